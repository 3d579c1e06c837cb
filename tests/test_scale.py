"""Operators that may not put a hot group into one task, against plain loops over random inputs."""

import hashlib
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import blocks, gates, hashtree, ranking, similarity, textindex


def test_grid_ranks_equal_chains(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 700
    kinds = {
        "even": (low := rng.random((n, 4)).round(2), low + rng.random((n, 4)).round(2) * 0.1),
        "chain": (low := np.repeat(rng.random((n, 1)).round(3), 4, 1), low),
        "ties": (low := rng.integers(0, 3, (n, 4)).astype(float), low + rng.integers(0, 2, (n, 4))),
        "flat": (low := np.column_stack([rng.random(n).round(3), np.ones((n, 3))]), low),
        "one": (np.zeros((1, 4)), np.zeros((1, 4))),
    }
    rows, want = [], {}
    for cohort, (low, high) in kinds.items():
        vectors = np.unique(np.hstack([low, high]), axis=0)
        ranks = ranking.chain_ranks(vectors[:, :4], vectors[:, 4:])
        for v, r in zip(vectors.tolist(), ranks.tolist(), strict=True):
            rows.append((cohort, *(x for i in range(4) for x in (v[i], v[4 + i]))))
            want[rows[-1]] = r
    schema = "cohort string, " + ", ".join(f"{k} double" for k in ranking._KEYS)
    df = spark.createDataFrame(rows, schema)
    for most in (100, 10_000):
        got = {tuple(r)[:-1]: r["pareto_rank"] for r in ranking.grid_ranks(df, most).collect()}
        assert got == want
    cells = ranking._grid(df, 40).groupBy("cohort", "cell").count().collect()
    # No cohort is one task: a cell holds few of its vectors, also where objectives go together or all but one are equal.
    assert all(r["count"] <= 80 for r in cells if r["cohort"] != "ties") and len(cells) > 60
    assert ranking.grid_ranks(df.limit(0)).count() == 0


def brute_pairs(sets, threshold):
    out = set()
    for a in sets:
        for b in sets:
            if a < b and (shared := len(sets[a] & sets[b])) and shared / len(sets[a] | sets[b]) >= threshold:
                out.add((a, b, shared, shared / len(sets[a] | sets[b])))
    return out


@pytest.mark.parametrize("block", [1000, 3])
def test_similar_sets_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(block)
    pool = [f".e{i}" for i in range(12)] + ["1:a", "a", "é"]
    sets = {f"p{i:03}": {".md"} | set(rng.sample(pool, rng.randint(0, 6))) for i in range(90)} | {f"q{i}": {".md"} for i in range(40)}
    rows = [(k, m) for k, s in sets.items() for m in s] * 2 + [(None, ".md"), ("p000", None), ("none", None)]
    df = spark.createDataFrame(rows, "project string, extension string")
    for threshold in (0.2, 0.5, 0.75, 1.0):
        pairs, named = similarity.similar_sets(df, "project", "extension", threshold)
        got = [tuple(r) for r in similarity.set_pairs(pairs, named).collect()]
        want = brute_pairs(sets, threshold)
        assert len(got) == len(set(got)) and set(got) == want
        # Equal sets are one: the join never sees the forty copies.
        assert pairs.count() <= len({frozenset(s) for s in sets.values()}) ** 2 / 2
        edges, degrees = similarity.set_graph(pairs, named)
        near = Counter(x for a, b, *_ in want for x in (a, b))
        assert {r["node"]: r["degree"] for r in degrees.collect()} == {k: near[k] for k in sets}
        assert all((min(a, b), max(a, b)) in {(x, y) for x, y, *_ in want} for a, b in (tuple(r) for r in edges.collect()))
    assert similarity.similar_sets(df.limit(0), "project", "extension", 0.5)[0].count() == 0
    with pytest.raises(ValueError):
        similarity.similar_sets(df, "project", "extension", 0.0)


def brute_tree(rows, fan):
    """{(level, idx): (rows, first key, last key, hash)} of (key, value) rows."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    level = sorted(((k is not None, k or ""), sha(frame(k) + frame(v)), k or "") for k, v in rows)
    nodes, out, at = [(1, k, k, h) for _, h, k in level], {}, 0
    while nodes:
        nodes = [(sum(n for n, *_ in run), run[0][1], run[-1][2], sha("".join(h for *_, h in run))) for i in range(0, len(nodes), fan) for run in [nodes[i : i + fan]]]
        out |= {(at, i): n for i, n in enumerate(nodes)}
        if len(nodes) == 1:
            break
        at += 1
    return out


def test_hash_trees(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "é", "", *(f"k{i:03}" for i in range(150))]), rng.choice([None, 1, 2])) for _ in range(300)]
    schema = "k string, v long"
    df = spark.createDataFrame(rows, schema)
    trees = {}
    for fan in (2, 7, 64):
        for parts in (1, 9):
            tree = hashtree.hash_tree(df.repartition(parts), ["k"], fan)
            assert {(r["level"], r["idx"]): tuple(r)[2:] for r in tree.collect()} == brute_tree(rows, fan)
        trees[fan] = tree
    assert hashtree.root(trees[7]) == max(brute_tree(rows, 7).items())[1][3]
    # A flipped row is found in its chunk alone; keys stay, so nothing moves.
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    at = next(i for i, r in enumerate(order) if r[0] == "k070")
    flipped = [(k, 9) if k == "k070" else (k, v) for k, v in rows]
    got = hashtree.changed_ranges(trees[7], hashtree.hash_tree(spark.createDataFrame(flipped, schema), ["k"], 7), 7).collect()
    assert {r["idx"] for r in got} == {i // 7 for i, r in enumerate(order) if r[0] == "k070"} and at // 7 in {r["idx"] for r in got}
    assert all(r["change"] == "altered" and r["old_first"] <= "k070" <= r["old_last"] for r in got)
    assert hashtree.changed_ranges(trees[7], trees[7], 7).count() == 0
    # Rows at the end only add chunks; none at all removes every one.
    longer = hashtree.hash_tree(spark.createDataFrame([*rows, *(("z", i) for i in range(700))], schema), ["k"], 7)
    added = hashtree.changed_ranges(trees[7], longer, 7).collect()
    assert {r["idx"] for r in added} == set(range(300 // 7, 143)) and {r["change"] for r in added} == {"altered", "added"}
    empty = hashtree.hash_tree(df.limit(0), ["k"], 7)
    assert hashtree.root(empty) == hashtree.EMPTY and empty.count() == 0
    assert {r["change"] for r in hashtree.changed_ranges(trees[7], empty, 7).collect()} == {"removed"}
    with pytest.raises(ValueError):
        hashtree.hash_tree(df, ["k"], 1)


def brute_cuts(names, links):
    """How many more parts there are among a node's neighbours without it."""
    near = {n: set() for n in names}
    for a, b in links:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for gone in names:
        parts, seen = 0, {gone}
        for start in near[gone]:
            if start not in seen:
                parts, todo = parts + 1, [start]
                while todo:
                    if (n := todo.pop()) not in seen:
                        seen.add(n)
                        todo += near[n]
        out[gone] = max(0, parts - 1)
    return out


def test_cut_risk_on_random_graphs(spark):
    rng = random.Random(11)
    names, links = [], []

    def add(kind, n, pairs):
        shuffled = [f"{kind}{i:03}" for i in range(n)]
        rng.shuffle(shuffled)
        names.extend(shuffled)
        links.extend((shuffled[a], shuffled[b]) for a, b in pairs)

    # One run holds graphs of many shapes, each of components of its own.
    add("chain", 70, [(i, i + 1) for i in range(69)])
    add("ring", 33, [(i, (i + 1) % 33) for i in range(33)])
    add("star", 40, [(0, i) for i in range(1, 40)])
    add("full", 8, [(i, j) for i in range(8) for j in range(8)])
    add("cactus", 61, [e for i in range(0, 60, 2) for e in ((i // 4 * 2, i + 1), (i + 1, i + 2), (i + 2, i // 4 * 2))])
    for g, (n, m) in enumerate(((40, 30), (60, 62), (60, 75), (50, 120), (30, 29))):
        add(f"g{g}-", n, [(rng.randrange(n), rng.randrange(n)) for _ in range(m)])
    add("alone", 3, [])
    edges = spark.createDataFrame([*links, *links[:50], ("chain000", "nobody"), (None, "ring000"), ("star000", None)], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "node string")
    got = [tuple(r) for r in blocks.cut_risk(nodes, edges).collect()]
    assert len(got) == len(names) and dict(got) == brute_cuts(names, links)
    assert blocks.cut_risk(nodes.limit(0), edges).count() == 0
    assert {tuple(r)[1] for r in blocks.cut_risk(nodes.where("node like 'alone%'"), edges).collect()} == {0}


@pytest.mark.parametrize("rest", [100_000, 5])
def test_percentiles_of_hot_groups(spark, monkeypatch, rest):
    monkeypatch.setattr(gates, "REST", rest)
    monkeypatch.setattr(gates, "CUTS", 8)
    rng = random.Random(rest)
    groups = {
        "hot": [rng.random() * 10 ** rng.randint(-9, 9) for _ in range(3000)],
        "same": [4.0] * 400,
        "often": [rng.choice([1.0, 1.0, 1.0, 2.0, rng.random()]) for _ in range(500)],
        "signed": [rng.gauss(0, 5) for _ in range(333)] + [None] * 9,
        "one": [-1.0],
        "nulls": [None, None],
        None: [float(i) for i in range(100)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    for percent in (95, 50, 1, 100):
        got = {r["g"]: (r["p"], r["n"]) for r in gates.percentile(df, "v", "g", percent=percent).collect()}
        known = {g: sorted(v for v in vs if v is not None) for g, vs in groups.items()}
        assert got == {g: (vs[-(-percent * len(vs) // 100) - 1] if vs else None, len(groups[g])) for g, vs in known.items()}
    every = sorted(v for vs in groups.values() for v in vs if v is not None)
    assert [tuple(r) for r in gates.p95(df, "v").collect()] == [(every[-(-95 * len(every) // 100) - 1], df.count())]
    assert gates.p95(df.limit(0), "v", "g").count() == 0


def test_batches_of_searches_equal_plain_search(spark):
    rng = random.Random(5)
    letters = "abAB/._é1%"
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(400)} | {"x" * 5000 + "/Äend"}
    rows = [(rng.choice(["file", "directory"]), n) for n in sorted(names)] + [("file", "ab/ab"), ("file", "ab/ab"), ("file", None)]
    items = spark.createDataFrame(rows, "kind string, relative_path string")
    queries = ["", " ", "a", "B", "é", "é", "%", "_", "ab", "AB/", "b.a", "xxxx", "ÄEND", "zzz", "a" * 13, "/", " ab ", None, "ab"]
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    got: dict = {}
    for r in textindex.search_batch(items, asked, limit=7).collect():
        got.setdefault(r["query"], []).append(tuple(r)[1:])
    fold = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    for q in set(queries) - {None}:
        term = fold(unicodedata.normalize("NFC", q.strip()))
        want = sorted((fold(p), k, p) for k, p in rows if p is not None and term in fold(p))
        assert sorted(got.get(q, [])) == [(len(want), i + 1, k, p) for i, (_, k, p) in enumerate(want[:7])], q
    assert None not in got
    index = textindex.postings(items)
    again = textindex.search_batch(items, asked, index=index, limit=7)
    assert again.count() == sum(map(len, got.values())) and index.where("piece = 'zzz'").isEmpty()
    assert textindex.search_batch(items.limit(0), asked).count() == 0 and textindex.search_batch(items, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        textindex.search_batch(items, asked, limit=0)
