"""Plans, graphs, evidence, gates, views, lineage."""

import hashlib
import itertools
import random

import pytest

from treeline.operators import blocks, evidence, frontier, gates, graph, lineage, planning, view
from treeline.operators.planning import Candidate, Policy, Tree


def small_tree():
    return Tree([
        Candidate("root", "root", None, 300, 30, False, False, 0.5, 0.5),
        Candidate("root/safe", "root/safe", "root", 200, 20, True, False, 0.1, 0.2),
        Candidate("root/protected", "root/protected", "root", 100, 10, False, True, 0.9, 0.9),
    ])


POLICY = Policy(250, 1000, 0.1)


DDL = "candidate_id string, parent_id string, recursive_bytes long, file_count long, eligible int, protected int, preservation_risk double, incoherence double"


def as_rows(spark, tree):
    return spark.createDataFrame([(c.id, c.parent, c.bytes, c.files, int(c.eligible), int(c.protected), c.risk, c.incoherence) for c in tree.all], DDL)


def sound(tree, actions, strict):
    """Whether actions hold, by walking down from the roots."""

    def holds_protected(i):
        return any(tree.by_id[k].protected or holds_protected(k) for k in tree.children[i])

    def walk(i, fixed):
        c, a = tree.by_id[i], actions[i]
        if fixed is None:
            good = (a == 3) == c.protected and (a != 2 or bool(tree.children[i])) and (a != 1 or (c.eligible and POLICY.fits(c) and not (strict and holds_protected(i))))
        else:
            good = a == (3 if c.protected else fixed)
        return good and all(walk(k, 3 if a == 3 else None if fixed is None and a == 2 else 0) for k in tree.children[i])

    return all(walk(r, None) for r in tree.roots)


def random_tree(rng, prefix=""):
    parent = {"a": None, "a/b": "a", "a/c": "a", "a/b/d": "a/b", "a/e": "a"}
    return Tree(Candidate(prefix + i, prefix + i, up and prefix + up, rng.randint(1, 300), rng.randint(1, 9), rng.random() < 0.6, rng.random() < 0.2, rng.random(), rng.random()) for i, up in parent.items())


def test_exact_plans_and_violations_equal_brute_force(spark):
    rng = random.Random(4)
    trees = {f"t{k}a": random_tree(rng, f"t{k}") for k in range(8)}
    every = None
    for t in trees.values():
        every = as_rows(spark, t) if every is None else every.unionByName(as_rows(spark, t))
    got = frontier.exact_plans(every, POLICY).collect()
    for root, tree in trees.items():
        ids = [c.id for c in tree.all]
        choices = [dict(zip(ids, a, strict=True)) for a in itertools.product(range(4), repeat=5)]
        valid = [tree.metrics(a) for a in choices if sound(tree, a, True)]
        want = {tuple(round(x, 9) for x in m) for m in valid if not any(planning.dominates(o, m) for o in valid)}
        assert {tuple(round(r[c], 9) for c in planning.METRICS) for r in got if r["root"] == root} == want
    tree = trees["t0a"]
    ids = [c.id for c in tree.all]
    choices = [dict(zip(ids, a, strict=True)) for a in itertools.product(range(4), repeat=5)]
    acts = spark.createDataFrame([(n, i, x) for n, a in enumerate(choices) for i, x in a.items()], "plan_id long, candidate_id string, action int")
    for strict in (False, True):
        broken = {r[0] for r in frontier.plan_violations(acts, as_rows(spark, tree), POLICY, strict=strict).select("plan_id").distinct().collect()}
        assert broken == {n for n, a in enumerate(choices) if not sound(tree, a, strict)}


def test_violations_of_odd_plans_are_rows(spark):
    good = [("root", 2), ("root/safe", 1), ("root/protected", 3)]
    plans = {"ok": good, "short": good[:2], "twice": [*good, good[1]], "stranger": [*good, ("zz", 0)], "none": [("root", None), *good[1:]], "nine": [("root", 9), *good[1:]]}
    df = spark.createDataFrame([(p, c, a) for p, rows in plans.items() for c, a in rows], "plan_id string, candidate_id string, action int")
    rules = {}
    for r in frontier.plan_violations(df, as_rows(spark, small_tree()), POLICY).collect():
        rules.setdefault(r["plan_id"], set()).add(r["rule"])
    whole = "does not name every candidate once"
    assert rules["short"] == rules["twice"] == {whole} and rules["stranger"] == {"unknown candidate"}
    assert "unknown action" in rules["none"] and "unknown action" in rules["nine"] and "ok" not in rules


def test_reduced_plans(spark):
    rows = [("r", f"p{i}", float(-i), float(20 - i), i / 10, float(i), float(i), i / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "root string, plan_id string, " + ", ".join(f"{c} double" for c in planning.METRICS))
    got = {r["plan_id"]: r["labels"] for r in frontier.reduce_plans(df).collect()}
    assert len(got) == 12 and got["p0"] == "fewest-archives,lowest-incoherence,lowest-temporary-space,safest" and got["p19"] == "greatest-potential-recovery"
    assert sum("knee-compromise" in v for v in got.values()) == 1
    assert frontier.reduce_plans(df.limit(0)).count() == 0


def test_exact_plans_solve_every_root(spark):
    rows = [(c.id.replace("root", r), c.parent and r, c.bytes, c.files, int(c.eligible), int(c.protected), c.risk, c.incoherence) for r in ("a", "b") for c in small_tree().all]
    rows.append(("a/safe/deep", "a/safe", 50, 5, 1, 0, 0.1, 0.1))
    df = spark.createDataFrame(rows, DDL)
    got = frontier.exact_plans(df, POLICY).collect()
    assert {r["root"] for r in got if r["state"] == "COMPLETE" and r["archives"] == 1} == {"a", "b"}
    assert {-r["negative_recoverable_bytes"] for r in got if r["root"] == "a"} == {0.0, 50.0, 200.0}
    over = frontier.exact_plans(df, POLICY, limit=1).collect()
    assert [(r["root"], r["state"], r["plan_id"]) for r in sorted(over)] == [("a", "SKIPPED_LIMIT", None), ("b", "SKIPPED_LIMIT", None)]

    from treeline.plans import registry

    sf = "/root/testdata/sf0.001"
    roots = {r["candidate_id"].partition("/")[0] for r in registry.QUERIES["candidate_tree"](spark, sf).collect()}
    assert len(roots) == 20 and {r["root"] for r in registry.QUERIES["exact_plans"](spark, sf).collect()} == roots


def test_sampled_hashes_cover_every_document(spark):
    from treeline.plans import registry

    sf = "/root/testdata/sf0.001"
    assert registry.QUERIES["sampled_hash_d2"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_repair():
    tree = small_tree()
    assert planning.repair(tree, POLICY, {"root": 1, "root/safe": 1, "root/protected": 1}) == {"root": 0, "root/safe": 0, "root/protected": 3}
    assert sound(tree, planning.repair(tree, POLICY, {"root": 2.2, "root/safe": 0.9, "root/protected": 0}), True)


def test_labels(spark):
    want = {
        "a/b c": "b-c-" + hashlib.sha256(b"a/b c").hexdigest()[:12] + ".zip",
        "x/---": "group-" + hashlib.sha256(b"x/---").hexdigest()[:12] + ".zip",
        "y/\u00e9t\u00e9.": "t-" + hashlib.sha256("y/\u00e9t\u00e9.".encode()).hexdigest()[:12] + ".zip",
        "z" * 90: "z" * 60 + "-" + hashlib.sha256(b"z" * 90).hexdigest()[:12] + ".zip",
        "": "root-e3b0c44298fc.zip",
    }
    got = spark.createDataFrame([(n,) for n in want], "p string").select("p", planning.archive_label("p").alias("label")).collect()
    assert {r["p"]: r["label"] for r in got} == want


def test_proposal(spark):
    agg = spark.createDataFrame([("", 9, 9), ("a", 6, 6), ("a/b", 3, 3), ("c", 3, 3), ("d", 0, 0), ("d/e", 0, 0)], "relative_path string, recursive_bytes long, file_count long")
    dec = spark.createDataFrame([("a", "ARCHIVE_ELIGIBLE"), ("a/b", "ARCHIVE_ELIGIBLE"), ("c", "PROTECT"), ("d/e", "ARCHIVE_ELIGIBLE")], "relative_path string, decision string")
    none = spark.createDataFrame([], "relative_path string")
    got = {r["relative_path"]: r["action"] for r in planning.proposal(agg, dec, none).collect()}
    assert got == {"a": "ARCHIVE_AS_UNIT", "a/b": "KEEP_UNPACKED", "c": "PROTECTED", "d": "DEFER_TO_CHILDREN", "d/e": "KEEP_UNPACKED"}
    broken = {r["relative_path"]: r["action"] for r in planning.proposal(agg, dec, spark.createDataFrame([("a/x",)], "relative_path string")).collect()}
    assert (broken["a"], broken["a/b"]) == ("DEFER_TO_CHILDREN", "ARCHIVE_AS_UNIT")


def test_graph(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "f")], "source string, target string").selectExpr("*", "'DEPENDS_ON' AS relationship_type", "1.0D AS confidence")
    roots = {r["node"]: r["root"] for r in graph.components(nodes, edges).collect()}
    assert roots == dict(zip("abcdefg", "aaaaeeg", strict=True))
    assert {r["node"]: r["cut_risk"] for r in blocks.cut_risk(nodes, edges).collect()} == dict(zip("abcdefg", (0, 1, 0, 0, 0, 0, 0), strict=True))
    ranks = {r["node"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9
    with pytest.raises(Exception, match="bad relation"):
        graph.check_relations(edges.withColumnRenamed("source", "t").selectExpr("target AS source", "target", "relationship_type")).collect()


def test_evidence(spark):
    for data in (b"", b"abcd", b"abcde", b"abcdefghij", bytes(range(200))):
        offsets = [0] if len(data) <= 4 else sorted({0, (len(data) - 4) // 2, len(data) - 4})
        framed = b"treeline-sampled-v1\x00" + len(data).to_bytes(8, "big") + b"".join(at.to_bytes(8, "big") + len(data[at : at + 4]).to_bytes(8, "big") + data[at : at + 4] for at in offsets)
        row = evidence.hash_content(spark.createDataFrame([("p", bytearray(data))], "relative_path string, content binary"), "D2", sample=4).first()
        assert (row["digest"], row["bytes_read"]) == (hashlib.sha256(framed).hexdigest(), sum(len(data[at : at + 4]) for at in offsets))
    files = spark.createDataFrame([("m/a.wav", b"same"), ("m/b.wav", b"same"), ("m/c.wav", b"else")], "relative_path string, content binary")
    for level, status in (("D2", "CANDIDATE"), ("D3", "CONFIRMED"), ("D4", "CONFIRMED")):
        hashed = evidence.hash_content(files, level)
        groups = evidence.duplicate_groups(hashed)
        row = groups.collect()
        assert len(row) == 1 and row[0]["member_count"] == 2 and row[0]["evidence_status"] == status
        assert {r["relative_path"] for r in evidence.duplicate_members(hashed, groups).collect()} == {"m/a.wav", "m/b.wav"}
    agg = spark.createDataFrame([("", 16, 100), ("m", 3, 12)], "relative_path string, file_count long, recursive_bytes long")
    got = {r["relative_path"]: r for r in evidence.directory_evidence(agg, hashed, groups, evidence.duplicate_members(hashed, groups)).collect()}
    assert (got[""]["coverage"], got[""]["confirmed_ratio"], got["m"]["selected_files"]) == (3 / 16, 2 / 3, 3)


def _measured(spark, gates_):
    rows = [(g, m, v if isinstance(v, bool) else None, None if isinstance(v, bool) else float(v)) for g, facts in gates_.items() for m, v in facts.items()]
    return spark.createDataFrame(rows, "gate string, metric string, flag boolean, number double")


def test_gates(spark):
    scale = {"duration_seconds": 1, "maximum_duration_seconds": 2, "peak_rss_bytes": 1, "maximum_peak_rss_bytes": 2, "temporary_bytes": 0, "maximum_temporary_bytes": 1, "observed_entry_count": 2_000_000, "minimum_entry_count": 1_000_000, "completed": True, "inputs_unchanged": True}
    viewer = scale | {"query_count": 100, "p95_query_seconds": 1, "maximum_p95_query_seconds": 2, "query_only": True}
    every = {g: dict.fromkeys(f, True) for g, f in gates.FACT_GATES.items()} | dict.fromkeys(gates.SCALE_GATES, scale) | {"viewer_search_scale": viewer}
    none = gates.evaluate(_measured(spark, {}))
    assert gates.overall(none).first()[0] == "INCOMPLETE" and none.count() == 9
    assert gates.overall(gates.evaluate(_measured(spark, every))).first()[0] == "PASS"
    for broken, reason in (({"duration_seconds": 3}, "duration_seconds must be at most maximum_duration_seconds"), ({"minimum_entry_count": 10}, "minimum_entry_count must be at least 1000000"), ({"completed": 1}, "completed must be true"), ({"temporary_bytes": -1}, "temporary_bytes must be at most maximum_temporary_bytes")):
        found = gates.evaluate(_measured(spark, every | {"scanner_scale": scale | broken}))
        assert {r["gate"]: r["reasons"] for r in found.where("status = 'FAIL'").collect()} == {"scanner_scale": [reason]} and gates.overall(found).first()[0] == "FAIL"
    with pytest.raises(Exception, match="unknown gate"):
        gates.evaluate(_measured(spark, {"no_such": {"x": True}})).collect()


def test_pagerank_is_one_whatever_the_size(spark, monkeypatch):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "node string")
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("zz", "a"), ("a", "zz"), (None, "b")]
    edges = spark.createDataFrame([(*r, "DEPENDS_ON") for r in rows], "source string, target string, relationship_type string")
    small = {r["node"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    monkeypatch.setattr(graph, "ROUNDS", 12)
    large = {r["node"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    assert graph._ranks(["a", "b", "c", "d"], [r for r in rows if "zz" not in r and r[0]]).tolist() == pytest.approx([large[n] for n in "abcd"], abs=1e-9)
    assert set(small) == set(large) == set("abcd") and abs(sum(large.values()) - 1) < 1e-9


def test_selected_files_are_read_or_named(spark, tmp_path):
    base = tmp_path / "in (a+b)"
    (base / "x").mkdir(parents=True)
    for name, data in (("x/same.txt", b"1234"), ("x/grown.txt", b"12345"), ("top.txt", b"1")):
        (base / name).write_bytes(data)
    files = spark.createDataFrame([("x/same.txt", 4, None), ("x/grown.txt", 4, None), ("top.txt", 1, None), ("x/gone.txt", 4, None), ("top2.txt", 1, 5)], "relative_path string, logical_bytes long, modified_ns long")
    read, errors = evidence.read_selected(files, str(base))
    assert {r["relative_path"]: bytes(r["content"]) for r in read.collect()} == {"x/same.txt": b"1234", "top.txt": b"1"}
    assert {tuple(r) for r in errors.collect()} == {("x/grown.txt", "CHANGED"), ("x/gone.txt", "MISSING"), ("top2.txt", "MISSING")}


def test_view(spark):
    rows = [("file", "B%x", None, "B%x", "", 2, 5, 1), ("file", "a_b", None, "a_b", "", 9, None, 1), ("directory", "Été", None, "", "", 0, None, 1)]
    items = spark.createDataFrame(rows, "kind string, relative_path string, parent_path string, name string, extension string, logical_bytes long, modified_ns long, depth long")
    names = lambda df: [r["relative_path"] for r in df.collect()]
    assert names(view.search(items, "%")) == ["B%x"] and names(view.search(items, "_")) == ["a_b"] and names(view.search(items, "b")) == ["a_b", "B%x"]
    assert names(view.search(items, "éT")) == [] and names(view.search(items, "é", kind="directory")) == ["Été"]
    assert names(view.page(items, "SIZE", descending=True)) == ["a_b", "B%x", "Été"]
    assert names(view.search_after(items, "", ("a_b", "file", "a_b"))) == ["B%x", "Été"]
    for bad in (0, 501, True):
        with pytest.raises(ValueError):
            view.search(items, limit=bad)


PROPOSAL = "proposal_id long, relative_path string, decision string, expected_revision long, note string"


def test_decisions_are_appended_against_a_revision(spark, tmp_path):
    log = view.DecisionLog(spark, f"file://{tmp_path}/log")
    outcomes = lambda df: {r["proposal_id"]: (r["outcome"], r["previous_decision"], r["revision"]) for r in df.collect()}
    first = [(1, "x", "PROTECT", None, None), (2, "x", "KEEP", 0, "later"), (3, "y", "KEEP", 1, None), (4, "z", "NO", 0, None), (5, "a/../b", "KEEP", 0, None), (6, "/abs", "KEEP", 0, None), (7, "n", "KEEP", 0, "x" * 4001), (8, "n", "KEEP", 0, "nul\x00"), (9, None, "KEEP", 0, None), (10, "w", "KEEP", 0, "x" * 4000)]
    got = outcomes(log.append(spark.createDataFrame(first, PROPOSAL)))
    assert got == {1: ("APPENDED", None, 1), 2: ("CONFLICT", None, None), 3: ("CONFLICT", None, None), 10: ("APPENDED", None, 1), **{k: ("INVALID", None, None) for k in range(4, 10)}}
    again = [(11, "x", "KEEP", None, None), (13, "x", "KEEP", 1, None), (12, "x", "UNKNOWN", 1, None), (14, "w", "PROTECT", 0, None)]
    got = outcomes(log.append(spark.createDataFrame(again, PROPOSAL)))
    assert got == {11: ("CONFLICT", "PROTECT", None), 12: ("APPENDED", "PROTECT", 2), 13: ("CONFLICT", "PROTECT", None), 14: ("CONFLICT", "KEEP", None)}
    assert {(r["relative_path"], r["decision"], r["revision"]) for r in view.current_decisions(log.events()).collect()} == {("x", "UNKNOWN", 2), ("w", "KEEP", 1)}
    assert outcomes(log.append(spark.createDataFrame([], PROPOSAL))) == {}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    """The second writer judges before the first one commits, and finds its claim taken."""
    one, two = (view.DecisionLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    offer = lambda k, d: spark.createDataFrame([(k, "x", d, 0, None)], PROPOSAL)
    judged = []
    plain = view.judge_proposals

    def late(events, proposals):
        out = view.cut(plain(events, proposals))
        if not judged:
            judged.append(out.first()["outcome"])
            monkeypatch.setattr(view, "judge_proposals", plain)
            assert one.append(offer(2, "KEEP")).first()["outcome"] == "APPENDED"
            monkeypatch.setattr(view, "judge_proposals", late)
        return out

    monkeypatch.setattr(view, "judge_proposals", late)
    assert two.append(offer(1, "PROTECT")).first()["outcome"] == "CONFLICT" and judged == ["APPENDED"]
    assert [r["decision"] for r in two.events().collect()] == ["KEEP"]
    (tmp_path / "log" / "claim-2").touch()
    with pytest.raises(RuntimeError, match="commit 2 was claimed"):
        one.append(offer(3, "KEEP"))


def test_artifact_detects_changes(spark, tmp_path):
    run = lineage.Artifact(spark, f"file://{tmp_path}/run")
    df = spark.createDataFrame([("b", 1), ("a", 2)], "p string, n long")
    first = run.write("analysis", {"t": df}, run_id="r", inputs={"snapshot": "x"}, order={"t": ("p",)}, finished_at="2024-01-01T00:00:00Z")
    assert run.verify("analysis") == first
    assert lineage.ordered_digest(df.repartition(3), "p") == lineage.ordered_digest(df, "p")
    assert lineage.multiset_digest(df.repartition(3)) == lineage.multiset_digest(df) != lineage.multiset_digest(df.limit(1))
    df.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/run/t")
    with pytest.raises(ValueError, match="stage t was changed after the run: altered from 'a' to 'b'"):
        run.verify("analysis")
    path = str(tmp_path / "receipt.json")
    lineage.write_receipt({"a": 1}, path)
    assert lineage.read_receipt(path) == {"a": 1}
    with open(path, "a") as f:
        f.write(" ")
    with pytest.raises(ValueError):
        lineage.read_receipt(path)
    assert lineage.iso_micros(1704067200123456789) == "2024-01-01T00:00:00.123457Z" and lineage.iso_micros(None) is None
