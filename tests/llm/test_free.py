"""Toxicity, near-duplicates, packing, token output, extraction, media and the pipeline, against brute force and round trips."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ROWS, prose
from pyspark.sql import functions as F

from treeline.llm import common, html, idcoder, media, neardup, packing, token_output, tokens, toxicity
from treeline.llm.tokens import encoder, vocabulary

VOCAB = vocabulary("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def library_ids(text):
    return encoder(VOCAB).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens_equal_the_library():
    rng = random.Random(7)
    letters = "aAbZéÉñßÿŸĲŁİıŉſ'.,!*#%019 \t\n\x1c\x85\xa0́ <|>endoftext_-ΑΣςж中ﬁǅ🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["don't WE'LL <|endoftext|>", None, ""]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(VOCAB).encode(texts)] == [library_ids(t) for t in texts]


def test_memory_of_words_does_not_change_ids(monkeypatch):
    letters = "".join(map(chr, range(0x21, 0x180)))
    texts = [" ".join(letters), letters, "a" * 100 + "!" * 60, "x]^_`{|}~\\ [x] a.b,c ", *(f"wörd{c}{m} Word{m}" for c in letters for m in ("", ".", "?!"))] * 2
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    fresh = tokens.PieceEncoder(VOCAB)
    assert [np.frombuffer(b, "<u4").tolist() for t in texts for b in fresh.encode([t])] == [library_ids(t) for t in texts]


def coded(ids):
    table, places = idcoder.table_of(ids)
    blocks = idcoder.encode_blocks(table, places)
    counts = [min(idcoder.BLOCK_IDS, len(ids) - i) for i in range(0, len(ids), idcoder.BLOCK_IDS)]
    again = idcoder.Table.unpacked(table.packed())
    assert np.array_equal(again.symbols[idcoder.decode_blocks(again, blocks, counts)], ids)
    return blocks, table


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 3000])
def test_id_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 20, n), rng.integers(0, 1 << 32, n), np.zeros(n, np.int64), rng.integers(0, 5, n), np.arange(n) % 7, np.arange(n) % 1500 // 3 * 7):
        blocks, _ = coded(ids)
        assert len(blocks) == -(-n // idcoder.BLOCK_IDS)
    if n > 2000:
        assert sum(map(len, coded(np.arange(n) % 7)[0])) < n / 3


def test_wide_tables(monkeypatch):
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.arange(700_000), rng.integers(0, 700_000, 50_000)])
    assert coded(ids)[1].bits > 12
    monkeypatch.setattr(idcoder, "MOST_SYMBOLS", 10)
    assert idcoder.table_of(ids)[0] is None
    keys, back = token_output.unpack_file(token_output.pack_file([1, 2], ids[:3000], np.array([2999, 1])))
    assert keys == [1, 2] and np.array_equal(np.concatenate(back), ids[:3000])


def test_mixing_beats_order_0_alone(spark):
    """Bits an id against an adaptive order-0 model that is reset as often, and the sum of all intervals."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = np.concatenate([np.frombuffer(b, "<u4") for b in encoder(VOCAB).encode(texts)]).astype(np.int64)
    blocks, table = coded(ids)
    own = (sum(map(len, blocks)) + len(table.packed())) * 8 / len(ids)
    spent = 0.0
    for at in range(0, len(ids), idcoder.BLOCK_IDS):
        seen = Counter()
        for k, x in enumerate(ids[at : at + idcoder.BLOCK_IDS].tolist()):
            # A twentieth of a count for every id of the file's table, which this model gets for nothing.
            spent -= np.log2((seen[x] + 0.05) / (k + 0.05 * len(table.symbols)))
            seen[x] += 1
    assert own < spent / len(ids)
    # One model step: the intervals of all ids lie side by side and fill the whole.
    table, places = idcoder.table_of(np.array([3, 3, 5, 9, 9, 9, 12] * 40))
    model = idcoder._Model(table, 1)
    for x in places[:50]:
        model.predict()
        at, prices = 0, []
        for y in range(len(table.symbols)):
            start, width = model.interval(np.array([y]), np.array([y], model.kind))
            assert start[0] == at and width[0] > 0
            at += int(width[0])
            prices.append(int(width[0]))
        assert at == 1 << model.total
        model.interval(np.array([x]), np.array([x], model.kind))
        model.learn(np.array([x]), np.array([x], model.kind))


def test_damaged_files_are_found():
    docs = [np.arange(k, dtype="<u4") for k in (3, 0, 2000)]
    data = token_output.pack_file([1, None, 3], np.concatenate(docs), np.array([3, 0, 2000]))
    keys, back = token_output.unpack_file(data)
    assert keys == [1, None, 3] and all(np.array_equal(a, b) for a, b in zip(back, docs, strict=True))
    for at in (8, 30, 70, len(data) - 20):
        with pytest.raises(token_output.DamagedFile):
            token_output.unpack_file(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    for size in [*range(0, len(data), 97), len(data) - 1]:
        with pytest.raises(token_output.DamagedFile):
            token_output.unpack_file(data[:size])


def test_token_output(spark, edge_docs, no_docs, tmp_path):
    got = token_output.read_index(token_output.write_ids(edge_docs, VOCAB, 1)).collect()
    want = Counter((k, len(library_ids(t)) + 1, crc([*library_ids(t), 1])) for k, t, _ in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda k: (k is not None, k or 0))
    assert token_output.read_index(token_output.write_ids(no_docs, VOCAB, 1)).count() == 0
    # Small files, laid out as files of their own and read back; one key with most rows is spread over them.
    rows = [(7, prose(i, 400)) for i in range(30)] + [(3, "first"), (9, "last")]
    files = token_output.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), VOCAB, 1, file_ids=3000)
    assert token_output.export_files(files, str(tmp_path)) == files.count() > 3
    again = token_output.import_files(spark, str(tmp_path))
    for some in (files, again):
        got = sorted(token_output.read_index(some).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [3] + [7] * 30 + [9]
        assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((k, crc([*library_ids(t), 1])) for k, t in rows)
        assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()


def test_packing(spark, edge_docs, no_docs):
    got = packing.pack(edge_docs, VOCAB, 0, 512, keep_ids=True).collect()
    want = Counter()
    for k, t, _ in ROWS:
        ids = [*library_ids(t), 0]
        for piece, start in enumerate(range(0, len(ids), 512)):
            want[k, piece, start, len(ids[start : start + 512]), crc(ids[start : start + 512])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(crc(np.frombuffer(bytes(r["ids"]), "<u4")) == r["ids_crc32"] for r in got)
    by = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 512 and len(by) <= -(-sum(by.values()) // 512) + 1
    assert packing.pack(no_docs, VOCAB, 0).count() == 0


def test_plans_hold_every_item():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 65, 400), np.full(50, 22), rng.integers(20, 40, 300), np.array([64, 64, 1])):
        histogram = dict(Counter(lengths.tolist()))
        groups = packing.plan(histogram, 64, rounds=60)
        held = Counter()
        for g in groups:
            assert sum(g.lengths) + g.space == 64 and g.space >= 0
            for x in g.lengths:
                held[x] += g.count
        assert held == histogram
        bins = []  # first fit decreasing
        for x in sorted(lengths.tolist(), reverse=True):
            spot = next((i for i, b in enumerate(bins) if b + x <= 64), None)
            if spot is None:
                bins.append(x)
            else:
                bins[spot] += x
        assert sum(g.count for g in groups) <= len(bins) + 2
    value = np.zeros(65)
    value[[7, 11, 30]] = 1.0, 1.7, 4.6
    best = sum(value[packing.best_configuration(value, 64)])
    assert best == max(a * 1.0 + b * 1.7 + c * 4.6 for a in range(10) for b in range(6) for c in range(3) if 7 * a + 11 * b + 30 * c <= 64)


def test_the_program_beats_best_fit():
    """Lengths that fill sequences in threes: best fit alone pairs them badly."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(60, 100, 4000), rng.integers(60, 100, 4000)
    counts = np.bincount(np.concatenate([a, b, 256 - a - b]), minlength=257)
    groups = packing.plan({int(x): int(counts[x]) for x in np.flatnonzero(counts)}, 256)
    used, alone, least = sum(g.count for g in groups), sum(g.count for g in packing.round_and_fill(counts, [], 256)), packing.least_bound(counts, 256)
    assert 4000 <= least <= used < alone
    # A bound is what no packing of a small instance goes under.
    small = np.bincount([60, 60, 60, 50, 50, 30], minlength=101)
    assert packing.least_bound(small, 100) <= 4 and packing.solve_program(small, 100, 50)[1] <= 4 + 1e-9


def test_the_chain_equals_brute_force():
    rng = random.Random(4)
    words = [f"{a}{b}o" for a in "bcdfghklmnrs" for b in "aeiou"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(200)]
    labels = np.array([["bao" in t, "ceo" in t, "bao" in t or "ceo" in t] for t in texts], int)
    docs = [toxicity.features(t) for t in texts]
    chain = toxicity.fit_chain(docs, labels, ["a", "b", "c"], np.arange(200) % 3)
    got = chain.probabilities(docs)
    for k, t in enumerate(texts):
        before = []
        parts = {f"{kind}{part}" for w in set(re.findall(r"[^\W\d_]+", t)) for kind, part in (("w", w), ("4", w[:4]), ("5", w[:5]))}
        for link in chain.links:
            score = link.bias + sum(link.weights[x] for x in {zlib.crc32(p.encode()) % toxicity.SPACE for p in parts}) + sum(e * p for e, p in zip(link.earlier, before, strict=True))
            before.append(1 / (1 + np.exp(-score)))
        assert np.allclose(got[k], before, atol=1e-9)
    # Later links read earlier ones.
    assert len(chain.links[2].earlier) == 2 and np.abs(chain.links[2].earlier).max() > 0
    assert ((got[:, 2] > 0.5) == labels[:, 2]).mean() > 0.9


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same_key_set = rows[i][0] is not None and rows[j][0] is not None
                if a and b and same_key_set and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (k, _) in zip(group, rows, strict=True):
        if k is not None:
            least[g] = min(least.get(g, k), k)
    return Counter((k, len(s), None if k is None else least[g], k is not None and least[g] == k) for (k, _), s, g in zip(rows, sets, group, strict=True))


def near_copies(n):
    base = prose(50, 100).split()
    out = []
    for i in range(n):
        rng, w = random.Random(i), list(base)
        for _ in range(i % 4):
            w[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_near_duplicates_equal_brute_force(spark, edge_docs, no_docs, monkeypatch):
    rows = [(k, t) for k, t, _ in ROWS]
    got = neardup.near_groups(edge_docs).collect()
    assert Counter(tuple(r) for r in got) == brute_groups(rows)
    assert neardup.near_groups(no_docs).count() == 0
    kept = neardup.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert stays(kept) == brute_stays(rows)


def stays(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def brute_stays(rows, percent=85):
    """One row of each group: the least key's; rows without a key or without words all stay."""
    sets = [shingle_set(t) for _, t in rows]
    out, group = Counter(), list(range(len(rows)))
    own = [k for k, s in enumerate(sets) if s and rows[k][0] is not None]
    links = [(i, j) for i in own for j in own if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while any(group[i] != group[j] for i, j in links):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    for g in set(group):
        own = [r for k, r in zip(group, rows, strict=True) if k == g]
        if own[0][0] is None or not shingle_set(own[0][1]):
            out.update(own)
        else:
            out[min(own, key=lambda r: r[0])] += 1
    return out


def test_rows_of_one_key_are_dropped_each(spark):
    a, b, c = prose(70, 60), prose(71, 60), prose(72, 60)
    rows = [(1, a), (9, a), (9, b), (9, b), (None, a), (None, a), (None, None), (5, None), (5, ""), (5, ""), (3, c), (12, c + " tail"), (12, b)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    assert stays(neardup.drop_near_duplicates(df)) == brute_stays(rows)
    same = spark.createDataFrame([(9, a, "x"), (9, a, "x"), (4, b, "y")], df.schema)
    assert stays(neardup.drop_near_duplicates(same)) == Counter({(9, a): 1, (4, b): 1})
    assert neardup.drop_near_duplicates(df).columns == df.columns
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rows = near_copies(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    for small, block, nodes in ((24, 256, 10**6), (3, 8, 0)):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "CELL", block)
        monkeypatch.setattr(neardup, "BROADCAST_NODES", nodes)
        assert Counter(tuple(r) for r in neardup.near_groups(df).collect()) == want


def test_the_pipeline_links_at_four_fifths(spark):
    import corpus_pipeline

    rows = []
    for i in range(20):
        words = prose(200 + i, 100).split()
        edited = [f"edit{j}" if j in (30, 60) else w for j, w in enumerate(words)]  # 86 of 106 shingles shared
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, df, SF).collect()} == set(range(0, 40, 2))
    assert neardup.near_groups(df, percent=85).where("kept").count() == 40


def shuffled_records(spark):
    """Rows that the last query's exchanges have written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    last = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())))
    values, nodes, total = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
            if node.name().strip() == "Exchange" and m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_texts_that_stay_are_not_shuffled(spark):
    """As on large inputs, where the marks of dropped rows are too many to be broadcast by themselves."""
    rows = [(i, prose(1000 + i, 30)) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:20]] + [(0, rows[0][1]), (None, rows[1][1]), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = neardup.drop_near_duplicates(df)
        got = left.collect()
        assert 20 < shuffled_records(spark) < 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert Counter(tuple(r) for r in got) == brute_stays(rows)


def test_a_sieve_loses_no_key(spark, monkeypatch):
    rows = spark.range(-1000, 5000).selectExpr("nullif(id, 7) as id", "id as _sieve_word", "id as _sieve_bits")
    keys = spark.range(0, 3000, 10).selectExpr("id as k")
    want = {r["k"] for r in keys.collect()}
    for most, passed in ((1 << 26, 700), (256, 6000)):
        monkeypatch.setattr(common, "SIEVE_MOST", most)
        may, rest = (x.collect() for x in common.sieved(rows, rows["id"], keys))
        assert want <= {r["id"] for r in may} and len(may) <= passed and len(may) + len(rest) == 6000
        assert all(r["id"] is None or r["id"] == r["_sieve_word"] for r in may + rest)
    assert common.sieved(rows, rows["id"], keys.limit(0))[1].count() == 6000


def test_sketches():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 1000):
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        c = neardup.sketch(s)
        assert len(c) == neardup.T and (c >> np.uint64(40)).max() < 2 * neardup.T and np.array_equal(c, neardup.sketch(s))
    shared = rng.integers(0, 2**63, 800, dtype=np.uint64)
    agree = []
    for k in range(30):
        a, b = (np.unique(np.concatenate([shared, np.random.default_rng(k * 2 + j).integers(0, 2**63, 100, dtype=np.uint64)])) for j in (0, 1))
        agree.append((neardup.sketch(a) == neardup.sketch(b)).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_toxicity_held_out(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    chain = toxicity.train(docs, labels.where(~held))
    got = toxicity.score(docs.select("doc_id", "text"), chain).join(labels.where(held), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in got}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.9
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) < 0.01
    scored = toxicity.score(edge_docs, chain)
    assert scored.columns == ["doc_id", "p_toxic_prose", "p_toxic_junk", "p_toxic", "rejected"] and scored.count() == len(ROWS)
    kept = toxicity.drop_toxic(edge_docs, chain)
    assert kept.columns == edge_docs.columns and kept.count() == scored.where("NOT rejected").count()
    assert toxicity.score(no_docs, chain).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(edge_docs, none).select("p_toxic").distinct().collect()[0][0] == 0.5


def page(host, i, body):
    return (i, f"https://{host}/p/{i}", f"<html><head><title>t{i}</title><style>p{{}}</style></head><body>{body}</body></html>", "x")


ARTICLE = '<nav><a href="/">Home</a></nav><div class="ad">buy</div><article><h1>Head &amp; {0}</h1><p>First&nbsp;  line<br>of {0}<p>second <b>bold</b> part<aside>side</aside><form><input value="x>y">go</form><section class="comments"><p>reader</p></section></article><footer>f</footer><script>var a="</p>";</script>'
PLAIN = '<div class="site-header">Site</div><div class="box"><p>Welcome to us, all of you readers of this and that</p></div><div class="text"><p>Own words {0} of the page, quite a few of them here</p><p>and more {0} words to be read</p></div><div class="cookie-notice">ok?</div>'


def test_extraction(spark):
    rows = [page("a.org", i, ARTICLE.format(i)) for i in range(3)] + [page("b.org", 10 + i, PLAIN.format(i)) for i in range(5)]
    rows += [(20, None, None, "x"), (21, "nohost", "", "x"), (22, "http://c", "<p>only &lt;text&gt; &#233;<li>one<li>two", "x"), (None, "http://c/2", "no tags at all", "x"), (23, "http://c/3", "<div>open <span>never closed", "x"), (23, "http://c/3", "<div>open <span>never closed", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, token string")
    got = html.extract_main_text(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(3):
        assert by[i] == f"Head & {i}\nFirst line of {i}\nsecond bold part"
    for i in range(5):
        assert by[10 + i] == f"Own words {i} of the page, quite a few of them here\nand more {i} words to be read"
    assert (by[20], by[21], by[23]) == ("", "", "open never closed")
    assert by[22] == "only <text> é\none\ntwo" and by[None] == "no tags at all"
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_template_inside_articles(spark):
    body = '<article><p>Story {0} has its own words<p>Join our <b>letter</b> today<p>told <b>by</b> {0}</article>'
    rows = [page("t.org", i, body.format(i)) for i in range(6)] + [page("copies.org", 20 + i, body.format(9)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, token string")
    by = {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()}
    for i in range(6):
        assert by[i] == f"Story {i} has its own words\ntold by {i}"
        assert by[20 + i] == "Story 9 has its own words\nJoin our letter today\ntold by 9"


def test_sibling_sections_stay(spark):
    body = '<div id=content><section id=intro><p>Opening {0}</section><section id=body><p>The longer body of page {0}</section></div><div class=lead>Lead {0}</div>'
    df = spark.createDataFrame([page("s.org", i, body.format(i)) for i in range(5)], "page_id long, url string, html string, token string")
    got = html.extract_main_text(df).collect()
    assert len(got) == 5 and all(r["text"] == "Opening {0}\nThe longer body of page {0}\nLead {0}".format(r["page_id"]) for r in got)


def test_layouts_nest(spark):
    def body(k, i):
        return f"<div class=kind{k}><div class=links><p>Menu of kind {k}</div><div class=text><p>Own words {i}</div><p>Ends kind {k}</div>"

    rows = [page("l.org", i, body(i % 3, i)) for i in range(15)]
    # Near copies on a small part of the host, in a container of their own, are no layout.
    rows += [page("l.org", 20 + i, f"<div id=post-7><p>Three times told<p>at {i}</div>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, token string")
    by = {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()}
    assert all(by[i] == f"Own words {i}" for i in range(15))
    assert all(by[20 + i] == f"Three times told\nat {i}" for i in range(3))


@pytest.mark.parametrize("kinds", [5, 6, 8])
def test_many_layouts(spark, kinds):
    """Layouts that each are on a small part of their host lose their menus too."""
    body = "<div class=kind{0}><div class=links><ul><li>First of {0}<li>Second of {0}</ul></div><div class=text><p>Own words {1}, and more</div><p>Ends {0}</div>"
    rows = [page("m.org", i, body.format(chr(97 + i % kinds), i)) for i in range(kinds * 10)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, token string")).collect()
    assert {r["text"] for r in got} == {f"Own words {i}, and more" for i in range(kinds * 10)}


def test_words_cut_no_article_block_alone(spark):
    body = "<article><h1>Study {0}</h1><div class='ad-libitum'>Fed at will {0}</div><section class='search-results-study'><p>Found {0}</section><ul class='related-work'><li>Work {0}</ul></article>"
    rows = [page(f"w{i}.org", i, body.format(i)) for i in range(3)]
    # On one of many pages of a host they are no template either; on most of them the template has them.
    rows += [page("x.org", 10 + i, body.format(i) if i == 0 else f"<article><p>Text {i}</article>") for i in range(12)]
    rows += [page("y.org", 30 + i, f"<div><p>Text {i} of its own</div><div class=related-links><a>Other {i * 7}</a></div>") for i in range(12)]
    by = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, token string")).collect()}
    for k, i in ((0, 0), (1, 1), (2, 2), (10, 0)):
        assert by[k] == f"Study {i}\nFed at will {i}\nFound {i}\nWork {i}"
    assert all(by[30 + i] == f"Text {i} of its own" for i in range(12))


@pytest.mark.parametrize("unit", ["<a x ", "<div>", "</i>", "<b>", "<b></p>", "<i><div>", "<p class=\"", "<p class='x", "<!--", "<title>", "<td><tr>", "&amp", "<a =", "<a ='", "class=", "<x/"])
def test_the_parser_is_linear(unit):
    import time

    def took(n):
        text = unit * (n // len(unit)) + "'" + " end"
        began = time.perf_counter()
        html.parse(text)
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 1.5


def test_attributes_are_read_like_a_browser():
    said = lambda t: " ".join("".join(r.text for r in html.parse(t)[1]).split())
    assert said("<p it's>one</p><p title='a>b'>two</p><a href=x'y>three</a><input value=\"> no\">four") == "onetwothreefour"
    assert said("a < b and <3 and </ x> c") == "a < b and <3 and </ x> c"


def test_classes_equal_brute_force_vectors(spark):
    """Tokens of a host are in one class if they occur as often on the same distinct pages."""
    rng = random.Random(9)
    parts = ["<nav>menu</nav>", "<div class=box><p>Same words</p></div>", "<ul><li>one<li>two</ul>", "<p>{0}</p>", "<section><p>shared</p><p>shared</p></section>", "<div class=side-bar>x</div>"]
    rows = [page(f"h{i % 2}.org", i, "".join(rng.choice(parts) for _ in range(6)).format(i % 9)) for i in range(40)]
    schema = "host string, page binary, kind int, token long, place long, count long"
    df = spark.createDataFrame([(u.split("/")[2], h) for _, u, h, _ in rows], "host string, html string")
    from treeline.llm.common import map_arrow

    tokens = map_arrow(df, html._tokens, schema).groupBy("host", "page", "kind", "token", "place").agg(F.max("count").alias("count"))
    got = {}
    for r in html.occurrence_vectors(tokens).collect():
        got.setdefault((r["host"], r["support"], r["vector"]), set()).add((r["kind"], r["token"]))
    seen = {}
    for u, h in {(u.split("/")[2], h) for _, u, h, _ in rows}:
        tags, free, _, key = html._free(u, h)
        count = Counter([(0, t) for t, _, _ in tags] + [(2, m) for _, _, m in tags if m])
        count.update((3 if r.main else 1, html.run_token(r.box, html._clean(r.text))) for r in free if html._clean(r.text))
        for token, n in count.items():
            seen.setdefault((u, token), {})[key] = n
    want = {}
    for (host, token), vector in seen.items():
        want.setdefault((host, frozenset(vector.items())), set()).add(token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_media(spark, edge_docs, no_docs):
    got = media.store_and_fingerprint(edge_docs).collect()
    want = Counter()
    for k, t, _ in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes((64 - len(raw) % 64) % 64 if raw else 64)
        want[k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        assert (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) == (r["media_bytes"], r["media_sha256"]) and len(r["times"]) == len(r["codes"])
    same = {}
    for r in got:
        assert same.setdefault(r["payload_sha256"], r["codes"]) == r["codes"]
    assert media.store_and_fingerprint(no_docs).count() == 0


def test_fingerprints_equal_a_direct_transform(monkeypatch):
    payload = media.payload_of(prose(3, 500))[0]
    t, c = media.fingerprint(payload)
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    total = max(1, -(-(len(x) - 256) // 128) + 1)
    x = np.concatenate([x, np.zeros(256 + 128 * total - len(x))])
    k = np.arange(129)
    mag = np.array([[abs((x[f * 128 : f * 128 + 256] * media._WINDOW * np.exp(-2j * np.pi * b * np.arange(256) / 256)).sum()) for b in k] for f in range(total)])
    peaks = [(f, b) for f in range(total) for b in k if mag[f, b] > 1 and mag[f, b] >= mag[max(0, f - 2) : f + 3, max(0, b - 8) : b + 9].max() - 1e-3]
    pairs = {(a[0], a[1] << 40 | b[1] << 32 | b[0] - a[0]) for n in (1, 2) for a, b in zip(peaks, peaks[n:], strict=False)}
    got = set(zip(t.tolist(), c.tolist(), strict=True))
    assert len(got & pairs) >= 0.98 * max(len(got), len(pairs))
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all(np.array_equal(a, b) for a, b in zip(media.fingerprint(payload), (t, c), strict=True))


def contaminated(text, grams):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit = {i for n in {len(g) for g in grams} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in grams for i in range(s, s + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, df = [docs.collect()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == docs.columns, name
        df = out.persist()
        seen.append(df.collect())
        assert set(seen[-1]) <= set(seen[-2]), name
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = chain.probabilities([toxicity.features(r["text"]) for r in seen[0]])[:, -1] >= 0.5
    assert {r["doc_id"] for r, b in zip(seen[0], bad, strict=True) if not b} == {r["doc_id"] for r in seen[1]}
    assert stays(spark.createDataFrame(seen[2], docs.schema)) == brute_stays([(r["doc_id"], r["text"]) for r in seen[1]], percent=80)
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        grams |= {tuple(w[s : s + min(13, len(w))]) for s in range(len(w) - min(13, len(w)) + 1)} if w else set()
    assert {r["doc_id"] for r in seen[2] if not contaminated(r["text"], grams)} == {r["doc_id"] for r in seen[3]}
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in packed) == Counter((r["doc_id"], k) for r in seen[3] for k in range(-(-(len(library_ids(r["text"])) + 1) // 2048)))


def test_stages_take_odd_rows(spark, edge_docs, no_docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, edge_docs, SF)
        assert name == "pack sequences" or got.columns == edge_docs.columns, name
        assert got.count() > 0 and stage(spark, no_docs, SF).count() == 0, name


def test_the_collector_rests_while_words_are_encoded(monkeypatch):
    import gc

    fresh, seen = tokens.PieceEncoder(VOCAB), []
    fresh.model = type("Model", (), {"tokenize": lambda self, w: seen.append(gc.isenabled()) or []})()
    fresh._of_words(["one", "two"])
    assert seen == [False, False] and gc.isenabled()
