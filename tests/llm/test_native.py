"""Sharding, URL filters, decontamination, chat formatting."""

import re
import zlib
from collections import Counter

from conftest_llm import ROWS
from pyspark.sql import functions as F

from treeline.llm import chat, decontamination, sharding, url_filter

SF = "/root/testdata/sf0.001"


def test_shards_match_the_mixture(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.interleave(docs, 7).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    whole, by = Counter(r["source"] for r in got), Counter((r["source"], r["shard"]) for r in got)
    assert all(abs(by[src, s] - whole[src] / 7) <= 2 for src in whole for s in counts)
    edge = sharding.interleave(edge_docs, 4).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in edge) == Counter((k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for k, t, _ in ROWS)
    assert sharding.interleave(no_docs, 4).count() == 0


def test_rare_sources_are_spread(spark):
    rows = [(i, "t", f"rare{i}") for i in range(2000)] + [(2000 + i, "t", "large") for i in range(8000)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 40).collect()
    rare = Counter(r["shard"] for r in got if r["source"] != "large")
    assert len(rare) == 40 and all(15 <= n <= 95 for n in rare.values())
    large = Counter(r["shard"] for r in got if r["source"] == "large")
    assert all(large[s] + rare[s] == 250 for s in range(40))


def test_null_keys_are_spread(spark):
    """Half of the ids null: the cells that order them hold no more rows than others."""
    from treeline.llm.common import hash_unit, text_crc32

    rows = [(None if i % 2 else i, f"text {i}", "large") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(df, 8).select("shard", "slot", "doc_id")
    assert Counter(r["shard"] for r in got.collect()) == Counter(dict.fromkeys(range(8), 500))
    key = F.md5(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_crc32(F.col("text")).cast("string")).cast("binary"))
    cells = df.groupBy(F.shiftright(hash_unit(key) * 64, 32)).count().collect()
    assert max(r["count"] for r in cells) < 2 * 4000 / 64


WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def brute(docs, items, n=13):
    words = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {}
    for key, text in items:
        w = words(text)
        k = min(n, len(w))
        for s in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[s : s + k]), set()).add(str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for g, keys in grams.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= keys
        out.append((key, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_decontamination_equals_brute_force(spark, edge_docs, no_docs, monkeypatch):
    texts = [t for _, t, _ in ROWS if t]
    w = texts[0].split()
    items = [(1, " ".join(w[3:40])), (2, " ".join(w[10:30]).upper()), (30, "three"), (4, "two, THREE"), (5, None), (6, "..."), (7, " ".join(texts[-2].split()[5000:5014])), (8, "One two three"), (9, " ".join(w[50:62]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("x"))
    want = brute([(k, t) for k, t, _ in ROWS], items)
    for limit in (decontamination.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
        got = decontamination.contamination(edge_docs, bench).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["hit_items"]), r["contaminated"]) for r in got) == want
    kept = decontamination.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(edge_docs.where("doc_id IN (4, 7)"), bench).collect()}
    assert cut[7] == "" and cut[4] == ROWS[3][1]
    assert decontamination.contamination(no_docs, bench).count() == 0
    assert decontamination.contamination(edge_docs, bench.limit(0)).where("contaminated").count() == 0


RULES = [url_filter.parse_rule(t, a) for t, a in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))]


def rule_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.action


def test_url_rules_and_trees(spark):
    urls = ["HTTP://A.Example.COM/en/7?x=/q", "http://example.com/en/71", "https://com/en/", "x.com/en/", None, "", "ftp://b.example.net/de/8#f", "http://notexample.net/de/8", "://org/es/", "http://h.org", "http://h?x/en/", "http://a.com://b/en/"]
    edge = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "y")], "page_id long, url string, probability string")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    for df in (edge, pages):
        for r in url_filter.judge(df, RULES).collect():
            host, path, rule, action = rule_of(r["url"])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] in ("allow", "block") and (action is None or r["verdict"] == action)
    assert url_filter.judge(edge.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(edge, []).collect()} == {"allow"}


def test_url_trees_learn_held_out_rules(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").selectExpr("url").where("url IS NOT NULL").distinct()
    host, path = url_filter.split_url(F.col("url"))
    labelled = rows.select("url", host.alias("host"), path.alias("path"))
    rule, action = url_filter.matching_rule(F.col("host"), F.col("path"), [r for r in RULES if r.text in ("com/en/", "net/de/", "org/es/")])
    labelled = labelled.withColumn("action", action).where("action IS NOT NULL").withColumn("block", (F.col("action") == "block").cast("int"))
    held = F.crc32(F.col("url").cast("binary")) % 4 == 0
    model = url_filter.fit(labelled.where(~held).select("url", "host", "path", "block"))
    got = model.score(labelled.where(held)).select(((F.col("p_block") >= 0.5).cast("int") == F.col("block")).alias("ok"))
    right, n = got.where("ok").count(), got.count()
    assert n > 100 and right / n > 0.9


def test_suffix_rates_leave_out_the_own_fold(spark):
    rows = [(f"http://h{i}.a{i % 3}.com/x", f"h{i}.a{i % 3}.com", None if i % 4 == 0 else int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, host string, block int")
    stats = url_filter.suffix_statistics(df)
    for r in stats.collect():
        own = [(u, b) for u, _, b in rows if u.split("/")[2].split(".", 1)[1] == r["suffix"]]
        assert (r["urls"], r["labelled"], r["blocked"]) == (len(own), sum(b is not None for _, b in own), sum(b or 0 for _, b in own))
        assert sum(r["fold_labelled"]) == r["labelled"] and sum(r["fold_blocked"]) == r["blocked"]
    folds = {r["url"]: r["f"] for r in df.select("url", url_filter._fold(F.col("url")).alias("f")).collect()}
    got = url_filter._with_suffixes(df.withColumn("suffix", url_filter.suffix_of(F.col("host"))), stats, 0.5, held_out=True).collect()
    for r in got:
        rest = [b for u, _, b in rows if b is not None and u.split("/")[2].split(".", 1)[1] == r["suffix"] and folds[u] != folds[r["url"]]]
        assert abs(r["suffix_rate"] - (sum(rest) + 10) / (len(rest) + 20)) < 1e-12


def conversations(spark):
    rows = [(1, 0, "system", "be & <kind>"), (1, 1, "user", 'a "q" </turn>'), (1, 2, "assistant", '<turn role="x" n="0" say="1" again="0">'), (1, 3, "user", None), (1, 4, "assistant", "long " * 60), (1, 5, "user", "&amp;lt;"), (1, 6, "assistant", ""), (2, 0, "assistant", "alone"), (None, 0, "user", "no id"), (3, None, "user", "b"), (3, None, "user", "b"), (3, 1, None, "c"), (4, 0, "system", "only")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash"))


def test_chat_reads_back(spark):
    rows, df = conversations(spark)
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for budget in (1, 40, 100, 5000):
        windows = chat.format_windows(df, budget=budget, history=2)
        for r in windows.collect():
            assert r["cost"] <= budget or len(re.findall(r'again="0"', r["formatted"])) <= 2
        for r in chat.read_back(windows).collect():
            turns = want[r["conv_id"]]
            assert [(t["role"], t["text"]) for t in r["turns"]] == turns
            assert r["said"] == [t for role, t in turns if role == "assistant"]
    for r in chat.format_windows(df, budget=100).collect():
        assert r["cost"] == len(r["formatted"].encode())
    counted = chat.format_windows(df.withColumn("tokens", F.length("text")), budget=10, tokens="tokens")
    assert Counter((r["conv_id"], len(r["turns"])) for r in chat.read_back(counted).collect()) == Counter((c, len(t)) for c, t in want.items())
    small = chat.format_windows(df, budget=40, history=2)
    assert small.count() > chat.format_windows(df, budget=5000).count() == 5
    first = small.where("conv_id = 1").collect()
    assert all('role="system"' in r["formatted"] for r in first)
    again = [x for r in first for x in re.findall(r'say="(.)" again="1"', r["formatted"])]
    assert again and set(again) == {"0"}
    assert chat.format_windows(df.limit(0)).count() == 0
