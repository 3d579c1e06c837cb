"""Benchmark decontamination by a hash set of normalised test n-grams.

A window is ``n`` consecutive words of a benchmark item; a shorter item is one window. Looking every document window
up would hash each word ``n`` times. Instead documents are cut into aligned blocks of b = (n + 1) // 2 words, so each
word is hashed once: any window of n words covers a whole aligned block. Only where a block is one of the blocks of
the benchmark are the at most n - b + 1 windows around it built and compared, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import ascii_lower, stash

#: Bytes of windows up to which the benchmark's side is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Contaminated rows up to which their keys are broadcast, about 60 bytes each.
BROADCAST_ROWS = 400_000
#: Runs of characters outside this class part the words.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs of digits, a-z (A-Z lower-cased) and non-ASCII characters; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")


def _gram(array: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(array, start, length), " ")


def _once(value: Column) -> Column:
    """A generator of one row that holds ``value``: the optimizer does not move the expression into later lambdas, where it would be computed for each element."""
    return F.explode(F.array(value))


def benchmark_windows(items: DataFrame, n: int = 13, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (item_id, len, gram) of all items; an item without words has none."""
    base = items.select(F.col(key).cast("string").alias("item_id"), _once(words(F.col(text))).alias("w")).where(F.size("w") > 0)
    base = base.withColumn("len", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return base.select("item_id", "len", "w", F.explode(starts).alias("s")).select("item_id", "len", _gram(F.col("w"), F.col("s"), F.col("len")).alias("gram")).distinct()


def row_key(key: Column, text: Column) -> Column:
    """Stands for (key, text): rows that agree in both get the same result, however often they are there."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit(""))).cast("binary"))


def window_hits(docs: DataFrame, windows: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, n_words, s, e, items_id): each document window of words [s, e), from 0, that is one of ``windows`` (len, gram, items_id).

    Blocks of all lengths come from one split of each text. The windows are broadcast up to BROADCAST_BYTES of them,
    which is measured first; beyond, block hashes are joined by a shuffle of (row_key, block, hash), and the documents
    with a hit are joined with their words again.
    """
    # One row a length, the longest window's at most.
    lengths = {r["len"]: r["bytes"] for r in windows.groupBy("len").agg(F.sum(F.octet_length("gram") + F.octet_length("items_id") + 32).alias("bytes")).collect()}
    small = sum(lengths.values()) <= BROADCAST_BYTES
    side = F.broadcast if small else (lambda df: df)
    base = docs.select(row_key(F.col(key), F.col(text)).alias("row_key"), _once(words(F.col(text))).alias("w"))
    block_of = lambda n: (n + 1) // 2
    none = F.array().cast("array<struct<len:int,i:int,h:bigint>>")

    def aligned(n: int) -> Column:
        block = block_of(n)
        # sequence() would count down where there is no block.
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.expr(f"int(size(w) div {block} - 1)")), lambda i: F.struct(F.lit(n).alias("len"), i.alias("i"), F.xxhash64(_gram(F.col("w"), i * block + 1, F.lit(block))).alias("h")))).otherwise(none)

    hashed = base.where(F.size("w") >= min(lengths, default=1)).select("row_key", "w", F.explode(F.concat(none, *(aligned(n) for n in sorted(lengths)))).alias("b"))
    at = hashed.select("row_key", "w", "b.len", "b.i", "b.h")
    half = F.expr("(len + 1) div 2").cast("int")
    parts = F.split("gram", " ")
    inner = F.transform(F.sequence(F.lit(1), F.col("len") - half + 1), lambda s: _gram(parts, s, half))
    blocks = windows.select("len", F.explode(inner).alias("g")).select("len", F.xxhash64("g").alias("h")).distinct()
    if small:
        found = at.join(side(blocks), ["len", "h"], "left_semi")
    else:
        hit = at.select("row_key", "len", "i", "h").join(blocks, ["len", "h"], "left_semi").select("row_key", "len", "i").distinct()
        found = base.dropDuplicates(["row_key"]).join(hit, "row_key")
    first = F.greatest(F.col("i") * half - (F.col("len") - half), F.lit(0))
    last = F.least(F.col("i") * half, F.size("w") - F.col("len"))
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    built = found.select("row_key", F.size("w").cast("long").alias("n_words"), "len", F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), _gram(F.col("w"), s + 1, F.col("len")).alias("gram")))).alias("x"))
    got = built.select("row_key", "n_words", "len", F.col("x.s").alias("s"), F.col("x.gram").alias("gram")).join(side(windows), ["len", "gram"])
    return got.select("row_key", "n_words", "s", (F.col("s") + F.col("len")).alias("e"), "items_id")


def _judged(docs: DataFrame, items: DataFrame, n: int, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """((row_key, n_words, n_hit, spans, item_sets, contaminated) of each document with a hit; (items_id, items)).

    Windows with the same items share one list: hits carry its id, so that a passage which all items have does not take
    their ids along with each of its windows.
    """
    every = benchmark_windows(items, n, key=item_key, text=item_text).groupBy("len", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = stash(every.withColumn("items_id", F.md5(F.to_json("items").cast("binary"))), "windows")
    hits = window_hits(docs, windows.select("len", "gram", "items_id"), key=key, text=text)
    per_doc = hits.groupBy("row_key").agg(F.first("n_words").alias("n_words"), F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"), F.collect_set("items_id").alias("item_sets"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    judged = per_doc.withColumn("n_hit", covered).withColumn("contaminated", F.col("n_hit") * 20 >= F.col("n_words"))
    return judged, windows.dropDuplicates(["items_id"]).select("items_id", "items")


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each row of ``docs`` as (key, text, n_words, n_hit, hit_items, spans, contaminated).

    ``spans`` holds the hit windows as sorted (s, e) word positions; a word inside any of them is hit. A document is
    contaminated if a twentieth of its words or more are hit, and at least one.

    Defined cases: null and empty texts have no words and are clean; null keys take part; repeated rows each get
    the same result; an empty benchmark hits nothing; an empty ``docs`` gives no rows; other columns are left out.
    """
    judged, sets = _judged(docs, items, n, key, text, item_key, item_text)
    judged = stash(judged, "judged")
    own = judged.select("row_key", F.explode("item_sets").alias("items_id")).join(sets, "items_id").groupBy("row_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("hit_items"))
    marked = judged.join(own, "row_key").select("row_key", "n_hit", "hit_items", "spans")
    base = docs.select(F.col(key).alias(key), F.col(text).alias(text), row_key(F.col(key), F.col(text)).alias("row_key"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    return base.join(marked, "row_key", "left").select(
        key,
        text,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
        "spans",
        (F.coalesce("n_hit", F.lit(0)) * 20 >= F.greatest(F.col("n_words"), F.lit(1))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 13, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the contaminated rows. Up to BROADCAST_ROWS of them, which is counted first, no text is shuffled.

    Defined cases: null and empty texts stay; null keys take part; repeated rows stay or go together; an empty
    benchmark drops nothing; an empty ``docs`` gives no rows; columns of any name stay as they are.
    """
    judged, _ = _judged(docs, items, n, key, text, item_key, item_text)
    marks = stash(judged.where("contaminated").select(F.col("row_key").alias("_bad_row")), "contaminated")
    few = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    return docs.join(few, row_key(docs[key], docs[text]) == F.col("_bad_row"), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 13, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_hit): each row's text without its hit words and the separators after them.

    Defined cases: rows without a hit keep their text, null too; null keys take part; repeated rows are cut alike; an
    empty benchmark cuts nothing; an empty ``docs`` gives no rows; other columns are left out.
    """
    marked = contamination(docs, items, n, key=key, text=text).where("n_hit > 0")
    word = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
    own, gaps = F.regexp_extract_all(F.col(text), F.lit(word), F.lit(1)), F.split(F.col(text), word)
    inside = lambda i: F.exists("spans", lambda x: (x["s"] <= i) & (i < x["e"]))
    kept = F.transform(F.arrays_zip(own.alias("w"), F.slice(gaps, F.lit(2), F.size(own)).alias("g")), lambda x, i: F.when(inside(i), "").otherwise(F.concat(x["w"], x["g"])))
    cut = marked.select(key, F.concat(F.element_at(gaps, 1), F.array_join(kept, "")).alias("_cut"), "n_hit", row_key(F.col(key), F.col(text)).alias("_k")).dropDuplicates(["_k"])
    all_rows = docs.select(key, text, row_key(F.col(key), F.col(text)).alias("_row"))
    return all_rows.join(cut.select("_k", "_cut", "n_hit"), F.col("_row") == F.col("_k"), "left").select(
        key, F.coalesce("_cut", text).alias(text), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit")
    )
