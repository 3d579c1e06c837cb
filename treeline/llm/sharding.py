"""Sharding by proportional stratified interleaving.

Rows of each source are put into a seeded random order and given the fractional rank (rank + u) / rows of the source,
where u in (0, 1) is the source's own seeded offset. Sorted by that fraction, every stretch of the whole order holds the
sources in the proportions of the corpus, so cutting it into equal runs gives shards that all match the mixture; the
offsets spread rare sources, whose few rows would else all have the same fractions, evenly over the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import distributed_rank, hash_unit, text_crc32, utf8_bytes


def interleave(docs: DataFrame, shards: int, *, seed: int = 1, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Row counts of the shards differ by at most one, and a source's rows in a shard by a small constant from its
    share. Rows are independent: equal texts are not held together.

    Ranks are exact and distributed: rows are dealt by (source, cell of the shuffle key), so a source with a third
    of all rows is spread over about sqrt(rows) cells; only the counts of cells are summed up in one place.

    Defined cases: a null source is a source of its own; null keys take part like any value; a null text has no
    bytes; repeated rows are rows like any other (their order among each other does not matter); an empty table
    gives no rows; other columns of ``docs`` are left out.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = docs.count()
    cells = max(1, math.isqrt(rows) + 1)
    base = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        (utf8_bytes(F.col(text)) + 16).alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), text_crc32(F.col(text)).cast("string")).cast("binary")).alias("shuffle_key"),
    )
    ties = [F.col(c) for c in ("shuffle_key", "doc_id", "text_crc32", "size")]
    by_source = distributed_rank(base, ["source"], F.shiftright(hash_unit(F.col("shuffle_key")) * cells, 32), ties, "source_rank", "source_rows")
    named = F.when(F.col("source").isNull(), f"{seed}-").otherwise(F.concat(F.lit(f"{seed}+"), F.col("source").cast("string")))
    offset = (hash_unit(F.md5(named.cast("binary"))) + 0.5) / float(1 << 32)
    placed = by_source.withColumn("fraction", (F.col("source_rank") + offset) / F.col("source_rows"))
    whole = distributed_rank(placed, [], F.floor(F.col("fraction") * cells), [F.col("fraction"), *ties, F.col("source")], "position", "rows")
    shard = F.expr(f"position * {shards} div rows")
    start = F.expr(f"(position * {shards} div rows * rows + {shards - 1}) div {shards}")
    return whole.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("position") - start).cast("long").alias("slot"))
