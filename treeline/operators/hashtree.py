"""Digests of tables as hash trees over ranges of their order: made in the executors, and able to say which rows differ.

Rows are dealt by ranges of their key, sorted in each, and numbered by prefix sums of the ranges' counts. Every ``fan``
rows in that order are a chunk, every ``fan`` nodes a node above, up to one root. Two trees are compared from the root
down, and only below nodes that differ, so a changed row is found among as many nodes as a path has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType
from pyspark.sql.window import Window

from treeline.store import cut

FAN = 64
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's columns by name: each ``-`` if null, else its text's UTF-8 byte count, a colon and the text."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            value = F.to_json(value)
        elif isinstance(f.dataType, BinaryType):
            value = F.hex(value)
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position``, its rows' places from 0 along ``order`` (nulls first). A range's rows stay where they were sorted; only the ranges' counts, one row each, are summed up in one place."""
    along = [F.col(c).asc_nulls_first() for c in order]
    held = cut(df.repartitionByRange(*along).sortWithinPartitions(*along).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", (before - F.col("_first")).alias("_shift"))
    # As many rows as there are shuffle partitions.
    return held.join(F.broadcast(starts), "_part").withColumn("position", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def hash_tree(df: DataFrame, order: list[str], fan: int = FAN) -> DataFrame:
    """The tree's nodes (level from 0, idx, rows, first_key, last_key, hash); the last level has one node, the root.

    Keys are the order's columns as text, joined by NUL. Rows that are equal in ``order`` are put in order by their hash.

    Defined cases: null keys come first and read as empty; repeated rows are hashed each; an empty table has no node,
    and its root is the digest of nothing.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    key = F.concat_ws("\x00", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order))
    hashed = df.select(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)), key.alias("key"), row_hash(df).alias("hash"))
    rows = numbered(hashed, [*(f"o{i}" for i in range(len(order))), "hash"])
    level, nodes = 0, rows.select(F.col("position").alias("idx"), F.lit(1).cast("long").alias("rows"), F.col("key").alias("first_key"), F.col("key").alias("last_key"), "hash")
    found: list[DataFrame] = []
    while True:
        runs = nodes.groupBy(F.expr(f"idx div {fan}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "first_key", "last_key", "hash"))).alias("run"), F.sum("rows").alias("rows"))
        nodes = cut(runs.select("idx", "rows", F.col("run")[0]["first_key"].alias("first_key"), F.element_at("run", -1)["last_key"].alias("last_key"), F.sha2(F.array_join("run.hash", "").cast("binary"), 256).alias("hash")))
        found.append(nodes.select(F.lit(level).alias("level"), "idx", "rows", "first_key", "last_key", "hash"))
        count = nodes.count()
        if count <= 1:
            return reduce(DataFrame.unionByName, found)
        level += 1


def root(tree: DataFrame) -> str:
    """The root's hash, one row to the driver."""
    top = tree.orderBy(F.desc("level")).select("hash").first()
    return top["hash"] if top else EMPTY


def changed_ranges(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """Chunks that differ: (idx, change, old_first, old_last, new_first, new_last); ``change`` is altered, added or removed.

    Both trees are of one order and fan. A row that is put in or taken out moves all rows after it, so every chunk from
    there on differs; the first one says where.
    """
    tops = [r[0] for t in (old, new) for r in t.agg(F.max("level")).collect()]
    if None in tops:
        gone, come = (t.where("level = 0").select("idx", F.lit(c).alias("change"), *(F.col(k).alias(f"{s}_{k[:-4]}") for k in ("first_key", "last_key"))) for t, c, s in ((old, "removed", "old"), (new, "added", "new")))
        return gone.unionByName(come, allowMissingColumns=True).select("idx", "change", "old_first", "old_last", "new_first", "new_last")
    side = lambda t, s, level: t.where(F.col("level") == level).select("idx", *(F.col(c).alias(f"{s}_{c}") for c in ("first_key", "last_key", "hash")))
    open_ = None
    # Levels that only the taller tree has hold no pair to compare: the descent starts at the lower root's level.
    for level in range(min(tops), -1, -1):
        a, b = side(old, "old", level), side(new, "new", level)
        if open_ is not None:
            below = cut(open_.select(F.explode(F.sequence(F.col("idx") * fan, F.col("idx") * fan + fan - 1)).alias("idx")))
            a, b = a.join(below, "idx", "left_semi"), b.join(below, "idx", "left_semi")
        open_ = a.join(b, "idx", "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("altered")
    ranges = (F.col(f"{s}_{k}_key").alias(f"{s}_{k}") for s in ("old", "new") for k in ("first", "last"))
    return open_.select("idx", change.alias("change"), *ranges)
