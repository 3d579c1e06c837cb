"""Helpers that the corpus operators share: reading, stashing in the shared folder, exact distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.store import shared_folder, ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stash(df: DataFrame, label: str, *, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors lose nothing.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/treeline-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long")


def hash_unit(hex_digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a long."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def distributed_rank(df: DataFrame, keys: list[str], cell: Column, order: list[Column], rank: str, total: str) -> DataFrame:
    """Add the exact 0-based rank of each row within ``keys`` and the rows of its key.

    ``cell`` must not decrease along ``order``. Rows are counted by (keys, cell), the counts are summed up along
    the cells, and only the rows of one cell are sorted together: a key with a third of all rows is spread over as
    many tasks as it has cells. Null keys form a key of their own.
    """
    named = df.withColumn("_cell", cell)
    counts = named.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = F.sum("_n").over(along.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_cell").alias("_kcell"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(along).alias(total),
    )
    on = F.col("_cell").eqNullSafe(F.col("_kcell"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))
    return (
        named.join(offsets, on)
        .withColumn(rank, (F.col("_before") + within - 1).cast("long"))
        .drop("_cell", "_kcell", "_before", *(f"_k{i}" for i in range(len(keys))))
    )


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package shipped to the workers, which give back free memory after each partition: they live on for other stages."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return df.mapInArrow(run, schema)


#: Whole texts that go to a Python worker at once within small_batches().
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands at most BATCH_ROWS rows at once to Python: a batch lies in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Offsets up to which range_rank broadcasts them, about 60 bytes each; beyond, they are joined by a shuffle.
BROADCAST_OFFSETS = 50_000


def range_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, total: str, label: str) -> DataFrame:
    """Add the exact 0-based rank of each row within ``keys`` along ``order`` (ascending, nulls first) and the rows of its key.

    The rows are dealt by ranges of (keys, order), sorted in each range and written to the shared folder with their
    place, so a key with a third of all rows lies in as many ranges as it fills; only counts by range are summed up.
    Null keys form a key of their own; rows equal in keys and order get their ranks in any order.
    """
    along = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    held = stash(df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    counts = held.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stash(counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_kpart"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_key).alias(total)), f"{label}-offsets")
    on = F.col("_part") == F.col("_kpart")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    few = offsets.count() <= BROADCAST_OFFSETS
    placed = held.join(F.broadcast(offsets) if few else offsets, on)
    return placed.withColumn(rank, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_kpart", "_shift", *(f"_k{i}" for i in range(len(keys))))


#: A key with over one in so many of the rows is hot: at most as many keys can be.
HOT_SHARE = 500


def spread_join(rows: DataFrame, facts: DataFrame, key: str, *, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` left join ``facts`` (one row a key, none null) on ``key``; rows of a hot key are dealt over several tasks.

    ``keys`` has the keys of all ``rows`` where those cost much to make.

    At most HOT_SHARE keys can be hot, so their names are broadcast; a hot key's fact is repeated once for each
    HOT_SHARE-th of the rows that its rows fill.
    """
    keys = rows if keys is None else keys
    n = max(1, keys.count())
    ways = F.ceil(F.col("count") * HOT_SHARE / n).cast("long")
    hot = stash(keys.groupBy(key).count().where(F.col("count") * HOT_SHARE > n).select(F.col(key).alias("_hot"), ways.alias("_ways")), "hot-keys")
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_ways") > 1, F.pmod(F.monotonically_increasing_id(), "_ways")).otherwise(F.lit(0)))
    spread = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_ways"), F.lit(1)) - 1)))
    return dealt.drop("_hot", "_ways").join(spread.drop("_hot", "_ways"), [key, "_salt"], "left").drop("_salt")


#: Bits of a sieve for each key, and at most. Its words of 64 bits are broadcast, about 40 bytes each; once there are more keys than the bits allow for, more rows pass and none is lost.
SIEVE_BITS, SIEVE_MOST = 32, 1 << 26


def sieved(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key``, a long, may be among ``keys`` (one column of longs), and the other rows, whose key is not; nothing of ``rows`` is shuffled.

    Each key sets the bit that its hash names. Of other rows one in SIEVE_BITS passes, so an exact join has to follow.
    """
    bits = min(SIEVE_MOST, max(64, SIEVE_BITS * keys.count()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    word, bit = (lambda c: F.shiftright(place(c), 6)), (lambda c: place(c).bitwiseAND(F.lit(63)).cast("int"))
    own = F.col(keys.columns[0])
    words = F.broadcast(keys.groupBy(word(own).alias("_sieve_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(own))).alias("_sieve_bits")))
    passes = (word(key) == words["_sieve_word"]) & (F.getbit(words["_sieve_bits"], bit(key)) == 1)
    return rows.join(words, passes, "left_semi"), rows.join(words, passes, "left_anti")
