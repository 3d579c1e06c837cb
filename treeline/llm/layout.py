"""Multidimensional clustered layout by distributed most-significant-digit radix partitioning.

Each dimension's values are cut into 2 ** BITS coordinates of equal row counts. Values are written as hexadecimal
digits that sort as the values do; a histogram of the next digit is taken only of the buckets that straddle a cut, and
the bucket that holds it is refined in the next round, until it holds one value. Coordinates interleave into z; rows
take their place by z and then by key, again by radix: buckets of equal z that are too large for one task are refined by
the key's digits, and positions are the prefix sums of the buckets' counts plus the place in the bucket.

Histograms (at most 4 x 15 buckets of 257 digits a round) and cuts are all that the driver sees; row buckets, files and
query counts stay distributed, and what is broadcast has a bound that does not grow with the rows.
"""

from __future__ import annotations

import os
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.common import stash

BITS, ROWS_A_FILE = 4, 1000
SIDE = 1 << BITS
_LOWEST = -(1 << 63)
#: Buckets of rows that may be refined at once: their list is broadcast, about 40 bytes each.
HEAVY_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Dim:
    """A dimension: its value as a SQL expression (a string or a whole number) and how far a row's query reaches on either side."""

    name: str
    value: str
    text: bool = False
    radius: int = 0


def digits(value: Column, text: bool) -> Column:
    """Hexadecimal text that sorts as the values do, null first: strings by UTF-8 bytes, numbers with the sign turned."""
    if text:
        code = F.hex(F.encode(value, "UTF-8"))
    else:
        code = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(_LOWEST))), 16, "0")
    return F.coalesce(F.concat(F.lit("01"), code), F.lit("00"))


def radix_cuts(values: DataFrame, dims: list[str], rows: int, parts: int = SIDE) -> dict[str, list[str]]:
    """For each dimension the digits of the rows at places ceil(c * rows / parts), c from 1: a value's coordinate is how many of them it is beyond.

    ``values`` (dim, code, n) holds each distinct value once, so a value with a third of all rows is one row here.
    Rounds are at most the digits of the longest straddling value: a bucket goes on at the first digit in which its
    smallest and largest value differ.
    """
    cuts: dict[tuple[str, int], str] = {}
    open_cuts = {(d, c): ("", 0) for d in dims for c in range(1, parts)}
    while open_cuts:
        prefixes = sorted({(d, prefix) for (d, _), (prefix, _) in open_cuts.items()})
        which = F.lit(None).cast("int")
        at = F.lit(0)
        for i, (d, prefix) in enumerate(prefixes):
            inside = (F.col("dim") == d) & F.col("code").startswith(prefix)
            which, at = F.when(inside, i).otherwise(which), F.when(inside, len(prefix)).otherwise(at)
        placed = values.withColumn("bucket", which).where("bucket IS NOT NULL").withColumn("digit", F.substring("code", at + 1, F.lit(2)))
        seen = placed.groupBy("bucket", "digit").agg(F.sum("n").alias("n"), F.min("code").alias("low"), F.max("code").alias("high")).collect()
        histograms = defaultdict(list)
        for r in sorted(seen, key=lambda r: (r["bucket"], r["digit"])):
            histograms[prefixes[r["bucket"]]].append(r)
        still = {}
        for (d, c), (prefix, before) in open_cuts.items():
            target = -(-c * rows // parts)
            for r in histograms[d, prefix]:
                if before + r["n"] >= target:
                    if r["low"] == r["high"]:
                        cuts[d, c] = r["low"]
                    else:
                        still[d, c] = (os.path.commonprefix([r["low"], r["high"]]), before)
                    break
                before += r["n"]
        open_cuts = still
    return {d: [cuts[d, c] for c in range(1, parts) if (d, c) in cuts] for d in dims}


def coordinate(code: Column, cuts: list[str]) -> Column:
    """How many of the ascending ``cuts`` lie below the code."""
    out = F.lit(0)
    for c, cut in enumerate(cuts, 1):  # the last condition that is added is tried first
        out = F.when(code > F.lit(cut), c).otherwise(out)
    return out.cast("int")


def interleaved(coordinates: list[Column]) -> Column:
    z = F.lit(0)
    for bit in range(BITS - 1, -1, -1):
        for c in coordinates:
            z = z * 2 + F.shiftright(c, bit).bitwiseAND(F.lit(1))
    return z.cast("int")


def coordinates_of(z: Column, n: int) -> list[Column]:
    """The ``n`` coordinates that interleave to z."""
    return [reduce(lambda a, b: a + b, [F.shiftright(z, bit * n + n - 1 - d).bitwiseAND(F.lit(1)) * (1 << bit) for bit in range(BITS)]) for d in range(n)]


def _refined(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (z, has, id, rid) with ``lo`` and ``rlo``, the lower ends of their radix bucket: buckets have at most ``most`` rows."""
    bucket = ["z", "has", "lo", "rlo"]
    rows = rows.withColumn("lo", F.lit(_LOWEST)).withColumn("rlo", F.lit(_LOWEST)).withColumn("_open", F.lit(True))

    def shift(low: str, high: str) -> Column:
        """The place of the highest 8 bits in which the bucket's ends differ."""
        out = F.lit(0)
        for s in range(8, 64, 8):
            out = F.when(F.shiftright(low, s) != F.shiftright(high, s), s).otherwise(out)
        return out

    while True:
        counts = rows.where("_open").groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"_{n}_{c}") for c in ("id", "rid") for n, f in (("low", F.min), ("high", F.max))))
        by_id = F.col("_low_id") < F.col("_high_id")
        heavy = stash(counts.where(F.col("_n") > most).select(*(F.col(c).alias(f"_{c}") for c in bucket), by_id.alias("_by_id"), F.when(by_id, shift("_low_id", "_high_id")).otherwise(shift("_low_rid", "_high_rid")).alias("_shift")), "radix-heavy")
        if heavy.isEmpty():
            return rows.drop("_open")
        met = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in bucket])
        cut = lambda c: F.expr(f"shiftleft(shiftright({c}, _shift), _shift)")
        rows = (
            rows.join(F.broadcast(heavy), met, "left")
            .withColumn("_open", F.col("_by_id").isNotNull())
            .withColumn("lo", F.when(F.col("_by_id"), cut("id")).otherwise(F.col("lo")))
            .withColumn("rlo", F.when(~F.col("_by_id"), cut("rid")).otherwise(F.col("rlo")))
            .drop(*(f"_{c}" for c in bucket), "_by_id", "_shift")
        )


def positions(rows: DataFrame, n: int, most: int = ROWS_A_FILE) -> DataFrame:
    """``rows`` (z, has, id, rid and more) with ``position``, their place by z, has, id, rid, from 0."""
    bucket = ["z", "has", "lo", "rlo"]
    placed = _refined(rows, max(most, n // HEAVY_BUCKETS))
    counts = stash(placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")), "radix-counts")
    # Prefix sums in three steps: of the upper half of z (one row each), of z in it, of the buckets of one z.
    so_far = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_z = counts.groupBy("z").agg(F.sum("_n").alias("_n")).withColumn("upper", F.shiftright("z", 8))
    by_upper = by_z.groupBy("upper").agg(F.sum("_n").alias("_n")).select("upper", so_far(Window.partitionBy().orderBy("upper")).alias("_upper_start"))
    starts = by_z.withColumn("_z_start", so_far(Window.partitionBy("upper").orderBy("z"))).join(F.broadcast(by_upper), "upper").select(F.col("z").alias("_z"), (F.col("_upper_start") + F.col("_z_start")).alias("_start"))
    offsets = counts.withColumn("_inside", so_far(Window.partitionBy("z").orderBy("has", "lo", "rlo"))).join(F.broadcast(starts), F.col("z") == F.col("_z")).select(*bucket, (F.col("_start") + F.col("_inside")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*bucket).orderBy("id", "rid"))
    return placed.join(offsets, bucket).withColumn("position", (F.col("_offset") + within - 1).cast("long")).drop("has", "lo", "rlo", "_offset")


def cluster(table: DataFrame, dims: list[Dim], *, key: str = "doc_id", rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """(key, rid, z, position, file) for each row of ``table``; ``rid`` numbers the table's rows as they were read.

    Defined cases: null is the smallest value of its dimension and the smallest key; repeated keys with equal z take
    neighbouring positions in any order; equal values have equal coordinates, so a value with a third of all rows is one
    coordinate; an empty table gives no rows; other columns are not read.
    """
    names = [f"d{i}" for i in range(len(dims))]
    held = stash(
        table.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("rid"), *(digits(F.expr(d.value), d.text).alias(n) for d, n in zip(dims, names, strict=True))),
        "layout-values",
    )
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), F.col(n).alias("code")) for n in names))).alias("v")
    values = stash(held.select(each).groupBy("v.dim", "v.code").agg(F.count(F.lit(1)).alias("n")), "layout-distinct")
    rows = values.where(F.col("dim") == names[0]).agg(F.sum("n")).first()[0] or 0
    cuts = radix_cuts(values, names, rows) if rows else {n: [] for n in names}
    z = interleaved([coordinate(F.col(n), cuts[n]) for n in names])
    keyed = held.select("key", "rid", z.alias("z"), F.col("key").isNotNull().cast("int").alias("has"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("id"))
    placed = positions(keyed, rows, rows_a_file).select(F.col("key").alias(key), "rid", F.col("z").cast("long").alias("z"), "position", F.expr(f"position div {rows_a_file}").alias("file"))
    return stash(placed, "layout-positions")


def file_bounds(placed: DataFrame, n: int) -> DataFrame:
    """(file, low_d, high_d for each of the ``n`` dimensions): what a reader needs to skip files."""
    named = placed.select("file", *(c.alias(f"c{d}") for d, c in enumerate(coordinates_of(F.col("z"), n))))
    return named.groupBy("file").agg(*(f(f"c{d}").alias(f"{side}_{d}") for d in range(n) for side, f in (("low", F.min), ("high", F.max))))


def _within(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), value))


def touched_counts(bounds: DataFrame, radii: list[int]) -> DataFrame:
    """(z, files_touched) for every cell of the grid: files whose bounds meet the query around that cell.

    A file meets the queries of one box of cells, its bounds widened by the radii. Each box adds one at its lower
    corners and takes it back beyond its upper ones; sums along each dimension in turn give the boxes over each cell.
    No file meets a query row by row, and the grid has SIDE ** n cells however many rows there are.
    """
    n = len(radii)
    spark = bounds.sparkSession
    ends = [(_within(F.col(f"low_{d}") - r), _within(F.col(f"high_{d}") + r) + 1) for d, r in enumerate(radii)]
    corners = F.array(*(F.struct(F.lit(1 - 2 * (k.bit_count() % 2)).alias("sign"), *(ends[d][k >> d & 1].cast("int").alias(f"g{d}") for d in range(n))) for k in range(1 << n)))
    axes = [f"g{d}" for d in range(n)]
    steps = bounds.select(F.explode(corners).alias("x")).select("x.*").where(" AND ".join(f"{a} < {SIDE}" for a in axes)).groupBy(*axes).agg(F.sum("sign").alias("v"))
    grid = spark.range(SIDE**n).select(F.col("id").alias("z"), *(c.cast("int").alias(a) for a, c in zip(axes, coordinates_of(F.col("id"), n), strict=True)))
    filled = grid.join(steps, axes, "left").withColumn("v", F.coalesce("v", F.lit(0)))
    for a in axes:
        filled = filled.withColumn("v", F.sum("v").over(Window.partitionBy(*(b for b in axes if b != a)).orderBy(a)))
    return filled.select("z", F.col("v").cast("long").alias("files_touched"))


def matching_counts(placed: DataFrame, radii: list[int]) -> DataFrame:
    """(z, files_matching) for every cell whose query finds a row: files with a row in it.

    Files are runs of z, so there are at most as many (file, cell) pairs as files and cells together; each pair answers
    the queries of the cells around it, and equal answers of a file count once.
    """
    n = len(radii)
    cells = placed.select("file", "z").distinct().select("file", *(c.cast("int").alias(f"c{d}") for d, c in enumerate(coordinates_of(F.col("z"), n))))
    for d, r in enumerate(radii):
        if r:
            cells = cells.withColumn(f"c{d}", F.explode(F.sequence(_within(F.col(f"c{d}") - r), _within(F.col(f"c{d}") + r))))
    asked = cells.select("file", interleaved([F.col(f"c{d}") for d in range(n)]).cast("long").alias("z")).distinct()
    return asked.groupBy("z").agg(F.count(F.lit(1)).alias("files_matching"))


def skipping(placed: DataFrame, radii: list[int], key: str = "doc_id") -> DataFrame:
    """``placed`` with the bounds of each row's file, and of each row's query the files that bounds leave and those that hold a row."""
    bounds = stash(file_bounds(placed, len(radii)), "layout-bounds")
    counts = touched_counts(bounds, radii).join(matching_counts(placed, radii), "z")  # at most SIDE ** n rows
    return placed.join(bounds, "file").join(F.broadcast(counts), "z")


def write_layout(table: DataFrame, placed: DataFrame, path: str, *, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Write ``table`` in clustered order, one Parquet file for each ``file``, and return their bounds, which are kept beside them.

    ``placed`` is of the same table as it is read again, whose rows ``rid`` numbers.
    """
    dims = 4
    rows = table.withColumn("_rid", F.monotonically_increasing_id())
    joined = rows.join(placed.select("rid", "position", "file"), F.col("_rid") == F.col("rid")).drop("_rid", "rid")
    # Ranges of whole files, each written in runs of rows_a_file.
    joined.repartitionByRange(F.col("file")).sortWithinPartitions("position").write.option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/rows")
    bounds = file_bounds(placed, dims)
    bounds.write.parquet(f"{path}/bounds")
    return table.sparkSession.read.parquet(f"{path}/bounds")
