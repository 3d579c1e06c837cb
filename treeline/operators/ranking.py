"""Review ranking: cohorts, interval objectives, interval dominance, Pareto ranks, the review queue."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import paths
from treeline.store import cut, ship

#: Fixed values.
PRESERVED_ROLES = ("SOURCE", "ORIGINAL_MEDIA", "PROJECT_METADATA", "CONFIGURATION")
OBJECTIVES = ("negative_storage_benefit", "preservation_risk", "uncertainty", "incoherence")


def cohort(path: Column | str, size: Column | str) -> Column:
    """The top segment and the power of two of the size."""
    path, size = (F.col(c) if isinstance(c, str) else c for c in (path, size))
    band = F.when(size <= 0, F.lit(0)).otherwise(F.floor(F.log2(size.cast("double")))).cast("string")
    return F.concat(F.when(path == "", "ROOT").otherwise(paths.top(path)), F.lit("|size2^"), band)


def directory_features(aggregates: DataFrame, projects: DataFrame) -> DataFrame:
    """One row a directory without the root: cohort, size, files, preservation and unknown ratio, coherence, is_project."""
    total = F.greatest(F.col("file_count"), F.lit(1))
    count = lambda role: F.coalesce(F.col("role_counts")[role], F.lit(0))
    preserved = sum((count(r) for r in PRESERVED_ROLES), F.lit(0))
    marks = projects.select("relative_path", F.lit(1).alias("is_project"))
    rows = aggregates.where("relative_path <> ''").join(marks, "relative_path", "left")
    return rows.select(
        "relative_path",
        cohort("relative_path", "recursive_bytes").alias("cohort"),
        "recursive_bytes",
        "file_count",
        (preserved / total).alias("preservation_ratio"),
        (count("UNKNOWN") / total).alias("unknown_ratio"),
        "role_coherence",
        F.coalesce("is_project", F.lit(0)).alias("is_project"),
    )


def objective_columns(features: DataFrame) -> DataFrame:
    """``features`` with a struct (low, point, high, confidence) for each objective. The largest log size is over all rows."""
    largest = features.agg(F.max(F.log1p("recursive_bytes")).alias("max_log"))
    rows = features.crossJoin(F.broadcast(largest))  # one row
    p, unknown, c = F.col("preservation_ratio"), F.col("unknown_ratio"), F.col("role_coherence")
    u = F.least(F.lit(1.0), unknown + F.when(F.col("file_count") < 3, 0.15).otherwise(0.0))
    s = F.when(F.col("max_log") == 0, 0.0).otherwise(-F.log1p("recursive_bytes") / F.col("max_log")) + F.lit(0.0)

    def interval(low: Column, point: Column, high: Column, confidence: Column) -> Column:
        return F.struct(low.alias("low"), point.alias("point"), high.alias("high"), confidence.alias("confidence"))

    return rows.select(
        *features.columns,
        interval(s, s, s, F.lit(1.0)).alias(OBJECTIVES[0]),
        interval(F.greatest(F.lit(0.0), p - u * 0.2), p, F.least(F.lit(1.0), p + u * 0.4), 1.0 - u).alias(OBJECTIVES[1]),
        interval(unknown, u, F.least(F.lit(1.0), u + 0.15), 1.0 - unknown).alias(OBJECTIVES[2]),
        interval(1.0 - c, 1.0 - c, 1.0 - c, F.lit(0.9)).alias(OBJECTIVES[3]),
    )


def objective_intervals(features: DataFrame) -> DataFrame:
    """(relative_path, objective_name, low, point, high, confidence): four rows a directory."""
    wide = objective_columns(features)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("objective_name"), F.col(n).alias("v")) for n in OBJECTIVES))).alias("o")
    return wide.select("relative_path", each).select("relative_path", "o.objective_name", "o.v.*")


def dominance_pairs(features: DataFrame) -> DataFrame:
    """(cohort, winner, loser): every high of the winner at most the loser's low, one less. For inspection of small cohorts."""
    wide = objective_columns(features)
    a = wide.select("cohort", F.col("relative_path").alias("winner"), *(F.col(n)["high"].alias(f"h{i}") for i, n in enumerate(OBJECTIVES)))
    b = wide.select("cohort", F.col("relative_path").alias("loser"), *(F.col(n)["low"].alias(f"l{i}") for i, n in enumerate(OBJECTIVES)))
    at_most, less = F.lit(True), F.lit(False)
    for i in range(len(OBJECTIVES)):
        at_most, less = at_most & (F.col(f"h{i}") <= F.col(f"l{i}")), less | (F.col(f"h{i}") < F.col(f"l{i}"))
    return a.join(b, "cohort").where((F.col("winner") != F.col("loser")) & at_most & less).select("cohort", "winner", "loser")


#: Vectors that a cell of the grid should hold; a task sees at most two cells.
CELL = 1000
#: Cuts of one objective at most; rounds are at most the cuts of all objectives and one.
MOST_CUTS = 127
_KEYS = [f"{b}{i}" for i in range(len(OBJECTIVES)) for b in "lh"]
_LOWS, _HIGHS = ([k for k in _KEYS if k[0] == b] for b in "lh")


def _over(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of the vectors ``high`` dominate one ``low``."""
    return (high <= low).all(1) & (high < low).any(1)


def chain_ranks(low: np.ndarray, high: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Each row's longest chain of dominators, or ``least`` where that is more.

    Dominance is transitive, and a dominator's highs are nowhere above those of the row and not all equal to them, so in
    the lexicographic order of highs a row meets all its dominators before.
    """
    order = np.lexsort(high.T[::-1])
    low, high = low[order], high[order]
    ranks = np.zeros(len(low), np.int64) if least is None else least[order].astype(np.int64)
    for i in range(1, len(low)):
        over = _over(high[:i], low[i])
        if over.any():
            ranks[i] = max(ranks[i], ranks[:i][over].max() + 1)
    out = np.empty_like(ranks)
    out[order] = ranks
    return out


def _quantiles(vectors: DataFrame, most: int) -> DataFrame:
    """(cohort, ways, q_ of each objective): the quantiles of highs, and the number of ways in which each objective is cut first.

    n / ``most`` cells would do for n vectors if objectives were independent; those of one value take no cuts.
    """
    shares = [i / (MOST_CUTS + 1) for i in range(1, MOST_CUTS + 1)]
    sizes = vectors.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), *(f(h).alias(f"{f.__name__}_{h}") for h in _HIGHS for f in (F.min, F.max)), *(F.percentile_approx(h, shares, 1000).alias(f"q_{h}") for h in _HIGHS))
    free = sum((F.when(F.col(f"min_{h}") < F.col(f"max_{h}"), 1).otherwise(0) for h in _HIGHS), F.lit(0))
    ways = F.when(F.col("n") <= most, 1).otherwise(F.least(F.lit(MOST_CUTS + 1), 1 + F.ceil(F.pow(F.col("n") / most, 1.0 / F.greatest(F.lit(1), free)))))
    return sizes.select("cohort", ways.cast("int").alias("ways"), *(f"q_{h}" for h in _HIGHS))


def _placed(vectors: DataFrame, quantiles: DataFrame) -> DataFrame:
    every = F.expr(f"filter(transform(sequence(1, ways), i -> int(floor(i * {MOST_CUTS + 1} / ways))), i -> i <= {MOST_CUTS})")
    cuts = quantiles.withColumn("picked", every).select("cohort", "ways", *(F.expr(f"array_distinct(transform(picked, i -> q_{h}[i - 1]))").alias(f"c_{h}") for h in _HIGHS))
    places = [F.expr(f"size(filter(c_{h}, c -> c < {h}))") for h in _HIGHS]
    return vectors.join(cuts, "cohort").withColumn("cell", F.array(*places)).withColumn("level", sum(places, F.lit(0))).drop(*(f"c_{h}" for h in _HIGHS))


def _grid(vectors: DataFrame, most: int) -> DataFrame:
    """``vectors`` with ``cell``, their places among each objective's quantiles of highs, and ``level``, the places' sum.

    A cohort of ``most`` vectors or fewer is one cell. Where objectives go together and cells hold over twice as many,
    their cohort is cut into twice as many ways, and so on; beyond MOST_CUTS a cell is only larger, not left out.
    """
    quantiles = cut(_quantiles(vectors, most))
    while True:
        placed = _placed(vectors, quantiles)
        full = placed.groupBy("cohort", "ways", "cell").count().where((F.col("count") > 2 * most) & (F.col("ways") <= MOST_CUTS)).select("cohort").distinct()
        full = cut(full.withColumn("full", F.lit(True)))
        if full.isEmpty():
            return placed.drop("ways")
        twice = F.when(F.col("full"), F.least(F.lit(MOST_CUTS + 1), F.col("ways") * 2)).otherwise(F.col("ways"))
        quantiles = cut(quantiles.join(full, "cohort", "left").withColumn("ways", twice).drop("full"))


def _bounds(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("cohort", "cell", "level").agg(*(f(k).alias(f"{f.__name__}_{k}") for k in _KEYS for f in (F.min, F.max)))


def grid_ranks(vectors: DataFrame, most: int = CELL) -> DataFrame:
    """``vectors`` (cohort, lows and highs, distinct) with ``pareto_rank``; no cohort is in one task.

    Objective space is a grid of cells by highs. A dominator lies in a cell that is nowhere above, so cells on one level
    do not depend on each other, and levels are settled one after another, all cohorts together. Of the settled cells
    one whose highs all lie below a cell's lows dominates it as a whole and gives its greatest rank plus one; one with a
    high above all the cell's lows gives nothing; and of the rest only those whose greatest rank could still raise the
    cell's are compared, vector by vector, a pair of cells in a task, with the vectors of such ranks only.
    """
    spark = vectors.sparkSession
    ship(spark)
    grid = cut(_grid(vectors, most).withColumn("vector", F.monotonically_increasing_id()))
    cells = cut(_bounds(grid))
    levels = [r[0] for r in cells.select("level").distinct().orderBy("level").collect()]
    numbers = ", ".join(f"{k} double" for k in _KEYS)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(pareto_rank=chain_ranks(pdf[_LOWS].to_numpy(), pdf[_HIGHS].to_numpy(), pdf["least"].to_numpy()))[["cohort", "vector", *_KEYS, "pareto_rank"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        above, here = pdf[pdf["pareto_rank"].notna()], pdf[pdf["pareto_rank"].isna()]
        high, ranks = above[_HIGHS].to_numpy(), above["pareto_rank"].to_numpy()
        got = [ranks[over].max() + 1 if (over := _over(high, low)).any() else 0 for low in here[_LOWS].to_numpy()]
        return pd.DataFrame({"vector": here["vector"], "least": np.array(got, np.int64)})

    done: list[DataFrame] = []
    tops: list[DataFrame] = []
    for level in levels:
        mine, here = grid.where(F.col("level") == level), cells.where(F.col("level") == level)
        if not done:
            start = mine.withColumn("least", F.lit(0).cast("long"))
        else:
            settled = reduce(DataFrame.unionByName, done)
            over = reduce(DataFrame.unionByName, tops).select("cohort", F.col("cell").alias("source"), F.col("top"), *(F.col(f"{m}_{h}").alias(f"{m}_s{h}") for m in ("min", "max") for h in _HIGHS))
            pairs = here.join(over, "cohort").where(reduce(lambda a, b: a & b, [F.col(f"min_s{h}") <= F.col(f"max_l{h[1:]}") for h in _HIGHS]))
            whole = reduce(lambda a, b: a & b, [F.col(f"max_s{h}") <= F.col(f"min_l{h[1:]}") for h in _HIGHS]) & reduce(lambda a, b: a | b, [F.col(f"max_s{h}") < F.col(f"min_l{h[1:]}") for h in _HIGHS])
            pairs = cut(pairs.select("cohort", "cell", "source", "top", whole.alias("whole")))
            base = pairs.where("whole").groupBy("cohort", "cell").agg((F.max("top") + 1).alias("base"))
            open_pairs = pairs.where("NOT whole").join(base, ["cohort", "cell"], "left").withColumn("base", F.coalesce("base", F.lit(0).cast("long"))).where("top + 1 > base")
            pair = F.struct("cell", "source").alias("pair")
            low_side = mine.join(open_pairs.select("cohort", "cell", "source"), ["cohort", "cell"]).select("cohort", pair, "vector", *_KEYS, F.lit(None).cast("long").alias("pareto_rank"))
            high_side = settled.withColumnRenamed("cell", "source").join(open_pairs.select("cohort", "cell", "source", "base"), ["cohort", "source"]).where("pareto_rank >= base").select("cohort", pair, "vector", *_KEYS, "pareto_rank")
            found = low_side.unionByName(high_side).groupBy("cohort", "pair").applyInPandas(compare, "vector long, least long").groupBy("vector").agg(F.max("least").alias("found"))
            start = mine.join(base, ["cohort", "cell"], "left").join(found, "vector", "left").withColumn("least", F.greatest(F.coalesce("base", F.lit(0).cast("long")), F.coalesce("found", F.lit(0).cast("long"))))
        ranked = start.select("cohort", "cell", "vector", *_KEYS, "least").groupBy("cohort", "cell").applyInPandas(settle, f"cohort string, vector long, {numbers}, pareto_rank long")
        ranked = cut(ranked.join(mine.select("vector", "cell"), "vector"))
        done.append(ranked)
        tops.append(ranked.groupBy("cohort", "cell").agg(F.max("pareto_rank").alias("top"), *(f(h).alias(f"{f.__name__}_{h}") for h in _HIGHS for f in (F.min, F.max))))
    if not done:
        return vectors.withColumn("pareto_rank", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, done).select("cohort", *_KEYS, "pareto_rank")


def pareto_ranks(features: DataFrame, most: int = CELL) -> DataFrame:
    """(relative_path, cohort, pareto_rank). Equal interval vectors of a cohort are ranked once, so copies of a directory cost nothing.

    Defined cases: a cohort of one has rank 0; directories with equal vectors share a rank; no directories, no rows.
    """
    wide = objective_columns(features)
    flat = wide.select("relative_path", "cohort", *(F.col(OBJECTIVES[int(k[1])])["low" if k[0] == "l" else "high"].alias(k) for k in _KEYS))
    ranked = grid_ranks(flat.select("cohort", *_KEYS).distinct(), most)
    return flat.join(ranked, ["cohort", *_KEYS]).select("relative_path", "cohort", "pareto_rank")


def review_queue(features: DataFrame, ranks: DataFrame, limit: int = 100) -> DataFrame:
    """(review_order, relative_path, priority): the ``limit`` (1 to 1000) directories of most impact, uncertainty and front."""
    if not 1 <= limit <= 1000:
        raise ValueError("review limit must be between 1 and 1000")
    priority = F.log1p("recursive_bytes") * (F.col("unknown_ratio") + 0.1) / (F.col("pareto_rank") + 1)
    best = features.join(ranks.select("relative_path", "pareto_rank"), "relative_path").select("relative_path", priority.alias("priority")).orderBy(F.desc("priority"), "relative_path").limit(limit)
    return best.select(F.row_number().over(Window.orderBy(F.desc("priority"), "relative_path")).alias("review_order"), "relative_path", "priority")
