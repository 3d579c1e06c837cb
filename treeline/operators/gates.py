"""Acceptance gates as a table of rules over declared measurements, and the percentile they use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.store import written

#: Values of a group up to which they are counted one by one, cuts of a larger one, and groups up to which their rows are broadcast, about a kilobyte each.
REST, CUTS, FEW_GROUPS = 100_000, 128, 10_000

MINIMUM_ENTRIES, MINIMUM_QUERIES = 1_000_000, 100
#: Gates that are a list of facts which must be true.
FACT_GATES = {
    "enrichment_distinct_volume": ("completed", "distinct_os_volumes", "selection_immutable", "source_contents_unchanged", "access_time_risk_acknowledged"),
    "forced_interruption_recovery": ("interruption_observed", "stopped_state_recorded", "resume_completed", "source_contents_unchanged"),
    "database_corruption": ("corruption_detected", "failed_closed"),
    "metadata_edge_cases": ("long_paths_tested", "invalid_metadata_tested", "permission_errors_tested", "concurrent_mutation_tested", "failed_closed"),
    "visible_gui_review": ("visible_session", "review_completed", "no_critical_defects"),
    "independent_replication": ("independent_host", "fresh_clone", "revision_matched", "mandatory_tests_passed", "source_contents_unchanged"),
}
SCALE_GATES, VIEWER_GATE = ("scanner_scale", "snapshot_pipeline_scale"), "viewer_search_scale"
#: What a rule may ask of a metric: to be true, or to compare with another metric of the gate or with a number.
TRUE, AT_MOST, AT_LEAST = "true", "at most", "at least"
_SCALE_RULES = [
    *((m, AT_MOST, f"maximum_{m}", None) for m in ("duration_seconds", "peak_rss_bytes", "temporary_bytes")),
    ("minimum_entry_count", AT_LEAST, None, float(MINIMUM_ENTRIES)),
    ("observed_entry_count", AT_LEAST, "minimum_entry_count", None),
    *((m, TRUE, None, None) for m in ("completed", "inputs_unchanged")),
]
_VIEWER_RULES = [("query_count", AT_LEAST, None, float(MINIMUM_QUERIES)), ("p95_query_seconds", AT_MOST, "maximum_p95_query_seconds", None), ("query_only", TRUE, None, None)]
#: (gate, metric, relation, other metric, number) of every rule.
RULES = [
    *((g, *r) for g in (*SCALE_GATES, VIEWER_GATE) for r in _SCALE_RULES),
    *((VIEWER_GATE, *r) for r in _VIEWER_RULES),
    *((g, m, TRUE, None, None) for g, facts in FACT_GATES.items() for m in facts),
]


def evaluate(measurements: DataFrame) -> DataFrame:
    """(gate, status, reasons) of every gate, for ``measurements`` (gate, metric, flag, number).

    A gate without measurements is INCOMPLETE, one with a rule that does not hold is FAIL, others are PASS. A missing or
    negative number, or a flag where a number belongs, does not hold. Measurements of an unknown gate raise.
    """
    spark = measurements.sparkSession
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "place int, gate string, metric string, relation string, other string, least double")
    known = F.col("gate").isin(*{r[0] for r in RULES})
    given = measurements.select(F.when(known, F.col("gate")).otherwise(F.raise_error(F.concat(F.lit("unknown gate: "), F.col("gate")))).alias("gate"), "metric", "flag", "number")
    other = given.select("gate", F.col("metric").alias("other"), F.col("number").alias("bound"))
    judged = rules.join(given, ["gate", "metric"], "left").join(other, ["gate", "other"], "left").join(given.groupBy("gate").agg(F.lit(True).alias("measured")), "gate", "left")
    bound = F.coalesce("bound", "least")
    holds = F.when(F.col("relation") == TRUE, F.col("flag")).when((F.col("number") < 0) | (bound < 0), False).when(F.col("relation") == AT_MOST, F.col("number") <= bound).otherwise(F.col("number") >= bound)
    reason = F.concat_ws(" ", F.col("metric"), F.lit("must be"), F.col("relation"), F.coalesce("other", F.col("least").cast("decimal(20,0)").cast("string")))
    broken = F.collect_list(F.when(~F.coalesce(holds, F.lit(False)), F.struct("place", reason.alias("reason"))))
    rows = judged.groupBy("gate").agg(F.max("measured").alias("measured"), F.sort_array(broken).alias("broken"))
    reasons = F.when(F.col("measured"), F.col("broken.reason")).otherwise(F.array(F.lit("no measurements")))
    status = F.when(F.col("measured").isNull(), "INCOMPLETE").when(F.size("broken") > 0, "FAIL").otherwise("PASS")
    return rows.select("gate", status.alias("status"), reasons.alias("reasons"))


def overall(gates: DataFrame) -> DataFrame:
    """One row: FAIL before INCOMPLETE before PASS."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return gates.agg(F.when(any_("FAIL"), "FAIL").when(any_("INCOMPLETE"), "INCOMPLETE").otherwise("PASS").alias("status"))


def percentile(rows: DataFrame, value: str, *by: str, percent: int = 95) -> DataFrame:
    """(by, value's nearest-rank percentile as ``p``, n): the least value that ``percent`` of the group's values do not exceed.

    A group of up to REST values is counted value by value. A larger one is cut at CUTS values of an approximate
    quantile sketch; one pass counts the rows at and between cuts, and only the gap that the rank falls into goes on.
    Cuts are values of the group, so a value that is there often has a count of its own, and a gap holds about one
    part in CUTS. No group's values meet in one task, and none but the last gaps' are shuffled.

    Defined cases: nulls are counted in n only; a group of nulls has a null p; null keys are a group; no rows, no rows.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    keys = [f"_k{i}" for i in range(len(by) + 1)]
    # A constant key, so that no grouping columns are a group too; flags tell null keys from others.
    data = rows.select(*(F.struct(F.col(c).alias("v")).alias(k) for c, k in zip(by, keys, strict=False)), F.lit(0).alias(keys[-1]), F.col(value).alias("_v"))
    sizes = written(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("_m")))
    data = data.where("_v is not null")
    asks = sizes.where("_m > 0").select(*keys, "_m", F.expr(f"(_m * {percent} + 99) div 100").alias("_rank"))
    done = []
    while True:
        few, many = asks.where(f"_m <= {REST}"), written(asks.where(f"_m > {REST}"))
        counted = _beside(data, few, keys).groupBy(*keys, "_v", "_rank").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
        done.append(counted.withColumn("_upto", upto).where("_upto >= _rank").groupBy(*keys).agg(F.min("_v").alias("p")))
        if many.isEmpty():
            break
        held = _beside(data, many, keys)
        cuts = F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], 100 * CUTS))
        sketch = written(held.groupBy(*keys).agg(F.array_sort(cuts).alias("_cuts")).join(many, keys))
        below, equal = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.array_contains("_cuts", F.col("_v"))
        parts = _beside(data, sketch, keys).groupBy(*keys, "_rank", (below * 2 + equal.cast("int")).alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part"))
        hit = parts.withColumn("_upto", upto).where("_upto >= _rank and _upto - _c < _rank")
        hit = written(hit.select(*keys, "_lo", "_hi", F.col("_c").alias("_m"), (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")))
        done.append(hit.where("_lo = _hi").select(*keys, F.col("_lo").alias("p")))
        asks = hit.where("_lo < _hi")
        gap = asks.select(*keys, "_lo", "_hi")
        data = written(_beside(data, gap, keys).where("_v between _lo and _hi").select(*keys, "_v"))
        asks = asks.select(*keys, "_m", "_rank")
    found = sizes.join(reduce(DataFrame.unionByName, done), keys, "left")
    return found.select(*(F.col(k)["v"].alias(c) for c, k in zip(by, keys, strict=False)), "p", "n")


def _beside(data: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``data`` with its group's row; groups are broadcast up to FEW_GROUPS, whatever the rows, and joined by key beyond."""
    small = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return data.join(F.broadcast(groups) if small else groups, keys)


def p95(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The nearest-rank 95th percentile."""
    return percentile(rows, value, *by).withColumnRenamed("p", "p95")


def latency_gates(rows: DataFrame, value: str, by: str, *, budget: float, least: int = MINIMUM_QUERIES) -> DataFrame:
    """(by, p95, n, status): PASS within the budget, FAIL over it, INCOMPLETE with fewer than ``least`` rows."""
    status = F.when(F.col("n") < least, "INCOMPLETE").when(F.col("p95") > budget, "FAIL").otherwise("PASS")
    return p95(rows, value, by).withColumn("status", status)
