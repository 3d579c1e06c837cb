"""One row of evidence a candidate directory, and the signals that a reviewer should see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.temporal import assign_projects


def candidate_evidence(candidates: DataFrame, evidence: DataFrame, dependency: DataFrame, directory_history: DataFrame, project_history: DataFrame) -> DataFrame:
    """Joins everything known of each candidate (relative_path). Directory evidence and history must be there for all of
    them, project history for each project that a candidate lies in; a project '' holds none."""
    held = assign_projects(candidates.select("relative_path"), dependency.where("node <> ''").select(F.col("node").alias("relative_path")), root=False)
    e = evidence.select("relative_path", "coverage", "selected_files", "candidate_files", "confirmed_files", "confirmed_ratio", F.lit(True).alias("_e"))
    h = directory_history.select("relative_path", F.col("transitions").alias("history_transitions"), F.col("ambiguous").alias("history_ambiguous"), "mean_churn", "max_churn", F.lit(True).alias("_h"))
    d = dependency.select(F.col("node").alias("project"), "evaluation_state", "in_degree", "out_degree", "relationship_degree", "pagerank", "cut_risk")
    p = project_history.select("project", F.col("activity_ratio").alias("project_activity"), F.col("ambiguous_files").alias("project_ambiguous"), F.lit(True).alias("_p"))
    rows = held.join(e, "relative_path", "left").join(h, "relative_path", "left").join(d, "project", "left").join(p, "project", "left")
    missing = F.col("_e").isNull() | F.col("_h").isNull() | (F.col("project").isNotNull() & F.col("_p").isNull())
    path = F.when(missing, F.raise_error(F.concat(F.lit("evidence does not cover "), F.col("relative_path")))).otherwise(F.col("relative_path"))
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree", "relationship_degree", "cut_risk")}
    return (
        rows.withColumns({"relative_path": path, "evaluation_state": F.coalesce("evaluation_state", F.lit("NO_PROJECT_CONTEXT")), "pagerank": F.coalesce("pagerank", F.lit(0.0)), **zeros}).drop("_e", "_h", "_p")
    )


def review_signals(evidence: DataFrame) -> DataFrame:
    """(relative_path, signal), up to six a candidate."""
    ambiguous = (F.col("history_ambiguous") > 0) | (F.coalesce("project_ambiguous", F.lit(0)) > 0)
    rules: list[tuple[str, Column]] = [
        ("ENRICHMENT_PARTIAL_COVERAGE", F.col("coverage") < 1.0),
        ("CONFIRMED_DUPLICATE_MEMBERS", F.col("confirmed_files") > 0),
        ("DEPENDENCY_NOT_EVALUATED", F.col("project").isNotNull() & (F.col("evaluation_state") != "EVALUATED")),
        ("DEPENDENCY_CUT_RISK", F.col("cut_risk") > 0),
        ("HISTORY_AMBIGUITY", ambiguous),
        ("HISTORY_CHURN_OBSERVED", F.col("max_churn") > 0),
    ]
    found = F.filter(F.array(*(F.when(c, name) for name, c in rules)), lambda s: s.isNotNull())
    return evidence.select("relative_path", F.explode(found).alias("signal"))
