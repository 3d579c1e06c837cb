"""Changes between two snapshots, and histories over a chain of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import paths
from treeline.operators.similarity import set_pairs, similar_sets

AMBIGUOUS = "AMBIGUOUS_ERROR_REGION"


def in_error_region(items: DataFrame, errors: DataFrame) -> DataFrame:
    """(relative_path) of the items that lie under an error's path or above it: two equi-joins on exploded ancestors."""
    e = errors.select(F.col("relative_path").alias("_e")).distinct()
    above = e.select(F.explode(paths.ancestors("_e", itself=True)).alias("relative_path")).distinct()
    under = items.select("relative_path", F.explode(paths.ancestors("relative_path", itself=True)).alias("_e")).join(e, "_e", "left_semi").select("relative_path")
    return under.unionByName(items.select("relative_path").join(above, "relative_path", "left_semi")).distinct()


def regular_files(files: DataFrame) -> DataFrame:
    return files.where("entry_type = 'FILE' AND observation_status = 'OBSERVED'")


def file_changes(baseline: DataFrame, current: DataFrame, baseline_errors: DataFrame, current_errors: DataFrame) -> DataFrame:
    """(relative_path, change_type, confidence, before and after of bytes, time and attributes) of every file of either snapshot."""
    facts = ("logical_bytes", "modified_ns", "attributes")
    side = lambda df, tag: regular_files(df).select("relative_path", F.lit(True).alias(f"in_{tag}"), *(F.col(c).alias(f"{tag}_{c}") for c in facts))
    both = side(baseline, "before").join(side(current, "after"), "relative_path", "full")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    kind = F.when(F.col("in_before").isNull(), "ADDED").when(F.col("in_after").isNull(), "REMOVED").when(same, "METADATA_UNCHANGED").otherwise("METADATA_CHANGED")
    typed = both.withColumn("change_type", kind)
    moved = typed.where("change_type IN ('ADDED', 'REMOVED')").select("relative_path", "change_type")
    # An added file is in doubt where the baseline had errors, a removed one where the current snapshot had.
    doubt = in_error_region(moved.where("change_type = 'ADDED'"), baseline_errors).unionByName(in_error_region(moved.where("change_type = 'REMOVED'"), current_errors)).withColumn("doubt", F.lit(True))
    confidence = F.when(F.col("doubt"), AMBIGUOUS).when(F.col("change_type") == "ADDED", "OBSERVED_CURRENT").when(F.col("change_type") == "REMOVED", "OBSERVED_BASELINE").otherwise("OBSERVED_BOTH")
    return typed.join(doubt, "relative_path", "left").select("relative_path", "change_type", confidence.alias("confidence"), *(f"{t}_{c}" for c in facts for t in ("before", "after")))


def directory_changes(changes: DataFrame, directories: DataFrame) -> DataFrame:
    """Counts of changes, bytes gained and churn of every directory (the root as ''), quiet ones too; a change in an unknown directory raises.

    Changes are summed up by parent before they are expanded over ancestors.
    """
    is_ = lambda t: F.count_if(F.col("change_type") == t)
    delta = F.coalesce("after_logical_bytes", F.lit(0)) - F.coalesce("before_logical_bytes", F.lit(0))
    sums = ("added", "removed", "changed", "unchanged", "ambiguous", "bytes_delta")
    per_parent = changes.groupBy(F.coalesce(paths.parent("relative_path"), F.lit("")).alias("p")).agg(
        is_("ADDED").alias("added"), is_("REMOVED").alias("removed"), is_("METADATA_CHANGED").alias("changed"), is_("METADATA_UNCHANGED").alias("unchanged"),
        F.count_if(F.col("confidence") == AMBIGUOUS).alias("ambiguous"), F.sum(delta).alias("bytes_delta"),
    )
    up = per_parent.select(F.explode(paths.ancestors("p", itself=True)).alias("relative_path"), *sums).groupBy("relative_path").agg(*(F.sum(c).alias(c) for c in sums))
    root = directories.sparkSession.createDataFrame([("",)], "relative_path string")
    rows = directories.select("relative_path").unionByName(root).distinct().withColumn("known", F.lit(True)).join(up, "relative_path", "full").na.fill(0, list(sums))
    here = F.when(F.col("known"), F.col("relative_path")).otherwise(F.raise_error(F.concat(F.lit("changes in an unknown directory: "), F.col("relative_path"))))
    rows = rows.select(here.alias("relative_path"), *sums)
    total = F.col("added") + F.col("removed") + F.col("changed") + F.col("unchanged")
    moved = F.col("added") + F.col("removed") + F.col("changed")
    return rows.withColumn("churn", F.when(total == 0, 0.0).otherwise(moved / total))


def assign_projects(items: DataFrame, projects: DataFrame, *, root: bool) -> DataFrame:
    """``items`` with ``project``, the longest one that holds them. A project '' holds everything if ``root``, else nothing."""
    up = items.select("relative_path", F.explode(paths.ancestors("relative_path", root=root, itself=True)).alias("project")).distinct()
    best = up.join(projects.select(F.col("relative_path").alias("project")), "project").groupBy("relative_path").agg(F.max_by("project", F.length("project")).alias("project"))
    return items.join(best, "relative_path", "left")


def project_nodes(baseline_projects: DataFrame, current_projects: DataFrame, changes: DataFrame, current_files: DataFrame) -> DataFrame:
    """(project, state, changed, ambiguous, current_files): removed files count for the baseline's projects, others for the current ones."""
    b, c = (p.select(F.col("relative_path").alias("project"), F.lit(True).alias(t)) for p, t in ((baseline_projects, "b"), (current_projects, "c")))
    state = F.when(F.col("b") & F.col("c"), "RETAINED").when(F.col("c"), "ADDED").otherwise("REMOVED")
    every = b.join(c, "project", "full").select("project", state.alias("state"))
    moved = changes.where("change_type <> 'METADATA_UNCHANGED'").select("relative_path", "change_type", "confidence")
    gone, here = moved.where("change_type = 'REMOVED'"), moved.where("change_type <> 'REMOVED'")
    assigned = assign_projects(here, current_projects, root=True).unionByName(assign_projects(gone, baseline_projects, root=True))
    counts = assigned.where("project IS NOT NULL").groupBy("project").agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("confidence") == AMBIGUOUS).alias("ambiguous"))
    held = assign_projects(regular_files(current_files).select("relative_path"), current_projects, root=True).where("project IS NOT NULL").groupBy("project").agg(F.count(F.lit(1)).alias("current_files"))
    return every.join(counts, "project", "left").join(held, "project", "left").na.fill(0, ["changed", "ambiguous", "current_files"])


def extension_sets(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, extension), distinct: the folded extensions of the regular files that each project holds."""
    held = assign_projects(regular_files(files).where("extension <> ''"), projects, root=True).where("project IS NOT NULL").select("project", "extension").distinct()
    return held.select("project", paths.casefold("extension").alias("extension")).distinct()


def shared_extension_edges(files: DataFrame, projects: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(source, target, shared, similarity) of project pairs whose sets of extensions overlap by ``threshold`` or more."""
    found = similar_sets(extension_sets(files, projects), "project", "extension", threshold)
    return set_pairs(*found).withColumnsRenamed({"a": "source", "b": "target"})


def file_history(transitions: DataFrame, count: int) -> DataFrame:
    """Features of each path over ``count`` contiguous transitions, given as (ordinal, relative_path, change_type, confidence).

    The state before a transition settles what an ambiguous one before it left open; states that contradict each
    other raise.
    """
    every = transitions.select("relative_path").distinct().select("relative_path", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("ordinal"))
    grid = every.join(transitions.select("relative_path", "ordinal", "change_type", (F.col("confidence") == AMBIGUOUS).alias("doubt")), ["relative_path", "ordinal"], "left").na.fill(False, ["doubt"])
    kind, doubt = F.col("change_type"), F.col("doubt")
    open_state = F.when(doubt, "AMBIGUOUS_NOT_OBSERVED").otherwise("NOT_OBSERVED")
    before = F.when(kind == "ADDED", open_state).when(kind.isNull(), "NOT_OBSERVED").otherwise("OBSERVED")
    after = F.when(kind == "REMOVED", open_state).when(kind.isNull(), "NOT_OBSERVED").otherwise("OBSERVED")
    along = Window.partitionBy("relative_path").orderBy("ordinal")
    stated = grid.withColumns({"before": before, "after": after}).withColumn("next", F.lead("before").over(along))
    clash = F.col("next").isNotNull() & (F.col("next") != F.col("after")) & (F.col("after") != "AMBIGUOUS_NOT_OBSERVED") & (F.col("next") != "AMBIGUOUS_NOT_OBSERVED")
    settled = F.when(clash, F.raise_error(F.lit("states of a file contradict each other"))).when((F.col("after") == "AMBIGUOUS_NOT_OBSERVED") & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("after"))
    stable = kind.eqNullSafe("METADATA_UNCHANGED")
    island = F.when(stable, F.col("ordinal") - F.row_number().over(Window.partitionBy("relative_path", stable).orderBy("ordinal")))
    marked = stated.select("relative_path", "ordinal", "before", settled.alias("state"), "change_type", "doubt", island.alias("island"))
    runs = marked.where("island IS NOT NULL").groupBy("relative_path", "island").count().groupBy("relative_path").agg(F.max("count").alias("longest_stable"))
    seen = F.col("state") == "OBSERVED"
    first_before = F.max(F.when(F.col("ordinal") == 0, F.col("before"))) == "OBSERVED"
    sure = lambda t: F.count_if((kind == t) & ~doubt)
    facts = marked.groupBy("relative_path").agg(
        F.when(first_before, F.lit(0)).otherwise(F.min(F.when(seen, F.col("ordinal") + 1))).alias("first_observed"),
        F.coalesce(F.max(F.when(seen, F.col("ordinal") + 1)), F.when(first_before, F.lit(0))).alias("last_observed"),
        (F.count_if(seen) + first_before.cast("long")).alias("observed"),
        sure("ADDED").alias("appearances"), sure("REMOVED").alias("disappearances"), F.count_if(kind == "METADATA_CHANGED").alias("changed"),
        F.count_if(kind == "METADATA_UNCHANGED").alias("unchanged"), F.count_if(doubt).alias("ambiguous"), F.max_by("state", "ordinal").alias("final_state"),
    )
    return facts.join(runs, "relative_path", "left").na.fill(0, ["longest_stable"]).withColumn("observation_ratio", F.col("observed") / F.lit(count + 1))


def directory_history(changes: DataFrame) -> DataFrame:
    """Sums over the transitions that know a directory, and mean and greatest churn."""
    return changes.groupBy("relative_path").agg(
        F.count(F.lit(1)).alias("transitions"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("changed").alias("changed"),
        F.sum("ambiguous").alias("ambiguous"), F.sum("bytes_delta").alias("bytes_delta"), F.avg("churn").alias("mean_churn"), F.max("churn").alias("max_churn"),
    )


def project_history(nodes: DataFrame, count: int) -> DataFrame:
    """Sums over the transitions (ordinal) that know a project, its share of active ones, and whether the last one still has it."""
    latest = F.max(F.when((F.col("ordinal") == count - 1) & (F.col("state") != "REMOVED"), 1))
    return nodes.groupBy("project").agg(
        F.count(F.lit(1)).alias("transitions"), F.count_if(F.col("changed") > 0).alias("active"), F.count_if(F.col("state") == "ADDED").alias("added"),
        F.count_if(F.col("state") == "REMOVED").alias("removed"), F.sum("changed").alias("changed_files"), F.sum("ambiguous").alias("ambiguous_files"),
        (F.count_if(F.col("changed") > 0) / F.count(F.lit(1))).alias("activity_ratio"), F.when(latest == 1, "OBSERVED").otherwise("NOT_OBSERVED").alias("current_state"),
    )


def chain_breaks(links: DataFrame) -> DataFrame:
    """Links (ordinal, baseline, current) whose baseline is not the current snapshot of the link before."""
    along = Window.orderBy("ordinal")
    return links.withColumn("expected", F.lag("current").over(along)).where("expected IS NOT NULL AND expected <> baseline")


