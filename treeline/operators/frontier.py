"""Plans as tables: rules that actions break, the plans of a tree that no other dominates, and the few that people are shown."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import paths
from treeline.operators.planning import METRICS, SELECTORS, Action, Policy
from treeline.store import ship, written

#: bytes, files, bytes x risk, largest archive, archives, bytes x incoherence; the first two are better when large.
_SIGNS = np.array([-1.0, -1.0, 1.0, 1.0, 1.0, 1.0])
_LARGEST = 3
_STATE = "node string, parent string, top string, guarded boolean, over boolean, sums array<double>, archives array<string>, defers array<string>"


def plan_violations(actions: DataFrame, candidates: DataFrame, policy: Policy, *, strict: bool = False) -> DataFrame:
    """(plan_id, candidate_id, rule): what each plan, given as (plan_id, candidate_id, action), does wrong; no rows for a sound one.

    Candidates are as :func:`planning.candidate_tree` makes them, with paths as ids. Above a candidate only a deferral
    leaves it open; anything else settles it: kept, or protected where it or anything above it is. ``strict`` also forbids
    an archive above a protected candidate. Rules are joins on ancestors; no plan is in one task.
    Defined cases: an unknown or null action, an unknown candidate, and a candidate that is missing or twice in a plan are
    rows as well; a plan without rows is no plan.
    """
    facts = candidates.select("candidate_id", "recursive_bytes", (F.col("eligible") == 1).alias("eligible"), (F.col("protected") == 1).alias("protected"), F.lit(True).alias("known"))
    rows = actions.select("plan_id", "candidate_id", "action").join(facts, "candidate_id", "left")
    up = F.explode(paths.ancestors("candidate_id")).alias("up")
    higher = rows.select("plan_id", F.col("candidate_id").alias("up"), F.col("action").alias("up_action"))
    above = rows.select("plan_id", "candidate_id", up).join(higher, ["plan_id", "up"]).groupBy("plan_id", "candidate_id").agg(
        F.max(F.col("up_action") != int(Action.DEFER_TO_CHILDREN)).alias("settled"), F.max(F.col("up_action") == int(Action.PROTECTED)).alias("shielded"))
    holds = candidates.select(up, F.col("protected") == 1).toDF("candidate_id", "p").groupBy("candidate_id").agg(F.max("p").alias("guarded"))
    parents = candidates.select(F.col("parent_id").alias("candidate_id")).where("candidate_id IS NOT NULL").distinct().withColumn("holds", F.lit(True))
    full = rows.join(above, ["plan_id", "candidate_id"], "left").join(holds, "candidate_id", "left").join(parents, "candidate_id", "left")
    full = full.na.fill(False, ["settled", "shielded", "guarded", "holds", "known"])
    is_ = lambda a: F.col("action") == int(a)
    forced = F.when(F.col("protected") | F.col("shielded"), int(Action.PROTECTED)).otherwise(int(Action.KEEP_UNPACKED))
    free = ~F.col("settled")
    rules = [
        ("unknown candidate", ~F.col("known")),
        ("unknown action", F.col("action").isNull() | ~F.col("action").isin(*(int(a) for a in Action))),
        ("not as settled above", F.col("settled") & (F.col("action") != forced)),
        ("protection and action disagree", free & (F.col("protected") != is_(Action.PROTECTED))),
        ("archive is not eligible", free & is_(Action.ARCHIVE_AS_UNIT) & ~F.col("eligible")),
        ("archive is too large", free & is_(Action.ARCHIVE_AS_UNIT) & (F.col("recursive_bytes") > min(policy.maximum_archive_bytes, policy.usable_bytes))),
        ("nothing to defer to", free & is_(Action.DEFER_TO_CHILDREN) & ~F.col("holds")),
    ]
    if strict:
        rules.append(("archive holds a protected candidate", free & is_(Action.ARCHIVE_AS_UNIT) & F.col("guarded")))
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda r: r.isNotNull())
    found = full.select("plan_id", "candidate_id", F.explode(broken).alias("rule"))
    total = candidates.agg(F.count(F.lit(1)).alias("total"))  # one row
    size = rows.where("known").groupBy("plan_id", "candidate_id").count().groupBy("plan_id").agg(F.count(F.lit(1)).alias("distinct"), F.max("count").alias("most"))
    uncovered = size.crossJoin(F.broadcast(total)).where("distinct <> total OR most > 1").select("plan_id", F.lit(None).cast("string").alias("candidate_id"), F.lit("does not name every candidate once").alias("rule"))
    return found.unionByName(uncovered)


def _undominated(sums: np.ndarray) -> np.ndarray:
    """Row numbers that no other row dominates; equal rows all stay."""
    cost = sums * _SIGNS
    kept = []
    for at in range(0, len(cost), 64):
        some = cost[at : at + 64, None]
        beaten = ((cost[None] <= some).all(2) & (cost[None] < some).any(2)).any(1)
        kept.append(at + np.flatnonzero(~beaten))
    return np.concatenate(kept) if kept else np.zeros(0, int)


def _together(parts: list[pd.DataFrame], limit: int) -> tuple[np.ndarray, list[tuple[list, list]]] | None:
    """All undominated choices of one state from each part; None where more than ``limit`` would have to be looked at."""
    sums, picks = np.zeros((1, 6)), [([], [])]
    for part in parts:
        more = np.array(part["sums"].tolist(), dtype=float)
        if len(sums) * len(more) > limit:
            return None
        grid = sums[:, None] + more[None]
        grid[..., _LARGEST] = np.maximum(sums[:, None, _LARGEST], more[None, :, _LARGEST])
        flat = grid.reshape(-1, 6)
        kept = _undominated(flat)
        own = list(zip(part["archives"], part["defers"], strict=True))
        picks = [([*picks[i][0], *own[j][0]], [*picks[i][1], *own[j][1]]) for i, j in (divmod(int(k), len(more)) for k in kept)]
        sums = flat[kept]
    return sums, picks


def _states(node: pd.Series, sums: np.ndarray, picks: list, *, guarded: bool, over: bool = False) -> pd.DataFrame:
    rows = [(node["node"], node["parent"], node["top"], guarded, over, s.tolist(), list(a), list(d)) for s, (a, d) in zip(sums, picks, strict=True)]
    return pd.DataFrame(rows, columns=["node", "parent", "top", "guarded", "over", "sums", "archives", "defers"])


def _solve_node(here: pd.DataFrame, below: pd.DataFrame, largest: int, limit: int) -> pd.DataFrame:
    """A candidate's undominated states from those of its children; ``here`` has what its children have in common."""
    node = here.iloc[0]
    kept = (np.zeros((1, 6)), [([], [])])
    if node["protected"]:
        return _states(node, *kept, guarded=True)
    if node["any_over"]:
        return _states(node, *kept, guarded=bool(node["any_guarded"]), over=True)
    sums, picks = [kept[0]], list(kept[1])
    size = float(node["recursive_bytes"])
    if node["eligible"] and not node["any_guarded"] and node["recursive_bytes"] <= largest:
        sums.append(np.array([[size, float(node["file_count"]), size * node["preservation_risk"], size, 1.0, size * node["incoherence"]]]))
        picks.append(([node["node"]], []))
    if node["children"]:
        found = _together([g for _, g in below.sort_values("node", kind="stable").groupby("node")], limit)
        if found is None:
            return _states(node, *kept, guarded=bool(node["any_guarded"]), over=True)
        sums.append(found[0])
        picks += [(a, [node["node"], *d]) for a, d in found[1]]
    every = np.vstack(sums)
    best = _undominated(every)
    return _states(node, every[best], [picks[i] for i in best], guarded=bool(node["any_guarded"]), over=len(best) > limit)


def _plain(largest: int) -> Column:
    """Whether a candidate has nothing to choose: protected, over the limit below, or no archive itself and above none."""
    archive = (F.col("eligible") == 1) & ~F.col("any_guarded") & (F.col("recursive_bytes") <= largest)
    return F.coalesce((F.col("protected") == 1) | F.col("any_over") | ((F.col("open") == 0) & ~archive), F.lit(False))


def _plain_states(nodes: DataFrame, limit: int) -> DataFrame:
    """What :func:`_solve_node` has for plain candidates, as columns: everything is kept, or deferred to children that keep everything."""
    settled = (F.col("protected") == 1) | F.col("any_over")
    defers = ~settled & (F.col("children") > 0)
    none = F.array().cast("array<string>")
    choices = F.when(defers, F.array(none, F.array("node"))).otherwise(F.array(none))
    return nodes.select(
        "node", "parent", "top", ((F.col("protected") == 1) | F.col("any_guarded")).alias("guarded"),
        ((F.col("protected") != 1) & (F.col("any_over") | (defers & F.lit(limit < 2)))).alias("over"),
        F.array(*(F.lit(0.0) for _ in _SIGNS)).alias("sums"), none.alias("archives"), F.explode(choices).alias("defers"),
    )


def _root_plans(members: pd.DataFrame, tops: pd.DataFrame, limit: int) -> pd.DataFrame:
    """A root's plans with their ids; ``members`` are its candidates' names and whether protection reaches them."""
    root = members["top"].iloc[0]
    columns = ["root", "state", "plan_id", "ordinal", "archives", *METRICS]
    found = None if tops["over"].any() else _together([g for _, g in tops.sort_values("node", kind="stable").groupby("node")], limit)
    if found is None:
        return pd.DataFrame([(root, "SKIPPED_LIMIT", *[None] * 9)], columns=columns).astype({"ordinal": "Int64", "archives": "Int64", **dict.fromkeys(METRICS, "float64")})
    outer = members[members["parent"].isna()]
    whole, files = max(1.0, float(outer["recursive_bytes"].sum())), float(outer["file_count"].sum())
    names = sorted(zip(members["node"], members["shielded"], strict=True))
    rows = []
    for s, (archives, defers) in zip(*found, strict=True):
        set_to = dict.fromkeys(archives, int(Action.ARCHIVE_AS_UNIT)) | dict.fromkeys(defers, int(Action.DEFER_TO_CHILDREN))
        actions = [[n, set_to.get(n, int(Action.PROTECTED if p else Action.KEEP_UNPACKED))] for n, p in names]
        text = json.dumps(actions, separators=(",", ":"))
        rows.append((root, "COMPLETE", hashlib.sha256(text.encode()).hexdigest(), [a for _, a in actions], len(archives), -s[0], max(0.0, files - s[1]), s[2] / whole, s[3], s[4], s[5] / whole))
    rows.sort(key=lambda r: r[3])
    return pd.DataFrame([(*r[:3], i, *r[4:]) for i, r in enumerate(rows)], columns=columns).astype({"ordinal": "Int64", "archives": "Int64"})


def exact_plans(candidates: DataFrame, policy: Policy, *, limit: int = 5000) -> DataFrame:
    """(root, state, plan_id, ordinal, archives, the six metrics): every plan of each top directory's tree that no other
    dominates; ordinal is its place among the root's plans by their actions, in the order of candidates.

    Candidates are settled level by level, deepest first; those without a choice as columns. For the others a task sees one
    candidate and its children's states, and of children with one state only what they have in common. A root where more than ``limit`` combinations would have to be
    looked at, or where one candidate's children have over ten times as many states, gets one row, SKIPPED_LIMIT.
    A plan's id is a digest over all candidates of its root, so those (names and sizes) are in one task at the end.
    Defined cases: no candidates, no rows; ids are unique paths, and a root without eligible candidates has its plans too.
    """
    spark = candidates.sparkSession
    policy.check()
    ship(spark)
    largest = min(policy.maximum_archive_bytes, policy.usable_bytes)
    guard = candidates.where("protected = 1").select(F.col("candidate_id").alias("up"), F.lit(True).alias("hit"))
    reach = candidates.select("candidate_id", F.explode(paths.ancestors("candidate_id", itself=True)).alias("up")).join(guard, "up").select("candidate_id").distinct().withColumn("shielded", F.lit(True))
    nodes = candidates.join(reach, "candidate_id", "left").na.fill(False, ["shielded"]).withColumnsRenamed({"candidate_id": "node", "parent_id": "parent"})
    nodes = written(nodes.withColumns({"top": paths.top("node"), "depth": paths.depth("node"), "parent_depth": paths.depth("parent")}))
    states = spark.createDataFrame([], _STATE)
    for level in sorted((r[0] for r in nodes.select("depth").distinct().collect()), reverse=True):  # as many rows as levels
        here, below = nodes.where(F.col("depth") == level), states.where(paths.depth("parent") == level)
        per_child = below.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n"), F.max("guarded").alias("g"), F.max("over").alias("o"))
        many = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
        shared = per_child.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("n") > 1).alias("open"), F.max("g").alias("any_guarded"), (F.max("o") | (many > 10 * limit)).alias("any_over"))
        here = here.join(shared, "node", "left").na.fill(0, ["children", "open"]).na.fill(False, ["any_guarded", "any_over"])
        here = written(here.withColumn("plain", _plain(largest)))
        # A single state is the one that keeps everything: it adds nothing to any choice.
        asked = here.where("NOT plain")
        passed = below.join(per_child.where("n > 1").select("parent", "node"), ["parent", "node"], "left_semi").join(asked.select(F.col("node").alias("parent")), "parent", "left_semi")
        # Rows are few and work on them is not: they are dealt over all cores, which sizes alone would not do.
        cores = spark.sparkContext.defaultParallelism
        passed = passed.select(F.col("parent").alias("above"), *states.columns).repartition(cores, "above")
        now = asked.drop("plain").repartition(cores, "node").groupBy("node").cogroup(passed.groupBy("above")).applyInPandas(lambda a, b: _solve_node(a, b, largest, limit), _STATE)
        states = written(states.where(paths.depth("parent").isNull() | (paths.depth("parent") != level)).unionByName(now).unionByName(_plain_states(here.where("plain"), limit)))
    members = nodes.select("top", "node", "parent", "shielded", "recursive_bytes", "file_count")
    ddl = f"root string, state string, plan_id string, ordinal long, archives long, {', '.join(f'{c} double' for c in METRICS)}"
    tops = states.where("parent IS NULL")
    return members.groupBy("top").cogroup(tops.groupBy("top")).applyInPandas(lambda a, b: _root_plans(a, b, limit), ddl)


def reduce_plans(plans: DataFrame, limit: int = 12, *, group: str = "root", tie: str = "plan_id") -> DataFrame:
    """The rows of ``plans`` that people are shown, with ``labels``: of each group the best by every selector, the knee, then others by id.

    ``plans`` are (group, plan_id, the six metrics, more), none dominated by another of its group. Ties go to
    the least ``tie``, which no two plans of a group share.
    """
    best = [F.min_by("plan_id", F.struct(*(METRICS[k] for k in by), tie)).alias(label) for label, by in SELECTORS.items()]
    edges = [f(c).alias(f"{t}_{c}") for c in METRICS for t, f in (("low", F.min), ("high", F.max))]
    ends = plans.groupBy(group).agg(*best, *edges)
    away = F.lit(0.0)
    for c in METRICS:
        away = away + F.pow((F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1.0)), 2)
    knee = plans.join(ends, group).groupBy(group).agg(F.min_by("plan_id", F.struct(F.sqrt(away), tie)).alias("knee-compromise"))
    names = [*SELECTORS, "knee-compromise"]
    picks = ends.join(knee, group).select(group, F.explode(F.array(*(F.struct(F.lit(i).alias("__place"), F.lit(n).alias("label"), F.col(f"`{n}`").alias("plan_id")) for i, n in enumerate(names)))).alias("pick"))
    taken = picks.select(group, "pick.*").groupBy(group, "plan_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.min("__place").alias("__place"))
    order = Window.partitionBy(group).orderBy(F.coalesce("__place", F.lit(len(names))), "plan_id")
    rows = plans.join(taken, [group, "plan_id"], "left").withColumn("__at", F.row_number().over(order))
    return rows.where(F.col("__at") <= limit).withColumn("labels", F.coalesce("labels", F.lit(""))).drop("__at", "__place")
