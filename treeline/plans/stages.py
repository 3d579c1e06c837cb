"""The stages of an analysis as runs of a workspace: each reads the tables of earlier runs and writes its own.

Every function returns its run's ledger row and takes a ``run_id``, which must be new. Inputs are runs as
:meth:`Workspace.find` returns them; where none is given, the latest complete run of the kind is taken. Counts that
follow from earlier counts are expected while writing, so a table that lost or doubled rows fails its run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import blocks, evidence, graph, ranking, structural, synthesis, temporal
from treeline.operators.runs import RunError, Table, Workspace
from treeline.sources.sample import directories


def _input(ws: Workspace, kind: str, run: dict | None) -> dict:
    return ws.find(kind) if run is None else run


def _reader(ws: Workspace, run: dict):
    """Reads the tables of a run that is known to be complete, without looking it up again."""
    return lambda name: ws.spark.read.parquet(f"{ws.path}/{run['kind']}/{run['run_id']}/{name}")


def run_session(ws: Workspace, files: DataFrame, errors: DataFrame, *, run_id: str | None = None, expect: dict[str, int] | None = None) -> dict:
    """A snapshot: files (relative_path unique), errors, directories. ``expect`` are counts that the scan reported, by table and count."""
    wanted = {t: {n.partition(".")[2]: v for n, v in (expect or {}).items() if n.startswith(f"{t}.")} for t in ("files", "errors", "directories")}
    regular = (F.col("entry_type") == "FILE") & (F.col("observation_status") == "OBSERVED")
    facts = {"observed": F.count_if(regular), "bytes": F.sum(F.when(regular, F.col("logical_bytes")))}
    return ws.run("session", [
        Table("files", lambda: files, ("relative_path",), facts, wanted["files"]),
        Table("errors", lambda: errors, (), {}, wanted["errors"]),
        Table("directories", lambda: directories(files), ("relative_path",), {}, wanted["directories"]),
    ], run_id=run_id)


def run_analysis(ws: Workspace, session: dict | None = None, *, run_id: str | None = None) -> dict:
    """roles (a row a file), aggregates (a row a directory, the root too), projects, features."""
    session = _input(ws, "session", session)
    read, run_id = _reader(ws, session), run_id or f"analysis-of-{session['run_id']}"
    own = _reader(ws, {"kind": "analysis", "run_id": run_id})
    return ws.run("analysis", [
        Table("roles", lambda: structural.classify_roles(read("files")), ("relative_path",), {}, {"rows": session["counts"]["files.observed"]}),
        Table("aggregates", lambda: structural.directory_aggregates(own("roles"), read("directories")), ("relative_path",), {}, {"rows": session["counts"]["directories.rows"] + 1}),
        Table("projects", lambda: structural.projects(read("files")), ("relative_path",)),
        Table("features", lambda: ranking.directory_features(own("aggregates"), own("projects")), ("relative_path",)),
    ], inputs=[session], run_id=run_id)


def run_ranking(ws: Workspace, analysis: dict | None = None, *, run_id: str | None = None) -> dict:
    """intervals (four objectives a candidate) and ranks (a row a candidate)."""
    analysis = _input(ws, "analysis", analysis)
    read, n = _reader(ws, analysis), analysis["counts"]["features.rows"]
    return ws.run("ranking", [
        Table("intervals", lambda: ranking.objective_intervals(read("features")), ("relative_path", "objective_name"), {}, {"rows": 4 * n}),
        Table("ranks", lambda: ranking.pareto_ranks(read("features")), ("relative_path",), {}, {"rows": n}),
    ], inputs=[analysis], run_id=run_id or f"ranking-of-{analysis['run_id']}")


def run_enrichment(ws: Workspace, content: DataFrame, session: dict | None = None, *, level: str = "D4", run_id: str | None = None) -> dict:
    """hashes, groups and members of the selected files, given as (relative_path, content); each has to be a file of the session."""
    session = _input(ws, "session", session)
    read, run_id = _reader(ws, session), run_id or f"enrichment-of-{session['run_id']}"
    own = _reader(ws, {"kind": "enrichment", "run_id": run_id})
    known = read("files").select("relative_path", F.lit(True).alias("__known"))
    checked = content.join(known, "relative_path", "left")
    path = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("not a file of the session: "), F.col("relative_path")))).otherwise(F.col("relative_path"))
    return ws.run("enrichment", [
        Table("hashes", lambda: evidence.hash_content(checked.withColumn("relative_path", path).drop("__known"), level), ("relative_path",)),
        Table("groups", lambda: evidence.duplicate_groups(own("hashes")), ("group_id",), {"members": F.sum("member_count")}),
        Table("members", lambda: evidence.duplicate_members(own("hashes"), own("groups")), ("group_id", "relative_path")),
    ], inputs=[session], run_id=run_id)


def run_fusion(ws: Workspace, analysis: dict | None = None, enrichment: dict | None = None, *, run_id: str | None = None) -> dict:
    """directories: what of each one's files and bytes is selected, and how much of that is confirmed to be duplicate."""
    analysis, enrichment = _input(ws, "analysis", analysis), _input(ws, "enrichment", enrichment)
    a, e = _reader(ws, analysis), _reader(ws, enrichment)
    full = {"rows": analysis["counts"]["aggregates.rows"]}
    return ws.run("fusion", [Table("directories", lambda: evidence.directory_evidence(a("aggregates"), e("hashes"), e("groups"), e("members")), ("relative_path",), {}, full)], inputs=[analysis, enrichment], run_id=run_id)


def run_longitudinal(ws: Workspace, baseline: dict, current: dict, *, run_id: str | None = None) -> dict:
    """changes, directories and nodes (projects) from the session of one analysis to that of another."""
    (b, c), run_id = (_reader(ws, r) for r in (baseline, current)), run_id or f"{baseline['run_id']}-to-{current['run_id']}"
    before, after = (_reader(ws, {"kind": "session", "run_id": r["sessions"][0]}) for r in (baseline, current))
    own = _reader(ws, {"kind": "longitudinal", "run_id": run_id})
    sessions = [baseline["sessions"][0], current["sessions"][0]]
    return ws.run("longitudinal", [
        Table("changes", lambda: temporal.file_changes(before("files"), after("files"), before("errors"), after("errors")), ("relative_path",)),
        Table("directories", lambda: temporal.directory_changes(own("changes"), before("directories").unionByName(after("directories")).distinct()), ("relative_path",)),
        Table("nodes", lambda: temporal.project_nodes(b("projects"), c("projects"), own("changes"), after("files")), ("project",)),
    ], inputs=[baseline, current], sessions=sessions, run_id=run_id)


def run_history(ws: Workspace, links: list[dict], *, run_id: str | None = None) -> dict:
    """directories and projects over a chain of longitudinal runs, each of which starts where the one before it ends."""
    if not links or any(a["sessions"][1] != b["sessions"][0] for a, b in zip(links, links[1:], strict=False)):
        raise RunError("the links are no chain")

    def along(name: str) -> DataFrame:
        every = [_reader(ws, r)(name).withColumn("ordinal", F.lit(i)) for i, r in enumerate(links)]
        whole = every[0]
        for more in every[1:]:
            whole = whole.unionByName(more)
        return whole

    return ws.run("history", [
        Table("directories", lambda: temporal.directory_history(along("directories")), ("relative_path",)),
        Table("projects", lambda: temporal.project_history(along("nodes"), len(links)), ("project",)),
    ], inputs=links, sessions=[links[0]["sessions"][0], *(r["sessions"][1] for r in links)], run_id=run_id)


def run_dependency(ws: Workspace, relations: DataFrame, analysis: dict | None = None, *, evaluated: DataFrame, run_id: str | None = None) -> dict:
    """nodes: a row for each project of the analysis, with degrees, rank and cut risk in the graph of ``relations``
    (source, target, relationship_type, confidence) and whether it is among the ``evaluated`` (node)."""
    analysis = _input(ws, "analysis", analysis)
    read, run_id = _reader(ws, analysis), run_id or f"dependency-of-{analysis['run_id']}"
    own, n = _reader(ws, {"kind": "dependency", "run_id": run_id}), analysis["counts"]["projects.rows"]

    def nodes() -> DataFrame:
        return read("projects").select(F.col("relative_path").alias("node"))

    def joined() -> DataFrame:
        edges, seen = own("relations"), evaluated.select("node").distinct().withColumn("seen", F.lit(True))
        degrees = graph.dependency_degrees(nodes(), edges).join(graph.pagerank(nodes(), edges), "node").join(blocks.cut_risk(nodes(), edges), "node")
        return degrees.join(seen, "node", "left").withColumn("evaluation_state", F.when(F.col("seen"), "EVALUATED").otherwise("NOT_EVALUATED")).drop("seen")

    return ws.run("dependency", [
        Table("relations", lambda: relations, ("source", "target", "relationship_type")),
        Table("nodes", joined, ("node",), {"evaluated": F.count_if(F.col("evaluation_state") == "EVALUATED")}, {"rows": n}),
    ], inputs=[analysis], run_id=run_id)


def run_synthesis(ws: Workspace, ranking_run: dict, fusion: dict, dependency: dict, history: dict, *, run_id: str | None = None) -> dict:
    """evidence (a row a ranked candidate) and signals. The first three have to stem from the session that the history ends with."""
    if any(list(r["sessions"]) != [history["sessions"][-1]] for r in (ranking_run, fusion, dependency)):
        raise RunError("the history does not end with the session of the other inputs")
    r, f, d, h = (_reader(ws, x) for x in (ranking_run, fusion, dependency, history))
    run_id = run_id or f"synthesis-of-{ranking_run['run_id']}"
    own = _reader(ws, {"kind": "synthesis", "run_id": run_id})

    def joined() -> DataFrame:
        ranks = r("ranks").select("relative_path", "pareto_rank")
        rows = synthesis.candidate_evidence(ranks.select("relative_path"), f("directories"), d("nodes"), h("directories"), h("projects"))
        return rows.join(ranks, "relative_path")

    return ws.run("synthesis", [
        Table("evidence", joined, ("relative_path",), {}, {"rows": ranking_run["counts"]["ranks.rows"]}),
        Table("signals", lambda: synthesis.review_signals(own("evidence")), ("relative_path", "signal")),
    ], inputs=[ranking_run, fusion, dependency, history], sessions=history["sessions"], run_id=run_id)
