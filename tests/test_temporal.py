"""Changes, error regions, histories, projects."""

import pytest

from treeline.functions import paths
from treeline.operators import temporal


def snapshot(spark, rows):
    df = spark.createDataFrame([(p, n, t) for p, n, t in rows], "relative_path string, logical_bytes long, modified_ns long")
    df = df.selectExpr("*", "0L AS attributes", "'FILE' AS entry_type", "'OBSERVED' AS observation_status").withColumn("name", paths.name("relative_path"))
    return df.withColumn("extension", paths.suffix("name"))


def errors(spark, *found):
    return spark.createDataFrame([(p,) for p in found], "relative_path string")


BASE = [("a/main.py", 5, 1), ("a/same.py", 5, 1), ("unicode/caf.txt", 3, 1), ("b/old.txt", 1, None)]
NEXT = [("a/main.py", 9, 2), ("a/same.py", 5, 1), ("c/new.py", 4, 1), ("b/old.txt", 1, None)]


def test_changes_and_error_regions(spark):
    none = errors(spark)
    got = {r["relative_path"]: (r["change_type"], r["confidence"]) for r in temporal.file_changes(snapshot(spark, BASE), snapshot(spark, NEXT), none, none).collect()}
    assert got == {
        "a/main.py": ("METADATA_CHANGED", "OBSERVED_BOTH"), "a/same.py": ("METADATA_UNCHANGED", "OBSERVED_BOTH"), "b/old.txt": ("METADATA_UNCHANGED", "OBSERVED_BOTH"),
        "unicode/caf.txt": ("REMOVED", "OBSERVED_BASELINE"), "c/new.py": ("ADDED", "OBSERVED_CURRENT"),
    }
    doubt = {r["relative_path"]: r["confidence"] for r in temporal.file_changes(snapshot(spark, BASE), snapshot(spark, NEXT), errors(spark, "c/new.py/x"), errors(spark, "unicode")).collect()}
    assert doubt["unicode/caf.txt"] == doubt["c/new.py"] == temporal.AMBIGUOUS
    whole = temporal.in_error_region(snapshot(spark, BASE), errors(spark, ""))
    assert whole.count() == 4


def test_directory_changes(spark):
    none = errors(spark)
    changes = temporal.file_changes(snapshot(spark, BASE), snapshot(spark, NEXT), none, none)
    dirs = spark.createDataFrame([("a",), ("b",), ("c",), ("unicode",), ("quiet",)], "relative_path string")
    got = {r["relative_path"]: tuple(r)[1:] for r in temporal.directory_changes(changes, dirs).collect()}
    assert got[""] == (1, 1, 1, 2, 0, 5, 3 / 5)
    assert got["a"] == (0, 0, 1, 1, 0, 4, 0.5)
    assert got["quiet"] == (0, 0, 0, 0, 0, 0, 0.0)


def history(spark, rows, n):
    df = spark.createDataFrame(rows, "ordinal int, relative_path string, change_type string, confidence string")
    return {r["relative_path"]: r for r in temporal.file_history(df, n).collect()}


def test_history_states(spark):
    got = history(spark, [
        (0, "stable", "METADATA_UNCHANGED", "OBSERVED_BOTH"), (1, "stable", "METADATA_UNCHANGED", "OBSERVED_BOTH"),
        (0, "gone", "REMOVED", "OBSERVED_BASELINE"), (1, "new", "ADDED", "OBSERVED_CURRENT"),
        (0, "back", "REMOVED", "AMBIGUOUS_ERROR_REGION"), (1, "back", "ADDED", "OBSERVED_CURRENT"),
    ], 2)
    assert (got["stable"]["observed"], got["stable"]["longest_stable"], got["stable"]["observation_ratio"]) == (3, 2, 1.0)
    assert (got["gone"]["first_observed"], got["gone"]["last_observed"], got["gone"]["final_state"]) == (0, 0, "NOT_OBSERVED")
    assert (got["new"]["first_observed"], got["new"]["appearances"], got["new"]["final_state"]) == (2, 1, "OBSERVED")
    assert (got["back"]["disappearances"], got["back"]["ambiguous"], got["back"]["observed"]) == (0, 1, 2)


def test_history_contradiction_raises(spark):
    with pytest.raises(Exception, match="contradict"):
        history(spark, [(0, "x", "ADDED", "OBSERVED_CURRENT"), (1, "x", "ADDED", "OBSERVED_CURRENT")], 2)


def test_projects(spark):
    files = snapshot(spark, [("p/a.py", 1, 1), ("p/sub/b.py", 1, 1), ("q/c.md", 1, 1), ("loose.py", 1, 1)])
    projects = spark.createDataFrame([("p",), ("p/sub",), ("q",)], "relative_path string")
    got = {r["relative_path"]: r["project"] for r in temporal.assign_projects(files.select("relative_path"), projects, root=True).collect()}
    assert got == {"p/a.py": "p", "p/sub/b.py": "p/sub", "q/c.md": "q", "loose.py": None}
    with_root = projects.union(spark.createDataFrame([("",)], "relative_path string"))
    assert temporal.assign_projects(files.select("relative_path"), with_root, root=True).where("project = ''").count() == 1
    assert temporal.assign_projects(files.select("relative_path"), with_root, root=False).where("project = ''").count() == 0
    edges = temporal.shared_extension_edges(files, projects, 0.2).collect()
    assert [(r["source"], r["target"], r["similarity"]) for r in edges] == [("p", "p/sub", 1.0)]


def test_chain_breaks(spark):
    links = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "x", "d")], "ordinal int, baseline string, current string")
    assert [(r["ordinal"], r["expected"]) for r in temporal.chain_breaks(links).collect()] == [(2, "c")]


def test_changes_in_unknown_directories_raise(spark):
    changes = spark.createDataFrame([("a/b/x", "ADDED", "OBSERVED_CURRENT", None, 1)], "relative_path string, change_type string, confidence string, before_logical_bytes long, after_logical_bytes long")
    known = spark.createDataFrame([("a",)], "relative_path string")
    with pytest.raises(Exception, match="unknown directory: a/b"):
        temporal.directory_changes(changes, known).collect()


def test_extensions_fold_like_names(spark):
    files = spark.createDataFrame([("p/a.stra\u00dfe", "FILE", "OBSERVED", ".stra\u00dfe"), ("q/b.STRASSE", "FILE", "OBSERVED", ".STRASSE")], "relative_path string, entry_type string, observation_status string, extension string")
    projects = spark.createDataFrame([("p",), ("q",)], "relative_path string")
    assert [tuple(r)[:3] for r in temporal.shared_extension_edges(files, projects, 0.9).collect()] == [("p", "q", 1)]
