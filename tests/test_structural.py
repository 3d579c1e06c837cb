"""The fixture corpus: roles, aggregates, projects, ranking, against rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import ranking, structural
from treeline.sources import sample

CORPUS = {
    "project/pyproject.toml": (25, "R210"),
    "project/src/main.py": (17, "R220"),
    "project/src/deep/one/two/three/config.json": (3, "R230"),
    "project/.cache/item.bin": (5, "R120"),
    "project/build/output.dat": (5, "R130"),
    "project/.venv/lib/site-packages/dependency.py": (4, "R110"),
    "media/final exports/render.wav": (4, "R310"),
    "media/final exports/other.wav": (4, "R310"),
    "unicode/café.txt": (3, "R999"),
    "unicode/café.txt": (3, "R999"),
    "=formula.txt": (0, "R999"),
    "+plus.txt": (0, "R999"),
    "-minus.txt": (0, "R999"),
    "@at.txt": (0, "R999"),
    "spaces & punctuation !.txt": (0, "R999"),
}


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [(p, n) for p, (n, _) in CORPUS.items()]
    files = spark.createDataFrame(rows, "relative_path string, logical_bytes long")
    files = files.withColumns({"parent_path": paths.parent("relative_path"), "name": paths.name("relative_path")}).withColumn("extension", paths.suffix("name"))
    dirs = sample.directories(files).unionByName(spark.createDataFrame([("empty directory",)], "relative_path string"))
    roles = structural.classify_roles(files)
    return {"files": files, "dirs": dirs, "roles": roles, "agg": structural.directory_aggregates(roles, dirs), "projects": structural.projects(files)}


def test_roles(inventory):
    assert {r["relative_path"]: r["rule_id"] for r in inventory["roles"].collect()} == {p: rule for p, (_, rule) in CORPUS.items()}


def test_aggregates(inventory):
    got = {r["relative_path"]: r for r in inventory["agg"].collect()}
    assert len(got) == 16
    assert (got[""]["recursive_bytes"], got[""]["file_count"], got[""]["directory_count"]) == (73, 15, 15)
    assert (got["project"]["recursive_bytes"], got["project"]["file_count"]) == (59, 6)
    assert math.isclose(got["project"]["role_coherence"], 0.0, abs_tol=1e-12)
    assert got["media"]["role_coherence"] == 1.0
    assert {p: got[p]["recursive_bytes"] for p in ("project/src", "project/src/deep", "project/.venv", "media", "unicode", "empty directory")} == {
        "project/src": 20, "project/src/deep": 3, "project/.venv": 4, "media": 8, "unicode": 6, "empty directory": 0,
    }
    assert got["empty directory"]["role_coherence"] == 0.0


def test_projects_and_relations(inventory):
    assert [tuple(r) for r in inventory["projects"].collect()] == [("project", 5, ["pyproject.toml"])]
    rel = structural.relationships(inventory["projects"], inventory["agg"]).collect()
    assert len(rel) == 6 and {r["relationship"] for r in rel} == {"HAS_ROLE"}


def test_ranking(inventory):
    features = ranking.directory_features(inventory["agg"], inventory["projects"])
    assert features.count() == 15
    assert features.select("cohort").distinct().count() == 7
    assert ranking.objective_intervals(features).count() == 60
    ranks = ranking.pareto_ranks(features)
    queue = ranking.review_queue(features, ranks, 5).collect()
    assert [r["review_order"] for r in queue] == [1, 2, 3, 4, 5]
    assert queue == sorted(queue, key=lambda r: (-r["priority"], r["relative_path"]))
    with pytest.raises(ValueError):
        ranking.review_queue(features, ranks, 1001)


def test_chain_ranks_equal_peeling():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(60):
        low = rng.integers(0, 4, (12, 2)).astype(float)
        high = low + rng.integers(0, 2, (12, 2))
        left, want, rank = set(range(12)), np.zeros(12, int), 0
        while left:
            front = {i for i in left if not any((high[j] <= low[i]).all() and (high[j] < low[i]).any() for j in left if j != i)}
            for i in front:
                want[i] = rank
            left, rank = left - front, rank + 1
        assert ranking.chain_ranks(low, high).tolist() == want.tolist()


def test_paths(spark):
    names = [".bashrc", "foo.", "a.tar.gz", "..foo", "x.py", "noext"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(paths.suffix("n")).collect()] == ["", "", ".gz", ".foo", ".py", ""]
    one = spark.createDataFrame([("a/b/c", "./a//b/"), ("", "x"), ("a", "y")], "p string, q string")
    got = one.select(paths.ancestors("p").alias("u"), paths.ancestors("p", itself=True).alias("s"), paths.parent("p").alias("up"), paths.normalise("q").alias("q")).collect()
    assert [r["u"] for r in got] == [["", "a", "a/b"], [""], [""]]
    assert [r["s"] for r in got] == [["", "a", "a/b", "a/b/c"], [""], ["", "a"]]
    assert [r["up"] for r in got] == ["a/b", None, None]
    assert got[0]["q"] == "a/b"
    bad = spark.createDataFrame([("a/../b",)], "q string")
    with pytest.raises(Exception, match="escapes"):
        bad.select(paths.normalise("q")).collect()
    both = spark.createDataFrame([("Straße", "é")], "a string, b string").select(paths.casefold("a"), paths.nfc("b")).first()
    assert tuple(both) == ("strasse", "é")


def test_rollup_root_is_total(spark):
    files = sample.files(spark, "/root/testdata/sf0.001")
    roles = structural.classify_roles(files)
    root = structural.role_counts(roles).where("relative_path = ''").agg(F.sum("bytes"), F.sum("n")).first()
    assert tuple(root) == tuple(files.agg(F.sum("logical_bytes"), F.count(F.lit(1))).first())


def test_roles_read_both_slashes(spark):
    rows = [("build\\x.py", "x.py", ".py"), ("a/build/", "build", ""), ("a//build/x.py", "x.py", ".py"), ("build", "build", "")]
    got = structural.classify_roles(spark.createDataFrame(rows, "relative_path string, name string, extension string")).collect()
    assert [r["rule_id"] for r in got] == ["R130", "R999", "R130", "R999"]
