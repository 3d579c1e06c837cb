"""The folder scan, SQLite and manifest readers, the decision stream."""

import json
import os
import sqlite3

import pytest
from pyarrow.fs import LocalFileSystem

from treeline.operators import evidence, lineage
from treeline.sources import filesystem, inventory
from treeline.streaming import decisions


def test_scan(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.tar.gz").write_bytes(b"12345")
    (tmp_path / ".hidden").write_text("")
    os.symlink(tmp_path / "a", tmp_path / "link")
    got = {r["relative_path"]: r for r in filesystem.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "a/b", "a/b/x.tar.gz", ".hidden", "link"}
    assert (got["a/b/x.tar.gz"]["logical_bytes"], got["a/b/x.tar.gz"]["extension"], got["a/b/x.tar.gz"]["depth"]) == (5, ".gz", 3)
    assert (got["link"]["entry_type"], got["a"]["entry_type"], got["a"]["parent_path"], got[".hidden"]["extension"]) == ("SYMLINK_DIRECTORY", "DIRECTORY", None, "")
    with pytest.raises(Exception, match="folder"):
        filesystem.scan(spark, str(tmp_path / "none")).collect()
    assert filesystem.scale_corpus(spark, 10, 3).orderBy("relative_path").collect()[4]["relative_path"] == "shard-0001/item-000000000004.dat"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "i.db")
    db = sqlite3.connect(path)
    db.execute(f"PRAGMA application_id = {inventory.INVENTORY_ID}")
    db.execute("CREATE TABLE files (relative_path TEXT, logical_bytes INTEGER)")
    db.executemany("INSERT INTO files VALUES (?, ?)", [("a", 1), ("b", None)])
    db.execute("CREATE TABLE scan_sessions (scan_session_id TEXT, state TEXT, finished_at TEXT)")
    db.executemany("INSERT INTO scan_sessions VALUES (?, ?, ?)", [("s1", "COMPLETE", "1"), ("s2", "COMPLETE", "2"), ("s3", "STOPPED", "3")])
    db.commit()
    db.close()
    schema = "relative_path string, logical_bytes long"
    assert sorted(map(tuple, inventory.read_sqlite(spark, path, "files", schema).collect())) == [("a", 1), ("b", None)]
    assert inventory.read_sqlite(spark, path, "files", schema, folder=f"file://{tmp_path}/out").count() == 2
    assert inventory.latest_session(path) == "s2"
    with pytest.raises(ValueError, match="type"):
        inventory.read_sqlite(spark, path, "files", schema, application_id=1)


def test_manifests(spark, tmp_path):
    good = tmp_path / "m.json"
    good.write_bytes(lineage.canonical({"a": 1, "b": [2]}) + b"\n")
    assert inventory.read_manifest(str(good), {"a", "b"}) == {"a": 1, "b": [2]}
    with pytest.raises(ValueError):
        inventory.read_manifest(str(good), {"a"})
    good.write_text(json.dumps({"a": 1, "b": [2]}))
    with pytest.raises(ValueError, match="canonical"):
        inventory.read_manifest(str(good), {"a", "b"})
    one = {"evidence_id": "e1", "source_project": "p", "target_project": "q", "relationship_type": "DEPENDS_ON", "confidence": 0.9, "evidence_reference": "r"}
    assert inventory.relations(spark, [one], ["p", "q"]).first()["directed"] == 1
    for bad in (one | {"confidence": 2}, one | {"target_project": "p"}, one | {"relationship_type": "X"}, one | {"relationship_type": "SHARES_ASSETS_WITH", "source_project": "q", "target_project": "p"}):
        with pytest.raises(ValueError):
            inventory.relations(spark, [bad], ["p", "q"])


def test_decision_stream(spark, tmp_path):
    log, table, check = (f"{tmp_path}/{n}" for n in ("log", "table", "check"))
    os.mkdir(log)

    def add(name, *rows):
        with open(f"{log}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("session", "relative_path", "decision", "revision", "recorded_at"), r, strict=True))) + "\n" for r in rows)
        decisions.maintain(decisions.read_log(spark, log), table, check).awaitTermination()

    add("1", ("s", "a", "KEEP", 1, "2024-01-01T00:00:00Z"), ("s", "b", "PROTECT", 1, "2024-01-01T00:00:01Z"))
    add("2", ("s", "a", "KEEP", 1, "2024-01-01T00:00:00Z"), ("s", "a", "ARCHIVE_ELIGIBLE", 2, "2024-01-02T00:00:00Z"))
    got = {(r["relative_path"], r["decision"], r["revision"]) for r in decisions.latest(spark, table).collect()}
    assert got == {("a", "ARCHIVE_ELIGIBLE", 2), ("b", "PROTECT", 1)}


def test_export(spark, tmp_path):
    one = spark.createDataFrame([("b",), ("a",)], "relative_path string")
    events = spark.createDataFrame([(1, "STOP\"PED", '{"x":1}')], "event_id long, event_type string, detail_json string")
    none = spark.createDataFrame([], "relative_path string, operation string")
    path = str(tmp_path / "out.ndjson")
    digest, n = lineage.write_export(lineage.export_lines(one, one, none, events), path)
    lines = [json.loads(x) for x in open(path)]
    assert n == 6 and len(digest) == 64 and [x["record_type"] for x in lines] == ["session", "directory", "directory", "file", "file", "event"]
    assert lines[1]["relative_path"] == "a" and lines[-1] == {"detail": {"x": 1}, "event_type": 'STOP"PED', "record_type": "event"}
    with pytest.raises(FileExistsError):
        lineage.write_export(lineage.export_lines(one, one, none, events), path)


@pytest.mark.parametrize("level", ["D2", "D4"])
def test_selected_files_are_hashed_in_ranges(spark, tmp_path, level):
    top = tmp_path / "data" / "data dir"
    (top / "sub é").mkdir(parents=True)
    sizes = {"empty": 0, "small": 10, "one": 1000, "over": 1001, "two": 1999, "sub é/large 1%": 250_000, "left out": 5}
    for i, (name, n) in enumerate(sizes.items()):
        (top / name).write_bytes(bytes((i + j * 7) % 251 for j in range(n)))
    rows = [(n, s, (top / n).stat().st_mtime_ns) for n, s in sizes.items() if n != "left out"]
    rows += [("gone", 3, None), ("left out", 6, None), (None, 1, None), ("small", None, None), ("one", 1000, 5)]
    files = spark.createDataFrame(rows, "relative_path string, logical_bytes long, modified_ns long")
    content = spark.createDataFrame([(n, bytearray((top / n).read_bytes())) for n in sizes if n != "left out"], "relative_path string, content binary")
    want = {tuple(r) for r in evidence.hash_content(content, level, sample=1000).collect()}
    # The folder's name is in the path twice, and is named in other ways than the listing's.
    for folder in (str(top), f"{tmp_path}/data/../data/data dir/", f"./{os.path.relpath(top)}"):
        found, errors = evidence.hash_selected(files, folder, level, sample=1000)
        assert {tuple(r) for r in found.collect()} == want
        assert sorted(tuple(r) for r in errors.collect()) == [("gone", "MISSING"), ("left out", "CHANGED"), ("one", "CHANGED"), ("small", "CHANGED")]
        read, missed = evidence.read_selected(files, folder)
        assert {r["relative_path"] for r in read.collect()} == {r[0] for r in want} and missed.count() == 4
    with pytest.raises(Exception, match="escapes"):
        evidence.hash_selected(spark.createDataFrame([("../x", 1, None)], files.schema), str(top), level)
    most = {r[0]: r[5] for r in want}
    assert most["sub é/large 1%"] == (3000 if level == "D2" else 250_000)
    assert [x.count() for x in evidence.hash_selected(files.limit(0), str(top), level)] == [0, 0]


def test_files_that_change_while_they_are_read(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"x" * 5000)

    class Touching(LocalFileSystem):
        """Writes to the file once it is open."""

        def open_input_file(self, name):
            f = super().open_input_file(name)
            os.utime(name, ns=(1, 1))
            return f

    for sample in (None, 100):
        os.utime(path, ns=(10**18, 10**18))
        assert evidence.hash_file(LocalFileSystem(), str(path), 5000, None, sample)[0] is None
        assert evidence.hash_file(Touching(), str(path), 5000, None, sample)[0] == "CHANGED"
        assert evidence.hash_file(LocalFileSystem(), str(path), 4999, None, sample)[0] == "CHANGED"
        assert evidence.hash_file(LocalFileSystem(), str(tmp_path / "none"), 1, None, sample)[0] == "MISSING"
        assert evidence.hash_file(LocalFileSystem(), str(tmp_path), 1, None, sample)[0] == "UNREADABLE"
