"""Registered queries against their SQL, on tables where they once differed from it."""

import ast
import random
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

from treeline.operators import frontier, hashtree, textindex, view
from treeline.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def by_sql(folder, name: str, *tables: str) -> Counter:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if Path(f'{folder}/{t}.parquet').is_dir() else ''}')")
    return Counter(tuple(r) for r in con.execute(registry.ORACLES[name]).fetchall())


def by_query(spark, folder, name: str) -> Counter:
    return Counter(tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect())


def test_no_function_of_the_registry_hides_another():
    names = [n.name for n in ast.parse(Path(registry.__file__).read_text()).body if isinstance(n, ast.FunctionDef)]
    assert [n for n, k in Counter(names).items() if k > 1] == []


def test_session_report_equals_its_sql(spark):
    got = by_query(spark, SF, "session_report")
    assert got == by_sql(SF, "session_report", "events") and sum(got.values()) > 1


def test_latest_session_equals_its_sql(spark):
    assert by_query(spark, SF, "latest_session") == by_sql(SF, "latest_session", "events")


def documents(tmp_path, first: int, count: int):
    """A folder with ``documents`` of ids from ``first`` and no text, in the order of their ids."""
    duckdb.connect().execute(f"COPY (SELECT i AS doc_id, '' AS text, ['de', 'en', 'es', 'fr'][1 + i % 4] AS lang, 'src' || i % 20 AS source, i % 900 AS n_chars FROM range({first}, {first + count}) r(i) ORDER BY 1) TO '{tmp_path}/documents.parquet'")
    return tmp_path


def test_escaped_search_takes_the_rows_that_its_sql_takes(spark, tmp_path):
    folder = documents(tmp_path, 99_900, 1200)
    got = by_query(spark, folder, "search_escaped")
    assert got == by_sql(folder, "search_escaped", "documents") and sum(got.values()) == 200


def test_search_for_several_texts_shows_each_item_once(spark):
    items = spark.createDataFrame([("file", "a%/c_100"), ("file", "b%"), ("directory", "C_100"), ("file", "c-100"), ("file", None)], "kind string, relative_path string")
    assert [r["relative_path"] for r in view.search(items, ("%", "c_100")).collect()] == ["a%/c_100", "b%", "C_100"]
    assert view.search(items, ("%", "c_100"), limit=2).count() == 2 and view.search(items, ()).count() == 0 and view.search(items, ("", "%")).count() == 5
    assert [r["relative_path"] for r in view.search(items, ("%", "c_100"), order=("kind", "relative_path")).collect()] == ["C_100", "a%/c_100", "b%"]


def test_hash_tree_equals_its_sql_above_four_levels(spark, tmp_path):
    folder = documents(tmp_path, 0, 66_000)
    got = by_query(spark, folder, "snapshot_hash_tree")
    assert got == by_sql(folder, "snapshot_hash_tree", "documents") and sum(r[0] == 3 for r in got) == 2
    whole = hashtree.hash_tree(registry._tree_rows(spark, str(folder)), ["relative_path"], 16)
    assert [(r["level"], r["rows"]) for r in whole.where("level > 3").collect()] == [(4, 66_660)]


def test_search_batch_does_not_pair_terms_with_all_texts_of_their_pieces(spark, monkeypatch):
    """All texts have all pieces, and each is in itself alone: rows of the joins by term are counted."""
    frame, joined = type(spark.range(1)), []
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **k: joined.append(join(self, *a, **k)) or joined[-1])
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab") for _ in range(24)) for _ in range(120)})
    items = spark.createDataFrame([("file", f"{n}/x") for n in names], "kind string, relative_path string")
    got = textindex.search_batch(items, spark.createDataFrame([(n,) for n in names], "query string")).collect()
    assert sorted((r["query"], r["relative_path"], r["matches"]) for r in got) == [(n, f"{n}/x", 1) for n in names]
    monkeypatch.undo()
    assert max(df.count() for df in joined if "term" in df.columns and "texts" not in df.columns) <= 2 * len(names)


def test_plain_candidates_are_settled_as_columns_like_the_others(spark):
    kinds = [(p, e, o, c, g) for p in (0, 1) for e in (0, 1) for o in (False, True) for c in (0, 2) for g in (False, True) if c or not (o or g)]
    rows = [(f"t/{i}", "t", "t", 10, 2, e, p, 0.5, 0.25, c, 0, g, o) for i, (p, e, o, c, g) in enumerate(kinds)]
    nodes = spark.createDataFrame(rows, "node string, parent string, top string, recursive_bytes long, file_count long, eligible int, protected int, preservation_risk double, incoherence double, children long, open long, any_guarded boolean, any_over boolean").withColumn("plain", frontier._plain(1000))
    plain = nodes.where("plain")
    assert {r["node"] for r in nodes.where("NOT plain").collect()} == {f"t/{i}" for i, (p, e, o, c, g) in enumerate(kinds) if e and not p and not o and not g}
    below = pd.DataFrame(columns=["node", "sums", "archives", "defers"])
    for limit in (1, 5000):
        got = sorted(map(repr, (r.asDict() for r in frontier._plain_states(plain, limit).collect())))
        both = plain.toPandas()
        # Children without a choice of their own are not handed on: their one state adds nothing.
        want = [x for i in range(len(both)) for x in _solved(both.iloc[i : i + 1], below, limit)]
        assert got == sorted(map(repr, want)) and len(got) > len(both)


def _solved(here, below, limit):
    out = frontier._solve_node(here, below, 1000, limit).to_dict("records")
    return [r | {"guarded": bool(r["guarded"]), "over": bool(r["over"])} for r in out]
