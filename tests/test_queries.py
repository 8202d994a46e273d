"""Every registered catalog query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumicat.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "documents labels embeddings events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in Q.ORACLES:
        assert rows
        return
    want = duck.sql(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    by = [want.columns.index(c) for c in sorted(want.columns)]
    a = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in rows), key=repr)
    b = sorted((tuple(plain(r[i]) for i in by) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def held_against_sql(spark, name, folder, rows=None):
    """Holds a query against its SQL over the folder, whose documents are made of rows (doc_id, text, source), if given."""
    c = duckdb.connect()
    if rows is not None:
        c.execute("CREATE TABLE made (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        c.executemany("INSERT INTO made VALUES (?, ?, 'en', ?, 1)", rows)
        c.execute(f"COPY made TO '{folder}/documents.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for t in ("labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, str(folder))
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


MORE = "/root/testdata/sf0.01"
#: Document 3 is a copy of 0, so that the moved 5 has no path; 7 has the same text.
PATHLESS = [(0, "a", "s"), (3, "a", "s"), (5, "b", "s"), (7, "b", "s"), (8, "c", None), (11, "c", "s"), (12, "a", None)]


def test_catalog_after_upsert_without_paths(spark, tmp_path):
    held_against_sql(spark, "catalog_after_upsert", tmp_path, PATHLESS)


def test_upsert_outcomes_without_times(spark, tmp_path):
    held_against_sql(spark, "upsert_outcomes", tmp_path, [*PATHLESS, (13, "f", None), (14, None, None), (None, "d", "s"), (None, "e", None)])


def test_upsert_outcomes_at_a_hundredth(spark):
    held_against_sql(spark, "upsert_outcomes", MORE)


def test_upsert_outcomes_of_repeated_ids(spark, tmp_path):
    held_against_sql(spark, "upsert_outcomes", tmp_path, [(3, "a", "s"), (3, "b", "s"), (3, "c", "t"), (5, "d", "s"), (5, "e", "s"), (51, "f", "t"), (51, "g", None)])


def test_catalog_after_upsert_at_a_hundredth(spark):
    held_against_sql(spark, "catalog_after_upsert", MORE)


def test_catalog_after_upsert_of_copies_without_paths(spark, tmp_path):
    """The SQL leaves open which of such copies is the old one: here the least doc_id, as in the SQL over a small table in that order."""
    rows = [(0, "a", None), (3, "a", None), (6, "b", None), (51, "b", None), (102, "c", None), (105, "c", None)]
    held_against_sql(spark, "catalog_after_upsert", tmp_path, rows)
    (tmp_path / "documents.parquet").unlink()
    spark.createDataFrame([(i, t, "en", None, 1) for i, t, _ in reversed(rows)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["catalog_after_upsert"](spark, str(tmp_path)).collect()
    assert sorted((r[2] for r in got), key=repr) == [1790000000, 1790000000, None]
