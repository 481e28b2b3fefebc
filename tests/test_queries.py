"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.core.QUERIES)))
def test_query(spark, name):
    df = entry.queries()[name](spark, D)
    got = rows_of(df.columns, df.collect())
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 10


ODD = [(1, "x" * 500 + " "), (2, ""), (3, ""), (4, ""), (5, None), (6, "ab"), (7, "a" * 499 + " " * 501 + "b"), (8, None), (9, "cd"), (10, "ef")]


@pytest.mark.parametrize("name", ["reconstruct_text", "change_detection"])
def test_blank_chunks_and_empty_texts(spark, tmp_path, name):
    """A last chunk of one blank, a blank chunk in the middle, empty and null texts: known ones, changed ones and new ones."""
    d = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "src1", 0) for k, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in (2, 3, 5, 6, 8, 9)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    df = entry.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
