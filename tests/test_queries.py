"""Every query of the feature engine against its SQL in DuckDB."""

import duckdb
import pytest

from geostrata.plans import catalog
from geostrata.sources.packed import list_files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(str).to_numpy().tolist())), list(df.columns)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(catalog.SQL[name]).df())


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "key" in df.columns


def test_packed_copies_are_made_by_many_tasks(spark, db, monkeypatch):
    """No step gathers a whole view, and positions don't depend on the number of files."""
    monkeypatch.setattr(catalog, "_copies", {})
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(list_files(catalog.packed_copy(spark, SF))) == 4 == len(list_files(catalog.packed_copy(spark, SF, "polygons")))
        for name in ("scan_bytes_pos", "scan_feature_pos", "seek_pos", "read_range_raw", "read_range_feature", "read_range_framed", "meta_read", "meta_shift", "file_size"):
            assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(catalog.SQL[name]).df()), name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
