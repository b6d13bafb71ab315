"""The operators' columns that SQL can express, against DuckDB."""

import duckdb
import pytest

from geostrata.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["quality_base", "pii_counts", "mix_targets", "op9_exact_dedup"])
def test_part(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)
