"""Whole lines of the operators behind ``pipe_row`` and ``stats_string``."""

import json

from pyspark.sql import functions as F

from geostrata.functions import codec
from geostrata.operators import aggregate, export
from geostrata.plans import catalog, features
from geostrata.sources.geojson import feature_json

SF = "/root/testdata/sf0.001"


def test_whole_lines(spark):
    p = features.points(spark, SF).limit(20)
    rows = {r["id"]: r for r in p.select("*", feature_json().alias("text")).collect()}
    lines = {r["id"]: r["line"].split("|") for r in export.pipe_rows(p, ["name", "missing"], ("id",)).collect()}
    stats = {r["id"]: r["line"] for r in aggregate.stats_string(p).collect()}
    assert set(lines) == set(stats) == set(rows)
    for i, r in rows.items():
        x, y = r["coords"][0][0][0]
        name, missing, bounds, kind, geometry = lines[i]
        assert (name, missing, kind) == (r["properties"]["name"]["s"], "", "Point")
        assert bounds == "%f,%f,%f,%f" % (x, y, x, y) and json.loads(geometry) == {"type": "Point", "coordinates": [x, y]}
        f = {k: r[k] for k in ("id", "geom_type", "dims", "coords")} | {"properties": {k: v.asDict() for k, v in r["properties"].items()}}
        assert stats[i] == f"Point,1,3,{len(r['text'].encode())},{len(codec.encode(f))}"


def test_queries_call_the_operators(spark, monkeypatch):
    called = []
    for where, name in ((export, "pipe_rows"), (aggregate, "stats_string")):
        real = getattr(where, name)
        monkeypatch.setattr(where, name, lambda *a, real=real, name=name: called.append(name) or real(*a))
    catalog.QUERIES["pipe_row"](spark, SF)
    catalog.QUERIES["stats_string"](spark, SF)
    assert called == ["pipe_rows", "stats_string"]


def test_statistics_are_taken_by_many_tasks(spark):
    """However few splits the input has; each feature once."""
    p = features.points(spark, SF).coalesce(1)
    got = aggregate.stats_timed(p).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > spark.sparkContext.defaultParallelism
    want = {r["id"]: tuple(r)[1:] for r in aggregate.stats(p).collect()}
    assert {r["id"]: (r["type"], r["verticies"], r["number_properties"], r["size_json"], r["size_buf"]) for r in got} == want
    assert len(got) == len(want) and all(r[f"time_{x}"] > 0 for r in got for x in ("read_json", "write_json", "read_buf", "write_buf"))
