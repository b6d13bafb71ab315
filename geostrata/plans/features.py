"""Feature tables over the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import properties as P
from ..schema import BBOX, FEATURE_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(k: str) -> Column:
    return F.expr(f"(({k} * 7919) % 3600000) / 10000.0D - 180")


def lat(k: str) -> Column:
    return F.expr(f"(({k} * 104729) % 1700000) / 10000.0D - 85")


def finish(df: DataFrame, kind: str, coords: Column, **props: Column) -> DataFrame:
    """Feature rows from rows with an ``id``."""
    df = df.select(F.col("id").cast("long").alias("id"), (P.make(**props) if props else P.empty()).alias("properties"), F.lit(kind).alias("geom_type"), coords.alias("coords"))
    df = df.withColumn("dims", G.dims("coords")).withColumn("bbox", G.bbox("coords").cast(BBOX))
    return df.select(*FEATURE_COLUMNS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    coords = F.array(F.array(F.array(F.array(lon("id"), lat("id")))))
    return finish(c, "Point", coords, name=P.text("c_name"), acctbal=P.number("c_acctbal"), segment=P.text("c_mktsegment"))


_PAIRS = "transform(sequence({a}, {b}), i -> array(CAST(embedding[2 * i] AS DOUBLE) * 180, CAST(embedding[2 * i + 1] AS DOUBLE) * 85))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines of 32 positions."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return finish(e, "LineString", F.array(F.array(F.expr(_PAIRS.format(a=0, b=31)))), label=P.value(F.col("label").cast("long"), 4))


def multilines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return finish(e, "MultiLineString", F.array(F.array(F.expr(_PAIRS.format(a=0, b=15)), F.expr(_PAIRS.format(a=16, b=31)))))


def multipoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderkey", F.array(lon("o_orderkey"), lat("o_orderkey")).alias("p")).alias("x"))
    o = o.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return finish(o, "MultiPoint", F.array(F.array(F.transform("xs", lambda x: x["p"]))))


def _square(shift: float) -> Column:
    cx = F.expr(f"((id * 7919) % 3560000) / 10000.0D - 178 + {shift}D")
    cy = F.expr(f"((id * 104729) % 1600000) / 10000.0D - 80 + {shift}D")
    h = F.col("p_size") / F.lit(100.0)
    return F.array(F.array(cx - h, cy - h), F.array(cx + h, cy - h), F.array(cx + h, cy + h), F.array(cx - h, cy + h), F.array(cx - h, cy - h))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as squares."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return finish(p, "Polygon", F.array(F.array(_square(0.0))), brand=P.text("p_brand"))


def multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return finish(p, "MultiPolygon", F.array(F.array(_square(0.0)), F.array(_square(1.0))))


ALL = {"points": points, "lines": lines, "multilines": multilines, "multipoints": multipoints, "polygons": polygons, "multipolygons": multipolygons}

# The same tables for DuckDB: one row per position.
SQL = {
    "pt": "pt AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, ((c_custkey * 7919) % 3600000) / 10000.0::DOUBLE - 180 AS lon, ((c_custkey * 104729) % 1700000) / 10000.0::DOUBLE - 85 AS lat FROM customer)",
    "ln": "ln AS (SELECT vec_id AS id, label, i, i // 16 AS part, embedding[2 * i + 1]::DOUBLE * 180 AS lon, embedding[2 * i + 2]::DOUBLE * 85 AS lat FROM embeddings, range(32) AS t(i))",
    "mp": "mp AS (SELECT o_custkey AS id, o_orderkey AS i, ((o_orderkey * 7919) % 3600000) / 10000.0::DOUBLE - 180 AS lon, ((o_orderkey * 104729) % 1700000) / 10000.0::DOUBLE - 85 AS lat FROM orders)",
    "po": "sq AS (SELECT p_partkey AS id, p_brand AS brand, s, ((p_partkey * 7919) % 3560000) / 10000.0::DOUBLE - 178 + s AS cx, ((p_partkey * 104729) % 1600000) / 10000.0::DOUBLE - 80 + s AS cy, p_size / 100.0::DOUBLE AS h FROM part, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS v(s)), mo AS (SELECT id, brand, s, i, CASE WHEN i IN (1, 2) THEN cx + h ELSE cx - h END AS lon, CASE WHEN i IN (2, 3) THEN cy + h ELSE cy - h END AS lat FROM sq, range(5) AS t(i)), po AS (SELECT * FROM mo WHERE s = 0)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
