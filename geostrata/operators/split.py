"""Splitting by key, sub-file indexes, tile partitions and lookups.

A split is one shuffle on the key; a range partitioning keeps keys together and
spreads a hot key over several tasks (AQE splits skewed joins; a write of a hot
key is spread by ``salt``).  No pass is repeated for coarse tiles first: Spark
has no limit of open files per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import properties as P
from ..functions import tiles as T
from . import aggregate as A


def split_map(rows: DataFrame, keys: Column, name: str = "key") -> DataFrame:
    """A row for every key of an array; rows without keys are dropped."""
    return rows.withColumn(name, F.explode(keys))


def add_features(rows: DataFrame) -> DataFrame:
    """Count and bounds by key, as features are added."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *bounds())


def bounds(col: str = "bbox") -> list[Column]:
    """Aggregates of the union of rectangles."""
    return [F.min(f"{col}.w").alias("w"), F.min(f"{col}.s").alias("s"), F.max(f"{col}.e").alias("e"), F.max(f"{col}.n").alias("north")]


def subfile_index(rows: DataFrame, size: Column) -> DataFrame:
    """Byte range of every key if keys are laid out in order."""
    per = rows.groupBy("key").agg(F.sum(size).cast("long").alias("size"), F.count(F.lit(1)).alias("n"), *bounds())
    return A.running_total(per, ["key"], "size", "end").withColumn("start", F.col("end") - F.col("size")).select("key", "start", "end", "size", "n", "w", "s", "e", "north")


def combine_nested(indexes: list[DataFrame]) -> DataFrame:
    """Several files' indexes as that of their concatenation, in order."""
    union = None
    for k, df in enumerate(indexes):
        df = df.withColumn("file", F.lit(k))
        union = df if union is None else union.unionByName(df)
    return A.running_total(union, ["file", "start"], "size", "end").withColumn("start", F.col("end") - F.col("size"))


def write_split(rows: DataFrame, path: str, partitions: int | None = None, salt: int = 1) -> None:
    """Rows with a ``key`` as a packed folder whose index has a range per key."""
    by = [F.col("key")] + ([F.pmod(F.xxhash64("id"), F.lit(salt))] if salt > 1 else [])
    args = [partitions, *by] if partitions else by
    rows.repartition(*args).sortWithinPartitions("key").write.format("packedfeature").mode("overwrite").save(path)


def write_combined(rows: DataFrame, path: str) -> None:
    """Rows with a ``key`` as one stream in the order of keys, in as many files as
    there are range partitions; ``scan.index`` with ``joined`` has its positions."""
    rows.repartitionByRange("key").sortWithinPartitions("key").write.format("packedfeature").mode("overwrite").save(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Rows with a ``key`` as a Parquet table partitioned by it."""
    rows.repartition("key").write.mode("overwrite").partitionBy("key").parquet(path)


def read_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The features of one key, by byte ranges; empty for an unknown key."""
    from .scan import scan

    return scan(spark, path, key=key)


def tile_map(rows: DataFrame, zoom: int, bounds: Column | None = None, cover: Callable[[int], Column] | None = None, coarse: int | None = None) -> DataFrame:
    """Features by tile: those that meet the bounds, a row for every tile they
    cover, the tile kept as property ``TILEID`` and as ``tile`` and ``key``.

    coarse: a zoom to roll tiles up to for the key.
    """
    if bounds is not None:
        rows = rows.where(G.bbox_intersect("bbox", bounds))
    tiles = cover(zoom) if cover else T.tile_cover("geom_type", "coords", zoom)
    rows = rows.withColumn("tile", F.explode(tiles))
    rows = rows.withColumn("properties", P.map_set("properties", "TILEID", P.text(T.tile_str("tile"))))
    at = T.tile_at("tile", coarse) if coarse is not None else F.col("tile")
    return rows.withColumn("key", T.tile_str(at))


def rolled_up(rows: DataFrame, zoom: int, tile: str = "tile") -> tuple[DataFrame, DataFrame]:
    """Rows by their ancestor tile at a zoom, and the rows that are coarser."""
    up = rows.withColumn("at", T.tile_at(tile, zoom))
    return up.where("at is not null").withColumn("key", T.tile_str("at")).drop("at"), up.where("at is null").drop("at")
