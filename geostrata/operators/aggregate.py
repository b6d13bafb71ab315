"""Whole-table facts: keys, bounds, counts and per-feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import properties as P
from ..session import kept

RESERVED = ("Bounds", "Type", "Geometry")


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the running sum of a column in the given order, and no pass in
    one task: a range partitioning (kept, as its bounds are sampled), sums within
    partitions, and the few partitions' totals before each."""
    parts = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).drop("_total")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn(name, within).join(F.broadcast(before), "_part")  # one row a partition
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def key_union(rows: DataFrame, order: str) -> DataFrame:
    """``(key, first)``: distinct property keys and where each is first seen,
    then the reserved ones (NULL)."""
    keys = rows.select(F.explode(F.map_keys("properties")).alias("key"), F.col(order).alias("o")).groupBy("key").agg(F.min("o").alias("first"))
    spark = rows.sparkSession
    return keys.unionByName(spark.createDataFrame([(k, None) for k in RESERVED], f"key string, first {dict(keys.dtypes)['first']}"))


def dataset_bounds(rows: DataFrame, col: str = "bbox") -> DataFrame:
    """The extent of all rows."""
    return rows.agg(F.min(f"{col}.w").alias("w"), F.min(f"{col}.s").alias("s"), F.max(f"{col}.e").alias("e"), F.max(f"{col}.n").alias("north"))


def progress(rows: DataFrame, every: int, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``rows`` unchanged, and what is observed as an action passes them: their
    number and how many full steps of ``every`` rows that is.  No pass is added, and
    nothing is logged row by row."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), F.floor(F.count(F.lit(1)) / every).alias("steps")), seen


def packed_size() -> Column:
    """Payload bytes of a feature row, by arithmetic alone."""
    v = G.varint_size
    ident = F.when(F.col("id").isNotNull(), 1 + v("id")).otherwise(0)
    nested = G.nested_size

    def prop(e: Column) -> Column:
        x = e["value"]
        s = F.octet_length(F.coalesce(x["s"], F.lit("")))
        body = (
            F.when(x["tag"] == 1, nested(s)).when(x["tag"] == 2, F.lit(5)).when(x["tag"] == 3, F.lit(9)).when(x["tag"] == 7, F.lit(2))
            .when(x["tag"] == 4, 1 + v(x["i"])).otherwise(1 + F.lit(0) + _unsigned_size(x["u"]))
        )
        return nested(nested(F.octet_length(e["key"])) + nested(body))

    props = F.aggregate(F.map_entries("properties"), F.lit(0), lambda a, e: a + prop(e))
    two = lambda p: F.aggregate(p, F.lit(0), lambda a, line: a + G.line_size(line, 2))
    rings = lambda p: F.aggregate(p, F.lit(0), lambda a, line: a + v(F.size(line) * F.col("dims")))
    lines = F.aggregate("coords", F.lit(0), lambda a, p: a + two(p))
    counts = F.when(F.col("geom_type").isin("Polygon", "MultiLineString", "MultiPolygon"), F.aggregate("coords", F.lit(0), lambda a, p: a + rings(p))).otherwise(0)
    polys = F.when(F.col("geom_type") == "MultiPolygon", F.aggregate("coords", F.lit(0), lambda a, p: a + v(F.size(p)))).otherwise(0)
    box = F.lit(0)
    for k in "wsen":
        box = box + v(G.zigzag(G.quantize(F.col(f"bbox.{k}"))))
    geom = F.when(F.col("geom_type").isNotNull(), 2 + nested(lines + counts + polys) + F.when(F.col("bbox").isNotNull(), nested(box)).otherwise(0)).otherwise(0)
    return (ident + props + geom).cast("long")


def _unsigned_size(u: Column) -> Column:
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(u < F.lit(str(1 << (7 * n))).cast("decimal(20,0)"), n).otherwise(out)
    return out


def frame_size(payload: Column) -> Column:
    return G.nested_size(payload)


def stats(rows: DataFrame) -> DataFrame:
    """Statistics of every feature (the reference columns without timings, which
    only a benchmark can give)."""
    from ..sources.geojson import feature_json

    return rows.select(
        "id", F.col("geom_type").alias("type"), G.vertex_count("coords").cast("long").alias("verticies"), F.size("properties").cast("long").alias("number_properties"),
        F.octet_length(feature_json()).cast("long").alias("size_json"), packed_size().alias("size_buf"),
    )


def stats_timed(rows: DataFrame) -> DataFrame:
    """``stats`` with the four timings (nanoseconds), measured per feature.  Rows are
    spread first: the work is much for their bytes, which the input's splits follow."""
    from ..functions import codec
    from ..sources.geojson import feature_json

    names = ["id", "type", "verticies", "number_properties", "size_json", "time_read_json", "time_write_json", "size_buf", "time_read_buf", "time_write_buf"]

    def run(batches):  # noqa: ANN001, ANN202
        import json
        from time import perf_counter_ns as now

        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                f = {k: r[k] for k in ("id", "geom_type", "dims", "coords")} | {"properties": dict(r["properties"])}
                t = [now()]
                payload = codec.encode(f)
                t.append(now())
                codec.decode(payload)
                t.append(now())
                parsed = json.loads(r["text"])
                t.append(now())
                json.dumps(parsed)
                t.append(now())
                d = [y - x for x, y in zip(t, t[1:])]
                out.append((r["id"], r["geom_type"], r["n"], len(f["properties"]), len(r["text"].encode()), d[2], d[3], len(payload), d[1], d[0]))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "type" else pa.int64()) for n, c in zip(names, cols)], names)

    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id", "coords")
    need = rows.select("id", "properties", "geom_type", "dims", "coords", feature_json().alias("text"), G.vertex_count("coords").alias("n"))
    return need.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'type' else 'long'}" for n in names))


def write_stats(rows: DataFrame, path: str) -> None:
    stats_timed(rows).drop("id").write.mode("overwrite").option("header", True).csv(path)


def stats_string(rows: DataFrame) -> DataFrame:
    """A comma-separated line per feature."""
    s = stats(rows)
    return s.select("id", F.concat_ws(",", *[F.col(c).cast("string") for c in s.columns if c != "id"]).alias("line"))


def property_text(key: str) -> Column:
    return P.map_get_default("properties", key)
