"""Reading packed streams: whole, partial, by position and by key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.packed import file_size, list_files, read_index, register
from ..schema import INDEX

#: Positions that are looked up by seeking.
SEEKS = 20_000


def scan(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The features of a packed file or folder (see the source's options)."""
    register(spark)
    reader = spark.read.format("packedfeature")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(path)


def scan_raw(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """``(payload, _pos_start, _pos_end)``: records undecoded."""
    return scan(spark, path, mode="raw", **options)


def scan_buffer(df: DataFrame, col: str) -> DataFrame:
    """The records of binary columns: the other columns, payload and positions."""
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.explode(codec.decode_stream(col)).alias("r"))
    return rows.select(*rest, "r.payload", F.col("r.start").alias("_pos_start"), F.col("r.end").alias("_pos_end"))


def to_buffers(df: DataFrame, by: str, order: str, most: int = 16 << 20) -> DataFrame:
    """``(by, part, buf)``: rows' records (column ``frame``) by a key and in order, as
    buffers of about ``most`` bytes at the most, numbered within their key."""
    kind = dict(df.dtypes)[by]

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        key, part, held, n, names = None, 0, [], 0, [by, "part", "buf"]
        one = lambda: pa.RecordBatch.from_arrays([pa.array([key], types[0]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], names)
        for b in batches:
            types = (b.schema.field(0).type,)
            for k, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (k != key or n + len(frame) > most):
                    yield one()
                    part, held, n = part + 1 if k == key else 0, [], 0
                key = k
                held.append(frame)
                n += len(frame)
        if held:
            yield one()

    rows = df.select(by, "frame", F.col(order).alias("_o")).repartition(by).sortWithinPartitions(by, "_o").select(by, "frame")
    return rows.mapInArrow(run, f"`{by}` {kind}, part int, buf binary")


def decoded(raw: DataFrame, sint_zigzag: bool = False) -> DataFrame:
    """Raw records with the feature's columns in place of the payload."""
    rest = [c for c in raw.columns if c != "payload"]
    return raw.select(*rest, codec.decode_feature("payload", sint_zigzag).alias("f")).select("f.*", *rest)


def seek(spark: SparkSession, path: str, pos: int, **options: object) -> DataFrame:
    """Records from a byte offset on, which must be a record's start."""
    return scan(spark, path, from_pos=pos, **options)


def read_ranges(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records at given positions (``_pos_start``, ``_pos_end``)."""
    return raw.join(ranges.select("_pos_start", "_pos_end").distinct(), ["_pos_start", "_pos_end"], "left_semi")


def look_up(spark: SparkSession, path: str, ranges: DataFrame, **options: object) -> DataFrame:
    """Records at given positions (``_pos_start``, ``_pos_end`` of their payload, and
    ``file``, if there is such a column: the end of a file's path).

    Up to ``SEEKS`` positions are read by seeking to them, and nothing else is
    read; beyond that the folder is scanned and joined.
    """
    columns = [F.col("file") if "file" in ranges.columns else F.lit(None).cast("string").alias("file"), "_pos_start", "_pos_end"]
    wanted = ranges.select(*columns).distinct()
    few = wanted.limit(SEEKS + 1).collect()
    if len(few) <= SEEKS:
        return scan(spark, path, mode="raw", ranges=json.dumps(sorted(map(tuple, few), key=str)), **options)
    out = []
    for name in sorted({r["file"] for r in wanted.select("file").distinct().collect()}, key=str):
        mine = wanted.where(F.col("file").eqNullSafe(F.lit(name)))
        for file in [path] if name is None else [f for f in list_files(path) if f.endswith(name)]:
            raw = scan_raw(spark, file, **options)
            out.append(read_ranges(raw, mine).select(*raw.columns))
    return merge(*out)


def merge(*frames: DataFrame) -> DataFrame:
    """One stream behind the other: UNION ALL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def index(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """The index of a packed folder: one row per run of records of a key, into
    however many ranges a file is cut for its readers.  Its size follows the files'
    number, not the records'.  joined: positions as if the files, in order, were one."""
    rows, base, last = [], 0, None
    for file in list_files(path):
        for r in read_index(path, file) or []:
            r = r | {"start": base + r["start"], "end": base + r["end"]}
            if last and r["key"] == last["key"] and r["start"] == last["end"]:
                last |= {"end": r["end"], "count": last["count"] + r["count"]}
                last |= {k: fn((v for v in (last[k], r[k]) if v is not None), default=None) for k, fn in zip("wsen", (min, min, max, max))}
            else:
                rows.append(last := r)
        base, last = (base + file_size(path, file), last) if joined else (0, None)
    return spark.createDataFrame([(r["key"], r["start"], r["end"], r["end"] - r["start"], r["count"], *[r[k] for k in "wsen"]) for r in rows], INDEX)


def shift_index(index: DataFrame, header: int) -> DataFrame:
    """Byte ranges moved by a header, sizes recomputed."""
    return index.withColumn("start", F.col("start") + header).withColumn("end", F.col("end") + header).withColumn("size", F.col("end") - F.col("start"))


def metadata_test() -> Column:
    """Whether a feature is the leading record of an older index."""
    return (F.size("properties") == 1) & F.map_contains_key("properties", "metadata")
