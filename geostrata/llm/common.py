"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: The white space of every operator's contract: space and U+0009 to U+000D.
SPACE = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch; keeps a Python worker's memory flat, whatever the texts' lengths.
BATCH_BYTES = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name in a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) a temporary folder
    is made and kept for the rest of the session; on a cluster that is an error,
    as every executor would write to a disk of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(spark, "_geostrata_dir", None)
        if not d:
            d = spark._geostrata_dir = "file://" + tempfile.mkdtemp(prefix="geostrata-")
    return d.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and reread.

    Cuts the lineage: a lost executor costs no recomputation beyond its tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geostrata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/geostrata-" in d:
            p = jvm.org.apache.hadoop.fs.Path(d)
            p.getFileSystem(conf).delete(p, True)


_state: dict = {}


def worker_state(key: object, make: Callable[[], T]) -> T:
    """What an operator keeps in its Python worker between tasks.  A worker holds
    one operator's state at a time, which bounds its memory."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of whole texts stay small.  Plans are lazy, so the limit
    stays in the session; one that is already lower is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes(setting: str) -> int:
    """A size setting in bytes: a number, maybe with a unit."""
    n = setting.lower().rstrip("b")
    return int(n[:-1]) << 10 * (1 + "kmgtp".index(n[-1])) if n[-1:].isalpha() else int(n)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, extra: list[str]) -> DataFrame:
    """``rows`` left-joined to ``groups`` (unique by ``key``), safe for hot keys.

    Groups that hold over a thousandth of all rows (so under 1,000 groups, a
    proven bound) are broadcast; only the rest of the rows meet the rest of
    the groups in a shuffle.
    """
    least = max(1000, total // 1000)
    hot = F.broadcast(groups.where(F.col(n) > least).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in extra]))
    near = rows.join(hot, rows[key] == F.col("_hk"), "left")
    done = near.where("_hk is not null").select(*[rows[c] for c in rows.columns], *[F.col(f"_h_{c}").alias(c) for c in extra])
    cold = groups.where(F.col(n) <= least).select(key, *extra)
    rest = near.where("_hk is null").select(*[rows[c] for c in rows.columns]).join(cold, key, "left").select(*rows.columns, *extra)
    return done.unionByName(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of a graph of long ids: ``(node, root)``, root the
    smallest id reachable.  Alternating large-star and small-star rounds, each
    written to the shared folder, hubs attached by broadcast; nodes without edges
    are not returned.
    """
    e = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        now = e.select(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now["n"] == 0 or tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(  # e stays: the result is lazy
                e.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = tuple(now)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = attach(both.where("v > u"), low, "u", "n", 2 * now["n"], ["m"])
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "edges")
        small = attach(large, low, "u", "n", now["n"], ["m"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(low)
        release(e)
        release(large)
        e = nxt
