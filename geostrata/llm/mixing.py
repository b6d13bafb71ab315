"""Mixing sources to target weights by pivotal dependent rounding.

A source of S words with target T takes each document ``floor(T/S)`` times and
once more with probability ``p = frac(T/S)``.  The fractions are settled by
pivotal steps that keep the expected *words*: of a pair, mass in words moves at
random from one to the other until one probability is 0 or 1; the other goes
on.  Documents are paired within buckets of about ``FAN`` of one source; a
bucket leaves at most one unsettled document, and those meet in buckets of the
next level: a reduction tree, so that a source ends with one document whose
own coin is at most one document's words away from the target.

Only DataFrame functions run.  All coins are hashes of the documents' ids, so
reruns agree.  A hot source only has more buckets.

Defined results: null or empty text has size 0 and takes nothing; sources sort
by code point, null last; a table without words has targets 0; repeated rows
are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, attach, load, materialise

#: Documents of one bucket of the reduction tree.
FAN = 32
#: Most copies of a document, and the sources' weights in turn.
MOST, WEIGHTS = 3, (5.0, 2.0, 1.0)
#: Sources up to which their statistics are broadcast.
BROADCAST_SOURCES = 20_000

#: One pivotal step between the unsettled document c and the next one, x.
#: a: words that can move to c, b: words that can move away from it.
_STEP = """
transform(array(struct(least((1 - acc.c.p) * acc.c.size, x.p * x.size) AS a, least(acc.c.p * acc.c.size, (1 - x.p) * x.size) AS b,
  pmod(xxhash64(acc.c.h, x.h), 1048576) / 1048576D AS u)), s ->
transform(array(struct(s.u * (s.a + s.b) < s.b AS up, s.a AS a, s.b AS b)), t ->
transform(array(struct(
  CASE WHEN t.up THEN CASE WHEN t.a = (1 - acc.c.p) * acc.c.size THEN 1D ELSE acc.c.p + t.a / acc.c.size END
       ELSE CASE WHEN t.b = acc.c.p * acc.c.size THEN 0D ELSE acc.c.p - t.b / acc.c.size END END AS p,
  CASE WHEN t.up THEN CASE WHEN t.a = x.p * x.size THEN 0D ELSE x.p - t.a / x.size END
       ELSE CASE WHEN t.b = (1 - x.p) * x.size THEN 1D ELSE x.p + t.b / x.size END END AS q)), r ->
struct(
  CASE WHEN r.p > 0 AND r.p < 1 THEN named_struct({c_keep}) WHEN r.q > 0 AND r.q < 1 THEN named_struct({x_keep}) END AS c,
  concat(acc.out, filter(array(named_struct({c_out}), named_struct({x_out})), y -> y.p <= 0 OR y.p >= 1)) AS out))[0])[0])[0]
"""
_FIELDS = ("id", "dup", "source", "size", "source_size", "target", "h", "bucket", "whole")


def _struct(of: str, p: str) -> str:
    return ", ".join([f"'{f}', {of}.{f}" for f in _FIELDS] + [f"'p', {p}"])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size)`` of every row; size is its number of words."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def targets(sizes: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size, n, target)``: shares of all words by weight, none
    above ``most`` times its source, the excess shared again by weight.

    The fixed point is the level t at which ``sum(min(most * size, t * weight))``
    is the total: sources are capped in order of ``size / weight``.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("free", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", "n", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _round(rows: DataFrame) -> DataFrame:
    """One level of the tree: buckets of a source folded by pivotal steps."""
    c_out, x_out = _struct("acc.c", "r.p"), _struct("x", "r.q")
    step = _STEP.format(c_keep=c_out, x_keep=x_out, c_out=c_out, x_out=x_out)
    kind = "struct<id bigint, dup bigint, source string, size bigint, source_size bigint, target double, h bigint, bucket bigint, whole bigint, p double>"
    kind = kind.replace(" bigint", ":bigint").replace(" string", ":string").replace(" double", ":double")
    folded = f"""aggregate(members, named_struct('c', CAST(NULL AS {kind}), 'out', CAST(array() AS array<{kind}>)),
      (acc, x) -> CASE WHEN acc.c IS NULL THEN named_struct('c', x, 'out', acc.out) ELSE {step} END)"""
    # The largest first, so that what is left at the end of a bucket is small.
    order = "array_sort(collect_list(struct(-size AS o, h AS h0, dup AS d0, struct({}) AS x)))".format(", ".join([*_FIELDS, "p"]))
    grouped = rows.groupBy("source", "bucket").agg(F.expr(order).alias("m"))
    return grouped.select(F.expr("transform(m, y -> y.x)").alias("members")).select(F.expr(folded).alias("f"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fan: int = FAN) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, copies)`` per row."""
    base = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    stats = materialise(targets(base), "sources")
    few, largest = stats.agg(F.count(F.lit(1)), F.max("n")).first()
    # Rows that agree in id, source and size are told apart by a number.
    rows = base.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("dup"))
    if few <= BROADCAST_SOURCES:
        side = F.broadcast(stats.select(F.col("source").alias("_s"), "source_size", "target", "n"))
        rows = rows.join(side, F.col("source").eqNullSafe(F.col("_s")), "left")
    else:  # hot sources still meet their figures by broadcast, and only the others in a shuffle
        key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_k")
        side = stats.select(key, "source_size", "target", "n")
        rows = attach(rows.select("*", key), side, "_k", "n", base.count(), ["source_size", "target", "n"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64(F.lit("mix"), "id", "dup", "size")
    rows = rows.select(
        "id", "dup", "source", "size", "source_size", "target", h.alias("h"),
        F.pmod(h, F.ceil(F.col("n") / fan)).alias("bucket"), F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"),
    )
    rows = materialise(rows, "rows")
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    settled = [rows.where(~open_).withColumn("p", F.lit(0.0))]
    level, buckets = rows.where(open_), max(1, -(-(largest or 0) // fan))
    while True:
        f = materialise(_round(level), "level")
        settled.append(f.select(F.explode("f.out").alias("y")).select("y.*"))
        left = f.where("f.c is not null").select("f.c.*")
        if buckets <= 1:
            coin = F.pmod(F.xxhash64(F.lit("last"), "h"), F.lit(1 << 20)) / float(1 << 20)
            settled.append(left.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)))
            break
        level, buckets = left.withColumn("bucket", F.floor(F.col("bucket") / fan)), -(-buckets // fan)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.round("p").cast("long")).cast("long")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes of it."""
    return mix(load(spark, sf_dir, "documents"))


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets."""
    return targets(sized(load(spark, sf_dir, "documents"))).select("source", "source_size", F.round("target", 3).alias("target"), F.col("n").alias("n_docs"))


PART_SQL = r"""
WITH RECURSIVE s AS (
  SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size, count(*) AS n_docs FROM documents GROUP BY source
),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
-- Sources are capped until none is above: at each step those whose share of what is left exceeds their cap.
step AS (
  SELECT 0 AS k, source, source_size, n_docs, weight, false AS capped, CAST(0 AS DOUBLE) AS level FROM w
  UNION ALL
  SELECT k + 1, source, source_size, n_docs, weight, capped OR now * weight >= 3 * source_size, now FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) / nullif(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0)::DOUBLE AS now FROM step
  ) WHERE k < 64
)
SELECT source, source_size, round(CASE WHEN capped THEN 3.0 * source_size ELSE level * weight END, 3)::DOUBLE AS target, n_docs FROM step WHERE k = 64
"""
