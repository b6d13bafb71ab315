"""Exact deduplication through a minimal perfect hash over historical digests.

The rows are taken in two lots: the *history* and the *arrivals*.  The
history's distinct digests are cut into shards of about ``SHARD_KEYS`` keys;
each shard gets a minimal perfect hash (levels of collision-free bit arrays,
ranked), whose slots hold the full 32-byte digest and the winner's locator
(code points, doc_id, row) with the number of rows.  Arrivals, already folded to
one row per digest, are sent to the shard of their digest, hashed to a slot and
accepted only when all 32 bytes agree; members are merged into the slot,
nonmembers are grouped on their own.  Where a shard would meet more than
``SHARD_KEYS`` arrivals, it is looked up in parts, each with a share of them.

A history can be kept: ``save_index`` writes its perfect hash to a folder, and
``exact_dedup`` with ``index`` takes every row as an arrival against it.

Defined results: null text counts as empty; texts are equal when identical
without the characters of ``[\\x20\\x09-\\x0D]``; of equal texts one row stays: that
with most code points, then the smallest doc_id (null last), then any.  Repeated
rows are rows of their own.  Against a kept history, keep_id may be of one of its
rows, which wins ties, and group_size counts its rows too.  Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, attach, load, materialise, release

#: Keys of one shard's perfect hash; bounds the memory of a task.
SHARD_KEYS = 32768
#: Bits of a level per key that is left, and levels before the overflow list.
GAMMA, LEVELS = 2.0, 40

_INDEX = "shard int, n_slots int, n_overflow int, sizes array<long>, bits array<binary>, digests binary, lens array<long>, ids array<long>, rows array<long>, counts array<long>"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each 32-byte key at a level; all four words of the digest count."""
    h = np.full(len(keys), np.uint64(level + 1)) * _MIX[2]
    for k in range(4):
        h = (h ^ keys[:, k]) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, built by levels."""

    def __init__(self, sizes: list[int], bits: list[bytes], n_overflow: int = 0):
        self.sizes, self.n_overflow = list(sizes), n_overflow
        self.bits = [np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[:s] for b, s in zip(bits, self.sizes)]
        base, self.ranks = 0, []
        for b in self.bits:
            self.ranks.append(base + np.cumsum(b, dtype=np.int64) - b)
            base += int(b.sum())
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: (n, 4) words.  Keys left after all levels go to the overflow."""
        sizes, bits, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = max(8, int(GAMMA * len(left)))
            at = _positions(left, len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(once, bitorder="little").tobytes())
            left = left[~once[at]]
        return cls(sizes, bits, len(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds a bit for it."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (b, r) in enumerate(zip(self.bits, self.ranks)):
            if not len(left):
                break
            at = _positions(keys[left], level, len(b))
            hit = b[at] == 1
            out[left[hit]] = r[at[hit]]
            left = left[~hit]
        return out


def _words(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(-1, 4)


def _build(table: pa.Table) -> pa.Table:
    """One shard's slots from its distinct historical digests."""
    keys = _words(table["digest"])
    h = PerfectHash.build(keys)
    slot = h.slots(keys)
    over = np.flatnonzero(slot < 0)
    slot[over] = h.n + np.arange(len(over))
    order = np.argsort(slot)
    take = table.take(pa.array(order))
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "n_slots": pa.array([len(keys)], pa.int32()),
            "n_overflow": pa.array([len(over)], pa.int32()),
            "sizes": pa.array([h.sizes], pa.list_(pa.int64())),
            "bits": pa.array([[np.packbits(b, bitorder="little").tobytes() for b in h.bits]], pa.list_(pa.binary())),
            "digests": pa.array([b"".join(take["digest"].to_pylist())], pa.binary()),
            "lens": pa.array([take["len"].to_pylist()], pa.list_(pa.int64())),
            "ids": pa.array([take["id"].to_pylist()], pa.list_(pa.int64())),
            "rows": pa.array([take["row"].to_pylist()], pa.list_(pa.int64())),
            "counts": pa.array([take["n"].to_pylist()], pa.list_(pa.int64())),
        }
    )


def _better(a: tuple, b: tuple) -> bool:
    """Whether locator a = (code points, doc_id, row) wins over b."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _part(digest: bytes, parts: int) -> int:
    """The part of a shard that a digest belongs to."""
    return int.from_bytes(digest[24:28]) % parts


def _lookup(index: pa.Table, arrivals: pa.Table) -> pa.Table:
    """Slots updated by their arrivals, then the arrivals that are no members."""
    digests, lens, ids, rows, counts, member = [], [], [], [], [], []
    lost = list(range(arrivals.num_rows))
    if index.num_rows:
        row = index.to_pylist()[0]
        held = [row["digests"][32 * i : 32 * i + 32] for i in range(row["n_slots"])]
        lens, ids, rows, counts = row["lens"], row["ids"], row["rows"], row["counts"]
        if arrivals.num_rows:
            h = PerfectHash(row["sizes"], row["bits"])
            slot = h.slots(_words(arrivals["digest"]))
            over = {d: h.n + k for k, d in enumerate(held[h.n :])}
            lost = []
            new = zip(*(arrivals[k].to_pylist() for k in ("digest", "len", "id", "row", "n")))
            for i, (d, length, who, at, n) in enumerate(new):
                s = int(slot[i])
                if s < 0 or held[s] != d:
                    s = over.get(d, -1)
                if s < 0:
                    lost.append(i)
                    continue
                counts[s] += n
                if _better((length, who, at), (lens[s], ids[s], rows[s])):
                    lens[s], ids[s], rows[s] = length, who, at
        mine = [i for i, d in enumerate(held) if row["parts"] == 1 or _part(d, row["parts"]) == row["part"]]
        digests, lens, ids, rows, counts = ([x[i] for i in mine] for x in (held, lens, ids, rows, counts))
        member = [True] * len(mine)
    rest = arrivals.take(pa.array(lost, pa.int64()))
    return pa.table(
        {
            "digest": pa.array(digests + rest["digest"].to_pylist(), pa.binary()),
            "keep_len": pa.array(lens + rest["len"].to_pylist(), pa.int64()),
            "keep_id": pa.array(ids + rest["id"].to_pylist(), pa.int64()),
            "keep_row": pa.array(rows + rest["row"].to_pylist(), pa.int64()),
            "group_size": pa.array(counts + rest["n"].to_pylist(), pa.int64()),
            "member": pa.array(member + [False] * rest.num_rows, pa.bool_()),
        }
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, len, digest)``: digest of the text without white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, SPACE, "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("len"), F.unhex(F.sha2(bare, 256)).alias("digest"))


def fold(rows: DataFrame) -> DataFrame:
    """One row per digest with its winner's locator and its number of rows."""
    best = F.min(F.struct((-F.col("len")).alias("l"), F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("row").alias("r")))
    one = rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    return one.select("digest", (-F.col("b.l")).alias("len"), F.col("b.i").alias("id"), F.col("b.r").alias("row"), "n")


def _shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(folded: DataFrame) -> DataFrame:
    """The perfect-hash index of folded historical digests, one row a shard."""
    shards = max(1, -(-folded.count() // SHARD_KEYS))
    index = _shard(folded, shards).groupBy("shard").applyInArrow(_build, _INDEX)
    return materialise(index.withColumn("shards", F.lit(shards)), "mph")


def save_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all rows as a history; its rows have number -1."""
    rows = digests(docs, id_col, text_col).withColumn("row", F.lit(-1).cast("long"))
    index = build_index(materialise(fold(rows), "history"))
    index.write.parquet(path)
    release(index)


def lookup(index: DataFrame, folded: DataFrame, most: int = SHARD_KEYS) -> DataFrame:
    """All digests of index and arrivals with winner, size and membership."""
    first, n = index.select("shards").first(), folded.count()
    shards = first[0] if first else max(1, -(-n // most))
    parts = max(1, -(-n // (shards * most)))
    of = F.conv(F.substring(F.hex("digest"), 49, 8), 16, 10).cast("long")
    left = index.drop("shards").withColumn("parts", F.lit(parts)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = _shard(folded, shards).withColumn("part", F.pmod(of, F.lit(parts)).cast("int"))
    schema = "digest binary, keep_len long, keep_id long, keep_row long, group_size long, member boolean"
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(_lookup, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    Without an index, rows with an even digest of their id make the history, the
    others arrive.
    """
    rows = digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "digests")
    new, own = rows, index is None
    if own:
        old = F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(2)) == 0
        history, new = materialise(fold(rows.where(old)), "history"), rows.where(~old)
        index = build_index(history)
        release(history)
    arrivals = materialise(fold(new), "arrivals")
    winners = materialise(lookup(index, arrivals), "winners")
    for t in (arrivals, index) if own else (arrivals,):
        release(t)
    out = attach(rows.drop("len"), winners, "digest", "group_size", rows.count(), ["keep_id", "keep_row", "group_size"])
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return exact_dedup(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
