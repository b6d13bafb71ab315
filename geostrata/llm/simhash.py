"""SimHash near-duplicates, linked exactly through vantage-point trees.

A pair of 64-bit fingerprints with at most ``RADIUS`` = 4 differing bits has at
most 1 differing bit in one of three parts of 21, 21 and 22 bits.  In each
part the fingerprints' projections are partitioned by a vantage-point tree:
level j holds the Hamming distance to a vantage point over the part's j-th run
of bits, and the leaf (the distances of all levels) is the shard.  By the
triangle bound, distances to a vantage point of two projections that differ in
one bit differ by at most one, and in one level only; so a query visits its
home shard and the shards whose distance differs by one in one level.  Every
distinct fingerprint is stored in its home shard and sent, as a query, to the
boundary shards above it: at most ``1 + levels`` rows a part, however large the
table.  The runs' width follows the number of fingerprints, which bounds
a shard's share.

Within a shard a tree over whole fingerprints, with vantage points from the
shard, finds the pairs: a branch is pruned when the triangle bound exceeds the
radius, and linked as a whole when it guarantees it.  Each shard returns a
forest of its links (at most one per fingerprint), not all pairs.  A shard of
more than ``SPLIT`` rows (a dense template) is cut into portions of about that
size by a hash of the fingerprint; a task then searches the trees of one portion
for the queries of one portion, so that no task holds more than two, and the
forests of all tasks have the shard's links.

Equal fingerprints are folded first, so copies cost one row.  Defined results:
null or empty text has fingerprint 0 and is linked like any other; repeated
rows are documents with one doc_id; a null doc_id is linked, but only a group
without any other has a null component_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, components, load, materialise, release, small_batches

SHINGLE, SEED, RADIUS = 4, 42, 4
#: First bit and width of the parts; the radius that one of them keeps.
PARTS, PART_RADIUS = ((0, 21), (21, 21), (42, 22)), 1
#: Root vantage point.
VANTAGE = 0x9E3779B97F4A7C15
#: Fingerprints up to which a node of a shard's tree is searched as it is.
LEAF = 192
#: Rows of a shard beyond which it is cut into portions.
SPLIT = 65_536
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest as h

    words = text.encode().translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    line, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]] + [len(line)]
    return [h(line[a:b], SEED) for a, b in zip(starts, ends)]


def fingerprints(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text: bits set in over half its shingles."""
    out = np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        h = np.array(shingle_hashes(t), np.uint64)
        if len(h):
            ones = np.zeros(64, np.int64)
            for a in range(0, len(h), 8192):
                bits = np.unpackbits(h[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
            out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: fingerprints as signed longs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(["" if t is None else t for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def run_bits(n: int) -> int:
    """Bits of a level's run: narrower for more fingerprints."""
    return 3 if n <= 1 << 24 else 2 if n <= 1 << 28 else 1


def route(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shard, fp, home)`` rows of fingerprints: home shards and the boundary
    shards that a query has to visit, those with the greater number only."""
    shards, fps, homes = [], [], []
    for part, (first, width) in enumerate(PARTS):
        away = ((fp ^ np.uint64(VANTAGE)) >> np.uint64(first)) & np.uint64((1 << width) - 1)
        runs = [(a, min(a + bits, width)) for a in range(0, width, bits)]
        dist = [np.bitwise_count((away >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in runs]
        scale, step = [], 1
        for a, b in runs:
            scale.append(step)
            step *= b - a + 1
        home = sum(d * s for d, s in zip(dist, scale)) * 3 + part
        shards.append(home)
        fps.append(fp)
        homes.append(np.ones(len(fp), bool))
        for d, s, (a, b) in zip(dist, scale, runs):
            go = d < b - a
            shards.append(home[go] + 3 * s)
            fps.append(fp[go])
            homes.append(np.zeros(int(go.sum()), bool))
    return np.concatenate(shards), np.concatenate(fps), np.concatenate(homes)


class Forest:
    """Union-find over a shard's fingerprints, for many of them at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                self.up[at] = r
                return r
            r = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[k] with b[k] for every k."""
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        while differ.any():
            low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            np.minimum.at(self.up, high, low)
            # A root that met two lower ones kept the least: the others are linked next.
            a, b = self.roots(low), self.roots(high)
            differ = a != b


def search(fp: np.ndarray, stored: np.ndarray, asked: np.ndarray, forest: Forest, radius: int = RADIUS, leaf: int = LEAF) -> None:
    """Link every asked fingerprint to the stored ones within the radius.

    stored, asked: indices into ``fp``.
    """
    todo = [(stored, asked)]
    while todo:
        s, q = todo.pop()
        if not len(s) or not len(q):
            continue
        if len(s) <= leaf:
            block = max(1, 200_000 // len(s))
            for a in range(0, len(q), block):
                part = q[a : a + block]
                i, j = np.nonzero(np.bitwise_count(fp[part, None] ^ fp[s][None, :]) <= radius)
                if len(i):
                    forest.link(part[i], s[j])
            continue
        # The stored point in the middle of the fingerprints' order is the vantage point.
        v = fp[s[len(s) // 2]]
        ds, dq = np.bitwise_count(fp[s] ^ v).astype(np.int16), np.bitwise_count(fp[q] ^ v).astype(np.int16)
        cuts = np.unique(np.quantile(ds, (0.25, 0.5, 0.75), method="nearest"))
        if ds.min() == ds.max():
            cuts = cuts[:0]
        edges = [-1, *[int(c) for c in cuts if c < ds.max()], 64]
        for lo, hi in zip(edges, edges[1:]):
            mine = (ds > lo) & (ds <= hi)
            inside, d = s[mine], ds[mine]
            if not len(inside):
                continue
            least, most = int(d.min()), int(d.max())
            whole = dq + most <= radius
            if whole.any():
                first = q[whole][0]
                forest.link(q[whole], np.full(int(whole.sum()), inside[0]))
                forest.link(inside, np.full(len(inside), first))
            some = ~whole & (dq >= least - radius) & (dq <= most + radius)
            if len(inside) == len(s):  # no progress by this vantage point: halve the shell
                half = len(s) // 2
                todo += [(inside[:half], q[some]), (inside[half:], q[some])]
            else:
                todo.append((inside, q[some]))


def shard_links(fp: np.ndarray, stored: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of a shard's links, as positions; stored, asked: masks."""
    forest = Forest(len(fp))
    search(fp, np.flatnonzero(stored), np.flatnonzero(asked), forest)
    roots = forest.roots(np.arange(len(fp)))
    at = np.flatnonzero(roots != np.arange(len(fp)))
    return at, roots[at]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of groups (rows sorted by shard, p and q) of fingerprints."""

    def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        fp, stored, asked = (np.concatenate(x) for x in zip(*parts))
        if len(fp) < 2 or not stored.any():
            return None
        a, b = shard_links(fp, stored, asked)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    now, parts = None, []
    for batch in batches:
        key = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
        fp = np.asarray(batch.column(3)).view(np.uint64)
        stored, asked = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if now is not None and tuple(key[:, a]) != now:
                if (out := flush(parts)) is not None:
                    yield out
                parts = []
            now = tuple(key[:, a])
            parts.append([fp[a:z], stored[a:z], asked[a:z]])
    if parts and (out := flush(parts)) is not None:
        yield out


def links(nodes: DataFrame, radius_bits: int | None = None, split: int = SPLIT) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) whose
    transitive closure is that of all pairs within the radius."""
    bits = radius_bits or run_bits(nodes.count())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp, home = route(np.asarray(b.column(0)).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp.view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    routed = nodes.select("fp").mapInArrow(send, "shard long, fp long, home boolean")
    hot = materialise(routed.groupBy("shard").count().where(F.col("count") > split).select(F.col("shard").alias("_s"), F.ceil(F.col("count") / split).alias("k")), "hot")
    none = F.lit(0).cast("long")
    cold = routed.select("shard", none.alias("p"), none.alias("q"), "fp", F.col("home").alias("stored"), F.lit(True).alias("asked"))
    if not hot.isEmpty():
        # At most a SPLIT-th of the routed rows are hot shards, and few have one at all.
        mine = routed.join(hot, F.col("shard") == F.col("_s"), "left")
        cold = mine.where("k is null").select("shard", none.alias("p"), none.alias("q"), "fp", F.col("home").alias("stored"), F.lit(True).alias("asked"))
        warm = mine.where("k is not null").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
        other = F.explode(F.sequence(none, F.col("k") - 1)).alias("other")
        # p: the portion whose trees are searched; q: the one whose queries are asked.
        stored = warm.where("home").select("shard", F.col("own").alias("p"), other, "fp", F.lit(True).alias("stored")).select("shard", "p", F.col("other").alias("q"), "fp", "stored", (F.col("p") == F.col("other")).alias("asked"))
        asked = warm.select("shard", F.col("own").alias("q"), other, "fp", "home").where("not (home and q = other)")
        asked = asked.select("shard", F.col("other").alias("p"), "q", "fp", F.lit(False).alias("stored"), F.lit(True).alias("asked"))
        cold = cold.unionByName(stored).unionByName(asked)
    tidy = cold.repartition("shard", "p", "q").sortWithinPartitions("shard", "p", "q", "fp")
    return materialise(tidy.mapInArrow(_found, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row."""
    rows = materialise(fingerprint_rows(docs, id_col, text_col), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    near = links(nodes)
    comp = materialise(components(near, "a", "b"), "components")
    release(near)
    joined = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    low = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("component_size"))
    labelled = materialise(attach(joined, low, "root", "k", max(1, nodes.count()), ["component_id", "component_size"]), "labelled")
    for t in (comp, nodes):
        release(t)
    out = attach(rows, labelled, "fp", "n", rows.count(), ["component_id", "component_size"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every row of ``documents``."""
    return near_duplicates(load(spark, sf_dir, "documents"))
