"""Suffix-array deduplication: remove bytes under long strings met earlier.

Every suffix is compared on its first ``WIDTH`` = 100 bytes.  Sorting all
suffixes of a corpus in one place is out of reach, so they are sent to buckets
in which equal strings are sure to meet: the bucket of a 100-byte string is the
hash of its minimizer, the ``GRAM``-byte gram with the least hash in it.  Equal
strings have equal minimizers at equal offsets, so no match is lost, whatever
the documents' number; one minimizer serves about 30 neighbouring suffixes,
and travels for all of them as one row with a hash of its whole context.

Copies are folded before they are sorted: rows with the same minimizer and the
same context hold the same suffixes, so all but the first are matched; this is
done for every ``FOLD`` rows before the shuffle (a passage in a third of all
documents sends one row of them) and again behind it.  Contexts are taken for
the same when two hashes of different build, of 64 and 32 bits, agree; they are
compared only within a bucket.  Only buckets that keep two different contexts
are sorted: their contexts are cut from the texts, parted once more by 68 bytes
that their suffixes share, and ordered by a deep-shallow sort.  Multikey
quicksort, with characters of 8 bytes and all classes' partitions in one pass,
orders the suffixes to ``SHALLOW`` bytes, leaving out those that are alone; what
still shares a prefix goes to blind tries: all suffixes of a node are compared
once with its first leaf and branch by the length of the common prefix and the
next byte.  Suffixes that agree with a leaf on all 100 bytes are later copies of
it.

Buckets of over ``HOT`` rows are first sorted in salted parts; what stays first
in its part is then grouped by its 100 bytes.  The lists that one document
gathers are bounded by its own length, as is its text.

Defined results: null text has no bytes; order is doc_id (null last), then
start; rows that share a doc_id are documents of their own, ordered by text;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, release, small_batches

WIDTH, GRAM, SHALLOW, HOT = 100, 36, 32, 50_000
#: Grams of one string; reach of a context to the left of its minimizer.
SPAN = WIDTH - GRAM + 1
REACH = SPAN - 1
#: Offsets up to which a suffix counts as right of the middle, and the bytes of either part's rows.
MIDDLE = REACH // 2
PART = MIDDLE + WIDTH
#: Rows that are folded at once; rows of a batch sent on; starts of a block of a long text.
FOLD, SENT, BLOCK = 1 << 20, 1 << 16, 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INDEX = np.uint64((1 << 24) - 1)
#: Values of bytes: in order for the first hash, random ones for the second.
_PLAIN = np.arange(256, dtype=np.uint64) + np.uint64(7)
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_B, _INV)):
            p = np.full(max(n, 1 << 16), b)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of any substring of a buffer, from one pass over it."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _PLAIN):
        p, self.inv = _power(len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * p[: len(buf)], dtype=np.uint64, out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[start]) * self.inv[start]

    def every(self, width: int) -> np.ndarray:
        n = len(self.sum) - width
        return (self.sum[width:] - self.sum[:n]) * self.inv[:n]


def minimizers(buf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a buffer: position, first and last start served, gram hash and both
    context hashes of every minimizer."""
    none = np.zeros(0, np.int64)
    if len(buf) < WIDTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.int32)
    found = []
    for s in range(0, len(buf) - WIDTH + 1, BLOCK):
        base = max(0, s - REACH)
        sub = buf[base : min(len(buf), s + BLOCK + 2 * WIDTH)]
        hasher = Hasher(sub)
        v = _mix(hasher.every(GRAM))
        m = (v & ~_INDEX) | np.arange(len(v), dtype=np.uint64)
        n, have = len(v) - SPAN + 1, 1
        while have < SPAN:
            step = min(have, SPAN - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        first, last = s - base, min(n, s - base + BLOCK)
        at = (m[first:last] & _INDEX).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        p, a = at[cut], first + cut
        b = np.append(a[1:], last) - 1
        left, right = np.maximum(p - REACH, 0), np.minimum(p + WIDTH, len(sub))
        shape = ((p - left) * 1000 + (right - p)).astype(np.uint64) * np.uint64(1 << 20) + ((p - a) * 128 + (p - b)).astype(np.uint64)
        again = _mix(Hasher(sub, _RANDOM)(left, right) + shape) >> np.uint64(32)
        found.append((p + base, a + base, b + base, v[p], _mix(hasher(left, right) ^ _mix(shape)), again.astype(np.uint32).view(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals (touching ones joined)."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


_ANCHOR = "h long, c long, c2 int, doc long, p int, a int, b int"
_NAMES = ["h", "c", "c2", "doc", "p", "a", "b"]


def _batch(h, c, c2, doc, p, a, b) -> pa.RecordBatch:  # noqa: ANN001
    as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    as_int = lambda x: pa.array(np.asarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([as_long(h), as_long(c), as_int(c2), as_long(doc), as_int(p), as_int(a), as_int(b)], _NAMES)


def _removed(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Removed intervals as rows: p is -1, [a, b) the bytes."""
    docs, starts, ends = [], [], []
    o = np.argsort(doc, kind="stable")
    doc, start, end = doc[o], start[o], end[o]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
    for x, y in zip(cuts, cuts[1:]):
        s, e = merged(start[x:y], end[x:y])
        docs.append(np.full(len(s), doc[x]))
        starts.append(s)
        ends.append(e)
    d, s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, starts, ends))
    none = np.zeros(len(d), np.int64)
    return _batch(_mix(d.astype(np.uint64)), none, none, d.astype(np.int64), np.full(len(d), -1), s, e)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded minimizers of (doc, text), ``FOLD`` rows at a time."""

    def folded(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, c, c2, doc, p, a, b = (np.concatenate(x) for x in zip(*parts))
        o = np.lexsort((p, doc, c2, c, h))
        h, c, c2, doc, p, a, b = (x[o] for x in (h, c, c2, doc, p, a, b))
        copy = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (c2[1:] == c2[:-1])]) if len(h) else np.zeros(0, bool)
        keep = ~copy
        for out in (_batch(*(x[keep] for x in (h, c, c2, doc, p, a, b))), _removed(doc[copy], a[copy], b[copy] + WIDTH)):
            for k in range(0, out.num_rows, SENT):
                yield out.slice(k, SENT)

    parts, n = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, a, b, h, c, c2 = minimizers(np.frombuffer((text or "").encode(), np.uint8))
            parts.append((h, c, c2, np.full(len(p), doc, np.int64), p, a, b))
            n += len(p)
            if n >= FOLD:
                yield from folded(parts)
                parts, n = [], 0
    if n:
        yield from folded(parts)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(batch.column(k)) for k in range(len(_NAMES))]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, c, c2, doc, p): copies become removed intervals, rows
    of buckets with different contexts go on, the others are done."""
    last: list | None = None  # the pending first row of a bucket with one context so far
    before = (None, None, None)
    for batch in batches:
        x = _arrays(batch)
        done = x[4] < 0
        if done.any():
            yield batch.filter(pa.array(done))
            x = [v[~done] for v in x]
        h, c, c2, doc, p, a, b = x
        if not len(h):
            continue
        copy = np.ones(len(h), bool)
        for v, old in zip((h, c, c2), before):
            copy &= np.concatenate([[v[0] == old], v[1:] == v[:-1]])
        yield _removed(doc[copy].astype(np.int64), a[copy].astype(np.int64), b[copy].astype(np.int64) + WIDTH)
        keep = np.flatnonzero(~copy)
        before = (h[-1], c[-1], c2[-1])
        if not len(keep):
            continue
        h, c, c2, doc, p, a, b = (v[keep] for v in x)
        same = np.concatenate([[last is not None and h[0] == last[0]], h[1:] == h[:-1]])
        follows = np.append(same[1:], False)
        go = same | follows
        if same[0] and last[-1]:  # the pending row has met another context
            yield _batch(*[np.array([v]) for v in last[:-1]])
        # The batch's last row stays pending when it is the first of its bucket.
        pending = not same[-1]
        go[-1] = same[-1]
        yield _batch(h[go], c[go], c2[go], doc[go], p[go], a[go], b[go])
        last = [h[-1], c[-1], c2[-1], doc[-1], p[-1], a[-1], b[-1], pending]


_CONTEXT = "key long, key2 long, doc long, p int, lo int, hi int, left int, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the parts of every context: (doc, text, list of (h, p, a, b))."""
    for batch in batches:
        key, key2, docs, ps, los, his, lefts, data = [], [], [], [], [], [], [], []
        for doc, text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            buf = np.frombuffer(raw, np.uint8)
            hasher = Hasher(buf)
            h, p, a, b = (np.array([r[k] for r in rows], np.int64) for k in ("h", "p", "a", "b"))
            for right in (True, False):
                lo, hi = (p - b, np.minimum(p - a, MIDDLE)) if right else (np.maximum(p - b, MIDDLE + 1), p - a)
                k = np.flatnonzero(lo <= hi)
                if not len(k):
                    continue
                q = p[k]
                # Bytes that all of the part's suffixes share: right of the minimizer, or from the middle.
                s, e = (q, np.minimum(q + WIDTH - MIDDLE, len(raw))) if right else (q - MIDDLE - 1, q + WIDTH - REACH)
                two = _mix(hasher(s, e) + np.uint64(right))
                back = MIDDLE if right else REACH
                s, e = np.maximum(q - back, 0), np.minimum(q - back + PART, len(raw))
                key += h[k].tolist()
                key2 += two.view(np.int64).tolist()
                docs += [doc] * len(k)
                ps += q.tolist()
                los += lo[k].tolist()
                his += hi[k].tolist()
                lefts += (q - s).tolist()
                data += [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (key, key2, docs)] + [pa.array(x, pa.int32()) for x in (ps, los, his, lefts)] + [pa.array(data, pa.binary())],
            ["key", "key2", "doc", "p", "lo", "hi", "left", "bytes"],
        )


def multikey(flat: np.ndarray, start: np.ndarray, left: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings (indices into ``start``, by class) that share ``SHALLOW`` bytes with
    another of their class, and their new classes.

    Every pass parts all classes by a pivot of their own into strings with a
    less, an equal and a greater word of 8 bytes at the class's depth, keeping
    the order within each; the equal ones go 8 bytes deeper.
    """
    words = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))
    depth, deep = np.zeros(len(left), np.int64), []
    new = np.concatenate([[True], cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, bool)
    while len(left):
        go = ~(new & np.append(new[1:], True))  # those that are alone are done
        done = go & (depth >= SHALLOW)
        deep.append((left[done], new[done]))
        go &= ~done
        left, depth, new = left[go], depth[go], new[go]
        if not len(left):
            break
        first = np.flatnonzero(new)
        idx, sizes = np.cumsum(new) - 1, np.diff(np.append(first, len(left)))
        w = words[start[left] + depth].astype(np.uint64)
        pivot = np.sort(np.stack([w[first], w[first + sizes // 2], w[first + sizes - 1]]), axis=0)[1][idx]
        side = (w >= pivot).astype(np.int64) + (w > pivot)
        at, before = np.zeros(len(left), np.int64), first.copy()
        starts = np.zeros(len(left), bool)
        for k in range(3):
            mine = side == k
            run = np.cumsum(mine)
            rank = run - (run[first] - mine[first])[idx] - 1
            at[mine] = (before[idx] + rank)[mine]
            starts[at[mine & (rank == 0)]] = True
            before += np.add.reduceat(mine.astype(np.int64), first)
        moved, deeper = np.empty_like(left), np.empty_like(depth)
        moved[at], deeper[at] = left, depth + 8 * (side == 1)
        left, depth, new = moved, deeper, starts
    left, new = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*deep)) if deep else (left, new)
    return left, np.cumsum(new)


def deep_shallow(flat: np.ndarray, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which of the 100-byte strings ``flat[start:start+100]`` of a bucket equal an
    earlier one (in the order given) of that bucket.

    flat has 8 bytes or more behind the last string.
    """
    later = np.zeros(len(start), bool)
    left = np.argsort(bucket, kind="stable")
    left, cls = multikey(flat, start, left, bucket[left])
    rest = WIDTH - SHALLOW
    bytes_ = np.ndarray((len(flat) - rest + 1, rest), np.uint8, flat, strides=(1, 1))
    while len(left):  # blind tries: each node's members against its first leaf
        new = np.concatenate([[True], cls[1:] != cls[:-1]])
        alone = new & np.append(new[1:], True)
        left, cls, new = left[~alone], cls[~alone], new[~alone]
        if not len(left):
            break
        leaf = left[new][np.cumsum(new) - 1]
        lcp, nxt = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
        for x in range(0, len(left), 100_000):
            mine, its = bytes_[start[left[x : x + 100_000]] + SHALLOW], bytes_[start[leaf[x : x + 100_000]] + SHALLOW]
            differs = mine != its
            at = differs.argmax(axis=1)
            lcp[x : x + 100_000] = np.where(differs[np.arange(len(at)), at], at, rest)
            nxt[x : x + 100_000] = mine[np.arange(len(at)), at]
        later[left[(lcp == rest) & ~new]] = True
        go = lcp < rest
        left, code = left[go], (cls[go] * (rest + 1) + lcp[go]) * 256 + nxt[go]
        o = np.argsort(code, kind="stable")
        left, cls = left[o], code[o]
        cls = np.cumsum(np.concatenate([[0], cls[1:] != cls[:-1]])) if len(cls) else cls
    return later


def _sorted_batches(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows sorted by the keys), of about ``most`` rows."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held.append(t)
        n += t.num_rows
        if n < most:
            continue
        t = pa.concat_tables(held).combine_chunks()
        k = [np.asarray(t[c]) for c in keys]
        new = np.zeros(t.num_rows, bool)
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            yield t.slice(0, int(cut[-1]))
            t = t.slice(int(cut[-1]))
        held, n = [t], t.num_rows
    if n:
        yield pa.concat_tables(held).combine_chunks()


def _suffixes(t: pa.Table) -> tuple[np.ndarray, ...]:
    """flat bytes; and per suffix its row, offset and start in flat."""
    data = t["bytes"].to_pylist()
    size = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data) + bytes(WIDTH + 8), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    lo, hi, left = (np.asarray(t[c]).astype(np.int64) for c in ("lo", "hi", "left"))
    n = hi - lo + 1
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
    return flat, row, off, at[row] + left[row] - off


def _order(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
    """Removed intervals of the buckets; salted: and the suffixes still first."""
    keys = ["key", "key2", "salt"]
    for t in _sorted_batches(batches, keys, 8192):
        k = [np.asarray(t[c]) for c in keys]
        new = np.zeros(t.num_rows, bool)
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        group = np.cumsum(new)
        sizes = np.bincount(group)
        if not salted:
            alone = sizes[group] == 1
            if alone.any():
                t, group = t.filter(pa.array(~alone)).combine_chunks(), group[~alone]
        if not t.num_rows:
            continue
        flat, row, off, start = _suffixes(t)
        doc, p = np.asarray(t["doc"]).astype(np.int64), np.asarray(t["p"]).astype(np.int64)
        later = deep_shallow(flat, start, group[row] * 128 + off)
        gone = np.flatnonzero(later)
        s = p[row[gone]] - off[gone]
        yield _found(doc[row[gone]], s, None)
        if salted:
            first = np.flatnonzero(~later)
            raw = flat.tobytes()
            yield _found(doc[row[first]], p[row[first]] - off[first], [raw[x : x + WIDTH] for x in start[first].tolist()])


def _found(doc: np.ndarray, s: np.ndarray, string: list[bytes] | None) -> pa.RecordBatch:
    if string is None:  # runs of starts become one interval
        o = np.lexsort((s, doc))
        doc, s = doc[o], s[o]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + WIDTH)]) if len(s) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        ends = s[np.append(cut[1:] - 1, len(s) - 1)] + WIDTH if len(s) else s
        doc, s, e, string = doc[cut], s[cut], ends, [None] * len(cut)
    else:
        e = s + WIDTH
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(string, pa.binary())], ["doc", "a", "b", "string"])


_FOUND = "doc long, a long, b long, string binary"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, doc_id, text)``: rid orders the rows; doc_id itself if it can."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, known, top = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id")).first()
    twice = n == known and rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if n == known and not twice:
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256))
    return materialise(ordered.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")


def removals(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc, a, b)``: byte intervals of ``rows`` (rid, text) to remove."""
    spark = rows.sparkSession
    small_batches(spark)
    sent = rows.select("rid", "text").mapInArrow(_anchors, _ANCHOR)
    folded = sent.repartition("h").sortWithinPartitions("h", "c", "c2", "doc", "p").mapInArrow(_fold, _ANCHOR)
    folded = materialise(folded, "folded")
    removed = folded.where("p < 0").select("doc", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    open_ = folded.where("p >= 0").groupBy("doc").agg(F.collect_list(F.struct("h", "p", "a", "b")).alias("open"))
    joined = rows.join(open_.hint("shuffle_hash"), rows["rid"] == open_["doc"]).select("doc", "text", "open")
    ctx = materialise(joined.mapInArrow(_contexts, _CONTEXT), "contexts")
    big = ctx.groupBy("key", "key2").count().where(F.col("count") > hot)
    big = big.select("key", "key2", F.ceil(F.col("count") * 2 / hot).alias("parts"))
    n_big = big.count()
    cold = ctx if not n_big else ctx.join(big, ["key", "key2"], "left_anti")
    cold = cold.withColumn("salt", F.lit(0).cast("long"))
    by = ["key", "key2", "salt"]
    tidy = lambda df: df.repartition(*by).sortWithinPartitions(*by, "doc", "p")
    found = tidy(cold).mapInArrow(lambda x: _order(x, False), _FOUND).select("doc", "a", "b")
    out = removed.unionByName(found)
    if n_big:
        warm = ctx.join(big, ["key", "key2"]).withColumn("salt", F.pmod(F.xxhash64("doc"), "parts")).drop("parts")
        warm = materialise(tidy(warm).mapInArrow(lambda x: _order(x, True), _FOUND), "salted")
        out = out.unionByName(warm.where("string is null").select("doc", "a", "b"))
        first = warm.where("string is not null")
        least = first.groupBy("string").agg(F.min(F.struct("doc", "a")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = first.join(least, "string").where("doc <> m.doc or a <> m.a")
        out = out.unionByName(again.select("doc", "a", "b"))
    out = materialise(out, "removed")
    for t in (folded, ctx, warm) if n_big else (folded, ctx):
        release(t)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``; kept: the
    bytes that are left."""
    rows = numbered(docs, id_col, text_col)
    gone = removals(rows, hot)
    by = gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                s, e = merged(np.array([x["a"] for x in spans or []], np.int64), np.array([x["b"] for x in spans or []], np.int64))
                kept, at = [], 0
                for x, y in zip(s.tolist(), e.tolist()):
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                for to, v in zip(out, (len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept)):
                    to.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(by.hint("shuffle_hash"), rows["rid"] == by["doc"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every row of ``documents``."""
    return suffix_dedup(load(spark, sf_dir, "documents")).drop("kept")
