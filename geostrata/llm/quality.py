"""Quality rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are compared: the *target*,
from trusted documents, and the *raw* one, from every document.  A document's
score is the mean over its n-grams of ``log p_target - log p_raw``, both with
add-``ALPHA`` smoothing, so its length doesn't matter.  It is kept when its
score reaches one threshold: the point that best separates trusted from
distrusted labelled documents that the target has not seen (of equal points
the lowest).  With no distrusted ones, the threshold is the least trusted score.

The raw counts cover all words of all documents.  The trusted target is fitted
on at most ``SAMPLE`` trusted labelled rows, those with the smallest hashed
doc_id; it is the only part that a bound touches.  A label's fold is
``crc32(doc_id) mod 5``: all of fold 0 sets the threshold, by counts of its
scores in steps of 1 / ``GRID``; the others the target.

Defined results: null text counts as empty; a document under 20 words or with
more than 30 % of its words in repeated 8-word windows fails the base rule and
isn't kept; without any labels the method keeps all others; repeated rows are
rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, load, small_batches

BUCKETS, ALPHA, SAMPLE, WINDOW, GRID = 1 << 16, 0.5, 20_000, 8, 1 << 14
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """Word to 64-bit hash, kept for the words met."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        b = word.encode()
        v = self[word] = (zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)) & 0xFFFFFFFFFFFFFFFF
        return v


_hashes = _Hashes()


def hashed(words: list[str]) -> np.ndarray:
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def ngrams(h: np.ndarray) -> np.ndarray:
    """Buckets of the unigrams and bigrams of hashed words."""
    two = ((h[:-1] * _B + h[1:]) ^ _C) * _A
    return (np.concatenate([h * _A, two]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def repeat_words(words: list[str], h: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first included."""
    m = len(words) - width + 1
    if m < 2:
        return 0
    w = np.zeros(m, np.uint64)
    for k in range(width):
        w = w * _A + h[k : k + m]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    seen = Counter(tuple(words[i : i + width]) for i in at.tolist())
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def features(text: str) -> tuple[list[str], np.ndarray, tuple[int, int, int, int, int]]:
    """Words, their hashes, and the base figures of a text."""
    words = _WORD.findall(text)
    h = hashed(words)
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACE):
                seen.add(line)
    chars = len(text) - sum(map(text.count, SPACE))
    return words, h, (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words, h))


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled ids with role 1 (target, at most ``sample``), 2 or 3 (trusted and
    distrusted, for the threshold: all)."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    good = F.col("quality") == 1
    role = F.when(fold > 0, F.when(good, 1).otherwise(0)).otherwise(F.when(good, 2).otherwise(3))
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.select(F.col("doc_id").cast("long").alias("_id"), role.cast("int").alias("role"))
    return rows.where("role = 1").orderBy(F.xxhash64("_id"), "_id").limit(sample).unionByName(rows.where("role > 1"))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Target and raw counts of every bucket, over all rows (text, role)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, role in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    n = np.bincount(ngrams(hashed(_WORD.findall(text))), minlength=BUCKETS) if len(text) > 4000 else None
                    at = None if n is not None else ngrams(hashed(_WORD.findall(text)))
                    for to in (raw, target) if role == 1 else (raw,):
                        if n is not None:
                            to += n
                        else:
                            np.add.at(to, at, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(target[at]), pa.array(raw[at])], ["bucket", "target", "raw"])

    got = rows.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, t, r in got:  # at most one row a bucket
        target[b], raw[b] = t, r
    return target, raw


def ratio(target: np.ndarray, raw: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """log p_target - log p_raw of every bucket; zeros if the target is empty."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + alpha) / (target.sum() + alpha * len(target))) - np.log((raw + alpha) / (raw.sum() + alpha * len(raw)))


def threshold(good: np.ndarray, bad: np.ndarray, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """The score that best separates the two, by the sum of their error rates;
    n_good, n_bad: how often each score is there, once if not given."""
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(good.min())

    def below(x: np.ndarray, n: np.ndarray | None, cut: np.ndarray) -> np.ndarray:
        o = np.argsort(x)
        total = np.concatenate([[0], np.cumsum(np.ones(len(x)) if n is None else n[o])])
        return total[np.searchsorted(x[o], cut)] / total[-1]

    cut = np.unique(good)
    best = below(good, n_good, cut) + (1 - below(bad, n_bad, cut))
    at = cut[int(np.flatnonzero(best <= best.min())[0])]
    under = bad[bad < at]
    return float((at + under.max()) / 2) if len(under) else float(at)


def score(h: np.ndarray, llr: np.ndarray) -> float:
    return float(llr[ngrams(h)].mean()) if len(h) else 0.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The buckets' log ratios and the threshold."""
    small_batches(docs.sparkSession)
    known = labelled(labels, sample)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("_doc"))
    joined = rows.join(F.broadcast(known.where("role = 1")), F.col("_doc") == F.col("_id"), "left")
    llr = ratio(*_counts(joined.select("text", F.coalesce("role", F.lit(-1)).alias("role"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [score(hashed(_WORD.findall(t or "")), llr) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], ["role", "score"])

    # Labels of fold 0 have no bound: no broadcast is forced, and only counts of scores are collected.
    held = rows.join(known.where("role > 1"), F.col("_doc") == F.col("_id")).select("text", "role")
    step = F.floor(F.col("score") * GRID).alias("step")
    got = held.mapInArrow(run, "role int, score double").groupBy("role", step).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    # A step's trusted scores count as its lowest, the distrusted ones as its highest.
    good, n_good = (np.array([x[k] for x in got if x["role"] == 2]) for k in ("low", "n"))
    bad, n_bad = (np.array([x[k] for x in got if x["role"] == 3]) for k in ("high", "n"))
    return llr, threshold(good, bad, n_good, n_bad)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Every row's base figures, verdict and score."""
    llr, least = fit(docs, labels, id_col, text_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                _, h, f = features(t or "")
                s = score(h, llr)
                failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
                out.append((*f, failed, not failed and s >= least, s))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of all ``documents``."""
    return quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures of all ``documents``."""
    return query(spark, sf_dir).drop("kept", "score")


PART_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(8) AS g(o) GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN hit USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
"""
