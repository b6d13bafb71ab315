"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is read as words; a word's input is a hashed word embedding next to the
mean of its hashed character n-gram embeddings.  Windows of ``WIDTH`` words, one
every ``STRIDE``, cover the whole text and overlap; each is read in both
directions by a gated recurrent layer, pooled by attention and scored.  A
document's score is that of its highest window, calibrated to a probability.

The network is trained in numpy on the driver: at most ``SAMPLE`` toxic and as
many clean labelled documents (those with the smallest hashed doc_id, folds
``crc32(doc_id) mod 5 <> 0`` only) train it.  Windows have no labels, so a toxic
document trains with its highest window (at first with any), a clean one with its
highest and random ones.  The highest window, in every round and for the
calibration, is that of all a document's windows, scored in Spark; random ones
are drawn from all of them, anew in every round.  The share of toxic documents
that the calibration supposes is that of the training folds' labels.  Only
texts are inputs of a score.  Scoring reads every window of every text.

Defined results: null or empty text is scored as a window without words; with
no labels of either kind in the folds the scores are 0; every row gives a row;
other columns are ignored or carried along, but for one with the score's name,
which the score replaces.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import load, materialise, release, small_batches, worker_state

WIDTH, STRIDE = 24, 12
SAMPLE = 3000
#: Random windows of a document before the first round, and of a clean one in each.
FIRST, DRAWN = 96, 16
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 15, 12, 12
WARM, ROUNDS, STEPS, BATCH, RATE = 150, 9, 50, 256, 0.01
#: Share of toxic documents, those with the lowest scores, that a round leaves out: labels err.
TRIM = 0.08
#: Share of clean windows that train as a repeated word; decay of embeddings a step.
STUTTER, DECAY = 0.2, 0.001
#: Errors above the least that a cut may have and still count as one of the best.
SLACK = 0.005
_CACHE = 150_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"\w(?:.*\w)?", re.DOTALL)
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts' ``words`` as numbers, where each text's begin (and the last's end),
    and the different words by number."""
    lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    flat = pc.dictionary_encode(lists.values)
    ids, vocab = flat.indices.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    some = ids != (vocab.index("") if "" in vocab else -1)  # space at a text's ends gives empty ones
    return ids[some], np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy()], vocab


def features(tokens: list[str], block: int = 16384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_features`` in blocks, so that its working memory stays bounded."""
    parts = [_features(tokens[a : a + block]) for a in range(0, len(tokens), block)] or [_features([])]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each token, and its n-gram buckets as a flat array with
    the number of n-grams of each token.  N-grams are runs of 3 to 5 bytes of
    the token between two marks; punctuation at its edges doesn't count."""
    raw = [b"\x02" + (t if t.isalnum() or not (core := _CORE.search(t)) else core[0]).encode() + b"\x03" for t in tokens]
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw) + bytes(5), np.uint8).astype(np.uint64) + np.uint64(1)
    end = np.repeat(np.cumsum(size), size)
    n = len(end)
    h, grams = np.zeros(n, np.uint64), np.empty((n, 3), np.int32)
    for k in range(1, 6):
        h = (h + buf[k - 1 : n + k - 1]) * _A
        h ^= h >> np.uint64(29)
        if k > 2:
            grams[:, k - 3] = (h * _C) >> np.uint64(64 - GRAMS.bit_length() + 1)
    inside = (end - np.arange(n))[:, None] >= np.arange(3, 6)
    # The word's own hash: a sum over its bytes of position and byte, mixed.
    at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    cell = (buf[:n] * _C + at.astype(np.uint64) * _A) * (buf[:n] | np.uint64(1))
    cell ^= cell >> np.uint64(31)
    cell *= _C
    word = np.add.reduceat(cell, np.cumsum(size) - size) if n else np.zeros(0, np.uint64)
    word = ((word ^ (word >> np.uint64(32))) * _A) >> np.uint64(64 - WORDS.bit_length() + 1)
    return word.astype(np.int32), grams[inside], np.maximum(size[:, None] - np.arange(2, 5), 0).sum(axis=1)


def project_all(p: dict, word: np.ndarray, gram: np.ndarray, n: np.ndarray, block: int = 8192) -> np.ndarray:
    """Input projections of many words, in blocks."""
    out, end = np.zeros((2, len(word), 3 * HIDDEN), np.float32), np.concatenate([[0], np.cumsum(n)])
    for a in range(0, len(word), block):
        z = min(len(word), a + block)
        out[:, a:z] = project(p, embed(p, word[a:z], gram[end[a] : end[z]], n[a:z]))
    return out


def embed(p: dict, word: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([p["Ew"][word], gram_sums(p["Ec"], gram, n) / n[:, None]], axis=1).astype(np.float32)


def gram_sums(table: np.ndarray, gram: np.ndarray, n: np.ndarray, most: int = 64) -> np.ndarray:
    """Sums of each word's n-gram rows: the k-th n-grams of all words together,
    but for words of more than ``most``."""
    out, first, long = np.zeros((len(n), table.shape[1]), table.dtype), np.cumsum(n) - n, n > most
    if long.any():
        size = n[long]
        out[long] = np.add.reduceat(np.take(table, gram[np.repeat(long, n)], axis=0), np.cumsum(size) - size, axis=0)
    order = np.argsort(-n, kind="stable")[long.sum() :]
    first, acc = first[order], np.zeros((len(order), table.shape[1]), table.dtype)
    for k, live in enumerate(np.searchsorted(-n[order], -np.arange(most), "left")):
        if not live:
            break
        acc[:live] += np.take(table, gram[first[:live] + k], axis=0)
    out[order] = acc
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int = 7) -> dict:
    """Parameters before training; leading axis 2: forward and backward."""
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    d, h = 2 * DIM, HIDDEN
    return {
        "Ew": np.zeros((WORDS, DIM), np.float32), "Ec": f(GRAMS, DIM, scale=0.1),
        "W": f(2, d, 3 * h, scale=d**-0.5), "U": f(2, h, 3 * h, scale=h**-0.5), "b": np.zeros((2, 1, 3 * h), np.float32),
        "A": f(2 * h, h, scale=(2 * h) ** -0.5), "v": f(h, scale=h**-0.5), "w": f(2 * h, scale=(2 * h) ** -0.5), "c": np.zeros(1, np.float32),
    }


def forward(p: dict, gx: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows.  gx: (2, n, width, 3 hidden), the inputs' projections,
    the second direction's in reverse; mask: (n, width), 1 where there's a word."""
    _, n, t, _ = gx.shape
    h, hid = np.zeros((2, n, HIDDEN), np.float32), HIDDEN
    out, memo = np.zeros((t, 2, n, hid), np.float32), []
    both = np.stack([mask, mask[:, ::-1]]).astype(np.float32)
    ragged = bool((mask == 0).any())
    for k in range(t):
        g = gx[:, :, k]
        u = np.matmul(h, p["U"])
        rz = _sigmoid(g[..., : 2 * hid] + u[..., : 2 * hid])
        r, z = rz[..., :hid], rz[..., hid:]
        new = np.tanh(g[..., 2 * hid :] + r * u[..., 2 * hid :])
        nxt = new + z * (h - new)
        if ragged:
            nxt = h + both[:, :, k, None] * (nxt - h)
        if keep:
            memo.append((h, r, z, new, u[..., 2 * hid :]))
        out[k] = h = nxt
    seq = np.concatenate([out[:, 0], out[::-1, 1]], axis=-1)  # (width, n, 2 hidden)
    a = np.tanh(seq @ p["A"])
    e = np.where(mask.T > 0, a @ p["v"], -30)
    e = np.exp(e - e.max(axis=0))
    e *= mask.T > 0
    att = e / np.maximum(e.sum(axis=0), 1e-9)
    pool = np.einsum("tn,tnd->nd", att, seq)
    logit = pool @ p["w"] + p["c"][0]
    return logit, {"memo": memo, "seq": seq, "a": a, "att": att, "pool": pool, "both": both} if keep else {}


def backward(p: dict, x: np.ndarray, s: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the inputs x (n, width, 2 dim)."""
    hid, (n, t, _) = HIDDEN, x.shape
    g = {"w": s["pool"].T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["w"]
    dseq = s["att"][:, :, None] * dpool
    datt = np.einsum("tnd,nd->tn", s["seq"], dpool)
    de = s["att"] * (datt - (s["att"] * datt).sum(axis=0))
    g["v"] = np.einsum("tn,tnh->h", de, s["a"])
    da = de[:, :, None] * p["v"] * (1 - s["a"] ** 2)
    g["A"] = np.einsum("tnd,tnh->dh", s["seq"], da)
    dseq = dseq + da @ p["A"].T
    dout = np.stack([dseq[..., :hid], dseq[::-1, :, hid:]], axis=1)  # (width, 2, n, hidden)
    dgx, dh = np.zeros((2, n, t, 3 * hid), np.float32), np.zeros((2, n, hid), np.float32)
    g["U"] = np.zeros_like(p["U"])
    ut = p["U"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        h, r, z, new, un = s["memo"][k]
        m = s["both"][:, :, k, None]
        dh = dh + dout[k]
        d = dh * m
        dz, dnew = d * (h - new), d * (1 - z)
        dn = dnew * (1 - new**2)
        dr = dn * un
        dg = np.concatenate([dr * r * (1 - r), dz * z * (1 - z), dn], axis=-1)
        du = dg.copy()
        du[..., 2 * hid :] *= r
        g["U"] += np.matmul(h.transpose(0, 2, 1), du)
        dh = dh * (1 - m) + d * z + np.matmul(du, ut)
        dgx[:, :, k] = dg
    rev = np.stack([x, x[:, ::-1]])
    flat = dgx.reshape(2, n * t, -1)
    g["W"] = np.matmul(rev.reshape(2, n * t, -1).transpose(0, 2, 1), flat)
    g["b"] = flat.sum(axis=1, keepdims=True)
    dx = np.matmul(flat, p["W"].transpose(0, 2, 1)).reshape(2, n, t, -1)
    return g, dx[0] + dx[1][:, ::-1]


def sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def project(p: dict, x: np.ndarray) -> np.ndarray:
    """Input projections of words for both directions: (2, n, 3 hidden)."""
    return np.matmul(x[None], p["W"]) + p["b"]


def eased(p: dict) -> dict:
    """Parameters as ``score_windows`` takes them: a gate's inputs negated, those
    of a tangent doubled as well, so that both are an exponential and a division."""
    by = np.repeat(np.array([-1, -1, -2], np.float32), HIDDEN)
    return p | {"W": p["W"] * by, "b": p["b"] * by, "U": p["U"] * by, "A": p["A"] * np.float32(-2), "v": p["v"] * np.float32(2)}


def score_windows(q: dict, table: np.ndarray, ids: np.ndarray, block: int = 1024) -> np.ndarray:
    """Logits of windows of word ids (-1: none) into a table of projections, as
    ``forward`` gives them, with fewer passes over memory.  q: ``eased`` parameters,
    by which the table is made too.  Windows lie along the last axis throughout."""
    out, hid, (_, width) = np.zeros(len(ids), np.float32), HIDDEN, ids.shape
    ut, at_ = np.ascontiguousarray(q["U"].transpose(0, 2, 1)), np.ascontiguousarray(q["A"].T)
    with np.errstate(over="ignore"):  # an infinite exponential is a gate of 0
        for a in range(0, len(ids), block):
            w = np.ascontiguousarray(ids[a : a + block].T)
            n, at, none = w.shape[1], np.maximum(w, 0), w < 0
            ragged, gone = bool(none.any()), none.astype(np.float32)
            seq, h, row = np.empty((width, 2 * hid, n), np.float32), np.zeros((2, hid, n), np.float32), np.empty((2, n, 3 * hid), np.float32)
            u, g = np.empty((2, 3 * hid, n), np.float32), np.empty((2, 3 * hid, n), np.float32)
            rz, new, r, z = u[:, : 2 * hid], u[:, 2 * hid :], u[:, :hid], u[:, hid : 2 * hid]
            for k in range(width):
                back = width - 1 - k
                np.take(table[0], at[k], axis=0, out=row[0], mode="clip")
                np.take(table[1], at[back], axis=0, out=row[1], mode="clip")
                np.copyto(g, row.transpose(0, 2, 1))
                np.matmul(ut, h, out=u)
                rz += g[:, : 2 * hid]
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                new *= r
                new += g[:, 2 * hid :]
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                if ragged:  # without a word the state stays
                    np.maximum(z[0], gone[k], out=z[0])
                    np.maximum(z[1], gone[back], out=z[1])
                h -= new
                h *= z
                h += new
                seq[k, :hid], seq[back, hid:] = h
            e = np.matmul(at_, seq)
            np.exp(e, out=e)
            e += 1
            np.reciprocal(e, out=e)
            e = np.matmul(q["v"], e)  # but for a constant, which falls out
            if ragged:
                e[none] = -np.inf
                e[0, none.all(axis=0)] = 0
            e = np.exp(e - e.max(axis=0))
            out[a : a + block] = (e * np.matmul(q["w"], seq)).sum(axis=0) / e.sum(axis=0) + q["c"][0]
    return out


def windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text's word ids, the last padded with -1."""
    return cells(ids, *places(np.array([0, len(ids)]))[1:])


def places(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words begin at ``start`` (its last entry: their end): how many
    windows each has, where each window begins, and where its text ends."""
    size = np.diff(start)
    n = np.where(size > 0, np.maximum(1, -(-(size - WIDTH + STRIDE) // STRIDE)), 0)
    return n, np.repeat(start[:-1] - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(n.sum()), np.repeat(start[1:], n)


def cells(ids: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows' word ids, -1 beyond their texts' ends."""
    at = low[:, None] + np.arange(WIDTH)
    return np.where(at < end[:, None], np.take(ids, at, mode="clip"), -1).astype(np.int32) if len(low) else np.zeros((0, WIDTH), np.int32)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict, rate: float) -> None:
        self.t += 1
        for k, v in g.items():
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.001 * (v * v - self.s[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-7)


class Words:
    """Windows as word ids, with the words' features."""

    def __init__(self, lines: list[str]):
        vocab: dict[str, int] = {}
        get, flat = vocab.setdefault, array("i")
        for line in lines:
            tokens = line.split(" ")
            flat.extend([get(t, len(vocab)) for t in tokens])
            flat.extend([-1] * (WIDTH - len(tokens)))
        self.ids = np.array(flat, np.int32).reshape(-1, WIDTH)
        self.word, self.gram, self.n = features(list(vocab))
        self.first = np.cumsum(self.n) - self.n


#: Of each document with words: number, the highest window's logit and line, random windows' lines.
Looked = list[tuple[int, float, str, list[str]]]


def train(toxic: np.ndarray, look: Callable[[dict | None, int], Looked], share: float = 0.1, seed: int = 7) -> dict | None:
    """Parameters from documents' labels and their windows.

    look: gives the highest window by parameters (none before the first round)
    and random ones, of all windows, in the round of that number.
    share: of toxic documents among all, for the calibration.
    """
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    rng, p = np.random.default_rng(seed), fresh(seed)
    adam = Adam(p, RATE)
    held = rng.random(len(toxic)) < 0.2  # for the calibration
    seen = look(None, 0)
    with_words = np.array([d for d, *_ in seen], np.int64)
    kinds = lambda at: {bool(t) for t in toxic[at]}
    if len(kinds(with_words[~held[with_words]])) < 2:
        held[:] = False
        if len(kinds(with_words)) < 2:
            return None

    def step(x: Words, at: np.ndarray, y: np.ndarray, rate: float) -> None:
        w = x.ids[at]
        # Some clean windows are turned into one of their words, again and again.
        stutter = (y == 0) & (rng.random(len(at)) < STUTTER)
        w[stutter] = w[stutter, rng.integers(0, 6, len(at))[stutter]][:, None]
        used, inv = np.unique(np.maximum(w, 0), return_inverse=True)
        inv = inv.reshape(w.shape)
        flat = np.concatenate([x.gram[x.first[u] : x.first[u] + x.n[u]] for u in used])
        n = x.n[used]
        x_used = embed(p, x.word[used], flat, n)
        # Whole inputs are dropped now and then, so that no single feature carries a word.
        drop = (rng.random((len(used), 2)) > np.array([0.5, 0.1])).astype(np.float32).repeat(DIM, axis=1)
        x_used = x_used * drop
        rows, mask = x_used[inv], (w >= 0).astype(np.float32)
        gx = project(p, rows.reshape(-1, 2 * DIM)).reshape(2, len(at), WIDTH, -1)
        gx[1] = gx[1][:, ::-1]
        logit, s = forward(p, gx, mask, True)
        d = ((_sigmoid(logit) - y) / len(at)).astype(np.float32)
        g, dx = backward(p, rows, s, d)
        du = sums(inv.ravel(), (dx * mask[:, :, None]).reshape(-1, 2 * DIM), len(used)) * drop
        g["Ew"] = sums(x.word[used], du[:, :DIM], WORDS)
        g["Ec"] = sums(flat, np.repeat(du[:, DIM:] / n[:, None], n, axis=0), GRAMS)
        adam.step(g, rate)
        p["Ew"] *= 1 - DECAY
        p["Ec"] *= 1 - DECAY

    half = BATCH // 2
    y = np.repeat(np.array([1, 0], np.float32), half)
    lines = [(d, line) for d, _, _, drawn in seen if not held[d] for line in drawn]
    of = toxic[[d for d, _ in lines]]
    x, pos, neg = Words([line for _, line in lines]), np.flatnonzero(of), np.flatnonzero(~of)
    del seen, lines
    for _ in range(WARM):
        step(x, np.concatenate([rng.choice(pos, half), rng.choice(neg, half)]), y, RATE)
    for k in range(ROUNDS):
        seen = [r for r in look(p, k + 1) if not held[r[0]]]
        of, s = toxic[[r[0] for r in seen]], np.array([r[1] for r in seen])
        drawn = [line for r, t in zip(seen, of) if not t for line in r[3]]
        x = Words([r[2] for r in seen] + drawn)
        hard, neg = np.flatnonzero(~of), len(seen) + np.arange(len(drawn))
        high = np.flatnonzero(of & (s >= np.quantile(s[of], TRIM)))
        del seen, drawn
        for _ in range(STEPS):
            step(x, np.concatenate([rng.choice(high, half), rng.choice(hard, half // 2), rng.choice(neg, half - half // 2)]), y, RATE * (1 - k / ROUNDS) + 1e-4)
    best = np.full(len(toxic), p["c"][0], np.float64)
    for d, s, *_ in look(p, -1):
        best[d] = s
    use = held if toxic[held].any() and not toxic[held].all() else np.ones(len(toxic), bool)
    p["cal"] = calibrate(best[use], toxic[use], share)
    return p


def calibrate(logit: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Slope and offset of the logistic curve of label by logit.  The offset puts
    a score of 0.5 midway in the cuts with nearly the fewest errors at the given share."""
    cut = np.unique(logit)
    cut = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
    a, b = np.sort(logit[toxic]), np.sort(logit[~toxic])
    wrong = share * np.searchsorted(a, cut) / len(a) + (1 - share) * (1 - np.searchsorted(b, cut) / len(b))
    best = np.flatnonzero(wrong <= wrong.min() + SLACK)
    low, high = cut[best[0]], cut[best[-1]]
    at = (low + high) / 2
    spread = max(1e-3, np.abs(np.median(a) - np.median(b)))
    slope = 8 / spread
    return np.array([slope, -slope * at])


class Scorer:
    """Scores texts with the words' input projections kept in a table."""

    def __init__(self, p: dict):
        self.p, self.q, self.ids, self.n = p, eased(p), {}, 0
        self.table = np.zeros((2, _CACHE, 3 * HIDDEN), np.float32)  # memory is taken as it fills

    def _learn(self, new: list[str]) -> None:
        gx = project_all(self.q, *features(new))
        while self.n + len(new) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, self.n : self.n + len(new)] = gx
        self.ids.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A probability for each text."""
        slope, offset = self.p["cal"]
        best = np.full(len(texts), self.p["c"][0], np.float64)
        for some, s, *_ in self._highest(texts):
            best[some] = s
        return _sigmoid(slope * best + offset)

    def highest(self, texts: list[str]) -> list[tuple[float, list[str]] | None]:
        """The logit and the words of each text's highest window; None without words."""
        out: list = [None] * len(texts)
        for some, s, low, end, word, vocab in self._highest(texts):
            for k, *x, a, z in zip(some.tolist(), s.tolist(), low, end):
                out[k] = (*x, [vocab[w] for w in word[a : min(z, a + WIDTH)]])
        return out

    def _highest(self, texts: list[str]) -> Iterator[tuple]:
        """In portions: numbers of the texts with words, their highest windows'
        logits, begins and ends of text; words as numbers, and the different ones."""
        size = np.cumsum([len(t) for t in texts]) >> 18
        for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1) if len(texts) else ():
            word, start, vocab = numbered([texts[k] for k in group])
            n, low, end = places(start)
            if len(low):
                s, first = self._logits(word, low, end, vocab), np.cumsum(n) - n
                some = np.flatnonzero(n)
                top = np.maximum.reduceat(s, first[some])
                hit = np.flatnonzero(~(s < np.repeat(top, n[some])))  # the first of equals
                at = hit[np.searchsorted(hit, first[some])]
                yield group[some], top, low[at], end[at], word, vocab

    def _logits(self, word: np.ndarray, low: np.ndarray, end: np.ndarray, vocab: list[str], block: int = 4096) -> np.ndarray:
        """Logits of windows, so many at a time."""
        out, at = np.empty(len(low), np.float32), np.fromiter(map(self.ids.get, vocab, repeat(-1)), np.int32, len(vocab))
        for a in range(0, len(low), block):
            w, used = cells(word, low[a : a + block], end[a : a + block]), np.zeros(len(vocab) + 1, bool)
            used[w] = True  # the last: no word
            used = np.flatnonzero(used[:-1])
            new = used[at[used] < 0]
            if self.n + len(new) > _CACHE:
                self.ids, self.n, new = {}, 0, used
                at[:] = -1
            if len(new):
                at[new] = np.arange(self.n, self.n + len(new))
                self._learn([vocab[k] for k in new])
            out[a : a + block] = score_windows(self.q, self.table, np.where(w < 0, -1, at[w]))
        return out


def sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` toxic and clean labelled ids of the training folds."""
    rows = labels.where("doc_id is not null and toxic is not null").where(fold_of() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    one = lambda k: rows.where(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return one(1).unionByName(one(0))


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def drawn(tokens: list[str], many: int, seed: tuple[int, ...]) -> list[str]:
    """Lines of at most ``many`` random windows of all that a text has."""
    n = max(1, -(-(len(tokens) - WIDTH + STRIDE) // STRIDE)) if tokens else 0
    at = range(n) if n <= many else np.random.default_rng(seed).choice(n, many, replace=False).tolist()
    return [" ".join(tokens[k * STRIDE : k * STRIDE + WIDTH]) for k in at]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> dict | None:
    """The trained parameters; None without labels of both kinds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    picked = rows.join(F.broadcast(sample(labels, most)), F.col("_doc") == F.col("_id")).select("_id", "toxic", "text")
    # At most twice ``most`` documents: spread over all cores, and read again in every round.
    parts = 2 * spark.sparkContext.defaultParallelism
    picked = materialise(picked.repartition(parts, "_id").sortWithinPartitions("_id", "text"), "picked")
    known = sorted(map(tuple, picked.groupBy("_id").agg(F.max("toxic")).collect()))
    place = {who: k for k, (who, _) in enumerate(known)}

    def look(p: dict | None, k: int) -> Looked:
        held = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = Scorer(held.value) if held.value else None
            for b in batches:
                out: tuple[list, ...] = ([], [], [], [])
                rows = [b.column(k).to_pylist() for k in range(3)]
                texts = [t or "" for t in rows[2]]
                tops = c.highest(texts) if c else repeat((0.0, []))
                for who, toxic, text, best in zip(*rows[:2], texts, tops):
                    many = FIRST if k == 0 else DRAWN if k > 0 and not toxic else 0
                    some = drawn(words(text), many, (who & 0xFFFFFFFFFFFFFFFF, k)) if many else []
                    if best and (some or c is not None):
                        for to, v in zip(out, (who, best[0], " ".join(best[1]), some)):
                            to.append(v)
                kinds = (pa.int64(), pa.float64(), pa.string(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["id", "logit", "line", "drawn"])

        got = picked.mapInArrow(run, "id long, logit double, line string, drawn array<string>").toArrow()
        held.destroy()
        best: dict[int, list] = {}  # rows of one id are one document
        for who, s, line, some in sorted(zip(*(got[c].to_pylist() for c in ("id", "logit", "line", "drawn")))):
            old = best.get(who)
            best[who] = [s, line, (old[2] if old else []) + some]
        return [(place[who], *x) for who, x in best.items()]

    of = F.avg((F.col("toxic") == 1).cast("double"))
    share = labels.where("doc_id is not null").where(fold_of() != 0).agg(of).first()[0]
    p = train(np.array([t == 1 for _, t in known], bool), look, min(0.5, max(0.01, share or 0.1)))
    release(picked)
    return p


def scored(docs: DataFrame, p: dict | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out`` behind its own, in place of one of that name."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()])
    held, key = spark.sparkContext.broadcast(p), uuid.uuid4().hex
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            texts = ["" if t is None else t for t in b.column(at).to_pylist()]
            s = worker_state(key, lambda: Scorer(p))(texts) if p else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(s, np.float64))], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every row of ``documents``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    p = fit(docs, load(spark, sf_dir, "labels"))
    return scored(docs, p).select(
        "doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
