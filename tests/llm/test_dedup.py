import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from geostrata.llm import exact_dedup as E
from geostrata.llm import simhash as H
from geostrata.llm import suffix_dedup as D
from geostrata.llm.common import components

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(SPACE.sub("", t).encode()).hexdigest()].append((-len(t), i is None, i or 0, i))
    return Counter((g[0][3], g[0][3], len(g), True, k) for k, g in ((k, sorted(g, key=lambda r: r[:3])) for k, g in groups.items())) + Counter(
        (r[3], g[0][3], len(g), False, k) for k, g in ((k, sorted(g, key=lambda r: r[:3])) for k, g in groups.items()) for r in g[1:]
    )


def test_exact_odd(odd):
    got = Counter(tuple(r) for r in E.exact_dedup(odd).collect())
    assert got == exact_brute(pairs(odd))


def test_exact_many(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) + " " * rng.randint(0, 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in E.exact_dedup(df).collect()) == exact_brute(rows)


def test_exact_keeps_one_row_of_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (None, "x"), (None, "x"), (2, "x "), (2, "x ")]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == exact_brute(rows) and sum(r["kept"] for r in got) == 2


def test_exact_against_a_kept_history(spark, tmp_path):
    old = [(i, "ab"[i % 2] * (i % 40)) for i in range(300)]
    new = [(1000 + i, "abc"[i % 3] * (i % 50) + " " * (i % 2)) for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    E.save_index(frame(old), str(tmp_path / "index"))
    got = E.exact_dedup(frame(new), index=spark.read.parquet(str(tmp_path / "index")))
    want = Counter({r: n for r, n in exact_brute(old + new).items() if r[0] >= 1000})
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("most", [3, 50])
def test_lookup_in_parts(spark, most):
    rows = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(400)], "doc_id long, text string")
    rows = E.digests(rows).withColumn("row", E.F.monotonically_increasing_id())
    whole, old = E.fold(rows), rows.where("id % 3 = 0")
    got = E.lookup(E.build_index(E.fold(old)), E.fold(rows.where("id % 3 > 0")), most)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got.select("digest", "keep_len", "keep_id", "keep_row", "group_size")) == key(whole)
    assert got.where("member").count() == E.fold(old).count()


def test_exact_empty(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_is_minimal_and_byte_checked():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    h = E.PerfectHash.build(keys)
    assert h.n_overflow == 0 and sorted(h.slots(keys).tolist()) == list(range(5000))
    same = np.repeat(keys[:1], 3, axis=0)  # keys that no level can part go to the overflow
    assert E.PerfectHash.build(same).n_overflow == 3


def fingerprint_brute(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = WORD.findall(t)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_brute(fps):
    """Smallest id of each row's component, by all pairs."""
    n, up = len(fps), list(range(len(fps)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                up[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(n):
        if fps[i][0] is not None:
            low[find(i)].append(fps[i][0])
    return [min(low[find(i)], default=None) for i in range(n)]


def test_simhash_odd(odd):
    rows = pairs(odd)
    fps = [(i, fingerprint_brute(t)) for i, t in rows]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(fps, component_brute(fps)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in H.near_duplicates(odd).collect()) == want


def clustered(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            f = base
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randint(0, 63)
            out.append(f)
    return list(dict.fromkeys(out))[:n]


@pytest.mark.parametrize("bits, split", [(1, H.SPLIT), (2, H.SPLIT), (3, H.SPLIT), (3, 8), (2, 40)])
def test_links_by_tree_are_all_links(spark, bits, split):
    fps = clustered(700, bits)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components(H.links(df, bits, split), "a", "b").collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = component_brute([(s, f) for s, f in zip(signed, fps)])
    assert [roots.get(s, s) for s in signed] == want


@pytest.mark.parametrize("leaf", [2, 16, 500])
def test_tree_search_is_exact(leaf):
    fps = np.array(clustered(400, 9), np.uint64)
    near = fps[:1] ^ np.array([1 << k for k in range(40)], np.uint64)  # a dense ball: linked as a whole
    fps = np.concatenate([fps, near])
    f = H.Forest(len(fps))
    H.search(fps, np.arange(len(fps)), np.arange(len(fps)), f, leaf=leaf)
    want = component_brute([(i, int(x)) for i, x in enumerate(fps)])
    assert f.roots(np.arange(len(fps))).tolist() == want


def test_dense_template_is_linked_fast():
    rng = np.random.default_rng(3)
    fps = np.zeros(30_000, np.uint64)
    for _ in range(5):  # up to five of 64 bits differ from the template
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    fps, began = np.unique(fps), time.process_time()
    a, b = H.shard_links(fps, np.ones(len(fps), bool), np.ones(len(fps), bool))
    assert time.process_time() - began < 60 and (np.bitwise_count(fps[0] ^ fps) <= 4).sum() <= len(a) + 1


def test_simhash_empty(spark):
    assert H.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def suffix_brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def suffix_got(df, hot=D.HOT):
    return Counter(tuple(r) for r in D.suffix_dedup(df, hot=hot).drop("kept").collect())


def test_suffix_odd(odd):
    assert suffix_got(odd) == suffix_brute(pairs(odd))


@pytest.mark.parametrize("hot", [4, D.HOT])
def test_suffix_shared_passages(spark, hot):
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(4)] + ["ab" * 90, "x" * 130]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(" ".join(word() for _ in range(rng.randint(0, 25))))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 3)
                parts.append(p[a : a + rng.randint(90, 400)])
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert suffix_got(df, hot) == suffix_brute(rows)


def test_suffix_empty(spark):
    assert D.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minimizers_of_blocks_agree(monkeypatch):
    buf = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    whole = D.minimizers(buf)
    monkeypatch.setattr(D, "BLOCK", 700)
    split = D.minimizers(buf)
    a = {(p, s) for p, x, y in zip(*whole[:3]) for s in range(x, y + 1)}
    b = {(p, s) for p, x, y in zip(*split[:3]) for s in range(x, y + 1)}
    assert a == b and {s for _, s in a} == set(range(4901))


def test_deep_shallow_against_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(97, 99, (6, 100)).astype(np.uint8)
    rows = base[rng.integers(0, 6, 300)].copy()
    for r in rows[:150]:
        r[rng.integers(0, 100)] ^= 1
    flat = np.concatenate([rows.ravel(), np.zeros(16, np.uint8)])
    bucket = rng.integers(0, 3, 300)
    got = D.deep_shallow(flat, np.arange(300) * 100, bucket)
    seen, want = set(), []
    for k, r in enumerate(rows):
        key = (bucket[k], r.tobytes())
        want.append(key in seen)
        seen.add(key)
    assert got.tolist() == want
