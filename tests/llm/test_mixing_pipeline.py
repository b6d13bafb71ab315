import random
from collections import Counter, defaultdict

import pytest

from geostrata.llm import mixing


def targets_brute(sizes):
    """Shares by weight, the excess over three times a source shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    t, total = dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    free, left = {s for s in sizes if sizes[s]}, total
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 3 * sizes[s]}
        if not over:
            for s in free:
                t[s] = level * w[s]
            break
        for s in over:
            t[s] = 3.0 * sizes[s]
            left -= t[s]
        free -= over
    return t


def check(df):
    rows = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for r in df.select("text", "source").collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    want, most = targets_brute(sizes), defaultdict(int)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        ratio = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(ratio + 1e-9) <= r["copies"] <= int(ratio - 1e-9) + 1 or not r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    return rows


def test_odd(odd):
    assert len(check(odd)) == odd.count()


@pytest.mark.parametrize("seed", range(2))
def test_many(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300]), rng.choice(["hot"] * 5 + list("abcdefg") + [None])) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    a = check(df)
    b = mixing.mix(df.repartition(2)).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))  # reruns agree


def test_many_sources(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), None if i % 50 == 0 else "hot" if i % 2 else f"s{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = check(df)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert Counter(map(tuple, check(df))) == Counter(map(tuple, a))


def test_expected_words_are_kept(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert len({r["copies"] for r in got if r["source"] == "b"}) == 2


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    src = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{src}/documents.parquet").where("doc_id < 300")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, "one two", "en", None, 7), (9003, "one two", "en", None, 7)], docs.schema)
    docs.unionByName(odd).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{src}/labels.parquet").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, small):
    """Each stage against its rule, applied by hand to its own input."""
    import corpus_pipeline as c
    from geostrata.llm import exact_dedup, simhash, toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    clean = c.materialise(c.drop_toxic(spark, docs, small))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, c.load(spark, small, "labels"))).collect()}
    assert clean.columns == columns and key(clean) == Counter({k: n for k, n in key(docs).items() if score[k[0]] < 0.5})
    one = c.materialise(c.drop_copies(spark, clean, small))
    keep = {r["keep_id"] for r in exact_dedup.exact_dedup(clean).collect()}
    assert one.columns == columns and key(one) == Counter({k: 1 for k in key(clean) if k[0] in keep})
    near = c.materialise(c.drop_near_copies(spark, one, small))
    stay = {r["component_id"] for r in simhash.near_duplicates(one).collect()}
    assert near.columns == columns and key(near) == Counter({k: n for k, n in key(one).items() if k[0] in stay})
    mixed = c.materialise(c.mix_sources(spark, near, small))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    assert mixed.columns == columns and key(mixed) == Counter({k: copies[k[0]] for k in key(near) if copies[k[0]]})
    assert c.encode(spark, mixed, small).count() == mixed.count()


def test_pipeline_of_nothing(spark, small, tmp_path):
    import corpus_pipeline as c

    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
