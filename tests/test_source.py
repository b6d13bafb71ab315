import json
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geostrata.functions import codec
from geostrata.functions import geometry as G
from geostrata.functions import properties as P
from geostrata.operators import scan as R
from geostrata.operators import split as S
from geostrata.schema import FEATURE
from geostrata.sources import geojson as J
from geostrata.sources.packed import list_files, register


@pytest.fixture(scope="module")
def features(spark):
    register(spark)
    p = F.array((F.col("id") % 360 - 180).cast("double"), (F.col("id") % 170 - 85).cast("double"))
    df = spark.range(500).select("id", P.make(n=P.number(F.col("id")), k=P.text(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))).alias("properties"), F.lit("Point").alias("geom_type"), F.lit(2).alias("dims"), F.array(F.array(F.array(p))).alias("coords"))
    return df.withColumn("bbox", G.bbox()).select(*FEATURE.names)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_write_read(spark, features, tmp_path):
    path = str(tmp_path / "a")
    features.write.format("packedfeature").mode("overwrite").save(path)
    assert ids(R.scan(spark, path)) == list(range(500))
    features.limit(10).write.format("packedfeature").mode("append").save(path)
    assert R.scan(spark, path).count() == 510
    features.where("id < 5").write.format("packedfeature").mode("overwrite").save(path)
    assert ids(R.scan(spark, path)) == list(range(5))
    assert R.scan(spark, path, columns="id,bbox").columns == ["id", "bbox"]


def test_index_tiles_the_file(spark, features, tmp_path):
    path = str(tmp_path / "a")
    rows = features.withColumn("key", P.map_get_default("properties", "k"))
    S.write_split(rows, path, 2)
    index = sorted(R.index(spark, path).collect(), key=lambda r: (r["key"], r["start"]))
    assert sum(r["count"] for r in index) == 500 and {r["key"] for r in index} == {"k0", "k1", "k2"}
    for file in list_files(path):
        own = json.load(open(file + ".index"))
        assert own[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(own, own[1:]))
    assert ids(S.read_key(spark, path, "k1")) == [i for i in range(500) if i % 3 == 1]
    assert S.read_key(spark, path, "none").count() == 0
    assert R.scan(spark, path, key="k1").rdd.getNumPartitions() < R.scan(spark, path).rdd.getNumPartitions()


def test_index_has_a_row_for_a_key_however_often_it_is_cut(spark, features, tmp_path):
    path = str(tmp_path / "a")
    features.coalesce(1).write.format("packedfeature").option("range_bytes", 1000).mode("append").save(path)
    one = list_files(path)[0]
    assert len(json.load(open(one + ".index"))) > 3
    (row,) = R.index(spark, path).collect()
    xs, ys = [i % 360 - 180 for i in range(500)], [i % 170 - 85 for i in range(500)]
    assert row[:5] == (None, 0, os.path.getsize(one), os.path.getsize(one), 500) and row[5:] == (min(xs), min(ys), max(xs), max(ys))
    features.coalesce(1).write.format("packedfeature").mode("append").save(path)
    whole = sum(map(os.path.getsize, list_files(path)))
    assert [r["start"] for r in R.index(spark, path).collect()] == [0, 0]
    assert [r[1:5] for r in R.index(spark, path, joined=True).collect()] == [(0, whole, whole, 1000)]


def test_bounds_prune_exactly(spark, features, tmp_path):
    path = str(tmp_path / "a")
    features.write.format("packedfeature").option("range_bytes", 1000).mode("append").save(path)
    want = features.where(G.bbox_intersect("bbox", G.box(-10, -20, 30, 40)))
    assert ids(R.scan(spark, path, bounds="-10,-20,30,40")) == ids(want)


def test_positions_and_ranges(spark, features, tmp_path):
    path = str(tmp_path / "a")
    features.coalesce(1).write.format("packedfeature").mode("append").save(path)
    raw = R.scan_raw(spark, path)
    rows = sorted(raw.collect(), key=lambda r: r["_pos_start"])
    data = open(list_files(path)[0], "rb").read()
    assert all(data[r["_pos_start"] : r["_pos_end"]] == bytes(r["payload"]) for r in rows)
    some = raw.where(F.col("_pos_start") % 3 == 0)
    assert R.read_ranges(raw, some).count() == some.count()
    at = rows[99]["_pos_end"]
    assert R.seek(spark, path, at).count() == 400


def test_concatenation_and_old_index_record(spark, features, tmp_path):
    (tmp_path / "b").mkdir()
    meta = codec.frame(codec.encode({"properties": {"metadata": {"tag": 1, "s": "index"}}, "geom_type": "Point", "coords": [[[[0.0, 0.0]]]]}))
    body = b"".join(codec.frame(codec.encode({"id": k, "properties": {}, "geom_type": "Point", "coords": [[[[1.0, 2.0]]]]})) for k in range(3))
    (tmp_path / "b" / "x.pfs").write_bytes(meta + body + body)
    assert ids(R.scan(spark, str(tmp_path / "b"))) == [0, 0, 1, 1, 2, 2]


def test_empty(spark, features, tmp_path):
    path = str(tmp_path / "a")
    features.limit(0).write.format("packedfeature").mode("overwrite").save(path)
    assert R.scan(spark, path).count() == 0


def test_stream_sees_growth(spark, features, tmp_path):
    path, out = str(tmp_path / "a"), str(tmp_path / "out")
    features.where("id < 100").write.format("packedfeature").mode("append").save(path)

    def run():
        s = spark.readStream.format("packedfeature").load(path)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()

    run()
    assert ids(spark.read.parquet(out)) == list(range(100))
    features.where("id >= 100").write.format("packedfeature").mode("append").save(path)
    run()
    assert ids(spark.read.parquet(out)) == list(range(500))


@pytest.mark.parametrize("size", [7, 64, 333, 5000, 1 << 20])
def test_collections_are_cut_anywhere(spark, tmp_path, size):
    texts = ['{"type":"Feature","id":%d,"properties":{"a":"%s"},"geometry":null}' % (k, t) for k, t in enumerate(['x"features":[{'.replace('"', '\\"'), "\\\\", "\\\\\\\"}]", "é漢🙂", "{[", "b" * 300, ""] * 3)]
    head = '{"crs":{"properties":{"name":"features"}},"bbox":[1,2], "note":"\\"features\\": [", "features" : \n [ '
    for name, sep in (("a.json", ",\n "), ("b.json", ",")):
        (tmp_path / name).write_text(head + sep.join(texts) + ' ], "after": [{"type":"Feature","id":99}, {"x":{"y":[{}]}}]}\n')
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "d.json").write_text("")
    got = [json.loads(r["feature"]) for r in J.read_texts(spark, str(tmp_path), chunk_bytes=size).collect()]
    assert sorted(got, key=str) == sorted([json.loads(t) for t in texts] * 2, key=str)


def test_chunks_take_little_memory(tmp_path):
    """A few times a chunk's bytes, not dozens."""
    one = '{"type":"Feature","id":%d,"bbox":[1.5,2.5,1.5,2.5],"geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"name":"a \\"name\\" of %d"}}'
    path, size = str(tmp_path / "a.json"), 1 << 22
    open(path, "w").write('{"type":"FeatureCollection","features":[' + ",\n".join(one % (k, k) for k in range(40_000)) + "]}")
    chunk = pa.RecordBatch.from_pylist([{"file": path, "start": 0, "stop": size, "quoted": False, "depth": 0, "first": 40}])
    for run in (J._summaries(path), J._cutter(path)):
        tracemalloc.start()
        assert sum(b.num_rows for b in run([chunk]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 6 * size, peak / size


def test_joined_positions(spark, features, tmp_path, monkeypatch):
    path = str(tmp_path / "packed")
    features.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("packedfeature").option("range_bytes", 2000).mode("overwrite").save(path)
    files = list_files(path)
    assert len(files) == 3
    os.remove(files[1] + ".index")  # also a file without an index has its place
    data = b"".join(open(f, "rb").read() for f in files)
    want = [(bytes(p), a, z) for p, a, z in codec.records(data)]
    raw = R.scan_raw(spark, path, joined=True)
    assert sorted(map(tuple, raw.collect()), key=lambda r: r[1]) == want
    for k in (1, 100, 250, 400, 499):  # in every file
        got = R.seek(spark, path, want[k - 1][2], mode="raw", joined=True).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want[k:]
    some = raw.where("_pos_start % 5 = 0").select("_pos_start", "_pos_end")
    wanted = [r for r in want if r[1] % 5 == 0]
    for most in (R.SEEKS, 2):
        monkeypatch.setattr(R, "SEEKS", most)
        assert sorted(map(tuple, R.look_up(spark, path, some, joined=True).collect()), key=lambda r: r[1]) == wanted


def test_look_up_reads_single_records(spark, features, tmp_path, monkeypatch):
    path = str(tmp_path / "packed")
    features.repartition(2).write.format("packedfeature").mode("overwrite").save(path)
    one = list_files(path)[0]
    some = R.scan_raw(spark, one).where("_pos_start % 5 = 0").withColumn("file", F.lit(one.rsplit("/", 1)[1]))
    want = sorted((bytes(r["payload"]), r["_pos_start"], r["_pos_end"]) for r in some.collect())
    assert want and sorted(map(tuple, R.look_up(spark, path, some).collect())) == want
    assert R.look_up(spark, path, some.limit(0)).count() == 0
    monkeypatch.setattr(R, "SEEKS", 2)  # beyond the bound: a scan and a join
    assert sorted(map(tuple, R.look_up(spark, one, some).collect())) == want


def test_whole_records():
    from geostrata.streaming import append_log

    data = b"".join(codec.frame(b"x" * n) for n in (0, 5, 127, 128, 300, 70_000))
    ends = [z for _, _, z in codec.records(data)]
    for size in (0, 1, 2, 3, 8, 140, 300, 600, 70_000, len(data) - 1, len(data)):
        for start in [0, *[e for e in ends if e <= size]]:
            got = append_log.whole_records(lambda n, at: data[:size][at : at + n], size, start)
            assert got == max([e for e in [0, *ends] if start <= e <= size])
