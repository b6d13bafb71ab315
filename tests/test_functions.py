import json
import math
import random

from pyspark.sql import functions as F

from geostrata.functions import codec
from geostrata.functions import geometry as G
from geostrata.functions import properties as P
from geostrata.functions import tiles as T
from geostrata.operators import aggregate as A
from geostrata.operators import export as X
from geostrata.operators import split as S
from geostrata.plans import features as V
from geostrata.sources import geojson as J

SF = "/root/testdata/sf0.001"


def test_arithmetic_size_is_the_encoders(spark):
    for name, view in V.ALL.items():
        rows = view(spark, SF).limit(60)
        bad = rows.select((A.packed_size() != F.octet_length(codec.encode_feature())).alias("bad")).where("bad").count()
        assert bad == 0, name


def test_cover_meets_the_geometry():
    rng = random.Random(5)
    for _ in range(40):
        kind = rng.choice(["Polygon", "LineString"])
        c = [rng.uniform(-170, 150), rng.uniform(-70, 60)]
        ring = [[c[0] + 9 * math.cos(a), c[1] + 9 * math.sin(a)] for a in sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 7)))]
        if kind == "Polygon":
            ring.append(ring[0])
        z, n = 7, 1 << 7
        got = {(t["x"], t["y"]) for t in T.cover(kind, [[ring]], z)}
        merc = [T._mercator(p[0], p[1], n) for p in ring]
        want = set()
        for a, b in zip(merc, merc[1:]):
            want.update((int(a[0] + t / 500 * (b[0] - a[0])), int(a[1] + t / 500 * (b[1] - a[1]))) for t in range(501))
        assert want <= got
        if kind == "LineString":  # nothing far from the line
            for x, y in got:
                assert min(math.dist((x + 0.5, y + 0.5), (a[0] + t / 200 * (b[0] - a[0]), a[1] + t / 200 * (b[1] - a[1]))) for a, b in zip(merc, merc[1:]) for t in range(201)) < 0.8


def test_cover_of_a_large_square_has_its_inside():
    square = [[[-40.0, -40.0], [40.0, -40.0], [40.0, 40.0], [-40.0, 40.0], [-40.0, -40.0]]]
    got = {(t["x"], t["y"]) for t in T.cover("Polygon", [square], 6)}
    xs, ys = [x for x, _ in got], [y for _, y in got]
    assert len(got) == (max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1)


def test_tiles_at_the_edges(spark):
    rows = spark.createDataFrame([(180.0, 85.0511), (-180.0, -85.0511), (0.0, 90.0), (0.0, -90.0), (179.9999999, 0.0)], "lon double, lat double")
    got = rows.select(T.tile_of("lon", "lat", 4).alias("t")).select("t.x", "t.y").collect()
    assert all(0 <= r["x"] <= 15 and 0 <= r["y"] <= 15 for r in got)
    one = spark.range(1).select(F.struct(F.lit(5).cast("long").alias("x"), F.lit(6).cast("long").alias("y"), F.lit(3).alias("z")).alias("tile"))
    up, coarse = S.rolled_up(one, 2)
    assert up.first()["key"] == "2-3-2" and coarse.count() == 0
    up, coarse = S.rolled_up(one, 5)
    assert up.count() == 0 and coarse.count() == 1
    assert T.zoom_steps(0, 10) == [4, 8, 10] and T.zoom_steps(3, 3) == []


TEXTS = [
    '{"type":"Feature","id":7,"properties":{"a":"x}{","n":1.5,"t":true,"z":null,"l":[1]},"geometry":{"type":"Point","coordinates":[1.5,2.5,3.5]}}',
    '{"type":"Feature","id":"name","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0.2,0.1],[0.3,0.1],[0.3,0.2],[0.2,0.1]]]}}',
    '{"type":"Feature","properties":null,"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}}',
    '{"type":"Feature","properties":{},"geometry":null}',
    '{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[]}}',
    '{"type":"Feature","properties":{},"geometry":{"type":"GeometryCollection","geometries":[]}}',
    '{"type":"Feat',
]


def test_geojson_parse(spark):
    rows = J.parse(spark.createDataFrame([(t,) for t in TEXTS], "feature string")).collect()
    first = next(r for r in rows if r["id"] == 7)
    assert first["dims"] == 3 and first["coords"] == [[[[1.5, 2.5, 3.5]]]]
    p = {k: tuple(v) for k, v in first["properties"].items()}
    assert p["a"][:2] == (1, "x}{") and p["n"][0] == 3 and p["n"][3] == 1.5 and p["t"][0] == 7 and p["t"][6] is True and p["z"][:2] == (1, "") and p["l"][:2] == (1, "")
    assert sum(r["_corrupt_record"] is not None for r in rows) == 2
    good = J.nonnull(J.parse(spark.createDataFrame([(t,) for t in TEXTS], "feature string"))).collect()
    assert sorted(r["geom_type"] for r in good) == ["LineString", "MultiPolygon", "Point", "Polygon"]
    kept = J.parse(spark.createDataFrame([(TEXTS[0],)], "feature string"), keep_json=True).first()
    assert kept["properties"]["l"]["s"] == "[1]"


def test_geojson_round_trip(spark, tmp_path):
    for name in ("multilines", "multipoints", "multipolygons"):
        rows = V.ALL[name](spark, SF).limit(30)
        path = str(tmp_path / name)
        J.write_collection(rows.repartition(3), path)
        for f in (tmp_path / name).glob("part*"):
            assert json.loads(f.read_text())["type"] == "FeatureCollection"
        back = {r["id"]: r["coords"] for r in J.read(spark, path).collect()}
        assert back == {r["id"]: r["coords"] for r in rows.collect()}


def test_pages(spark):
    rows = V.points(spark, SF).limit(25)
    got = sorted((r["page"], len(json.loads(r["text"])["features"]), r["full"]) for r in X.pages(rows, "id", 10).collect())
    assert got == [(0, 10, True), (1, 10, True), (2, 5, False)]
    assert json.loads(X.page(rows, "id", 10, 9).first()["text"])["features"] == []
    assert X.page(rows, "id", 0, 0).first()["full"]
    assert all(f["properties"]["COLORKEY"] == "purple" for f in json.loads(X.page(rows, "id", 10, 2).first()["text"])["features"])


def test_map_set_replaces_and_keeps(spark):
    r = V.points(spark, SF).limit(1).select(P.map_set("properties", "name", P.number(F.lit(2.0))).alias("p")).first()["p"]
    assert set(r) == {"name", "acctbal", "segment"} and r["name"]["d"] == 2.0 and r["name"]["s"] is None


def test_delimited_export_quotes(spark, tmp_path):
    rows = V.points(spark, SF).limit(2).withColumn("properties", P.make(name=P.text(F.lit('a|b"c'))))
    X.pipe_export(rows, str(tmp_path / "a"))
    got = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "a"), sep="|")
    assert got.count() == 2
    assert X.pipe_rows(rows, ["name", "Type"]).first()["line"].startswith('a|b"c|')


def test_bounds_of_odd_sets(spark):
    far = spark.createDataFrame([([[[[200.0, 95.0], [210.0, 99.0]]]],), ([],), (None,)], "coords array<array<array<array<double>>>>")
    got = [r[0] for r in far.select(G.bbox()).collect()]
    assert tuple(got[0]) == (200.0, 95.0, 210.0, 99.0) and got[1] is None and got[2] is None
    assert [r[0] for r in far.select(G.vertex_count()).collect()] == [2, 0, 0]
