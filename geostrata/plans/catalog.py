"""Every query of the feature engine with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import geometry as G
from ..functions import properties as P
from ..functions import tiles as T
from ..operators import aggregate as A
from ..operators import export as X
from ..operators import scan as R
from ..operators import split as S
from ..session import fresh_path
from ..sources import geojson as J
from ..sources.packed import register
from . import features as V
from .features import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- pieces of SQL -----------------------------------------------------------


def qz(x: str) -> str:
    return f"CAST(trunc(({x}) * 1e7::DOUBLE) AS BIGINT)"


def zz(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END)"


def vl(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN ({x}) < {1 << (7 * n)} THEN {n}" for n in range(1, 9)) + " ELSE 9 END)"


def hexed(x: str) -> str:
    """A varint's bytes in hexadecimal digits, for values under 2^35."""
    byte = lambda k, more: f"printf('%02x', (({x}) >> {7 * k}) & 127 {'| 128' if more else ''})"
    sizes = [" || ".join([*[byte(k, True) for k in range(n - 1)], byte(n - 1, False)]) for n in range(1, 6)]
    return "(CASE " + " ".join(f"WHEN ({x}) < {1 << (7 * n)} THEN {s}" for n, s in enumerate(sizes[:-1], 1)) + f" ELSE {sizes[-1]} END)"


def nest(x: str) -> str:
    return f"(1 + {vl(x)} + ({x}))"


def tile_sql(lon: str, lat: str, z: int) -> tuple[str, str]:
    n = 1 << z
    x = f"least(greatest(CAST(floor((({lon}) + 180.0) / 360.0::DOUBLE * {n}) AS BIGINT), 0), {n - 1})"
    y = f"least(greatest(CAST(floor((1.0::DOUBLE - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * {n}) AS BIGINT), 0), {n - 1})"
    return x, y


#: Payload and record bytes of a point feature.
POINT_SIZE = (
    f"(1 + {vl('id')} + 22 + {nest('10 + octet_length(encode(name))')} + {nest('13 + octet_length(encode(segment))')} + 2 + "
    f"{nest(vl(zz(qz('lon'))) + ' + ' + vl(zz(qz('lat'))))} + {nest('2 * ' + vl(zz(qz('lon'))) + ' + 2 * ' + vl(zz(qz('lat'))))})"
)
SIZED = with_("pt") + f", sz AS (SELECT *, CAST({POINT_SIZE} AS BIGINT) AS payload FROM pt), fr AS (SELECT *, CAST(1 + {vl('payload')} + payload AS BIGINT) AS frame FROM sz), al AS (SELECT *, CAST(sum(frame) OVER (ORDER BY id) AS BIGINT) AS stop FROM fr) "
#: The bytes themselves, in hexadecimal digits: a double's from its sign, exponent and mantissa.
_TEXT_HEX = "'12' || {body} || '0a' || {klen} || '{key}' || '12' || {value} || '0a' || {len} || lower(hex(encode({c})))"


def _text_hex(key: str, c: str) -> str:
    n, k = f"octet_length(encode({c}))", len(key)
    return _TEXT_HEX.format(body=hexed(f"4 + {k} + 2 + {n}"), klen=f"'{k:02x}'", key=key.encode().hex(), value=hexed(f"2 + {n}"), len=hexed(n), c=c)


_EXPONENT = "CAST(floor(log2(abs(acctbal))) AS BIGINT)"
_BITS = f"(CASE WHEN acctbal = 0 THEN 0::HUGEINT ELSE (CASE WHEN acctbal < 0 THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END) + (({_EXPONENT} + 1023)::HUGEINT * 4503599627370496) + CAST((abs(acctbal) / pow(2, {_EXPONENT}) - 1) * 4503599627370496 AS HUGEINT) END)"
_DOUBLE_HEX = " || ".join(f"printf('%02x', CAST(({_BITS} // {1 << (8 * k)}::HUGEINT) % 256 AS INT))" for k in range(8))
_ORDINATES = hexed(zz(qz("lon"))) + " || " + hexed(zz(qz("lat")))
_N = vl(zz(qz("lon"))) + " + " + vl(zz(qz("lat")))
_ACCTBAL_HEX = "'12140a07" + b"acctbal".hex() + "120919' || " + _DOUBLE_HEX
POINT_HEX = " || ".join(["'08'", hexed("id"), _ACCTBAL_HEX, _text_hex("name", "name"), _text_hex("segment", "segment"), "'180122'", hexed(_N), _ORDINATES, "'2a'", hexed(f"2 * ({_N})"), _ORDINATES, _ORDINATES])
BYTES = with_("pt") + f", al AS (SELECT id, {POINT_HEX} AS hex FROM pt) "
BOX = "min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS north"
QBOX = ", ".join(f"{qz(f'{fn}({c})')} AS {n}" for fn, c, n in (("min", "lon", "qw"), ("min", "lat", "qs"), ("max", "lon", "qe"), ("max", "lat", "qn")))


# --- pieces of Spark ---------------------------------------------------------


def first_position() -> tuple[Column, Column]:
    p = F.col("coords")[0][0][0]
    return p[0], p[1]


def qpoint(df: DataFrame) -> DataFrame:
    """Decoded points in comparable form."""
    x, y = first_position()
    # Decoded ordinates are whole units over 1e7: rounding finds the unit again.
    unit = lambda v: F.round(v * 1e7).cast("long")
    return df.select("id", P.map_get_default("properties", "name").alias("name"), P.get("properties", "acctbal")["d"].alias("acctbal"), unit(x).alias("qx"), unit(y).alias("qy"))


QPOINT = with_("pt") + f"SELECT id, name, acctbal, {qz('lon')} AS qx, {qz('lat')} AS qy FROM pt"


def unit(c: str) -> Column:
    return F.round(F.col(c) * 1e7).cast("long")


def qbounds(df: DataFrame) -> DataFrame:
    return df.select("id", *[G.quantize(f"bbox.{k}").alias(n) for k, n in zip("wsen", ("qw", "qs", "qe", "qn"))])


_copies: dict[tuple, str] = {}


def packed_copy(spark: SparkSession, sf_dir: str, view: str = "points", ordered: bool = True) -> str:
    """A view written as a packed folder, once per session and input.  ordered: the
    files are ranges of ids, one stream in their order (``joined`` has its positions)."""
    register(spark)
    key = (spark.sparkContext.applicationId, sf_dir, view, ordered)
    if key not in _copies:
        path = fresh_path(spark, f"packed-{view}")
        rows = V.ALL[view](spark, sf_dir)
        rows = rows.repartitionByRange("id").sortWithinPartitions("id") if ordered else rows.repartition(4, "id")
        rows.write.format("packedfeature").mode("append").save(path)
        _copies[key] = path
    return _copies[key]


# --- scans -------------------------------------------------------------------


@q("scan_file", QPOINT)
def scan_file(spark, d):
    return qpoint(R.scan(spark, packed_copy(spark, d)))


@q("scan_buffer", QPOINT)
def scan_buffer(spark, d):
    buf = V.points(spark, d).select("id", F.pmod("id", F.lit(64)).alias("g"), codec.encode_frame(codec.encode_feature()).alias("frame"))
    buf = R.to_buffers(buf, "g", "id", 1 << 16)
    return qpoint(R.decoded(R.scan_buffer(buf, "buf")))


@q("scan_next", with_("pt") + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(id) AS BIGINT) AS low, CAST(max(id) AS BIGINT) AS high FROM pt")
def scan_next(spark, d):
    return R.scan(spark, packed_copy(spark, d), columns="id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@q("scan_bytes", BYTES + "SELECT hex AS payload, CAST(count(*) AS BIGINT) AS n FROM al GROUP BY hex")
def scan_bytes(spark, d):
    raw = R.scan_raw(spark, packed_copy(spark, d))
    return raw.groupBy(F.lower(F.hex("payload")).alias("payload")).agg(F.count(F.lit(1)).alias("n"))


_AT = BYTES + f", ap AS (SELECT hex, length(hex) // 2 AS n, CAST(sum(length(hex) // 2 + 1 + {vl('length(hex) // 2')}) OVER (ORDER BY id) AS BIGINT) AS stop FROM al) "


def placed(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_pos_start").alias("pos_start"), F.col("_pos_end").alias("pos_end"), F.lower(F.hex("payload")).alias("payload"))


@q("scan_bytes_pos", _AT + "SELECT stop - n AS pos_start, stop AS pos_end, hex AS payload FROM ap")
def scan_bytes_pos(spark, d):
    return placed(R.scan_raw(spark, packed_copy(spark, d), joined=True))


@q("scan_feature", with_("pt") + "SELECT id, name, segment, 'Point' AS geom_type, CAST(2 AS INT) AS dims FROM pt")
def scan_feature(spark, d):
    f = R.scan(spark, packed_copy(spark, d))
    return f.select("id", P.map_get_default("properties", "name").alias("name"), P.map_get_default("properties", "segment").alias("segment"), "geom_type", "dims")


@q("scan_feature_pos", SIZED + "SELECT id, stop - payload AS pos_start, stop AS pos_end FROM al")
def scan_feature_pos(spark, d):
    f = R.scan(spark, packed_copy(spark, d), positions=True, joined=True)
    return f.select("id", F.col("_pos_start").alias("pos_start"), F.col("_pos_end").alias("pos_end"))


@q("scan_all", "SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS n_points, CAST((SELECT count(*) FROM part) AS BIGINT) AS n_polygons")
def scan_all(spark, d):
    a = R.scan(spark, packed_copy(spark, d)).select("geom_type")
    b = R.scan(spark, packed_copy(spark, d, "polygons")).select("geom_type")
    kind = lambda k: F.count(F.when(F.col("geom_type") == k, 1))
    return R.merge(a, b).agg(kind("Point").alias("n_points"), kind("Polygon").alias("n_polygons"))


@q("scan_reset", with_("pt") + "SELECT id, CAST(2 AS BIGINT) AS seen FROM pt")
def scan_reset(spark, d):
    f = R.scan(spark, packed_copy(spark, d), columns="id")  # lazy: evaluating it again is the rewind
    return R.merge(f, f).groupBy("id").agg(F.count(F.lit(1)).alias("seen"))


def _start_of(spark: SparkSession, path: str, k: int) -> int:
    """Byte offset of the k-th record of a folder's stream."""
    raw = R.scan_raw(spark, path, joined=True).select("_pos_start", "_pos_end").orderBy("_pos_start").limit(k)
    last = raw.agg(F.max("_pos_end")).first()[0]
    return int(last or 0)


@q("seek_pos", SIZED + "SELECT id, stop AS pos_end FROM al WHERE stop > (SELECT stop FROM al ORDER BY id LIMIT 1 OFFSET 99)")
def seek_pos(spark, d):
    path = packed_copy(spark, d)
    f = R.seek(spark, path, _start_of(spark, path, 100), positions=True, joined=True)
    return f.select("id", F.col("_pos_end").alias("pos_end"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """The positions to look up: here those of every record."""
    return R.scan_raw(spark, packed_copy(spark, d), joined=True).select("_pos_start", "_pos_end")


@q("read_range_raw", _AT + "SELECT stop - n AS pos_start, stop AS pos_end, hex AS payload FROM ap")
def read_range_raw(spark, d):
    return placed(R.look_up(spark, packed_copy(spark, d), _ranges(spark, d), joined=True))


@q("read_range_feature", SIZED + f"SELECT id, name, acctbal, {qz('lon')} AS qx, {qz('lat')} AS qy FROM al")
def read_range_feature(spark, d):
    return qpoint(R.decoded(R.look_up(spark, packed_copy(spark, d), _ranges(spark, d), joined=True)))


@q("read_range_framed", SIZED + "SELECT stop - frame AS frame_start, frame FROM al")
def read_range_framed(spark, d):
    n = F.octet_length(codec.encode_frame("payload")).cast("long")
    return R.look_up(spark, packed_copy(spark, d), _ranges(spark, d), joined=True).select((F.col("_pos_end") - n).alias("frame_start"), n.alias("frame"))


@q("meta_check", with_("pt") + "SELECT (id % 7 = 0) AS is_metadata, CAST(count(*) AS BIGINT) AS n FROM pt GROUP BY 1")
def meta_check(spark, d):
    one = P.make(metadata=P.text(F.lit("x")))
    rows = V.points(spark, d).withColumn("properties", F.when(F.col("id") % 7 == 0, one).otherwise(F.col("properties")))
    return rows.groupBy(R.metadata_test().alias("is_metadata")).agg(F.count(F.lit(1)).alias("n"))


@q("meta_feature_test", with_("pt") + "SELECT id FROM pt WHERE id % 7 = 0")
def meta_feature_test(spark, d):
    one = P.make(metadata=P.text(F.lit("x")))
    two = P.make(metadata=P.text(F.lit("x")), other=P.text(F.lit("y")))
    props = F.when(F.col("id") % 7 == 0, one).when(F.col("id") % 7 == 1, two).otherwise(F.col("properties"))
    return V.points(spark, d).withColumn("properties", props).where(R.metadata_test()).select("id")


@q("meta_read", SIZED + f"SELECT CAST(0 AS BIGINT) AS start, CAST(sum(frame) AS BIGINT) AS stop, CAST(count(*) AS BIGINT) AS n, {QBOX} FROM al")
def meta_read(spark, d):
    i = R.index(spark, packed_copy(spark, d), joined=True)
    return i.select("start", F.col("end").alias("stop"), F.col("count").alias("n"), *[unit(k).alias(n) for k, n in zip("wsen", ("qw", "qs", "qe", "qn"))])


@q("meta_shift", SIZED + "SELECT CAST(1000 AS BIGINT) AS start, CAST(1000 + sum(frame) AS BIGINT) AS stop, CAST(sum(frame) AS BIGINT) AS size FROM al")
def meta_shift(spark, d):
    return R.shift_index(R.index(spark, packed_copy(spark, d), joined=True), 1000).select("start", F.col("end").alias("stop"), "size")


@q("file_size", SIZED + "SELECT CAST(sum(frame) AS BIGINT) AS bytes FROM al")
def file_size(spark, d):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfs").load(packed_copy(spark, d))
    return files.agg(F.sum("length").alias("bytes"))


def _geojson_path(spark: SparkSession, d: str, lines: bool) -> str:
    key = (spark.sparkContext.applicationId, d, "geojson", lines)
    if key not in _copies:
        path = fresh_path(spark, "geojson")
        (J.write_lines if lines else J.write_collection)(V.points(spark, d), path)
        _copies[key] = path
    return _copies[key]


@q("geojson_open", with_("pt") + "SELECT CAST(count(*) AS BIGINT) AS n FROM pt")
def geojson_open(spark, d):
    return J.read_texts(spark, _geojson_path(spark, d, False)).agg(F.count(F.lit(1)).alias("n"))


@q("geojson_chunk", with_("pt") + "SELECT id, name FROM pt")
def geojson_chunk(spark, d):
    texts = J.read_texts(spark, _geojson_path(spark, d, False), chunk_bytes=1 << 16)  # several chunks even of these small files
    return texts.select(F.get_json_object("feature", "$.id").cast("bigint").alias("id"), F.get_json_object("feature", "$.properties.name").alias("name"))


# --- sinks -------------------------------------------------------------------


@q("sink_file_new", QPOINT)
def sink_file_new(spark, d):
    register(spark)
    path = fresh_path(spark, "new")
    for _ in range(2):  # the second write replaces the first
        V.points(spark, d).write.format("packedfeature").mode("overwrite").save(path)
    return qpoint(R.scan(spark, path))


@q("sink_file_append", with_("pt") + "SELECT id, CAST(2 AS BIGINT) AS n FROM pt")
def sink_file_append(spark, d):
    register(spark)
    path = fresh_path(spark, "append")
    for _ in range(2):
        V.points(spark, d).write.format("packedfeature").mode("append").save(path)
    return R.scan(spark, path, columns="id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@q("sink_buf_new", SIZED + "SELECT id % 16 AS g, CAST(sum(frame) AS BIGINT) AS bytes FROM al GROUP BY 1")
def sink_buf_new(spark, d):
    buf = V.points(spark, d).select("id", F.pmod("id", F.lit(16)).alias("g"), codec.encode_frame(codec.encode_feature()).alias("frame"))
    buf = R.to_buffers(buf, "g", "id")
    return buf.groupBy("g").agg(F.sum(F.octet_length("buf")).cast("long").alias("bytes"))


@q("write_feature", BYTES + f"SELECT id, '0a' || {hexed('length(hex) // 2')} || hex AS frame FROM al")
def write_feature(spark, d):
    return V.points(spark, d).select("id", F.lower(F.hex(codec.encode_frame(codec.encode_feature()))).alias("frame"))


def _rewritten(spark: SparkSession, d: str, column: str) -> DataFrame:
    register(spark)
    raw = R.scan_raw(spark, packed_copy(spark, d)).select("payload")
    if column == "frame":
        raw = raw.select(codec.encode_frame("payload").alias("frame"))
    path = fresh_path(spark, column)
    raw.write.format("packedfeature").mode("append").save(path)
    return qpoint(R.scan(spark, path))


@q("write_payload", QPOINT)
def write_payload(spark, d):
    return _rewritten(spark, d, "payload")


@q("write_raw", QPOINT)
def write_raw(spark, d):
    return _rewritten(spark, d, "frame")


@q("merge", with_("pt", "po") + "SELECT id, 'Point' AS geom_type FROM pt UNION ALL SELECT DISTINCT id, 'Polygon' FROM po")
def merge(spark, d):
    return R.merge(V.points(spark, d), V.polygons(spark, d)).select("id", "geom_type")


@q("sink_bytes", SIZED + "SELECT CAST(sum(payload) AS BIGINT) AS payload, CAST(sum(frame) AS BIGINT) AS frame FROM al")
def sink_bytes(spark, d):
    p = V.points(spark, d).select(codec.encode_feature().alias("p"))
    return p.agg(F.sum(F.octet_length("p")).alias("payload"), F.sum(A.frame_size(F.octet_length("p"))).cast("long").alias("frame"))


@q("sink_reader", QPOINT)
def sink_reader(spark, d):
    return qpoint(V.points(spark, d).select(codec.decode_feature(codec.encode_feature()).alias("f")).select("f.*"))


@q("meta_write", with_("pt") + f"SELECT segment AS key, CAST(count(*) AS BIGINT) AS n, {QBOX} FROM pt GROUP BY segment")
def meta_write(spark, d):
    register(spark)
    path = fresh_path(spark, "split")
    S.write_split(V.points(spark, d).withColumn("key", P.map_get_default("properties", "segment")), path, 3)
    i = R.index(spark, path)
    sides = [(F.min("w"), "qw"), (F.min("s"), "qs"), (F.max("e"), "qe"), (F.max("n"), "qn")]
    return i.groupBy("key").agg(F.sum("count").alias("n"), *[F.round(c * 1e7).cast("long").alias(n) for c, n in sides])


@q("pipe_export", with_("pt") + "SELECT name, segment, 'Point' AS Type FROM pt")
def pipe_export(spark, d):
    path = fresh_path(spark, "pipe")
    X.pipe_export(V.points(spark, d), path, ["name", "segment"])
    return spark.read.option("header", True).csv(path, sep="|").select("name", "segment", "Type")


@q("pipe_row", with_("pt") + "SELECT id, name || '|' || segment || '||' || 'Point' AS line FROM pt")
def pipe_row(spark, d):
    """Whole lines are made; the SQL has neither bounds nor geometry, which are cut out of them."""
    x = F.split("line", r"\|")
    return X.pipe_rows(V.points(spark, d), ["name", "segment", "missing"], ("id",)).select("id", F.concat_ws("|", x[0], x[1], x[2], x[4]).alias("line"))


@q("meta_csv", with_("pt") + "SELECT 'Point' AS type, CAST(1 AS BIGINT) AS verticies, CAST(3 AS BIGINT) AS number_properties, CAST(count(*) AS BIGINT) AS n FROM pt")
def meta_csv(spark, d):
    path = fresh_path(spark, "stats")
    A.write_stats(V.points(spark, d), path)
    schema = "type string, verticies long, number_properties long, size_json long, time_read_json long, time_write_json long, size_buf long, time_read_buf long, time_write_buf long"
    s = spark.read.option("header", True).schema(schema).csv(path)
    return s.groupBy("type", "verticies", "number_properties").agg(F.count(F.lit(1)).alias("n"))


_PAGED = "SELECT (row_number() OVER (ORDER BY id) - 1) // 100 AS page, id FROM pt"


@q("page_json", with_("pt") + f"SELECT CAST(page AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS n, CAST(min(id) AS BIGINT) AS low, count(*) = 100 AS is_full FROM ({_PAGED}) GROUP BY page")
def page_json(spark, d):
    p = X.pages(V.points(spark, d), "id", 100)
    ids = F.from_json("text", "features array<struct<id:bigint>>")["features"]
    return p.select("page", F.size(ids).cast("long").alias("n"), F.array_min(F.transform(ids, lambda x: x["id"])).alias("low"), F.col("full").alias("is_full"))


# --- projections -------------------------------------------------------------


def _roundtrip(view: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = V.ALL[view](spark, d).select(codec.decode_feature(codec.encode_feature()).alias("f")).select("f.*")
        pts = f.select("id", F.posexplode(G.positions()).alias("i", "p"))
        return pts.select("id", F.col("i").cast("long").alias("i"), F.round(F.col("p")[0] * 1e7).cast("long").alias("qx"), F.round(F.col("p")[1] * 1e7).cast("long").alias("qy"))

    return run


_POSITIONS = {
    "points": with_("pt") + f"SELECT id, CAST(0 AS BIGINT) AS i, {qz('lon')} AS qx, {qz('lat')} AS qy FROM pt",
    "lines": with_("ln") + f"SELECT id, CAST(i AS BIGINT) AS i, {qz('lon')} AS qx, {qz('lat')} AS qy FROM ln",
    "multilines": with_("ln") + f"SELECT id, CAST(i AS BIGINT) AS i, {qz('lon')} AS qx, {qz('lat')} AS qy FROM ln",
    "multipoints": with_("mp") + f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS BIGINT) AS i, {qz('lon')} AS qx, {qz('lat')} AS qy FROM mp",
    "polygons": with_("po") + f"SELECT id, CAST(i AS BIGINT) AS i, {qz('lon')} AS qx, {qz('lat')} AS qy FROM po",
    "multipolygons": with_("po") + f"SELECT id, CAST(s * 5 + i AS BIGINT) AS i, {qz('lon')} AS qx, {qz('lat')} AS qy FROM mo",
}
for _v, _name in (("points", "read_point"), ("lines", "decode_feature"), ("multilines", "write_line"), ("multipoints", "write_point"), ("polygons", "read_polygon"), ("multipolygons", "read_multipolygon")):
    q(_name, _POSITIONS[_v])(_roundtrip(_v))


@q("encode_feature", BYTES + "SELECT id, hex AS payload FROM al")
def encode_feature(spark, d):
    return V.points(spark, d).select("id", F.lower(F.hex(codec.encode_feature())).alias("payload"))


def _encoded_size(view: str) -> Callable:
    return lambda spark, d: V.ALL[view](spark, d).select("id", F.octet_length(codec.encode_feature()).cast("long").alias("bytes"))


_LINE_DELTA = "SELECT id, {part} AS part, i, {x} - coalesce(lag({x}) OVER (PARTITION BY id, {part} ORDER BY i), 0) AS dx, {y} - coalesce(lag({y}) OVER (PARTITION BY id, {part} ORDER BY i), 0) AS dy FROM {t}"


def _delta_sql(table: str, part: str) -> str:
    return _LINE_DELTA.format(part=part, x=qz("lon"), y=qz("lat"), t=table)


_VSUM = f"sum({vl(zz('dx'))} + {vl(zz('dy'))})"
_BOX4 = " + ".join(vl(zz(qz(f"{fn}({c})"))) for fn, c in (("min", "lon"), ("min", "lat"), ("max", "lon"), ("max", "lat")))


@q("write_polygon", with_("po") + f", dl AS ({_delta_sql('po', '0')}), sz AS (SELECT id, 1 + {_VSUM} AS body FROM dl GROUP BY id), bx AS (SELECT id, max(brand) AS brand, {_BOX4} AS box FROM po GROUP BY id) SELECT id, CAST(1 + {vl('id')} + {nest('11 + octet_length(encode(brand))')} + 2 + {nest('body')} + {nest('box')} AS BIGINT) AS bytes FROM sz JOIN bx USING (id)")
def write_polygon(spark, d):
    return _encoded_size("polygons")(spark, d)


@q("write_multipolygon", with_("po") + f", dl AS ({_delta_sql('mo', 's')}), sz AS (SELECT id, 4 + {_VSUM} AS body FROM dl GROUP BY id), bx AS (SELECT id, {_BOX4} AS box FROM mo GROUP BY id) SELECT id, CAST(1 + {vl('id')} + 2 + {nest('body')} + {nest('box')} AS BIGINT) AS bytes FROM sz JOIN bx USING (id)")
def write_multipolygon(spark, d):
    return _encoded_size("multipolygons")(spark, d)


@q("project_keys", with_("pt") + "SELECT id, 'acctbal' || CASE WHEN id % 5 <> 0 THEN ',name' ELSE '' END || CASE WHEN id % 3 = 0 THEN ',segment' ELSE '' END AS keys FROM pt")
def project_keys(spark, d):
    p = some_keys(V.points(spark, d)).select("id", codec.payload_keys(codec.encode_feature()).alias("k"))
    return p.select("id", F.array_join("k", ",").alias("keys"))


@q("project_bbox", with_("po") + f"SELECT {QBOX}, CAST(count(*) // 5 AS BIGINT) AS n FROM po")
def project_bbox(spark, d):
    b = R.scan(spark, packed_copy(spark, d, "polygons"), columns="bbox")
    return b.agg(*S.bounds(), F.count(F.lit(1)).alias("n")).select(unit("w").alias("qw"), unit("s").alias("qs"), unit("e").alias("qe"), unit("north").alias("qn"), "n")


@q("project_bbox_tail", with_("po") + f"SELECT id, {QBOX} FROM po GROUP BY id")
def project_bbox_tail(spark, d):
    p = V.polygons(spark, d).select("id", codec.payload_bbox(codec.encode_feature()).alias("bbox"))
    return p.select("id", *[unit(f"bbox.{k}").alias(n) for k, n in zip("wsen", ("qw", "qs", "qe", "qn"))])


_X6, _Y6 = tile_sql("lon", "lat", 6)
_KEY6 = f"{_X6} || '-' || {_Y6} || '-6'"


def tiled(spark: SparkSession, d: str, zoom: int = 6) -> DataFrame:
    x, y = first_position()
    return V.points(spark, d).withColumn("tile", T.tile_of(x, y, zoom)).withColumn("key", T.tile_str("tile"))


@q("project_tileid", with_("pt") + f"SELECT id, {_X6} AS x, {_Y6} AS y FROM pt")
def project_tileid(spark, d):
    rows = tiled(spark, d).withColumn("properties", P.map_set("properties", "TILEID", P.text("key")))
    t = rows.select("id", T.tile_parse(codec.payload_property(codec.encode_feature(), "TILEID")["s"]).alias("t"))
    return t.select("id", "t.x", "t.y")


# --- filters -----------------------------------------------------------------


@q("overlap_1d", with_("po") + "SELECT id, (max(lon) >= -20 AND 20 >= min(lon)) AS meets FROM po GROUP BY id")
def overlap_1d(spark, d):
    p = V.polygons(spark, d)
    return p.select("id", G.overlap_1d(F.col("bbox.w"), F.col("bbox.e"), F.lit(-20.0), F.lit(20.0)).alias("meets"))


_MEETS = "max(lon) >= -60 AND 60 >= min(lon) AND max(lat) >= -30 AND 30 >= min(lat)"


@q("bbox_intersect", with_("po") + f"SELECT id, ({_MEETS}) AS meets FROM po GROUP BY id")
def bbox_intersect(spark, d):
    return V.polygons(spark, d).select("id", G.bbox_intersect("bbox", G.box(-60, -30, 60, 30)).alias("meets"))


@q("bounds_filter", with_("po") + f"SELECT id FROM po GROUP BY id HAVING {_MEETS}")
def bounds_filter(spark, d):
    return R.scan(spark, packed_copy(spark, d, "polygons"), bounds="-60,-30,60,30").select("id")


_EVENTS = "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"


def events_json(spark: SparkSession, d: str) -> DataFrame:
    """Events as feature texts; every fifth has no geometry, every seventh is cut off."""
    e = V.table(spark, d, "events").withColumnRenamed("event_id", "id")
    geom = F.when(F.col("id") % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"type":"Point","coordinates":['), (F.col("id") % 360 - 180).cast("string"), F.lit(","), (F.col("id") % 170 - 85).cast("string"), F.lit("]}")))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"properties":'), F.col("props"), F.lit(',"geometry":'), geom, F.lit("}"))
    return e.select(F.when(F.col("id") % 7 == 0, F.substring(text, 1, 12)).otherwise(text).alias("feature"))


@q("json_parse", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 7 <> 0")
def json_parse(spark, d):
    rows = J.parse(events_json(spark, d)).where("_corrupt_record is null")
    return rows.select("id", P.get("properties", "k")["d"].alias("k"))


@q("parse_ok", "SELECT (event_id % 7 <> 0) AS ok, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def parse_ok(spark, d):
    return J.parse(events_json(spark, d)).groupBy(F.col("_corrupt_record").isNull().alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@q("partial_read", with_("po") + f"SELECT id, {QBOX} FROM po GROUP BY id HAVING max(lon) >= -20 AND min(lon) <= 40 AND max(lat) >= -30 AND min(lat) <= 30")
def partial_read(spark, d):
    """Ids and bounds alone, of the records that meet a rectangle: nothing else is decoded."""
    f = R.scan(spark, packed_copy(spark, d, "polygons"), columns="id,bbox", bounds="-20,-30,40,30")
    return f.select("id", *[unit(f"bbox.{k}").alias(n) for k, n in zip("wsen", ("qw", "qs", "qe", "qn"))])


@q("nonnull_geom", "SELECT event_id AS id FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def nonnull_geom(spark, d):
    return J.nonnull(J.parse(events_json(spark, d))).select("id")


@q("key_filter", with_("pt") + "SELECT id FROM pt WHERE segment = 'BUILDING'")
def key_filter(spark, d):
    path = fresh_path(spark, "by-key")
    rows = V.points(spark, d).withColumn("key", P.map_get_default("properties", "segment"))
    S.write_table(rows.select("id", "key"), path)
    return spark.read.parquet(path).where("key = 'BUILDING'").select("id")


@q("key_subframe", with_("pt") + "SELECT id FROM pt WHERE segment = 'MACHINERY'")
def key_subframe(spark, d):
    register(spark)
    path = fresh_path(spark, "split")
    S.write_split(V.points(spark, d).withColumn("key", P.map_get_default("properties", "segment")), path, 3)
    return R.merge(S.read_key(spark, path, "MACHINERY"), S.read_key(spark, path, "no such key")).select("id")


# --- map, split, tiles -------------------------------------------------------


@q("map_features", with_("pt") + "SELECT id + 1000000 AS id, name, 'purple' AS colour FROM pt")
def map_features(spark, d):
    register(spark)
    path = fresh_path(spark, "mapped")
    rows = V.points(spark, d).withColumn("id", F.col("id") + 1000000).withColumn("properties", P.map_set("properties", "COLORKEY", P.text(F.lit("purple"))))
    rows.write.format("packedfeature").mode("append").save(path)
    f = R.scan(spark, path)
    return f.select("id", P.map_get_default("properties", "name").alias("name"), P.map_get_default("properties", "COLORKEY").alias("colour"))


_KEYS = "SELECT id, 'a' || id % 3 AS key, lon, lat FROM pt WHERE id % 4 <> 0 UNION ALL SELECT id, 'b' || id % 5, lon, lat FROM pt WHERE id % 4 = 1"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Points with none, one or two keys."""
    one, two = F.concat(F.lit("a"), (F.col("id") % 3).cast("string")), F.concat(F.lit("b"), (F.col("id") % 5).cast("string"))
    none = F.array().cast("array<string>")
    return S.split_map(V.points(spark, d), F.when(F.col("id") % 4 == 0, none).when(F.col("id") % 4 == 1, F.array(one, two)).otherwise(F.array(one)))


@q("split_map", with_("pt") + _KEYS.replace(", lon, lat", ""))
def split_map(spark, d):
    return keyed(spark, d).select("id", "key")


@q("split_add_feature", with_("pt") + f"SELECT key, CAST(count(*) AS BIGINT) AS n, {BOX} FROM ({_KEYS}) GROUP BY key")
def split_add_feature(spark, d):
    return S.add_features(keyed(spark, d))


@q("split_add_bytes", SIZED + "SELECT 'a' || id % 3 AS key, CAST(sum(payload) AS BIGINT) AS bytes FROM al GROUP BY 1")
def split_add_bytes(spark, d):
    raw = R.scan(spark, packed_copy(spark, d), mode="raw")
    key = F.concat(F.lit("a"), (codec.decode_feature("payload")["id"] % 3).cast("string"))
    return raw.select("payload", key.alias("key")).groupBy("key").agg(F.sum(F.octet_length("payload")).alias("bytes"))


_INDEX = f"ix AS (SELECT segment AS key, CAST(sum(frame) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n, {BOX} FROM al GROUP BY 1), iy AS (SELECT key, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS stop, size, n, w, s, e, north FROM ix)"


def sized_points(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).withColumn("key", P.map_get_default("properties", "segment")).withColumn("frame", A.frame_size(A.packed_size()))


@q("subfile_index", SIZED + f", {_INDEX} SELECT key, stop - size AS start, stop, size, n, w, s, e, north FROM iy")
def subfile_index(spark, d):
    return S.subfile_index(sized_points(spark, d), F.col("frame")).withColumnRenamed("end", "stop")


@q("combine", SIZED + f", {_INDEX} SELECT key, stop - size AS start, stop FROM iy")
def combine(spark, d):
    """The index of keys combined into one stream."""
    register(spark)
    path = fresh_path(spark, "combined")
    S.write_combined(sized_points(spark, d).drop("frame"), path)
    return R.index(spark, path, joined=True).select("key", "start", F.col("end").alias("stop"))


@q("split_combine", with_("pt") + "SELECT segment AS key, id FROM pt")
def split_combine(spark, d):
    path = fresh_path(spark, "table")
    S.write_table(V.points(spark, d).withColumn("key", P.map_get_default("properties", "segment")).select("id", "key"), path)
    return spark.read.parquet(path).select("key", "id")


@q("combine_nested", SIZED + f", {_INDEX}, two AS (SELECT 0 AS f, * FROM iy UNION ALL SELECT 1, * FROM iy), tz AS (SELECT f, key, size, CAST(sum(size) OVER (ORDER BY f, stop) AS BIGINT) AS stop FROM two) SELECT CAST(f AS INT) AS file, key, stop - size AS start, stop FROM tz")
def combine_nested(spark, d):
    i = S.subfile_index(sized_points(spark, d), F.col("frame"))
    return S.combine_nested([i, i]).select("file", "key", "start", F.col("end").alias("stop"))


@q("split_tiles", with_("pt") + f"SELECT {_KEY6} AS key, CAST(count(*) AS BIGINT) AS n FROM pt GROUP BY 1")
def split_tiles(spark, d):
    rows = S.split_map(V.points(spark, d), F.transform(T.tile_cover("geom_type", "coords", 6), T.tile_str))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@q("tile_partition", with_("pt") + f"SELECT {_KEY6} AS key, CAST(count(*) AS BIGINT) AS n, {BOX} FROM pt WHERE lon BETWEEN -120 AND 120 AND lat BETWEEN -60 AND 60 GROUP BY 1")
def tile_partition(spark, d):
    x, y = first_position()
    rows = S.tile_map(V.points(spark, d), 6, G.box(-120, -60, 120, 60), cover=lambda z: F.array(T.tile_of(x, y, z)))
    return S.add_features(rows)


@q("tile_batch", with_("pt") + f"SELECT id, {_KEY6} AS tileid, ({_X6} // 8) || '-' || ({_Y6} // 8) || '-3' AS key FROM pt")
def tile_batch(spark, d):
    x, y = first_position()
    rows = S.tile_map(V.points(spark, d), 6, cover=lambda z: F.array(T.tile_of(x, y, z)), coarse=3)
    return rows.select("id", P.map_get_default("properties", "TILEID").alias("tileid"), "key")


@q("concurrent_scan", QPOINT)
def concurrent_scan(spark, d):
    return qpoint(R.scan(spark, packed_copy(spark, d, ordered=False)))


_P0 = tile_sql("min(lon)", "max(lat)", 8), tile_sql("max(lon)", "min(lat)", 8)


@q("tile_cover", with_("po") + f", bx AS (SELECT id, {_P0[0][0]} AS x0, {_P0[0][1]} AS y0, {_P0[1][0]} AS x1, {_P0[1][1]} AS y1 FROM po GROUP BY id) SELECT id, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS n_tiles FROM bx")
def tile_cover(spark, d):
    """Axis-parallel squares cover exactly their bounds' tiles."""
    p = V.polygons(spark, d)
    return p.select("id", F.size(T.tile_cover("geom_type", "coords", 8)).cast("long").alias("n_tiles"))


@q("bbox_tiles", with_("po") + f", bx AS (SELECT id, {_P0[0][0]} AS x0, {_P0[0][1]} AS y0, {_P0[1][0]} AS x1, {_P0[1][1]} AS y1 FROM po GROUP BY id) SELECT id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM (SELECT id, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM bx) AS a, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)")
def bbox_tiles(spark, d):
    p = V.polygons(spark, d).select("id", F.explode(T.bbox_tiles("bbox", 8)).alias("t"))
    return p.select("id", "t.x", "t.y")


# --- aggregations ------------------------------------------------------------


def some_keys(rows: DataFrame) -> DataFrame:
    """Points of which only every third has the property ``segment``, and every fifth no ``name``."""
    keep = lambda k, _: ((k != "segment") | (F.col("id") % 3 == 0)) & ((k != "name") | (F.col("id") % 5 != 0))
    return rows.withColumn("properties", F.map_filter("properties", keep))


@q("key_union", with_("pt") + "SELECT key, min(id) AS first FROM (SELECT id, unnest(['acctbal', CASE WHEN id % 3 = 0 THEN 'segment' END, CASE WHEN id % 5 <> 0 THEN 'name' END]) AS key FROM pt) WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT unnest(['Bounds', 'Type', 'Geometry']), CAST(-1 AS BIGINT)")
def key_union(spark, d):
    return A.key_union(some_keys(V.points(spark, d)), "id").select("key", F.coalesce("first", F.lit(-1)).cast("long").alias("first"))


@q("feature_count", with_("pt") + f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({_KEYS})")
def feature_count(spark, d):
    return keyed(spark, d).agg(F.count(F.lit(1)).alias("n"))


@q("dataset_bounds", with_("po") + f"SELECT {BOX} FROM mo")
def dataset_bounds(spark, d):
    return A.dataset_bounds(V.multipolygons(spark, d))


@q("bounds_union", with_("pt") + f"SELECT segment, {BOX} FROM pt GROUP BY segment")
def bounds_union(spark, d):
    p = V.points(spark, d).withColumn("segment", P.map_get_default("properties", "segment"))
    return p.groupBy("segment").agg(*S.bounds())


@q("bounds_expand", with_("po") + f"SELECT id, {BOX} FROM mo GROUP BY id")
def bounds_expand(spark, d):
    p = V.multipolygons(spark, d).select("id", G.bbox_union(F.transform("coords", lambda poly: G.bbox(F.array(poly)))).alias("b"))
    return p.select("id", "b.w", "b.s", "b.e", F.col("b.n").alias("north"))


@q("stats_feature", with_("po") + "SELECT id, 'MultiPolygon' AS type, CAST(count(*) AS BIGINT) AS verticies, CAST(0 AS BIGINT) AS number_properties FROM mo GROUP BY id")
def stats_feature(spark, d):
    return A.stats(V.multipolygons(spark, d)).select("id", "type", "verticies", "number_properties")


@q("stats_string", SIZED + "SELECT id, 'Point,1,3,' || payload AS line FROM al")
def stats_string(spark, d):
    """Whole lines are made; the SQL has no size of the JSON text, which is cut out of them."""
    x = F.split("line", ",")
    return A.stats_string(V.points(spark, d)).select("id", F.concat_ws(",", x[0], x[1], x[2], x[4]).alias("line"))


# --- geometry ----------------------------------------------------------------

for _name, _view, _sql in (
    ("bbox_point", "points", with_("pt") + f"SELECT id, {QBOX} FROM pt GROUP BY id"),
    ("bbox_multipoint", "multipoints", with_("mp") + f"SELECT id, {QBOX} FROM mp GROUP BY id"),
    ("bbox_linestring", "lines", with_("ln") + f"SELECT id, {QBOX} FROM ln GROUP BY id"),
    ("bbox_multilinestring", "multilines", with_("ln") + f"SELECT id, {QBOX} FROM ln GROUP BY id"),
    ("bbox_polygon", "polygons", with_("po") + f"SELECT id, {QBOX} FROM po GROUP BY id"),
    ("bbox_multipolygon", "multipolygons", with_("po") + f"SELECT id, {QBOX} FROM mo GROUP BY id"),
):
    q(_name, _sql)(lambda spark, d, v=_view: qbounds(V.ALL[v](spark, d)))


@q("bbox_any", with_("pt", "po") + f"SELECT 'Point' AS geom_type, {QBOX} FROM pt UNION ALL SELECT 'Polygon', {QBOX} FROM po UNION ALL SELECT 'MultiPolygon', {QBOX} FROM mo")
def bbox_any(spark, d):
    rows = R.merge(V.points(spark, d), V.polygons(spark, d), V.multipolygons(spark, d)).select("geom_type", G.bbox().alias("bbox"))
    b = rows.groupBy("geom_type").agg(*S.bounds())
    return b.select("geom_type", *[G.quantize(k).alias(n) for k, n in zip(("w", "s", "e", "north"), ("qw", "qs", "qe", "qn"))])


@q("bbox_collection", with_("pt", "po") + f"SELECT id, {QBOX} FROM (SELECT id, lon, lat FROM pt UNION ALL SELECT id, lon, lat FROM po) GROUP BY id")
def bbox_collection(spark, d):
    members = R.merge(V.points(spark, d), V.polygons(spark, d)).select("id", "bbox")
    c = members.groupBy("id").agg(F.collect_list("bbox").alias("bs")).select("id", G.bbox_union("bs").alias("bbox"))
    return qbounds(c)


@q("bbox_points", with_("ln") + f"SELECT id, {QBOX} FROM ln GROUP BY id")
def bbox_points(spark, d):
    return qbounds(V.lines(spark, d).select("id", G.bbox(F.array(F.array(G.positions()))).alias("bbox")))


@q("bbox_points_root", with_("ln") + f"SELECT id, {QBOX} FROM (SELECT id, lon + 500 AS lon, lat FROM ln) GROUP BY id")
def bbox_points_root(spark, d):
    """Seeded with the positions, so a set beyond the sentinel isn't clamped."""
    far = F.transform(G.positions(), lambda p: F.array(p[0] + 500, p[1]))
    return qbounds(V.lines(spark, d).select("id", G.bbox(F.array(F.array(far))).alias("bbox")))


@q("geom_dims", with_("pt") + "SELECT id, CAST(id % 3 + 2 AS BIGINT) AS dims FROM pt")
def geom_dims(spark, d):
    x, y = first_position()
    p = F.slice(F.array(x, y, F.lit(1.0), F.lit(2.0)), F.lit(1), (F.col("id") % 3 + 2).cast("int"))
    return V.points(spark, d).select("id", G.dims(F.array(F.array(F.array(p)))).cast("long").alias("dims"))


_CODE = "SELECT k AS t, d, CASE WHEN d = 2 THEN k ELSE k * 16 + d END AS code FROM range(1, 7) AS a(k), range(2, 5) AS b(d)"


def _codes(spark: SparkSession) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")])
    t = spark.range(1).select(F.posexplode(kinds).alias("k", "geom_type")).select((F.col("k") + 1).alias("t"), "geom_type")
    return t.select("t", "geom_type", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("d"))


@q("geom_code", f"SELECT CAST(t AS BIGINT) AS t, CAST(d AS BIGINT) AS d, CAST(code AS BIGINT) AS code FROM ({_CODE})")
def geom_code(spark, d):
    return _codes(spark).select(F.col("t").cast("long"), F.col("d").cast("long"), G.geom_code("geom_type", "d").cast("long").alias("code"))


@q("geom_code_parse", f"SELECT CAST(code AS BIGINT) AS code, CAST(t AS BIGINT) AS t, CAST(d AS BIGINT) AS d FROM ({_CODE})")
def geom_code_parse(spark, d):
    c = _codes(spark).select(G.geom_code("geom_type", "d").alias("code"))
    return c.select(F.col("code").cast("long"), G.code_type("code").cast("long").alias("t"), G.code_dims("code").cast("long").alias("d"))


@q("vertex_count", with_("mp") + "SELECT id, CAST(count(*) AS BIGINT) AS n FROM mp GROUP BY id")
def vertex_count(spark, d):
    return V.multipoints(spark, d).select("id", G.vertex_count().cast("long").alias("n"))


_X12, _Y12 = tile_sql("lon", "lat", 12)


@q("tile_of", with_("pt") + f"SELECT id, {_X12} AS x, {_Y12} AS y, CAST(12 AS INT) AS z FROM pt")
def tile_of(spark, d):
    x, y = first_position()
    return V.points(spark, d).select("id", T.tile_of(x, y, 12).alias("t")).select("id", "t.x", "t.y", "t.z")


@q("tile_parent", with_("pt") + f"SELECT id, {_X12} // 16 AS x, {_Y12} // 16 AS y, CAST(8 AS INT) AS z FROM pt")
def tile_parent(spark, d):
    x, y = first_position()
    return V.points(spark, d).select("id", T.tile_parent(T.tile_of(x, y, 12), 4).alias("t")).select("id", "t.x", "t.y", "t.z")


@q("tile_str", with_("pt") + f"SELECT id, {_KEY6} AS key FROM pt")
def tile_str(spark, d):
    return tiled(spark, d).select("id", "key")


@q("tile_parse", with_("pt") + f"SELECT id, {_X6} AS x, {_Y6} AS y, CAST(6 AS INT) AS z FROM pt")
def tile_parse(spark, d):
    return tiled(spark, d).select("id", T.tile_parse("key").alias("t")).select("id", "t.x", "t.y", "t.z")


_A, _B = tile_sql("max(lon)", "max(lat)", 14), tile_sql("min(lon)", "min(lat)", 14)
_GRID = with_("po") + f", gr AS (SELECT id, abs({_A[0]} - {_B[0]}) * abs({_A[1]} - {_B[1]}) AS size FROM po GROUP BY id)"


@q("grid_size", _GRID + " SELECT id, CAST(size AS BIGINT) AS size FROM gr")
def grid_size(spark, d):
    return V.polygons(spark, d).select("id", T.grid_size("bbox", 14).alias("size"))


_SHRINK = "CASE " + " ".join(f"WHEN size // {4**k} <= 750 THEN {14 - k}" for k in range(16)) + " END"


@q("start_zoom", _GRID + f" SELECT id, CAST({_SHRINK} AS BIGINT) AS zoom FROM gr")
def start_zoom(spark, d):
    return V.polygons(spark, d).select("id", T.start_zoom(T.grid_size("bbox", 14), 14).cast("long").alias("zoom"))


@q("zoom_steps", "SELECT CAST(f AS BIGINT) AS first, CAST(least(f + 4 * k, 14) AS BIGINT) AS zoom FROM range(0, 15) AS a(f), range(1, 5) AS b(k) WHERE f + 4 * (k - 1) < 14")
def zoom_steps(spark, d):
    rows = [(f, z) for f in range(15) for z in T.zoom_steps(f, 14)]  # planning helper: a fixed table of zooms
    return spark.createDataFrame(rows, "first long, zoom long")


# --- encoding and arithmetic -------------------------------------------------


@q("quantize", with_("pt") + f"SELECT id, {qz('lon')} AS qx, {qz('lat')} AS qy FROM pt")
def quantize(spark, d):
    x, y = first_position()
    return V.points(spark, d).select("id", G.quantize(x).alias("qx"), G.quantize(y).alias("qy"))


@q("zigzag", with_("pt") + f"SELECT id, {zz(qz('lon'))} AS zx, {qz('lon')} AS qx FROM pt")
def zigzag(spark, d):
    z = V.points(spark, d).select("id", G.zigzag(G.quantize(first_position()[0])).alias("zx"))
    return z.select("id", "zx", G.unzigzag("zx").alias("qx"))


@q("round_half", with_("pt") + "SELECT id, CAST(CASE WHEN lon < 0 THEN floor(lon * 10.0::DOUBLE) ELSE floor(lon * 10.0::DOUBLE + 0.5::DOUBLE) END AS BIGINT) AS r FROM pt")
def round_half(spark, d):
    return V.points(spark, d).select("id", F.round(G.round_half(first_position()[0], 1) * 10).cast("long").alias("r"))


def _ordinates(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d).select("id", F.transform(G.positions(), lambda p: G.quantize(p[0])).alias("qx"))


@q("delta", with_("ln") + f", dl AS ({_delta_sql('ln', '0')}) SELECT id, CAST(i AS BIGINT) AS i, dx FROM dl")
def delta(spark, d):
    v = _ordinates(spark, d).select("id", F.posexplode(G.delta("qx")).alias("i", "dx"))
    return v.select("id", F.col("i").cast("long").alias("i"), "dx")


@q("undelta", with_("ln") + f"SELECT id, CAST(i AS BIGINT) AS i, {qz('lon')} AS qx FROM ln")
def undelta(spark, d):
    v = _ordinates(spark, d).select("id", F.posexplode(G.undelta(G.delta("qx"))).alias("i", "qx"))
    return v.select("id", F.col("i").cast("long").alias("i"), "qx")


@q("varint", with_("pt") + f"SELECT id, CAST({vl(zz(qz('lon')))} AS BIGINT) AS n FROM pt")
def varint(spark, d):
    return V.points(spark, d).select("id", G.varint_size(G.zigzag(G.quantize(first_position()[0]))).cast("long").alias("n"))


@q("packed_u64", with_("ln") + f", dl AS ({_delta_sql('ln', '0')}) SELECT id, CAST({_VSUM} AS BIGINT) AS n FROM dl GROUP BY id")
def packed_u64(spark, d):
    return V.lines(spark, d).select("id", G.line_size(G.positions()).cast("long").alias("n"))


@q("packed_size", SIZED + "SELECT id, payload FROM al")
def packed_size(spark, d):
    return V.points(spark, d).select("id", A.packed_size().alias("payload"))


@q("append_all", with_("pt") + "SELECT id, lower(hex(encode(name))) || lower(hex(encode(segment))) AS bytes FROM pt")
def append_all(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("id"), F.lower(F.hex(F.concat(F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")))).alias("bytes"))


def _value_roundtrip(tag: int, x: Callable[[], Column], field: str, name: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = V.points(spark, d).withColumn("properties", P.make(v=P.value(x(), tag)))
        f = rows.select(codec.decode_feature(codec.encode_feature()).alias("f"))
        return f.select("f.id", F.col("f.properties")["v"]["tag"].cast("long").alias("tag"), F.col("f.properties")["v"][field].alias(name))

    return run


q("write_value", with_("pt") + "SELECT id, CAST(4 AS BIGINT) AS tag, -id AS v FROM pt")(_value_roundtrip(4, lambda: -F.col("id"), "i", "v"))
q("float64_val", with_("pt") + "SELECT id, CAST(3 AS BIGINT) AS tag, acctbal AS v FROM pt")(_value_roundtrip(3, lambda: P.get("properties", "acctbal")["d"], "d", "v"))


@q("float32_val", with_("pt") + "SELECT id, CAST(2 AS BIGINT) AS tag, CAST(CAST(id AS FLOAT) AS DOUBLE) / 2 AS v FROM pt")
def float32_val(spark, d):
    f = _value_roundtrip(2, lambda: F.col("id").cast("float"), "f", "v")(spark, d)
    return f.select("id", "tag", (F.col("v").cast("double") / 2).alias("v"))


@q("varint_value", with_("pt") + "SELECT id, CAST(5 AS BIGINT) AS tag, id AS v FROM pt")
def varint_value(spark, d):
    return _value_roundtrip(5, lambda: F.col("id").cast("decimal(20,0)"), "u", "v")(spark, d).withColumn("v", F.col("v").cast("long"))


@q("write_keyvalue", with_("pt") + "SELECT id, CAST(7 AS BIGINT) AS tag, (id % 2 = 0) AS v FROM pt")
def write_keyvalue(spark, d):
    return _value_roundtrip(7, lambda: F.col("id") % 2 == 0, "b", "v")(spark, d)


@q("read_bbox_fields", with_("ln") + f"SELECT id, {QBOX} FROM ln GROUP BY id")
def read_bbox_fields(spark, d):
    p = V.lines(spark, d).select("id", codec.payload_bbox(codec.encode_feature()).alias("bbox"))
    return p.select("id", *[unit(f"bbox.{k}").alias(n) for k, n in zip("wsen", ("qw", "qs", "qe", "qn"))])


# --- texts and maps ----------------------------------------------------------


@q("json_emit", with_("pt") + f"SELECT id, name, acctbal, {qz('lon')} AS qx FROM pt")
def json_emit(spark, d):
    text = V.points(spark, d).select(J.feature_json().alias("t"))
    j = text.select(F.from_json("t", "id bigint, properties struct<name:string, acctbal:double>, geometry struct<coordinates:array<double>>").alias("j"))
    return j.select("j.id", "j.properties.name", "j.properties.acctbal", G.quantize(F.col("j.geometry.coordinates")[0]).alias("qx"))


@q("map_set", with_("pt") + "SELECT id, 'x' || id AS name, CAST(4 AS BIGINT) AS n FROM pt")
def map_set(spark, d):
    props = P.map_set(P.map_set("properties", "name", P.text(F.concat(F.lit("x"), F.col("id").cast("string")))), "TILEID", P.text(F.lit("0-0-0")))
    p = V.points(spark, d).withColumn("properties", props)
    return p.select("id", P.map_get_default("properties", "name").alias("name"), F.size("properties").cast("long").alias("n"))


@q("map_get_default", with_("pt") + "SELECT id, segment, '' AS missing FROM pt")
def map_get_default(spark, d):
    return V.points(spark, d).select("id", P.map_get_default("properties", "segment").alias("segment"), P.map_get_default("properties", "no such key").alias("missing"))


@q("str_join", with_("pt") + "SELECT id, name || '|' || segment AS line FROM pt")
def str_join(spark, d):
    return V.points(spark, d).select("id", F.concat_ws("|", P.map_get_default("properties", "name"), P.map_get_default("properties", "segment")).alias("line"))


@q("value_to_string", with_("pt") + "SELECT id, CAST(id AS VARCHAR) AS whole, CAST(id AS VARCHAR) || '.5' AS half, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS flag FROM pt")
def value_to_string(spark, d):
    s = P.value_to_string
    return V.points(spark, d).select("id", s(P.number(F.col("id"))).alias("whole"), s(P.number(F.col("id") + 0.5)).alias("half"), s(P.value(F.col("id") % 2 == 0, 7)).alias("flag"))


@q("str_contains", with_("pt") + "SELECT id, contains(name, '00007') AS has FROM pt")
def str_contains(spark, d):
    return V.points(spark, d).select("id", P.map_get_default("properties", "name").contains("00007").alias("has"))


# --- conversions -------------------------------------------------------------


@q("geojson_to_packed", QPOINT)
def geojson_to_packed(spark, d):
    register(spark)
    path = fresh_path(spark, "converted")
    J.read(spark, _geojson_path(spark, d, True), lines=True).write.format("packedfeature").mode("append").save(path)
    return qpoint(R.scan(spark, path))


@q("add_features", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def add_features(spark, d):
    register(spark)
    path = fresh_path(spark, "added")
    J.nonnull(J.parse(events_json(spark, d))).write.format("packedfeature").mode("append").save(path)
    return R.scan(spark, path, columns="id").agg(F.count(F.lit(1)).alias("n"))


@q("packed_to_geojson", with_("po") + f"SELECT id, {QBOX} FROM mo GROUP BY id")
def packed_to_geojson(spark, d):
    path = fresh_path(spark, "geojson-out")
    J.write_collection(R.scan(spark, packed_copy(spark, d, "multipolygons")), path)
    b = J.read(spark, path)
    return b.select("id", *[unit(f"bbox.{k}").alias(n) for k, n in zip("wsen", ("qw", "qs", "qe", "qn"))])


@q("packed_to_pipe", with_("pt") + "SELECT name, 'Point' AS Type, CAST(count(*) AS BIGINT) AS n FROM pt GROUP BY 1")
def packed_to_pipe(spark, d):
    path = fresh_path(spark, "pipe-legacy")
    X.pipe_export(R.scan(spark, packed_copy(spark, d)), path, legacy=True)
    cols = F.split("value", r"\|")
    t = spark.read.text(path).select(cols[X.COMMON.index("name")].alias("name"), cols[len(X.COMMON) + 1].alias("Type"))
    return t.groupBy("name", "Type").agg(F.count(F.lit(1)).alias("n"))


@q("bench_read", "SELECT CAST((SELECT count(*) FROM part) AS BIGINT) AS n, CAST((SELECT count(*) * 10 FROM part) AS BIGINT) AS positions")
def bench_read(spark, d):
    f = R.scan(spark, packed_copy(spark, d, "multipolygons", ordered=False))
    return f.agg(F.count(F.lit(1)).alias("n"), F.sum(G.vertex_count()).cast("long").alias("positions"))


@q("bench_write", with_("ln") + "SELECT CAST(count(DISTINCT id) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS positions FROM ln")
def bench_write(spark, d):
    register(spark)
    path = fresh_path(spark, "bench")
    V.lines(spark, d).write.format("packedfeature").mode("append").save(path)
    return R.scan(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(G.vertex_count()).cast("long").alias("positions"))


@q("progress_log", with_("pt") + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) // 100 AS BIGINT) AS steps FROM pt")
def progress_log(spark, d):
    rows, seen = A.progress(V.points(spark, d), 100)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["steps"])], "n long, steps long")


@q("stream_append", QPOINT)
def stream_append(spark, d):
    """A packed folder read as a stream to its present end."""
    register(spark)
    path, out = packed_copy(spark, d), fresh_path(spark, "stream")
    s = spark.readStream.format("packedfeature").load(path)
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    return qpoint(spark.read.parquet(out))
