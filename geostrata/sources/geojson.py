"""GeoJSON in and out: collections, lines and columns.

A collection is one JSON value, but it is cut all the same: every chunk is first
summed up (does it end in a text, by how much does the depth change) for both
states it may begin in; a walk over the sums tells each chunk's real state, and
then every chunk's task cuts out the features that begin in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import properties as P
from ..schema import BBOX, TYPES
from .packed import file_system

#: Bytes of a collection that one task reads at a time.
CHUNK_BYTES = 10 << 20
#: Bytes of a chunk that are looked through at a time.
BLOCK = 1 << 18
#: Bytes behind a chunk that are read first for its last feature.
MORE = 1 << 16
_STEP = np.zeros(256, np.int8)
_STEP[[123, 91]], _STEP[[125, 93]] = 1, -1
_PACKED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")

#: Ordinates' nesting by type: dimensions of the coordinates array.
_DEPTH = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def read_texts(spark: SparkSession, path: str, lines: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One JSON text per feature: ``(feature)``.

    A file is one FeatureCollection, read in chunks by many tasks; with ``lines``
    every line is a feature.  Members of a collection that are no objects are
    passed over.  Compressed files are read whole, as they can't be cut.
    """
    if lines:
        return spark.read.text(path).select(F.col("value").alias("feature")).where(F.length(F.trim("feature")) > 0)
    sizes = {f: n for f, n in file_sizes(path)}
    if not sizes or any(f.endswith(_PACKED) for f in sizes):
        return chunk(spark.read.text(path, wholetext=True), "value")
    rows = [(f, a, min(n, a + chunk_bytes), n <= chunk_bytes) for f, n in sizes.items() for a in range(0, n, chunk_bytes)]
    schema = "file string, start long, stop long, alone boolean"
    parts = min(len(rows), max(1, 4 * spark.sparkContext.defaultParallelism)) or 1
    spread = lambda x, s: spark.createDataFrame(x, s).repartition(max(1, min(parts, len(x))))
    cut = [r for r in rows if not r[3]]
    begin = _begins(spread(cut, schema).mapInArrow(_summaries(path), _SUMMARY).toArrow().to_pylist()) if cut else {}
    known = [(f, a, z, *begin.get((f, a), (False, 0, -1))) for f, a, z, _ in rows]
    known = [r for r in known if r[5] < r[2]]  # the others lie before or behind the features
    if not known:
        return spark.createDataFrame([], "feature string")
    return spread(known, "file string, start long, stop long, quoted boolean, depth long, first long").mapInArrow(_cutter(path), "feature string")


def file_sizes(path: str) -> list[tuple[str, int]]:
    """Data files of a location and their sizes."""
    import pyarrow.fs as fs

    system, p = file_system(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(p, info.size)]
    if info.type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(p, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _structure(buf: np.ndarray, escaped: bool, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Places of the brackets outside texts and by how much each changes the depth,
    and whether what follows is escaped and lies in a text.  escaped: a backslash
    before the first byte makes it one of a text."""
    n = len(buf)
    slash = np.flatnonzero(buf == 92)
    odd = np.zeros(n + 1, bool)  # behind an odd number of backslashes
    odd[0] = escaped
    if len(slash):
        fresh = np.diff(slash, prepend=-2) > 1
        begin = slash[fresh][np.cumsum(fresh) - 1]
        odd[slash + 1] = (slash - begin + 1 + (escaped & (begin == 0))) % 2 == 1
    mark = (buf == 34) & ~odd[:n]
    at = np.flatnonzero(_STEP[buf])
    inside = (np.searchsorted(np.flatnonzero(mark), at) + quoted) % 2 == 1
    at = at[~inside]
    return at, _STEP[buf[at]].astype(np.int64), bool(odd[n]), bool((int(mark.sum()) + quoted) % 2)


def _brackets(raw: bytes, start: int, escaped: bool, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """``_structure`` of bytes from a place on, block by block: memory follows the
    brackets' number, not the bytes'."""
    places, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(start, len(raw), BLOCK):
        at, step, escaped, quoted = _structure(np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - k), k), escaped, quoted)
        places.append(at + k)
        steps.append(step)
    return np.concatenate(places), np.concatenate(steps), escaped, quoted


_COLUMNS = ("file", "start", "quoted", "after", "change", "at", "depths", "ends", "lows")
_SUMMARY = "file string, start long, quoted boolean, after boolean, change long, at array<long>, depths array<long>, ends array<long>, lows array<long>"
_FEATURES = re.compile(rb'"features"[ \t\r\n]*:[ \t\r\n]*\[')


def _open_chunk(system, file: str, start: int, stop: int) -> tuple[bytes, bool, bytes]:  # noqa: ANN001
    """A chunk's bytes, whether its first is escaped, and what lies before it."""
    with system.open_input_file(file) as f:
        back = min(start, 256)
        while back < start and not f.read_at(back, start - back).strip(b"\\"):
            back = min(start, 2 * back)
        lead = f.read_at(back, start - back)
        return f.read_at(stop - start, start), (len(lead) - len(lead.rstrip(b"\\"))) % 2 == 1, lead[-256:]


def _summaries(path: str) -> Callable:
    """Of chunks, by whether they begin in a text: whether they end in one, the
    change of depth, where an array of features opens, at which depth, and where it
    ends (-1: not here), and where the depth first falls by 1, 2, ..."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        system, _ = file_system(path)
        for b in batches:
            out = []
            for row in b.to_pylist():
                raw, escaped, lead = _open_chunk(system, row["file"], row["start"], row["stop"])
                ends = [m.end() - 1 - len(lead) for m in _FEATURES.finditer(lead + raw)]
                ends = np.array([e for e in ends if e >= 0], np.int64)
                for quoted in (False, True):
                    place, step, _, last = _brackets(raw, 0, escaped, quoted)
                    depth = np.cumsum(step)
                    k = np.flatnonzero(np.isin(place, ends))
                    stops = [i + np.argmax(depth[i:] < depth[i]) for i in k.tolist()]
                    stops = [row["start"] + int(place[x]) if depth[x] < depth[i] else -1 for i, x in zip(k.tolist(), stops)]
                    low = np.minimum.accumulate(np.minimum(depth, 0))
                    lows = (row["start"] + place[np.diff(low, prepend=0) < 0]).tolist()
                    out.append((row["file"], row["start"], quoted, last, int(step.sum()), (row["start"] + place[k]).tolist(), depth[k].tolist(), stops, lows))
            yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, r)) for r in out], _summary_schema())

    return run


def _summary_schema():  # noqa: ANN202
    import pyarrow as pa

    long = pa.int64()
    return pa.schema(list(zip(_COLUMNS, (pa.string(), long, pa.bool_(), pa.bool_(), long, *[pa.list_(long)] * 4))))


def _begins(rows: list[dict]) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Of each chunk: whether it begins in a text, its depth, and where the features
    begin (beyond any file for chunks behind their end, and if nowhere)."""
    by, nowhere = {(r["file"], r["start"], r["quoted"]): r for r in rows}, 1 << 62
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, quoted, depth, first, last = None, False, 0, nowhere, -1
    for name, start in sorted({(r["file"], r["start"]) for r in rows}):
        if name != file:
            file, quoted, depth, first, last = name, False, 0, nowhere, -1
        r = by[name, start, quoted]
        if first == nowhere:
            found = [(at, end) for at, d, end in zip(r["at"], r["depths"], r["ends"]) if depth + d == 2]
            if found:
                first, last = found[0][0] + 1, found[0][1]
                out.update({k: (*v[:2], first) for k, v in out.items() if k[0] == name})
            out[name, start] = (quoted, depth, first)
        elif last >= 0:
            out[name, start] = (quoted, depth, nowhere)
        else:
            out[name, start] = (quoted, depth, first)
            if len(r["lows"]) >= depth - 1:  # here the depth falls to 1: the array ends
                last = r["lows"][depth - 2]
        quoted, depth = r["after"], depth + r["change"]
    return out


def _cutter(path: str) -> Callable:
    """The features that begin in a chunk, as texts."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        system, _ = file_system(path)
        for b in batches:
            for row in b.to_pylist():
                raw, opens, closes = _features_of(system, row)
                for k in range(0, len(opens), 4096):
                    texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(opens[k : k + 4096].tolist(), closes[k : k + 4096].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["feature"])

    return run


def _features_of(system, row: dict) -> tuple[bytes, np.ndarray, np.ndarray]:  # noqa: ANN001
    """A chunk's bytes, with those behind it that its last feature takes up, and
    the features' starts and ends in them."""
    file, start, stop = row["file"], row["start"], row["stop"]
    raw, escaped, _ = _open_chunk(system, file, start, stop)
    own, quoted = len(raw), row["quoted"]
    place, step, escaped, quoted = _brackets(raw, 0, escaped, quoted)
    while True:
        depth, byte = row["depth"] + np.cumsum(step), np.frombuffer(raw, np.uint8)[place]
        first = row["first"] - start
        if row["first"] < 0:  # the file's only chunk
            two = set(place[(byte == 91) & (depth == 2)].tolist())
            first = next((m.end() for m in _FEATURES.finditer(raw) if m.end() - 1 in two), len(raw))
        first = max(0, first)
        end = place[(place >= first) & (depth == 1) & (step < 0)]  # the array's end
        until = int(end[0]) if len(end) else len(raw)
        opens = place[(byte == 123) & (depth == 3)]
        opens = opens[(opens >= first) & (opens < min(until, own))]
        closes = place[(byte == 125) & (depth == 2)]
        nxt = np.searchsorted(closes, opens)
        closes = closes[nxt[nxt < len(closes)]]
        if len(closes) == len(opens):
            return raw, opens, closes + 1
        with system.open_input_file(file) as f:  # the last feature goes on in the next chunk
            more = f.read_at(max(MORE, len(raw) - own), start + len(raw))
        if not more:
            return raw, opens[: len(closes)], closes + 1
        k = len(raw)
        raw += more
        at, steps, escaped, quoted = _brackets(raw, k, escaped, quoted)
        place, step = np.concatenate([place, at]), np.concatenate([step, steps])


def chunk(df: DataFrame, col: str) -> DataFrame:
    """The features of collections as texts, by a real parser."""
    items = F.from_json(F.col(col), "features array<string>")["features"]
    return df.select(F.explode(items).alias("feature"))


def _coords(kind: Column, raw: Column) -> Column:
    out = F.lit(None).cast("array<array<array<array<double>>>>")
    wrap = {1: lambda c: F.array(F.array(F.array(c))), 2: lambda c: F.array(F.array(c)), 3: lambda c: F.array(c), 4: lambda c: c}
    empty = F.array().cast("array<array<array<array<double>>>>")
    full = lambda d: lambda x: F.when(F.size(x) > 0, wrap[d](x)).otherwise(empty)
    for d in (4, 3, 2, 1):
        c = F.from_json(raw, "array<" * d + "double" + ">" * d)
        out = F.when(kind.isin(*[t for t in TYPES if _DEPTH[t] == d]), F.transform(F.array(c), full(d))[0]).otherwise(out)  # parsed once
    return out


def parse(df: DataFrame, col: str = "feature", keep_json: bool = False) -> DataFrame:
    """Feature rows of JSON texts, and ``_corrupt_record``: texts that are no
    feature, or whose geometry has no packed form.  Features without geometry
    have NULL geometry columns."""
    top = F.from_json(F.col(col), "type string, id string, properties string, geometry struct<type:string, coordinates:string>", {"mode": "PERMISSIVE"})
    rows = df.select(F.col(col).alias("_text"), top.alias("j"))
    kind = F.col("j.geometry.type")
    known = kind.isin(*TYPES)
    bad = F.col("j").isNull() | ~F.coalesce(F.col("j.type") == "Feature", F.lit(False)) | (kind.isNotNull() & ~known)
    ident = F.when(F.col("j.id").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.expr("try_cast(split(j.id, '[.]')[0] AS bigint)"))
    coords = _coords(kind, F.col("j.geometry.coordinates"))
    out = rows.select(
        ident.alias("id"),
        F.coalesce(P.from_json(F.col("j.properties"), keep_json), P.empty()).alias("properties"),
        F.when(~bad, kind).alias("geom_type"), F.when(~bad, coords).alias("coords"), F.when(bad, F.col("_text")).alias("_corrupt_record"),
    )
    out = out.withColumn("dims", F.when(F.col("geom_type").isNotNull(), G.dims("coords"))).withColumn("bbox", G.bbox("coords"))
    return out.select("id", "properties", "geom_type", "dims", "coords", F.col("bbox").cast(BBOX).alias("bbox"), "_corrupt_record")


def nonnull(rows: DataFrame) -> DataFrame:
    """Parsed features that have a geometry, as feature rows."""
    return rows.where(F.col("_corrupt_record").isNull() & F.col("geom_type").isNotNull()).drop("_corrupt_record")


def read(spark: SparkSession, path: str, lines: bool = False, keep_json: bool = False) -> DataFrame:
    return nonnull(parse(read_texts(spark, path, lines), keep_json=keep_json))


def geometry_json(kind: Column | str = "geom_type", coords: Column | str = "coords") -> Column:
    """A geometry's GeoJSON text; NULL without one."""
    k, c = (F.col(x) if isinstance(x, str) else x for x in (kind, coords))
    inner = {1: lambda: c[0][0][0], 2: lambda: c[0][0], 3: lambda: c[0], 4: lambda: c}
    out = F.lit(None).cast("string")
    for name in TYPES:
        v = F.when(F.size(c) > 0, F.to_json(inner[_DEPTH[name]]())).otherwise("[]")
        out = F.when(k == name, F.concat(F.lit(f'{{"type":"{name}","coordinates":'), v, F.lit("}"))).otherwise(out)
    return out


def feature_json() -> Column:
    """A feature row's GeoJSON text."""
    ident = F.when(F.col("id").isNotNull(), F.concat(F.lit('"id":'), F.col("id").cast("string"), F.lit(","))).otherwise("")
    box = F.when(F.col("bbox").isNotNull(), F.concat(F.lit('"bbox":'), F.to_json(F.array("bbox.w", "bbox.s", "bbox.e", "bbox.n")), F.lit(","))).otherwise("")
    geom = F.coalesce(geometry_json(), F.lit("null"))
    return F.concat(F.lit("{"), ident, F.lit('"type":"Feature",'), box, F.lit('"geometry":'), geom, F.lit(',"properties":'), P.props_json(), F.lit("}"))


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Features as lines, one file per task."""
    rows.select(feature_json().alias("value")).write.mode(mode).text(path)


def write_collection(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every task's features as one collection per file.

    Lines between a head and a tail, joined by the text sink's line separator.
    """
    body = rows.select(feature_json().alias("value"))

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        first = True
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                lead = '{"type":"FeatureCollection","features":[' if first else ","
                yield pa.RecordBatch.from_arrays([pa.array([(lead if k == 0 else ",") + t for k, t in enumerate(texts)])], ["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(['{"type":"FeatureCollection","features":[]}' if first else "]}"])], ["value"])

    body.mapInArrow(run, "value string").write.mode(mode).text(path)
