"""Web-map tiles: numbers, parents, keys, covers and planning helpers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("z", T.IntegerType())])
#: Tiles of a grid that a first pass may have, and zoom levels of a later one.
GRID, STEP = 750, 4


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tile_of(lon: Column | str, lat: Column | str, zoom: int) -> Column:
    """The tile of a position (spherical Mercator), kept within the grid."""
    n = 1 << zoom
    phi = F.radians(_c(lat))
    x = F.floor((_c(lon) + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n)
    clamp = lambda v: F.least(F.greatest(v, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    return F.struct(clamp(x).alias("x"), clamp(y).alias("y"), F.lit(zoom).alias("z"))


def tile_parent(tile: Column | str, levels: int = 1) -> Column:
    t = _c(tile)
    return F.struct(F.shiftright(t["x"], levels).alias("x"), F.shiftright(t["y"], levels).alias("y"), (t["z"] - levels).alias("z"))


def tile_at(tile: Column | str, zoom: int) -> Column:
    """The ancestor at a zoom; NULL when the tile is already coarser."""
    t = _c(tile)
    k = t["z"] - zoom
    up = lambda v: F.expr("0").cast("long") + F.floor(v / F.pow(F.lit(2.0), k))
    return F.when(k >= 0, F.struct(up(t["x"]).alias("x"), up(t["y"]).alias("y"), F.lit(zoom).alias("z")))


def tile_str(tile: Column | str) -> Column:
    t = _c(tile)
    return F.concat_ws("-", t["x"].cast("string"), t["y"].cast("string"), t["z"].cast("string"))


def tile_parse(key: Column | str) -> Column:
    """The tile of a key; NULL when the key isn't one."""
    p = F.split(_c(key), "-")
    ok = _c(key).rlike(r"^\d+-\d+-\d+$")
    return F.when(ok, F.struct(p[0].cast("long").alias("x"), p[1].cast("long").alias("y"), p[2].cast("int").alias("z")))


def grid_size(bounds: Column | str, zoom: int) -> Column:
    """Estimated tiles of a rectangle: the product of its tile distances."""
    b = _c(bounds)
    a, z = tile_of(b["e"], b["n"], zoom), tile_of(b["w"], b["s"], zoom)
    return F.abs(a["x"] - z["x"]) * F.abs(a["y"] - z["y"])


def start_zoom(size: Column | str, zoom: Column | int, most: int = GRID) -> Column:
    """Zoom at which a grid of that size has shrunk to at most ``most`` tiles, a
    level for every quarter (integer division)."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(_c(size).cast("long").alias("n"), F.lit(0).alias("k")),
        lambda a, _: F.struct(F.when(a["n"] > most, F.floor(a["n"] / 4)).otherwise(a["n"]).alias("n"), (a["k"] + (a["n"] > most).cast("int")).alias("k")),
        lambda a: a["k"],
    )
    return (F.lit(zoom) if isinstance(zoom, int) else zoom) - steps


def zoom_steps(first: int, last: int, step: int = STEP) -> list[int]:
    """Zooms that refinement in steps would stop at (a planning helper)."""
    return [*range(first + step, last, step), last] if first < last else []


def bbox_tiles(bounds: Column | str, zoom: int) -> Column:
    """All tiles that a rectangle meets, as an array."""
    b = _c(bounds)
    nw, se = tile_of(b["w"], b["n"], zoom), tile_of(b["e"], b["s"], zoom)
    return F.flatten(
        F.transform(
            F.sequence(nw["x"], se["x"]),
            lambda x: F.transform(F.sequence(nw["y"], se["y"]), lambda y: F.struct(x.alias("x"), y.alias("y"), F.lit(zoom).alias("z"))),
        )
    )


def _mercator(lon: float, lat: float, n: int) -> tuple[float, float]:
    phi = math.radians(max(-85.0511287798066, min(85.0511287798066, lat)))
    return (lon + 180.0) / 360.0 * n, (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n


def _segment(a: tuple, b: tuple, n: int, out: set) -> None:
    """Tiles that a segment passes: split at every grid line it crosses."""
    (x0, y0), (x1, y1) = a, b
    cuts = {0.0, 1.0}
    for p, q in ((x0, x1), (y0, y1)):
        if p != q:
            lo, hi = sorted((p, q))
            cuts.update((k - p) / (q - p) for k in range(math.ceil(lo), math.floor(hi) + 1))
    ts = sorted(t for t in cuts if 0 <= t <= 1)
    for t in [*ts, *[(u + v) / 2 for u, v in zip(ts, ts[1:])]]:
        x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
        out.add((min(max(int(x), 0), n - 1), min(max(int(y), 0), n - 1)))


def cover(geom_type: str, coords: list, zoom: int) -> list[dict]:
    """Tiles that a geometry meets: its vertices, the paths of its segments and,
    for polygons, the tiles whose centre lies inside (even-odd over all rings)."""
    n, out = 1 << zoom, set()
    for polygon in coords or []:
        rings = [[_mercator(p[0], p[1], n) for p in line] for line in polygon or []]
        for ring in rings:
            for x, y in ring:
                out.add((min(max(int(x), 0), n - 1), min(max(int(y), 0), n - 1)))
            if geom_type not in ("Point", "MultiPoint"):
                for a, b in zip(ring, ring[1:]):
                    _segment(a, b, n, out)
        if geom_type in ("Polygon", "MultiPolygon") and rings and any(rings):
            ys = [y for r in rings for _, y in r]
            for row in range(max(0, math.floor(min(ys))), min(n - 1, math.floor(max(ys))) + 1):
                y, xs = row + 0.5, []
                for ring in rings:
                    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
                        if (y0 <= y) != (y1 <= y):
                            xs.append(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
                xs.sort()
                for x0, x1 in zip(xs[::2], xs[1::2]):
                    out.update((x, row) for x in range(max(0, math.ceil(x0 - 0.5)), min(n - 1, math.floor(x1 - 0.5)) + 1))
    return [{"x": x, "y": y, "z": zoom} for x, y in sorted(out)]


def _clamp(v: np.ndarray, n: int) -> np.ndarray:
    return np.clip(np.trunc(v).astype(np.int64), 0, n - 1)


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every pair the whole numbers from first to last: owner and number."""
    size = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(first)), size)
    return owner, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + first[owner]


def cover_batch(types: pa.Array, geometries: pa.Array, zoom: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cover`` of a batch: record, x and y of every tile, in order.  Raises
    ``ValueError`` for nulls within geometries."""
    n, levels, arr = 1 << zoom, [], geometries
    for depth in range(4):
        if depth and arr.null_count:
            raise ValueError("null within a geometry")
        o = np.asarray(arr.offsets).astype(np.int64)
        levels.append(np.diff(o))
        arr = arr.values.slice(int(o[0]), int(o[-1] - o[0]))
    polygons, lines, positions, width = levels
    if arr.null_count or (width < 2).any():
        raise ValueError("a position is incomplete")
    record = np.repeat(np.arange(len(polygons)), polygons)  # of polygons
    polygon = np.repeat(np.arange(len(lines)), lines)  # of lines
    line = np.repeat(np.arange(len(positions)), positions)  # of positions
    v, at = np.asarray(arr), np.cumsum(width) - width
    phi = np.radians(np.clip(v[at + 1], -85.0511287798066, 85.0511287798066))
    x, y = (v[at] + 180.0) / 360.0 * n, (1 - np.log(np.tan(phi) + 1 / np.cos(phi)) / np.pi) / 2 * n
    owner = polygon[line]
    found = [(record[owner], _clamp(x, n), _clamp(y, n))]
    names = types.dictionary_encode()
    names = np.array([*names.dictionary.to_pylist(), None], object)[np.asarray(names.indices.fill_null(len(names.dictionary)))] if len(types) else np.zeros(0, object)
    is_path = ~np.isin(names, ["Point", "MultiPoint"])[record][owner] if len(owner) else np.zeros(0, bool)
    # Segments: split at every grid line they cross.
    a = np.flatnonzero((line[1:] == line[:-1]) & is_path[1:]) if len(line) > 1 else np.zeros(0, np.int64)
    b, every = a + 1, np.arange(len(a))
    ts = [(every, np.zeros(len(a))), (every, np.ones(len(a)))]
    for p in (x, y):
        lo, hi = np.minimum(p[a], p[b]), np.maximum(p[a], p[b])
        k = np.flatnonzero(lo != hi)
        seg, cut = _runs(np.ceil(lo[k]).astype(np.int64), np.floor(hi[k]).astype(np.int64))
        seg = k[seg]
        ts.append((seg, (cut - p[a[seg]]) / (p[b[seg]] - p[a[seg]])))
    seg, t = (np.concatenate(z) for z in zip(*ts))
    keep = (t >= 0) & (t <= 1)
    seg, t = seg[keep], t[keep]
    order = np.lexsort((t, seg))
    seg, t = seg[order], t[order]
    same = np.flatnonzero(seg[1:] == seg[:-1])
    seg, t = np.concatenate([seg, seg[same]]), np.concatenate([t, (t[same] + t[same + 1]) / 2])
    i, j = a[seg], b[seg]
    found.append((record[owner[i]], _clamp(x[i] + t * (x[j] - x[i]), n), _clamp(y[i] + t * (y[j] - y[i]), n)))
    # Polygons: in every row the stretches between an odd and an even crossing of its middle.
    is_area = np.isin(names, ["Polygon", "MultiPolygon"])[record][owner] if len(owner) else np.zeros(0, bool)
    i = np.flatnonzero(is_area)
    first = np.cumsum(positions) - positions
    nxt = np.where(i + 1 < (first + positions)[line[i]], i + 1, first[line[i]])
    lo, hi = np.minimum(y[i], y[nxt]), np.maximum(y[i], y[nxt])
    edge, row = _runs(np.maximum(np.ceil(lo - 0.5) - 1, 0).astype(np.int64), np.minimum(np.ceil(hi - 0.5), n - 1).astype(np.int64))
    i, nxt, mid = i[edge], nxt[edge], row + 0.5
    keep = (y[i] <= mid) != (y[nxt] <= mid)
    i, nxt, row, mid = i[keep], nxt[keep], row[keep], mid[keep]
    cross = x[i] + (mid - y[i]) * (x[nxt] - x[i]) / (y[nxt] - y[i])
    of = owner[i]
    order = np.lexsort((cross, row, of))
    of, row, cross = of[order], row[order], cross[order]
    left, right = cross[::2], cross[1::2]  # every row of a polygon has an even number
    k, inside = _runs(np.maximum(np.ceil(left - 0.5), 0).astype(np.int64), np.minimum(np.floor(right - 0.5), n - 1).astype(np.int64))
    found.append((record[of[::2][k]], inside, row[::2][k]))
    rec, tx, ty = (np.concatenate(z) for z in zip(*found))
    key = np.unique((rec * n + tx) * n + ty) if len(polygons) << (2 * zoom) < 1 << 62 else None
    if key is None:
        rows = np.unique(np.stack([rec, tx, ty], axis=1), axis=0)
        return rows[:, 0], rows[:, 1], rows[:, 2]
    return key // n // n, key // n % n, key % n


def tile_cover(geom_type: Column | str, coords: Column | str, zoom: int) -> Column:
    """``cover`` as a column (Arrow batches at once); points alone stay in the JVM."""
    kind = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int32())]))

    def run(types: pa.Array, geometries: pa.Array) -> pa.Array:
        try:
            rec, x, y = cover_batch(types, geometries, zoom)
        except ValueError:
            return pa.array([cover(t, c, zoom) for t, c in zip(types.to_pylist(), geometries.to_pylist())], kind)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rec, minlength=len(types)))])
        tiles = pa.StructArray.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), zoom, np.int32))], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tiles).cast(kind)

    run.__annotations__ = {"types": pa.Array, "geometries": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, T.ArrayType(TILE))
    point = _c(coords)[0][0][0]
    return F.when(_c(geom_type) == "Point", F.array(tile_of(point[0], point[1], zoom))).otherwise(udf(_c(geom_type), _c(coords)))
