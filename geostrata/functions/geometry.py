"""Geometry expressions over the uniform ``coords`` column.

All are built-in column expressions: higher-order functions and arithmetic that
stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TYPES

POWER = 1e7


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def positions(coords: Column | str = "coords") -> Column:
    """All positions of a geometry as one array."""
    return F.flatten(F.flatten(_c(coords)))


def vertex_count(coords: Column | str = "coords") -> Column:
    return F.when(_c(coords).isNull(), F.lit(0)).otherwise(F.size(positions(coords)))


def bbox(coords: Column | str = "coords") -> Column:
    """Bounds of a geometry, seeded with its own positions; NULL if it has none."""
    pts = positions(coords)
    side = lambda fn, k: fn(F.transform(pts, lambda p: p[k]))
    box = F.struct(side(F.array_min, 0).alias("w"), side(F.array_min, 1).alias("s"), side(F.array_max, 0).alias("e"), side(F.array_max, 1).alias("n"))
    return F.when(F.coalesce(F.size(pts), F.lit(0)) > 0, box)


def dims(coords: Column | str = "coords") -> Column:
    """Ordinates of the first position; 2 for an empty geometry."""
    first = F.get(positions(coords), F.lit(0))
    return F.coalesce(F.when(F.size(first) > 0, F.size(first)), F.lit(2))


def type_number(geom_type: Column | str = "geom_type") -> Column:
    out = F.when(F.lit(False), 0)
    for k, name in enumerate(TYPES):
        out = out.when(_c(geom_type) == name, k + 1)
    return out


def geom_code(geom_type: Column | str = "geom_type", n: Column | str = "dims") -> Column:
    """Type number alone in two dimensions, else shifted with the dimensions."""
    t = type_number(geom_type)
    return F.when(_c(n) == 2, t).otherwise(F.shiftleft(t, 4) + _c(n))


def code_type(code: Column | str) -> Column:
    return F.when(_c(code) <= 6, _c(code)).otherwise(F.shiftright(_c(code), 4))


def code_dims(code: Column | str) -> Column:
    return F.when(_c(code) <= 6, F.lit(2)).otherwise(_c(code).bitwiseAND(15))


def quantize(x: Column | str) -> Column:
    """Units of 1e-7 degrees, cut off toward zero."""
    return (_c(x) * F.lit(POWER)).cast("long")


def dequantize(q: Column | str) -> Column:
    return _c(q) / F.lit(POWER)


def zigzag(q: Column | str) -> Column:
    return F.shiftleft(_c(q), 1).bitwiseXOR(F.shiftright(_c(q), 63))


def unzigzag(z: Column | str) -> Column:
    return F.shiftrightunsigned(_c(z), 1).bitwiseXOR(-_c(z).bitwiseAND(1))


def delta(values: Column | str) -> Column:
    """The first value, then differences from the one before."""
    v = _c(values)
    return F.transform(v, lambda x, k: F.when(k == 0, x).otherwise(x - F.get(v, k - 1)))


def undelta(values: Column | str) -> Column:
    """Running sums: the inverse of ``delta``."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(_c(values), none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x)))


def round_half(x: Column | str, places: int = 7) -> Column:
    """Half up for positive values, down for negative ones."""
    p = F.lit(10.0**places)
    return F.when(_c(x) < 0, F.floor(_c(x) * p)).otherwise(F.floor(_c(x) * p + 0.5)) / p


def varint_size(x: Column | str) -> Column:
    """Bytes of an unsigned varint, seven bits each; a negative value is a full
    10 bytes.  The argument is evaluated once."""
    return F.ceil(F.length(F.bin(_c(x))) / 7).cast("int")


def nested_size(n: Column) -> Column:
    """Bytes of a field of ``n`` bytes: tag, length and content."""
    return F.transform(F.array(n), lambda x: 1 + varint_size(x) + x)[0]


def line_size(line: Column, n: int = 2) -> Column:
    """Bytes of a line's packed ordinates."""
    size = F.lit(0)
    for k in range(n):
        size = size + F.aggregate(F.transform(delta(_ordinate(line, k)), lambda d: varint_size(zigzag(d))), F.lit(0), lambda a, x: a + x)
    return size


def _ordinate(line: Column, k: int) -> Column:
    return F.transform(line, lambda p: quantize(p[k]))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two closed intervals meet."""
    return (a1 >= b0) & (b1 >= a0)


def bbox_intersect(a: Column | str, b: Column | str) -> Column:
    """Whether two rectangles meet; touching counts."""
    a, b = _c(a), _c(b)
    return overlap_1d(a["w"], a["e"], b["w"], b["e"]) & overlap_1d(a["s"], a["n"], b["s"], b["n"])


def bbox_union(boxes: Column | str) -> Column:
    """Union of an array of rectangles; NULL ones don't count."""
    b = F.filter(_c(boxes), lambda x: x.isNotNull())
    box = F.struct(*[fn(F.transform(b, _field(k))).alias(k) for fn, k in ((F.array_min, "w"), (F.array_min, "s"), (F.array_max, "e"), (F.array_max, "n"))])
    return F.when(F.size(b) > 0, box)


def _field(k: str):  # noqa: ANN202
    return lambda x: x[k]


def box(w: float, s: float, e: float, n: float) -> Column:
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("wsen", (w, s, e, n))])
