"""The compact byte form of a feature, and columns that use it.

Wire layout of a payload: id (field 1, varint), properties (field 2, one entry
each, keys in order), geometry code (field 3), packed ordinates (field 4) and
packed bounds (field 5).  Ordinates are cut to 1e-7 degrees, delta coded within
a line, zigzagged and written as varints.  A record of a stream is the byte 10,
the payload's length and the payload.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..schema import BOOL, DOUBLE, FEATURE, FLOAT, INT, SINT, STRING, TYPES, UINT

POWER = 10**7
FRAME = 10
_NUMBER = {name: k + 1 for k, name in enumerate(TYPES)}
_FIELDS = {STRING: "s", FLOAT: "f", DOUBLE: "d", INT: "i", UINT: "u", SINT: "u", BOOL: "b"}
_MASK = (1 << 64) - 1
_FEW = 16


def varint(x: int) -> bytes:
    """An unsigned varint; negative values as their 64-bit complement."""
    x &= _MASK
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[at]
        at += 1
        x |= (c & 127) << shift
        if c < 128:
            return x & _MASK, at
        shift += 7


def varints(values: np.ndarray) -> bytes:
    """Varints of unsigned 64-bit values, all at once (few of them one by one, which
    takes less time)."""
    if len(values) < _FEW:
        return b"".join(map(varint, np.asarray(values, np.uint64).tolist()))
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(10):
        some = size > k
        if not some.any():
            break
        more = (size[some] > k + 1).astype(np.uint8) << np.uint8(7)
        out[at[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def read_varints(b: bytes) -> np.ndarray:
    """All varints of a field, as unsigned 64-bit values."""
    if len(b) < 4 * _FEW:
        few, x, shift = [], 0, 0
        for c in bytes(b):
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                few.append(x & _MASK)
                x = shift = 0
        return np.array(few, np.uint64)
    raw = np.frombuffer(b, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max()) + 1):
        some = first + k <= last
        out[some] |= (raw[first[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def packed(values: np.ndarray) -> bytes:
    body = varints(values)
    return varint(len(body)) + body


def quantize(a: np.ndarray) -> np.ndarray:
    return np.trunc(np.asarray(a, np.float64) * POWER).astype(np.int64)


def zigzag(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, np.int64)
    return ((q << 1) ^ (q >> 63)).view(np.uint64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, np.uint64)
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)


def _line(line: list, dims: int) -> np.ndarray:
    """Zigzagged deltas of a line; positions are cut or padded to ``dims``."""
    if not line:
        return np.zeros(0, np.uint64)
    q = quantize(np.array([(list(p) + [0.0] * dims)[:dims] for p in line]))
    q[1:] = q[1:] - q[:-1]
    return zigzag(q.ravel())


def write_value(tag: int, v: Any) -> bytes:
    if tag == STRING:
        s = (v or "").encode()
        body = b"\x0a" + varint(len(s)) + s
    elif tag == FLOAT:
        body = b"\x15" + struct.pack("<f", v)
    elif tag == DOUBLE:
        body = b"\x19" + struct.pack("<d", v)
    elif tag == INT:
        body = b"\x20" + varint(int(v))
    elif tag == UINT:
        body = b"\x28" + varint(int(v))
    elif tag == SINT:
        body = b"\x30" + varint(int(v))
    elif tag == BOOL:
        body = b"\x38" + (b"\x01" if v else b"\x00")
    else:
        raise ValueError(f"unknown value tag {tag}")
    return b"\x12" + varint(len(body)) + body


def write_property(key: str, tag: int, v: Any) -> bytes:
    k = key.encode()
    body = b"\x0a" + varint(len(k)) + k + write_value(tag, v)
    return b"\x12" + varint(len(body)) + body


def geometry_code(geom_type: str, dims: int) -> int:
    t = _NUMBER[geom_type]
    return t if dims == 2 else (t << 4) + dims


def bounds(coords: list) -> tuple[float, float, float, float] | None:
    xs = [p[0] for polygon in coords or [] for line in polygon or [] for p in line or [] if len(p) > 1]
    ys = [p[1] for polygon in coords or [] for line in polygon or [] for p in line or [] if len(p) > 1]
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def encode(feature: dict) -> bytes:
    """The payload of a feature row (a dictionary of ``FEATURE``'s fields).

    Raises ``ValueError`` for a geometry type that has no code.
    """
    out = []
    if feature.get("id") is not None:
        out.append(b"\x08" + varint(int(feature["id"])))
    props = feature.get("properties") or {}
    for key, v in sorted(props.items() if isinstance(props, dict) else props):
        out.append(write_property(key, v["tag"], v[_FIELDS[v["tag"]]]))
    kind, coords = feature.get("geom_type"), feature.get("coords")
    if kind is not None:
        if kind not in _NUMBER:
            raise ValueError(f"a geometry of type {kind} can't be packed")
        coords = coords or []
        first = next((p for polygon in coords for line in polygon or [] for p in line or []), None)
        dims = feature.get("dims") or (len(first) if first else 2)
        out.append(bytes([0x18, geometry_code(kind, dims)]))
        parts: list[np.ndarray] = []
        if kind in ("Point", "LineString", "MultiPoint"):
            parts = [_line(line, dims) for polygon in coords for line in polygon or []]
        else:
            for polygon in coords:
                if kind == "MultiPolygon":
                    parts.append(np.array([len(polygon or [])], np.uint64))
                for line in polygon or []:
                    parts += [np.array([len(line or []) * dims], np.uint64), _line(line, dims)]
        out.append(b"\x22" + packed(np.concatenate(parts) if parts else np.zeros(0, np.uint64)))
        box = bounds(coords)
        if box:
            out.append(b"\x2a" + packed(zigzag(quantize(np.array(box)))))
    return b"".join(out)


def fields(payload: bytes, at: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """``(field, wire type, start, end)`` of a message's fields, in any order."""
    n = len(payload)
    while at < n:
        tag, at = read_varint(payload, at)
        wire = tag & 7
        start = at
        if wire == 0:
            _, at = read_varint(payload, at)
        elif wire == 1:
            at += 8
        elif wire == 2:
            size, start = read_varint(payload, at)
            at = start + size
        elif wire == 5:
            at += 4
        else:
            raise ValueError(f"wire type {wire} at byte {at}")
        yield tag >> 3, wire, start, at


def _read_value(b: bytes, sint_zigzag: bool) -> dict:
    out: dict[str, Any] = {"tag": STRING, "s": "", "f": None, "d": None, "i": None, "u": None, "b": None}
    for field, _, start, end in fields(b):
        out["tag"], out["s"] = field, None
        if field == STRING:
            out["s"] = b[start:end].decode("utf-8", "replace")
        elif field == FLOAT:
            out["f"] = struct.unpack("<f", b[start:end])[0]
        elif field == DOUBLE:
            out["d"] = struct.unpack("<d", b[start:end])[0]
        elif field == INT:
            v = read_varint(b, start)[0]
            out["i"] = v - (1 << 64) if v >> 63 else v
        elif field in (UINT, SINT):
            v = read_varint(b, start)[0]
            if field == SINT and sint_zigzag:
                v = int(unzigzag(np.array([v], np.uint64))[0])
            out["u"] = Decimal(v)
        elif field == BOOL:
            out["b"] = read_varint(b, start)[0] != 0
    return out


def read_property(b: bytes, sint_zigzag: bool = False) -> tuple[str, dict]:
    key, v = "", {"tag": STRING, "s": "", "f": None, "d": None, "i": None, "u": None, "b": None}
    first = True
    for field, _, start, end in fields(b):
        if first:
            key, first = b[start:end].decode("utf-8", "replace"), False
        elif field == 2:
            v = _read_value(b[start:end], sint_zigzag)
    return key, v


def _positions(z: np.ndarray, dims: int) -> list:
    n = len(z) // dims
    q = np.cumsum(unzigzag(z[: n * dims]).reshape(n, dims), axis=0)
    return (q / POWER).tolist()


def _geometry(kind: str, dims: int, body: bytes) -> list:
    v = read_varints(body)
    if kind in ("Point", "LineString", "MultiPoint"):
        if kind == "Point":
            v = v[:dims]
            if 0 < len(v) < dims:  # a short field of an older writer: what is there
                dims = len(v)
        return [[_positions(v, dims)]] if len(v) else []
    at, out = 0, []

    def ring() -> list:
        nonlocal at
        n = int(v[at])
        line = _positions(v[at + 1 : at + 1 + n], dims)
        at += 1 + n
        return line

    if kind == "MultiPolygon":
        while at < len(v):
            n = int(v[at])
            at += 1
            out.append([ring() for _ in range(n)])
        return out
    lines = []
    while at < len(v):
        lines.append(ring())
    return [lines] if lines else []


def decode(payload: bytes, sint_zigzag: bool = False) -> dict:
    """The feature row of a payload.  Stored bounds outside the geographic range
    (an older encoding) are replaced by the geometry's own."""
    out: dict[str, Any] = {"id": None, "properties": {}, "geom_type": None, "dims": None, "coords": None, "bbox": None}
    body, box = None, None
    for field, wire, start, end in fields(payload):
        if field == 1 and wire == 0:
            v = read_varint(payload, start)[0]
            out["id"] = v - (1 << 64) if v >> 63 else v
        elif field == 2 and wire == 2:
            key, v = read_property(payload[start:end], sint_zigzag)
            out["properties"][key] = v
        elif field == 3:
            code = payload[start]
            kind, out["dims"] = (code, 2) if code <= 6 else (code >> 4, code & 15)
            out["geom_type"] = TYPES[kind - 1] if 1 <= kind <= 6 else None
        elif field == 4 and wire == 2:
            body = payload[start:end]
        elif field == 5 and wire == 2:
            box = unzigzag(read_varints(payload[start:end])[:4]) / POWER
    if out["geom_type"]:
        out["coords"] = _geometry(out["geom_type"], out["dims"] or 2, body or b"")
        if out["geom_type"] == "Point" and out["coords"]:
            out["dims"] = len(out["coords"][0][0][0])
        ok = box is not None and len(box) == 4 and abs(box[0]) <= 360 and abs(box[2]) <= 360 and abs(box[1]) <= 90.1 and abs(box[3]) <= 90.1 and box[0] <= box[2] and box[1] <= box[3]
        found = tuple(box) if ok else bounds(out["coords"])
        out["bbox"] = dict(zip("wsen", map(float, found))) if found else None
    return out


def read_keys(payload: bytes) -> list[str]:
    """Property names; values are skipped by their length."""
    out = []
    for field, wire, start, end in fields(payload):
        if field == 2 and wire == 2:
            _, at = read_varint(payload, start)
            n, at = read_varint(payload, at)
            out.append(payload[at : at + n].decode("utf-8", "replace"))
        elif field > 2:
            break
    return out


def read_bbox(payload: bytes) -> dict | None:
    """Bounds alone: every other field is skipped forward."""
    for field, wire, start, end in fields(payload):
        if field == 5 and wire == 2:
            q = unzigzag(read_varints(payload[start:end])[:4]) / POWER
            return dict(zip("wsen", map(float, q))) if len(q) == 4 else None
    return None


def read_one(payload: bytes, key: str) -> dict | None:
    """One property's value; the others are skipped."""
    want = key.encode()
    for field, wire, start, end in fields(payload):
        if field == 2 and wire == 2:
            _, at = read_varint(payload, start)
            n, at = read_varint(payload, at)
            if payload[at : at + n] == want:
                return read_property(payload[start:end])[1]
        elif field > 2:
            return None
    return None


def frame(payload: bytes) -> bytes:
    """The record of a payload."""
    return bytes([FRAME]) + varint(len(payload)) + payload


def records(buf: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """``(payload, start, end)`` of a stream's records; positions are those of
    the payload."""
    end = len(buf) if end is None else end
    while at < end:
        if buf[at] != FRAME:
            raise ValueError(f"no record at byte {at}")
        n, start = read_varint(buf, at + 1)
        yield buf[start : start + n], start, start + n
        at = start + n


def _arrow(fn: Callable, n: int, out: DataType) -> Callable[..., Column]:
    """An Arrow function over ``n`` columns, batch by batch."""
    import pyarrow as pa

    def one(a):  # noqa: ANN001, ANN202
        return fn(a)

    def five(a, b, c, d, e):  # noqa: ANN001, ANN202
        return fn(a, b, c, d, e)

    run = one if n == 1 else five
    run.__annotations__ = dict.fromkeys("abcde"[:n], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(run, out)


def _each(fn: Callable, out: DataType) -> Callable[..., Column]:
    """An Arrow function of one column, value by value; null stays null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(out)
    return _arrow(lambda a: pa.array([None if x is None else fn(x) for x in a.to_pylist()], kind), 1, out)


def encode_feature(*columns: Column | str) -> Column:
    """The payload of feature columns (``FEATURE`` order, bbox left out)."""
    from pyspark.sql.types import BinaryType

    from . import batch

    return _arrow(batch.encode_all, 5, BinaryType())(*(columns or ("id", "properties", "geom_type", "dims", "coords")))


def decode_feature(payload: Column | str, sint_zigzag: bool = False) -> Column:
    """The feature struct of a payload."""
    from . import batch

    return _arrow(lambda a: batch.with_nulls(batch.features(*batch.of_column(a), sint_zigzag), a), 1, FEATURE)(payload)


def payload_keys(payload: Column | str) -> Column:
    from pyspark.sql.types import ArrayType, StringType

    return _each(read_keys, ArrayType(StringType()))(payload)


def payload_bbox(payload: Column | str) -> Column:
    from ..schema import BBOX
    from . import batch

    return _arrow(lambda a: batch.with_nulls(batch.decode_all(*batch.of_column(a), ["bbox"])["bbox"], a), 1, BBOX)(payload)


def payload_property(payload: Column | str, key: str) -> Column:
    from ..schema import VALUE

    return _each(lambda p: read_one(p, key), VALUE)(payload)


def encode_frame(payload: Column | str) -> Column:
    from pyspark.sql.types import BinaryType

    from . import batch

    return _arrow(batch.framed, 1, BinaryType())(payload)


def decode_stream(buf: Column | str) -> Column:
    """A buffer's records as an array of (payload, start, end)."""
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return _each(lambda b: [{"payload": p, "start": s, "end": e} for p, s, e in records(b)], kind)(buf)
