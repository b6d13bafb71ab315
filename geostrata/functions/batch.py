"""Many payloads at once: the codec over whole Arrow batches in numpy.

A batch's payloads are read field by field, all records in step; each kind of
field is then decoded for all records together, and Arrow arrays are made from
buffers.  Fields that no wanted column needs are only skipped.  Writing goes the
other way: sizes first, then every part's bytes to their places.

What these passes don't cover (fields of other writers, nulls within
coordinates, damaged payloads) raises ``Unusual``; the batch then goes through
``codec`` record by record, which defines the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import BBOX, COORDS, FEATURE, PROPERTIES, TYPES, VALUE
from . import codec

_KINDS = {x.name: to_arrow_type(x.dataType) for x in FEATURE}
_VALUE, _BBOX, _PAIRS = to_arrow_type(VALUE), to_arrow_type(BBOX), to_arrow_type(PROPERTIES)
_POSITION = to_arrow_type(COORDS).value_type.value_type.value_type
_SIMPLE = (1, 2, 4)
_POINT, _NESTED = 1, 6


class Unusual(ValueError):
    """A batch that has to be read or written record by record."""


# --- bytes ---


def _need(ok: np.ndarray | bool) -> None:
    if not np.all(ok):
        raise Unusual


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(_starts(sizes), sizes)


def _slices(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one behind the other."""
    return buf[np.repeat(at, size) + _within(size)]


def _varints(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varints at positions, and the positions behind them."""
    b = buf[at]
    out, more, nxt, shift = (b & 127).astype(np.uint64), b > 127, at + 1, 7
    while more.any():
        if shift > 63:
            raise Unusual
        b = buf[nxt[more]]
        out[more] |= (b & 127).astype(np.uint64) << np.uint64(shift)
        nxt[more] += 1
        more[more] = b > 127
        shift += 7
    return out, nxt


def _varint_size(v: np.ndarray) -> np.ndarray:
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        big = v >= np.uint64(1 << (7 * k))
        if not big.any():
            break
        size += big
    return size


def _put_varints(out: np.ndarray, at: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
    for k in range(int(size.max(initial=0))):
        some = size > k if k else slice(None)
        more = (size[some] > k + 1).astype(np.uint8) << np.uint8(7)
        out[at[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
    """Slices of ``data``, one behind the other, to their places."""
    out[np.repeat(at, size) + _within(size)] = data


def _binary(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and sizes of a binary or string array."""
    _, offsets, data = arr.buffers()
    wide = np.int64 if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type) else np.int32
    o = np.frombuffer(offsets, wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, o[:-1], np.diff(o)


def _to_binary(data: np.ndarray, size: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(size), [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


# --- reading ---


def offsets(buf: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Payload starts and ends of a stream's records."""
    starts, ends, n = [], [], len(buf)
    while at < n:
        if buf[at] != codec.FRAME:
            raise ValueError(f"no record at byte {at}")
        size = buf[at + 1]
        at += 2
        if size > 127:
            size, at = codec.read_varint(buf, at - 1)
        starts.append(at)
        at += size
        ends.append(at)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _fields(buf: np.ndarray, start: np.ndarray, end: np.ndarray, last: int) -> tuple[np.ndarray, ...]:
    """``(record, field, wire type, start, end)`` of all fields, record by record in
    step, until each record's field ``last`` was met."""
    at, act = start.copy(), np.flatnonzero(start < end)
    found = []
    while len(act):
        tag = buf[at[act]]
        _need(tag < 128)
        wire, field, pos = tag & 7, tag >> 3, at[act] + 1
        _need((wire == 0) | (wire == 1) | (wire == 2) | (wire == 5))
        stop = pos + np.where(wire == 1, 8, 4)
        var = (wire == 0) | (wire == 2)
        if var.any():
            size, nxt = _varints(buf, pos[var])
            _need(size[wire[var] == 2] < np.uint64(1 << 31))
            body = wire[var] == 2
            pos[var] = np.where(body, nxt, pos[var])
            stop[var] = np.where(body, nxt + size.astype(np.int64), nxt)
        _need(stop <= end[act])
        found.append((act, field, wire, pos, stop))
        at[act] = stop
        act = act[(stop < end[act]) & (field < last)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _strings(buf: np.ndarray, at: np.ndarray, size: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    out = _to_binary(_slices(buf, at, size), size, pa.string(), valid)
    try:
        out.validate(full=True)
    except pa.ArrowInvalid as e:
        raise Unusual from e
    return out


def _fixed(data: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(valid), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


def _properties(buf: np.ndarray, n: int, rec: np.ndarray, at: np.ndarray, end: np.ndarray, zigzag: bool) -> pa.Array:
    order = np.argsort(rec, kind="stable")
    rec, at, end = rec[order], at[order], end[order]
    _need(at < end)
    _need(buf[at] == 0x0A)
    key_size, key_at = _varints(buf, at + 1)
    key_size = key_size.astype(np.int64)
    value = key_at + key_size
    _need(value <= end)
    some = value < end
    _need(buf[value[some]] == 0x12)
    size, first = _varints(buf, value[some] + 1)
    _need(first + size.astype(np.int64) == end[some])
    some[some] = size > 0
    body, stop = np.zeros(len(rec), np.int64), end
    body[some] = first[size > 0]
    tag = np.full(len(rec), 1, np.int8)  # no value is an empty text
    tag[some] = buf[body[some]] >> 3
    wires = np.array([9, 2, 5, 1, 0, 0, 0, 0], np.uint8)
    _need((tag > 0) & (tag < 8))
    _need((buf[body[some]] & 7) == wires[tag[some]])
    text_at, text_size = np.zeros(len(rec), np.int64), np.zeros(len(rec), np.int64)
    is_ = {k: some & (tag == k) for k in range(1, 8)}
    t = is_[1]
    if t.any():
        v, nxt = _varints(buf, body[t] + 1)
        text_at[t], text_size[t] = nxt, v.astype(np.int64)
        _need(nxt + text_size[t] == stop[t])
    num = np.zeros(len(rec), np.uint64)
    t = is_[4] | is_[5] | is_[6] | is_[7]
    if t.any():
        num[t], nxt = _varints(buf, body[t] + 1)
        _need(nxt == stop[t])
    f, d = np.zeros((len(rec), 4), np.uint8), np.zeros((len(rec), 8), np.uint8)
    for data, k, w in ((f, 2, 4), (d, 3, 8)):
        t = is_[k]
        if t.any():
            _need(body[t] + 1 + w == stop[t])
            data[t] = buf[(body[t] + 1)[:, None] + np.arange(w)]
    whole = num.copy()
    if zigzag and is_[6].any():
        whole[is_[6]] = codec.unzigzag(num[is_[6]]).view(np.uint64)
        _need(whole[is_[6]].view(np.int64) >= 0)
    big = np.zeros((len(rec), 2), np.uint64)
    big[:, 0] = whole
    keys = _strings(buf, key_at, key_size)
    items = pa.StructArray.from_arrays(
        [
            pa.array(tag), _strings(buf, text_at, text_size, tag == 1), _fixed(f, is_[2], pa.float32()), _fixed(d, is_[3], pa.float64()),
            _fixed(num, is_[4], pa.int64()), _fixed(big, is_[5] | is_[6], pa.decimal128(20, 0)), pa.array(num != 0, mask=~is_[7]),
        ],
        fields=list(_VALUE),
    )
    # Keys in order; a key that is there twice takes the slow way.
    code = keys.dictionary_encode()
    names = code.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    by = rec * max(1, len(names)) + (rank[np.asarray(code.indices)] if len(names) else 0)
    if len(by) and (by[1:] <= by[:-1]).any():
        o = np.argsort(by, kind="stable")
        _need(by[o][1:] != by[o][:-1])
        keys, items = keys.take(pa.array(o)), items.take(pa.array(o))
    count = np.bincount(rec, minlength=n)
    return pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), keys, items).cast(_PAIRS)


def _nested(sizes: np.ndarray, values: pa.Array, valid: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=None if valid is None else pa.array(~valid))


def _geometry(buf: np.ndarray, kind: np.ndarray, dims: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Coordinates of records by kind (0: none), and the dimensions of points."""
    n, size = len(kind), np.where(kind > 0, end - at, 0)
    raw = _slices(buf, at, size)
    z = codec.read_varints(raw)
    last = np.concatenate([[0], np.cumsum(raw < 128)])
    stop = np.cumsum(size)
    _need(raw[stop[size > 0] - 1] < 128)
    v_end = last[stop]
    v_at = last[stop - size]
    count = v_end - v_at
    _need((dims > 0) | (kind == 0))
    lines = []  # (record, place in it, polygon, first value, values)
    s = np.flatnonzero(np.isin(kind, _SIMPLE) & (count > 0))
    point = kind[s] == _POINT
    short = s[point & (count[s] < dims[s])]
    dims = dims.copy()
    dims[short] = count[short]  # a short field of an older writer: what is there
    none = np.zeros(len(s), np.int64)
    lines.append((s, none, none, v_at[s], np.where(point, dims[s], count[s] // dims[s] * dims[s])))
    polygons = np.zeros(n, np.int64)
    polygons[s] = 1
    act = np.flatnonzero((kind > 0) & ~np.isin(kind, _SIMPLE) & (count > 0))
    polygons[act[kind[act] != _NESTED]] = 1
    cur, rings, place = v_at.copy(), np.zeros(n, np.int64), 0
    while len(act):
        value = z[cur[act]].astype(np.int64)
        head = (kind[act] == _NESTED) & (rings[act] == 0)
        over = act[head]
        _need(value >= 0)
        _need(value[head] > 0)
        polygons[over] += 1
        rings[over] = value[head]
        cur[over] += 1
        r = act[~head]
        if len(r):
            k = value[~head]
            _need(cur[r] + 1 + k <= v_end[r])
            lines.append((r, np.full(len(r), place), polygons[r] - 1, cur[r] + 1, k // dims[r] * dims[r]))
            cur[r] += 1 + k
            rings[r] -= kind[r] == _NESTED
        place += 1
        act = act[cur[act] < v_end[act]]
    _need(rings == 0)
    rec, place, polygon, first, values = (np.concatenate(x) for x in zip(*lines))
    o = np.lexsort((place, rec))
    rec, polygon, first, values = rec[o], polygon[o], first[o], values[o]
    width = dims[rec]
    positions = values // np.maximum(width, 1)
    to, out = _starts(values), np.zeros(int(values.sum()), np.float64)
    q = codec.unzigzag(z)
    for w in np.unique(width):
        m = np.flatnonzero((width == w) & (positions > 0))
        if not len(m):
            continue
        within = _within(values[m])
        mine = q[np.repeat(first[m], values[m]) + within].reshape(-1, w)
        run, begin = np.cumsum(mine, axis=0), _starts(positions[m])
        run -= np.repeat(run[begin] - mine[begin], positions[m], axis=0)
        out[np.repeat(to[m], values[m]) + within] = run.ravel() / codec.POWER
    coords = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(width, positions))]), pa.int32()), pa.array(out))
    coords = _nested(positions, coords)
    # Lines by polygon, polygons by record.
    each = np.zeros(int(polygons.sum()), np.int64)
    np.add.at(each, _starts(polygons)[rec] + polygon, 1)
    coords = _nested(polygons, _nested(each, coords), kind > 0)
    return coords.cast(_KINDS["coords"]), dims


def decode(buf: np.ndarray, start: np.ndarray, end: np.ndarray, columns: list[str], zigzag: bool = False) -> dict[str, pa.Array]:
    """Feature columns of payloads that lie in a buffer."""
    n, want = len(start), set(columns)
    buf = np.concatenate([buf, np.zeros(16, np.uint8)])
    # Bounds alone are taken as stored; beside a geometry they are checked.
    geometry = bool(want & {"geom_type", "dims", "coords"})
    # Only partial reads rely on the fields' order; a whole one takes them as they come.
    last = 16 if len(want) == len(_KINDS) else 5 if "bbox" in want or geometry and "dims" in want else 4 if "coords" in want else 3 if geometry or "properties" in want else 1
    rec, field, wire, at, stop = _fields(buf, start, end, last)
    out: dict[str, pa.Array] = {}
    if "id" in want:
        t = (field == 1) & (wire == 0)
        value, has = np.zeros(n, np.uint64), np.zeros(n, bool)
        value[rec[t]], has[rec[t]] = _varints(buf, at[t])[0], True
        out["id"] = _fixed(value.view(np.int64), has, pa.int64())
    if "properties" in want:
        t = (field == 2) & (wire == 2)
        out["properties"] = _properties(buf, n, rec[t], at[t], stop[t], zigzag)
    if geometry or "bbox" in want:
        t = field == 3
        code = np.zeros(n, np.int64)
        code[rec[t]] = buf[at[t]]
        kind, dims = np.where(code <= 6, code, code >> 4), np.where(code <= 6, 2, code & 15)
        known = (kind >= 1) & (kind <= 6)
        _need((code == 0) | known)
        kind = np.where(known, kind, 0)
        positions = None
        if "coords" in want or "dims" in want or "bbox" in want and geometry:
            a, z = np.zeros(n, np.int64), np.zeros(n, np.int64)
            t = (field == 4) & (wire == 2)
            a[rec[t]], z[rec[t]] = at[t], stop[t]
            positions = z > a
            if "coords" in want or (known & (kind == _POINT) & (z - a < 2 * dims)).any():
                out["coords"], dims = _geometry(buf, kind, dims, a, z)
        has = np.zeros(n, bool)
        has[rec[field == 3]] = True
        out["geom_type"] = pa.DictionaryArray.from_arrays(pa.array(np.maximum(kind - 1, 0), pa.int32(), mask=~known), pa.array(TYPES)).cast(pa.string())
        out["dims"] = pa.array(dims, pa.int32(), mask=~has)
        if "bbox" in want:
            t = (field == 5) & (wire == 2)
            box, full = np.zeros((n, 4), np.float64), np.zeros(n, bool)
            nxt, until = at[t], stop[t]
            for k in range(4):
                _need(nxt < until)
                v, nxt = _varints(buf, nxt)
                box[rec[t], k] = codec.unzigzag(v) / codec.POWER
            full[rec[t]] = True
            if geometry or positions is not None or "id" in want or "properties" in want:
                full &= known
                ok = (np.abs(box[:, [0, 2]]) <= 360).all(axis=1) & (np.abs(box[:, [1, 3]]) <= 90.1).all(axis=1) & (box[:, 0] <= box[:, 2]) & (box[:, 1] <= box[:, 3])
                _need(ok | ~full)  # an older encoding: bounds come from the geometry
                t = (field == 4) & (wire == 2)
                filled = np.zeros(n, bool)
                filled[rec[t]] = stop[t] > at[t]
                _need(full | ~(known & filled))
            out["bbox"] = pa.StructArray.from_arrays([pa.array(box[:, k]) for k in range(4)], fields=list(_BBOX), mask=pa.array(~full))
    return {c: out[c] for c in columns}


def decode_all(buf: bytes | memoryview, start: np.ndarray, end: np.ndarray, columns: list[str], zigzag: bool = False) -> dict[str, pa.Array]:
    """``decode``, record by record where that can't do it."""
    try:
        return decode(np.frombuffer(buf, np.uint8), start, end, columns, zigzag)
    except (Unusual, IndexError, pa.ArrowInvalid):
        rows = []
        for a, z in zip(start.tolist(), end.tolist()):
            if columns == ["bbox"]:
                rows.append({"bbox": codec.read_bbox(bytes(buf[a:z]))})
            else:
                row = codec.decode(bytes(buf[a:z]), zigzag)
                rows.append(row | {"properties": sorted(row["properties"].items())})
        return {c: pa.array([r[c] for r in rows], _KINDS[c]) for c in columns}


def features(buf: bytes, start: np.ndarray, end: np.ndarray, zigzag: bool = False) -> pa.Array:
    """Feature structs of payloads."""
    got = decode_all(buf, start, end, list(_KINDS), zigzag)
    return pa.StructArray.from_arrays(list(got.values()), fields=[pa.field(k, v) for k, v in _KINDS.items()])


def of_column(arr: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A binary column's bytes, starts and ends; a null has none."""
    buf, at, size = _binary(arr)
    if arr.null_count:
        size = np.where(np.asarray(arr.is_valid()), size, 0)
    return buf.tobytes(), at, at + size


def with_nulls(arr: pa.Array, like: pa.Array) -> pa.Array:
    """``arr``, null where ``like`` is."""
    if not like.null_count:
        return arr
    keep = pa.array(np.where(np.asarray(like.is_valid()), np.arange(len(like)), -1))
    return arr.take(pa.compute.if_else(pa.compute.greater_equal(keep, 0), keep, None))


# --- writing ---


def _flat(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes and values of a list array without nulls within."""
    _need(arr.null_count == 0)
    o = np.asarray(arr.offsets).astype(np.int64)
    return np.diff(o), arr.values.slice(int(o[0]), int(o[-1] - o[0]))


def _entries(props: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each record's properties, one behind the other, and their sizes."""
    o = np.asarray(props.offsets).astype(np.int64)
    count = np.diff(o)
    if props.null_count:
        _need(count[~np.asarray(props.is_valid())] == 0)
    keys, items = props.keys.slice(int(o[0]), int(o[-1] - o[0])), props.items.slice(int(o[0]), int(o[-1] - o[0]))
    _need(keys.null_count == 0 and items.null_count == 0)
    rec = np.repeat(np.arange(n), count)
    if not len(rec):
        return np.zeros(0, np.uint8), np.zeros(n, np.int64)
    code = keys.dictionary_encode()
    names = code.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    by = rec * len(names) + rank[np.asarray(code.indices)]
    if (by[1:] <= by[:-1]).any():
        order = pa.array(np.argsort(by, kind="stable"))
        keys, items = keys.take(order), items.take(order)
    part = dict(zip(("tag", "s", "f", "d", "i", "u", "b"), items.flatten()))
    _need(part["tag"].null_count == 0)
    tag = np.asarray(part["tag"]).astype(np.int64)
    _need((tag > 0) & (tag < 8))
    for name, ks in (("f", (2,)), ("d", (3,)), ("i", (4,)), ("u", (5, 6))):
        if part[name].null_count:
            _need(~(np.isin(tag, ks) & ~np.asarray(part[name].is_valid())))
    num = np.zeros(len(tag), np.uint64)
    for name, ks in (("i", (4,)), ("u", (5, 6)), ("b", (7,))):
        t = np.isin(tag, ks)
        if not t.any():
            continue
        v = part[name].filter(pa.array(t))
        if name == "i":
            num[t] = np.asarray(v).astype(np.int64).view(np.uint64)
        elif name == "b":
            num[t] = np.asarray(v.fill_null(False)).astype(np.uint64)
        else:
            raw = np.frombuffer(pa.concat_arrays([v]).buffers()[1], np.uint64)[2 * v.offset :].reshape(-1, 2)[: len(v)]
            num[t] = raw[:, 0]
    text = tag == 1
    t_buf, t_at, t_size = _binary(part["s"])
    if part["s"].null_count:
        t_size = np.where(np.asarray(part["s"].is_valid()), t_size, 0)
    t_size = np.where(text, t_size, 0)
    k_buf, k_at, k_size = _binary(keys)
    small = _varint_size(num)
    plain = np.choose(tag - 1, [0, 5, 9, 1 + small, 1 + small, 1 + small, 2])
    v_text = _varint_size(t_size.astype(np.uint64))
    value = np.where(text, 1 + v_text + t_size, plain)  # the value's own message
    v_value, v_key = _varint_size(value.astype(np.uint64)), _varint_size(k_size.astype(np.uint64))
    body = 1 + v_key + k_size + 1 + v_value + value
    v_body = _varint_size(body.astype(np.uint64))
    size = 1 + v_body + body
    at = _starts(size)
    out = np.zeros(int(size.sum()), np.uint8)
    as_u = lambda x: x.astype(np.uint64)
    out[at] = 0x12
    _put_varints(out, at + 1, as_u(body), v_body)
    at = at + 1 + v_body
    out[at] = 0x0A
    _put_varints(out, at + 1, as_u(k_size), v_key)
    at = at + 1 + v_key
    _put(out, at, _slices(k_buf, k_at, k_size), k_size)
    at = at + k_size
    out[at] = 0x12
    _put_varints(out, at + 1, as_u(value), v_value)
    at = at + 1 + v_value
    out[at] = np.array([0, 0x0A, 0x15, 0x19, 0x20, 0x28, 0x30, 0x38], np.uint8)[tag]
    if text.any():
        _put_varints(out, at[text] + 1, as_u(t_size[text]), v_text[text])
        _put(out, at[text] + 1 + v_text[text], _slices(t_buf, t_at[text], t_size[text]), t_size[text])
    for name, k, w, kind in (("f", 2, 4, "<f4"), ("d", 3, 8, "<f8")):
        t = tag == k
        if t.any():
            raw = np.asarray(part[name].filter(pa.array(t))).astype(kind).view(np.uint8).reshape(-1, w)
            out[(at[t] + 1)[:, None] + np.arange(w)] = raw
    t = tag > 3
    if t.any():
        _put_varints(out, at[t] + 1, num[t], small[t])
    return out, np.bincount(rec, size, n).astype(np.int64)


def _bodies(kind: np.ndarray, dims: pa.Array, coords: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each record: dimensions; bytes of all geometries and their sizes; bounds
    in units, and whether there are any."""
    n, has = len(kind), kind > 0
    o = np.asarray(coords.offsets).astype(np.int64)
    polygons = np.diff(o)
    valid = np.asarray(coords.is_valid())
    _need(has | (polygons == 0) | ~valid)
    polygons = np.where(valid & has, polygons, 0)
    _need(int(polygons.sum()) == int(o[-1] - o[0]))
    inner = coords.values.slice(int(o[0]), int(o[-1] - o[0]))
    lines, inner = _flat(inner)
    positions, inner = _flat(inner)
    width, flat = _flat(inner)
    _need(flat.null_count == 0)
    x = np.asarray(flat).astype(np.float64, copy=False)
    _need(np.isfinite(x) & (np.abs(x) < 9e11))
    of_polygon = np.repeat(np.arange(n), polygons)  # record of each polygon, line, position
    of_line = np.repeat(of_polygon, lines)
    of_position = np.repeat(of_line, positions)
    first = np.full(n, 2, np.int64)
    if len(width):
        r, i = np.unique(of_position, return_index=True)
        first[r] = width[i]
    given = np.asarray(dims.fill_null(0)).astype(np.int64)
    d = np.where(given > 0, given, first)
    _need(width == d[of_position])
    _need((d >= 2) & (d < 16) | ~has)
    q = np.trunc(x * codec.POWER).astype(np.int64)
    value_at, z = _starts(width), np.empty(len(q), np.uint64)
    head = _starts(positions)[positions > 0]  # the first position of each line
    for w in np.unique(width):
        m = width == w
        p = q[value_at[m][:, None] + np.arange(w)]
        delta = p.copy()
        delta[1:] -= p[:-1]
        is_first = np.zeros(len(width), bool)
        is_first[head] = True
        f = is_first[m]
        delta[f] = p[f]
        z[(value_at[m][:, None] + np.arange(w)).ravel()] = codec.zigzag(delta.ravel())
    # Heads: polygons' numbers of lines, and lines' numbers of ordinates.
    nested, simple = kind[of_polygon] == _NESTED, np.isin(kind, _SIMPLE)
    _need(lines[nested] > 0)
    ordinates = np.bincount(np.repeat(np.arange(len(positions)), positions), width, len(positions)).astype(np.int64)
    with_head = ~simple[of_line]
    first_line = np.zeros(len(positions), bool)
    first_line[_starts(lines)[lines > 0]] = True
    of_poly = np.repeat(np.arange(len(lines)), lines)
    poly_head = first_line & nested[of_poly] if len(lines) else first_line
    many = ordinates + with_head + poly_head
    at, values = _starts(many), np.zeros(int(many.sum()), np.uint64)
    values[at[poly_head]] = lines[of_poly[poly_head]].astype(np.uint64)
    values[(at + poly_head)[with_head]] = ordinates[with_head].astype(np.uint64)
    values[np.repeat(at + poly_head + with_head, ordinates) + _within(ordinates)] = z
    size = _varint_size(values)
    data = np.zeros(int(size.sum()), np.uint8)
    _put_varints(data, _starts(size), values, size)
    per = np.bincount(np.repeat(of_line, many), size, n).astype(np.int64)
    # Bounds.
    box, full = np.zeros((n, 4), np.float64), np.zeros(n, bool)
    if len(width):
        r, i = np.unique(of_position, return_index=True)
        xs, ys = x[value_at], x[value_at + 1]
        for k, (fn, v) in enumerate(((np.minimum, xs), (np.minimum, ys), (np.maximum, xs), (np.maximum, ys))):
            box[r, k] = fn.reduceat(v, i)
        full[r] = True
    return d, data, per, np.trunc(box * codec.POWER).astype(np.int64), full


def encode(ids: pa.Array, props: pa.Array, kinds: pa.Array, dims: pa.Array, coords: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All payloads' bytes and sizes, and their bounds in units, where they have any."""
    n = len(ids)
    code = {t: k + 1 for k, t in enumerate(TYPES)}
    names = kinds.dictionary_encode()
    known = [code.get(t, -1) for t in names.dictionary.to_pylist()]
    kind = np.where(np.asarray(kinds.is_valid()), np.array([*known, 0])[np.asarray(names.indices.fill_null(len(known)))], 0)
    _need(kind >= 0)
    has = kind > 0
    p_data, p_size = _entries(props, n)
    d, g_data, g_size, box, full = _bodies(kind, dims, coords)
    given = np.asarray(ids.is_valid())
    number = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
    i_size = _varint_size(number)
    id_size = np.where(given, 1 + i_size, 0)
    v_body = _varint_size(g_size.astype(np.uint64))
    geometry = np.where(has, 2 + 1 + v_body + g_size, 0)
    z = codec.zigzag(box.ravel())
    z_size = _varint_size(z)
    b_size = z_size.reshape(-1, 4).sum(axis=1)
    bounds = np.where(full, 2 + b_size, 0)  # under 128 bytes: one for their number
    size = id_size + p_size + geometry + bounds
    out, at = np.zeros(int(size.sum()), np.uint8), _starts(size)
    out[at[given]] = 0x08
    _put_varints(out, at[given] + 1, number[given], i_size[given])
    at = at + id_size
    _put(out, at, p_data, p_size)
    at = at + p_size
    g = at[has]
    out[g] = 0x18
    out[g + 1] = np.where(d == 2, kind, (kind << 4) + d)[has]
    out[g + 2] = 0x22
    _put_varints(out, g + 3, g_size[has].astype(np.uint64), v_body[has])
    _put(out, at[has] + 3 + v_body[has], g_data, g_size[has])
    at = (at + geometry)[full]
    out[at] = 0x2A
    out[at + 1] = b_size[full]
    zs, mine = z_size.reshape(-1, 4)[full], z.reshape(-1, 4)[full]
    at = at + 2
    for k in range(4):
        _put_varints(out, at, mine[:, k], zs[:, k])
        at = at + zs[:, k]
    return out, size, box, full


def encode_all(ids: pa.Array, props: pa.Array, kinds: pa.Array, dims: pa.Array, coords: pa.Array) -> pa.Array:
    """Payloads as a binary array."""
    try:
        out, size, _, _ = encode(ids, props, kinds, dims, coords)
        return _to_binary(out, size, pa.binary())
    except (Unusual, IndexError):
        rows = zip(*(x.to_pylist() for x in (ids, props, kinds, dims, coords)))
        return pa.array([codec.encode(dict(zip(("id", "properties", "geom_type", "dims", "coords"), r))) for r in rows], pa.binary())


def framed(arr: pa.Array) -> pa.Array:
    """Records of a binary column's payloads."""
    buf, at, size = _binary(arr)
    if arr.null_count:
        size = np.where(np.asarray(arr.is_valid()), size, 0)
    out, whole = frames(buf, at, size)
    return with_nulls(_to_binary(out, whole, pa.binary()), arr)


def frames(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of payloads that lie in ``data``: bytes and sizes."""
    v = _varint_size(size.astype(np.uint64))
    whole = 1 + v + size
    to, out = _starts(whole), np.zeros(int(whole.sum()), np.uint8)
    out[to] = codec.FRAME
    _put_varints(out, to + 1, size.astype(np.uint64), v)
    _put(out, to + 1 + v, _slices(data, at, size), size)
    return out, whole
