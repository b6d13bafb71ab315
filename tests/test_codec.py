import math
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from geostrata.functions import batch, codec
from geostrata.schema import TYPES


def value(tag, v):
    out = {"tag": tag, "s": None, "f": None, "d": None, "i": None, "u": None, "b": None}
    out[codec._FIELDS[tag]] = v
    return out


def coords_of(rng, kind, dims):
    point = lambda: [round(rng.uniform(-180, 180), 6), round(rng.uniform(-85, 85), 6), *[round(rng.uniform(0, 900), 3) for _ in range(dims - 2)]]
    line = lambda n: [point() for _ in range(n)]
    if kind == "Point":
        return [[[point()]]]
    if kind in ("LineString", "MultiPoint"):
        return [[line(rng.randint(1, 40))]]
    if kind in ("Polygon", "MultiLineString"):
        return [[line(rng.randint(0, 9)) for _ in range(rng.randint(1, 4))]]
    return [[line(rng.randint(1, 7)) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(1, 4))]


def test_known_bytes():
    f = {"id": 300, "properties": {"a": value(1, "x")}, "geom_type": "Point", "dims": 2, "coords": [[[[0.0000001, -0.0000001]]]]}
    assert codec.encode(f).hex() == "08ac02" + "1208" + "0a0161" + "1203" + "0a0178" + "1801" + "22020201" + "2a0402010201"
    assert codec.frame(b"abc") == b"\x0a\x03abc"
    line = {"id": None, "properties": {}, "geom_type": "LineString", "dims": 2, "coords": [[[[1e-7, 2e-7], [3e-7, 1e-7]]]]}
    assert codec.encode(line).hex() == "1802" + "220402040401" + "2a0402020604"


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("dims", [2, 3, 4])
def test_round_trip(kind, dims):
    rng = random.Random(f"{kind}{dims}")
    for _ in range(40):
        c = coords_of(rng, kind, dims)
        props = {"s": value(1, "ß中|\n"), "f": value(2, 0.5), "d": value(3, math.pi), "i": value(4, rng.randint(-(2**63), 2**63 - 1)), "u": value(5, Decimal(2**64 - 1)), "b": value(7, rng.random() < 0.5)}
        ident = rng.choice([None, 0, -1, 2**40])
        got = codec.decode(codec.encode({"id": ident, "properties": props, "geom_type": kind, "dims": dims, "coords": c}))
        assert got["id"] == ident and got["geom_type"] == kind and got["dims"] == dims
        assert got["properties"] == props
        want = [[[[math.trunc(x * 1e7) / 1e7 for x in p] for p in line] for line in polygon] for polygon in c]
        assert got["coords"] == want


def test_varints_agree_and_hold_all_sizes():
    values = [0, 1, 127, 128, 2**14 - 1, 2**14, 2**28, 2**35, 2**42, 2**49, 2**55, 2**56, 2**63, 2**64 - 1]
    assert codec.varints(np.array(values, np.uint64)) == b"".join(map(codec.varint, values))
    assert codec.read_varints(codec.varints(np.array(values, np.uint64))).tolist() == values
    assert [codec.read_varint(codec.varint(v), 0)[0] for v in values] == values


def test_zigzag():
    q = np.array([0, -1, 1, -2, 2**62, -(2**62), -(2**63)], np.int64)
    assert codec.zigzag(q).tolist()[:4] == [0, 1, 2, 3]
    assert codec.unzigzag(codec.zigzag(q)).tolist() == q.tolist()


def test_empty_geometries_have_no_bounds():
    for kind in TYPES:
        got = codec.decode(codec.encode({"geom_type": kind, "coords": []}))
        assert (got["geom_type"], got["coords"], got["bbox"], got["dims"]) == (kind, [], None, 2)


def test_empty_ring_keeps_the_later_ones():
    c = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], [], [[0.5, 0.5], [0.6, 0.5]]]]
    assert codec.decode(codec.encode({"geom_type": "Polygon", "coords": c}))["coords"] == c


def test_mixed_positions_are_padded_or_cut():
    c = [[[[1.0, 2.0, 3.0], [4.0, 5.0], [6.0, 7.0, 8.0, 9.0]]]]
    assert codec.decode(codec.encode({"geom_type": "LineString", "coords": c}))["coords"] == [[[[1.0, 2.0, 3.0], [4.0, 5.0, 0.0], [6.0, 7.0, 8.0]]]]


def test_unknown_geometry_is_refused():
    with pytest.raises(ValueError):
        codec.encode({"geom_type": "GeometryCollection", "coords": []})


def test_old_bounds_are_replaced_and_short_points_read():
    point = b"\x18\x01\x22" + codec.packed(codec.zigzag(codec.quantize(np.array([10.5, -3.25]))))
    old = point + b"\x2a" + codec.packed(np.array([105000000, -32500000 % 2**64, 105000000, -32500000 % 2**64], np.uint64))
    assert codec.decode(old)["bbox"] == {"w": 10.5, "s": -3.25, "e": 10.5, "n": -3.25}
    short = b"\x18" + bytes([(1 << 4) + 3]) + point[2:]
    assert codec.decode(short)["coords"] == [[[[10.5, -3.25]]]] and codec.decode(short)["dims"] == 2


def test_sint_is_raw_unless_asked():
    entry = b"\x12\x08\x0a\x01k\x12\x03\x30\x8e\x03"
    assert codec.decode(entry)["properties"]["k"]["u"] == 398
    assert codec.decode(entry, True)["properties"]["k"]["u"] == 199


def test_partial_reads_go_forward():
    # A bounds payload that itself holds the byte 42.
    f = {"id": 1, "properties": {"TILEID": value(1, "1-2-3"), "z": value(3, 1.0)}, "geom_type": "Point", "dims": 2, "coords": [[[[21.4e-7, 21.4e-7]]]]}
    b = codec.encode(f)
    assert b.endswith(b"\x2a\x04\x2a\x2a\x2a\x2a")
    assert codec.read_bbox(b) == codec.decode(b)["bbox"]
    assert codec.read_keys(b) == ["TILEID", "z"] and codec.read_one(b, "TILEID")["s"] == "1-2-3" and codec.read_one(b, "none") is None


def test_fields_may_come_in_any_order():
    f = {"id": 7, "properties": {"a": value(4, 5)}, "geom_type": "Point", "dims": 2, "coords": [[[[1.0, 2.0]]]]}
    b = codec.encode(f)
    parts = [b[:2], b[2:]]
    assert codec.decode(parts[1] + parts[0]) == codec.decode(b)


def test_streams_concatenate():
    a, b = codec.frame(b"one"), codec.frame(b"x" * 300)
    assert [p for p, _, _ in codec.records(a + b)] == [b"one", b"x" * 300]
    assert [(s, e) for _, s, e in codec.records(a + b)] == [(2, 5), (8, 308)]


def test_few_varints_are_those_of_many():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 15, 16, 17, 100):
        v = rng.integers(0, 1 << 63, n, np.uint64) >> rng.integers(0, 63, n).astype(np.uint64)
        v[: n // 5] = np.uint64((1 << 64) - 1)
        whole = codec.varints(v)
        assert whole == b"".join(codec.varint(int(x)) for x in v)
        far = codec.read_varints(whole + b"\x01" * 200 + b"\x80")  # long enough for the other way; a cut one at the end counts not
        assert codec.read_varints(whole).tolist() == v.tolist() == far[:n].tolist() and len(far) == n + 200
        assert codec.read_varints(whole + b"\x80").tolist() == v.tolist()


def test_ids_of_any_size():
    """The whole id is written, also beyond the five bytes that the queries' SQL spells out."""
    ids = [0, 127, (1 << 35) - 1, 1 << 35, 59_000_014_999, (1 << 63) - 1, -1]
    rows = [{"id": i, "properties": {}, "geom_type": "Point", "dims": 2, "coords": [[[[1.5, 2.5]]]]} for i in ids]
    columns = [pa.array([r[c] for r in rows], batch._KINDS[c]) for c in ("id", "properties", "geom_type", "dims", "coords")]
    for r, payload in zip(rows, batch.encode_all(*columns).to_pylist()):
        assert payload == codec.encode(r) and codec.read_varint(payload, 1)[0] == r["id"] & ((1 << 64) - 1)
        assert codec.decode(payload)["id"] == r["id"]
