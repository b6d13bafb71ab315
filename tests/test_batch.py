"""The batch codec against the record codec."""

import random
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

from geostrata.functions import batch, codec
from geostrata.schema import FEATURE, FEATURE_COLUMNS, TYPES

KIND = {f.name: to_arrow_type(f.dataType) for f in FEATURE}


def value(r):
    empty = {"tag": 1, "s": None, "f": None, "d": None, "i": None, "u": None, "b": None}
    tag = r.randint(1, 7)
    v = {
        1: ("s", r.choice(["", "a", "größe 漢字", "x" * 300])), 2: ("f", struct.unpack("<f", struct.pack("<f", r.uniform(-9, 9)))[0]), 3: ("d", r.uniform(-9, 9)),
        4: ("i", r.choice([0, 5, -1, 2**62, -(2**63)])), 5: ("u", Decimal(r.choice([0, 7, 2**64 - 1]))), 6: ("u", Decimal(r.choice([0, 300]))), 7: ("b", r.random() < 0.5),
    }[tag]
    return empty | {"tag": tag, v[0]: v[1]}


def feature(r, odd=False):
    dims = r.choice([2, 2, 2, 3, 4])
    p = lambda: [r.uniform(-179, 179), r.uniform(-85, 85), *[r.uniform(-5, 5) for _ in range(dims - 2)]]
    line = lambda n: [p() for _ in range(n)]
    kind = r.choice([*TYPES, None])
    coords = {
        "Point": lambda: [[[p()]]], "LineString": lambda: [[line(r.randint(1, 40))]], "MultiPoint": lambda: [[line(r.randint(1, 5))]],
        "Polygon": lambda: [[line(4) for _ in range(r.randint(1, 3))]], "MultiLineString": lambda: [[line(r.randint(1, 9)) for _ in range(r.randint(1, 4))]],
        "MultiPolygon": lambda: [[line(r.randint(3, 6)) for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 4))], None: lambda: None,
    }[kind]()
    if odd and kind and r.random() < 0.3:
        coords = r.choice([[], [[]], [[[[1.0, 2.0], [3.0, 4.0, 5.0]]]]])
    props = sorted((k, value(r)) for k in r.sample(["a", "b", "Zz", "é", "key" * 50], r.randint(0, 4)))
    r.shuffle(props)
    return {"id": r.choice([None, 0, 1, -1, 2**40]), "properties": props, "geom_type": kind, "dims": dims if kind and r.random() < 0.5 else None, "coords": coords}


def arrays(rows):
    return [pa.array([f[c] for f in rows], KIND[c]) for c in ("id", "properties", "geom_type", "dims", "coords")]


def slow(payloads, columns, zz=False):
    rows = [codec.decode(p, zz) for p in payloads]
    rows = [r | {"properties": sorted(r["properties"].items())} for r in rows]
    return {c: pa.array([r[c] for r in rows], KIND[c]).to_pylist() for c in columns}


@pytest.mark.parametrize("seed, odd", [(1, False), (2, False), (3, True), (4, True)])
def test_batches(seed, odd):
    r = random.Random(seed)
    rows = [feature(r, odd) for _ in range(300)]
    want = [codec.encode(f | {"properties": dict(f["properties"])}) for f in rows]
    got = batch.encode_all(*arrays(rows))
    assert got.to_pylist() == want
    assert batch.encode_all(*[a.slice(7, 50) for a in arrays(rows)]).to_pylist() == want[7:57]
    if not odd:  # without a way around it
        out, size, _, _ = batch.encode(*arrays(rows))
        assert out.tobytes() == b"".join(want) and size.tolist() == list(map(len, want))
    stream = b"".join(map(codec.frame, want))
    start, end = batch.offsets(stream)
    assert [(a, z) for _, a, z in codec.records(stream)] == list(zip(start.tolist(), end.tolist()))
    data, whole = batch.frames(np.frombuffer(b"".join(want), np.uint8), batch._starts(np.array(list(map(len, want)))), np.array(list(map(len, want))))
    assert data.tobytes() == stream and int(whole.sum()) == len(stream)
    for columns in (FEATURE_COLUMNS, ["id"], ["properties"], ["geom_type", "dims"], ["coords"], ["id", "bbox"], ["bbox"], ["coords", "id"]):
        read = batch.decode_all(stream, start, end, columns)
        have = {c: read[c].cast(KIND[c]).to_pylist() for c in columns}
        assert all(read[c].type == KIND[c] for c in columns)
        if columns == ["bbox"]:
            assert have["bbox"] == [codec.read_bbox(p) for p in want]
        else:
            assert have == slow(want, columns), columns
    if not odd:
        batch.decode(np.frombuffer(stream, np.uint8), start, end, FEATURE_COLUMNS)


def test_damaged_and_foreign_payloads_take_the_slow_way():
    twice = codec.write_property("k", 4, 1) + codec.write_property("k", 4, 2)
    for p in (twice, b"\x08\x05\x82\x01\x01a", b"\x12\x03\x0a\x01k", b"\x12\x05\x0a\x01k\x12\x00", codec.write_property("k", 1, "x").replace(b"x", b"\xff"), b"\x18\x01\x22\x01\x02", b"", codec.write_property("z", 6, 7)):
        stream = codec.frame(p)
        for zz in (False, True):
            got = batch.decode_all(stream, *batch.offsets(stream), FEATURE_COLUMNS, zz)
            assert {c: got[c].to_pylist() for c in FEATURE_COLUMNS} == slow([p], FEATURE_COLUMNS, zz), p
    with pytest.raises(ValueError, match="can't be packed"):
        batch.encode_all(*arrays([{"id": 1, "properties": [], "geom_type": "GeometryCollection", "dims": None, "coords": None}]))


def test_empty():
    start, end = batch.offsets(b"")
    got = batch.decode_all(b"", start, end, FEATURE_COLUMNS)
    assert all(len(got[c]) == 0 and got[c].type == KIND[c] for c in FEATURE_COLUMNS)
    assert len(batch.encode_all(*arrays([]))) == 0


def test_tile_covers():
    from geostrata.functions import tiles

    r = random.Random(9)
    rows = []
    for k in range(400):
        f = feature(r)
        spread = r.choice([0.01, 1, 20])
        x0, y0 = r.uniform(-150, 150), r.uniform(-80, 80)
        if f["coords"] and k % 2:
            f["coords"] = [[[[x0 + p[0] / 180 * spread, y0 + p[1] / 90 * spread, *p[2:]] for p in line] for line in polygon] for polygon in f["coords"]]
        if k % 50 == 0:
            f = {"geom_type": "Polygon", "coords": [[[[0.0, 0.0], [0.0, 10.0], [10.0, 10.0], [10.0, 0.0], [0.0, 0.0]], [[2.0, 2.0], [2.0, 8.0], [8.0, 8.0], [8.0, 2.0]]]]}
        rows.append((f["geom_type"], f["coords"]))
    types, coords = pa.array([t for t, _ in rows], pa.string()), pa.array([c for _, c in rows], KIND["coords"])
    for zoom in (0, 3, 6):
        rec, x, y = tiles.cover_batch(types.slice(3), coords.slice(3), zoom)
        got = list(zip(rec.tolist(), x.tolist(), y.tolist()))
        want = [(k, t["x"], t["y"]) for k, (kind, c) in enumerate(rows[3:]) for t in tiles.cover(kind, c, zoom)]
        assert len(set(got) ^ set(want)) <= len(want) // 10_000 and got == sorted(got)
    rec, x, y = tiles.cover_batch(types.slice(0, 0), coords.slice(0, 0), 5)
    assert len(rec) == 0
