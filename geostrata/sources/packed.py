"""The packed feature stream as a Spark data source, ``packedfeature``.

Read options: ``mode`` (``feature`` or ``raw``), ``positions``, ``columns`` (the
feature columns to decode; the others are skipped), ``key`` and ``bounds``
(``w,s,e,n``; both prune by the index), ``from_pos``, ``ranges`` (JSON of file
name or null, start and end: single payloads, read by seeking), ``joined``
(positions are those of all files, in order, as one stream), ``sint_zigzag``.  A
file is split along its index; one without an index is one partition, as its
records carry no sync marker.

A write makes one file per task, with an index beside it (``<file>.index``): a
byte range for each ``RANGE_BYTES`` or change of the column ``key``, if there is
one.  Files are written under a temporary name and renamed by the commit.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import batch, codec
from ..schema import FEATURE, FEATURE_COLUMNS, POSITIONS, RAW

RANGE_BYTES = 64 << 20
BATCH = 4096
SUFFIX = ".pfs"


def file_system(path: str):  # noqa: ANN201
    """File system and path of a location; a plain path is a local one."""
    import pyarrow.fs as fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def list_files(path: str, suffix: str = SUFFIX) -> list[str]:
    import pyarrow.fs as fs

    system, p = file_system(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.File:
        return [p]
    if info.type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(p, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


def file_size(path: str, file: str) -> int:
    return file_system(path)[0].get_file_info(file).size


def read_index(path: str, file: str) -> list[dict] | None:
    system, _ = file_system(path)
    if system.get_file_info(file + ".index").type.name != "File":
        return None
    with system.open_input_stream(file + ".index") as f:
        return json.loads(f.read())


def is_metadata(row: dict) -> bool:
    """Whether a record is the leading index record of an older writer."""
    return set(row["properties"]) == {"metadata"}


@dataclass
class Range(InputPartition):
    """A byte range of a file that begins and ends at records, or single records'
    positions in it.  base: what is added to positions."""

    file: str
    start: int
    end: int | None
    at: tuple[tuple[int, int], ...] | None = None
    base: int = 0


class PackedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.out = options, schema
        self.path = options.get("path") or ""
        self.raw = options.get("mode", "feature") == "raw"
        self.joined = options.get("joined", "false").lower() == "true"

    def _files(self) -> list[tuple[str, int]]:
        """Files, and what is added to positions in them."""
        files = list_files(self.path)
        sizes = [file_size(self.path, f) if self.joined else 0 for f in files]
        return list(zip(files, accumulate(sizes, initial=0)))

    def partitions(self) -> list[Range]:
        key, box = self.options.get("key"), self.options.get("bounds")
        want = [float(v) for v in box.split(",")] if box else None
        first = int(self.options.get("from_pos", 0))
        out = []
        if self.options.get("ranges"):
            return self._single(json.loads(self.options["ranges"]))
        for file, base in self._files():
            index, at = read_index(self.path, file), max(0, first - base)
            if index is None:
                if not self.joined or at < file_size(self.path, file):
                    out.append(Range(file, at, None, base=base))
                continue
            for r in index:
                if key is not None and r["key"] != key or r["end"] <= at:
                    continue
                if want and r["w"] is not None and not (r["e"] >= want[0] and want[2] >= r["w"] and r["n"] >= want[1] and want[3] >= r["s"]):
                    continue
                out.append(Range(file, max(r["start"], at), r["end"], base=base))
        return out or [Range("", 0, 0)]

    def _single(self, ranges: list) -> list[Range]:
        """Positions as partitions of up to ``BATCH`` records: nothing else is read."""
        by_file: dict[tuple[str, int], list[tuple[int, int]]] = {}
        files = self._files()
        for name, a, z in ranges:
            if name is not None:
                mine = [(f, 0) for f, _ in files if f.endswith(name)]
            else:
                mine = files[bisect_right(files, int(a), key=lambda x: x[1]) - 1 :][:1] if self.joined and files else files
            for file, base in mine:
                by_file.setdefault((file, base), []).append((int(a) - base, int(z) - base))
        out = [Range(f, 0, 0, tuple(sorted(at)[k : k + BATCH]), base) for (f, base), at in by_file.items() for k in range(0, len(at), BATCH)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.file:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.file) as f:
            if partition.at is None:
                end = f.size() if partition.end is None else partition.end
                f.seek(partition.start)
                pieces = [(partition.start, f.read(end - partition.start))]
            else:  # single records, by their positions
                pieces = [(a, f.read_at(z - a, a)) for a, z in partition.at]
        kind, names = to_arrow_schema(self.out), [x.name for x in self.out]
        box = self.options.get("bounds")
        want = [float(v) for v in box.split(",")] if box else None
        zz = self.options.get("sint_zigzag", "false").lower() == "true"
        if partition.at is None:
            first, buf = pieces[0]
            start, end = batch.offsets(buf)
            if len(start) and first == 0 and codec.read_keys(buf[start[0] : end[0]]) == ["metadata"]:
                start, end = start[1:], end[1:]
            shift = np.full(len(start), first + partition.base)
        else:
            size = np.array([len(b) for _, b in pieces], np.int64)
            buf, end = b"".join(b for _, b in pieces), np.cumsum(size)
            start = end - size
            shift = np.array([a for a, _ in pieces], np.int64) - start + partition.base
        for k in range(0, len(start), BATCH):
            a, z, base = start[k : k + BATCH], end[k : k + BATCH], shift[k : k + BATCH]
            if want:  # bounds alone decide, before anything else is decoded
                b = batch.decode_all(buf, a, z, ["bbox"])["bbox"]
                w, s, e, n = (np.asarray(x.fill_null(np.nan)) for x in b.flatten())
                keep = ~((e < want[0]) | (want[2] < w) | (n < want[1]) | (want[3] < s)) | ~np.asarray(b.is_valid())
                a, z, base = a[keep], z[keep], base[keep]
            got = {"_pos_start": pa.array(base + a), "_pos_end": pa.array(base + z)}
            if self.raw and "payload" in names:
                got["payload"] = batch._to_binary(batch._slices(np.frombuffer(buf, np.uint8), a, z - a), z - a, pa.binary())
            elif columns := [c for c in names if c in FEATURE_COLUMNS]:
                lo, hi = (int(a[0]), int(z[-1])) if len(a) and partition.at is None else (0, len(buf))
                got |= batch.decode_all(memoryview(buf)[lo:hi], a - lo, z - lo, columns, zz)
            if len(a):
                yield pa.RecordBatch.from_arrays([got[c].cast(kind.field(c).type) for c in names], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class PackedWriter(DataSourceArrowWriter):
    """Takes feature rows, or ``payload`` (encoded), or ``frame`` (framed)."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def _framed(self, b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
        """A batch's records: bytes, sizes, bounds (w, s, e, n) and which have any."""
        import pyarrow as pa

        names = b.schema.names
        if "frame" in names:
            buf, at, size = batch._binary(b.column(names.index("frame")))
            out, whole = batch._slices(buf, at, size), size
            start, end = batch.offsets(out.tobytes())
            box = batch.decode_all(out.tobytes(), start, end, ["bbox"])["bbox"]
            if len(start) != len(whole):  # several records, or none, in a row
                whole = np.diff(np.concatenate([[0], end]))
        else:
            if "payload" in names:
                payload = b.column(names.index("payload"))
                box = None
            else:
                columns = [b.column(names.index(c)) if c in names else pa.nulls(b.num_rows, batch._KINDS[c]) for c in ("id", "properties", "geom_type", "dims", "coords")]
                columns = [x.cast(batch._KINDS[c]) for x, c in zip(columns, ("id", "properties", "geom_type", "dims", "coords"))]
                try:
                    data, size, units, full = batch.encode(*columns)
                    out, whole = batch.frames(data, np.cumsum(size) - size, size)
                    return out, whole, units / codec.POWER, full
                except (batch.Unusual, IndexError):
                    payload, box = batch.encode_all(*columns), None
            if payload.null_count:
                raise ValueError("a payload is null")
            buf, at, size = batch._binary(payload)
            out, whole = batch.frames(buf, at, size)
            if box is None:
                box = batch.decode_all(buf.tobytes(), at, at + size, ["bbox"])["bbox"]
        full = np.asarray(box.is_valid())
        bounds = np.stack([np.asarray(x.fill_null(0.0)) for x in box.flatten()], axis=1) if len(box) else np.zeros((0, 4))
        return out, whole, bounds, full

    def write(self, iterator: Iterator) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"{root}/_{uuid.uuid4().hex}{SUFFIX}"
        at, index, now = 0, [], None
        with system.open_output_stream(name) as f:
            for b in iterator:
                if not b.num_rows:
                    continue
                out, whole, bounds, full = self._framed(b)
                f.write(out.tobytes())
                keys = b.column(b.schema.names.index("key")).to_pylist() if "key" in b.schema.names else None
                if keys and len(keys) != len(whole):
                    raise ValueError("a row with a key must hold one record")
                stop = np.cumsum(whole) + at
                change = np.flatnonzero([x != y for x, y in zip(keys, keys[1:])]) + 1 if keys else np.zeros(0, np.int64)
                k, n = 0, len(whole)
                while k < n:  # a range a turn: to the next key, or until the range is full
                    key = keys[k] if keys else None
                    if now is None or key != now["key"] or at - now["start"] >= self.range_bytes:
                        now = {"key": key, "start": at, "end": at, "count": 0, "w": None, "s": None, "e": None, "n": None}
                        index.append(now)
                    cut = np.searchsorted(change, k, "right")
                    until = int(change[cut]) if cut < len(change) else n
                    until = min(until, int(np.searchsorted(stop, now["start"] + self.range_bytes)) + 1)
                    until = max(until, k + 1)
                    at = int(stop[until - 1])
                    now["end"], now["count"] = at, now["count"] + until - k
                    box = bounds[k:until][full[k:until]]
                    if len(box):
                        for name_, fn, v in (("w", min, box[:, 0].min()), ("s", min, box[:, 1].min()), ("e", max, box[:, 2].max()), ("n", max, box[:, 3].max())):
                            now[name_] = float(v) if now[name_] is None else fn(now[name_], float(v))
                    k = until
        if not at:
            system.delete_file(name)
            return Written(None)
        with system.open_output_stream(name + ".index") as f:
            f.write(json.dumps(index).encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in list_files(self.path):
                system.delete_file(f)
                if read_index(self.path, f) is not None:
                    system.delete_file(f + ".index")
        for k, m in enumerate(messages):
            if m and m.file:
                to = f"{root}/part-{k:05d}-{m.file.rsplit('/_', 1)[1]}"
                system.move(m.file + ".index", to + ".index")
                system.move(m.file, to)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(m.file)
                system.delete_file(m.file + ".index")


class PackedFeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packedfeature"

    def schema(self) -> T.StructType:
        if self.options.get("mode", "feature") == "raw":
            return RAW
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else FEATURE.names
        more = POSITIONS if self.options.get("positions", "false").lower() == "true" else []
        return T.StructType([*[FEATURE[n] for n in names], *more])

    def reader(self, schema: T.StructType) -> PackedReader:
        return PackedReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(dict(self.options), schema, overwrite)

    def streamReader(self, schema: T.StructType):  # noqa: ANN201, N802
        from ..streaming.append_log import AppendLogReader

        return AppendLogReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, once."""
    if not getattr(spark, "_geostrata_format", False):
        spark.dataSource.register(PackedFeatureSource)
        spark._geostrata_format = True
