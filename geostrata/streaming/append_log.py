"""Packed files as an append-only log: new whole records of every micro-batch.

The offset is the number of bytes read of each file, so files may grow and new
ones may appear.  A record that is still being written waits for the next batch.
The driver only lists files and, for those without an index, steps over the new
records' heads; records are read by tasks, along the index's ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceStreamReader

#: Bytes that are fetched to step over records' heads.
STEP = 8 << 20


def whole_records(read_at, size: int, at: int) -> int:  # noqa: ANN001
    """The end of the last whole record from a record's start on, in a file of that size."""
    buf, base = b"", at
    while at < size:
        if at + 11 > base + len(buf) and base + len(buf) < size:
            base = at
            buf = read_at(min(STEP, size - at), at)
        k, n, shift = at - base + 1, 0, 0
        while k < len(buf):
            n |= (buf[k] & 127) << shift
            shift += 7
            k += 1
            if buf[k - 1] < 128:
                break
        else:
            return at
        stop = base + k + n
        if stop > size:
            return at
        at = stop
    return at


class AppendLogReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.out = options, schema
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from ..sources.packed import file_system, list_files, read_index

        path = self.options["path"]
        system, _ = file_system(path)
        for file in list_files(path):
            at, size = self.known.get(file, 0), system.get_file_info(file).size
            if size > at and (index := read_index(path, file)) and index[-1]["end"] == size:
                self.known[file] = size
            elif size > at:
                with system.open_input_file(file) as f:
                    self.known[file] = whole_records(f.read_at, size, at)
        return {f: n for f, n in self.known.items() if n}

    def partitions(self, start: dict, end: dict) -> list:
        from ..sources.packed import Range, read_index

        out = []
        for file, until in end.items():
            at = start.get(file, 0)
            cuts = [r["end"] for r in read_index(self.options["path"], file) or [] if at < r["end"] < until]
            out += [Range(file, a, z) for a, z in zip([at, *cuts], [*cuts, until]) if z > a]
        return out

    def read(self, partition) -> Iterator:  # noqa: ANN001
        from ..sources.packed import PackedReader

        return PackedReader(self.options, self.out).read(partition)
