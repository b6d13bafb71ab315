"""Command line: ``python -m geostrata convert|dump|bench SOURCE [TARGET]``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators import export, scan
from .sources import geojson
from .sources.packed import register


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="geostrata")
    p.add_argument("command", choices=("to-packed", "to-geojson", "dump", "bench"))
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--lines", action="store_true", help="the GeoJSON is one feature per line")
    p.add_argument("--legacy", action="store_true", help="dump without quoting")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("geostrata").getOrCreate()
    register(spark)
    if a.command == "to-packed":
        geojson.read(spark, a.source, a.lines).write.format("packedfeature").mode("overwrite").save(a.target)
    elif a.command == "to-geojson":
        (geojson.write_lines if a.lines else geojson.write_collection)(scan.scan(spark, a.source), a.target)
    elif a.command == "dump":
        rows = scan.scan(spark, a.source)
        if a.target:
            export.pipe_export(rows, a.target, legacy=a.legacy)
        else:
            print("|".join([*export.COMMON, "Bounds", "Type", "Geometry"]))
            for line in export.pipe_rows(rows).toLocalIterator():
                print(line[0])
    else:  # the GeoJSON file first, then the packed one, whichever order they come in
        first, second = (a.target, a.source) if a.source.endswith(".pfs") else (a.source, a.target)
        for name, rows in (("geojson", geojson.read(spark, first, a.lines)), ("packed", scan.scan(spark, second))):
            began = time.time()
            n = rows.count()
            print(f"{name}: {n} features in {time.time() - began:.2f} s")


if __name__ == "__main__":
    main()
