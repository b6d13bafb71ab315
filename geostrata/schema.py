"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: Value tags of a property, by the field of ``VALUE`` that holds the value.
STRING, FLOAT, DOUBLE, INT, UINT, SINT, BOOL = 1, 2, 3, 4, 5, 6, 7

VALUE = T.StructType(
    [
        T.StructField("tag", T.ByteType()),
        T.StructField("s", T.StringType()),
        T.StructField("f", T.FloatType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("i", T.LongType()),
        T.StructField("u", T.DecimalType(20, 0)),
        T.StructField("b", T.BooleanType()),
    ]
)
PROPERTIES = T.MapType(T.StringType(), VALUE)
BBOX = T.StructType([T.StructField(k, T.DoubleType()) for k in "wsen"])
#: polygon > ring or line > position > ordinate, for every geometry type.
COORDS = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))

FEATURE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("properties", PROPERTIES),
        T.StructField("geom_type", T.StringType()),
        T.StructField("dims", T.IntegerType()),
        T.StructField("coords", COORDS),
        T.StructField("bbox", BBOX),
    ]
)
POSITIONS = [T.StructField("_pos_start", T.LongType()), T.StructField("_pos_end", T.LongType())]
RAW = T.StructType([T.StructField("payload", T.BinaryType()), *POSITIONS])
INDEX = T.StructType(
    [T.StructField("key", T.StringType()), *[T.StructField(k, T.LongType()) for k in ("start", "end", "size", "count")], *[T.StructField(k, T.DoubleType()) for k in "wsen"]]
)
TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
FEATURE_COLUMNS = [f.name for f in FEATURE]
