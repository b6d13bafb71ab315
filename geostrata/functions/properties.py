"""Property maps: typed values, lookups and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOOL, DOUBLE, FLOAT, INT, PROPERTIES, STRING, UINT, VALUE

_NULL = {"s": "string", "f": "float", "d": "double", "i": "bigint", "u": "decimal(20,0)", "b": "boolean"}
_FIELD = {STRING: "s", FLOAT: "f", DOUBLE: "d", INT: "i", UINT: "u", BOOL: "b"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value(x: Column, tag: int) -> Column:
    """A typed property value."""
    f = _FIELD[tag]
    return F.struct(F.lit(tag).cast("tinyint").alias("tag"), *[(x if k == f else F.lit(None)).cast(t).alias(k) for k, t in _NULL.items()])


def text(x: Column | str) -> Column:
    return value(_c(x), STRING)


def number(x: Column | str) -> Column:
    return value(_c(x), DOUBLE)


def empty() -> Column:
    return F.create_map().cast(PROPERTIES)


def make(**values: Column) -> Column:
    """A property map of named typed values."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def keys(properties: Column | str = "properties") -> Column:
    return F.array_sort(F.map_keys(_c(properties)))


def map_set(properties: Column | str, key: str, v: Column) -> Column:
    """The map with a value set, whether or not it was there."""
    rest = F.map_filter(F.coalesce(_c(properties), empty()), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), v.cast(VALUE)))


def get(properties: Column | str, key: str) -> Column:
    return F.try_element_at(_c(properties), F.lit(key))


def plain_number(d: Column) -> Column:
    """A double the shortest way: integral values without a fraction."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def value_to_string(v: Column) -> Column:
    """A typed value as text; NULL for none."""
    return F.coalesce(v["s"], plain_number(v["d"]), plain_number(v["f"].cast("double")), v["i"].cast("string"), v["u"].cast("string"), v["b"].cast("string"))


def texts(properties: Column | str = "properties") -> Column:
    """The map with every value as text."""
    return F.transform_values(F.coalesce(_c(properties), empty()), lambda _, v: value_to_string(v))


def map_get_default(properties: Column | str, key: str, default: str = "") -> Column:
    return F.coalesce(value_to_string(get(properties, key)), F.lit(default))


def _json_value(v: Column) -> Column:
    quoted = F.to_json(F.array(v["s"]))
    return F.when(v["s"].isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.coalesce(value_to_string(v), F.lit("null")))


def props_json(properties: Column | str = "properties") -> Column:
    """The map as a JSON object, keys in order."""
    entries = F.array_sort(F.map_entries(F.transform_values(F.coalesce(_c(properties), empty()), lambda _, v: _json_value(v))))

    def pair(e: Column) -> Column:
        k = F.to_json(F.array(e["key"]))
        return F.concat(F.substring(k, F.lit(2), F.length(k) - 2), F.lit(":"), e["value"])

    return F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}"))


def from_json(json: Column | str, keep_json: bool = False) -> Column:
    """The property map of a JSON object: strings, numbers (as doubles) and
    booleans; null, arrays and objects become an empty string, or their JSON
    text with ``keep_json``."""
    entries = F.from_json(_c(json), "map<string,string>")
    raw = F.try_parse_json(_c(json))

    def typed(k: Column, v: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(raw, F.lit("$"), "map<string,variant>")[k])
        kind = F.coalesce(kind, F.lit("VOID"))
        other = F.coalesce(v, F.lit("")) if keep_json else F.lit("")
        return (
            F.when(kind == "STRING", text(v))
            .when(kind == "BOOLEAN", value(v.cast("boolean"), BOOL))
            .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|TINYINT|SMALLINT)"), number(v.cast("double")))
            .otherwise(text(other))
        )

    return F.transform_values(entries, typed)
