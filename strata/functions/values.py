"""Rendering of typed values: plain text, CSV fields, SQL literals, JSON, chart numbers, buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import col, strip

# Fixed values.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
MAX_SAFE_INTEGER = 9007199254740991
TYPE_NAMES = {
    "character varying": "varchar",
    "character": "char",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "time without time zone": "time",
    "time with time zone": "timetz",
    "double precision": "double",
    "real": "float",
    "smallint": "int2",
    "integer": "int",
    "bigint": "int8",
    "boolean": "bool",
}
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"^[+-]?Infinity$"
BUCKETS = ("Today", "Yesterday", "Last 7 Days", "Last 30 Days", "Older")

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def _double_text(c: Column) -> Column:
    """A double as JavaScript prints it: 23, 0.05, 12345678.9, 1e+21, 1.5e-7.

    Java prints the same digits but goes to exponents earlier; those are spelled out through a
    decimal wide enough for every digit. (Before version 19 it gives a few doubles one digit more
    than needed; such a text still reads back as the same double.)
    """
    size, shown = F.abs(c), c.cast("string")
    spelled = lambda scale: shown.cast(f"decimal(38,{scale})").cast("string")
    scientific = F.regexp_replace(F.regexp_replace(shown, r"\.0E", "E"), r"E(\d)", "E+$1")
    return (
        F.when(c == 0, "0")
        .when((size >= 1e21) | (size < 1e-6), F.replace(scientific, F.lit("E"), F.lit("e")))
        .when(size >= 1e7, F.regexp_replace(spelled(12), r"\.?0+$", ""))
        .when(size < 1e-3, F.regexp_replace(spelled(24), "0+$", ""))
        .otherwise(F.regexp_replace(shown, r"\.0$", ""))
    )


def number_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _double_text(c.cast("double"))
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    return c.cast("string")


def _finite(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.lit(True)


def iso_text(c: Column) -> Column:
    return F.date_format(c, ISO_FORMAT)


def value_text(c: Column | str, dtype: T.DataType) -> Column:
    """The text form of a value; null stays null."""
    c = col(c)
    if isinstance(dtype, T.NumericType):
        return number_text(c, dtype)
    if isinstance(dtype, _TIMES):
        return iso_text(c)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, _NESTED):
        return F.when(c.isNotNull(), json_value(c, dtype))
    return c.cast("string")


def _json_string(c: Column) -> Column:
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def json_value(c: Column | str, dtype: T.DataType) -> Column:
    """JSON text of a value: big integers and bytes as strings, times in ISO form, no NaN."""
    c = col(c)
    if isinstance(dtype, T.IntegralType):
        safe = F.abs(c.cast("decimal(20,0)")) <= MAX_SAFE_INTEGER
        text = F.when(safe, c.cast("string")).otherwise(F.concat(F.lit('"'), c.cast("string"), F.lit('"')))
    elif isinstance(dtype, T.NumericType):
        text = F.when(_finite(c, dtype), number_text(c, dtype))
    elif isinstance(dtype, T.BooleanType):
        text = c.cast("string")
    elif isinstance(dtype, _TIMES) or isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit('"'), value_text(c, dtype), F.lit('"'))
    elif isinstance(dtype, T.ArrayType):
        parts = F.transform(c, lambda x: json_value(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    elif isinstance(dtype, T.StructType):
        text = json_object([(f.name, json_value(c[f.name], f.dataType)) for f in dtype.fields])
    elif isinstance(dtype, T.MapType):
        parts = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                _json_string(e["key"].cast("string")), F.lit(":"), json_value(e["value"], dtype.valueType)
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    else:
        text = _json_string(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.coalesce(text, F.lit("null")))


def json_object(parts: list[tuple[str, Column]]) -> Column:
    """JSON object text from (name, JSON text) pairs."""
    pieces: list[Column] = [F.lit("{")]
    for i, (name, text) in enumerate(parts):
        key = name.replace("\\", "\\\\").replace('"', '\\"')
        pieces += [F.lit(f'{"," if i else ""}"{key}":'), text]
    return F.concat(*pieces, F.lit("}"))


def sql_literal(c: Column | str, dtype: T.DataType) -> Column:
    """A value as SQL literal; null, NaN and infinities become NULL."""
    c = col(c)
    if isinstance(dtype, T.NumericType):
        text = F.when(_finite(c, dtype), number_text(c, dtype))
    elif isinstance(dtype, T.BooleanType):
        text = F.upper(c.cast("string"))
    else:
        text = F.concat(F.lit("'"), F.replace(value_text(c, dtype), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def csv_minimal(text: Column) -> Column:
    """Quote only what needs it; null is an empty field."""
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n\r]'), doubled).otherwise(text), F.lit(""))


def csv_quoted(text: Column) -> Column:
    """Quote every field; null is ``""``."""
    return F.concat(
        F.lit('"'), F.coalesce(F.replace(text, F.lit('"'), F.lit('""')), F.lit("")), F.lit('"')
    )


def row_text(df: DataFrame, render: Callable[[Column, T.DataType], Column], sep: str) -> Column:
    return F.concat_ws(sep, *[render(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])


def normalize_type_name(c: Column | str) -> Column:
    """Short type name for a long one; names off the list stay as they are."""
    c = col(c)
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(c)), c)


def chart_number(c: Column | str, dtype: T.DataType) -> Column:
    """A value as chart number: anything that is no number counts as 0."""
    c = col(c)
    if isinstance(dtype, T.NumericType):
        number = c.cast("double")
    elif isinstance(dtype, T.BooleanType):
        number = c.cast("int").cast("double")
    elif isinstance(dtype, T.StringType):
        text = strip(c)
        number = F.when(text.rlike(NUMBER_TEXT) | text.rlike(INFINITY_TEXT), text.try_cast("double"))
    else:
        number = F.lit(None).cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def text_class(c: Column | str) -> Column:
    """Type of a text value by its look: boolean, integer, decimal, timestamp or varchar."""
    c = col(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(c.rlike(NUMBER_TEXT), "decimal")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?$"), "timestamp")
        .otherwise("varchar")
    )


def recency_bucket(ts: Column | str, now: Column) -> Column:
    """Calendar bucket of a time as seen from `now`."""
    ts = col(ts)
    today = F.to_date(now)
    since = lambda days: ts >= F.date_sub(today, days).cast("timestamp_ntz")
    return (
        F.when(since(0), BUCKETS[0])
        .when(since(1), BUCKETS[1])
        .when(since(7), BUCKETS[2])
        .when(since(30), BUCKETS[3])
        .otherwise(BUCKETS[4])
    )
