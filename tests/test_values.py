import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strata.functions import values as v


@pytest.fixture
def text_of(spark):
    def render(value, dtype, fn=v.value_text):
        df = spark.createDataFrame([(value,)], f"x {dtype}")
        return df.select(fn(F.col("x"), df.schema["x"].dataType).alias("r")).first()[0]

    return render


@pytest.mark.parametrize(
    "number, expected",
    [
        (23.0, "23"), (0.05, "0.05"), (-1.5, "-1.5"), (0.0, "0"), (-0.0, "0"), (12345678.9, "12345678.9"),
        (1e7, "10000000"), (123456789012345680.0, "123456789012345680"), (1e20, "100000000000000000000"),
        (1e21, "1e+21"), (1.5e22, "1.5e+22"), (0.001, "0.001"), (0.00012, "0.00012"), (0.000001, "0.000001"),
        (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (-2.5e-10, "-2.5e-10"), (float("inf"), "Infinity"), (float("nan"), "NaN"),
        (100000.0, "100000"), (1234567.125, "1234567.125"), (98765432.125, "98765432.125"),
    ],
)
def test_double_text(text_of, number, expected):
    assert text_of(number, "double") == expected


def test_other_texts(text_of):
    assert text_of(Decimal("12.50"), "decimal(8,2)") == "12.5"
    assert text_of(Decimal("100.00"), "decimal(8,2)") == "100"
    assert text_of(True, "boolean") == "true"
    assert text_of(dt.datetime(2024, 1, 2, 3, 4, 5, 678900), "timestamp_ntz") == "2024-01-02T03:04:05.678Z"
    assert text_of(dt.date(2024, 1, 2), "date") == "2024-01-02T00:00:00.000Z"
    assert text_of(bytearray(b"abc"), "binary") == "YWJj"
    assert text_of(None, "string") is None


@pytest.mark.parametrize(
    "value, dtype, expected",
    [
        (None, "int", "NULL"), (5, "int", "5"), (1.5, "double", "1.5"), (float("nan"), "double", "NULL"),
        (float("-inf"), "double", "NULL"), (True, "boolean", "TRUE"), ("it's", "string", "'it''s'"),
        (dt.datetime(2024, 1, 2), "timestamp_ntz", "'2024-01-02T00:00:00.000Z'"),
        ([1, None], "array<int>", "'[1,null]'"), (("a'b", 2), "struct<k:string,n:int>", '\'{"k":"a\'\'b","n":2}\''),
    ],
)
def test_sql_literal(text_of, value, dtype, expected):
    assert text_of(value, dtype, v.sql_literal) == expected


def test_json_value(text_of):
    big = 9007199254740991
    assert text_of(big, "bigint", v.json_value) == str(big)
    assert text_of(big + 1, "bigint", v.json_value) == f'"{big + 1}"'
    assert text_of(-big - 1, "bigint", v.json_value) == f'"{-big - 1}"'
    assert text_of('a"\\\n', "string", v.json_value) == '"a\\"\\\\\\n"'
    assert text_of(float("nan"), "double", v.json_value) == "null"
    assert text_of({"k": big + 1}, "map<string,bigint>", v.json_value) == f'{{"k":"{big + 1}"}}'
    assert text_of(None, "array<int>", v.json_value) == "null"


@pytest.mark.parametrize(
    "text, expected",
    [("plain", "plain"), ("a,b", '"a,b"'), ('q"', '"q"""'), ("x\ny", '"x\ny"'), ("x\ry", '"x\ry"'), ("", ""), (None, "")],
)
def test_csv_minimal(one, text, expected):
    assert one(lambda c: v.csv_minimal(F.col(c)), text) == expected


def test_csv_quoted(one):
    assert one(lambda c: v.csv_quoted(F.col(c)), 'a"b') == '"a""b"'
    assert one(lambda c: v.csv_quoted(F.col(c)), None) == '""'


@pytest.mark.parametrize(
    "text, expected",
    [("1d", 0.0), ("1e3", 1000.0), (" 12 ", 12.0), ("NaN", 0.0), ("Infinity", float("inf")), ("", 0.0), (None, 0.0), ("-.5", -0.5), ("x", 0.0), ("5.", 5.0)],
)
def test_chart_number(text_of, text, expected):
    assert text_of(text, "string", v.chart_number) == expected


def test_chart_number_types(text_of):
    assert text_of(True, "boolean", v.chart_number) == 1.0
    assert text_of(float("nan"), "double", v.chart_number) == 0.0
    assert text_of(dt.date(2024, 1, 1), "date", v.chart_number) == 0.0


def test_normalize_type_name(one):
    assert one(v.normalize_type_name, "TIMESTAMP WITH TIME ZONE") == "timestamptz"
    assert one(v.normalize_type_name, "Jsonb") == "Jsonb"


@pytest.mark.parametrize(
    "text, expected",
    [("true", "boolean"), ("12", "integer"), ("1.5", "decimal"), ("2024-01-01T10:00:00.000Z", "timestamp"), ("x", "varchar"), ("", "varchar"), (None, None)],
)
def test_text_class(one, text, expected):
    assert one(v.text_class, text) == expected


@pytest.mark.parametrize(
    "ts, bucket",
    [
        ("2024-03-10 00:00:00", "Today"), ("2024-03-09 23:59:59", "Yesterday"), ("2024-03-03 00:00:00", "Last 7 Days"),
        ("2024-03-02 23:59:59", "Last 30 Days"), ("2024-02-09 00:00:00", "Last 30 Days"), ("2024-02-08 23:00:00", "Older"),
    ],
)
def test_recency_bucket(one, ts, bucket):
    now = F.lit("2024-03-10 15:00:00").cast("timestamp_ntz")
    assert one(lambda c: v.recency_bucket(F.col(c).cast("timestamp_ntz"), now), ts) == bucket
