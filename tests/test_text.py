"""Text helpers against hand-set values and against SQLite's own scalar functions."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from seasonstar.functions import text as T

AWKWARD = [
    "31/02/2024", "1/3/2024", "02/15/2024", "3/2024", " 5/6/2024 ", "15/ 3/2024", "15/3abc/2024",
    "15/+3/2024", "15/-3/2024", "15/003/2024", "15/13/2024", "15/0/2024", "15//2024", "//2024",
    "/5/2024", "a/5/x2024", "a/5/b/c/2024", "1/2/24", "0012/12", "x/0005", "12/5/0000",
    "2024-03-15", "2024-3-5", " 2024-03-15", "2024-03-15 ", "2024-02-30", "2024-02-31",
    "2024-13-01", "2024-00-10", "2024-03-00", "2024-03-32", "2024-03-15 10:30",
    "2024-03-15T10:30:59.123", "2024-03-15 24:00", "2024-03-15 25:00", "2024-03-15T",
    "2024-03-15 abc", "2024-03-15 a/b", "2024-03-15 10:30Z", "20240315", "202401", "2024-03",
    "abc", "", " ", "1,234", "1e3", "-.5e2", "12.9", "  42", "+7", "-7", "- 7",
    "99999999999999999999", "-99999999999999999999", "9223372036854775807",
    "9223372036854775808", ".5", "5.", "5.e", "1e", "1e+", "1e5x", "0x10", "inf", "nan",
    "Infinity", "1d", "1f", "12abc", "\t12", "null", "Null", " null ", "RTO07", "7", "Foo RTO",
    "Foo rto", "Foo RTO ", "RTO", " RTO", "  RTO x", "FooRTO", "Foo RTO RTO", "Ōtorohanga RTO",
    "12/12-1 /2024", "3/3-45 /2024", "3/3-15T/2024", "0/1/2024", "2024-03-1T", "2024-03-1 ",
    "+202-03-15", "2024-03-15\n", "15/3/2024\n", "Foo RTO\n", "1/1/1/1999", None,
]


@pytest.fixture(scope="module")
def parsed(spark):
    frame = spark.createDataFrame(list(enumerate(AWKWARD)), "i int, x string").repartition(3)
    rows = frame.select(
        "i",
        T.lenient_int("x").alias("int"),
        T.lenient_real("x").alias("real"),
        T.month_start("x").cast("string").alias("month"),
        T.strip_suffix("x", " RTO").alias("stripped"),
        T.remove_all("x", " RTO").alias("removed"),
        T.null_text("x").alias("nulled"),
        T.last_chars(T.trimmed("x"), 2).alias("last_two"),
        T.lenient_int(T.last_chars(T.trimmed("x"), 2)).alias("code"),
    ).collect()
    return {AWKWARD[row.i]: row.asDict() for row in rows}


@pytest.mark.parametrize(
    "name, sql",
    [
        ("int", "CAST(:x AS INTEGER)"),
        ("real", "CAST(:x AS REAL)"),
        ("removed", "TRIM(REPLACE(:x, ' RTO', ''))"),
        ("nulled", "NULLIF(TRIM(:x), 'null')"),
        ("last_two", "SUBSTR(TRIM(:x), -2)"),
        ("code", "CAST(SUBSTR(TRIM(:x), -2) AS INTEGER)"),
    ],
)
def test_scalars_agree_with_sqlite(parsed, name, sql):
    con = sqlite3.connect(":memory:")
    for text, row in parsed.items():
        assert row[name] == con.execute(f"SELECT {sql}", {"x": text}).fetchone()[0], repr(text)


def test_dashed_dates_agree_with_sqlite(parsed):
    con = sqlite3.connect(":memory:")
    for text, row in parsed.items():
        if text is None or "/" in text:
            continue
        expected = con.execute("SELECT DATE(?, 'start of month')", (text,)).fetchone()[0]
        if expected is not None and expected.startswith("-"):
            expected = None  # a bare number is a day count to SQLite, and no date here
        assert row["month"] == expected, repr(text)


@pytest.mark.parametrize(
    "text, month",
    [
        ("31/02/2024", (2024, 2)),
        ("1/3/2024", (2024, 3)),
        (" 5/6/2024 ", (2024, 6)),
        ("15/ 3/2024", (2024, 3)),
        ("15/3abc/2024", (2024, 3)),
        ("15/003/2024", (2024, 3)),
        ("a/5/b/c/2024", (2024, 5)),
        ("12/12-1 /2024", (2024, 12)),
        ("3/3-45 /2024", (2024, 3)),
        ("3/3-15T/2024", (2024, 3)),
        ("1/1/1/1999", (1999, 1)),
        ("/5/2024", (2024, 5)),
        ("02/15/2024", None),
        ("3/2024", None),
        ("15/-3/2024", None),
        ("15/0/2024", None),
        ("15//2024", None),
        ("1/2/24", None),
        ("0012/12", None),
        ("x/0005", None),
        ("15/3/2024\n", None),
        ("2024-03-15 a/b", None),
    ],
)
def test_slash_dates(parsed, text, month):
    assert parsed[text]["month"] == (month and "{}-{:02d}-01".format(*month))


def test_strip_suffix(parsed):
    assert parsed["Foo RTO"]["stripped"] == "Foo"
    assert parsed["Foo rto"]["stripped"] == "Foo"
    assert parsed["Foo RTO RTO"]["stripped"] == "Foo RTO"
    assert parsed["FooRTO"]["stripped"] == "FooRTO"
    assert parsed["RTO"]["stripped"] == "RTO"
    assert parsed["Foo RTO\n"]["stripped"] == "Foo RTO\n"
    assert parsed["Ōtorohanga RTO"]["stripped"] == "Ōtorohanga"
    assert parsed[None]["stripped"] is None


def test_recode_leaves_unmapped_labels_null(spark):
    frame = spark.createDataFrame([(" a ",), ("b",), ("A",), (None,)], "x string")
    rows = frame.select(T.recode("x", {"a": "Alpha", "b": "Beta"}).alias("y")).collect()
    assert [row.y for row in rows] == ["Alpha", "Beta", None, None]


def test_no_python_udf_in_text_plans(spark):
    frame = spark.createDataFrame([("x",)], "x string").select(
        T.month_start("x"), T.lenient_int("x"), T.lenient_real("x")
    )
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_functions_work_without_ansi(spark):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        frame = spark.createDataFrame([("12.9 kg",), ("15/13/2024",), ("",)], "x string")
        rows = frame.select(T.lenient_int("x"), T.lenient_real("x"), T.month_start("x")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    assert [tuple(row) for row in rows] == [(12, 12.9, None), (15, 15.0, None), (0, 0.0, None)]


def test_rounding_is_half_up_on_the_decimal_digits(spark):
    from seasonstar.functions.numeric import round_half_up

    values = [2.675, 0.125, -0.125, 1.005, 12.344999999999999, 0.04999999999999, 1e300, None]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    rows = [r.y for r in frame.select(round_half_up(F.col("x"), 2).alias("y")).collect()]
    assert rows == [2.68, 0.13, -0.13, 1.01, 12.34, 0.05, 1e300, None]
