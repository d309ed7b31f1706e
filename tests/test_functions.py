"""Column functions on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas
from shelfcast.functions import calendar, classify, cleaning
from shelfcast.functions import filters as flt

D = dt.date


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(expression).collect()]


def test_empty_filter_keeps_all(spark):
    df = column(spark, ["a", "b", None])
    assert df.where(flt.in_filter("c", [])).count() == 3
    assert df.where(flt.code_part_filter([], 2, 3, "c")).count() == 3
    assert df.where(flt.in_filter("c", ["a"])).count() == 1


@pytest.mark.parametrize("start,length", [(0, 2), (2, 3), (5, 3), (2, 6)])
def test_code_part_equals_substring(spark, start, length):
    codes = ["20118207", "20119204", "2", "20", "", "31118207", None, "2000"]
    values = ["20", "2", "118", "207", "0040", "118207", "", "200"]
    df = column(spark, codes)
    wanted = sorted(c for c in codes if c is not None and c[start:start + length] in values)
    kept = df.where(flt.code_part_filter(values, start, length, "c")).collect()
    assert sorted(r.c for r in kept) == wanted


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        flt.item_dimension_filter("shape", ["x"])
    with pytest.raises(ValueError):
        flt.measure_name("profit")


def test_item_dimensions(spark):
    df = column(spark, ["20118207", "20119204", "31118207"]).withColumnRenamed("c", "item")
    count = lambda kind, value: df.where(flt.item_dimension_filter(kind, [value])).count()
    assert [count("category", "20"), count("catalog", "118"), count("color", "207"),
            count("item", "20118207"), count("catalog+color", "118207")] == [2, 2, 2, 1, 2]


def test_date_range_includes_time_on_last_day(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp '2024-04-01 00:00:00'), (timestamp '2024-06-20 23:59:59'),"
        " (timestamp '2024-06-21 00:00:00'), (NULL) t(c)"
    )
    assert df.where(flt.date_range_filter("c", "2024-04-01", "2024-06-20")).count() == 2


def test_weeks_start_on_sunday(spark):
    days = [D(2024, 3, 30), D(2024, 3, 31), D(2024, 4, 1), D(2024, 4, 6), D(2024, 4, 7)]
    assert apply(spark, days, calendar.period_start("c", "W"), "date") == [
        D(2024, 3, 24), D(2024, 3, 31), D(2024, 3, 31), D(2024, 3, 31), D(2024, 4, 7)
    ]
    assert apply(spark, days, calendar.period_start("c", "W", "end"), "date") == [
        D(2024, 3, 31), D(2024, 3, 31), D(2024, 4, 7), D(2024, 4, 7), D(2024, 4, 7)
    ]


def test_other_periods_and_labels(spark):
    day = [D(2024, 2, 29)]
    start = lambda f: apply(spark, day, calendar.period_start("c", f), "date")[0]
    assert [start(f) for f in ("D", "no_agg", "?", "M", "Q", "Y")] == [
        D(2024, 2, 29), D(2024, 2, 29), D(2024, 2, 29), D(2024, 2, 1), D(2024, 1, 1), D(2024, 1, 1)
    ]
    label = lambda f: apply(spark, day, calendar.period_label("c", f), "date")[0]
    assert [label("M"), label("Y"), label("W")] == ["2024-02", "2024", "2024-02-29"]


@pytest.mark.parametrize("freq,periods", [("D", 81), ("W", 12), ("M", 3), ("Q", 1), ("Y", 1)])
def test_calendar_fill_keeps_sums(spark, freq, periods):
    rows = [(D(2024, 4, 1), "a", 5.0), (D(2024, 4, 2), "a", None), (D(2024, 6, 20), "b", 7.0)]
    df = spark.createDataFrame(rows, "day date, k string, v double")
    filled = calendar.calendar_fill(df, "day", ["v"], "2024-04-01", "2024-06-20", freq).collect()
    assert len(filled) == periods and sum(r.v for r in filled) == 12.0
    keyed = calendar.calendar_fill(df, "day", ["v"], "2024-04-01", "2024-06-20", freq, ["k"]).collect()
    assert len(keyed) == 2 * periods and sum(r.v for r in keyed) == 12.0


def test_calendar_fill_drops_rows_outside_the_range(spark):
    rows = [(D(2023, 1, 1), 5.0), (D(2024, 4, 2), 1.0), (D(2025, 1, 1), 9.0)]
    df = spark.createDataFrame(rows, "day date, v double")
    filled = calendar.calendar_fill(df, "day", ["v"], "2024-04-01", "2024-04-30", "W").collect()
    assert sum(r.v for r in filled) == 1.0 and len(filled) == 5


def test_normalize_dmy_date(spark):
    raw = ["1/2/24", "01/02/024", "1/12/2024", "31/2/2024", "2024-01-02", "1/2", "1/2/3/4", "",
           "100/2/24", "//24", None]
    assert apply(spark, raw, cleaning.normalize_dmy_date("c")) == [
        "01/02/2024", "01/02/2024", "01/12/2024", "31/02/2024", "2024-01-02", "1/2", "1/2/3/4", "",
        "100/02/2024", "00/00/2024", None
    ]


def test_parse_date(spark):
    raw = ["01/02/2024", "29/02/2024", "31/02/2024", "text", "01-02-2024", None]
    assert apply(spark, raw, cleaning.parse_date_or_null("c", "dd/MM/yyyy")) == [
        D(2024, 2, 1), D(2024, 2, 29), None, None, None, None
    ]
    # a dash pattern on slash dates gives nothing
    assert apply(spark, raw[:2], cleaning.reformat_date("c", "dd-MM-yyyy")) == [None, None]
    assert apply(spark, raw[:1], cleaning.reformat_date("c", "dd/MM/yyyy")) == ["01-02-2024"]


def test_normalize_item_code(spark):
    raw = ["0012", " 12 ", "+7", "-007", "-0", "12.0", "12.5", "A-1", "", "-12.00", None,
           "9" * 45, "000"]
    assert apply(spark, raw, cleaning.normalize_item_code(F.col("c"))) == [
        "12", "12", "7", "-7", "0", "12", "12.5", "A-1", "", "-12", "nan", "9" * 45, "0"
    ]
    numbers = [12.0, 12.9, -12.9, None, float("nan")]
    assert apply(
        spark, numbers, cleaning.normalize_item_code(F.col("c"), T.DoubleType()), "double"
    ) == ["12", "12", "-12", "nan", "nan"]


def test_amounts_and_tokens(spark):
    raw = ["₪1,234.50", "12%", "-3", "x", "", None]
    assert apply(spark, raw, cleaning.clean_amount("c")) == [1234.5, 12.0, -3.0, None, None, None]
    df = spark.createDataFrame([("None", 1, "x1"), ("a", 2, "3.5")], "a string, b int, c string")
    assert [tuple(r) for r in cleaning.normalize_null_tokens(df).collect()] == [
        (None, 1, "x1"), ("a", 2, "3.5")
    ]
    assert [tuple(r) for r in cleaning.coerce_numeric(df, ["c"]).collect()] == [
        ("None", 1, None), ("a", 2, 3.5)
    ]


def test_text_classes(spark):
    words = schemas.MATERIAL_WORDS
    texts = ["כיסא עור", "בד כחול", "עור בד", "עץ", None]
    assert apply(spark, texts, classify.two_word_class(F.col("c"), words)) == [
        "only_leather", "only_fabric", "leather_and_fabric", "neither_leather_nor_fabric",
        "neither_leather_nor_fabric",
    ]
    color = classify.single_word_class(
        F.col("c"), schemas.COLOR_WORDS, schemas.MANY_COLORS, schemas.NO_COLOR
    )
    texts = ["כחול", "חום אדום", "שחור", "עץ", None, "אפור"]
    assert apply(spark, texts, color) == [
        "blue", "more than 1 color", "black", "other", "other", "gray"
    ]
