"""Item codes of many parts, and texts that are no numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions import cleaning
from shelfcast.operators.ingest import conform_to
from shelfcast.plans import tables

NO_NUMBERS = [*tables.NO_NUMBERS, "-inf", "1e999", "", ".", "1,5", "1 2", "--1", "1e", "0b1", "NaN"]
NUMBERS = {"12": 12.0, " -1.5 ": -1.5, "+.5": 0.5, "1.": 1.0, "1e3": 1000.0, "007": 7.0}


def parts(spark, keys):
    return keys.select(F.col("id").alias("p_partkey"), F.lit("Brand#7").alias("p_brand"))


def test_a_code_for_every_part(spark):
    codes = parts(spark, spark.range(300_000)).select(tables.item_code().alias("item"))
    row = codes.agg(F.count_distinct("item"), F.min(F.length("item")), F.max(F.length("item"))).first()
    assert tuple(row) == (300_000, 8, 8)


def test_codes_of_very_large_numbers(spark):
    keys = spark.createDataFrame([(62**6 - 1,), (62**5,), (63,)], "id long")
    assert [r[0] for r in parts(spark, keys).select(tables.item_code()).collect()] == ["07zzzzzz", "07100000", "07001001"]


@pytest.mark.parametrize("key", [62**6, -1])
def test_a_part_without_a_code_is_an_error(spark, key):
    with pytest.raises(Exception, match="no item code for part"):
        parts(spark, spark.createDataFrame([(key,)], "id long")).select(tables.item_code()).collect()


def test_only_decimal_numbers_are_numbers(spark):
    df = spark.createDataFrame([(t,) for t in [*NO_NUMBERS, *NUMBERS]], "v string")
    wanted = [None] * len(NO_NUMBERS) + list(NUMBERS.values())
    assert [r.v for r in cleaning.coerce_numeric(df, ["v"]).collect()] == wanted
    schema = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("w", T.DoubleType())])
    assert [tuple(r) for r in conform_to(df, schema).collect()] == [(v, None) for v in wanted]
    amounts = spark.createDataFrame([("\u20aa1,250.5",), ("nan%",), ("7%",), ("0x1p3",)], "v string")
    assert [r[0] for r in amounts.select(cleaning.clean_amount("v")).collect()] == [1250.5, None, 7.0, None]


def test_large_numbers_as_item_codes(spark):
    values = [1e20, -1e20, 2.0**63, 12.9, -12.9, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(cleaning.normalize_item_code(F.col("v"), T.DoubleType())).collect()]
    assert found == [
        "100000000000000000000", "-100000000000000000000", "9223372036854776000", "12", "-12", "Infinity", "nan", "nan",
    ]
