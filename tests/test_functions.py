"""Scalars on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallybook.functions import dates, fuzzy, money, text


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_strict_money(spark):
    cases = {"2.49": 249, "-6.00": -600, "12": 1200, "3.": 300, ".5": 50, "12x.99": None, "": None, "-": None, "1.234": None, "99999999999999999999": None, None: None}
    assert column(spark, list(cases), money.parse_strict) == list(cases.values())


def test_lenient_money(spark):
    cases = {"2.499": 249, "12x.99": 99, "-1.5": -150, "abc": 0, "99999999999999999999.10": 10}
    assert column(spark, list(cases), money.parse_lenient) == list(cases.values())


def test_money_text(spark):
    df = spark.createDataFrame([(1234,), (-5,), (0,)], "x long")
    assert [r[0] for r in df.select(money.text(F.col("x"))).collect()] == ["12.34", "-0.05", "0.00"]
    assert [r[0] for r in df.select(money.from_scaled4(F.col("x") * 10)).collect()] == [123, 0, 0]


def test_dates(spark):
    df = spark.createDataFrame([("02/03/2026",), ("2026-02-18",), ("02/30/2026",), ("26/08/02",)], "t string")
    got = {(r.t, r.kind, r.day) for r in dates.readings(df, "t", 2026).collect()}
    assert ("02/03/2026", "mdy4", datetime.date(2026, 2, 3)) in got and ("02/03/2026", "dmy4", datetime.date(2026, 3, 2)) in got
    assert ("2026-02-18", "ymd4", datetime.date(2026, 2, 18)) in got
    assert not [x for x in got if x[0] == "02/30/2026"]
    assert ("26/08/02", "ymd2", datetime.date(2026, 8, 2)) in got


def test_rows(spark):
    cases = {"": "blank", "CALL 416-555-1234": "phone", "YOU SAVED 1.00": "savings", "SUBTOTAL 4.00": "summary", " 4.99 ": "price", "MILK 4.99": "priced", "AISLE 7": "code", "MILK": "text"}
    assert column(spark, list(cases), text.row_class) == list(cases.values())
    assert column(spark, ["2, 49 x 2. 49"], text.decimal_spacing) == ["2.49 x 2.49"]
    assert column(spark, ["12345 BIG  MILK 4.99 H"], text.clean_description) == ["BIG MILK"]
    assert column(spark, ["A 1.00 B 2.50", "none"], text.last_price) == [250, None]


def test_weighted_distance():
    assert fuzzy.weighted_distance("C0STCO", "COSTCO") == pytest.approx(0.1)
    assert fuzzy.weighted_distance("AB", "") == 2
    cost, start = fuzzy.substring_cost("MILK", "BIG M1LK 2L")
    assert cost == pytest.approx(0.1) and start == 4


def test_bigrams(spark):
    df = spark.createDataFrame([("MILK", "XMILX"), ("A", "A")], "k string, t string")
    assert [round(r[0], 4) for r in df.select(fuzzy.bigram_share(F.col("k"), F.col("t"))).collect()] == [0.6667, 0.0]
