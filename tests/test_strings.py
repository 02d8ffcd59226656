import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import numeric, strings


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_strings(spark):
    lit = F.lit
    assert one(spark, strings.padded_id(lit(" 320193"))) == "0000320193" and one(spark, strings.padded_id(lit("12345678901"))) == "12345678901"
    assert one(spark, strings.slug(lit(" A/B  c! "))) == "A_B_c" and one(spark, strings.slug(lit("!!"))) == ""
    assert one(spark, strings.url_part(lit("a b+c,é"))) == "a%20b%2Bc%2C%C3%A9"
    assert one(spark, strings.has_code(lit("2.02, 9.01"), "9.01")) and not one(spark, strings.has_code(lit("12.02"), "2.02")) and not one(spark, strings.has_code(lit(None).cast("string"), "2.02"))
    d = lit(dt.date(2024, 2, 29))
    assert one(spark, strings.quarter_label(d)) == "Q1'24" and one(spark, strings.years_on(d, -1)) == dt.date(2023, 2, 28)
    assert one(spark, strings.day_millis(lit(dt.date(2025, 1, 1)))) == 1735689600000
    assert [one(spark, strings.axis_kind(lit(x))) for x in ("2024-01-01T00", "Q1", "2024-13-01")] == ["datetime", "category", "category"]
    assert one(spark, strings.version_key(lit("v1.10.2-rc"))) == [1, 10, 2]
    assert [one(spark, strings.money(lit(float(x)))) for x in (1234567890, -2500000, 56)] == ["$1.2B", "-$2.5M", "$56"]
    y = [one(spark, strings.fiscal_year(lit(dt.date(*x)), e)) for x, e in (((2023, 9, 30), "0930"), ((2023, 10, 1), "0930"), ((2023, 2, 28), "0229"), ((2024, 2, 29), "0229"), ((2023, 3, 1), "0229"))]
    assert y == [2023, 2024, 2023, 2024, 2024]


def test_numbers(spark):
    lit = F.lit
    assert one(spark, numeric.ratio(lit(1), lit(0))) is None and one(spark, numeric.zero_ratio(lit(1), lit(0))) == 0.0 and one(spark, numeric.zero_ratio(lit(None).cast("double"), lit(2))) == 0.0
    assert one(spark, numeric.cagr(lit(-1.0), lit(2.0), lit(1))) is None and round(one(spark, numeric.cagr(lit(100.0), lit(121.0), lit(2))), 6) == 10.0
    assert one(spark, numeric.growth(lit(-5.0), lit(-10.0))) == 50.0 and one(spark, numeric.scale_of(lit(-2.5e6))) == 1e6
