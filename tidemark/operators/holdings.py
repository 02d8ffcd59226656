"""Holdings reports: unit detection and roll-up by issuer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report whose median value a share is below this states its values in thousands.
THOUSANDS_BELOW = 5.0


def in_thousands(lines: DataFrame, filing: str) -> DataFrame:
    """(filing, median_price, thousands) from plain share lines with shares; filings without any count as whole units."""
    plain = (F.col("shtype") == "SH") & F.col("putcall").isNull() & (F.col("shares") > 0)
    price = F.when(plain, F.col("value") / F.col("shares"))
    return lines.groupBy(filing).agg(F.percentile(price, 0.5).alias("median_price")).withColumn("thousands", F.coalesce(F.col("median_price") < THOUSANDS_BELOW, F.lit(False)))


def roll_up(lines: DataFrame, filing: str) -> DataFrame:
    """(filing, cusip6, issuer, cusip, value_usd, shares, derivative, pct): positions by issuer.

    Options count towards value but not shares; derivative lists their kinds. The name is the most frequent, of
    equals the one met first; cusip is that of the last line. pct is of the filing's total (a zero total counts as 1).
    """
    unit = in_thousands(lines, filing).select(filing, F.when(F.col("thousands"), 1000).otherwise(1).alias("k"))
    d = lines.join(unit, filing).withColumn("cusip6", F.substring("cusip", 1, 6))
    names = d.groupBy(filing, "cusip6", "issuer").agg(F.count("*").alias("c"), F.min("line_no").alias("l")).groupBy(filing, "cusip6").agg(F.min_by("issuer", F.struct(-F.col("c"), F.col("l"))).alias("issuer"))
    plain = F.col("putcall").isNull()
    g = d.groupBy(filing, "cusip6").agg(F.max_by("cusip", "line_no").alias("cusip"), F.sum(F.col("value") * F.col("k")).alias("value_usd"), F.coalesce(F.sum(F.when(plain, F.col("shares"))), F.lit(0)).alias("shares"), F.array_join(F.array_sort(F.collect_set("putcall")), "/").alias("derivative"))
    # The total is an aggregate of the roll-up, not a window over a filing.
    total = g.groupBy(filing).agg(F.sum("value_usd").alias("t"))
    out = g.join(names, [filing, "cusip6"]).join(total, filing)
    return out.select(filing, "cusip6", "issuer", "cusip", "value_usd", "shares", "derivative", (100.0 * F.col("value_usd") / F.coalesce(F.nullif("t", F.lit(0)), F.lit(1))).alias("pct"))
