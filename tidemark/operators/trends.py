"""Search-interest series: calendars, complete weeks, rescaling of overlapping windows, quarters and nowcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sunday_week(c: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(c, F.dayofweek(c) - 1)


def fiscal_quarter(c: Column, year_end_month: int) -> Column:
    """Label such as FY2027Q1 of the fiscal quarter that ends in c's month, for a fiscal year that ends in the given month."""
    start = year_end_month % 12
    q = F.floor(F.pmod(F.month(c) - start - 1, F.lit(12)) / 3) + 1
    fy = F.year(c) + F.when(F.month(c) > year_end_month, 1).otherwise(0)
    return F.concat(F.lit("FY"), fy.cast("string"), F.lit("Q"), q.cast("string"))


def fiscal_calendar(df: DataFrame, *, start: str, end: str, year_end_month: int) -> DataFrame:
    """df with one row per fiscal quarter that ends in [start, end]: quarter_start, quarter_end, fiscal_quarter.

    Quarters end with months. The first quarter has a start too, since months fix it.
    """
    ends = F.filter(F.transform(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")), F.last_day), lambda d: (F.pmod(F.month(d) - year_end_month, F.lit(3)) == 0) & d.between(F.col(start), F.col(end)))
    d = df.where(F.col(start) <= F.col(end)).withColumn("quarter_end", F.explode(ends))
    return d.withColumn("quarter_start", F.add_months(F.date_add("quarter_end", 1), -3)).withColumn("fiscal_quarter", fiscal_quarter(F.col("quarter_end"), year_end_month))


def windows(df: DataFrame, *, start: str, end: str, most_days: int = 224, overlap_days: int = 21) -> DataFrame:
    """df with window_no, window_start and window_end: [start, end] in windows of most_days that overlap by overlap_days."""
    step = most_days - overlap_days
    starts = F.sequence(F.col(start), F.col(end), F.expr(f"interval {step} days"))
    d = df.where(F.col(start) <= F.col(end)).select("*", F.posexplode(starts).alias("window_no", "window_start"))
    d = d.withColumn("window_end", F.least(F.date_add("window_start", most_days - 1), F.col(end)))
    # A window is the last if the one before already reached the end.
    return d.where((F.col("window_no") == 0) | (F.date_add("window_start", most_days - 1 - step) < F.col(end)))


def complete_weeks(daily: DataFrame, *, keys: list[str], day: str, value: str, partial: str | None = None) -> DataFrame:
    """(keys, week, value): sums of Sunday weeks with all seven days confirmed."""
    d = daily.where(~F.coalesce(F.col(partial), F.lit(False))) if partial else daily
    return d.groupBy(*keys, sunday_week(F.col(day)).alias("week")).agg(F.sum(value).alias("value"), F.count_distinct(day).alias("n")).where("n = 7").drop("n")


def overlap_factors(spine: DataFrame, window_daily: DataFrame, *, keys: list[str], window: str, day: str, value: str, partial: str) -> DataFrame:
    """(keys, window, factor, overlap_weeks): mean of the spine over mean of the window in the weeks both have.

    spine has keys, week and value. Windows without a common week, or with a mean of zero, give no row.
    """
    weekly = complete_weeks(window_daily, keys=[*keys, window], day=day, value=value, partial=partial)
    both = weekly.join(spine.select(*keys, "week", F.col("value").alias("s")), [*keys, "week"])
    return both.groupBy(*keys, window).agg(F.try_divide(F.avg("s"), F.nullif(F.avg("value"), F.lit(0.0))).alias("factor"), F.count("*").alias("overlap_weeks")).where("factor is not null")


def stitch(spine: DataFrame, window_daily: DataFrame, *, keys: list[str], window: str, day: str, value: str, partial: str) -> DataFrame:
    """One daily series per key: every window scaled onto the spine, of overlapping windows the later one."""
    f = overlap_factors(spine, window_daily, keys=keys, window=window, day=day, value=value, partial=partial)
    scaled = window_daily.join(f, [*keys, window]).withColumn("scaled", F.col(value) * F.col("factor"))
    return scaled.groupBy(*keys, day).agg(F.max_by(F.struct("scaled", partial, "overlap_weeks"), window).alias("r")).select(*keys, day, F.col("r.scaled").alias("value"), F.col(f"r.{partial}").alias(partial), F.col("r.overlap_weeks").alias("overlap_weeks"))


def quarter_sums(daily: DataFrame, year_end_month: int, *, keys: list[str], day: str, value: str, partial: str, today: str) -> DataFrame:
    """(keys, quarter_end, fiscal_quarter, index, n_confirmed, is_partial): sums of confirmed days by fiscal quarter.

    The quarter of a day follows from its month, so no join with a calendar is needed.
    """
    ahead = F.pmod(F.lit(year_end_month) - F.month(day), F.lit(3)).cast("int")
    end = F.last_day(F.add_months(F.col(day), ahead))
    ok = ~F.coalesce(F.col(partial), F.lit(False))
    g = daily.groupBy(*keys, end.alias("quarter_end")).agg(F.coalesce(F.sum(F.when(ok, F.col(value))), F.lit(0.0)).alias("index"), F.count(F.when(ok, 1)).alias("n_confirmed"), F.bool_or(~ok).alias("any_partial"))
    t = F.lit(today).cast("date")
    current = (t <= F.col("quarter_end")) & (t > F.last_day(F.add_months("quarter_end", -3)))
    return g.select(*keys, "quarter_end", fiscal_quarter(F.col("quarter_end"), year_end_month).alias("fiscal_quarter"), "index", "n_confirmed", (F.col("any_partial") | current).alias("is_partial"))


def quarter_to_date(daily: DataFrame, year_end_month: int, *, keys: list[str], day: str, value: str, partial: str, today: str, years: int) -> DataFrame:
    """(keys, years_back, qtd, full_quarter, fraction, yoy): the current quarter so far against the same days of the
    quarters of earlier years; years without all those days are left out."""
    t = F.lit(today).cast("date")
    ahead = F.pmod(F.lit(year_end_month) - F.month(t), F.lit(3)).cast("int")
    qend = F.last_day(F.add_months(t, ahead))
    qstart = F.date_add(F.last_day(F.add_months(qend, -3)), 1)
    ok = daily.where(~F.coalesce(F.col(partial), F.lit(False))).select(*keys, F.col(day).alias("d"), F.col(value).alias("v"))
    now = ok.where((F.col("d") >= qstart) & (F.col("d") <= t)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("cur"))
    backs = F.explode(F.sequence(F.lit(1), F.lit(years)))
    per = now.select("*", backs.alias("years_back")).withColumns({"s": F.add_months(qstart, -12 * F.col("years_back")), "e": F.last_day(F.add_months(qend, -12 * F.col("years_back")))})
    near = ok.withColumn("years_back", F.explode(F.sequence(F.lit(1), F.lit(years)))).withColumns({"s": F.add_months(qstart, -12 * F.col("years_back")), "e": F.last_day(F.add_months(qend, -12 * F.col("years_back")))}).where(F.col("d").between(F.col("s"), F.col("e")))
    j = near.join(per.drop("s", "e"), [*keys, "years_back"])
    inside = F.datediff("d", "s") < F.col("n")
    g = j.groupBy(*keys, "years_back").agg(F.sum(F.when(inside, F.col("v"))).alias("qtd"), F.count(F.when(inside, 1)).alias("m"), F.max("n").alias("n"), F.max("cur").alias("cur"), F.sum("v").alias("full_quarter")).where("m = n")
    return g.select(*keys, "years_back", "qtd", "full_quarter", F.try_divide("qtd", F.nullif("full_quarter", F.lit(0.0))).alias("fraction"), F.try_divide("cur", F.nullif("qtd", F.lit(0.0))).alias("yoy"))


def granularity(df: DataFrame, *, keys: list[str], time: str) -> DataFrame:
    """(keys, gap_seconds, granularity): the least positive gap between buckets, as hourly, daily, weekly or monthly."""
    w = Window.partitionBy(*keys).orderBy(time)
    gap = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lag(time).over(w).cast("timestamp"))
    g = df.where(F.col(time).isNotNull()).withColumn("__g", gap).where("__g > 0").groupBy(*keys).agg(F.min("__g").alias("gap_seconds"))
    h = F.col("gap_seconds") / 3600
    return g.withColumn("granularity", F.when(h < 20, "hourly").when(h < 24 * 5, "daily").when(h < 24 * 20, "weekly").otherwise("monthly"))


def apportion(weekly: DataFrame, *, week: str, value: str) -> DataFrame:
    """Weekly values spread evenly over the seven days from week: day and day_value behind the other columns."""
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(F.col(week), i))
    return weekly.select("*", F.explode(days).alias("day")).withColumn("day_value", F.col(value) / 7)


def rebinned(monthly: DataFrame, year_end_month: int, *, keys: list[str], month: str, value: str) -> DataFrame:
    """(keys, quarter_end, fiscal_quarter, value, n_months): monthly values (one row a month) added up by fiscal quarter.

    Months are taken whole, nothing is interpolated; n_months tells how many a quarter has.
    """
    ahead = F.pmod(F.lit(year_end_month) - F.month(month), F.lit(3)).cast("int")
    end = F.last_day(F.add_months(F.trunc(month, "month"), ahead))
    g = monthly.groupBy(*keys, end.alias("quarter_end")).agg(F.sum(value).alias("value"), F.count("*").alias("n_months"))
    return g.withColumn("fiscal_quarter", fiscal_quarter(F.col("quarter_end"), year_end_month))


def required_granularity(df: DataFrame, expected: str, *, keys: list[str], time: str) -> DataFrame:
    """df, but a key whose buckets have another granularity than expected fails the query with its name; keys of a single
    bucket pass."""
    g = granularity(df, keys=keys, time=time)
    told = F.concat(F.lit(f"expected {expected} buckets, found "), F.col("granularity"), F.lit(" for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    bad = g.where(F.col("granularity") != expected).select(*[F.col(k).alias(f"__{k}") for k in keys], told.alias("__told"))
    d = df.join(bad, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    ok = F.when(F.col("__told").isNull(), True).otherwise(F.raise_error(F.col("__told")).cast("boolean"))
    return d.where(ok).select(*df.columns)


def prior_quarter_end(c: Column, year_end_month: int) -> Column:
    """The last day of the fiscal quarter before the one a date lies in."""
    ahead = F.pmod(F.lit(year_end_month) - F.month(c), F.lit(3)).cast("int")
    return F.last_day(F.add_months(F.trunc(c, "month"), ahead - 3))


def decomposed(df: DataFrame, *, keys: list[str], order: str, value: str, period: int) -> DataFrame:
    """df with trend (the mean of a whole period around the row, null at the ends), seasonal (the mean deviation of the
    rows at the same place of the period, made to sum to zero) and rest. Rows of a key follow each other without gaps."""
    w = Window.partitionBy(*keys).orderBy(order)
    half = period // 2
    around = w.rowsBetween(-half, half)
    # With an even period the two ends count half.
    ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    total = F.sum(value).over(around) if period % 2 else F.sum(value).over(w.rowsBetween(-half + 1, half - 1)) + ends
    d = df.withColumn("__i", F.row_number().over(w)).withColumn("trend", F.when(F.count(value).over(around) == 2 * half + 1, total / period)).withColumn("__p", F.col("__i") % period)
    s = d.where("trend is not null").groupBy(*keys, "__p").agg(F.avg(F.col(value) - F.col("trend")).alias("__s"))
    m = s.groupBy(*keys).agg(F.avg("__s").alias("__m"))
    s = s.join(m, keys).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), (F.col("__s") - F.col("__m")).alias("seasonal"))
    met = d.join(s, [*[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__p") == F.col("__q")], "left")
    return met.select(*df.columns, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("rest"))
