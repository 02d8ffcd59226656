"""Bars and window functions over them. All work per entity: the partition key is part of every call.

A window over n rows is null until n rows exist. Rows of an entity are ordered by time; callers pass bars with one row
per entity and time (see bars()).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def clean_bars(df: DataFrame, *, symbol: str, day: str, arrival: str, adjusted: str | None = None) -> DataFrame:
    """Bars with close and day present, the last arrival of each (symbol, day), missing or zero open, high and low set
    to close, and, with an adjusted close, all prices scaled to it."""
    kept = df.where(F.col("close").isNotNull() & F.col(day).isNotNull())
    cols = [c for c in kept.columns if c not in (symbol, day)]
    last = kept.groupBy(symbol, day).agg(F.max_by(F.struct(*cols), F.col(arrival)).alias("r")).select(symbol, day, "r.*")
    k = F.coalesce(F.try_divide(F.col(adjusted), F.nullif(F.col("close"), F.lit(0.0))), F.lit(1.0)) if adjusted else F.lit(1.0)
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col("close")) * k for c in ("open", "high", "low")}
    return last.withColumns({**fill, "close": F.col("close") * k, "volume": F.coalesce(F.col("volume"), F.lit(0.0))})


def bars(df: DataFrame, *, symbol: str, time: str, price: str, order: str, unit: str = "day", volume: Column | None = None) -> DataFrame:
    """(symbol, day, open, high, low, close, volume) of each symbol and calendar unit: day, week (Monday), month.

    open and close are the first and last price by order. One aggregation with partial sums, no sort.
    """
    day = F.date_trunc(unit, time).cast("date")
    seq = F.struct(F.col(order), F.col(price))
    return df.where(F.col(price).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(symbol).alias("symbol"), day.alias("day")).agg(
        F.min(seq)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(seq)[price].alias("close"), (F.sum(volume) if volume is not None else F.count("*")).cast("double").alias("volume")
    )


def resample(b: DataFrame, unit: str, symbol: str = "symbol", day: str = "day") -> DataFrame:
    """Daily bars as weekly or monthly ones; last_day is the last day with a bar."""
    return b.groupBy(symbol, F.date_trunc(unit, day).cast("date").alias(day)).agg(
        F.min_by("open", day).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", day).alias("close"), F.sum("volume").alias("volume"), F.max(day).alias("last_day")
    )


def ordered(symbol: str = "symbol", day: str = "day") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(day)


def gated(value: Column, n: int, w: WindowSpec) -> Column:
    """value once n rows exist, else null."""
    return F.when(F.row_number().over(w) >= n, value)


def last_n(n: int, w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def sma(c: Column, n: int, w: WindowSpec) -> Column:
    return gated(F.avg(c).over(last_n(n, w)), n, w)


def rolling(f, c: Column, n: int, w: WindowSpec) -> Column:
    """f (max, min, stddev_pop ...) over the last n rows, the current one included."""
    return gated(f(c).over(last_n(n, w)), n, w)


def bollinger(b: DataFrame, w: WindowSpec, n: int = 20, k: float = 2.0, close: str = "close") -> DataFrame:
    """bb_mid, bb_up, bb_lo, bb_width (null if the middle is zero) and bb_pct (null if the band is flat)."""
    mid, sd = sma(F.col(close), n, w), rolling(F.stddev_pop, F.col(close), n, w)
    d = b.withColumns({"bb_mid": mid, "__sd": sd}).withColumns({"bb_up": F.col("bb_mid") + k * F.col("__sd"), "bb_lo": F.col("bb_mid") - k * F.col("__sd")})
    width = F.try_divide(F.col("bb_up") - F.col("bb_lo"), F.nullif(F.col("bb_mid"), F.lit(0.0)))
    return d.withColumns({"bb_width": width, "bb_pct": F.try_divide(F.col(close) - F.col("bb_lo"), F.nullif(F.col("bb_up") - F.col("bb_lo"), F.lit(0.0)))}).drop("__sd")


def donchian(b: DataFrame, w: WindowSpec, n: int = 20) -> DataFrame:
    """don_hi and don_lo of the n bars before the current one."""
    before = w.rowsBetween(-n, -1)
    full = F.row_number().over(w) > n
    return b.withColumns({"don_hi": F.when(full, F.max("high").over(before)), "don_lo": F.when(full, F.min("low").over(before))})


def true_range(w: WindowSpec) -> Column:
    pc = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def with_obv(b: DataFrame, w: WindowSpec) -> DataFrame:
    """obv: volume added on rises and taken away on falls of the close, from 0."""
    step = F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")
    stepped = b.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("obv", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def pivots(b: DataFrame, w: WindowSpec, span: int = 2) -> DataFrame:
    """pivot_low and pivot_high: whether a bar is the extreme among span bars on each side (ties allowed)."""
    sides = [F.lag, F.lead]
    low = [F.col("low") <= f("low", i).over(w) for f in sides for i in range(1, span + 1)]
    high = [F.col("high") >= f("high", i).over(w) for f in sides for i in range(1, span + 1)]
    every = lambda xs: F.coalesce(reduce(and_, xs), F.lit(False))
    return b.withColumns({"pivot_low": every(low), "pivot_high": every(high)})


def lagged_growth(c: Column, w: WindowSpec, lag: int = 1) -> Column:
    """Percent change against lag rows before, by that row's absolute value; null if it's zero or missing."""
    then = F.lag(c, lag).over(w)
    return F.try_divide(c - then, F.nullif(F.abs(then), F.lit(0.0))) * 100


def rebase(c: Column, w: WindowSpec, base: float = 100.0) -> Column:
    """c relative to its entity's first value that is neither null nor zero, times base."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.try_divide(c, F.first(F.nullif(c, F.lit(0.0)), ignorenulls=True).over(whole)) * base


def shifted(c: Column, w: WindowSpec, k: int) -> Column:
    """c of k rows before (k > 0) or after (k < 0)."""
    return F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w)


def tail(df: DataFrame, n: int, *, by: str, order: str) -> DataFrame:
    """The last n rows of each entity by order; nulls in order count as oldest."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def trim_leading(df: DataFrame, metrics: list[str], w: WindowSpec) -> DataFrame:
    """Without the rows of an entity before any of the metrics is known."""
    known = F.coalesce(*[F.col(m).cast("double") for m in metrics]).isNotNull().cast("int")
    return df.withColumn("__k", F.max(known).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__k = 1").drop("__k")


def reversed_(by: list[str], order: list[str]) -> WindowSpec:
    """The rows behind a row, nearest last: a frame that begins with the partition grows by a row at each step, while
    one that ends with it is computed anew for every row."""
    return Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])


def fill(c: Column, by: list[str], order: list[str], forward: bool = True) -> Column:
    """The last known value up to the row in this order, or the next one from it on."""
    w = Window.partitionBy(*by).orderBy(*order) if forward else reversed_(by, order)
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def trailing_sum(c: Column, w: WindowSpec, n: int = 4) -> Column:
    """Sum of the last n rows, null until n of them are known."""
    return F.when(F.count(c).over(last_n(n, w)) == n, F.sum(c).over(last_n(n, w)))


def volume_spike(w: WindowSpec, n: int = 20) -> Column:
    """Volume against the mean of the last n bars."""
    return F.try_divide(F.col("volume"), F.nullif(sma(F.col("volume"), n, w), F.lit(0.0)))


def year_range(b: DataFrame, symbol: str = "symbol", day: str = "day") -> DataFrame:
    """hi_52w and lo_52w: extremes of the 365 days that end with the bar's."""
    w = Window.partitionBy(symbol).orderBy(F.unix_date(day)).rangeBetween(-364, 0)
    return b.withColumns({"hi_52w": F.max("high").over(w), "lo_52w": F.min("low").over(w)})


def sigma_flags(b: DataFrame, column: str, w: WindowSpec, n: int = 20, k: float = 3.0) -> DataFrame:
    """b with z, the deviation from the mean of the n rows before in their sample deviations, and flag, whether it
    exceeds k; both null (false) until n rows stand before, or where they are all alike."""
    before = w.rowsBetween(-n, -1)
    z = F.when(F.count(column).over(before) == n, F.try_divide(F.col(column) - F.avg(column).over(before), F.nullif(F.stddev_samp(column).over(before), F.lit(0.0))))
    return b.withColumn("z", z).withColumn("flag", F.coalesce(F.col("z") > k, F.lit(False)))
