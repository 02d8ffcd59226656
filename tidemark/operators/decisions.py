"""What a bar table says at its last row: regime, votes, signals and levels, for all symbols at once.

Input is a table with the columns of series and recursive operators (see plans.market.full_table); each result has one
row per symbol, or per symbol and signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


def _last(df: DataFrame) -> DataFrame:
    back = Window.partitionBy("symbol").orderBy(F.col("day").desc())
    return df.withColumn("__n", F.row_number().over(back)).where("__n = 1").drop("__n")


def regime(t: DataFrame) -> DataFrame:
    """(symbol, day, label, slope, squeeze): trend by the strength of the directional index and the long average.

    squeeze: the band width is among the narrowest tenth of the last 120 bars.
    """
    w, back = _w(), Window.partitionBy("symbol").orderBy(F.col("day").desc())
    # Only the last bar is judged, so the widths are gathered once a symbol, from its last 120 bars.
    recent = t.withColumns({"__n": F.row_number().over(back), "__ml20": F.lag("sma_long", 20).over(w)}).where("__n <= 120")
    widths = recent.groupBy("symbol").agg(F.array_sort(F.collect_list("bb_width")).alias("__w"))
    d = recent.where("__n = 1").join(widths, "symbol")
    place = F.greatest(F.floor(F.size("__w") / 10), F.lit(1)).cast("int")
    label = F.when(F.col("adx14").isNull() | F.col("sma_long").isNull(), "unknown").when(F.col("adx14") >= 25, F.when(F.col("close") > F.col("sma_long"), "trending-up").otherwise("trending-down")).when(F.col("adx14") < 20, "range").otherwise("transitional")
    slope = F.when(F.col("__ml20").isNotNull() & F.col("sma_long").isNotNull(), F.when(F.col("sma_long") > F.col("__ml20"), "up").otherwise("down"))
    return d.select("symbol", "day", label.alias("label"), slope.alias("slope"), F.coalesce(F.col("bb_width") <= F.try_element_at("__w", place), F.lit(False)).alias("squeeze"))


def _vote(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def votes(t: DataFrame) -> DataFrame:
    """(symbol, day, v_ma, v_macd, v_rsi, v_volume, score): four votes of 1, 0 or -1 and their sum."""
    w = _w()
    last20 = w.rowsBetween(-19, 0)
    change = F.col("close") - F.lag("close").over(w)
    d = t.withColumns({"__up": F.when(change >= 0, F.col("volume")), "__dn": F.when(change < 0, F.col("volume")), "__h1": F.lag("macd_hist", 1).over(w), "__h2": F.lag("macd_hist", 2).over(w)})
    d = _last(d.withColumns({"__mu": F.avg("__up").over(last20), "__md": F.avg("__dn").over(last20)}))
    h, h1, h2 = F.col("macd_hist"), F.col("__h1"), F.col("__h2")
    v = {
        "v_ma": _vote(F.col("close") > F.col("sma_long"), F.col("close") < F.col("sma_long")), "v_macd": _vote((h > h1) & (h1 > h2), (h < h1) & (h1 < h2)), "v_rsi": _vote(F.col("rsi14") > 50, F.col("rsi14") < 50),
        "v_volume": _vote(F.col("__mu") > F.col("__md") * 1.1, F.col("__md") > F.col("__mu") * 1.1),
    }
    return d.select("symbol", "day", *[c.alias(n) for n, c in v.items()], sum(v.values(), F.lit(0)).alias("score"))


def signals(t: DataFrame, lookback: int = 3) -> DataFrame:
    """(symbol, signal, direction, bars_ago): rules that held in the last lookback bars, each at its latest bar."""
    w = _w()
    before = lambda c: F.lag(c).over(w)
    c, pc = F.col("close"), before("close")
    cross = lambda a, b: (F.col(a) - F.col(b)) * (before(a) - before(b)) < 0
    side = lambda a, b: F.when(F.col(a) > F.col(b), "long").otherwise("short")
    rules = {
        "channel breakout": (c > F.col("don_hi"), F.lit("long")), "channel breakdown": (c < F.col("don_lo"), F.lit("short")), "dip above long average": ((F.col("rsi2") < 10) & (c > F.col("sma_long")), F.lit("long")),
        "supertrend flip": (F.col("supertrend_dir") != before("supertrend_dir"), F.when(F.col("supertrend_dir") == 1, "long").otherwise("short")), "macd cross": (cross("macd", "macd_signal"), side("macd", "macd_signal")),
        "average cross": (cross("sma50", "sma_long"), side("sma50", "sma_long")), "lower band re-entry": ((pc < before("bb_lo")) & (c > F.col("bb_lo")), F.lit("long")), "upper band re-entry": ((pc > before("bb_up")) & (c < F.col("bb_up")), F.lit("short")),
    }
    # The direction of a cross is the side at the last bar, not at the bar of the cross.
    fired = t.withColumn("__hits", F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(r, F.lit(False)).alias("hit"), d.alias("direction")) for n, (r, d) in rules.items()]))
    back = Window.partitionBy("symbol").orderBy(F.col("day").desc())
    recent = fired.withColumn("bars_ago", F.row_number().over(back) - 1).where(F.col("bars_ago") < lookback)
    rows = recent.select("symbol", "bars_ago", "rsi14", F.explode("__hits").alias("h"))
    hits = rows.groupBy("symbol", "h.signal").agg(F.min(F.when(F.col("h.hit"), F.col("bars_ago"))).alias("bars_ago"), F.max_by("h.direction", -F.col("bars_ago")).alias("direction")).where("bars_ago is not null").select("symbol", "signal", "direction", "bars_ago")
    context = recent.where("bars_ago = 0 and (rsi14 >= 70 or rsi14 <= 30)").select("symbol", F.when(F.col("rsi14") >= 70, "overbought").otherwise("oversold").alias("signal"), F.lit("context").alias("direction"), F.lit(0).alias("bars_ago"))
    return hits.unionByName(context)


def levels(t: DataFrame, risk_pct: float = 1.0, capital: float | None = None) -> DataFrame:
    """(symbol, side, entry, stop, distance, target2, target3, trail, shares): stops at the last confirmed pivot if it
    lies within 3.5 average ranges, else 2.5 ranges away; targets at two and three times the distance."""
    from tidemark.operators.series import pivots

    w = _w()
    p = pivots(t, w)
    whole = p.groupBy("symbol").agg(F.max_by("low", F.when(F.col("pivot_low"), F.col("day"))).alias("swing_lo"), F.max_by("high", F.when(F.col("pivot_high"), F.col("day"))).alias("swing_hi"))
    d = _last(t).join(whole, "symbol")
    d = d.select("*", F.explode(F.array(F.struct(F.lit("long").alias("side"), F.lit(1).alias("s"), F.col("swing_lo").alias("swing")), F.struct(F.lit("short").alias("side"), F.lit(-1).alias("s"), F.col("swing_hi").alias("swing")))).alias("x"))
    c, a, s = F.col("close"), F.col("atr14"), F.col("x.s")
    stop = F.when(F.abs(c - F.col("x.swing")) <= 3.5 * a, F.col("x.swing")).otherwise(c - s * 2.5 * a)
    d = d.withColumn("stop", stop).withColumn("distance", F.abs(c - F.col("stop"))).where("atr14 is not null")
    shares = F.floor(F.lit(capital * risk_pct / 100) / F.nullif(F.col("distance"), F.lit(0.0))) if capital else F.lit(None).cast("bigint")
    trail = F.when(F.col("supertrend_dir") == s, F.col("supertrend"))
    return d.select("symbol", F.col("x.side").alias("side"), c.alias("entry"), "stop", "distance", (c + s * 2 * F.col("distance")).alias("target2"), (c + s * 3 * F.col("distance")).alias("target3"), trail.alias("trail"), shares.alias("shares"))


def snapshot(t: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The last n bars of each symbol with these columns and bars_ago."""
    back = Window.partitionBy("symbol").orderBy(F.col("day").desc())
    return t.withColumn("bars_ago", F.row_number().over(back) - 1).where(F.col("bars_ago") < n).select("symbol", "day", "bars_ago", *columns)
