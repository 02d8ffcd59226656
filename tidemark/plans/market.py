"""Queries over bars, series and decisions. Bars are made of orders: the priority class is the symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decisions, recursive, series
from tidemark.sources.tables import table


def daily(spark: SparkSession, folder: str, unit: str = "day") -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return series.bars(o, symbol="o_orderpriority", time="o_orderdate", price="o_totalprice", order="o_orderkey", unit=unit)


def full_table(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with every window and recursive column."""
    w = series.ordered()
    t = series.donchian(series.bollinger(daily(spark, folder), w), w)
    t = t.withColumns({"sma50": series.sma(F.col("close"), 50, w), "sma_long": series.sma(F.col("close"), 200, w)})
    t = series.with_obv(t, w)
    hi, lo = series.rolling(F.max, F.col("close"), 22, w), series.rolling(F.min, F.col("close"), 22, w)
    t = t.withColumns({"__hi": hi, "__lo": lo})
    t = recursive.with_indicators(t)
    return t.withColumns({"ch_long": F.col("__hi") - 3 * F.col("atr14"), "ch_short": F.col("__lo") + 3 * F.col("atr14")}).drop("__hi", "__lo")


def _r(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


def sma_bollinger(spark: SparkSession, folder: str) -> DataFrame:
    t = series.bollinger(daily(spark, folder), series.ordered())
    return t.select("symbol", "day", *_r("close", "bb_mid", "bb_up", "bb_lo", "bb_width"))


def donchian(spark: SparkSession, folder: str) -> DataFrame:
    return series.donchian(daily(spark, folder), series.ordered()).select("symbol", "day", "don_hi", "don_lo")


def range_volume(spark: SparkSession, folder: str) -> DataFrame:
    w = series.ordered()
    t = series.with_obv(daily(spark, folder), w).withColumns({"tr": series.true_range(w), "spike": series.volume_spike(w)})
    return t.select("symbol", "day", "obv", *_r("tr", "spike"))


def pivots(spark: SparkSession, folder: str) -> DataFrame:
    return series.pivots(daily(spark, folder), series.ordered()).where("pivot_low or pivot_high").select("symbol", "day", "pivot_low", "pivot_high")


def year_range(spark: SparkSession, folder: str) -> DataFrame:
    return series.year_range(daily(spark, folder)).select("symbol", "day", "hi_52w", "lo_52w")


def averages(spark: SparkSession, folder: str) -> DataFrame:
    return recursive.with_indicators(daily(spark, folder)).select("symbol", "day", *_r("ema12", "ema26", "atr14", "rsi14"))


#: Columns of the whole table that are prices (rounded to cents), plain means (to five decimals) and others (to three).
MEANS = ["bb_mid", "sma50", "sma_long"]
PRICES = ["open", "high", "low", "close", "volume", "bb_up", "bb_lo", "don_hi", "don_lo", "obv", "ema12", "ema26", "macd", "macd_signal", "macd_hist", "atr14", "supertrend", "ch_long", "ch_short"]
OTHERS = ["bb_width", "bb_pct", "rsi14", "rsi2", "adx14", "plus_di", "minus_di", "supertrend_dir"]


def indicator_table(spark: SparkSession, folder: str) -> DataFrame:
    t = full_table(spark, folder)
    return t.select("symbol", "day", *[F.round(c, 2).alias(c) for c in PRICES], *[F.round(c, 5).alias(c) for c in MEANS], *[F.round(c, 3).alias(c) for c in OTHERS])


def regime(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.regime(full_table(spark, folder))


def votes(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.votes(full_table(spark, folder))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.signals(full_table(spark, folder), lookback=10)


def levels(spark: SparkSession, folder: str) -> DataFrame:
    t = decisions.levels(full_table(spark, folder), capital=100_000.0)
    return t.select("symbol", "side", *[F.round(c, 2).alias(c) for c in ("entry", "stop", "distance", "target2", "target3", "trail")], "shares")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.snapshot(full_table(spark, folder).select("symbol", "day", *[F.round(c, 2).alias(c) for c in ("close", "atr14", "rsi14", "supertrend")]), ["close", "atr14", "rsi14", "supertrend"])


QUERIES = {
    "bars_daily": daily, "bars_weekly": lambda s, d: daily(s, d, "week"), "bars_monthly": lambda s, d: series.resample(daily(s, d), "month"), "sma_bollinger": sma_bollinger, "donchian": donchian, "range_volume": range_volume,
    "fractal_pivots": pivots, "year_range": year_range, "ema_atr_rsi": averages, "indicator_table": indicator_table, "regime": regime, "votes": votes, "signals": signals, "levels": levels, "snapshots": snapshots,
}

BARS = "SELECT o_orderpriority AS symbol, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"
DAY = "WITH b AS (" + BARS.format(unit="day") + "), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS pc FROM b)"
_EMA = "m{k} AS (SELECT symbol, avg(close) AS seed FROM n WHERE i <= {k} GROUP BY 1), e{k} AS (SELECT n.symbol, n.i, m.seed AS v FROM n JOIN m{k} m USING (symbol) WHERE n.i = {k} UNION ALL SELECT n.symbol, n.i, e.v + 2.0 / ({k} + 1) * (n.close - e.v) FROM e{k} e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"
_WILDER = "s{k} AS (SELECT symbol, avg({x}) AS seed FROM x WHERE i BETWEEN {a} AND {z} GROUP BY 1), w{k} AS (SELECT x.symbol, x.i, s.seed AS v FROM x JOIN s{k} s USING (symbol) WHERE x.i = {z} UNION ALL SELECT x.symbol, x.i, w.v + (x.{x} - w.v) / 14 FROM w{k} w JOIN x ON x.symbol = w.symbol AND x.i = w.i + 1)"

_SEEDS = {"e12": ("close", 12), "e26": ("close", 26), "a14": ("tr", 14), "a10": ("tr", 10), "u14": ("up", 14), "d14": ("dn", 14), "u2": ("up", 2), "d2": ("dn", 2), "s14": ("tr2", 14), "p14": ("pl", 14), "m14": ("mi", 14)}


def _carried(name: str, seed: str, x: str, first: int, step: str) -> str:
    return f"CASE WHEN x.i = {first} THEN x.{seed} WHEN x.i > {first} THEN r.{name} + {step} * (x.{x} - r.{name}) END AS {name}_"


#: All indicators in one recursion over the bars of a symbol, in SQL.
FULL = (
    DAY.replace("WITH b", "WITH RECURSIVE b")
    + ", m AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn, high - lag(high) OVER w AS mu, lag(low) OVER w - low AS md FROM n WINDOW w AS (PARTITION BY symbol ORDER BY day)), "
    + "y AS (SELECT *, CASE WHEN i > 1 THEN tr END AS tr2, CASE WHEN mu IS NOT NULL THEN CASE WHEN mu > md AND mu > 0 THEN mu ELSE 0 END END AS pl, CASE WHEN mu IS NOT NULL THEN CASE WHEN md > mu AND md > 0 THEN md ELSE 0 END END AS mi FROM m), "
    + "x AS (SELECT *, " + ", ".join(f"avg({c}) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {n}" for n, (c, k) in _SEEDS.items()) + " FROM y), "
    + "r AS (SELECT symbol, i, " + ", ".join(f"NULL::DOUBLE AS {c}" for c in ("ema12", "ema26", "line", "lsum", "sig", "a14", "a10", "u14", "d14", "u2", "d2", "s14", "p14", "m14", "dx", "dsum", "adx", "top", "bot")) + ", 1 AS side FROM x WHERE i = 1 UNION ALL SELECT symbol, i, ema12_, ema26_, line_, lsum_, sig_, a14_, a10_, u14_, d14_, u2_, d2_, s14_, p14_, m14_, dx_, dsum_, adx_, top_, bot_, side_ FROM (SELECT x.symbol, x.i, "
    + ", ".join([
        _carried("ema12", "e12", "close", 12, "2.0 / 13"), _carried("ema26", "e26", "close", 26, "2.0 / 27"), "ema12_ - ema26_ AS line_", "coalesce(r.lsum, 0) + coalesce(line_, 0) AS lsum_", "CASE WHEN x.i = 34 THEN lsum_ / 9 WHEN x.i > 34 THEN r.sig + 0.2 * (line_ - r.sig) END AS sig_",
        _carried("a14", "a14", "tr", 14, "1.0 / 14"), _carried("a10", "a10", "tr", 10, "1.0 / 10"), _carried("u14", "u14", "up", 15, "1.0 / 14"), _carried("d14", "d14", "dn", 15, "1.0 / 14"), _carried("u2", "u2", "up", 3, "0.5"), _carried("d2", "d2", "dn", 3, "0.5"),
        _carried("s14", "s14", "tr2", 15, "1.0 / 14"), _carried("p14", "p14", "pl", 15, "1.0 / 14"), _carried("m14", "m14", "mi", 15, "1.0 / 14"), "CASE WHEN s14_ <> 0 THEN CASE WHEN p14_ + m14_ > 0 THEN 100 * abs(p14_ - m14_) / (p14_ + m14_) ELSE 0 END END AS dx_", "coalesce(r.dsum, 0) + coalesce(dx_, 0) AS dsum_",
        "CASE WHEN x.i = 28 THEN dsum_ / 14 WHEN x.i > 28 THEN r.adx + (dx_ - r.adx) / 14 END AS adx_", "(x.high + x.low) / 2 + 3 * a10_ AS hi_", "(x.high + x.low) / 2 - 3 * a10_ AS lo_", "CASE WHEN a10_ IS NULL THEN NULL WHEN r.top IS NULL OR hi_ < r.top OR x.pc > r.top THEN hi_ ELSE r.top END AS top_",
        "CASE WHEN a10_ IS NULL THEN NULL WHEN r.bot IS NULL OR lo_ > r.bot OR x.pc < r.bot THEN lo_ ELSE r.bot END AS bot_", "CASE WHEN a10_ IS NULL THEN 1 WHEN r.side = 1 THEN CASE WHEN x.close < bot_ THEN -1 ELSE 1 END ELSE CASE WHEN x.close > top_ THEN 1 ELSE -1 END END AS side_",
    ])
    + " FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)), "
    + "g AS (SELECT x.symbol, x.day, x.i, x.open, x.high, x.low, x.close, x.volume, x.pc, CASE WHEN x.i >= 20 THEN avg(x.close) OVER w20 END AS bb_mid, CASE WHEN x.i >= 20 THEN stddev_pop(x.close) OVER w20 END AS sd, CASE WHEN x.i > 20 THEN max(x.high) OVER wb END AS don_hi, CASE WHEN x.i > 20 THEN min(x.low) OVER wb END AS don_lo, "
    + "CASE WHEN x.i >= 50 THEN avg(x.close) OVER w50 END AS sma50, CASE WHEN x.i >= 200 THEN avg(x.close) OVER w200 END AS sma_long, coalesce(sum(sign(x.close - x.pc) * x.volume) OVER wall, 0.0) AS obv, r.ema12, r.ema26, r.line AS macd, r.sig AS macd_signal, r.line - r.sig AS macd_hist, "
    + ", ".join(f"CASE WHEN r.u{k} IS NULL THEN NULL WHEN r.d{k} = 0 THEN CASE WHEN r.u{k} > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + r.u{k} / r.d{k}) END AS rsi{k}" for k in (14, 2))
    + ", r.a14 AS atr14, r.adx AS adx14, 100 * r.p14 / nullif(r.s14, 0) AS plus_di, 100 * r.m14 / nullif(r.s14, 0) AS minus_di, CASE WHEN r.a10 IS NOT NULL THEN CASE WHEN r.side = 1 THEN r.bot ELSE r.top END END AS supertrend, CASE WHEN r.a10 IS NOT NULL THEN r.side END AS supertrend_dir, "
    + "CASE WHEN x.i >= 22 THEN max(x.close) OVER w22 END - 3 * r.a14 AS ch_long, CASE WHEN x.i >= 22 THEN min(x.close) OVER w22 END + 3 * r.a14 AS ch_short FROM x JOIN r ON r.symbol = x.symbol AND r.i = x.i WINDOW wall AS (PARTITION BY x.symbol ORDER BY x.day), w20 AS (PARTITION BY x.symbol ORDER BY x.day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w22 AS (PARTITION BY x.symbol ORDER BY x.day ROWS BETWEEN 21 PRECEDING AND CURRENT ROW), w50 AS (PARTITION BY x.symbol ORDER BY x.day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), w200 AS (PARTITION BY x.symbol ORDER BY x.day ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), wb AS (PARTITION BY x.symbol ORDER BY x.day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), "
    + "t AS (SELECT *, bb_mid + 2 * sd AS bb_up, bb_mid - 2 * sd AS bb_lo, 4 * sd / nullif(bb_mid, 0) AS bb_width, (close - (bb_mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_pct, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) - 1 AS ago FROM g)"
)
_CROSS = "(({a} - {b}) * (lag({a}) OVER w - lag({b}) OVER w) < 0)"
_RULES = [
    ("channel breakout", "close > don_hi", "'long'"), ("channel breakdown", "close < don_lo", "'short'"), ("dip above long average", "rsi2 < 10 AND close > sma_long", "'long'"), ("supertrend flip", "supertrend_dir <> lag(supertrend_dir) OVER w", "CASE WHEN supertrend_dir = 1 THEN 'long' ELSE 'short' END"),
    ("macd cross", _CROSS.format(a="macd", b="macd_signal"), "CASE WHEN macd > macd_signal THEN 'long' ELSE 'short' END"), ("average cross", _CROSS.format(a="sma50", b="sma_long"), "CASE WHEN sma50 > sma_long THEN 'long' ELSE 'short' END"),
    ("lower band re-entry", "pc < lag(bb_lo) OVER w AND close > bb_lo", "'long'"), ("upper band re-entry", "pc > lag(bb_up) OVER w AND close < bb_up", "'short'"),
]

SQL = {
    "bars_daily": BARS.format(unit="day"),
    "bars_weekly": BARS.format(unit="week"),
    "bars_monthly": DAY + " SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS day, arg_min(open, b.day) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.day) AS close, sum(volume) AS volume, max(b.day) AS last_day FROM b GROUP BY symbol, date_trunc('month', b.day)",
    "sma_bollinger": DAY + ", m AS (SELECT symbol, day, i, close, avg(close) OVER w AS mid, stddev_pop(close) OVER w AS sd FROM n WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), g AS (SELECT symbol, day, close, CASE WHEN i >= 20 THEN mid END AS mid, CASE WHEN i >= 20 THEN sd END AS sd FROM m) SELECT symbol, day, round(close, 4) AS close, round(mid, 4) AS bb_mid, round(mid + 2 * sd, 4) AS bb_up, round(mid - 2 * sd, 4) AS bb_lo, round(4 * sd / nullif(mid, 0), 4) AS bb_width FROM g",
    "donchian": DAY + " SELECT symbol, day, CASE WHEN i > 20 THEN max(high) OVER w END AS don_hi, CASE WHEN i > 20 THEN min(low) OVER w END AS don_lo FROM n WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    "range_volume": DAY + " SELECT symbol, day, coalesce(sum(sign(close - pc) * volume) OVER (PARTITION BY symbol ORDER BY day), 0.0) AS obv, round(greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)), 4) AS tr, round(CASE WHEN i >= 20 THEN volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) END, 4) AS spike FROM n",
    "fractal_pivots": DAY + ", p AS (SELECT symbol, day, coalesce(low <= lag(low) OVER w AND low <= lag(low, 2) OVER w AND low <= lead(low) OVER w AND low <= lead(low, 2) OVER w, false) AS pivot_low, coalesce(high >= lag(high) OVER w AND high >= lag(high, 2) OVER w AND high >= lead(high) OVER w AND high >= lead(high, 2) OVER w, false) AS pivot_high FROM n WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT * FROM p WHERE pivot_low OR pivot_high",
    "year_range": DAY + " SELECT symbol, day, max(high) OVER w AS hi_52w, min(low) OVER w AS lo_52w FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)",
    "ema_atr_rsi": DAY.replace("WITH b", "WITH RECURSIVE b") + ", x AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM n), "
    + ", ".join([_EMA.format(k=12), _EMA.format(k=26), _WILDER.format(k="t", x="tr", a=1, z=14), _WILDER.format(k="u", x="up", a=2, z=15), _WILDER.format(k="d", x="dn", a=2, z=15)])
    + " SELECT n.symbol, n.day, round(e12.v, 4) AS ema12, round(e26.v, 4) AS ema26, round(wt.v, 4) AS atr14, round(CASE WHEN wu.v IS NULL THEN NULL WHEN wd.v = 0 THEN CASE WHEN wu.v > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + wu.v / wd.v) END, 4) AS rsi14 FROM n LEFT JOIN e12 USING (symbol, i) LEFT JOIN e26 USING (symbol, i) LEFT JOIN wt USING (symbol, i) LEFT JOIN wu USING (symbol, i) LEFT JOIN wd USING (symbol, i)",
    "indicator_table": FULL + " SELECT symbol, day, " + ", ".join([*[f"round({c}, 2) AS {c}" for c in PRICES], *[f"round({c}, 5) AS {c}" for c in MEANS], *[f"round({c}, 3) AS {c}" for c in OTHERS[:-1]], "CAST(supertrend_dir AS DOUBLE) AS supertrend_dir"]) + " FROM t",
    "regime": FULL + ", l AS (SELECT *, lag(sma_long, 20) OVER (PARTITION BY symbol ORDER BY day) AS before FROM t), s AS (SELECT symbol, list_sort(list(bb_width) FILTER (WHERE bb_width IS NOT NULL)) AS ws FROM t WHERE ago < 120 GROUP BY 1) SELECT symbol, day, CASE WHEN adx14 IS NULL OR sma_long IS NULL THEN 'unknown' WHEN adx14 >= 25 THEN CASE WHEN close > sma_long THEN 'trending-up' ELSE 'trending-down' END WHEN adx14 < 20 THEN 'range' ELSE 'transitional' END AS label, CASE WHEN before IS NOT NULL AND sma_long IS NOT NULL THEN CASE WHEN sma_long > before THEN 'up' ELSE 'down' END END AS slope, coalesce(bb_width <= ws[greatest(len(ws) // 10, 1)], false) AS squeeze FROM l JOIN s USING (symbol) WHERE ago = 0",
    "votes": FULL + ", v AS (SELECT *, lag(macd_hist) OVER w AS h1, lag(macd_hist, 2) OVER w AS h2, avg(volume) FILTER (WHERE close - pc >= 0) OVER w20 AS mu, avg(volume) FILTER (WHERE close - pc < 0) OVER w20 AS md FROM t WINDOW w AS (PARTITION BY symbol ORDER BY day), w20 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), s AS (SELECT symbol, day, CASE WHEN close > sma_long THEN 1 WHEN close < sma_long THEN -1 ELSE 0 END AS v_ma, CASE WHEN macd_hist > h1 AND h1 > h2 THEN 1 WHEN macd_hist < h1 AND h1 < h2 THEN -1 ELSE 0 END AS v_macd, CASE WHEN rsi14 > 50 THEN 1 WHEN rsi14 < 50 THEN -1 ELSE 0 END AS v_rsi, CASE WHEN mu > md * 1.1 THEN 1 WHEN md > mu * 1.1 THEN -1 ELSE 0 END AS v_volume FROM v WHERE ago = 0) SELECT *, v_ma + v_macd + v_rsi + v_volume AS score FROM s",
    "signals": FULL + ", f AS (" + " UNION ALL ".join(f"SELECT symbol, ago, '{n}' AS signal, coalesce({r}, false) AS hit, {d} AS direction FROM t WINDOW w AS (PARTITION BY symbol ORDER BY day)" for n, r, d in _RULES) + ") SELECT symbol, signal, arg_min(direction, ago) AS direction, CAST(min(ago) FILTER (WHERE hit) AS INTEGER) AS bars_ago FROM f WHERE ago < 10 GROUP BY 1, 2 HAVING bool_or(hit) UNION ALL SELECT symbol, CASE WHEN rsi14 >= 70 THEN 'overbought' ELSE 'oversold' END, 'context', 0 FROM t WHERE ago = 0 AND (rsi14 >= 70 OR rsi14 <= 30)",
    "levels": FULL + ", p AS (SELECT *, coalesce(low <= lag(low) OVER w AND low <= lag(low, 2) OVER w AND low <= lead(low) OVER w AND low <= lead(low, 2) OVER w, false) AS pl, coalesce(high >= lag(high) OVER w AND high >= lag(high, 2) OVER w AND high >= lead(high) OVER w AND high >= lead(high, 2) OVER w, false) AS ph FROM t WINDOW w AS (PARTITION BY symbol ORDER BY day)), s AS (SELECT symbol, arg_max(low, day) FILTER (WHERE pl) AS sl, arg_max(high, day) FILTER (WHERE ph) AS sh FROM p GROUP BY 1), d AS (SELECT t.*, side, k, CASE WHEN k = 1 THEN sl ELSE sh END AS sw FROM t JOIN s USING (symbol), (VALUES ('long', 1), ('short', -1)) AS z(side, k) WHERE ago = 0 AND atr14 IS NOT NULL), e AS (SELECT *, CASE WHEN abs(close - sw) <= 3.5 * atr14 THEN sw ELSE close - k * 2.5 * atr14 END AS stop FROM d) SELECT symbol, side, round(close, 2) AS entry, round(stop, 2) AS stop, round(abs(close - stop), 2) AS distance, round(close + k * 2 * abs(close - stop), 2) AS target2, round(close + k * 3 * abs(close - stop), 2) AS target3, round(CASE WHEN supertrend_dir = k THEN supertrend END, 2) AS trail, CAST(floor(1000.0 / nullif(abs(close - stop), 0)) AS BIGINT) AS shares FROM e",
    "snapshots": FULL + " SELECT symbol, day, CAST(ago AS INTEGER) AS bars_ago, round(close, 2) AS close, round(atr14, 2) AS atr14, round(rsi14, 2) AS rsi14, round(supertrend, 2) AS supertrend FROM t WHERE ago < 10",
}
