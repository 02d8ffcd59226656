"""Series whose next value depends on the last one: exponential and Wilder averages and what is built on them.

Each entity's bars (bounded by the calendar: one row per entity and day) go through one Arrow group; within it every
recursion runs once over plain arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NAN = np.nan
COLUMNS = ["ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi14", "rsi2", "atr14", "adx14", "plus_di", "minus_di", "supertrend", "supertrend_dir"]


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """s[i] = s[i-1] + alpha * (x[i] - s[i-1]), seeded at the n-th known value with the mean of the first n; leading
    nans are skipped."""
    out = np.full(len(x), NAN)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known) or len(x) - known[0] < n:
        return out
    at = known[0] + n - 1
    out[at] = last = float(np.mean(x[known[0] : at + 1]))
    for i in range(at + 1, len(x)):
        last += alpha * (x[i] - last)
        out[i] = last
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 2.0 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1.0 / n)


def _moves(x: np.ndarray) -> np.ndarray:
    """Differences, the first unknown."""
    return np.concatenate([[NAN], np.diff(x)]) if len(x) else x


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    d = _moves(close)
    up, down = wilder(np.maximum(d, 0.0), n), wilder(np.maximum(-d, 0.0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        normal = 100.0 - 100.0 / (1.0 + up / down)
    flat = np.where(up > 0, 100.0, 50.0)
    return np.where(np.isnan(up), NAN, np.where(down == 0, flat, normal))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[NAN], close[:-1]]) if len(close) else close
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, +DI and -DI; moves and ranges count from the second bar on."""
    up, down = _moves(high), -_moves(low)
    plus = np.where(np.isnan(up), NAN, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), NAN, np.where((down > up) & (down > 0), down, 0.0))
    span = true_range(high, low, close)
    if len(span):
        span[0] = NAN
    s, p, m = wilder(span, n), wilder(plus, n), wilder(minus, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(s == 0, NAN, s)
        pdi, mdi = 100.0 * p / s, 100.0 * m / s
        dx = np.where(np.isnan(pdi), NAN, np.where(pdi + mdi > 0, 100.0 * np.abs(pdi - mdi) / (pdi + mdi), 0.0))
    return wilder(dx, n), pdi, mdi


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 10, k: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """The trailing line and its side: 1 under a rising close, -1 above a falling one."""
    width = k * wilder(true_range(high, low, close), n)
    middle = (high + low) / 2.0
    line, side = np.full(len(close), NAN), np.full(len(close), NAN)
    top = bottom = NAN
    now = 1
    for i in np.flatnonzero(~np.isnan(width)):
        upper, lower = middle[i] + width[i], middle[i] - width[i]
        # A band only tightens, until the close before has crossed it.
        if np.isnan(top) or upper < top or close[i - 1] > top:
            top = upper
        if np.isnan(bottom) or lower > bottom or close[i - 1] < bottom:
            bottom = lower
        if now == 1:
            now = -1 if close[i] < bottom else 1
        else:
            now = 1 if close[i] > top else -1
        side[i], line[i] = now, bottom if now == 1 else top
    return line, side


def indicators(bars: pd.DataFrame) -> pd.DataFrame:
    """One entity's bars in order of day, with COLUMNS."""
    h, lo, c = (bars[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
    fast, slow = ema(c, 12), ema(c, 26)
    line = fast - slow
    signal = ema(line, 9)
    adx, pdi, mdi = directional(h, lo, c)
    st, side = supertrend(h, lo, c)
    values = [fast, slow, line, signal, line - signal, rsi(c, 14), rsi(c, 2), wilder(true_range(h, lo, c), 14), adx, pdi, mdi, st, side]
    return bars.assign(**{n: np.where(np.isnan(v), None, v) for n, v in zip(COLUMNS, values)})


def with_indicators(bars: DataFrame, symbol: str = "symbol", day: str = "day") -> DataFrame:
    """bars with COLUMNS, null while an average has too few rows. bars has one row per symbol and day and no null prices."""
    schema = ", ".join(f"`{n}` {t}" for n, t in bars.dtypes) + ", " + ", ".join(f"{c} double" for c in COLUMNS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return indicators(pdf.sort_values(day, ignore_index=True))

    return bars.groupBy(symbol).applyInPandas(run, schema)
