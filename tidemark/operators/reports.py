"""Tables behind reports and charts: estimates, prices with revenue, calendars, change lists, peers, keyword checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import scale_of
from tidemark.functions.strings import quarter_label
from tidemark.operators.series import lagged_growth, ordered, tail


def estimates(df: DataFrame, *, entity: str, day: str, actual: str, estimated: str, last: int = 8) -> DataFrame:
    """(entity, day, label, estimate, reported, divisor): the last announcements of each entity that have an actual, both
    figures divided by one divisor an entity, so that the greatest of them lies below 1,000."""
    d = tail(df.where(F.col(actual).isNotNull()), last, by=entity, order=day)
    top = F.max(F.greatest(F.abs(F.col(actual)), F.abs(F.coalesce(F.col(estimated), F.lit(0))))).over(Window.partitionBy(entity))
    d = d.withColumn("divisor", scale_of(top))
    return d.select(entity, day, quarter_label(F.col(day)).alias("label"), (F.col(estimated) / F.col("divisor")).alias("estimate"), (F.col(actual) / F.col("divisor")).alias("reported"), "divisor")


def fiscal_spans(df: DataFrame, *, entity: str, end: str) -> DataFrame:
    """df with span_start, span_mid, span_days: a period begins the day after the one before it ended, the first one 90
    days before its own end; the middle is in milliseconds since 1970."""
    before = F.lag(end).over(Window.partitionBy(entity).orderBy(end))
    d = df.withColumn("span_start", F.coalesce(F.date_add(before, 1), F.date_sub(end, 90)))
    ms = lambda c: F.unix_date(c).cast("bigint") * 86_400_000
    return d.withColumns({"span_days": F.datediff(end, "span_start"), "span_mid": F.floor((ms("span_start") + ms(end)) / 2)})


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median): the value at place n // 2 of n sorted ones; values of a group are counted, not listed.

    Equal values are one row, so a window holds a group's different values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    c = c.withColumns({"upto": F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    at = F.floor(F.col("total") / 2)
    return c.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(*by, F.col(value).alias("median"))


def price_with_revenue(prices: DataFrame, periods: DataFrame, *, entity: str, day: str, end: str, revenue: str, mode: str = "period", released: str | None = None, point: str = "period_end") -> DataFrame:
    """(entity, at, value, ...) of the periods that lie within their entity's days of prices.

    mode 'period': at is the middle of the period in milliseconds, value the revenue by the entity's divisor, with
    divisor and width (the upper median of the periods' days); 'reaction': at is the day of release; 'growth': value
    is the change against four periods before in percent, at the end of the period or, with point 'released', the day
    of release. Entities without prices give no rows.
    """
    if mode not in ("period", "reaction", "growth"):
        raise ValueError(f"no mode {mode!r}")
    span = prices.groupBy(entity).agg(F.min(day).alias("__a"), F.max(day).alias("__z"))
    at = end if mode == "period" or (mode == "growth" and point == "period_end") else released
    p = periods
    if mode == "growth":
        # Growth is formed over all periods, before those outside the prices go.
        p = p.withColumn("__g", lagged_growth(F.col(revenue), ordered(entity, end), 4))
    p = p.join(span, entity).where(F.col(at).between(F.col("__a"), F.col("__z"))).drop("__a", "__z")
    if mode == "growth":
        return p.where("__g is not null").select(entity, F.col(at).alias("at"), F.round("__g", 2).alias("value"))
    p = p.withColumn("divisor", scale_of(F.max(F.abs(F.col(revenue))).over(Window.partitionBy(entity))))
    value = F.round(F.col(revenue) / F.col("divisor"), 4)
    if mode == "reaction":
        return p.select(entity, F.col(at).alias("at"), value.alias("value"), "divisor")
    p = fiscal_spans(p, entity=entity, end=end)
    width = upper_median(p, [entity], "span_days").withColumnRenamed("median", "width")
    return p.join(width, entity).select(entity, F.col("span_mid").alias("at"), value.alias("value"), "divisor", "width")


def axis_of(kinds: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """(by, axis): 'category' if all kinds of a chart are, else 'datetime'."""
    return kinds.groupBy(*by).agg(F.when(F.bool_and(F.coalesce(F.col(kind) == "category", F.lit(False))), "category").otherwise("datetime").alias("axis"))


def upcoming(events: DataFrame, *, day: str, today: str, horizon: int, order: Sequence[str], most: int = 25) -> DataFrame:
    """The first entries from today to horizon days on, both included, by day and order, with place."""
    from tidemark.operators.tables import head

    t = F.lit(today).cast("date")
    return head(events.where(F.col(day).between(t, F.date_add(t, horizon))), most, [F.col(day), *[F.col(c).asc_nulls_last() for c in order]])


# Kinds of change in the order of a report, with their words.
CHANGES = {"moved": "date moved", "new": "newly added", "status_changed": "status change", "dropped": "dropped (review)"}


def change_rows(diff: DataFrame, *, by: str, kind: str) -> DataFrame:
    """(by, kind, change, before, after, place): the changes of joins.snapshot_diff() as rows of a report, those of a key
    in the order of CHANGES; kept and unchanged entries are left out."""
    names = list(CHANGES)
    d = diff.where(F.col("change").isin(*names))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("change"))
    words = F.element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv]), F.col("change"))
    status = F.col("change") == "status_changed"
    before = F.when(status, F.col("old_status")).otherwise(F.col("old_day").cast("string"))
    after = F.when(status, F.col("new_status")).when(F.col("change") == "dropped", F.lit(None)).otherwise(F.col("new_day").cast("string"))
    w = Window.partitionBy(by).orderBy(rank, kind, F.coalesce("new_day", "old_day"), F.coalesce("new_status", "old_status"))
    return d.select(by, kind, words.alias("change"), F.coalesce(before, F.lit("")).alias("before"), F.coalesce(after, F.lit("")).alias("after"), F.row_number().over(w).alias("place"))


def isolated(stored: DataFrame, fetched: DataFrame, failures: DataFrame, *, by: str, error: str) -> tuple[DataFrame, DataFrame]:
    """What a run over many keys leaves where some fetches failed: the state to store (fetched rows, but the stored rows
    of failed keys) and (by, error, n_kept) of the failures. A failed key's fetched rows don't count."""
    bad = failures.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(error).alias(error))
    good = fetched.join(bad.select(by), by, "left_anti")
    kept = stored.join(bad.select(by), by, "left_semi")
    counts = kept.groupBy(by).agg(F.count("*").alias("n_kept"))
    return good.unionByName(kept, allowMissingColumns=True), bad.join(counts, by, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def keyword_fit(index: DataFrame, revenue: DataFrame, *, keys: Sequence[str], quarter: str, index_value: str, revenue_value: str, lag: int = 4, least: int = 8) -> DataFrame:
    """(keys, n_quarters, r): correlation of the changes (against lag quarters before, in percent), not the levels, of an
    interest index and of revenue in the quarters both have; keys with fewer than least such quarters give no row."""
    change = lambda d, v, n: d.select(*keys, quarter, lagged_growth(F.col(v), Window.partitionBy(*keys).orderBy(quarter), lag).alias(n)).where(f"{n} is not null")
    both = change(index, index_value, "__i").join(change(revenue, revenue_value, "__r"), [*keys, quarter])
    return both.groupBy(*keys).agg(F.count("*").alias("n_quarters"), F.corr("__i", "__r").alias("r")).where(F.col("n_quarters") >= least)


def peer_table(df: DataFrame, *, entity: str, year: str, values: Mapping[str, Column], years: Sequence[int]) -> DataFrame:
    """(entity, one column for each value and year, such as revenue_1996): the figures of peers side by side.

    The years are those given, so the columns don't depend on the data; missing ones are null.
    """
    cells = [F.max(F.when(F.col(year) == y, c)).alias(f"{n}_{y}") for n, c in values.items() for y in years]
    return df.groupBy(entity).agg(*cells)


def consensus(df: DataFrame, *, entity: str, rating: str, target: str) -> DataFrame:
    """(entity, rating, n, share, mean_target): how many analysts gave each rating, and the mean target of the entity."""
    per = df.groupBy(entity, rating).agg(F.count("*").alias("n"), F.sum(target).alias("__t"), F.count(target).alias("__k"))
    whole = per.groupBy(entity).agg(F.sum("n").alias("__n"), F.try_divide(F.sum("__t"), F.sum("__k")).alias("mean_target"))
    return per.join(whole, entity).select(entity, rating, "n", (F.col("n") / F.col("__n")).alias("share"), "mean_target")


def quarter_ratio(a: DataFrame, b: DataFrame, *, day: str, value: str) -> DataFrame:
    """(quarter, a, b, ratio): two companies' figures by the calendar quarter end nearest to their own period ends."""
    from tidemark.operators.joins import nearest_bucket

    side = lambda d, n: d.groupBy(nearest_bucket(F.col(day)).alias("quarter")).agg(F.sum(value).alias(n))
    return side(a, "a").join(side(b, "b"), "quarter").withColumn("ratio", F.try_divide(F.col("a").cast("double"), F.nullif(F.col("b").cast("double"), F.lit(0.0))))


def with_enough_bars(bars: DataFrame, *, symbol: str = "symbol", least: int = 60, wanted: int = 220) -> tuple[DataFrame, DataFrame]:
    """The bars of symbols with at least so many, and (symbol, n_bars, note) of those with fewer than wanted: 'too few'
    below least, else a 'short history'."""
    n = bars.groupBy(symbol).agg(F.count("*").alias("n_bars"))
    notes = n.where(F.col("n_bars") < wanted).withColumn("note", F.when(F.col("n_bars") < least, "too few").otherwise("short history"))
    return bars.join(n.where(F.col("n_bars") >= least).select(symbol), symbol, "left_semi"), notes


def margins(df: DataFrame, *, entity: str, period: str, revenue: str, parts: Mapping[str, str], last: int = 8) -> DataFrame:
    """(entity, period, revenue, parts, <part>_margin, divisor): the last periods of each entity, amounts by one divisor an
    entity, margins in percent of revenue (null where that is zero)."""
    d = tail(df, last, by=entity, order=period)
    d = d.withColumn("divisor", scale_of(F.max(F.abs(F.col(revenue))).over(Window.partitionBy(entity))))
    shares = [(F.try_divide(F.col(c), F.nullif(F.col(revenue), F.lit(0.0))) * 100).alias(f"{n}_margin") for n, c in parts.items()]
    return d.select(entity, period, (F.col(revenue) / F.col("divisor")).alias("revenue"), *[(F.col(c) / F.col("divisor")).alias(n) for n, c in parts.items()], *shares, "divisor")


def flagged_prices(prices: DataFrame, flags: DataFrame, *, entity: str, day: str, title: str) -> DataFrame:
    """prices with at (milliseconds since 1970) and flags, the titles of the day's flags in order, '' where there are none.
    Flags on days without a price are left out."""
    f = flags.groupBy(entity, day).agg(F.array_join(F.array_sort(F.collect_set(title)), "; ").alias("flags"))
    d = prices.join(f, [entity, day], "left")
    return d.withColumns({"at": F.unix_date(F.col(day)).cast("bigint") * 86_400_000, "flags": F.coalesce("flags", F.lit(""))})


def report_document(title: str, parts: Mapping[str, DataFrame], most: int = 25) -> str:
    """A report as JSON: each part with its columns, its first rows (by the part's own order) and how many it has in all."""
    import json

    out = {}
    for name, d in parts.items():
        out[name] = {"columns": d.columns, "rows": [json.loads(r) for r in d.limit(most).toJSON().collect()], "total": d.count()}
    return json.dumps({"title": title, "parts": out}, ensure_ascii=False)
