"""Everyday table operators that take more than one call of Spark: filling, selecting, sampling, stacking, validating."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profile import numbered


def columns_like(df: DataFrame, pattern: str | None = None, kinds: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Names of the columns that match the pattern wholly, have one of the types, and aren't excluded, in their order."""
    return [c for c, t in df.dtypes if (pattern is None or re.fullmatch(pattern, c)) and (not kinds or t in kinds) and c not in exclude]


def fill_mean(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """df with nulls of column replaced by the mean of its group (of the table without by); all null stays null.

    The means are an aggregation joined back, so no task holds a group.
    """
    mean = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.avg(column).alias("__mean"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True)
    # Without groups the means are one row.
    d = df.join(mean if by else F.broadcast(mean), same, "left")
    return d.withColumn(column, F.coalesce(column, "__mean")).select(*df.columns)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def sample(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """About that share of the rows, the same ones on every run and whatever the partitions: by a hash of the key."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(u < share)


def head(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in this order, with place; partitions keep n rows each, so nothing but those is sorted."""
    d = df.orderBy(*order).limit(n)
    return d.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; columns a part lacks are null in its rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str]) -> DataFrame:
    """Row i of left beside row i of right in their orders, with row_no; the shorter side is padded with nulls.

    Rows are numbered in ranges, so no task sorts a table.
    """
    return numbered(left, order_left, "row_no").join(numbered(right, order_right, "row_no"), "row_no", "full")


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all checks, and the others with the names of the failed ones (reasons). Null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    d = df.withColumn("reasons", failed)
    return d.where(F.size("reasons") == 0).drop("reasons"), d.where(F.size("reasons") > 0)


def require(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """df, but a row that fails a check fails the query with the check's name. Null counts as failed."""
    ok = F.lit(True)
    for n, c in checks.items():
        ok = ok & F.coalesce(c, F.lit(False)) | F.when(~F.coalesce(c, F.lit(False)), F.raise_error(F.lit(f"{n} doesn't hold")).cast("boolean"))
    return df.where(ok)


def piped(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df through the steps in order."""
    for f in steps:
        df = df.transform(f)
    return df


def numbers(df: DataFrame, columns: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """df with the columns as doubles (text that isn't a number is null), without rows where one of them is null or one
    of positive isn't above zero."""
    d = df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double") for c in columns}).dropna(subset=list(columns))
    for c in positive:
        d = d.where(F.col(c) > 0)
    return d


def in_window(day: Column, start, end) -> Column:
    """Whether day lies in [start, end], both ends included; false for null."""
    return F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))


def since(day: Column, as_of, days: int) -> Column:
    """Whether day is at most so many days before as_of; false for null."""
    return F.coalesce(day >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))


def navigation(pages: DataFrame, *, space: str, group: str, order: str, page: str) -> DataFrame:
    """(space, group, pages): the pages of each group by order (nulls last), then name.

    A group is a menu: its pages are as many as a reader can see.
    """
    item = F.struct(F.col(order).isNull().alias("__n"), F.col(order).alias("order"), F.col(page).alias("page"))
    return pages.groupBy(space, group).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["page"]).alias("pages"))


def key_values(stored: DataFrame, changes: DataFrame, key: str = "key", value: str = "value", order: str = "order") -> DataFrame:
    """A table of settings after changes: the last value of each key by order counts, null deletes it."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("x")).select(key, F.col("x.v").alias("__new"), F.lit(True).alias("__hit"))
    d = stored.join(last, key, "full")
    return d.select(key, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value)).alias(value)).where(F.col(value).isNotNull())


def scored_layers(scores: DataFrame, *, layer: str, candidate: str, score: str) -> DataFrame:
    """(layer, candidate, mean, place, layer_mean): candidates of a layer by their mean score over all dimensions."""
    per = scores.groupBy(layer, candidate).agg(F.avg(score).alias("mean"), F.sum(score).alias("__s"), F.count(score).alias("__n"))
    whole = per.groupBy(layer).agg(F.try_divide(F.sum("__s"), F.sum("__n")).alias("layer_mean"))
    w = Window.partitionBy(layer).orderBy(F.col("mean").desc_nulls_last())
    return per.withColumn("place", F.rank().over(w)).join(whole, layer).select(layer, candidate, "mean", "place", "layer_mean")


def credited(claims: DataFrame, used: DataFrame, rules: DataFrame, *, task: str, source: str, tool: str) -> DataFrame:
    """(task, source, credited): whether a claimed source is backed by a tool that the task used.

    A rule (pattern, tool) says which tool backs the sources whose name matches the pattern, in any case. Rules are a
    list in a table of some rows, so it is broadcast; more than 1,000 raise an error.
    """
    if rules.limit(1001).count() > 1000:
        raise ValueError("more than 1,000 rules")
    named = claims.select(task, source).distinct().join(F.broadcast(rules.select("pattern", F.col("tool").alias("__tool"))), F.expr(f"`{source}` rlike concat('(?i)', pattern)"), "left")
    hits = named.join(used.select(task, F.col(tool).alias("__tool")).distinct().withColumn("__hit", F.lit(True)), [task, "__tool"], "left")
    return hits.groupBy(task, source).agg(F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("credited"))


def shaped(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, object] = {}) -> DataFrame:
    """df with exactly these columns: missing ones are null, blank and null cells of a column with a default take it."""
    def cell(c: str) -> Column:
        v = F.col(c) if c in df.columns else F.lit(None).cast("string")
        return F.coalesce(F.when(F.trim(v.cast("string")) != "", v), F.lit(defaults[c])) if c in defaults else v

    return df.select(*[cell(c).alias(c) for c in columns])


def settled(stored: DataFrame, defaults: Mapping[str, str], allowed: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """(key, value): settings as stored over the defaults; a value that isn't allowed for its key gives way to the default."""
    d = stored.sparkSession.createDataFrame(list(defaults.items()), "key string, __default string")
    ok = F.lit(True)
    for k, values in allowed.items():
        ok = ok & ((F.col("key") != k) | F.col("value").isin(*values))
    return d.join(stored.select("key", "value"), "key", "full").select("key", F.coalesce(F.when(F.coalesce(ok, F.lit(False)), F.col("value")), F.col("__default")).alias("value"))
