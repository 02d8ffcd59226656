"""Joins that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def asof_backward(left: DataFrame, right: DataFrame, *, by: Sequence[str], time: str, values: Sequence[str], strict: bool = False, span: str = "month") -> DataFrame:
    """left with values of the last right row of the same key at or before its time (before it, if strict).

    Both sides are united and sorted once per key and span of time, and the last known right row is carried forward;
    what a span begins with comes from the last right rows of the spans before it, of which there is one each. So the
    work is one shuffle and one sort whatever the ratio of the sides, and no task holds a key. Times that aren't dates
    or timestamps form one span.

    Right rows of equal key and time must be unique, else the greatest values count. Left rows without such a row keep
    nulls; null keys or times match nothing.
    """
    right = right.groupBy(*by, time).agg(F.max(F.struct(*values)).alias("__v"))
    tag = 1 if strict else -1
    part = F.date_trunc(span, F.col(time)).cast("string") if dict(left.dtypes)[time].startswith(("date", "timestamp")) else F.lit("")
    both = left.select(*[F.col(c) for c in by], F.col(time), F.struct(*[F.col(c) for c in left.columns]).alias("__l"), F.lit(None).cast(dict(right.dtypes)["__v"]).alias("__v"), F.lit(0).alias("__side"))
    both = both.unionByName(right.select(*by, time, F.lit(None).cast(dict(both.dtypes)["__l"]).alias("__l"), "__v", F.lit(tag).alias("__side"))).withColumn("__b", part)
    spans = both.groupBy(*by, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(time))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"), before.alias("__in"))
    w = Window.partitionBy(*by, "__b").orderBy(F.col(time).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__l is not null")
    # Null keys match nothing, so they needn't find their span.
    carried = carried.join(spans, [*[F.col(c) == F.col(f"__k{i}") for i, c in enumerate(by)], F.col("__b") == F.col("__kb")], "left").withColumn("__v", F.coalesce("__v", "__in"))
    known = F.col(f"__l.{time}").isNotNull()
    for k in by:
        known = known & F.col(f"__l.{k}").isNotNull()
    return carried.select("__l.*", *[F.when(known, F.col(f"__v.{v}")).alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, *, by: Sequence[str], point: str, start: str, end: str, width: int = 32) -> DataFrame:
    """Each point (a date) with every range of its key with start <= point <= end.

    Ranges are cut into cells of width days, so that the join is an equality of key and cell with the exact condition
    behind it, not a nested loop. Null keys, points or ends match nothing.
    """
    cell = lambda c: F.floor(F.unix_date(c) / width)
    cells = ranges.where(F.col(start) <= F.col(end)).withColumn("__cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    placed = points.withColumn("__cell", cell(F.col(point)))
    return placed.join(cells, [*by, "__cell"]).where(F.col(point).between(F.col(start), F.col(end))).drop("__cell")


def snapshot_diff(stored: DataFrame, fetched: DataFrame, *, by: str, kind: str, ref: str, day: str, status: str, today: str) -> DataFrame:
    """(by, kind, ref, change, old_day, new_day, old_status, new_status): new, moved, status_changed, dropped and
    unchanged entries.

    An entry's slot is its ref, or its day where it has none. Only future entries of kinds that the fetch covers may
    drop. What is left over on both sides is paired as moved if a key and kind has exactly one future entry left on
    each. A move outranks a change of status.
    """
    slot = F.coalesce(F.nullif(F.trim(F.col(ref)), F.lit("")), F.col(day).cast("string"))
    side = lambda df, p: df.select(F.col(by), F.col(kind), slot.alias("slot"), F.col(ref).alias(f"{p}_ref"), F.col(day).alias(f"{p}_day"), F.col(status).alias(f"{p}_status"))
    keys = [by, kind, "slot"]
    one = lambda df, p: df.groupBy(*keys).agg(F.max(F.struct(f"{p}_day", f"{p}_status", f"{p}_ref")).alias("x")).select(*keys, "x.*")
    old, new = one(side(stored, "old"), "old"), one(side(fetched, "new"), "new")
    both = old.withColumn("o", F.lit(True)).join(new.withColumn("n", F.lit(True)), keys, "full")
    covered = fetched.select(by, kind).distinct().withColumn("covered", F.lit(True))
    both = both.join(covered, [by, kind], "left")
    future = lambda c: F.col(c) >= F.lit(today).cast("date")
    gone = F.col("n").isNull() & F.col("covered") & future("old_day")
    fresh = F.col("o").isNull() & future("new_day")
    both = both.withColumns({"gone": F.coalesce(gone, F.lit(False)), "fresh": F.coalesce(fresh, F.lit(False))})
    # What is left of a key and kind is counted; only those with one entry on each side are paired, by a join that
    # carries one row for each of them, so a key with many entries meets in no single task.
    left = both.groupBy(by, kind).agg(F.count_if("gone").alias("ng"), F.count_if("fresh").alias("nf"), F.max(F.when(F.col("gone"), F.struct(F.col("old_day").alias("p_day"), F.col("old_status").alias("p_status")))).alias("p"))
    left = left.where("ng = 1 and nf = 1").select(by, kind, "p.p_day", "p.p_status", F.lit(True).alias("pair"))
    rows = both.join(left, [by, kind], "left")
    pair = F.coalesce("pair", F.lit(False))
    rows = rows.where(~(pair & F.col("gone")))
    moved_pair = pair & F.col("fresh")
    old_day, old_status = F.when(moved_pair, F.col("p_day")).otherwise(F.col("old_day")), F.when(moved_pair, F.col("p_status")).otherwise(F.col("old_status"))
    change = (
        F.when(moved_pair, "moved").when(F.col("o").isNull(), "new").when(F.col("gone"), "dropped").when(F.col("n").isNull(), "kept")
        .when(~F.col("old_day").eqNullSafe(F.col("new_day")), "moved").when(~F.col("old_status").eqNullSafe(F.col("new_status")), "status_changed").otherwise("unchanged")
    )
    return rows.select(by, kind, F.coalesce("new_ref", "old_ref").alias(ref), change.alias("change"), old_day.alias("old_day"), F.col("new_day"), old_status.alias("old_status"), F.col("new_status"))


def position_changes(before: DataFrame, after: DataFrame, *, keys: Sequence[str], amount: str) -> DataFrame:
    """(keys, before, after, change): new, exit, add, trim or hold per key; amounts of repeated keys are summed."""
    b = before.groupBy(*keys).agg(F.sum(amount).alias("before"))
    a = after.groupBy(*keys).agg(F.sum(amount).alias("after"))
    j = b.join(a, list(keys), "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "exit").when(F.col("after") > F.col("before"), "add").when(F.col("after") < F.col("before"), "trim").otherwise("hold")
    return j.withColumn("change", change)


def with_fallback(df: DataFrame, dimension: DataFrame, *, key: str, values: Sequence[str], default_key: str) -> DataFrame:
    """df with values of its key in the dimension, or of default_key where the key is missing or null."""
    d = dimension.select(key, F.struct(*values).alias("__v"))
    rest = d.where(F.col(key) == default_key).select(F.col("__v").alias("__d")).limit(1)
    joined = df.join(d, key, "left").join(F.broadcast(rest), F.lit(True), "left")
    return joined.withColumn("__v", F.coalesce("__v", "__d")).select(*df.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def closure(edges: DataFrame, roots: DataFrame, *, parent: str, child: str, root: str, most: int = 50, acyclic: bool = False) -> DataFrame:
    """(root, node, depth): every node reached from each root, at its least depth.

    Breadth-first, one join a level; a node already reached isn't followed again, so cycles end. With acyclic nodes are
    followed as often as they're reached and depth is the greatest one, so that ordering by it, deepest first, puts
    whatever a node depends on before it; a cycle then never ends and is an error. More than most levels raise an error.
    Each level's frontier is written once; what was reached before is the union of the frontiers.
    """
    e = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p is not null and c is not null").distinct()
    front = cut(roots.select(F.col(root).alias("root"), F.col(root).alias("node"), F.lit(0).alias("depth")).where("root is not null").distinct())
    seen = front
    for depth in range(1, most + 1):
        step = front.join(e, front["node"] == e["p"]).select("root", F.col("c").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = cut(step if acyclic else step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if front.isEmpty():
            return seen.groupBy("root", "node").agg(F.max("depth").alias("depth")) if acyclic else seen
        seen = seen.unionByName(front)
    raise ValueError(f"a cycle, or deeper than {most} levels" if acyclic else f"deeper than {most} levels")


def nearest_bucket(c: Column, unit_months: int = 3) -> Column:
    """The calendar quarter end (or other unit) nearest to a date, the earlier one of two equally near."""
    here = F.last_day(F.add_months(F.trunc(c, "month"), 0))
    offset = F.pmod(F.lit(unit_months) - F.pmod(F.month(c), unit_months), F.lit(unit_months))
    after = F.last_day(F.add_months(here, offset.cast("int")))
    before = F.last_day(F.add_months(after, -unit_months))
    return F.when(F.datediff(c, before) <= F.datediff(after, c), before).otherwise(after)
