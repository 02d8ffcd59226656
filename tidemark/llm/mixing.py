"""Sources mixed to target shares along a curriculum that may change over time."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Target tables may hold so many sources; their rows are read to the driver.
MOST_SOURCES = 10_000


def quotas(sizes: Mapping[str, int], weights: Mapping[str, float], repeats: Mapping[str, int], total: float) -> dict[str, float]:
    """Size that each source contributes: its weight's share of total, no more than repeats times its own size.

    What a capped source can't give is shared among the others by their weights, again and again until none of them
    is over its cap; if all are capped, the sum stays under total.
    """
    cap = {s: float(sizes.get(s, 0)) * max(0, repeats[s]) for s in weights}
    left, open_, out = float(total), {s for s in weights if weights[s] > 0}, dict.fromkeys(weights, 0.0)
    while open_:
        whole = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / whole >= cap[s]}
        if not over:
            return out | {s: left * weights[s] / whole for s in open_}
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ -= over
    return out


def curriculum(quota: Mapping[str, float], slopes: Mapping[str, float], cells: int = 64, rounds: int = 500) -> dict[str, list[float]]:
    """For each source, the share of its quota given by the times 0, 1/cells, ..., 1.

    Source s has the schedule 1 + slope * (2x - 1) at time x. At each time the rates of all sources must sum to the
    same, and each source must give its quota by the end: the table of sources and cells of time that has these sums
    and else keeps the ratios of the schedules is found by scaling rows and columns in turn. The shares are its running
    sums along time.
    """
    names = [s for s, q in quota.items() if q > 0]
    if not names:
        return {}
    if any(not -1 <= slopes.get(s, 0.0) <= 1 for s in names):
        raise ValueError("slopes lie between -1 and 1")
    mid = (np.arange(cells) + 0.5) / cells
    table = np.array([1 + slopes.get(s, 0.0) * (2 * mid - 1) for s in names])
    want = np.array([quota[s] for s in names])
    want = want / want.sum()
    for _ in range(rounds):
        table *= (1 / cells) / table.sum(0)
        sums = table.sum(1)
        table *= (want / sums)[:, None]
        if np.abs(sums - want).max() < 1e-12:
            break
    upto = np.cumsum(table, axis=1) / want[:, None]
    return {s: [0.0, *map(float, upto[i, :-1]), 1.0] for i, s in enumerate(names)}


def _time_of(share: Column, upto: Column, cells: int) -> Column:
    """The time in [0, 1] at which a source has given share of its quota, upto being its running shares."""
    k = F.least(F.greatest(F.size(F.filter(upto, lambda x: x <= share)) - 1, F.lit(0)), F.lit(cells - 1))
    lo, hi = F.get(upto, k), F.get(upto, k + 1)
    inside = F.coalesce(F.try_divide(share - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0))
    return (k + F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))) / F.lit(cells)


def mix(sized: DataFrame, targets: DataFrame, *, id: str, source: str, size: str, weight: str = "weight", repeats: str = "max_repeats", slopes: Mapping[str, float] | None = None, seed: int = 7, buckets: int = 4096, cells: int = 64) -> DataFrame:
    """(position, id, source, repeat_no, size): every use of a record, sorted by training position.

    sized has one row per record with its source and size; targets has weight (shares, made to sum to 1) and the most
    uses for each source. The total is the size of all records with a source once. Records whose source is null or
    has no target aren't used; sizes that are null or under one count as nothing and are used as often as their
    neighbours. A source's records follow each other in an order drawn by a hash of id and seed, pass after pass, so
    the uses of a record lie as far apart as its quota allows; the last pass ends with the record whose middle lies
    within the quota, so no record is used more often than allowed. Ties in position follow source, id and repeat_no.

    slopes gives the curriculum: a source's weight at time x in [0, 1] is proportional to 1 + slope * (2x - 1), so that
    +1 grows from nothing and -1 fades out; the default 0 is even. The weights are scaled so that at every time they
    make up the whole and over all time each source gives its quota, see curriculum(). Their integral is inverted for
    each record's place in its source's cumulative demand, so position is the number of tokens before it in the whole.

    Running sizes are formed in two levels, within buckets of the hash and over the buckets of a source, so no task
    holds a source.
    """
    rules = [r.asDict() for r in targets.where(F.col(source).isNotNull()).select(source, weight, repeats).limit(MOST_SOURCES + 1).collect()]
    if len(rules) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = sized.where(F.col(source).isNotNull()).select(F.col(id).alias("id"), F.col(source).alias("src"), n.alias("n"), F.xxhash64(F.col(id), F.lit(seed)).alias("h"))
    rows = rows.withColumn("b", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sums = rows.groupBy("src", "b").agg(F.sum("n").alias("held"))
    total = int(sums.agg(F.sum("held")).first()[0] or 0)
    wanted = targets.select(F.col(source).alias("src")).where("src is not null").distinct()
    # At most a row for each source of the targets, whose number was checked above.
    by_source = {r["src"]: int(r["held"]) for r in sums.join(wanted, "src", "left_semi").groupBy("src").agg(F.sum("held").alias("held")).collect()}
    most = {r[source]: int(r[repeats] or 0) for r in rules}
    quota = quotas(by_source, {r[source]: float(r[weight] or 0) for r in rules}, most, total)
    upto = curriculum(quota, slopes or {}, cells)
    plan = [(s, q, float(by_source.get(s, 0)), most[s]) for s, q in quota.items() if q > 0]
    table = sized.sparkSession.createDataFrame(plan, "src string, quota double, whole double, most int")
    curves = sized.sparkSession.createDataFrame(list(upto.items()), "src string, curve array<double>")
    before = F.coalesce(F.sum("held").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("offset", before).select("src", "b", "offset").join(F.broadcast(table), "src")
    inner = F.sum("n").over(Window.partitionBy("src", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("upto", inner).join(offsets, ["src", "b"]).withColumn("middle", F.col("offset") + F.col("upto") - F.col("n") / 2)
    passes = F.least(F.col("most"), F.floor((F.col("quota") - F.col("middle")) / F.col("whole")).cast("int") + 1)
    uses = placed.where("whole > 0").withColumn("k", F.explode(F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))))
    share = (F.col("k") * F.col("whole") + F.col("middle")) / F.col("quota")
    uses = uses.join(F.broadcast(curves), "src")
    at = F.floor(_time_of(share, F.col("curve"), cells) * F.lit(float(max(sum(quota.values()), 1)))).cast("long")
    out = uses.select(at.alias("position"), F.col("id").alias(id), F.col("src").alias(source), (F.col("k") + 1).alias("repeat_no"), F.col("n").alias(size))
    return out.orderBy("position", source, id, "repeat_no")


def shares(mixed: DataFrame, targets: DataFrame, *, source: str, id: str, size: str, weight: str = "weight") -> DataFrame:
    """(source, target_share, actual_share, n_uses, n_records, total_size, most_uses) for each source with a target."""
    # Uses of a record are counted first, so that one source's records don't meet in one task.
    per = mixed.groupBy(source, id).agg(F.count("*").alias("u"), F.sum(size).alias("z"))
    got = per.groupBy(source).agg(F.sum("u").alias("n_uses"), F.count("*").alias("n_records"), F.sum("z").alias("total_size"), F.max("u").alias("most_uses"))
    full = targets.select(F.col(source), F.col(weight).alias("target_share")).join(got, source, "left").fillna(0, ["n_uses", "n_records", "total_size", "most_uses"])
    whole = F.sum("total_size").over(Window.partitionBy())
    return full.select(source, "target_share", F.coalesce(F.try_divide("total_size", whole), F.lit(0.0)).alias("actual_share"), "n_uses", "n_records", "total_size", "most_uses")
