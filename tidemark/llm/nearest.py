"""Pairs of records of two tables that lie nearest in time, within a tolerance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def search(left: pd.DataFrame, right: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    """For each (e, t) of left the row of right with the same e whose t is nearest, at most tolerance away.

    right has one row per (e, t). Of two rows equally near the earlier one counts. Neighbours are found by a binary
    search over all entities at once: entity numbers and times form one ascending key.
    """
    empty = pd.DataFrame({"e": left["e"].iloc[:0], "t": np.zeros(0, np.int64), "rt": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64)})
    if left.empty or right.empty:
        return empty
    codes, _ = pd.factorize(pd.concat([left["e"], right["e"]], ignore_index=True), sort=False)
    lc, rc = codes[: len(left)].astype(np.int64), codes[len(left) :].astype(np.int64)
    lt, rt = left["t"].to_numpy(np.int64), right["t"].to_numpy(np.int64)
    low = min(lt.min(), rt.min())
    span = int(max(lt.max(), rt.max()) - low) + 1
    order = np.argsort(rc * span + (rt - low), kind="stable")
    rc, rt, rid = rc[order], rt[order], right["rid"].to_numpy(np.int64)[order]
    after = np.searchsorted(rc * span + (rt - low), lc * span + (lt - low), side="left")
    far = np.iinfo(np.int64).max

    def distance(at: np.ndarray) -> np.ndarray:
        inside = np.clip(at, 0, len(rt) - 1)
        good = (at >= 0) & (at < len(rt)) & (rc[inside] == lc)
        d = np.abs(rt[inside] - lt)
        return np.where(good & (d <= tolerance), d, far)

    before, behind = distance(after - 1), distance(after)
    at = np.where(before <= behind, after - 1, after)
    ok = np.minimum(before, behind) < far
    return pd.DataFrame({"e": left["e"].to_numpy()[ok], "t": lt[ok], "rt": rt[at[ok]], "rid": rid[at[ok]]})


def nearest_in_time(left: DataFrame, right: DataFrame, *, entity: str, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: int, width: int | None = None, shards: int | None = None, most: int = 500_000) -> DataFrame:
    """(left_id, right_id, distance): each row of left with the row of its entity in right that is nearest in time.

    Times are whole numbers of one unit, in which tolerance (inclusive) and width count too; ids are bigint. Ties: the
    earlier row of right, then the smaller right_id. Rows of left without a partner, and rows of either side with a
    null entity, time or id, are left out; repeated rows count once. Only the named columns are read, so others may
    clash. Empty inputs give an empty result.

    Both sides are cut into ranges of width (by default 16 tolerances) and co-grouped by a hash of the entity and the
    range; right rows are copied into the neighbouring range if they are within tolerance of it, so no pair is missed.
    Within a group all entities are searched at once. Left rows of one entity and time are searched once; right rows
    of one entity and time are reduced to the smallest id first.

    A group of more than most distinct times is split: one of many entities by a further hash of the entity, the times
    of one entity by narrower ranges, each of which gets, besides its own right rows, only the nearest one before and
    the nearest one behind it. So no task holds an unbounded group, and rows are copied no more often for it. Whether
    any group is that big is counted first: the distinct times of both sides are written once, and a job runs.
    """
    spark = left.sparkSession
    width = max(width or 16 * tolerance, tolerance, 1)
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = lambda df, i, t: df.where(F.col(entity).isNotNull() & F.col(t).isNotNull() & F.col(i).isNotNull())
    lrows = known(left, left_id, left_time).select(F.col(entity).cast("string").alias("e"), F.col(left_time).cast("long").alias("t"), F.col(left_id).cast("long").alias("lid"))
    ltimes = cut(lrows.select("e", "t").distinct())
    rtimes = cut(known(right, right_id, right_time).select(F.col(entity).cast("string").alias("e"), F.col(right_time).cast("long").alias("t"), F.col(right_id).cast("long").alias("rid")).groupBy("e", "t").agg(F.min("rid").alias("rid")))
    ranged = lambda c: F.floor(c / F.lit(width)).cast("long")
    lg = ltimes.select("e", "t", ranged(F.col("t")).alias("b"))
    rg = rtimes.select("e", "t", "rid", F.explode(F.sequence(ranged(F.col("t") - tolerance), ranged(F.col("t") + tolerance))).alias("b"))
    shard = F.pmod(F.xxhash64("e"), F.lit(shards))
    counts = lg.select("e", "b").unionByName(rg.select("e", "b")).groupBy("e", "b").agg(F.count("*").alias("n"))

    def solve(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        return search(lp, rp, tolerance)

    def answered(lg: DataFrame, rg: DataFrame, keys: list[str]) -> DataFrame:
        # A left time lies in one group, so it is answered once.
        best = lg.select(*keys, "e", "t").groupBy(*keys).cogroup(rg.select(*keys, "e", "t", "rid").groupBy(*keys)).applyInPandas(solve, "e string, t long, rt long, rid long")
        return lrows.join(best, ["e", "t"]).select(F.col("lid").alias(left_id), F.col("rid").alias(right_id), F.abs(F.col("rt") - F.col("t")).alias("distance")).distinct()

    if (counts.groupBy(shard, "b").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
        return answered(lg.withColumn("s", shard), rg.withColumn("s", shard), ["s", "b"])
    hot = counts.where(F.col("n") > most).select("e", "b", F.ceil(F.col("n") / most).cast("long").alias("k"))
    full = counts.where(F.col("n") <= most).groupBy(shard.alias("s"), "b").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("s", "b", F.ceil(F.col("n") / most).cast("long").alias("m"))
    keys = ["s", "b", "own", "x", "j"]

    def placed(df: DataFrame) -> DataFrame:
        """df with its group: of a hot entity (own) the narrower range j, of others the part x of the shard."""
        d = df.join(hot, ["e", "b"], "left").withColumn("s", shard).join(full, ["s", "b"], "left")
        alone = F.col("k").isNotNull()
        j = F.floor((F.col("t") - F.col("b") * width) * F.col("k") / width).cast("long")
        return d.withColumns({"own": F.when(alone, F.col("e")).otherwise(""), "x": F.when(alone, 0).otherwise(F.pmod(F.xxhash64("e", F.lit(1)), F.coalesce("m", F.lit(1)))), "j": F.when(alone, j).otherwise(0)}).drop("k", "m")

    lg, rg = placed(lg), placed(rg)
    # What the narrower ranges of a hot entity hold, one row each: these few rows are put in order to find neighbours.
    ends = rg.where("own <> ''").groupBy(*keys, "e").agg(F.min(F.struct("t", "rid")).alias("first"), F.max(F.struct("t", "rid")).alias("last"))
    ends = lg.where("own <> ''").select(*keys, "e").distinct().withColumn("asks", F.lit(True)).join(ends, [*keys, "e"], "full")
    upto = lambda c: Window.partitionBy("e", "b").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"before": F.last("last", True).over(upto(F.col("j"))), "behind": F.last("first", True).over(upto(F.col("j").desc()))}).where("asks")
    beside = ends.select(*keys, "e", F.explode(F.array_compact(F.array("before", "behind"))).alias("y")).select(*keys, "e", "y.t", "y.rid")
    columns = [*keys, "e", "t", "rid"]
    return answered(lg, rg.select(*columns).unionByName(beside.select(*columns)), keys)
