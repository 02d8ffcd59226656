"""Statistical tests and rank measures as aggregations, and models of Spark's own library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def welch(df: DataFrame, *, group: str, a, b, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean_a, mean_b, t, freedom): Welch's test between the groups a and b; null under two values in either."""
    side = lambda f, g: f(F.when(F.col(group) == g, F.col(value).cast("double")))
    d = df.groupBy(*by).agg(*[side(f, g).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    sa, sb = F.try_divide("va", F.nullif("na", F.lit(0))), F.try_divide("vb", F.nullif("nb", F.lit(0)))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.nullif(F.sqrt(sa + sb), F.lit(0.0)))
    freedom = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1))
    ok = (F.col("na") > 1) & (F.col("nb") > 1)
    return d.select(*by, F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), F.when(ok, t).alias("t"), F.when(ok, freedom).alias("freedom"))


def anova(df: DataFrame, *, group: str, value: str) -> DataFrame:
    """(n_groups, n_rows, f): one-way analysis of variance, from one row per group."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("m"), F.var_pop(F.col(value).cast("double")).alias("v"))
    w = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("inside"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = F.try_divide(between / (F.col("k") - 1), F.nullif(F.col("inside") / (F.col("n") - F.col("k")), F.lit(0.0)))
    return w.select(F.col("k").alias("n_groups"), F.col("n").alias("n_rows"), F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), f).alias("f"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n_rows, freedom, chi2): independence of two columns, from the counts of their pairs; absent pairs count as zero."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    ra, rb = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("rb"))
    whole = c.agg(F.sum("n").alias("t"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    # chi2 = t * (sum of n² / (ra * rb) - 1), in which absent pairs are zero by themselves.
    parts = c.join(ra, a).join(rb, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("q"))
    return whole.join(F.broadcast(parts)).select(F.col("t").cast("bigint").alias("n_rows"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("freedom"), (F.col("t") * (F.col("q") - 1)).alias("chi2"))


def point_biserial(df: DataFrame, flag: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, r): correlation of a boolean with a number."""
    return df.groupBy(*by).agg(F.corr(F.col(flag).cast("double"), F.col(value).cast("double")).alias("r"))


def kendall(df: DataFrame, a: str, b: str, by: Sequence[str], grid: int = 64) -> DataFrame:
    """(by, tau): Kendall's tau-b over the distinct values of a and b of each group, with their counts.

    Both columns should have few values (ratings, ranks, buckets): a group's table of values, not its rows, is compared
    with itself, and a group with more than grid values in either column fails the query.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    c = d.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("n"))
    wide = c.groupBy(*by).agg(F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    wide = wide.where(F.when((F.col("kx") > grid) | (F.col("ky") > grid), F.raise_error(F.lit(f"more than {grid} values")).cast("boolean")).otherwise(True))
    # Counts of the values below and beside each cell, by running sums over the table in order.
    upto = Window.partitionBy(*by, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    xs, ys = c.select(*by, "x").distinct(), c.select(*by, "y").distinct()
    full = xs.join(ys, list(by)).join(c, [*by, "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    left = full.withColumn("row_below", F.coalesce(F.sum("n").over(upto), F.lit(0.0)))
    lower = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(*by, "x").orderBy(F.col("y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumns({"agree": F.coalesce(F.sum("row_below").over(lower), F.lit(0.0)), "differ": F.coalesce(F.sum("row_below").over(higher), F.lit(0.0))})
    pairs = left.groupBy(*by).agg(F.sum(F.col("n") * F.col("agree")).alias("p"), F.sum(F.col("n") * F.col("differ")).alias("q"), F.sum("n").alias("t"))
    ties = lambda k, n: c.groupBy(*by, k).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(n))
    all_ = F.col("t") * (F.col("t") - 1) / 2
    tau = F.try_divide(F.col("p") - F.col("q"), F.nullif(F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty"))), F.lit(0.0)))
    return pairs.join(wide, list(by)).join(ties("x", "tx"), list(by)).join(ties("y", "ty"), list(by)).select(*by, tau.alias("tau"))


def clusters(df: DataFrame, *, id: str, vector: str, k: int, seed: int = 7, rounds: int = 20) -> DataFrame:
    """(id, cluster) by k-means; rows with a null vector are left out. The same seed gives the same clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.where(F.col(vector).isNotNull()).select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(d).transform(d).select(id, "cluster")


def components(df: DataFrame, *, id: str, vector: str, k: int) -> DataFrame:
    """(id, components): the first k principal components of each vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.where(F.col(vector).isNotNull()).select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(d).transform(d).select(id, vector_to_array("__p").alias("components"))


def item_rules(df: DataFrame, *, items: str, support: float, confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence, lift, support) of item lists by frequent patterns; items of a row count once."""
    from pyspark.ml.fpm import FPGrowth

    d = df.where(F.col(items).isNotNull()).select(F.array_distinct(items).alias("items"))
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(d).associationRules
