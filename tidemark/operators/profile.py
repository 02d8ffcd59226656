"""Profiles of tables: descriptions, correlation, missing values, outliers, quality, recency-frequency-money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def _stack(names: Sequence[str], cells: dict[str, list[Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("name"), *[c[i].alias(k) for k, c in cells.items()]) for i, n in enumerate(names)]))


def _edges(rows: DataFrame, by: Sequence[str], value: str, buckets: int) -> DataFrame:
    """(by, edges): up to buckets - 1 distinct values that part each group's values into ranges of about one size."""
    wanted = [i / buckets for i in range(1, buckets)]
    return rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, wanted, 10 * buckets)).alias("edges"))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """(by, name, share, value): exact quantiles of numeric columns, interpolated between neighbours; nulls don't count.

    Approximate quantiles part the values into ranges; the counts of the ranges tell in which a wanted rank lies. Equal
    values are counted, not repeated, and only values of the ranges that hold a wanted rank are put in order, so no task
    holds a column or a group. NaN counts as the greatest value. Groups without values give no rows.
    """
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.name", "x.v").where("v is not null")
    key = [*by, "name"]
    counted = long.groupBy(*key, "v").agg(F.count("*").alias("c"))
    edges = _edges(long, key, "v", buckets)
    e = edges.select(*[F.col(k).alias(f"__{k}") for k in key], "edges")
    placed = counted.join(e, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]).drop(*[f"__{k}" for k in key])
    placed = placed.withColumn("b", F.size(F.filter("edges", lambda x: x < F.col("v")))).drop("edges")
    sizes = placed.groupBy(*key, "b").agg(F.sum("c").alias("n"))
    # At most buckets rows a group stand in these windows.
    w = Window.partitionBy(*key)
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(w)})
    rank = F.col("share") * (F.col("total") - 1)
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    hit = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    wanted = wanted.withColumns({"lo": F.floor(rank), "hi": F.ceil(rank)}).where(hit(F.col("lo")) | hit(F.col("hi")))
    ranges = wanted.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("b").alias("__b"), "before").distinct()
    values = placed.join(ranges, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], F.col("b") == F.col("__b")]).drop("__b", *[f"__{k}" for k in key])
    inner = Window.partitionBy(*key, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("upto", F.col("before") + F.sum("c").over(inner)).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("b").alias("__b"), "v", "c", "upto")
    met = wanted.join(values, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], F.col("b") == F.col("__b")])
    at = lambda r: F.max(F.when((F.col("upto") > F.col(r)) & (F.col("upto") - F.col("c") <= F.col(r)), F.col("v")))
    ends = met.groupBy(*key, "share", "total").agg(at("lo").alias("a"), at("hi").alias("z"))
    part = rank - F.floor(rank)
    value = F.when(part == 0, F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * part)
    return ends.select(*key, "share", value.alias("value"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, n, mean, std, min, q25, q50, q75, max) of numeric columns; quartiles are exact, interpolated.

    Nulls don't count; a column without values gives nulls. std is the sample's. The quartiles come from quantiles().
    """
    aggs = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}__{i}") for i, c in enumerate(columns) for k, f in aggs.items()])
    plain = row.select(_stack(columns, {k: [F.col(f"{k}__{i}") for i in range(len(columns))] for k in aggs}).alias("x")).select("x.*")
    q = quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("name").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return plain.join(q, "name", "left").select("name", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, r): Pearson correlation of each pair of columns, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"r__{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r__{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")


def rank_correlation(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """(by, r): Spearman correlation with average ranks for ties, per group; rows with a null in either don't count.

    The pairs of values of a group are counted first, and its different values of each column, with their counts, are
    put in order: what a window holds are the values, not the rows.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))

    def ranks(c: str, name: str) -> DataFrame:
        g = pairs.groupBy(F.col(by).alias(f"__k{name}"), F.col(c).alias(f"__v{name}")).agg(F.sum("__n").alias("n"))
        w = Window.partitionBy(f"__k{name}").orderBy(f"__v{name}").rowsBetween(Window.unboundedPreceding, 0)
        return g.select(f"__k{name}", f"__v{name}", (F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / 2).alias(name))

    met = pairs
    for c, name in (("__a", "ra"), ("__b", "rb")):
        met = met.join(ranks(c, name), F.col(by).eqNullSafe(F.col(f"__k{name}")) & (F.col(c) == F.col(f"__v{name}")))
    n, x, y = F.col("__n"), F.col("ra"), F.col("rb")
    g = met.groupBy(by).agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    c = lambda p, q, r: F.col(p) - F.col(q) * F.col(r) / F.col("n")
    return g.select(by, F.try_divide(c("xy", "x", "y"), F.nullif(F.sqrt(c("xx", "x", "x") * c("yy", "y", "y")), F.lit(0.0))).alias("r"))


def missing(df: DataFrame) -> DataFrame:
    """(name, n_rows, n_missing, share) of every column."""
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m__{i}") for i, c in enumerate(df.columns)])
    k = range(len(df.columns))
    return row.select(_stack(df.columns, {"n_rows": [F.col("n") for _ in k], "n_missing": [F.col(f"m__{i}") for i in k], "share": [F.try_divide(F.col(f"m__{i}"), F.col("n")) for i in k]}).alias("x")).select("x.*")


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates) of whole rows or of the columns; copies are counted on both sides of the shuffle."""
    per = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("__c"))
    return per.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def shape(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, skew, kurt): sample skewness and excess kurtosis with the correction for small samples; null under 3 and 4 rows."""
    d = df.groupBy(*by).agg(F.count(column).cast("double").alias("__n"), F.skewness(column).alias("__g"), F.kurtosis(column).alias("__k"))
    n = F.col("__n")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("__g"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__k") + 6))
    return d.select(*by, skew.alias("skew"), kurt.alias("kurt"))


def iqr_outliers(df: DataFrame, column: str, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows of df outside their group's quartiles by more than k quartile ranges, with bounds lo and hi. Null keys are a group."""
    q = quantiles(df, [column], [0.25, 0.75], by).groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max(F.when(F.col("share") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("share") == 0.75, F.col("value"))).alias("q3"))
    bounds = q.select(*[f"__{c}" for c in by], (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"))
    met = df.join(bounds, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True))
    return met.where((F.col(column) < F.col("lo")) | (F.col(column) > F.col("hi"))).select(*df.columns, "lo", "hi")


def z_outliers(df: DataFrame, column: str, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """Rows of df more than k sample deviations from their group's mean, with z."""
    s = df.groupBy(*by).agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.join(s, list(by)).withColumn("z", F.try_divide(F.col(column) - F.col("__m"), F.nullif(F.col("__s"), F.lit(0.0)))).where(F.abs("z") > k).drop("__m", "__s")


def quality(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(completeness, uniqueness, validity, score): shares of non-null cells, of distinct keys and of rows that pass
    all checks, and their mean."""
    ok = F.lit(True)
    for c in checks.values():
        ok = ok & F.coalesce(c, F.lit(False))
    filled = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in df.columns), F.lit(0))
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(filled).alias("f"), F.sum(ok.cast("long")).alias("v"))
    row = per.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("v").alias("v"), F.count("*").alias("d"))
    parts = {"completeness": F.try_divide("f", F.col("n") * len(df.columns)), "uniqueness": F.try_divide("d", "n"), "validity": F.try_divide("v", "n")}
    return row.select(*[c.alias(k) for k, c in parts.items()]).withColumn("score", (F.col("completeness") + F.col("uniqueness") + F.col("validity")) / 3)


def quality_six(df: DataFrame, key: str, *, valid: dict[str, Column], consistent: dict[str, Column], accurate: dict[str, Column], updated: Column, as_of: str, fresh_days: int = 30, weights: dict[str, float] | None = None) -> DataFrame:
    """(completeness, uniqueness, validity, consistency, accuracy, timeliness, score, grade): six shares and their weighted
    mean (equal weights by default), in one aggregation by key and one over it.

    Rows pass valid, consistent and accurate by all conditions of each (null counts as failed); a row is timely if its
    date updated lies at most fresh_days before as_of. grade is good from 0.95, fair from 0.8, else poor. An empty table
    has null shares.
    """
    def every(checks: dict[str, Column]) -> Column:
        ok = F.lit(True)
        for c in checks.values():
            ok = ok & F.coalesce(c, F.lit(False))
        return F.sum(ok.cast("long"))

    filled = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in df.columns), F.lit(0))
    timely = F.coalesce(updated.between(F.date_sub(F.lit(as_of).cast("date"), fresh_days), F.lit(as_of).cast("date")), F.lit(False))
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(filled).alias("f"), every(valid).alias("v"), every(consistent).alias("c"), every(accurate).alias("a"), F.sum(timely.cast("long")).alias("t"))
    row = per.agg(F.sum("n").alias("n"), F.count("*").alias("d"), *[F.sum(x).alias(x) for x in "fvcat"])
    parts = {"completeness": F.try_divide("f", F.col("n") * len(df.columns)), "uniqueness": F.try_divide("d", "n"), "validity": F.try_divide("v", "n"), "consistency": F.try_divide("c", "n"), "accuracy": F.try_divide("a", "n"), "timeliness": F.try_divide("t", "n")}
    w = weights or dict.fromkeys(parts, 1.0)
    score = sum((F.col(k) * w.get(k, 0.0) for k in parts), F.lit(0.0)) / sum(w.values())
    out = row.select(*[c.alias(k) for k, c in parts.items()]).withColumn("score", score)
    return out.withColumn("grade", F.when(F.col("score") >= 0.95, "good").when(F.col("score") >= 0.8, "fair").when(F.col("score").isNotNull(), "poor"))


def rfm(customers: DataFrame, orders: DataFrame, *, customer: str, order: str, day: str, amount: str, as_of: str, tiles: int = 5) -> DataFrame:
    """(customer, recency, frequency, money, r, f, m): days since the last order, orders and spend by as_of, with tiles
    of 1 (worst) to tiles (best). Customers without an order keep a null recency and the lowest tile.

    Ranks are formed in ranges, so no task sorts all customers: see with_tiles().
    """
    o = orders.where(F.col(day) <= F.lit(as_of).cast("date")).groupBy(customer).agg(F.max(day).alias("last"), F.count_distinct(order).alias("frequency"), F.sum(amount).alias("money"))
    d = customers.select(customer).distinct().join(o, customer, "left").select(customer, F.datediff(F.lit(as_of).cast("date"), "last").alias("recency"), F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("money", F.lit(0.0)).alias("money"))
    return with_tiles(d, {"r": -F.coalesce(F.col("recency"), F.lit(10**6)), "f": F.col("frequency"), "m": F.col("money")}, F.col(customer), tiles)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """df with name, the number of each row (from 1) in this order over the whole table.

    Rows are range-partitioned by the order, which parts equal values too, and numbered within the partitions (as many
    as shuffles have, by default), whose counts give each its first number; so no task sorts the table. Rows equal in
    the order are numbered in any order, so the order should be unique. Nulls come first. df is written once in ranges.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(f"__o{i}").asc_nulls_first() for i in range(len(cols))]
    keyed = df.withColumns({f"__o{i}": c for i, c in enumerate(cols)})
    ranged = cut(keyed.repartitionByRange(parts, *keys).withColumn("__b", F.spark_partition_id()))
    sizes = {r["__b"]: r["count"] for r in ranged.groupBy("__b").count().collect()}  # one row a partition
    first, total = [], 0
    for b in sorted(sizes):
        first.append((b, total))
        total += sizes[b]
    firsts = spark.createDataFrame(first, "__b int, __first bigint")
    at = F.col("__first") + F.row_number().over(Window.partitionBy("__b").orderBy(*keys))
    return ranged.join(F.broadcast(firsts), "__b").withColumn(name, at.cast("bigint")).drop("__b", "__first", *[f"__o{i}" for i in range(len(cols))])


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """df with place, the number of each row (from 1) within its group in this order, and n, the rows of the group.

    All rows are numbered in the order of group and order by numbered(), so a big group lies in several ranges and no
    task sorts one; a group's first number is the count of the rows of the groups before it.
    """
    keyed = df.withColumns({f"__g{i}": F.col(c) for i, c in enumerate(by)})
    keys = [f"__g{i}" for i in range(len(by))]
    done = numbered(keyed, [*keys, *order], "__no", parts)
    firsts = done.groupBy(*keys).agg(F.min("__no").alias("__f"), F.count("*").alias("n"))
    firsts = firsts.select(*[F.col(k).alias(f"{k}r") for k in keys], "__f", "n")
    met = done.join(firsts, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys])
    return met.withColumn("place", (F.col("__no") - F.col("__f") + 1).cast("int")).select(*df.columns, "place", "n")


def with_tiles(df: DataFrame, values: dict[str, Column], tie: Column, tiles: int, parts: int | None = None) -> DataFrame:
    """df with, for each name of values, the ntile (1 to tiles) of each row by the value, ties by tie, over the whole table.

    tie should be unique. Rows are numbered by numbered(), value and tie together, so that equal values are spread over
    ranges too and no task sorts the table. Null values come first.
    """
    out = df.withColumns({"__t": tie, **{f"__v_{n}": v.cast("double") for n, v in values.items()}})
    total = df.count()
    small, big = divmod(total, tiles)
    edge = big * (small + 1)
    for n in values:
        out = numbered(out, [f"__v_{n}", "__t"], "__k", parts)
        k = F.col("__k") - 1
        t = F.when(k < edge, F.floor(k / (small + 1))).otherwise(big + F.floor((k - edge) / max(small, 1)))
        out = out.withColumn(n, (t + 1).cast("int"))
    return out.drop("__t", "__k", *[f"__v_{n}" for n in values])


def beta(df: DataFrame, asset: str, market: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, beta, slope): sample covariance over population variance, 1 if the market doesn't move, and the unbiased slope."""
    b = F.coalesce(F.try_divide(F.covar_samp(asset, market), F.nullif(F.var_pop(market), F.lit(0.0))), F.lit(1.0))
    return df.groupBy(*by).agg(b.alias("beta"), F.regr_slope(asset, market).alias("slope"))
