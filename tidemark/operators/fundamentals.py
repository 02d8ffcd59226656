"""Statement figures: ratios, ratings against benchmark rows, bridges and surprises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio, zero_ratio

# Numerator and denominator of each ratio, over the flat statement columns.
PLAIN = {
    "roe": ("net_income", "shareholders_equity"), "roa": ("net_income", "total_assets"), "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"), "current_ratio": ("current_assets", "current_liabilities"),
    "cash_ratio": ("cash_and_equivalents", "current_liabilities"), "debt_to_equity": ("total_debt", "shareholders_equity"), "interest_coverage": ("ebit", "interest_expense"), "asset_turnover": ("revenue", "total_assets"),
    "inventory_turnover": ("cost_of_goods_sold", "inventory"), "receivables_turnover": ("revenue", "accounts_receivable"), "eps": ("net_income", "shares_outstanding"), "book_value_per_share": ("shareholders_equity", "shares_outstanding"),
}


def ratios(df: DataFrame, zero: bool = True) -> DataFrame:
    """df with the profitability, liquidity, leverage, efficiency and valuation ratios.

    Missing statement columns and null cells count as 0 and a zero denominator gives 0; with zero=False both give null.
    peg is null unless growth is positive.
    """
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    div = zero_ratio if zero else ratio
    n = (lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))) if zero else (lambda c: col(c).cast("double"))
    out = {k: div(n(a), n(b)) for k, (a, b) in PLAIN.items()}
    out["gross_margin"] = div(n("revenue") - n("cost_of_goods_sold"), n("revenue"))
    out["quick_ratio"] = div(n("current_assets") - n("inventory"), n("current_liabilities"))
    out["debt_service_coverage"] = div(n("operating_income"), n("interest_expense") + n("current_portion_long_term_debt"))
    cap = n("share_price") * n("shares_outstanding")
    out["days_sales_outstanding"] = div(F.lit(365.0), out["receivables_turnover"])
    out["pe"] = div(n("share_price"), out["eps"])
    out["pb"] = div(n("share_price"), out["book_value_per_share"])
    out["ps"] = div(cap, n("revenue"))
    out["ev_to_ebitda"] = div(cap + n("total_debt") - n("cash_and_equivalents"), n("ebitda"))
    out["peg"] = F.when(n("earnings_growth_rate") > 0, div(out["pe"], n("earnings_growth_rate") * 100))
    return df.withColumns(out)


def long_ratios(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, ratio, value)."""
    return df.unpivot(keys, names, "ratio", "value")


def rated(long: DataFrame, benchmarks: DataFrame, industry: str = "industry") -> DataFrame:
    """long with rating by the benchmark rows (industry, ratio, excellent, good, acceptable, higher) of its industry, or
    of 'general' where the industry has none. Ratios without a row are 'unrated', null values 'unknown'."""
    b = benchmarks.select(industry, "ratio", F.struct("excellent", "good", "acceptable", "higher").alias("b"))
    general = b.where(F.col(industry) == "general").select("ratio", F.col("b").alias("g"))
    d = long.join(b, [industry, "ratio"], "left").join(general, "ratio", "left").withColumn("b", F.coalesce("b", "g"))
    v, up = F.col("value"), F.col("b.higher")
    meets = lambda level: F.when(up, v >= F.col(f"b.{level}")).otherwise(v <= F.col(f"b.{level}"))
    rating = F.when(v.isNull(), "unknown").when(F.col("b").isNull(), "unrated").when(meets("excellent"), "excellent").when(meets("good"), "good").when(meets("acceptable"), "acceptable").otherwise("poor")
    return d.withColumn("rating", rating).drop("b", "g")


def health(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, band): mean of 4 (excellent) to 1 (poor), others 2."""
    s = F.when(F.col("rating") == "excellent", 4).when(F.col("rating") == "good", 3).when(F.col("rating") == "acceptable", 2).when(F.col("rating") == "poor", 1).otherwise(2)
    g = ratings.groupBy(*keys).agg(F.avg(s).alias("score"))
    return g.withColumn("band", F.when(F.col("score") >= 3.5, "excellent").when(F.col("score") >= 2.5, "good").when(F.col("score") >= 1.5, "fair").otherwise("poor"))


def trend(df: DataFrame, keys: list[str], period: str, value: str, lower_is_better: Column | None = None) -> DataFrame:
    """(keys, first, last, change_pct, trend): last against first by period, stable within 5 %."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"))
    c = ratio(F.col("last") - F.col("first"), F.abs(F.col("first"))) * 100
    signed = F.when(lower_is_better, -F.col("change_pct")).otherwise(F.col("change_pct")) if lower_is_better is not None else F.col("change_pct")
    return g.withColumn("change_pct", c).withColumn("trend", F.when(F.col("change_pct").isNull(), "unknown").when(F.abs("change_pct") <= 5, "stable").when(signed > 0, "improving").otherwise("deteriorating"))


def bridge(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step_no, step, amount, kind) from revenue to net income in eight steps that add up.

    What neither costs, expenses nor taxes explain is the 'other' step, so the last total always reconciles.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    pretax = F.coalesce(F.col("incomeBeforeTax").cast("double"), F.col("netIncome").cast("double") + n("incomeTaxExpense"))
    steps = [
        ("revenue", n("revenue"), "total"), ("cost of revenue", -n("costOfRevenue"), "step"), ("gross profit", n("revenue") - n("costOfRevenue"), "total"), ("operating expenses", -n("operatingExpenses"), "step"),
        ("operating income", n("revenue") - n("costOfRevenue") - n("operatingExpenses"), "total"), ("other", pretax - (n("revenue") - n("costOfRevenue") - n("operatingExpenses")), "step"), ("income tax", n("netIncome") - pretax, "step"), ("net income", n("netIncome"), "total"),
    ]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"), a.alias("amount"), F.lit(k).alias("kind")) for i, (s, a, k) in enumerate(steps)])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def surprise(actual: Column, estimate: Column) -> Column:
    """Percent by which actual exceeds estimate, by the estimate's absolute value."""
    return ratio(actual - estimate, F.abs(estimate)) * 100


def segment_matrix(df: DataFrame, *, entity: str, year: str, data: str, last: int) -> DataFrame:
    """(entity, year, segment, amount) of each entity's last years, zero-filled, without segments that are zero throughout.

    data is a map of segment to amount. The long form keeps one schema whatever the segments.
    """
    years = df.groupBy(entity).agg(F.slice(F.reverse(F.array_sort(F.collect_set(year))), 1, last).alias("ys"))
    d = df.select(entity, year, F.explode(data).alias("segment", "amount")).join(years, entity).where(F.array_contains("ys", F.col(year)))
    sums = d.groupBy(entity, year, "segment").agg(F.sum("amount").alias("amount"))
    live = sums.groupBy(entity, "segment").agg(F.sum(F.abs("amount")).alias("s")).where("s > 0").select(entity, "segment")
    grid = live.join(years.select(entity, F.explode("ys").alias(year)), entity)
    return grid.join(sums, [entity, year, "segment"], "left").select(entity, year, "segment", F.coalesce("amount", F.lit(0)).alias("amount"))


# For each ratio the words above each bound, from the greatest down, and those below all of them.
WORDS = {
    "current_ratio": ([(2.0, "Strong liquidity"), (1.5, "Adequate liquidity"), (1.0, "Potential liquidity concerns")], "Liquidity issues"),
    "roe": ([(0.20, "Excellent returns"), (0.15, "Good returns"), (0.10, "Average returns"), (0.0, "Below average returns")], "Negative returns"),
}
# For each ratio the words below each bound, from the least up, and those from the last bound on.
WORDS_BELOW = {
    "debt_to_equity": ([(0.5, "Low leverage"), (1.0, "Moderate leverage"), (2.0, "High leverage")], "Very high leverage"),
    "pe": ([(15.0, "Potentially undervalued"), (25.0, "Fair value"), (40.0, "Growth premium")], "High valuation"),
}


def interpretation(ratio_name: str, value: Column) -> Column:
    """What a ratio's value says in words; ratios without words say so, null gives null."""
    if ratio_name in WORDS:
        levels, rest = WORDS[ratio_name]
        out = F.lit(rest)
        for bound, words in reversed(levels):
            out = F.when(value > bound, words).otherwise(out)
    elif ratio_name in WORDS_BELOW:
        levels, rest = WORDS_BELOW[ratio_name]
        out = F.lit(rest)
        for bound, words in reversed(levels):
            out = F.when(value < bound, words).otherwise(out)
        if ratio_name == "pe":
            out = F.when(value <= 0, "N/A (negative earnings)").otherwise(out)
    else:
        out = F.lit("No interpretation available")
    return F.when(value.isNotNull(), out)


def interpreted(long: DataFrame) -> DataFrame:
    """long ratios (ratio, value) with interpretation."""
    out = F.when(F.col("value").isNotNull(), F.lit("No interpretation available"))
    for name in [*WORDS, *WORDS_BELOW]:
        out = F.when(F.col("ratio") == name, interpretation(name, F.col("value"))).otherwise(out)
    return long.withColumn("interpretation", out)


def summary_text(roe: Column, current: Column, leverage: Column, pe: Column) -> Column:
    """Up to four sentences on returns, liquidity, leverage and price, those whose ratio is known and in its range."""
    text = [
        F.when(roe > 0, F.format_string("ROE of %.1f%% indicates %s shareholder returns.", roe * 100, F.when(roe > 0.15, "strong").otherwise("moderate"))),
        F.when(current > 0, F.format_string("Current ratio of %.2f suggests %s.", current, F.when(current > 1.5, "good liquidity position").otherwise("potential liquidity concerns"))),
        F.when(leverage >= 0, F.format_string("Debt-to-equity of %.2f indicates %s leverage.", leverage, F.when(leverage < 0.5, "conservative").when(leverage < 1, "moderate").otherwise("high"))),
        F.when(pe > 0, F.format_string("P/E ratio of %.1f suggests the stock is trading at %s.", pe, F.when(pe < 15, "a discount").when(pe < 25, "fair value").otherwise("a premium"))),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" ", *text), F.lit("")), F.lit("Insufficient data for summary."))


def recommendations(ratings: DataFrame, trends: DataFrame, keys: list[str], advice: DataFrame, most: int = 5) -> DataFrame:
    """(keys, place, recommendation): for each key first its poor ratios by name with the advice on them (ratio, advice),
    then its deteriorating trends (ratio, trend), at most so many; two general ones where there are neither."""
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    poor = ratings.where("rating = 'poor'").join(advice.select("ratio", "advice"), "ratio", "left").select(*keys, F.lit(1).alias("kind"), "ratio", F.concat(F.lit("Priority: Address "), words("ratio"), F.lit(" - "), F.coalesce("advice", F.lit(""))).alias("recommendation"))
    down = trends.where("trend = 'deteriorating'").select(*keys, F.lit(2).alias("kind"), "ratio", F.concat(F.lit("Monitor: "), words("ratio"), F.lit(" showing negative trend")).alias("recommendation"))
    some = poor.unionByName(down)
    calm = ratings.select(*keys).distinct().join(some.select(*keys).distinct(), keys, "left_anti")
    general = F.array(F.lit("Continue current financial management practices"), F.lit("Consider strategic growth opportunities"))
    calm = calm.select(*keys, F.posexplode(general).alias("n", "recommendation")).select(*keys, F.lit(3).alias("kind"), F.col("n").cast("string").alias("ratio"), "recommendation")
    w = Window.partitionBy(*keys).orderBy("kind", "ratio")
    return some.unionByName(calm).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*keys, "place", "recommendation")
