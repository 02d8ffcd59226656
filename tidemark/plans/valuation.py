"""Queries over statements and valuation models. The lines of a supplier make up its figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric, strings
from tidemark.operators import fundamentals, models, reports
from tidemark.sources.tables import table


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    """Supplier, base revenue in thousands, shares and net debt."""
    li = table(s, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice")
    g = li.groupBy(F.col("l_suppkey").alias("supplier")).agg((F.round(F.sum("l_extendedprice")) / 1000).alias("base_revenue"), F.sum("l_quantity").alias("shares"))
    return g.withColumn("net_debt", F.col("base_revenue") * 0.2)


def _r(*names: str, to: int = 4) -> list:
    return [F.round(n, to).alias(n) for n in names]


_VALUES = ("pv_fcf", "terminal", "ev", "per_share", "terminal_pct")


def dcf_grid(s: SparkSession, d: str) -> DataFrame:
    """Every supplier's value for each pair of capital cost and terminal growth; undefined pairs are null."""
    cases = models.with_defaults(_suppliers(s, d).withColumn("margin", F.lit(0.22)))
    cases = models.grid(cases, {"wacc": [0.07, 0.08, 0.025], "terminal_growth": [0.02, 0.03]})
    return models.enterprise_value(cases, ["supplier", "wacc", "terminal_growth"]).select("supplier", "wacc", "terminal_growth", *_r(*_VALUES))


def dcf_multiple(s: SparkSession, d: str) -> DataFrame:
    """Rates of each year as arrays, terminal value by a multiple: the supplier's own or the default."""
    rates = {"growth": [0.10, 0.08, -0.05], "margin": [0.2, 0.21], "capex_pct": [0.05, 0.06, 0.05], "nwc_pct": [0.1, 0.12, 0.11]}
    cases = _suppliers(s, d).withColumns({k: F.array(*map(F.lit, v)) for k, v in rates.items()}).withColumns({"wacc": F.lit(0.09), "years": F.lit(3), "exit_multiple": F.when(F.col("supplier") % 2 == 0, 8.0)})
    cases = cases.withColumns({"tax": F.lit(0.25), "terminal_growth": F.lit(0.03)})
    return models.enterprise_value(cases, ["supplier"], method="multiple").select("supplier", *_r(*_VALUES))


def past_margins(s: SparkSession, d: str) -> DataFrame:
    """By supplier and ship year; years whose lines are all fully discounted would have no margin."""
    li = table(s, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_shipdate")
    y = li.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).otherwise(0.0)).alias("rev"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("ebitda"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("capex"))
    return models.historical_margins(y, ["l_suppkey"], year="y", revenue="rev", ebitda="ebitda", capex="capex").select("l_suppkey", F.round("base_revenue", 2).alias("base_revenue"), *_r("mean_margin", "mean_capex_pct"), "n_years", "n_unusable")


def default_cases(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").select("c_custkey", F.when(F.col("c_acctbal") > 0, 0.04).alias("growth"), F.when(F.col("c_nationkey") < 10, 0.3).alias("margin"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey") / 100).alias("past"))
    return models.with_defaults(c, history_margin="past").select("c_custkey", "growth", "margin", "capex_pct", "nwc_pct", "tax", "terminal_growth", "years", "exit_multiple")


def outlook(s: SparkSession, d: str) -> DataFrame:
    sc = s.createDataFrame([("bear", 0.5, 0.4), ("base", 1.0, 0.9), ("bull", 1.3, 1.2)], "name string, first double, second double")
    c = _suppliers(s, d).withColumns({"cagr": (F.col("supplier") % 7 - 2) / 20, "gross_margin": F.lit(45.0), "net_margin": (F.col("supplier") % 5 - 1) * 4.0, "price": F.lit(30.0), "cap": F.col("shares") * 30})
    return models.outlook(c, sc).select("supplier", "scenario", *_r("growth1", "revenue1", "revenue2", "gross1", "income2", "eps1", "eps2", "pe1", "pe2", "ps1", "ps2", to=3))


def price_table(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part", "p_partkey", "p_retailprice")
    return models.data_table(p, ["p_partkey"], ("volume", [10, 20.5]), ("discount", [0.0, 0.05, 0.25]), lambda: F.round(F.col("p_retailprice") * F.col("volume") * (1 - F.col("discount")), 4))


def scenarios(s: SparkSession, d: str) -> DataFrame:
    """Each customer's orders are scenarios with odd probabilities, in a table of their own."""
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_custkey % 2 = 0")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    o = o.join(n, "o_custkey").select("o_custkey", F.col("o_orderkey").cast("string").alias("scenario"), "o_totalprice", F.when(F.col("o_custkey") % 2 == 0, 1 / (F.col("n") + 0.37)).alias("p"))
    return models.scenario_table(o, ["o_custkey"], "scenario", "o_totalprice", "p").select("o_custkey", "scenario", F.round("o_totalprice", 3).alias("value"), *_r("p"), F.round("weighted", 3).alias("weighted"))


def scenario_value(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_custkey", "o_orderkey", F.sqrt("o_totalprice").alias("v")).withColumn("p", F.when(F.col("o_custkey") % 3 == 0, 0.1))
    return models.expected(o, ["o_custkey"], "v", "p").select("o_custkey", F.round("expected", 4).alias("expected"))


_CASE = lambda: F.col("revenue") * F.col("margin") * F.col("multiple")


def _part_cases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.col("p_retailprice").alias("revenue"), F.lit(0.2).alias("margin"), (F.col("p_size") + 1).cast("double").alias("multiple"))


def tornado(s: SparkSession, d: str) -> DataFrame:
    """For each part the variables by their impact, the greatest first."""
    t = models.tornado(_part_cases(s, d), ["p_partkey"], {"revenue": (800, 1200), "margin": (0.15, 0.22), "multiple": (8, 13)}, _CASE)
    return models.by_impact(t, ["p_partkey"]).select("p_partkey", "place", "variable", *_r("at_low", "at_high", "impact"))


def margin_sweep(s: SparkSession, d: str) -> DataFrame:
    return models.sweep(_part_cases(s, d), "margin", 0.1, 0.3, 5, _CASE).select("p_partkey", *_r("margin", "output", "output_change"))


def _deals(s: SparkSession, d: str) -> DataFrame:
    """Each supplier buys the one with the next number."""
    b = _suppliers(s, d).select("supplier", "shares", (F.col("base_revenue") * 0.1).alias("income"))
    t = b.select((F.col("supplier") - 1).alias("supplier"), F.col("shares").alias("t_shares"), F.col("income").alias("t_income"))
    fixed = {"a_price": 50.0, "t_price": 25.0, "offer": 30.0, "cash_pct": 0.6, "stock_pct": 0.4, "debt_part": 0.5, "debt_rate": 0.06, "cash_yield": 0.03, "fee": 2.0, "tax": 0.25, "synergies": 50.0, "intangibles": 300.0}
    deals = b.join(t, "supplier").withColumnsRenamed({"shares": "a_shares", "income": "a_income"}).withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({"years": F.lit(10), "deductible": F.col("supplier") % 2 == 0})
    return models.merger(deals)


def merger_table(s: SparkSession, d: str) -> DataFrame:
    return _deals(s, d).select("supplier", *_r("equity_value", "new_shares", "proforma_eps", "accretion", "breakeven_synergies"))


def flow_growth(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    return o.select("o_custkey", F.round(numeric.flow_cagr(F.transform("x", lambda v: v["o_totalprice"] - 100000)), 6).alias("growth"))


def capital_cost(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part", "p_partkey", "p_size", "p_retailprice")
    return p.select("p_partkey", F.round(models.cost_of_capital(F.lit(0.04), F.col("p_size") / 25, F.lit(0.07), F.lit(0.05), F.col("p_retailprice") / 2000, F.lit(0.25)), 6).alias("wacc"))


def _statements(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x = F.col("l_extendedprice")
    g = li.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.sum(x).alias("revenue"), F.sum(x * F.col("l_discount")).alias("net_income"), F.sum(x * F.col("l_tax")).alias("cost_of_goods_sold"), F.sum("l_quantity").alias("shares_outstanding"))
    r, i = F.col("revenue"), F.col("supplier")
    made = {
        "shareholders_equity": r * ((i % 9 + 1) / 30), "total_assets": r * 2, "share_price": F.lit(30.0), "operating_income": r * 0.12, "ebit": r * 0.11, "ebitda": r * 0.15, "current_assets": r * ((i % 5 + 1) / 5), "current_liabilities": r * 0.4,
        "cash_and_equivalents": r * 0.1, "inventory": r * 0.15, "total_debt": r * ((i % 4) / 11), "interest_expense": r * 0.01, "current_portion_long_term_debt": r * 0.02, "accounts_receivable": r * 0.3, "earnings_growth_rate": (i % 3 - 1) / 10,
    }
    return fundamentals.ratios(g.withColumns(made))


_ALL = ["operating_margin", "current_ratio", "quick_ratio", "cash_ratio", "debt_to_equity", "interest_coverage", "debt_service_coverage", "inventory_turnover", "receivables_turnover", "days_sales_outstanding", "book_value_per_share", "ev_to_ebitda", "peg"]


def all_ratios(s: SparkSession, d: str) -> DataFrame:
    """The ratios that statement_ratios leaves out."""
    return _statements(s, d).select("supplier", *_r(*_ALL))


def ratio_words(s: SparkSession, d: str) -> DataFrame:
    long = fundamentals.long_ratios(_statements(s, d), ["supplier"], ["roe", "current_ratio", "debt_to_equity", "pe", "quick_ratio"])
    return fundamentals.interpreted(long).select("supplier", "ratio", F.round("value", 4).alias("value"), "interpretation")


def ratio_summary(s: SparkSession, d: str) -> DataFrame:
    return _statements(s, d).select("supplier", fundamentals.summary_text(F.col("roe"), F.col("current_ratio"), F.col("debt_to_equity"), F.col("pe")).alias("summary"))


def recommendations(s: SparkSession, d: str) -> DataFrame:
    """Suppliers with a negative balance, a large key or a nation divisible by three get advice."""
    p = table(s, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    rating = lambda c: F.when(c, "poor").otherwise("good")
    r = p.select("s_suppkey", F.explode(F.array(F.struct(F.lit("cash_ratio").alias("ratio"), rating(F.col("s_acctbal") < 3000).alias("rating")), F.struct(F.lit("net_margin").alias("ratio"), rating(F.col("s_suppkey") % 4 == 0).alias("rating")))).alias("x")).select("s_suppkey", "x.*")
    t = p.select("s_suppkey", F.lit("debt_to_equity").alias("ratio"), F.when(F.col("s_nationkey") % 3 == 0, "deteriorating").otherwise("stable").alias("trend"))
    advice = s.createDataFrame([("cash_ratio", "hold more cash")], "ratio string, advice string")
    return fundamentals.recommendations(r, t, ["s_suppkey"], advice, most=2)


def revenue_trend(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem", "l_suppkey", "l_extendedprice", "l_shipdate").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_extendedprice").alias("v"))
    return fundamentals.trend(li, ["l_suppkey"], "y", "v", F.col("l_suppkey") % 2 == 0).select("l_suppkey", *_r("change_pct"), "trend")


def texts(s: SparkSession, d: str) -> DataFrame:
    """The number formats side by side."""
    p = table(s, d, "part", "p_partkey", "p_retailprice", "p_size")
    x = F.col("p_retailprice")
    y = F.when(F.col("p_size") > 5, (F.col("p_size") - 20) / 7)
    return p.select(
        "p_partkey", strings.ratio_text(x / 1000, "percentage").alias("a"), strings.ratio_text(x, "currency").alias("b"), strings.ratio_text(y, "times").alias("c"), strings.ratio_text(x / 3, "days").alias("e"),
        strings.axis_text(y, percent=True).alias("f"), strings.axis_text(F.col("p_size") - 20, currency="$", unit="M").alias("g"), strings.money_text(F.when(F.col("p_size") > 5, x)).alias("h"),
    )


def value_texts(s: SparkSession, d: str) -> DataFrame:
    """The sentence of every supplier's value; those with an even number have no value."""
    cases = models.with_defaults(_suppliers(s, d)).withColumn("wacc", F.when(F.col("supplier") % 2 == 0, 0.02).otherwise(0.08))
    v = models.enterprise_value(cases, ["supplier"])
    return v.select("supplier", models.value_text(F.col("supplier")).alias("text"))


def deal_texts(s: SparkSession, d: str) -> DataFrame:
    return _deals(s, d).select("supplier", models.deal_text(F.col("supplier")).alias("text"))


_KINDS = {"net_margin": "percentage", "current_ratio": "times", "days_sales_outstanding": "days", "book_value_per_share": "currency"}


def ratio_report(s: SparkSession, d: str) -> DataFrame:
    """Ratios in long form with their text and words."""
    long = fundamentals.interpreted(fundamentals.long_ratios(_statements(s, d), ["supplier"], list(_KINDS)))
    text = F.lit(None).cast("string")
    for name, kind in _KINDS.items():
        text = F.when(F.col("ratio") == name, strings.ratio_text(F.col("value"), kind)).otherwise(text)
    return long.select("supplier", "ratio", text.alias("text"), "interpretation")


def outlook_table(s: SparkSession, d: str) -> DataFrame:
    """The scenarios side by side."""
    return outlook(s, d).groupBy("supplier").pivot("scenario", ["bear", "base", "bull"]).agg(F.first("revenue2")).select("supplier", "bear", "base", "bull")


def margin_series(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_extendedprice").alias("r"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("i"))
    return reports.margins(li, entity="l_suppkey", period="y", revenue="r", parts={"income": "i"}, last=3).select("l_suppkey", "y", *_r("revenue", "income", "income_margin"), "divisor")


def flagged_days(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    prices = o.groupBy("o_orderpriority", "day").agg(F.max("o_totalprice").alias("price"))
    return reports.flagged_prices(prices, o.where("o_totalprice > 480000").withColumn("title", F.concat(F.lit("big "), "o_orderstatus")), entity="o_orderpriority", day="day", title="title")


QUERIES = {f.__name__: f for f in (dcf_grid, dcf_multiple, past_margins, default_cases, outlook, price_table, scenarios, scenario_value, tornado, margin_sweep, merger_table, flow_growth, capital_cost, all_ratios, ratio_words, ratio_summary, recommendations, revenue_trend)}
QUERIES |= {f.__name__: f for f in (value_texts, deal_texts, ratio_report, outlook_table, margin_series, flagged_days)}
QUERIES["number_texts"] = texts

_S = "WITH s AS (SELECT l_suppkey AS supplier, round(sum(l_extendedprice)) / 1000 AS base, sum(l_quantity) AS sh FROM lineitem GROUP BY 1)"
_G = "WITH g AS (SELECT l_suppkey AS supplier, sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS ni, sum(l_extendedprice * l_tax) AS cogs, sum(l_quantity) AS sh, l_suppkey AS i FROM lineitem GROUP BY 1), r AS (SELECT supplier, ni / (rev * ((i % 9 + 1) / 30)) AS roe, ((i % 5 + 1) / 5) / 0.4 AS cr, ((i % 4) / 11) / ((i % 9 + 1) / 30) AS de, 30 / (ni / sh) AS pe, (((i % 5 + 1) / 5) - 0.15) / 0.4 AS qr, g.* EXCLUDE (supplier) FROM g)"
_DCF = " SELECT supplier{keys}, round(pv, 4) AS pv_fcf, round(tv, 4) AS terminal, round(pv + tv, 4) AS ev, round((pv + tv - base * 0.2) / sh, 4) AS per_share, round(tv / (pv + tv) * 100, 4) AS terminal_pct FROM e"
SQL = {
    "dcf_grid": _S + ", w(wacc) AS (VALUES (0.07::DOUBLE), (0.08::DOUBLE), (0.025::DOUBLE)), tg(terminal_growth) AS (VALUES (0.02::DOUBLE), (0.03::DOUBLE)), y AS (SELECT unnest(range(1, 6)) AS t), f AS (SELECT s.*, t, base * pow(1.1, t) * (0.22 - 0.05) * 0.75 - (base * pow(1.1, t) * 0.10 - CASE WHEN t = 1 THEN base * 0.1 ELSE base * pow(1.1, t - 1) * 0.10 END) AS fcf FROM s, y), p AS (SELECT supplier, base, sh, wacc, terminal_growth, sum(fcf / pow(1 + wacc, t)) AS pv, max(fcf) FILTER (WHERE t = 5) AS l FROM w, tg, f GROUP BY ALL), e AS (SELECT *, CASE WHEN wacc > terminal_growth THEN l * (1 + terminal_growth) / (wacc - terminal_growth) / pow(1 + wacc, 5) END AS tv FROM p)" + _DCF.format(keys=", wacc, terminal_growth"),
    "dcf_multiple": _S + ", y(t, g, m, c, n, k, nb) AS (VALUES (1, 1.10::DOUBLE, 0.2::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE, 0.1::DOUBLE), (2, 1.08, 0.21, 0.06, 0.12, 1.10, 0.1), (3, 0.95, 0.21, 0.05, 0.11, 1.188, 0.12)), f AS (SELECT s.*, t, base * k * g * m AS ebitda, base * k * g * (m - c) * 0.75 - (base * k * g * n - base * k * nb) AS fcf FROM s, y), e AS (SELECT supplier, base, sh, sum(fcf / pow(1.09, t)) AS pv, max(ebitda) FILTER (WHERE t = 3) * CASE WHEN supplier % 2 = 0 THEN 8 ELSE 10 END / pow(1.09, 3) AS tv FROM f GROUP BY supplier, base, sh)" + _DCF.format(keys=""),
    "past_margins": "WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END) AS rev, sum(l_extendedprice * l_discount) AS e, sum(l_extendedprice * l_tax) AS c FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(arg_max(rev, y), 2) AS base_revenue, round(avg(e / rev) FILTER (WHERE rev <> 0), 4) AS mean_margin, round(avg(c / rev) FILTER (WHERE rev <> 0), 4) AS mean_capex_pct, count(*) AS n_years, count(*) FILTER (WHERE rev = 0) AS n_unusable FROM y GROUP BY 1",
    "default_cases": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 0.04 ELSE 0.1 END::DOUBLE AS growth, CASE WHEN c_nationkey < 10 THEN 0.3::DOUBLE WHEN c_nationkey < 20 THEN c_nationkey / 100 ELSE 0.2::DOUBLE END AS margin, 0.05::DOUBLE AS capex_pct, 0.1::DOUBLE AS nwc_pct, 0.25::DOUBLE AS tax, 0.03::DOUBLE AS terminal_growth, 5 AS years, 10.0::DOUBLE AS exit_multiple FROM customer",
    "outlook": _S + ", c(scenario, a, b) AS (VALUES ('bear', 0.5::DOUBLE, 0.4::DOUBLE), ('base', 1.0, 0.9), ('bull', 1.3, 1.2)), g AS (SELECT *, (supplier % 7 - 2) / 20 * a AS g1, (supplier % 7 - 2) / 20 * b AS g2, (supplier % 5 - 1) * 4.0::DOUBLE AS nm FROM s, c), r AS (SELECT *, base * (1 + g1) AS r1, base * (1 + g1) * (1 + g2) AS r2 FROM g), e AS (SELECT *, r1 * nm / 100 / sh AS e1, r2 * nm / 100 / sh AS e2 FROM r) SELECT supplier, scenario, round(g1, 3) AS growth1, round(r1, 3) AS revenue1, round(r2, 3) AS revenue2, round(r1 * 0.45, 3) AS gross1, round(r2 * nm / 100, 3) AS income2, round(e1, 3) AS eps1, round(e2, 3) AS eps2, round(CASE WHEN e1 > 0 THEN 30 / e1 END, 3) AS pe1, round(CASE WHEN e2 > 0 THEN 30 / e2 END, 3) AS pe2, round(sh * 30 / r1, 3) AS ps1, round(sh * 30 / r2, 3) AS ps2 FROM e",
    "price_table": "SELECT p_partkey, volume, round(p_retailprice * volume, 4) AS \"v_0_0\", round(p_retailprice * volume * (1 - 0.05::DOUBLE), 4) AS \"v_0_05\", round(p_retailprice * volume * (1 - 0.25::DOUBLE), 4) AS \"v_0_25\" FROM part, (VALUES (10.0::DOUBLE), (20.5::DOUBLE)) AS v(volume)",
    "scenarios": "WITH n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), x AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS scenario, o_totalprice AS value, CASE WHEN o_custkey % 2 = 0 THEN 1 / (n + 0.37::DOUBLE) ELSE 1 / n END AS p FROM n), y AS (SELECT *, value * p AS weighted FROM x), t AS (SELECT o_custkey, sum(weighted) AS w, sum(p) AS p FROM y GROUP BY 1) SELECT o_custkey, scenario, round(value, 3) AS value, round(p, 4) AS p, round(weighted, 3) AS weighted FROM y WHERE o_custkey % 2 = 0 UNION ALL SELECT o_custkey, 'expected value', round(w, 3), round(p, 4), round(w, 3) FROM t WHERE o_custkey % 2 = 0",
    "scenario_value": "SELECT o_custkey, round(CASE WHEN o_custkey % 3 = 0 THEN sum(sqrt(o_totalprice) * 0.1::DOUBLE) ELSE avg(sqrt(o_totalprice)) END, 4) AS expected FROM orders GROUP BY 1",
    "tornado": "WITH c AS (SELECT p_partkey, p_retailprice AS r, 0.2::DOUBLE AS m, (p_size + 1)::DOUBLE AS k FROM part), t AS (SELECT p_partkey, 'revenue' AS variable, 800 * m * k AS lo, 1200 * m * k AS hi FROM c UNION ALL SELECT p_partkey, 'margin', r * 0.15::DOUBLE * k, r * 0.22::DOUBLE * k FROM c UNION ALL SELECT p_partkey, 'multiple', r * m * 8, r * m * 13 FROM c) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(hi - lo), 9) DESC, variable) AS INTEGER) AS place, variable, round(lo, 4) AS at_low, round(hi, 4) AS at_high, round(abs(hi - lo), 4) AS impact FROM t",
    "margin_sweep": "SELECT p_partkey, round(0.1 + i * 0.05, 4)::DOUBLE AS margin, round(p_retailprice * (0.1::DOUBLE + i * 0.05::DOUBLE) * (p_size + 1), 4) AS output, round(p_retailprice * (0.1::DOUBLE + i * 0.05::DOUBLE) * (p_size + 1) - p_retailprice * 0.2::DOUBLE * (p_size + 1), 4) AS output_change FROM part, range(5) AS t(i)",
    "merger_table": _S + ", d AS (SELECT a.supplier, a.sh AS ash, a.base * 0.1 AS ai, t.sh AS tsh, t.base * 0.1 AS ti FROM s a JOIN s t ON t.supplier = a.supplier + 1), e AS (SELECT *, 30 * tsh AS ev, 0.4 * 30 * tsh / 50 AS ns, ((0.6 * 30 * tsh) * 0.5 * 0.06 + (0.6 * 30 * tsh) * 0.5 * 0.03 + 2) * 0.75 + CASE WHEN supplier % 2 = 0 THEN 30 * 0.75 ELSE 30 END AS drag FROM d), p AS (SELECT *, (ai + ti + 50 * 0.75 - drag) / (ash + ns) AS pe FROM e) SELECT supplier, round(ev, 4) AS equity_value, round(ns, 4) AS new_shares, round(pe, 4) AS proforma_eps, round((pe - ai / ash) / (ai / ash), 4) AS accretion, round((ai / ash * (ash + ns) - ai - ti + drag) / 0.75, 4) AS breakeven_synergies FROM p",
    "flow_growth": "WITH x AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) - 100000 AS a, arg_max(o_totalprice, o_orderkey) - 100000 AS z, count(*) - 1 AS n FROM orders GROUP BY 1) SELECT o_custkey, round(CASE WHEN n >= 1 AND a > 0 AND z > 0 THEN pow(z / a, 1.0 / n) - 1 ELSE 0 END, 6) AS growth FROM x",
    "capital_cost": "SELECT p_partkey, round((0.04 + p_size / 25 * 0.07::DOUBLE) / (1 + p_retailprice / 2000) + p_retailprice / 2000 / (1 + p_retailprice / 2000) * 0.05 * 0.75, 6) AS wacc FROM part",
    "all_ratios": _G + " SELECT supplier, 0.12::DOUBLE AS operating_margin, round(cr, 4) AS current_ratio, round(qr, 4) AS quick_ratio, 0.25::DOUBLE AS cash_ratio, round(de, 4) AS debt_to_equity, 11.0::DOUBLE AS interest_coverage, 4.0::DOUBLE AS debt_service_coverage, round(cogs / (rev * 0.15), 4) AS inventory_turnover, round(1 / 0.3, 4)::DOUBLE AS receivables_turnover, round(365 * 0.3, 4)::DOUBLE AS days_sales_outstanding, round(rev * ((i % 9 + 1) / 30) / sh, 4) AS book_value_per_share, round((30 * sh + rev * ((i % 4) / 11) - rev * 0.1) / (rev * 0.15), 4) AS ev_to_ebitda, CASE WHEN i % 3 = 2 THEN round(pe / 10, 4) END AS peg FROM r",
    "ratio_words": _G + ", l AS (SELECT supplier, 'roe' AS ratio, roe AS v FROM r UNION ALL SELECT supplier, 'current_ratio', cr FROM r UNION ALL SELECT supplier, 'debt_to_equity', de FROM r UNION ALL SELECT supplier, 'pe', pe FROM r UNION ALL SELECT supplier, 'quick_ratio', qr FROM r) SELECT supplier, ratio, round(v, 4) AS value, CASE ratio WHEN 'roe' THEN CASE WHEN v > 0.2 THEN 'Excellent returns' WHEN v > 0.15 THEN 'Good returns' WHEN v > 0.1 THEN 'Average returns' WHEN v > 0 THEN 'Below average returns' ELSE 'Negative returns' END WHEN 'current_ratio' THEN CASE WHEN v > 2 THEN 'Strong liquidity' WHEN v > 1.5 THEN 'Adequate liquidity' WHEN v > 1 THEN 'Potential liquidity concerns' ELSE 'Liquidity issues' END WHEN 'debt_to_equity' THEN CASE WHEN v < 0.5 THEN 'Low leverage' WHEN v < 1 THEN 'Moderate leverage' WHEN v < 2 THEN 'High leverage' ELSE 'Very high leverage' END WHEN 'pe' THEN CASE WHEN v <= 0 THEN 'N/A (negative earnings)' WHEN v < 15 THEN 'Potentially undervalued' WHEN v < 25 THEN 'Fair value' WHEN v < 40 THEN 'Growth premium' ELSE 'High valuation' END ELSE 'No interpretation available' END AS interpretation FROM l",
    "ratio_summary": _G + " SELECT supplier, concat_ws(' ', CASE WHEN roe > 0 THEN 'ROE of ' || printf('%.1f', roe * 100) || '% indicates ' || CASE WHEN roe > 0.15 THEN 'strong' ELSE 'moderate' END || ' shareholder returns.' END, CASE WHEN cr > 0 THEN 'Current ratio of ' || printf('%.2f', cr) || ' suggests ' || CASE WHEN cr > 1.5 THEN 'good liquidity position.' ELSE 'potential liquidity concerns.' END END, CASE WHEN de >= 0 THEN 'Debt-to-equity of ' || printf('%.2f', de) || ' indicates ' || CASE WHEN de < 0.5 THEN 'conservative' WHEN de < 1 THEN 'moderate' ELSE 'high' END || ' leverage.' END, CASE WHEN pe > 0 THEN 'P/E ratio of ' || printf('%.1f', pe) || ' suggests the stock is trading at ' || CASE WHEN pe < 15 THEN 'a discount.' WHEN pe < 25 THEN 'fair value.' ELSE 'a premium.' END END) AS summary FROM r",
    "recommendations": "WITH x AS (SELECT s_suppkey, 1 AS kind, 'cash_ratio' AS ratio, 'Priority: Address cash ratio - hold more cash' AS recommendation FROM supplier WHERE s_acctbal < 3000 UNION ALL SELECT s_suppkey, 1, 'net_margin', 'Priority: Address net margin - ' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 2, 'debt_to_equity', 'Monitor: debt to equity showing negative trend' FROM supplier WHERE s_nationkey % 3 = 0), y AS (SELECT * FROM x UNION ALL SELECT s_suppkey, 3, n, t FROM supplier, (VALUES ('0', 'Continue current financial management practices'), ('1', 'Consider strategic growth opportunities')) AS g(n, t) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM x)) SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY kind, ratio) AS INTEGER) AS place, recommendation FROM y QUALIFY place <= 2",
    "revenue_trend": "WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, arg_min(v, y) AS a, arg_max(v, y) AS z FROM y GROUP BY 1), c AS (SELECT l_suppkey, (z - a) / abs(a) * 100 AS c FROM g) SELECT l_suppkey, round(c, 4) AS change_pct, CASE WHEN abs(c) <= 5 THEN 'stable' WHEN (CASE WHEN l_suppkey % 2 = 0 THEN -c ELSE c END) > 0 THEN 'improving' ELSE 'deteriorating' END AS trend FROM c",
    "number_texts": "WITH p AS (SELECT *, CASE WHEN p_size > 5 THEN (p_size - 20) / 7 END AS y FROM part) SELECT p_partkey, printf('%.2f', p_retailprice / 10) || '%' AS a, '$' || printf('%.2f', p_retailprice) AS b, printf('%.2f', y) || 'x' AS c, printf('%.1f', p_retailprice / 3) || ' days' AS e, coalesce(printf('%.1f', y) || '%', '—') AS f, CASE WHEN p_size = 20 THEN '$0' WHEN p_size < 20 THEN '($' || printf('%.1f', 20.0 - p_size) || 'M)' ELSE '$' || printf('%.1f', p_size - 20.0) || 'M' END AS g, CASE WHEN p_size > 5 THEN '$' || format('{:,.2f}', p_retailprice) ELSE '-' END AS h FROM p",
    "ratio_report": _G + ", l AS (SELECT supplier, 'net_margin' AS ratio, printf('%.2f', ni / rev * 100) || '%' AS text, NULL AS v FROM r UNION ALL SELECT supplier, 'current_ratio', printf('%.2f', cr) || 'x', cr FROM r UNION ALL SELECT supplier, 'days_sales_outstanding', '109.5 days', NULL FROM r UNION ALL SELECT supplier, 'book_value_per_share', '$' || printf('%.2f', rev * ((i % 9 + 1) / 30) / sh), NULL FROM r) SELECT supplier, ratio, text, CASE WHEN ratio <> 'current_ratio' THEN 'No interpretation available' WHEN v > 2 THEN 'Strong liquidity' WHEN v > 1.5 THEN 'Adequate liquidity' WHEN v > 1 THEN 'Potential liquidity concerns' ELSE 'Liquidity issues' END AS interpretation FROM l",
    "margin_series": "WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_extendedprice) AS r, sum(l_extendedprice * l_discount) AS i FROM lineitem GROUP BY 1, 2), t AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY y DESC) <= 3), d AS (SELECT *, max(abs(r)) OVER (PARTITION BY l_suppkey) AS x FROM t), v AS (SELECT *, CAST(CASE WHEN x >= 1e12 THEN 1e12 WHEN x >= 1e9 THEN 1e9 WHEN x >= 1e6 THEN 1e6 WHEN x >= 1e3 THEN 1e3 ELSE 1 END AS DOUBLE) AS divisor FROM d) SELECT l_suppkey, CAST(y AS INTEGER) AS y, round(r / divisor, 4) AS revenue, round(i / divisor, 4) AS income, round(i / r * 100, 4) AS income_margin, divisor FROM v",
    "flagged_days": "WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderpriority, day, max(o_totalprice) AS price, coalesce(string_agg(DISTINCT CASE WHEN o_totalprice > 480000 THEN 'big ' || o_orderstatus END, '; ' ORDER BY CASE WHEN o_totalprice > 480000 THEN 'big ' || o_orderstatus END), '') AS flags, CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) * 86400000 AS at FROM o GROUP BY 1, 2",
}
SQL["outlook_table"] = SQL["outlook"].replace(" SELECT supplier, scenario,", ", z AS (SELECT supplier, scenario,", 1) + ") SELECT supplier, max(revenue2) FILTER (WHERE scenario = 'bear') AS bear, max(revenue2) FILTER (WHERE scenario = 'base') AS base, max(revenue2) FILTER (WHERE scenario = 'bull') AS bull FROM z GROUP BY 1"
_V = SQL["dcf_grid"].split(" SELECT supplier, wacc")[0].replace("(VALUES (0.07::DOUBLE), (0.08::DOUBLE), (0.025::DOUBLE))", "(VALUES (0.08::DOUBLE), (0.02::DOUBLE))").replace("(VALUES (0.02::DOUBLE), (0.03::DOUBLE))", "(VALUES (0.03::DOUBLE))").replace("(0.22 - 0.05)", "(0.20 - 0.05)")
SQL["value_texts"] = _V + " SELECT supplier, CASE WHEN tv IS NULL THEN supplier || ': no value under these assumptions.' ELSE supplier || ': enterprise value ' || printf('%.1f', pv + tv) || ', equity ' || printf('%.1f', pv + tv - base * 0.2) || ', ' || printf('%.2f', (pv + tv - base * 0.2) / sh) || ' a share; ' || printf('%.1f', tv / (pv + tv) * 100) || '% of it lies behind the last year.' END AS text FROM e WHERE wacc = CASE WHEN supplier % 2 = 0 THEN 0.02::DOUBLE ELSE 0.08::DOUBLE END"
SQL["deal_texts"] = SQL["merger_table"].split(" SELECT supplier, round(ev")[0] + ", z AS (SELECT supplier, (pe - ai / ash) / (ai / ash) AS a, (ai / ash * (ash + ns) - ai - ti + drag) / 0.75 AS b FROM p) SELECT supplier, supplier || ': ' || printf('%.1f', abs(a) * 100) || '% ' || CASE WHEN a > 0 THEN 'accretive' WHEN a < 0 THEN 'dilutive' ELSE 'neutral' END || '; breaks even at synergies of ' || printf('%.1f', b) || '.' AS text FROM z"
