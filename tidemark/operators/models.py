"""Valuation arithmetic over tables of assumptions: one row per case, all cases in parallel, no state between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_of_capital(risk_free: Column, beta: Column, premium: Column, debt_cost: Column, leverage: Column, tax: Column) -> Column:
    """Weighted average cost of capital; leverage is debt over equity."""
    return (risk_free + beta * premium) / (1 + leverage) + leverage / (1 + leverage) * debt_cost * (1 - tax)


# What is assumed where a case says nothing.
DEFAULTS = {"growth": 0.10, "margin": 0.20, "capex_pct": 0.05, "nwc_pct": 0.10, "tax": 0.25, "terminal_growth": 0.03, "years": 5, "exit_multiple": 10.0}


def with_defaults(cases: DataFrame, history_margin: str | None = None) -> DataFrame:
    """cases with the assumptions they lack or hold as null filled: a margin by history_margin first, all by DEFAULTS."""
    fill = {}
    for name, value in DEFAULTS.items():
        known = [F.col(name)] if name in cases.columns else []
        if name == "margin" and history_margin:
            known.append(F.col(history_margin))
        fill[name] = F.coalesce(*known, F.lit(value))
    return cases.withColumns(fill)


def historical_margins(history: DataFrame, keys: Sequence[str], *, year: str, revenue: str, ebitda: str, capex: str) -> DataFrame:
    """(keys, base_revenue, mean_margin, mean_capex_pct, n_years, n_unusable): what the past years say.

    base_revenue is that of the last year. Years with a null or zero revenue have no margin: they're counted, not used.
    """
    ok = F.coalesce(F.col(revenue) != 0, F.lit(False))
    per = lambda c: F.avg(F.when(ok, F.try_divide(F.col(c).cast("double"), F.col(revenue).cast("double"))))
    return history.groupBy(*keys).agg(F.max_by(F.col(revenue), F.col(year)).alias("base_revenue"), per(ebitda).alias("mean_margin"), per(capex).alias("mean_capex_pct"), F.count("*").alias("n_years"), F.count_if(~ok).alias("n_unusable"))


def _rate(cases: DataFrame, name: str, year: Column) -> Column:
    """A rate of a year: the column's own value, or the year's of an array (its last one behind its end)."""
    if not dict(cases.dtypes)[name].startswith("array"):
        return F.col(name)
    return F.get(F.col(name), F.least(year, F.size(name)) - 1)


def project(cases: DataFrame, years: str = "years") -> DataFrame:
    """cases with one row per year (year, revenue, ebitda, ebit, tax_paid, nwc_change, fcf).

    A case has base_revenue, growth, margin, capex_pct, nwc_pct and tax; the four rates are numbers or arrays with one
    for each year. Working capital starts at a tenth of the base. Depreciation equals capex. Revenue is the base times
    the product of growth up to the year, formed within the row, so no order of rows matters.
    """
    upto = lambda n: F.aggregate(F.sequence(F.lit(1), n), F.col("base_revenue").cast("double"), lambda acc, y: acc * (1 + _rate(cases, "growth", y)))
    d = cases.withColumn("year", F.explode(F.sequence(F.lit(1), F.col(years)))).withColumn("__before", F.when(F.col("year") > 1, upto(F.greatest(F.col("year") - 1, F.lit(1)))).otherwise(F.col("base_revenue")))
    y = F.col("year")
    d = d.withColumn("revenue", F.col("__before") * (1 + _rate(cases, "growth", y)))
    nwc_before = F.when(y == 1, F.col("base_revenue") * 0.10).otherwise(F.col("__before") * _rate(cases, "nwc_pct", y - 1))
    margin, capex = _rate(cases, "margin", y), _rate(cases, "capex_pct", y)
    d = d.withColumns({"ebitda": F.col("revenue") * margin, "ebit": F.col("revenue") * (margin - capex), "nwc_change": F.col("revenue") * _rate(cases, "nwc_pct", y) - nwc_before})
    return d.drop("__before").withColumn("tax_paid", F.col("ebit") * F.col("tax")).withColumn("fcf", F.col("ebit") - F.col("tax_paid") - F.col("nwc_change"))


def enterprise_value(cases: DataFrame, keys: Sequence[str], years: str = "years", method: str = "growth") -> DataFrame:
    """(keys, pv_fcf, terminal, ev, equity, per_share, terminal_pct) of cases with wacc, terminal_growth, net_debt and shares.

    terminal is by perpetual growth, null unless wacc exceeds it, or, with method 'multiple', the last year's ebitda
    times exit_multiple (10 where it is null or missing); where it is null the values behind it are null too.
    """
    if method not in ("growth", "multiple"):
        raise ValueError(f"no method {method!r}: growth or multiple")
    p = project(cases, years)
    multiple = F.coalesce(F.col("exit_multiple") if "exit_multiple" in cases.columns else F.lit(None).cast("double"), F.lit(DEFAULTS["exit_multiple"]))
    last = F.max_by(F.struct("fcf", "ebitda", "wacc", "terminal_growth", multiple.alias("multiple"), F.col(years).alias("n"), "net_debt", "shares"), "year").alias("l")
    g = p.groupBy(*keys).agg(F.sum(F.col("fcf") / F.pow(1 + F.col("wacc"), F.col("year"))).alias("pv_fcf"), last)
    growth = F.when(F.col("l.wacc") > F.col("l.terminal_growth"), F.try_divide(F.col("l.fcf") * (1 + F.col("l.terminal_growth")), F.col("l.wacc") - F.col("l.terminal_growth")))
    future = growth if method == "growth" else F.col("l.ebitda") * F.col("l.multiple")
    g = g.withColumn("terminal", future / F.pow(1 + F.col("l.wacc"), F.col("l.n"))).withColumn("ev", F.col("pv_fcf") + F.col("terminal")).withColumn("equity", F.col("ev") - F.col("l.net_debt"))
    return g.select(*keys, "pv_fcf", "terminal", "ev", "equity", F.try_divide("equity", F.nullif("l.shares", F.lit(0.0))).alias("per_share"), (F.try_divide("terminal", F.nullif("ev", F.lit(0.0))) * 100).alias("terminal_pct"))


def outlook(companies: DataFrame, scenarios: DataFrame) -> DataFrame:
    """companies with each scenario's two-year projection: growth, revenue, income, earnings per share, forward P/E and P/S.

    A company has base_revenue, cagr, gross_margin and net_margin (percent), shares, price and cap; a scenario has name
    and the multipliers of the growth of the first and the second year. scenarios is a list in a table of some rows, so
    it is broadcast; more than 100 rows raise an error. P/E is null where earnings aren't positive.
    """
    if scenarios.limit(101).count() > 100:
        raise ValueError("more than 100 scenarios")
    d = companies.join(F.broadcast(scenarios.select(F.col("name").alias("scenario"), "first", "second")))
    c = F.col
    d = d.withColumns({"growth1": c("cagr") * c("first"), "growth2": c("cagr") * c("second")}).drop("first", "second")
    d = d.withColumn("revenue1", c("base_revenue") * (1 + c("growth1"))).withColumn("revenue2", c("revenue1") * (1 + c("growth2")))
    for n in "12":
        d = d.withColumns({f"gross{n}": c(f"revenue{n}") * c("gross_margin") / 100, f"income{n}": c(f"revenue{n}") * c("net_margin") / 100})
        d = d.withColumn(f"eps{n}", F.try_divide(f"income{n}", F.nullif(c("shares").cast("double"), F.lit(0.0))))
        d = d.withColumns({f"pe{n}": F.when(c(f"eps{n}") > 0, c("price") / c(f"eps{n}")), f"ps{n}": F.try_divide(c("cap").cast("double"), F.nullif(c(f"revenue{n}"), F.lit(0.0)))})
    return d


def data_table(cases: DataFrame, keys: Sequence[str], rows: tuple[str, Sequence[float]], columns: tuple[str, Sequence[float]], output: Callable[[], Column]) -> DataFrame:
    """(keys, row value, one column for each column value): a two-way table of output, one line for each row value.

    The columns are named by their values, with '_' for the point.
    """
    (row, row_values), (column, column_values) = rows, columns
    named = [(float(v), f"v_{v}".replace(".", "_").replace("-", "m")) for v in column_values]
    d = cases.withColumn(row, F.explode(F.array(*[F.lit(float(v)) for v in row_values])))
    cells = [d.withColumn(column, F.lit(v)).select(*keys, row, F.lit(n).alias("__c"), output().alias("__o")) for v, n in named]
    long = cells[0]
    for c in cells[1:]:
        long = long.unionByName(c)
    return long.groupBy(*keys, row).pivot("__c", [n for _, n in named]).agg(F.first("__o"))


def grid(cases: DataFrame, axes: dict[str, Sequence[float]]) -> DataFrame:
    """cases with every combination of the axes' values in their columns; the axes are short lists in the call."""
    for name, values in axes.items():
        cases = cases.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return cases


def sweep(cases: DataFrame, name: str, low: float, high: float, steps: int, output: Callable[[], Column], label: str = "output") -> DataFrame:
    """cases with name set to evenly spaced values from low to high and the output expression of each, with its change
    against the case's own value of name."""
    base = cases.withColumn("__base", output())
    values = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(float(low)) + i * F.lit((high - low) / max(steps - 1, 1)))
    d = base.withColumn(name, F.explode(values)).withColumn(label, output())
    return d.withColumn(f"{label}_change", F.col(label) - F.col("__base")).drop("__base")


def tornado(cases: DataFrame, keys: Sequence[str], spans: dict[str, tuple[float, float]], output: Callable[[], Column]) -> DataFrame:
    """(keys, variable, at_low, at_high, impact): the output with one variable at its low and its high value, the others
    as in the case."""
    frames = []
    for v, (lo, hi) in spans.items():
        low, high = cases.withColumn(v, F.lit(float(lo))), cases.withColumn(v, F.lit(float(hi)))
        a, b = (x.select(*keys, output().alias("o")) for x in (low, high))
        frames.append(a.withColumn("side", F.lit("l")).unionByName(b.withColumn("side", F.lit("h"))).withColumn("variable", F.lit(v)))
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    g = both.groupBy(*keys, "variable").agg(F.max(F.when(F.col("side") == "l", F.col("o"))).alias("at_low"), F.max(F.when(F.col("side") == "h", F.col("o"))).alias("at_high"))
    return g.withColumn("impact", F.abs(F.col("at_high") - F.col("at_low")))


def by_impact(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A tornado's rows with place, the greatest impact of a key first; equal ones (to nine decimals) by variable."""
    w = Window.partitionBy(*keys).orderBy(F.round("impact", 9).desc_nulls_last(), "variable")
    return t.withColumn("place", F.row_number().over(w))


def expected(scenarios: DataFrame, keys: Sequence[str], output: str, probability: str) -> DataFrame:
    """(keys, expected): sum of output by probability; where a key names no probability, all count alike."""
    n = scenarios.groupBy(*keys).agg(F.sum(F.col(output) * F.col(probability)).alias("w"), F.count(probability).alias("known"), F.avg(output).alias("plain"))
    return n.select(*keys, F.when(F.col("known") > 0, F.col("w")).otherwise(F.col("plain")).alias("expected"))


def scenario_table(scenarios: DataFrame, keys: Sequence[str], scenario: str, output: str, probability: str, label: str = "expected value") -> DataFrame:
    """(keys, scenario, output, probability, weighted): the scenarios with their probabilities (equal parts of one where
    a key names none) and their part of the expected value, and one row more per key, named label, with the sums."""
    n = scenarios.groupBy(*keys).agg(F.count("*").alias("__n"), F.count(probability).alias("__known"))
    p = F.when(F.col("__known") > 0, F.coalesce(F.col(probability).cast("double"), F.lit(0.0))).otherwise(1 / F.col("__n"))
    d = scenarios.join(n, list(keys)).select(*keys, scenario, F.col(output).cast("double").alias(output), p.alias(probability)).withColumn("weighted", F.col(output) * F.col(probability))
    total = d.groupBy(*keys).agg(F.sum("weighted").alias("weighted"), F.sum(probability).alias(probability))
    return d.unionByName(total.select(*keys, F.lit(label).alias(scenario), F.col("weighted").alias(output), probability, "weighted"))


def breakeven(cases: DataFrame, low: float, high: float, output: Callable[[Column], Column], target: float = 0.0, rounds: int = 60) -> DataFrame:
    """cases with breakeven: where the monotone output crosses target in [low, high], by bisection inside one expression;
    null if it doesn't."""
    f = lambda x: output(x) - F.lit(float(target))
    rising = f(F.lit(high)) >= f(F.lit(low))
    start = F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["a"] + acc["b"]) / 2
        above = (f(mid) >= 0) == rising
        return F.struct(F.when(above, acc["a"]).otherwise(mid).alias("a"), F.when(above, mid).otherwise(acc["b"]).alias("b"))

    inside = f(F.lit(low)) * f(F.lit(high)) <= 0
    return cases.withColumn("breakeven", F.when(inside, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["a"] + s["b"]) / 2)))


def merger(deals: DataFrame) -> DataFrame:
    """deals with equity_value, new_shares, proforma_shares, proforma_eps, accretion and breakeven_synergies.

    A deal has a_price, a_shares, a_income, t_price, t_shares, t_income, offer, cash_pct, stock_pct, debt_part,
    debt_rate, cash_yield, fee, tax, synergies, intangibles, years and deductible. Undefined values are null.
    """
    c = F.col
    d = deals.withColumn("equity_value", c("offer") * c("t_shares")).withColumn("new_shares", F.try_divide(c("stock_pct") * c("equity_value"), F.nullif("a_price", F.lit(0.0))))
    d = d.withColumn("proforma_shares", c("a_shares") + c("new_shares"))
    cash = c("cash_pct") * c("equity_value")
    financing = (cash * c("debt_part") * c("debt_rate") + cash * (1 - c("debt_part")) * c("cash_yield") + c("fee")) * (1 - c("tax"))
    yearly = F.coalesce(F.try_divide("intangibles", F.nullif("years", F.lit(0))), F.lit(0.0))
    drag = financing + F.when(c("deductible"), yearly * (1 - c("tax"))).otherwise(yearly)
    income = c("a_income") + c("t_income") + c("synergies") * (1 - c("tax")) - c("__drag")
    eps = F.try_divide("a_income", F.nullif("a_shares", F.lit(0.0)))
    d = d.withColumn("__drag", drag).withColumns({"proforma_eps": F.try_divide(income, F.nullif("proforma_shares", F.lit(0.0))), "__eps": eps})
    need = (c("__eps") * c("proforma_shares") - c("a_income") - c("t_income") + c("__drag")) / F.nullif(1 - c("tax"), F.lit(0.0))
    return d.withColumns({"accretion": F.try_divide(c("proforma_eps") - c("__eps"), F.nullif("__eps", F.lit(0.0))), "breakeven_synergies": need}).drop("__drag", "__eps")


def value_text(name: Column) -> Column:
    """A sentence on a valued case, for its columns ev, equity, per_share and terminal_pct; undefined cases say so."""
    text = F.format_string("%s: enterprise value %.1f, equity %.1f, %.2f a share; %.1f%% of it lies behind the last year.", name.cast("string"), F.col("ev"), F.col("equity"), F.col("per_share"), F.col("terminal_pct"))
    return F.when(F.col("ev").isNotNull() & F.col("per_share").isNotNull(), text).otherwise(F.concat(name.cast("string"), F.lit(": no value under these assumptions.")))


def deal_text(name: Column) -> Column:
    """A sentence on a merger, for its columns accretion and breakeven_synergies."""
    word = F.when(F.col("accretion") > 0, "accretive").when(F.col("accretion") < 0, "dilutive").otherwise("neutral")
    text = F.format_string("%s: %.1f%% %s; breaks even at synergies of %.1f.", name.cast("string"), F.abs(F.col("accretion")) * 100, word, F.col("breakeven_synergies"))
    return F.when(F.col("accretion").isNotNull() & F.col("breakeven_synergies").isNotNull(), text).otherwise(F.concat(name.cast("string"), F.lit(": not defined.")))
