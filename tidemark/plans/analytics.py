"""Queries over the relational tables: joins, aggregates, reshaping, profiles, models and text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.functions.norm import calendar_day, symbol_key
from tidemark.operators import drift, fundamentals, holdings, joins, models, profile, series, text, trends, upsert
from tidemark.plans.problems import income
from tidemark.sources.tables import once, table

Session = SparkSession


def _r(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


def _segments(s: Session, d: str, unit: str = "quarter") -> DataFrame:
    """(segment, day, revenue): order value by market segment and calendar unit."""
    o = table(s, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").join(table(s, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.date_trunc(unit, "o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("revenue"))


_SEG = "WITH s AS (SELECT c_mktsegment AS segment, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS day, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def growth_quarterly(s: Session, d: str) -> DataFrame:
    w = series.ordered("segment")
    t = _segments(s, d).withColumns({"yoy": series.lagged_growth(F.col("revenue"), w, 4), "ttm": series.trailing_sum(F.col("revenue"), w), "rebased": series.rebase(F.col("revenue"), w), "next": series.shifted(F.col("revenue"), w, -1)})
    return t.select("segment", "day", *[F.round(c, 2).alias(c) for c in ("revenue", "yoy", "ttm", "rebased", "next")])


def segment_share(s: Session, d: str) -> DataFrame:
    t = _segments(s, d, "year")
    w = Window.partitionBy("day")
    return t.select("segment", "day", F.round(F.col("revenue") / F.sum("revenue").over(w) * 100, 4).alias("share"), F.rank().over(w.orderBy(F.col("revenue").desc())).alias("place"))


def segment_pivot(s: Session, d: str) -> DataFrame:
    t = _segments(s, d, "year").groupBy("day").pivot("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.sum("revenue"))
    return t.fillna(0.0).select("day", *[F.round(c, 2).alias(c.lower()) for c in t.columns[1:]])


def segment_long(s: Session, d: str) -> DataFrame:
    return segment_pivot(s, d).unpivot(["day"], ["automobile", "building", "furniture", "household", "machinery"], "segment", "revenue").where("revenue <> 0")


def scaled_revenue(s: Session, d: str) -> DataFrame:
    t = _segments(s, d, "year")
    return t.withColumn("divisor", numeric.scale_of(F.max(F.abs("revenue")).over(Window.partitionBy("segment")))).select("segment", "day", "divisor", F.round(F.col("revenue") / F.col("divisor"), 4).alias("scaled"))


def tail_rows(s: Session, d: str) -> DataFrame:
    return series.tail(_segments(s, d), 4, by="segment", order="day").select("segment", "day", F.round("revenue", 2).alias("revenue"))


def growth_span(s: Session, d: str) -> DataFrame:
    g = _segments(s, d, "year").groupBy("segment").agg(F.min_by("revenue", "day").alias("a"), F.max_by("revenue", "day").alias("z"), (F.year(F.max("day")) - F.year(F.min("day"))).alias("years"))
    return g.select("segment", "years", F.round(numeric.cagr(F.col("a"), F.col("z"), F.col("years")), 4).alias("cagr"))


def filled_gaps(s: Session, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    by, order = ["user_id"], ["ts", "event_id"]
    return e.select("event_id", F.round(series.fill(v, by, order), 4).alias("last_purchase"), F.round(series.fill(v, by, order, forward=False), 4).alias("next_purchase"))


def asof_signup(s: Session, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    signs = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("value").alias("signup_value"))
    return joins.asof_backward(buys, signs, by=["user_id"], time="ts", values=["signup_value"]).select("event_id", "user_id", F.round("signup_value", 4).alias("signup_value"))


def calendar_changes(s: Session, d: str) -> DataFrame:
    """What the observations from 2024 on say against those before, per ticker and kind."""
    e = once(table(s, d, "universe_events", "event_id", "ticker", "type", "date", "status", "ref", "fetched_at"), "event_id").where("fetched_at is not null")
    e = e.select(symbol_key(F.col("ticker")).alias("ticker"), "type", F.nullif(F.trim("ref"), F.lit("")).alias("ref"), calendar_day(F.col("date")).alias("day"), "status", "fetched_at")
    slot = F.coalesce("ref", F.col("day").cast("string"))
    newest = lambda x: x.groupBy("ticker", "type", slot.alias("slot")).agg(F.max_by(F.struct("ref", "day", "status"), F.struct("fetched_at", "day", "status")).alias("x")).select("ticker", "type", "x.*")
    old, new = newest(e.where("fetched_at < '2024-01-01'")), newest(e.where("fetched_at >= '2024-01-01'"))
    return joins.snapshot_diff(old, new, by="ticker", kind="type", ref="ref", day="day", status="status", today="2024-01-01").where("change not in ('kept')")


def latest_state(s: Session, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    first, late = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return upsert.keep_last([first, late], ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def merged_state(s: Session, d: str) -> DataFrame:
    """Balances of two thirds of the customers after all customers' largest orders were merged in: some rows are
    replaced, some kept, some inserted; null updates keep what is stored."""
    c = table(s, d, "customer", "c_custkey", "c_name", "c_acctbal").where("c_custkey % 3 > 0")
    batch = table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return upsert.upsert(c, batch, ["c_custkey"], "o_orderkey").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def idle_customers(s: Session, d: str) -> DataFrame:
    """Customers without an order of the first priority."""
    o = table(s, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return upsert.delete(table(s, d, "customer", "c_custkey", "c_mktsegment"), o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def active_nations(s: Session, d: str) -> DataFrame:
    return table(s, d, "nation").join(table(s, d, "supplier", F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")


def fiscal_sums(s: Session, d: str) -> DataFrame:
    """Orders by fiscal quarter of years that end in January, by a range join with the calendar."""
    o = table(s, d, "orders", "o_orderdate", "o_totalprice").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice").withColumn("k", F.lit(1))
    # The calendar's span comes from the orders; it has four rows a year.
    span = o.agg(F.add_months(F.min("day"), -3).alias("a"), F.add_months(F.max("day"), 3).alias("z"))
    cal = trends.fiscal_calendar(span, start="a", end="z", year_end_month=1).withColumn("k", F.lit(1)).drop("a", "z")
    j = joins.range_join(o, cal, by=["k"], point="day", start="quarter_start", end="quarter_end")
    return j.groupBy("fiscal_quarter", "quarter_end").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def weekly_complete(s: Session, d: str) -> DataFrame:
    e = table(s, d, "orders", "o_orderpriority", "o_orderdate").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return trends.complete_weeks(e, keys=["symbol"], day="day", value="n").select("symbol", "week", F.col("value").cast("bigint").alias("n_orders"))


def search_interest(s: Session, d: str) -> DataFrame:
    """(q, day, interest): the points of all cached responses by search term and UTC day, the latest response's value."""
    v = once(table(s, d, "vsco_3m_daily"), "env_id").select("env_id", F.explode("raw_response.interest_over_time.timeline_data").alias("t")).where("t is not null")
    p = v.select("env_id", F.to_date(F.timestamp_seconds(F.col("t.timestamp").try_cast("long"))).alias("day"), F.col("t.partial_data").alias("partial"), F.explode("t.values").alias("x"))
    p = p.where("x is not null and day is not null and x.query is not null and not coalesce(partial, false)")
    return p.groupBy(F.col("x.query").alias("q"), "day").agg(F.max_by("x.extracted_value", "env_id").alias("interest"))


def interest_quarters(s: Session, d: str) -> DataFrame:
    daily = search_interest(s, d).withColumn("partial", F.lit(False))
    return trends.quarter_sums(daily, 1, keys=["q"], day="day", value="interest", partial="partial", today="2030-01-01").select("q", "fiscal_quarter", F.col("index").cast("bigint").alias("interest"), "n_confirmed")


def interest_gaps(s: Session, d: str) -> DataFrame:
    return trends.granularity(search_interest(s, d), keys=["q"], time="day")


def _lines(s: Session, d: str) -> DataFrame:
    li = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag").join(table(s, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.col("l_suppkey").alias("filing"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.col("p_brand").alias("issuer"), F.concat(F.translate("p_brand", "#", "0"), F.lit("XX0")).alias("cusip"), F.round("l_extendedprice").cast("bigint").alias("value"), F.col("l_quantity").cast("bigint").alias("shares"), F.lit("SH").alias("shtype"), F.when(F.col("l_returnflag") == "R", "Put").alias("putcall"))


def holdings_rollup(s: Session, d: str) -> DataFrame:
    return holdings.roll_up(_lines(s, d), "filing").select("filing", "cusip6", "issuer", "value_usd", "shares", "derivative", F.round("pct", 4).alias("pct"))


def position_changes(s: Session, d: str) -> DataFrame:
    li = table(s, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"), F.year("l_shipdate").alias("y"))
    return joins.position_changes(li.where("y <= 1996"), li.where("y > 1996"), keys=["l_suppkey", "l_partkey"], amount="q")


def statement_ratios(s: Session, d: str) -> DataFrame:
    """Ratios of suppliers, whose statement figures are made of their lines."""
    li = table(s, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    g = li.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("net_income"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("cost_of_goods_sold"), F.sum("l_quantity").alias("shares_outstanding"))
    f = g.join(table(s, d, "supplier", "s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey")).withColumns({"shareholders_equity": F.abs("s_acctbal") * 1000, "total_assets": F.col("revenue") * 2, "share_price": F.lit(30.0)})
    names = ["roe", "roa", "gross_margin", "net_margin", "asset_turnover", "eps", "pe", "pb", "ps", "current_ratio"]
    return fundamentals.ratios(f).select(F.col("l_suppkey").alias("supplier"), *_r(*names))


def _flat_ratios(s: Session, d: str) -> DataFrame:
    return fundamentals.long_ratios(statement_ratios(s, d), ["supplier"], ["gross_margin", "net_margin", "roa", "pe"])


def health(s: Session, d: str) -> DataFrame:
    rows = [("general", "gross_margin", 0.97, 0.96, 0.95, True), ("general", "net_margin", 0.055, 0.05, 0.045, True), ("general", "roa", 0.026, 0.025, 0.024, True), ("general", "pe", 400.0, 450.0, 500.0, False)]
    b = s.createDataFrame(rows, "industry string, ratio string, excellent double, good double, acceptable double, higher boolean")
    r = fundamentals.rated(_flat_ratios(s, d).withColumn("industry", F.lit("wholesale")), b)
    return fundamentals.health(r, ["supplier"]).select("supplier", F.round("score", 4).alias("score"), "band")


def revenue_bridge(s: Session, d: str) -> DataFrame:
    i = income(s, d, "revenue", "costOfRevenue", "operatingExpenses", "incomeBeforeTax", "incomeTaxExpense", "netIncome")
    return fundamentals.bridge(i, ["inc_id"]).select("inc_id", "step_no", "step", F.col("amount").cast("bigint").alias("amount"))


def earnings_surprise(s: Session, d: str) -> DataFrame:
    e = once(table(s, d, "aapl_earnings", "earn_id", "epsActual", "epsEstimated", "revenueActual", "revenueEstimated"), "earn_id").where("epsActual is not null")
    return e.select("earn_id", F.round(fundamentals.surprise(F.col("epsActual"), F.col("epsEstimated")), 4).alias("eps_surprise"), F.round(fundamentals.surprise(F.col("revenueActual"), F.col("revenueEstimated")), 4).alias("revenue_surprise"))


def segment_matrix(s: Session, d: str) -> DataFrame:
    g = once(table(s, d, "aapl_segmentation", "seg_id", "symbol", "fiscalYear", "data"), "seg_id")
    m = g.select("symbol", F.col("fiscalYear").alias("year"), F.transform_values(F.from_json("data", "map<string,string>"), lambda _, v: F.coalesce(drift.amount_text(v), F.lit(0))).alias("data")).where("data is not null")
    return fundamentals.segment_matrix(m, entity="symbol", year="year", data="data", last=3).withColumn("amount", F.col("amount").cast("double"))


def breakeven_price(s: Session, d: str) -> DataFrame:
    p = table(s, d, "part", "p_partkey", "p_retailprice")
    return models.breakeven(p, 0.0, 5000.0, lambda x: x * 0.8 - F.col("p_retailprice")).select("p_partkey", F.round("breakeven", 3).alias("breakeven"))


def rfm(s: Session, d: str) -> DataFrame:
    c = table(s, d, "customer", "c_custkey")
    o = table(s, d, "orders", "o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice").withColumn("day", F.col("o_orderdate").cast("date"))
    r = profile.rfm(c, o, customer="c_custkey", order="o_orderkey", day="day", amount="o_totalprice", as_of="1998-08-01")
    return r.select("c_custkey", "recency", "frequency", F.round("money", 2).alias("money"), "r", "f", "m")


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe(s: Session, d: str) -> DataFrame:
    return profile.describe(table(s, d, "lineitem", *LINE), LINE).select("name", "n", *_r("mean", "std", "min", "q25", "q50", "q75", "max"))


def correlations(s: Session, d: str) -> DataFrame:
    return profile.correlations(table(s, d, "lineitem", *LINE, "l_returnflag"), LINE, ["l_returnflag"]).select("l_returnflag", "a", "b", *_r("r"))


def rank_correlation(s: Session, d: str) -> DataFrame:
    return profile.rank_correlation(table(s, d, "part", "p_brand", "p_size", "p_retailprice"), "p_size", "p_retailprice", "p_brand").select("p_brand", *_r("r"))


def missing(s: Session, d: str) -> DataFrame:
    return profile.missing(table(s, d, "documents", "doc_id", "text", "lang", "source", "symbol", "doc_date")).select("name", "n_rows", "n_missing", *_r("share"))


def duplicates(s: Session, d: str) -> DataFrame:
    return profile.duplicates(table(s, d, "documents", "text", "lang", "source"))


def shape(s: Session, d: str) -> DataFrame:
    return profile.shape(table(s, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", *_r("skew", "kurt"))


def outliers(s: Session, d: str) -> DataFrame:
    return profile.iqr_outliers(table(s, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"], 0.5).select("o_orderkey", *[F.round(c, 2).alias(c) for c in ("lo", "hi")])


def z_scores(s: Session, d: str) -> DataFrame:
    return profile.z_outliers(table(s, d, "events", "event_id", "event_type", "value"), "value", ["event_type"], 2.0).select("event_id", *_r("z"))


def quality(s: Session, d: str) -> DataFrame:
    r = table(s, d, "revenue_margins", "point_id", "symbol", "category", "name", "data", "unit", "currency")
    q = profile.quality(r, "point_id", {"name": F.col("name").isin("Revenue", "Net income", "Net margin"), "data": F.col("data") > 0})
    return q.select(*_r("completeness", "uniqueness", "validity", "score"))


def beta(s: Session, d: str) -> DataFrame:
    return profile.beta(table(s, d, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", *_r("beta", "slope"))


def group_ranks(s: Session, d: str) -> DataFrame:
    p = table(s, d, "part", "p_partkey", "p_brand", "p_retailprice")
    r = profile.placed(p, ["p_brand"], [-F.col("p_retailprice"), F.col("p_partkey")])
    sums = p.groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"))
    small, big = F.floor(F.col("n") / 4), F.col("n") % 4
    k = F.col("place") - 1
    quarter = F.when(k < big * (small + 1), F.floor(k / (small + 1))).otherwise(big + F.floor((k - big * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    pct = F.coalesce(F.try_divide(k, F.nullif(F.col("n") - 1, F.lit(0))), F.lit(0.0))
    return r.join(sums, "p_brand").select("p_partkey", "place", F.round(pct, 4).alias("pct"), quarter.cast("int").alias("quarter"), F.round(F.col("p_retailprice") / F.col("total") * 100, 4).alias("share"))


def priority_stats(s: Session, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")
    g = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("mean_filled"), F.round(F.stddev_samp("o_totalprice"), 2).alias("sd"))
    p = profile.quantiles(o, ["o_totalprice"], [0.9], ["o_orderpriority"]).select("o_orderpriority", F.round("value", 2).alias("p90"))
    return g.join(p, "o_orderpriority")


def cube(s: Session, d: str) -> DataFrame:
    return table(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.count("*").alias("n"))


def event_props(s: Session, d: str) -> DataFrame:
    e = table(s, d, "events", "event_type", "props")
    return e.select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v")).groupBy("event_type", "key").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def run_pairs(s: Session, d: str) -> DataFrame:
    """Signups with the same user's next purchase within a day; runs without one are open."""
    e = table(s, d, "events", "event_id", "ts", "user_id", "event_type")
    behind = series.reversed_(["user_id"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(behind)
    t = e.withColumn("done", nxt).where("event_type = 'signup'")
    return t.select("event_id", F.when(F.col("done") <= F.col("ts") + F.expr("interval 1 day"), "done").otherwise("open").alias("outcome"))


def closure(s: Session, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("p"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("c"))
    sup = table(s, d, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("p"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("c"))
    roots = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("root"))
    return joins.closure(n.unionByName(sup), roots, parent="p", child="c", root="root")


QUESTIONS = [("q1", "gross margin and freight costs"), ("q2", "search interest in the home market"), ("q3", "covenant test headroom net debt")]


def _questions(s: Session) -> DataFrame:
    return s.createDataFrame(QUESTIONS, "query_id string, query string")


def _docs(s: Session, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text")


def term_totals(s: Session, d: str) -> DataFrame:
    t = text.term_counts(_docs(s, d), id="doc_id", text="text")
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_top(s: Session, d: str) -> DataFrame:
    b = text.bm25(_docs(s, d), _questions(s), id="doc_id", text="text", query_id="query_id", query="query").withColumn("score", F.round("score", 6))
    return text.top_k(b, by="query_id", score="score", id="doc_id", k=20)


def fused(s: Session, d: str) -> DataFrame:
    return text.fuse(bm25_top(s, d), query_id="query_id", id="doc_id", score="score").select("doc_id", F.round("rrf", 6).alias("rrf"), F.round("best_score", 4).alias("best_score"), F.size("queries").alias("n_queries"))


def found_snippets(s: Session, d: str) -> DataFrame:
    f = text.search(_docs(s, d), _questions(s), id="doc_id", text="text", query_id="query_id", query="query")
    return f.select("doc_id", F.round("rrf", 6).alias("rrf"), "snippet")


def chunk_offsets(s: Session, d: str) -> DataFrame:
    return text.chunks(_docs(s, d), text="text", size=600, overlap=80).select("doc_id", "chunk_no", "start", "end")


QUERIES = {f.__name__: f for f in (
    growth_quarterly, segment_share, segment_pivot, segment_long, scaled_revenue, tail_rows, growth_span, filled_gaps, asof_signup, calendar_changes, latest_state, merged_state, idle_customers, active_nations, fiscal_sums,
    weekly_complete, search_interest, interest_quarters, interest_gaps, holdings_rollup, position_changes, statement_ratios, health, revenue_bridge, earnings_surprise, segment_matrix, breakeven_price,
    rfm, describe, correlations, rank_correlation, missing, duplicates, shape, outliers, z_scores, quality, beta, group_ranks, priority_stats, cube, event_props, run_pairs, closure, term_totals, bm25_top,
    fused, found_snippets, chunk_offsets,
)}

_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 1)"
_BM = (
    "WITH qs(query_id, query) AS (VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in QUESTIONS) + "), q AS (SELECT query_id, t AS term, count(*) AS qf FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: length(w) > 1)) AS t FROM qs) GROUP BY 1, 2), "
    f"d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM d) GROUP BY 1, 2, 3), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), sc AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2), "
    "rk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank_no FROM sc WHERE score > 0 QUALIFY rank_no <= 20)"
)
_WIN = "OVER (PARTITION BY segment ORDER BY day)"
_STATS = "SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem"

_INTEREST = "WITH v AS (SELECT DISTINCT env_id, raw_response.interest_over_time.timeline_data AS tl FROM vsco_3m_daily), t AS (SELECT env_id, unnest(tl) AS t FROM v), p AS (SELECT env_id, CAST(make_timestamp(try_cast(t.timestamp AS BIGINT) * 1000000) AS DATE) AS day, unnest(t.values) AS x, t.partial_data AS pd FROM t WHERE t IS NOT NULL), i AS (SELECT x.query AS q, day, arg_max(x.extracted_value, env_id) AS interest FROM p WHERE x IS NOT NULL AND day IS NOT NULL AND x.query IS NOT NULL AND NOT coalesce(pd, false) GROUP BY 1, 2)"
_RATIOS = "WITH g AS (SELECT l_suppkey AS supplier, sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS ni, sum(l_extendedprice * l_tax) AS cogs, sum(l_quantity) AS sh FROM lineitem GROUP BY 1), r AS (SELECT supplier, round((rev - cogs) / rev, 4) AS gross_margin, round(ni / rev, 4) AS net_margin, round(ni / (rev * 2), 4) AS roa, round(30 / (ni / sh), 4) AS pe FROM g)"
_UNIVERSE_DAY = "CASE WHEN regexp_matches(trim(date), '^[0-9]{4}([-/]?)[0-9]{2}[-/]?[0-9]{2}([T ].*)?$') THEN try_cast(regexp_replace(trim(date), '^([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2}).*$', '\\1-\\2-\\3') AS DATE) END"
#: Snapshots before and from 2024 on, by slot; what is left on both sides of a ticker and type pairs if it is one each.
_CALENDAR = (
    f"WITH e AS (SELECT DISTINCT event_id, nullif(replace(upper(trim(ticker)), '.', '-'), '') AS ticker, type, nullif(trim(ref), '') AS ref, {_UNIVERSE_DAY} AS day, status, fetched_at FROM universe_events WHERE fetched_at IS NOT NULL), s AS (SELECT *, coalesce(ref, CAST(day AS VARCHAR)) AS slot, fetched_at >= '2024-01-01' AS late FROM e), "
    "k AS (SELECT late, ticker, type, slot, ref, day, status FROM s QUALIFY row_number() OVER (PARTITION BY late, ticker, type, slot ORDER BY fetched_at DESC, day DESC NULLS LAST, status DESC NULLS LAST) = 1), "
    "j AS (SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.type, n.type) AS type, o.slot IS NOT NULL OR o.late IS NOT NULL AS o, n.late IS NOT NULL AS n, o.ref AS old_ref, n.ref AS new_ref, o.day AS old_day, n.day AS new_day, o.status AS old_status, n.status AS new_status FROM (SELECT * FROM k WHERE NOT late) o FULL JOIN (SELECT * FROM k WHERE late) n ON o.ticker = n.ticker AND o.type = n.type AND o.slot = n.slot), "
    "c AS (SELECT DISTINCT ticker, type FROM k WHERE late), f AS (SELECT j.*, coalesce(NOT n AND c.ticker IS NOT NULL AND old_day >= DATE '2024-01-01', false) AS gone, coalesce(NOT o AND new_day >= DATE '2024-01-01', false) AS fresh FROM j LEFT JOIN c ON c.ticker = j.ticker AND c.type = j.type), "
    "w AS (SELECT *, sum(gone::INT) OVER p AS ng, sum(fresh::INT) OVER p AS nf, max(old_day) FILTER (WHERE gone) OVER p AS pd, max(old_status) FILTER (WHERE gone) OVER p AS ps FROM f WINDOW p AS (PARTITION BY ticker, type)), x AS (SELECT *, ng = 1 AND nf = 1 AND ticker IS NOT NULL AND type IS NOT NULL AS pair FROM w), "
    "y AS (SELECT ticker, type, coalesce(new_ref, old_ref) AS ref, CASE WHEN pair AND fresh THEN 'moved' WHEN NOT o THEN 'new' WHEN gone THEN 'dropped' WHEN NOT n THEN 'kept' WHEN old_day IS DISTINCT FROM new_day THEN 'moved' WHEN old_status IS DISTINCT FROM new_status THEN 'status_changed' ELSE 'unchanged' END AS change, CASE WHEN pair AND fresh THEN pd ELSE old_day END AS old_day, new_day, CASE WHEN pair AND fresh THEN ps ELSE old_status END AS old_status, new_status FROM x WHERE NOT (pair AND gone)) SELECT * FROM y WHERE change <> 'kept'"
)

SQL = {
    "growth_quarterly": _SEG.format(unit="quarter") + f" SELECT segment, day, round(revenue, 2) AS revenue, round((revenue - lag(revenue, 4) {_WIN}) / abs(lag(revenue, 4) {_WIN}) * 100, 2) AS yoy, round(CASE WHEN row_number() {_WIN} >= 4 THEN sum(revenue) OVER (PARTITION BY segment ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END, 2) AS ttm, round(revenue / first_value(revenue) {_WIN} * 100, 2) AS rebased, round(lead(revenue) {_WIN}, 2) AS next FROM s",
    "segment_share": _SEG.format(unit="year") + " SELECT segment, day, round(revenue / sum(revenue) OVER (PARTITION BY day) * 100, 4) AS share, CAST(rank() OVER (PARTITION BY day ORDER BY revenue DESC) AS INTEGER) AS place FROM s",
    "segment_pivot": _SEG.format(unit="year") + " SELECT day, " + ", ".join(f"round(coalesce(sum(revenue) FILTER (WHERE segment = '{x}'), 0), 2) AS {x.lower()}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM s GROUP BY day",
    "segment_long": _SEG.format(unit="year") + " SELECT day, lower(segment) AS segment, round(revenue, 2) AS revenue FROM s WHERE round(revenue, 2) <> 0",
    "scaled_revenue": _SEG.format(unit="year") + ", m AS (SELECT segment, max(abs(revenue)) AS x FROM s GROUP BY 1), v AS (SELECT segment, CAST(CASE WHEN x >= 1e12 THEN 1e12 WHEN x >= 1e9 THEN 1e9 WHEN x >= 1e6 THEN 1e6 WHEN x >= 1e3 THEN 1e3 ELSE 1 END AS DOUBLE) AS divisor FROM m) SELECT segment, day, divisor, round(revenue / divisor, 4) AS scaled FROM s JOIN v USING (segment)",
    "tail_rows": _SEG.format(unit="quarter") + " SELECT segment, day, round(revenue, 2) AS revenue FROM s QUALIFY row_number() OVER (PARTITION BY segment ORDER BY day DESC) <= 4",
    "growth_span": _SEG.format(unit="year") + ", g AS (SELECT segment, arg_min(revenue, day) AS a, arg_max(revenue, day) AS z, CAST(year(max(day)) - year(min(day)) AS INTEGER) AS years FROM s GROUP BY 1) SELECT segment, years, round((pow(z / a, 1.0 / years) - 1) * 100, 4) AS cagr FROM g",
    "filled_gaps": "WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS last_purchase, round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS next_purchase FROM e",
    "asof_signup": "WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), g AS (SELECT user_id, ts, max(value) AS signup_value FROM events WHERE event_type = 'signup' GROUP BY 1, 2) SELECT b.event_id, b.user_id, round(g.signup_value, 4) AS signup_value FROM b ASOF LEFT JOIN g ON b.user_id = g.user_id AND b.ts >= g.ts",
    "latest_state": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) = 1",
    "merged_state": "WITH c AS (SELECT * FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders WHERE o_totalprice > 300000 GROUP BY 1) SELECT c_custkey, c_name, round(coalesce(p, c_acctbal), 2) AS c_acctbal FROM c FULL JOIN b USING (c_custkey)",
    "idle_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "active_nations": "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)",
    "fiscal_sums": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders), q AS (SELECT last_day(CAST(day + to_months(CAST((3 + (1 - month(day)) % 3) % 3 AS INTEGER)) AS DATE)) AS quarter_end, o_totalprice FROM o) SELECT 'FY' || CAST(year(quarter_end) + CASE WHEN month(quarter_end) > 1 THEN 1 ELSE 0 END AS VARCHAR) || 'Q' || CAST(CASE month(quarter_end) WHEN 4 THEN 1 WHEN 7 THEN 2 WHEN 10 THEN 3 ELSE 4 END AS VARCHAR) AS fiscal_quarter, quarter_end, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM q GROUP BY quarter_end",
    "weekly_complete": "WITH e AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2) SELECT symbol, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS week, CAST(sum(n) AS BIGINT) AS n_orders FROM e GROUP BY 1, 2 HAVING count(*) = 7",
    "holdings_rollup": "WITH l AS (SELECT l_suppkey AS filing, l_orderkey * 10 + l_linenumber AS line_no, p_brand AS issuer, substr(replace(p_brand, '#', '0') || 'XX0', 1, 6) AS cusip6, CAST(round(l_extendedprice) AS BIGINT) AS value, CAST(l_quantity AS BIGINT) AS shares, l_returnflag = 'R' AS opt FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT filing, CASE WHEN quantile_cont(value / shares, 0.5) FILTER (WHERE NOT opt AND shares > 0) < 5 THEN 1000 ELSE 1 END AS k FROM l GROUP BY 1), nm AS (SELECT filing, cusip6, issuer FROM (SELECT filing, cusip6, issuer, row_number() OVER (PARTITION BY filing, cusip6 ORDER BY count(*) DESC, min(line_no)) AS n FROM l GROUP BY 1, 2, 3) WHERE n = 1), g AS (SELECT filing, cusip6, CAST(sum(value * k) AS BIGINT) AS value_usd, CAST(coalesce(sum(shares) FILTER (WHERE NOT opt), 0) AS BIGINT) AS shares, CASE WHEN bool_or(opt) THEN 'Put' ELSE '' END AS derivative FROM l JOIN u USING (filing) GROUP BY 1, 2) SELECT filing, cusip6, issuer, value_usd, shares, derivative, round(100.0 * value_usd / sum(value_usd) OVER (PARTITION BY filing), 4) AS pct FROM g JOIN nm USING (filing, cusip6)",
    "position_changes": "WITH a AS (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS before FROM lineitem WHERE year(l_shipdate) <= 1996 GROUP BY 1, 2), z AS (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS after FROM lineitem WHERE year(l_shipdate) > 1996 GROUP BY 1, 2) SELECT l_suppkey, l_partkey, before, after, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'exit' WHEN after > before THEN 'add' WHEN after < before THEN 'trim' ELSE 'hold' END AS change FROM a FULL JOIN z USING (l_suppkey, l_partkey)",
    "statement_ratios": "WITH g AS (SELECT l_suppkey AS supplier, sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS ni, sum(l_extendedprice * l_tax) AS cogs, sum(l_quantity) AS sh FROM lineitem GROUP BY 1), f AS (SELECT g.*, abs(s_acctbal) * 1000 AS eq, rev * 2 AS ta FROM g JOIN supplier ON s_suppkey = supplier) SELECT supplier, round(ni / eq, 4) AS roe, round(ni / ta, 4) AS roa, round((rev - cogs) / rev, 4) AS gross_margin, round(ni / rev, 4) AS net_margin, round(rev / ta, 4) AS asset_turnover, round(ni / sh, 4) AS eps, round(30 / (ni / sh), 4) AS pe, round(30 / (eq / sh), 4) AS pb, round(30 * sh / rev, 4) AS ps, CAST(0 AS DOUBLE) AS current_ratio FROM f",
    "revenue_bridge": "WITH i AS (SELECT DISTINCT inc_id, coalesce(revenue, 0) AS r, coalesce(costOfRevenue, 0) AS c, coalesce(operatingExpenses, 0) AS e, coalesce(incomeBeforeTax, netIncome + coalesce(incomeTaxExpense, 0)) AS p, netIncome AS n FROM aapl_income_quarter) SELECT inc_id, step_no, step, CAST(amount AS BIGINT) AS amount FROM (SELECT inc_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step_no, unnest(['revenue', 'cost of revenue', 'gross profit', 'operating expenses', 'operating income', 'other', 'income tax', 'net income']) AS step, unnest([r, -c, r - c, -e, r - c - e, p - (r - c - e), n - p, n]) AS amount FROM i)",
    "earnings_surprise": "SELECT DISTINCT earn_id, round((epsActual - epsEstimated) / nullif(abs(epsEstimated), 0) * 100, 4) AS eps_surprise, round((revenueActual - revenueEstimated) / CAST(nullif(abs(revenueEstimated), 0) AS DOUBLE) * 100, 4) AS revenue_surprise FROM aapl_earnings WHERE epsActual IS NOT NULL",
    "search_interest": "WITH v AS (SELECT DISTINCT env_id, raw_response.interest_over_time.timeline_data AS tl FROM vsco_3m_daily), t AS (SELECT env_id, unnest(tl) AS t FROM v), p AS (SELECT env_id, CAST(make_timestamp(try_cast(t.timestamp AS BIGINT) * 1000000) AS DATE) AS day, unnest(t.values) AS x, t.partial_data AS pd FROM t WHERE t IS NOT NULL) SELECT x.query AS q, day, arg_max(x.extracted_value, env_id) AS interest FROM p WHERE x IS NOT NULL AND day IS NOT NULL AND x.query IS NOT NULL AND NOT coalesce(pd, false) GROUP BY 1, 2",
    "breakeven_price": "SELECT p_partkey, CASE WHEN p_retailprice / 0.8 BETWEEN 0 AND 5000 THEN round(p_retailprice / 0.8, 3) END AS breakeven FROM part",
    "rfm": "WITH o AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS l, count(DISTINCT o_orderkey) AS f, sum(o_totalprice) AS m FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-08-01' GROUP BY 1), d AS (SELECT c_custkey, CAST(date_diff('day', l, DATE '1998-08-01') AS INTEGER) AS recency, coalesce(f, 0) AS frequency, coalesce(m, 0) AS money FROM customer LEFT JOIN o ON o_custkey = c_custkey) SELECT c_custkey, recency, frequency, round(money, 2) AS money, CAST(ntile(5) OVER (ORDER BY -coalesce(recency, 1000000), c_custkey) AS INTEGER) AS r, CAST(ntile(5) OVER (ORDER BY frequency, c_custkey) AS INTEGER) AS f, CAST(ntile(5) OVER (ORDER BY money, c_custkey) AS INTEGER) AS m FROM d",
    "describe": " UNION ALL ".join(_STATS.format(c=c) for c in LINE),
    "correlations": " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem GROUP BY 1" for i, a in enumerate(LINE) for b in LINE[i + 1 :]),
    "rank_correlation": "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 4) AS r FROM r GROUP BY 1",
    "missing": " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS share FROM documents" for c in ("doc_id", "text", "lang", "source", "symbol", "doc_date")),
    "duplicates": "WITH p AS (SELECT count(*) AS c FROM documents GROUP BY text, lang, source) SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates FROM p",
    "shape": "SELECT l_returnflag, round(skewness(l_extendedprice), 4) AS skew, round(kurtosis(l_extendedprice), 4) AS kurt FROM lineitem GROUP BY 1",
    "outliers": "WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS z FROM orders GROUP BY 1) SELECT o_orderkey, round(a - 0.5 * (z - a), 2) AS lo, round(z + 0.5 * (z - a), 2) AS hi FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice < a - 0.5 * (z - a) OR o_totalprice > z + 0.5 * (z - a)",
    "z_scores": "WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_id, round((value - m) / nullif(sd, 0), 4) AS z FROM events JOIN s USING (event_type) WHERE abs((value - m) / nullif(sd, 0)) > 2",
    "quality": "WITH r AS (SELECT *, CASE WHEN name IN ('Revenue', 'Net income', 'Net margin') AND data > 0 THEN 1 ELSE 0 END AS ok, (CASE WHEN symbol IS NULL THEN 0 ELSE 1 END) + (CASE WHEN category IS NULL THEN 0 ELSE 1 END) + (CASE WHEN name IS NULL THEN 0 ELSE 1 END) + (CASE WHEN data IS NULL THEN 0 ELSE 1 END) + (CASE WHEN unit IS NULL THEN 0 ELSE 1 END) + (CASE WHEN currency IS NULL THEN 0 ELSE 1 END) + 1 AS f FROM revenue_margins), a AS (SELECT sum(f) / (count(*) * 7.0) AS c, count(DISTINCT point_id) / CAST(count(*) AS DOUBLE) AS u, sum(ok) / CAST(count(*) AS DOUBLE) AS v FROM r) SELECT round(CAST(c AS DOUBLE), 4) AS completeness, round(u, 4) AS uniqueness, round(v, 4) AS validity, round(CAST((c + u + v) / 3 AS DOUBLE), 4) AS score FROM a",
    "beta": "SELECT l_returnflag, round(covar_samp(l_extendedprice, l_quantity) / var_pop(l_quantity), 4) AS beta, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1",
    "group_ranks": "SELECT p_partkey, CAST(row_number() OVER o AS INTEGER) AS place, round(percent_rank() OVER o, 4) AS pct, CAST(ntile(4) OVER o AS INTEGER) AS quarter, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand) * 100, 4) AS share FROM part WINDOW o AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)",
    "priority_stats": "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS mean_filled, round(stddev_samp(o_totalprice), 2) AS sd, round(quantile_cont(o_totalprice, 0.9), 2) AS p90 FROM orders GROUP BY 1",
    "cube": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "event_props": "WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events WHERE json_extract(props, '$.k') IS NOT NULL) SELECT event_type, 'k' AS key, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM e GROUP BY 1",
    "run_pairs": "WITH e AS (SELECT event_id, ts, event_type, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS done FROM events) SELECT event_id, CASE WHEN done <= ts + INTERVAL 1 DAY THEN 'done' ELSE 'open' END AS outcome FROM e WHERE event_type = 'signup'",
    "closure": "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), x AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, c, depth + 1 FROM x JOIN e ON p = node) SELECT root, node, depth FROM x",
    "term_totals": f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM c GROUP BY 1",
    "bm25_top": _BM + " SELECT query_id, doc_id, score, CAST(rank_no AS INTEGER) AS rank_no FROM rk",
    "fused": _BM + " SELECT doc_id, round(sum(1.0 / (60 + rank_no)), 6) AS rrf, round(max(score), 4) AS best_score, CAST(count(DISTINCT query_id) AS INTEGER) AS n_queries FROM rk GROUP BY 1",
    "chunk_offsets": "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, text, n, unnest(range(0, n, 520)) AS s FROM d) SELECT doc_id, CAST(s // 520 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, CAST(least(s + 600, n) AS INTEGER) AS \"end\" FROM c WHERE (s = 0 OR s - 520 + 600 < n) AND NOT regexp_full_match(text[s + 1 : least(s + 600, n)], '\\s*')",
    "calendar_changes": _CALENDAR,
    "interest_quarters": _INTEREST + ", m AS (SELECT q, interest, last_day(CAST(day + to_months(CAST((3 + (1 - month(day)) % 3) % 3 AS INTEGER)) AS DATE)) AS e FROM i) SELECT q, 'FY' || CAST(year(e) + CASE WHEN month(e) > 1 THEN 1 ELSE 0 END AS VARCHAR) || 'Q' || CAST(CASE month(e) WHEN 4 THEN 1 WHEN 7 THEN 2 WHEN 10 THEN 3 ELSE 4 END AS VARCHAR) AS fiscal_quarter, CAST(coalesce(sum(interest), 0) AS BIGINT) AS interest, count(*) AS n_confirmed FROM m GROUP BY q, e",
    "interest_gaps": _INTEREST + ", g AS (SELECT q, date_diff('day', lag(day) OVER (PARTITION BY q ORDER BY day), day) * 86400 AS g FROM i), m AS (SELECT q, min(g) AS gap_seconds FROM g WHERE g > 0 GROUP BY 1) SELECT q, gap_seconds, CASE WHEN gap_seconds < 72000 THEN 'hourly' WHEN gap_seconds < 432000 THEN 'daily' WHEN gap_seconds < 1728000 THEN 'weekly' ELSE 'monthly' END AS granularity FROM m",
    "health": _RATIOS + ", l AS (SELECT supplier, CASE WHEN gross_margin >= 0.97 THEN 4 WHEN gross_margin >= 0.96 THEN 3 WHEN gross_margin >= 0.95 THEN 2 ELSE 1 END + CASE WHEN net_margin >= 0.055 THEN 4 WHEN net_margin >= 0.05 THEN 3 WHEN net_margin >= 0.045 THEN 2 ELSE 1 END + CASE WHEN roa >= 0.026 THEN 4 WHEN roa >= 0.025 THEN 3 WHEN roa >= 0.024 THEN 2 ELSE 1 END + CASE WHEN pe <= 400 THEN 4 WHEN pe <= 450 THEN 3 WHEN pe <= 500 THEN 2 ELSE 1 END AS s FROM r) SELECT supplier, round(s / 4, 4) AS score, CASE WHEN s >= 14 THEN 'excellent' WHEN s >= 10 THEN 'good' WHEN s >= 6 THEN 'fair' ELSE 'poor' END AS band FROM l",
    "segment_matrix": "WITH g AS (SELECT DISTINCT seg_id, symbol, fiscalYear AS year, data FROM aapl_segmentation), k AS (SELECT symbol, year, CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN data END AS data FROM g), f AS (SELECT symbol, year, data, unnest(json_keys(data)) AS segment FROM k WHERE data IS NOT NULL), "
    "v AS (SELECT symbol, year, segment, map_extract_value(from_json(data, '\"MAP(VARCHAR, JSON)\"'), segment) AS j FROM f), a AS (SELECT symbol, year, segment, coalesce(try_cast(replace(regexp_replace(CASE json_type(j) WHEN 'OBJECT' THEN coalesce(j->>'$.amount', j->>'$.value') WHEN 'VARCHAR' THEN j->>'$' ELSE CAST(j AS VARCHAR) END, '\\s', '', 'g'), ',', '') AS DECIMAL(30, 6)), 0) AS amount FROM v), "
    "y AS (SELECT symbol, year FROM (SELECT DISTINCT symbol, year FROM k WHERE data IS NOT NULL AND year IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) <= 3), s AS (SELECT symbol, year, segment, sum(amount) AS amount FROM a JOIN y USING (symbol, year) GROUP BY 1, 2, 3), l AS (SELECT symbol, segment FROM s GROUP BY 1, 2 HAVING sum(abs(amount)) > 0) SELECT symbol, year, segment, CAST(coalesce(amount, 0) AS DOUBLE) AS amount FROM l JOIN y USING (symbol) LEFT JOIN s USING (symbol, year, segment)",
    "found_snippets": _BM + f", fu AS (SELECT doc_id, sum(1.0 / (60 + rank_no)) AS rrf FROM rk GROUP BY 1 ORDER BY rrf DESC, doc_id LIMIT 10), ts AS (SELECT list(DISTINCT term) AS ts FROM q), p AS (SELECT doc_id, rrf, text, list_min(list_filter(list_transform(ts, lambda t: instr(lower(text), t)), lambda i: i > 0)) AS pos FROM fu JOIN documents USING (doc_id), ts) SELECT doc_id, round(rrf, 6) AS rrf, trim(regexp_replace(substr(text, greatest(coalesce(pos, 1) - 80, 1), 240), '\\s+', ' ', 'g')) AS snippet FROM p",
}
