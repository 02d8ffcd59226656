"""Operators of series, joins, merges, profiles, models and text on small inputs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fundamentals, holdings, joins, models, profile, recursive, series, text, trends, upsert


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def D(s):
    return dt.date.fromisoformat(s)


def naive_wilder(x, n):
    out, known = [None] * len(x), [i for i, v in enumerate(x) if v is not None]
    if len(known) >= n:
        at = known[0] + n - 1
        out[at] = sum(x[known[0] : at + 1]) / n
        for i in range(at + 1, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def walk(n=300, seed=0):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    return pd.DataFrame({"symbol": "X", "day": pd.date_range("2023-01-02", periods=n).date, "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": r.integers(1, 9, n).astype(float)})


def test_recursions_against_loops():
    b = walk()
    t = recursive.indicators(b)
    c, h, lo = list(b.close), list(b.high), list(b.low)
    same = lambda got, want: [None if g is None else round(g, 8) for g in got] == [None if w is None else round(w, 8) for w in want]
    d = [None, *[c[i] - c[i - 1] for i in range(1, len(c))]]
    up, dn = naive_wilder([None if x is None else max(x, 0) for x in d], 14), naive_wilder([None if x is None else max(-x, 0) for x in d], 14)
    assert same(list(t.rsi14), [None if u is None else 100 - 100 / (1 + u / w) for u, w in zip(up, dn)])
    tr = [h[0] - lo[0], *[max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, len(c))]]
    assert same(list(t.atr14), naive_wilder(tr, 14))
    assert t.macd_signal.first_valid_index() == 25 + 8 and t.adx14.first_valid_index() == 14 + 13
    assert set(t.supertrend_dir.dropna()) <= {1.0, -1.0} and t.supertrend.first_valid_index() == 9
    s = t.dropna(subset=["supertrend"])
    assert all((x.close >= x.supertrend) == (x.supertrend_dir == 1) for x in s.itertuples())


def test_rsi_flat_and_rising():
    assert recursive.rsi(np.full(20, 5.0), 14)[-1] == 50 and recursive.rsi(np.arange(20.0), 14)[-1] == 100
    assert np.isnan(recursive.rsi(np.arange(5.0), 14)).all() and len(recursive.rsi(np.zeros(0), 14)) == 0


def test_indicators_spark(spark):
    b = pd.concat([walk(40), walk(40, 1).assign(symbol="Y")])
    t = recursive.with_indicators(spark.createDataFrame(b))
    assert t.count() == 80 and t.where("symbol = 'Y' and rsi14 is null").count() == 14


def test_clean_bars(spark):
    d = spark.createDataFrame([("A", "d1", 1, 0.0, None, 9.0, 10.0, 5.0, 1.0), ("A", "d1", 2, 8.0, 12.0, 7.0, 10.0, 5.0, None), ("A", None, 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", "d2", 4, 1.0, 1.0, 1.0, None, 1.0, 1.0)], "symbol string, day string, seq int, open double, high double, low double, close double, adj double, volume double")
    r = series.clean_bars(d, symbol="symbol", day="day", arrival="seq", adjusted="adj").collect()
    assert len(r) == 1 and (r[0].open, r[0].high, r[0].close, r[0].volume) == (4.0, 6.0, 5.0, 0.0)


def test_series_nulls(spark):
    d = spark.createDataFrame([("A", i, v) for i, v in enumerate([None, 0.0, 10.0, None, 20.0])], "symbol string, day int, v double")
    w = series.ordered()
    t = d.select("day", series.rebase(F.col("v"), w).alias("r"), series.lagged_growth(F.col("v"), w).alias("g"), series.fill(F.col("v"), ["symbol"], ["day"]).alias("f"), series.fill(F.col("v"), ["symbol"], ["day"], False).alias("b"), series.trailing_sum(F.col("v"), w, 2).alias("s"))
    assert rows(t, "day") == [(0, None, None, None, 0.0, None), (1, 0.0, None, 0.0, 0.0, None), (2, 100.0, None, 10.0, 10.0, 10.0), (3, None, None, 10.0, 20.0, None), (4, 200.0, None, 20.0, 20.0, None)]
    assert [r.day for r in series.trim_leading(d, ["v"], w).orderBy("day").collect()] == [1, 2, 3, 4]


def test_asof(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, None, 5), (4, "y", None), (5, "x", 2)], "id int, k string, t int")
    b = spark.createDataFrame([("x", 2, 1.0), ("x", 2, 3.0), ("x", 4, None), (None, 1, 9.0)], "k string, t int, v double")
    assert rows(joins.asof_backward(a, b, by=["k"], time="t", values=["v"]).select("id", "v"), "id") == [(1, None), (2, None), (3, None), (4, None), (5, 3.0)]
    assert rows(joins.asof_backward(a, b, by=["k"], time="t", values=["v"], strict=True).where("id = 5").select("v")) == [(None,)]


def test_range_join(spark):
    p = spark.createDataFrame([("a", D("2024-01-31")), ("a", D("2024-03-01")), ("b", None)], "k string, d date")
    r = spark.createDataFrame([("a", D("2023-01-01"), D("2024-01-31"), 1), ("a", D("2024-02-01"), D("2024-03-01"), 2), ("a", D("2024-05-01"), D("2024-01-01"), 3), ("b", None, None, 4)], "k string, s date, e date, n int")
    assert rows(joins.range_join(p, r, by=["k"], point="d", start="s", end="e").select("d", "n"), "d") == [(D("2024-01-31"), 1), (D("2024-03-01"), 2)]


def test_snapshot_diff(spark):
    c = "ticker string, type string, ref string, day date, status string"
    old = [("A", "earn", None, D("2026-07-01"), "est"), ("A", "div", "R1", D("2026-08-01"), "est"), ("A", "lock", None, D("2026-09-01"), "est"), ("A", "div", "R2", D("2026-01-01"), "est"), ("A", "div", "R3", D("2026-10-01"), "est"), ("A", "idx", "R9", D("2026-10-01"), "est"), ("A", "idx", "R8", D("2026-10-02"), "est")]
    new = [("A", "earn", None, D("2026-07-09"), "conf"), ("A", "div", "R1", D("2026-08-01"), "conf"), ("A", "div", "R3", D("2026-10-05"), "conf"), ("A", "idx", "R7", D("2026-11-01"), "est"), ("B", "div", None, D("2026-08-01"), None)]
    got = {(r.ticker, r.type, r.ref, str(r.old_day), str(r.new_day)): r.change for r in joins.snapshot_diff(spark.createDataFrame(old, c), spark.createDataFrame(new, c), by="ticker", kind="type", ref="ref", day="day", status="status", today="2026-06-12").collect()}
    assert got == {
        ("A", "earn", None, "2026-07-01", "2026-07-09"): "moved", ("A", "div", "R1", "2026-08-01", "2026-08-01"): "status_changed", ("A", "lock", None, "2026-09-01", "None"): "kept", ("A", "div", "R2", "2026-01-01", "None"): "kept",
        ("A", "div", "R3", "2026-10-01", "2026-10-05"): "moved", ("A", "idx", "R9", "2026-10-01", "None"): "dropped", ("A", "idx", "R8", "2026-10-02", "None"): "dropped", ("A", "idx", "R7", "None", "2026-11-01"): "new", ("B", "div", None, "None", "2026-08-01"): "new",
    }


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "p string, c string")
    r = spark.createDataFrame([("a",), ("d",), (None,)], "root string")
    assert rows(joins.closure(e, r, parent="p", child="c", root="root"), "root", "depth") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "d", 0)]


def test_fallback_and_quarters(spark):
    d = spark.createDataFrame([("t",), ("z",), (None,)], "k string")
    b = spark.createDataFrame([("t", 1), ("general", 2)], "k string, v int")
    assert sorted(rows(joins.with_fallback(d, b, key="k", values=["v"], default_key="general")), key=str) == [("t", 1), ("z", 2), (None, 2)]
    q = spark.createDataFrame([(D("2024-01-28"),), (D("2024-04-30"),), (D("2024-11-20"),)], "d date").select(joins.nearest_bucket(F.col("d")))
    assert [r[0] for r in q.collect()] == [D("2023-12-31"), D("2024-03-31"), D("2024-12-31")]


def test_merges(spark):
    s = spark.createDataFrame([(1, "a", "true"), (2, "b", ""), (None, "n", None)], "id int, v string, active string")
    b = spark.createDataFrame([(1, None, 2), (1, "z", 1), (3, "c", 1)], "id int, v string, n int")
    assert sorted(rows(upsert.upsert(s, b, ["id"], "n").select("id", "v")), key=str) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    assert upsert.insert_missing(s, b, ["id"], "n").count() == 4
    assert upsert.delete(s, b, ["id"]).count() == 2
    off = upsert.set_flag(s, b.where("id = 1"), ["id"], "active", "false")
    assert upsert.active(s).count() == 3 and upsert.active(off).count() == 2
    p = spark.createDataFrame([("k", "2024-01-01", 1), ("k", "2024-01-02", 2)], "s string, day string, v int")
    src = spark.createDataFrame([("k", "2024-01-01", 9), ("k", "2024-01-02", 5), ("k", "2024-01-03", 6)], "s string, day string, v int")
    once = upsert.sync(p, src, ["s", "day"], "day")
    assert rows(once.select("day", "v"), "day") == [("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-03", 6)]
    assert rows(upsert.sync(once, src, ["s", "day"], "day"), "day") == rows(once, "day")
    assert upsert.sync(p.limit(0), src, ["s", "day"], "day").count() == 3
    # An entity that lags loses none of the days since its own last one; a new entity comes whole.
    lag = spark.createDataFrame([("k", "2024-01-09", 1), ("slow", "2024-01-01", 1)], p.schema)
    more = spark.createDataFrame([("slow", "2024-01-01", 2), ("slow", "2024-01-02", 3), ("k", "2024-01-08", 9), ("new", "2023-01-01", 4)], p.schema)
    assert sorted(rows(upsert.sync(lag, more, ["s", "day"], "day"))) == [("k", "2024-01-09", 1), ("new", "2023-01-01", 4), ("slow", "2024-01-01", 2), ("slow", "2024-01-02", 3)]
    assert sorted(rows(upsert.sync(lag, more, ["s", "day"], "day", entity=[]).where("s = 'slow'"))) == [("slow", "2024-01-01", 1)]
    assert rows(upsert.metadata(src, "day", ["s"])) == [("k", 3, "2024-01-01", "2024-01-03")]


def test_profile(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, None)], "k int, v double")
    s = rows(profile.shape(d, "v", ["k"]).where("k = 1"))[0]
    assert math.isclose(s[1], 1.764, abs_tol=1e-3) and math.isclose(s[2], 3.228, abs_tol=1e-3)
    assert rows(profile.missing(d))[1][:3] == ("v", 5, 1) and rows(profile.duplicates(d))[0] == (5, 5, 0)
    assert rows(profile.describe(d, ["v"]))[0][:3] == ("v", 4, 4.0) and profile.describe(d.limit(0), ["v"]).collect()[0].n == 0
    t = profile.with_tiles(spark.createDataFrame([(i, float(i % 3)) for i in range(11)], "i int, v double"), {"q": F.col("v")}, F.col("i"), 4)
    order = sorted(range(11), key=lambda i: (i % 3, i))
    assert {r.i: r.q for r in t.collect()} == {i: (1 if n < 3 else 2 if n < 6 else 3 if n < 9 else 4) for n, i in enumerate(order)}
    assert profile.with_tiles(d.limit(0), {"q": F.col("v")}, F.col("k"), 4).count() == 0


def test_trends(spark):
    d = [(i, D("2024-01-07") + dt.timedelta(i)) for i in range(22)]
    daily = spark.createDataFrame([("k", w, day, float(i % 5) * f, i == 21) for i, day in d for w, f in ((0, 1.0), (1, 2.0))], "k string, w int, day date, v double, partial boolean")
    weeks = trends.complete_weeks(daily.where("w = 0"), keys=["k"], day="day", value="v", partial="partial")
    assert weeks.count() == 3
    st = trends.stitch(weeks.withColumn("value", F.col("value") * 3), daily, keys=["k"], window="w", day="day", value="v", partial="partial")
    got = {r.day: r.value for r in st.collect()}
    assert len(got) == 22 and math.isclose(got[D("2024-01-08")], 3.0) and st.first().overlap_weeks == 3
    w = spark.createDataFrame([(D("2024-01-01"), D("2024-12-31"))], "a date, z date")
    assert [(str(r.window_start), str(r.window_end)) for r in trends.windows(w, start="a", end="z").collect()] == [("2024-01-01", "2024-08-11"), ("2024-07-22", "2024-12-31")]
    f = spark.createDataFrame([(D("2026-04-30"),), (D("2027-01-31"),)], "d date").select(trends.fiscal_quarter(F.col("d"), 1))
    assert [r[0] for r in f.collect()] == ["FY2027Q1", "FY2027Q4"]
    q = trends.quarter_sums(daily.where("w = 0"), 1, keys=["k"], day="day", value="v", partial="partial", today="2024-01-28").collect()
    assert len(q) == 1 and q[0].fiscal_quarter == "FY2024Q4" and q[0].n_confirmed == 21 and q[0].is_partial
    assert trends.apportion(spark.createDataFrame([(D("2024-01-07"), 14.0)], "w date, v double"), week="w", value="v").agg(F.sum("day_value"), F.count("*")).first() == (14.0, 7)


def test_quarter_to_date(spark):
    days = [(D("2022-11-01") + dt.timedelta(i)) for i in range(480)]
    daily = spark.createDataFrame([("k", d, 2.0 if d.year == 2024 else 1.0, False) for d in days], "k string, day date, v double, partial boolean")
    r = trends.quarter_to_date(daily, 1, keys=["k"], day="day", value="v", partial="partial", today="2024-02-10", years=2).collect()
    assert len(r) == 1 and r[0].years_back == 1 and r[0].qtd == 10.0 and r[0].full_quarter == 89.0 and r[0].yoy == 2.0


def test_holdings(spark):
    c = "f string, line_no int, issuer string, cusip string, value long, shares long, shtype string, putcall string"
    d = spark.createDataFrame([("a", 1, "X", "123456001", 10, 5, "SH", None), ("a", 2, "X INC", "123456002", 20, 9, "SH", None), ("a", 3, "X", "123456003", 5, 7, "SH", "Call"), ("a", 4, "Y", "999999000", 0, 0, "SH", None), ("b", 1, "Z", "1", 900, 10, "SH", None)], c)
    r = {(x.f, x.cusip6): x for x in holdings.roll_up(d, "f").collect()}
    x = r["a", "123456"]
    assert (x.value_usd, x.shares, x.derivative, x.issuer, x.cusip) == (35000, 14, "Call", "X", "123456003") and x.pct == 100.0 and r["b", "1"].value_usd == 900


def test_fundamentals(spark):
    d = spark.createDataFrame([(1, 100.0, 60.0, 0.0, None, 0.1), (2, None, None, 5.0, 2.0, -1.0)], "id int, revenue double, cost_of_goods_sold double, net_income double, total_assets double, earnings_growth_rate double")
    z = {r.id: r for r in fundamentals.ratios(d).collect()}
    assert z[1].gross_margin == 0.4 and z[1].roa == 0.0 and z[2].roa == 2.5 and z[2].peg is None and z[2].gross_margin == 0.0
    assert {r.id: r.roa for r in fundamentals.ratios(d, zero=False).collect()} == {1: None, 2: 2.5}
    b = spark.createDataFrame([(1, 100, 60, 20, None, 5, 16)], "id int, revenue long, costOfRevenue long, operatingExpenses long, incomeBeforeTax long, incomeTaxExpense long, netIncome long")
    s = rows(fundamentals.bridge(b, ["id"]), "step_no")
    assert sum(x[3] for x in s if x[4] == "step") + 100 == 16 and s[-1][3] == 16
    t = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 104.0), ("b", 1, 10.0), ("b", 2, 20.0), ("c", 1, 0.0)], "k string, p int, v double")
    assert {r.k: r.trend for r in fundamentals.trend(t, ["k"], "p", "v").collect()} == {"a": "stable", "b": "improving", "c": "unknown"}


def test_models(spark):
    m = spark.createDataFrame([(50.0, 200.0, 800.0, 25.0, 100.0, 200.0, 30.0, 0.6, 0.4, 0.5, 0.06, 0.03, 2.0, 0.25, 50.0, 300.0, 10, True)], "a_price double, a_shares double, a_income double, t_price double, t_shares double, t_income double, offer double, cash_pct double, stock_pct double, debt_part double, debt_rate double, cash_yield double, fee double, tax double, synergies double, intangibles double, years int, deductible boolean")
    r = models.merger(m).first()
    drag = (0.6 * 3000 * 0.5 * 0.06 + 0.6 * 3000 * 0.5 * 0.03 + 2) * 0.75 + 30 * 0.75
    assert math.isclose(r.proforma_eps, (800 + 200 + 37.5 - drag) / 224) and math.isclose(r.new_shares, 24)
    again = models.merger(m.withColumn("synergies", F.lit(r.breakeven_synergies))).first()
    assert abs(again.accretion) < 1e-12
    w = spark.range(1).select(models.cost_of_capital(*[F.lit(x) for x in (0.04, 1.2, 0.07, 0.05, 0.5, 0.25)])).first()[0]
    assert math.isclose(w, (0.04 + 0.084) / 1.5 + 0.5 / 1.5 * 0.05 * 0.75)
    b = models.breakeven(spark.createDataFrame([(10.0,), (1e9,)], "t double"), 0.0, 100.0, lambda x: F.col("t") - x * 2)
    assert [None if r.breakeven is None else round(r.breakeven, 6) for r in b.collect()] == [5.0, None]


def test_visible_text():
    html = "<html><head><title>no</title></head><body><ix:header>no<div>no</div></ix:header><p>A &amp; B<br>C</p><div style='DISPLAY: none'>no<b>no</b></div><div>D<p>E</div>F<script>no</script></i><td>G</td></body></html>"
    assert text.visible(html) == "A & B\nC\n\nD\nEF\n\nG" or text.visible(html).replace("\n\n", "\n").split("\n")[:3] == ["A & B", "C", "D"]
    assert "no" not in text.visible(html) and text.visible(None) is None and text.visible("") == ""


def test_text(spark):
    d = spark.createDataFrame([(1, "Item 1. Business\nWe sell iron. Iron!\nItem 1A. Risk factors\n" + "x" * 50), (2, None), (3, "")], "id int, t string")
    h = d.where("id = 1").select(text.headers(F.col("t")).alias("h")).first().h
    assert [(x.position, x.label) for x in h] == [(0, "Item 1"), (37, "Item 1A")]
    c = text.chunks(d, text="t", size=40, overlap=10).orderBy("chunk_no").collect()
    n = len(d.first().t)
    assert [(x.start, x.end) for x in c] == [(0, 40), (30, 70), (60, 100), (90, n)][: len(c)] and c[-1].end == n
    assert rows(text.term_counts(d, id="id", text="t").where("term = 'iron'").select("id", "tf")) == [(1, 2)]
    q = spark.createDataFrame([("q", "iron iron"), ("e", "")], "qid string, q string")
    s = text.search(d, q, id="id", text="t", query_id="qid", query="q").collect()
    assert len(s) == 1 and s[0].queries == ["q"] and "iron" in s[0].snippet.lower()
    assert text.html_text(spark.createDataFrame([(1, "<p>a"), (2, None)], "id int, h string"), id="id", html="h").count() == 2


def test_queries_have_sql_of_their_own():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bars_weekly", "sma_bollinger", "ema_atr_rsi", "growth_quarterly", "asof_signup", "holdings_rollup", "rfm", "bm25_top", "chunk_offsets", "p3_found"])
def test_against_duckdb(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    import __spark_entry__ as entry

    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    norm = lambda v: round(v, 3) if isinstance(v, float) else v
    want = sorted((tuple(norm(x[names.index(k)]) for k in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(norm(x[k]) for k in cols) for x in df.collect()), key=repr) == want


def test_closure_of_dependencies(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "x"), (None, "q")], "p string, c string")
    r = spark.createDataFrame([("a",), ("a",), (None,)], "r string")
    assert rows(joins.closure(e, r, parent="p", child="c", root="r").select("node", "depth"), "node") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(joins.closure(e, r, parent="p", child="c", root="r", acyclic=True).select("node", "depth"), "node") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    x = spark.createDataFrame([("x",)], "r string")
    assert joins.closure(e, x, parent="p", child="c", root="r").count() == 1
    with pytest.raises(ValueError, match="cycle"):
        joins.closure(e, x, parent="p", child="c", root="r", most=5, acyclic=True)


def test_asof_over_spans(spark):
    """What a month begins with comes from months before it, also over a gap; right rows of equal time, strict and not."""
    import datetime as dt

    D = dt.datetime  # noqa: N806
    right = spark.createDataFrame([("k", D(2024, 1, 5), 1), ("k", D(2024, 1, 20), 2), ("k", D(2024, 4, 1), 3), ("z", D(2024, 1, 1), 9), (None, D(2024, 1, 1), 8)], "k string, t timestamp, v int")
    left = spark.createDataFrame([(1, "k", D(2024, 1, 1)), (2, "k", D(2024, 1, 6)), (3, "k", D(2024, 3, 15)), (4, "k", D(2024, 4, 1)), (5, "k", None), (6, None, D(2025, 1, 1)), (7, "none", D(2025, 1, 1)), (8, "k", D(2030, 1, 1))], "id int, k string, t timestamp")
    got = lambda strict: rows(joins.asof_backward(left, right, by=["k"], time="t", values=["v"], strict=strict).select("id", "v"), "id")
    assert got(False) == [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, None), (7, None), (8, 3)]
    assert got(True)[3] == (4, 2) and joins.asof_backward(left.limit(0), right, by=["k"], time="t", values=["v"]).count() == 0
    assert [v for _, v in rows(joins.asof_backward(left, right.limit(0), by=["k"], time="t", values=["v"]).select("id", "v"), "id")] == [None] * 8


def test_places_in_groups(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9), (None, 4), (None, 5)], "g string, v int")
    assert sorted(rows(profile.placed(d, ["g"], [-F.col("v")], 3)), key=str) == sorted([("a", 3, 1, 3), ("a", 2, 2, 3), ("a", 1, 3, 3), ("b", 9, 1, 1), (None, 5, 1, 2), (None, 4, 2, 2)], key=str)
    assert profile.placed(d.limit(0), ["g"], [F.col("v")]).count() == 0


def test_part_headings(spark):
    t = "Part I\nItem 1. Business\n  item  1A: Risk\nitemize\nItem 7\nPART II - more\nno item 2.\n"
    d = spark.createDataFrame([(t,), ("",), (None,)], "t string")
    got = [r.h for r in d.select(text.headers(F.col("t")).alias("h")).collect()]
    assert [(x.position, x.label) for x in got[0]] == [(0, "Part I"), (7, "Item 1"), (24, "Item 1A"), (49, "Item 7"), (56, "Part Ii")] and got[1] == [] and got[2] is None
    assert all(t[x.position :].lstrip().lower().startswith(x.label.split()[0].lower()) for x in got[0])


def test_search_with_many_words(spark, monkeypatch):
    """Beyond the limit of words the documents' words are joined instead: the scores are the same."""
    docs = spark.createDataFrame([(1, "net debt rose"), (2, "debt debt margin"), (3, None), (4, "")], "id int, t string")
    q = spark.createDataFrame([("q1", "net debt debt"), ("q2", "margin"), ("q3", "")], "q string, w string")
    run = lambda: sorted((r.q, r.id, round(r.score, 9)) for r in text.bm25(docs, q, id="id", text="t", query_id="q", query="w").collect())
    few = run()
    monkeypatch.setattr(text, "MOST_TERMS", 1)
    assert few == run() and [x[:2] for x in few] == [("q1", 1), ("q1", 2), ("q2", 2)]


def test_white_space_of_pages():
    assert text.visible("<p>a\u00a0 \t b</p>\n\n\n<p> c </p><br><br><br>d") == "a b\nc\n\nd"
    assert text.visible("") == "" and text.visible(None) is None


def test_shared_folder(spark):
    from tidemark import session

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Fake:
        def __init__(self, **k):
            self.conf = Conf(k)

    with pytest.raises(ValueError, match="executors share"):
        session.shared_dir(Fake(**{"spark.master": "spark://host:7077"}))
    assert session.shared_dir(Fake(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x"})) == "hdfs://x"
    d = session.cut(spark.range(3))
    assert d.count() == 3 and "/tidemark/" in session.own_dir(spark)


def test_granularity_is_required(spark):
    d = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-08"), ("b", "2024-01-01")], "k string, t string").withColumn("t", F.to_date("t"))
    assert trends.required_granularity(d, "weekly", keys=["k"], time="t").count() == 3
    with pytest.raises(Exception, match="expected daily buckets, found weekly for a"):
        trends.required_granularity(d, "daily", keys=["k"], time="t").collect()
    assert rows(d.select(trends.prior_quarter_end(F.col("t"), 1).cast("string").alias("x")).distinct()) == [("2023-10-31",)]
