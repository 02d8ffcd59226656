"""Everyday table operators, reports and statistical tests: nulls, ties, empty tables, clashing names."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import strings, udf
from tidemark.operators import fundamentals, inference, models, profile, reports, tables, trends, upsert


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_fills(spark):
    d = frame(spark, [(1, "a", 1.0), (2, "a", None), (3, None, 5.0), (4, None, None), (5, "b", None)], "i int, g string, v double")
    assert rows(tables.fill_mean(d, "v", ["g"]).select("i", "v"), "i") == [(1, 1.0), (2, 1.0), (3, 5.0), (4, 5.0), (5, None)]
    assert rows(tables.fill_mean(d, "v").select("i", "v"), "i")[1] == (2, 3.0) and tables.fill_mean(d.limit(0), "v", ["g"]).count() == 0
    assert rows(tables.fill_constants(d, {"g": "x"}).select("g").distinct(), "g") == [("a",), ("b",), ("x",)]
    assert tables.columns_like(d, "[gv]") == ["g", "v"] and tables.columns_like(d, kinds=["int"]) == ["i"] and tables.columns_like(d, exclude=["i", "v"]) == ["g"]


def test_sample_is_the_same_whatever_the_partitions(spark):
    d = spark.range(5000)
    a, b = tables.sample(d, ["id"], 0.2, 3), tables.sample(d.repartition(7), ["id"], 0.2, 3)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) and 800 < a.count() < 1200
    assert tables.sample(d, ["id"], 0.0).count() == 0 and tables.sample(d, ["id"], 1.0).count() == 5000


def test_head_stack_and_side_by_side(spark):
    d = frame(spark, [(3, "x"), (1, None), (2, "y")], "a int, b string")
    assert rows(tables.head(d, 2, [F.col("b").asc_nulls_last(), F.col("a")]), "place") == [(3, "x", 1), (2, "y", 2)]
    assert rows(tables.stack([d, frame(spark, [(9, 1.5)], "a int, c double")]), "a")[-1] == (9, None, 1.5)
    got = rows(tables.side_by_side(d, frame(spark, [("p",)], "z string"), ["a"], ["z"]), "row_no")
    assert got == [(1, 1, None, "p"), (2, 2, "y", None), (3, 3, "x", None)] and tables.side_by_side(d.limit(0), d.limit(0).select(F.col("a").alias("z")), ["a"], ["z"]).count() == 0


def test_validation(spark):
    d = frame(spark, [(1, "ok"), (2, None), (-1, "ok")], "a int, b string").withColumn("c", F.lit(1))
    good, bad = tables.split_valid(d, {"positive": F.col("a") > 0, "named": F.col("b") == "ok"})
    assert rows(good.select("a")) == [(1,)] and sorted(rows(bad.select("a", "reasons")), key=str) == [(-1, ["positive"]), (2, ["named"])]
    assert tables.require(d.where("a = 1"), {"positive": F.col("a") > 0}).count() == 1
    for broken in ("a = -1", "b is null"):
        with pytest.raises(Exception, match="doesn't hold"):
            tables.require(d.where(broken), {"rule": (F.col("a") > 0) & (F.col("b") == "ok")}).collect()
    n = frame(spark, [("1,200", 1), ("x", 2), ("-3", 3), (None, 4), ("0", 5)], "t string, i int")
    assert rows(tables.numbers(n, ["t"], ["t"])) == [(1200.0, 1)] and tables.numbers(n, ["t"]).count() == 3
    assert rows(n.select(tables.in_window(F.lit(None).cast("date"), "2020-01-01", "2020-01-02").alias("x")).distinct()) == [(False,)]


def test_settings_and_shapes(spark):
    s = frame(spark, [("a", "1"), ("b", "2")], "key string, value string")
    c = frame(spark, [("a", "9", 1), ("a", "8", 2), ("b", None, 1), ("c", "3", 1)], "key string, value string, order int")
    assert rows(tables.key_values(s, c), "key") == [("a", "8"), ("c", "3")]
    assert rows(tables.settled(s, {"a": "x", "d": "y"}, {"a": ["2"]}), "key") == [("a", "x"), ("b", "2"), ("d", "y")]
    assert rows(tables.shaped(s, ["key", "missing", "value"], {"value": "0"}), "key") == [("a", None, "1"), ("b", None, "2")]


def test_credit_and_layers(spark):
    c = frame(spark, [(1, "SEC filing"), (1, "guess"), (2, "sec x"), (2, None)], "t int, s string")
    u, r = frame(spark, [(1, "edgar"), (2, "other")], "t int, tool string"), frame(spark, [("^sec", "edgar")], "pattern string, tool string")
    got = {x[:2]: x[2] for x in rows(tables.credited(c, u.withColumnRenamed("tool", "s"), r, task="t", source="s", tool="s"))}
    assert got == {(1, "SEC filing"): True, (1, "guess"): False, (2, "sec x"): False, (2, None): False}
    assert tables.credited(c.limit(0), u.withColumnRenamed("tool", "s"), r, task="t", source="s", tool="s").count() == 0


def plain_quantile(v, q):
    v = sorted(v)
    k = q * (len(v) - 1)
    lo = int(k)
    return v[lo] if k == lo else v[lo] + (v[lo + 1] - v[lo]) * (k - lo)


@pytest.mark.parametrize("buckets", [2, 64])
def test_quantiles_against_sorting(spark, buckets):
    """Ties that fill several ranges, groups of one value, null groups, nulls, and shares at both ends."""
    rnd = random.Random(buckets)
    data = [(rnd.choice(["a", "a", "b", None]), float(rnd.choice([1, 1, 1, 1, 2, rnd.randint(0, 50)])), None if rnd.random() < 0.2 else rnd.gauss(0, 1)) for _ in range(400)] + [("one", 7.0, None)]
    d = frame(spark, data, "g string, v double, w double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.name, r.share): r.value for r in profile.quantiles(d, ["v", "w"], shares, ["g"], buckets).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        for n, i in (("v", 1), ("w", 2)):
            vs = [x[i] for x in data if x[0] == g and x[i] is not None]
            want |= {(g, n, s): plain_quantile(vs, s) for s in shares if vs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert profile.quantiles(d.limit(0), ["v"], [0.5]).count() == 0 and profile.describe(d.limit(0), ["v"]).first().n == 0


def test_numbers_and_tiles_with_one_value(spark):
    """All values alike: the tie column orders them, over several ranges."""
    d = spark.range(101).select("id", F.lit(5).alias("v"), F.lit("x").alias("r"))
    n = profile.numbered(d, ["v", "id"], "no", 4)
    assert all(r.no == r.id + 1 for r in n.collect())
    t = profile.with_tiles(d, {"t": F.col("v")}, F.col("id"), 5, 4)
    assert [r.t for r in t.orderBy("id").collect()] == [1] * 21 + [2] * 20 + [3] * 20 + [4] * 20 + [5] * 20 and profile.with_tiles(d.limit(0), {"t": F.col("v")}, F.col("id"), 5).count() == 0


def test_kendall_against_pairs(spark):
    rnd = random.Random(2)
    data = [("g", rnd.randint(0, 5), rnd.randint(0, 4)) for _ in range(60)] + [("flat", 1, k) for k in range(3)] + [("g", None, 1)]
    got = dict(rows(inference.kendall(frame(spark, data, "g string, a int, b int"), "a", "b", ["g"])))
    p = [(a, b) for g, a, b in data if g == "g" and a is not None]
    sign = lambda x: (x > 0) - (x < 0)
    s = sum(sign(x[0] - y[0]) * sign(x[1] - y[1]) for x, y in itertools.combinations(p, 2))
    nx, ny = (sum(x[i] != y[i] for x, y in itertools.combinations(p, 2)) for i in (0, 1))
    assert abs(got["g"] - s / (nx * ny) ** 0.5) < 1e-9 and got["flat"] is None
    with pytest.raises(Exception, match="more than 3 values"):
        inference.kendall(frame(spark, data, "g string, a int, b int"), "a", "b", ["g"], grid=3).collect()


def test_statistics_edges(spark):
    d = frame(spark, [("A", 1.0), ("A", 2.0), ("B", 5.0), ("B", None), ("C", 1.0)], "g string, v double")
    assert rows(inference.welch(d, group="g", a="A", b="B", value="v")) == [(1.5, 5.0, None, None)]
    assert rows(inference.anova(d.where("g = 'A'"), group="g", value="v")) == [(1, 2, None)]
    assert rows(inference.chi_square(frame(spark, [("x", "p"), ("y", "q"), (None, "q")], "a string, b string"), "a", "b")) == [(2, 1, 2.0)]
    assert rows(inference.point_biserial(d.withColumn("f", F.col("g") == "A"), "f", "v"))[0][0] < 0


def test_models_of_the_library(spark):
    pts = [(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(20)] + [(99, None)]
    d = frame(spark, pts, "id int, v array<double>")
    c = dict(rows(inference.clusters(d, id="id", vector="v", k=2)))
    assert len(c) == 20 and len({c[i] for i in range(0, 20, 2)}) == 1 and c[0] != c[1]
    p = dict(rows(inference.components(d, id="id", vector="v", k=1)))
    assert len(p) == 20 and abs(abs(p[1][0] - p[0][0]) - 10.01) < 1e-6
    r = inference.item_rules(frame(spark, [(["a", "b"],), (["a", "b", "b"],), (["a"],), (None,)], "i array<string>"), items="i", support=0.5, confidence=0.9).collect()
    assert [(x.antecedent, x.consequent) for x in r] == [(["b"], ["a"])]


def test_own_functions(spark):
    d = frame(spark, [("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, v double")
    plus = udf.mapped(lambda x: x + 1, "double")
    assert sorted(rows(d.select(plus("v").alias("x"))), key=str) == [(2.0,), (4.0,), (6.0,), (None,)]
    assert rows(d.where("g = 'a'").select(udf.vectorised(lambda s: s * 2, "double")("v").alias("x")), "x") == [(2.0,), (6.0,)]
    mean = udf.folded(d.repartition(3), ["g"], "v", part=lambda s: (float(s.sum()), int(s.count())), merge=lambda p: sum(a for a, _ in p) / n if (n := sum(b for _, b in p)) else None, state="total: double, n: bigint", name="mean")
    assert sorted(rows(mean), key=str) == [("a", 2.0), ("b", None), (None, 5.0)]
    spark.udtf.register("tidemark_upto", udf.table_function(lambda n: ((i,) for i in range(n)), "i int"))
    assert rows(spark.sql("SELECT i FROM tidemark_upto(3)"), "i") == [(0,), (1,), (2,)]


def test_reports(spark):
    D = dt.date  # noqa: N806
    e = frame(spark, [("a", D(2024, 3, 31), 2e9, 1e9), ("a", D(2024, 6, 30), None, 1e9), ("a", D(2024, 9, 30), -5e9, None)], "s string, d date, act double, est double")
    assert rows(reports.estimates(e, entity="s", day="d", actual="act", estimated="est"), "d") == [("a", D(2024, 3, 31), "Q1'24", 1.0, 2.0, 1e9), ("a", D(2024, 9, 30), "Q3'24", None, -5.0, 1e9)]
    sp = rows(reports.fiscal_spans(e, entity="s", end="d").select("d", "span_start", "span_days"), "d")
    assert sp[0] == (D(2024, 3, 31), D(2024, 1, 1), 90) and sp[1] == (D(2024, 6, 30), D(2024, 4, 1), 90)
    assert rows(reports.upper_median(frame(spark, [("a", 1), ("a", 2), ("a", 2), ("a", 9), ("b", None)], "g string, v int"), ["g"], "v")) == [("a", 2)]
    with pytest.raises(ValueError):
        reports.price_with_revenue(e, e, entity="s", day="d", end="d", revenue="act", mode="x")
    assert reports.price_with_revenue(e.limit(0), e, entity="s", day="d", end="d", revenue="act").count() == 0
    k = frame(spark, [(1, "category"), (1, "datetime"), (2, "category"), (3, None)], "c int, k string")
    assert rows(reports.axis_of(k, ["c"], "k"), "c") == [(1, "datetime"), (2, "category"), (3, "datetime")]
    state, bad = reports.isolated(frame(spark, [("a", 1), ("b", 2)], "k string, v int"), frame(spark, [("a", 9), ("c", 3)], "k string, v int"), frame(spark, [("a", "timeout"), ("a", "again"), (None, "x"), ("z", "gone")], "k string, e string"), by="k", error="e")
    assert rows(state, "k") == [("a", 1), ("c", 3)] and rows(bad, "k") == [("a", "again", 1), ("z", "gone", 0)]
    fl = reports.flagged_prices(frame(spark, [("a", D(1970, 1, 2), 1.0)], "s string, d date, p double"), frame(spark, [("a", D(1970, 1, 2), "y"), ("a", D(1970, 1, 2), "x"), ("a", D(1980, 1, 1), "z")], "s string, d date, t string"), entity="s", day="d", title="t")
    assert rows(fl.select("at", "flags")) == [(86_400_000, "x; y")]
    assert '"total": 3' in reports.report_document("r", {"e": e.select("s")}, 2)
    kept, notes = reports.with_enough_bars(frame(spark, [("a",)] * 3 + [("b",)] * 5, "symbol string"), least=4, wanted=9)
    assert kept.count() == 5 and rows(notes, "symbol") == [("a", 3, "too few"), ("b", 5, "short history")]


def test_models_edges(spark):
    case = frame(spark, [(1, 100.0, [0.1, 0.2], 0.2, 0.05, 0.1, 0.25, 3, 0.08, 0.03, 10.0, 5.0), (2, 100.0, None, 0.2, 0.05, 0.1, 0.25, 3, 0.08, 0.03, 10.0, 0.0)], "id int, base_revenue double, growth array<double>, margin double, capex_pct double, nwc_pct double, tax double, years int, wacc double, terminal_growth double, net_debt double, shares double")
    r = {x.id: x for x in models.enterprise_value(case, ["id"], method="multiple").collect()}
    # Growth of the third year is that of the last one given.
    last = 100 * 1.1 * 1.2 * 1.2
    assert abs(r[1].terminal - last * 0.2 * 10 / 1.08**3) < 1e-6 and r[2].ev is None and r[2].per_share is None
    with pytest.raises(ValueError):
        models.enterprise_value(case, ["id"], method="guess")
    t = models.scenario_table(frame(spark, [("a", "x", 10.0, None), ("a", "y", 20.0, None), ("b", "x", 1.0, 0.5), ("b", "y", 2.0, None)], "k string, s string, v double, p double"), ["k"], "s", "v", "p")
    assert rows(t.where("s = 'expected value'").select("k", "v"), "k") == [("a", 15.0), ("b", 0.5)]
    h = models.historical_margins(frame(spark, [("a", 1, 0.0, 1.0), ("a", 2, 10.0, 2.0)], "k string, y int, r double, e double"), ["k"], year="y", revenue="r", ebitda="e", capex="e")
    assert rows(h) == [("a", 10.0, 0.2, 0.2, 2, 1)]
    assert [x[0] for x in rows(frame(spark, [(None,), (0.16,), (-1.0,)], "v double").select(fundamentals.interpretation("roe", F.col("v")).alias("x")))] == [None, "Good returns", "Negative returns"]
    assert rows(frame(spark, [(None,)], "v double").select(fundamentals.summary_text(*[F.col("v")] * 4).alias("x"))) == [("Insufficient data for summary.",)]
    m = trends.rebinned(frame(spark, [("a", dt.date(2024, 11, 1), 1), ("a", dt.date(2025, 1, 15), 2)], "k string, m date, v int"), 1, keys=["k"], month="m", value="v")
    assert rows(m.select("fiscal_quarter", "value", "n_months")) == [("FY2025Q4", 3, 2)]


def test_registry(spark):
    s = frame(spark, [("TaiwanStockPrice", "1", "d1", "x", 1), ("Other", "1", "d1", "x", 1)], "dataset string, entity string, date string, type string, n int")
    n = frame(spark, [("TaiwanStockPrice", "1", "d1", "y", 2), ("TaiwanStockBalanceSheet", "1", "d1", "a", 2), ("TaiwanStockBalanceSheet", "1", "d1", "b", 2), ("Other", "1", "d1", "x", 1)], s.schema)
    got = rows(upsert.merge_datasets(s, n).select("dataset", "type", "n"), "dataset", "type")
    assert got == [("Other", "x", 1), ("TaiwanStockBalanceSheet", "a", 2), ("TaiwanStockBalanceSheet", "b", 2), ("TaiwanStockPrice", "y", 2)]


def test_texts(spark):
    d = frame(spark, [("a, b + \"c d\" - e, -x",), ("",), (None,), ("-\"q r\"",)], "t string")
    got = [[(x.series, x.term, x.excluded) for x in r.k] for r in d.select(strings.keyword_terms(F.col("t")).alias("k")).collect()]
    assert got[1] == got[2] == [] and got[3] == [(0, "q r", True)] and got[0][0] == (0, "a", False) and got[0][-1] == (2, "x", True)
    v = frame(spark, [(None,), (-1.25,), (0.0,), (float("nan"),), (1234.5,)], "v double").select(strings.axis_text(F.col("v"), currency="$", unit="B").alias("a"), strings.axis_text(F.col("v"), percent=True, decimals=0).alias("b")).collect()
    assert [r.a for r in v] == ["—", "($1.3B)", "$0", "—", "$1234.5B"] and v[0].b == "—" and v[4].b in ("1234%", "1235%")
    assert rows(frame(spark, [(dt.date(2024, 12, 30),)], "d date").select(strings.iso_week(F.col("d")).alias("w"))) == [("2025-W01",)]
