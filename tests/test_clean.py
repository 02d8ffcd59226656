"""Edge cases of the clean-up operators: nulls, empty inputs, ties, repeated rows, clashing names."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.norm import calendar_day, quarter_of, symbol_key
from tidemark.operators import drift, nested, timestamps, units
from tidemark.plans import problems
from tidemark.sources.tables import once


def col(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in d.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_norms(spark):
    assert col(spark, [" ab.k ", "AB-K", "", None, " x\t"], symbol_key) == ["AB-K", "AB-K", None, None, "X"]
    d = dt.date(2024, 2, 29)
    assert col(spark, ["2024-02-29", "2024/02/29", "20240229", " 2024-02-29 ", "2024-02-29T10:00", "2024-02-29 00:00:00", "2023-02-29", "TBD", "", None, "2024-02/29"], calendar_day) == [d] * 6 + [None] * 5
    q = ["Q1", "q2 ", "3Q", "Quarter 4", "Q2 2023", "2023-Q3", "First quarter", "FY", "12M", "FY2022", "Q5", "", None, "H1", "2023"]
    assert col(spark, q, quarter_of) == [1, 2, 3, 4, 2, 3, 1] + [None] * 8


def test_once(spark):
    d = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "b", 1), (None, "b", 1)], "k int, v string, w int")
    assert sorted(map(tuple, once(d, "k").collect()), key=str) == [(1, "a", None), (None, "b", 1)]
    assert once(d.select("k"), "k").count() == 2 and once(d.limit(0), "k", spread=True).count() == 0


def times(spark, values, **k):
    d = spark.createDataFrame([("s", v, "clash") for v in values], "src string, v string, epoch_ms string")
    out = timestamps.normalise_times(d, source="src", value="v", **k)
    assert out.columns == ["src", "v", "epoch_ms", "time_format", "posterior", "time_status"]
    return {r.v: r for r in out.collect()}


def test_mixture_decides_by_the_source(spark):
    """13/02 shows that the source writes days first; what fits both is read so. Without such a sign it stays ambiguous."""
    days_first = [f"{d}/02/2020 10:00:00" for d in range(13, 28)]
    t = times(spark, [*days_first, "03/04/2020 10:00:00"])
    assert t["03/04/2020 10:00:00"].time_format == "dmy_slash" and t["03/04/2020 10:00:00"].epoch_ms == 1585908000000
    t = times(spark, ["03/04/2020 10:00:00", "05/04/2020 10:00:00"])
    assert all(r.time_status == "ambiguous" and r.epoch_ms is None for r in t.values())
    assert times(spark, ["20010205200029"])["20010205200029"].time_format == "compact"


def test_times_edges(spark):
    t = times(spark, [None, "", "pending", "2021-02-30 10:00:00", "2021-02-28 24:00:00", "2021-02-28", "x" * 10000, "2021-02-28 10:00:00.123456789+00:00", "2021-02-28T10:00:00-00:30"])
    assert [t[v].time_status for v in (None, "", "pending", "2021-02-30 10:00:00", "2021-02-28 24:00:00", "2021-02-28", "x" * 10000)] == ["missing"] + ["unreadable"] * 6
    assert t["2021-02-28 10:00:00.123456789+00:00"].epoch_ms == 1614506400123 and t["2021-02-28T10:00:00-00:30"].epoch_ms == 1614508200000
    assert timestamps.normalise_times(spark.createDataFrame([], "src string, v string"), source="src", value="v").count() == 0


def test_mixture_plain():
    share, post = timestamps.mixture([((("a", True), ("b", True)), 10), ((("a", True),), 5), ((("b", False),), 1)])
    assert abs(sum(share.values()) - 1) < 1e-6 and post[0]["a"] > 0.8 and post[2]["b"] == 1


def test_powers_and_currencies(spark):
    cases = {"USD": (None, "USD"), "in k of US$": (3, "USD"), "€ Mio.": (6, "EUR"), "Umsatz in Mrd. €": (9, "EUR"), "GBp": (-2, "GBP"), "Gbp": (None, "GBP"), "GBX": (-2, "GBP"), "R$ mil": (3, "BRL"), "INRCr.": (7, "INR"), "NT$ bn": (9, "TWD"), "Fr.Tsd.": (3, "CHF"), "per thousand visits": (None, None), "K-class": (None, None), "M&A": (None, None), "": (None, None), None: (None, None), "C$'000": (3, "CAD")}
    got = list(zip(col(spark, list(cases), units.stated_power), col(spark, list(cases), units.stated_currency)))
    assert dict(zip(cases, got)) == cases
    assert col(spark, ["Lakh", "units", "%", "M", "millions "], lambda c: units.stated_power(c, alone=True)) == [5, 0, None, 6, 6]


def test_viterbi_follows_the_level():
    """Without any word the jump of the amounts shows where the unit switches, and one estimate fixes both sides."""
    level = np.log10(np.array([1e9, 1.1e9, 1.2e6, 1.25e6, 1.3e9]))
    nan = np.full(5, np.nan)
    est = nan.copy()
    est[0] = 0
    states = np.array(units.STATES, dtype=float)
    assert list(units.viterbi(np.array([True] + [False] * 4), units.Chain(level, nan, est, states))) == [0, 0, 3, 3, 0]
    two = units.viterbi(np.array([True, False, True, False, False]), units.Chain(level, np.array([np.nan, np.nan, 6, np.nan, np.nan]), nan, states))
    assert list(two[2:4]) == [6, 6]
    assert len(units.viterbi(np.zeros(0, bool), units.Chain(np.zeros(0), np.zeros(0), np.zeros(0), states))) == 0
    # The row in the middle takes its unit from its neighbours.
    assert list(units.viterbi(np.array([True, False, False]), units.Chain(np.array([9.0, 6, 9]), np.array([0, np.nan, 0]), nan[:3], states))) == [0, 3, 0]


@pytest.mark.parametrize("most", [200_000, 10, 1])
def test_decoding_in_blocks(spark, most):
    """A long hot series, also with more rows on a day than a block holds, is decoded as a whole; null series and days too."""
    rows = [(i, "hot", dt.date(2000, 1, 1) + dt.timedelta(90 * (i % 100)), 1e9 if i % 3 else 1e6, None if i % 5 else (0 if i % 3 else 3), None) for i in range(300)]
    rows += [(1000, None, None, 5.0, 6, None), (1001, "z", None, None, None, 3.01), (1002, "z", dt.date(2001, 1, 1), 0.0, None, None)]
    d = spark.createDataFrame(rows, "id long, s string, d date, v double, w int, e double")
    got = {r.id: r.power for r in units.decode_powers(d, record="id", series="s", day="d", level="v", stated="w", estimate="e", most=most).collect()}
    assert len(got) == len(rows) and got[1000] == 6 and got[1001] == 3
    assert all(got[i] == (0 if i % 3 else 3) for i in range(300))


def test_block_size_changes_nothing(spark):
    """Few rows state a unit, so nearly all depends on the neighbours: blocks give the path of the whole series."""
    rng = np.random.default_rng(5)
    power, rows = 0, []
    for i in range(400):
        power = int(rng.choice([0, 3, 6])) if rng.random() < 0.1 else power
        rows.append((i, "ab"[i % 2], dt.date(2000, 1, 1) + dt.timedelta(int(i // 7)), float(10 ** (9 - power + rng.normal(0, 0.05))), power if rng.random() < 0.05 else None, power + float(rng.normal(0, 0.1)) if rng.random() < 0.05 else None))
    d = spark.createDataFrame(rows, "id long, s string, d date, v double, w int, e double")
    run = lambda most: {r.id: r.power for r in units.decode_powers(d, record="id", series="s", day="d", level="v", stated="w", estimate="e", most=most).collect()}
    whole = run(10**6)
    assert len(whole) == 400 and run(10) == whole and run(3) == whole
    three = spark.createDataFrame([(1, "s", dt.date(2000, 1, 1), 1e9, 0, None), (2, "s", dt.date(2000, 4, 1), 1e6, None, None), (3, "s", dt.date(2000, 7, 1), 1e9, 0, None)], d.schema)
    for most in (1, 2, 10):
        got = units.decode_powers(three, record="id", series="s", day="d", level="v", stated="w", estimate="e", most=most).collect()
        assert sorted((r.id, r.power) for r in got) == [(1, 0), (2, 3), (3, 0)]
    assert units.decode_powers(d.limit(0), record="id", series="s", day="d", level="v", stated="w", estimate="e").count() == 0


def test_exact_amounts(spark):
    d = spark.createDataFrame([(1500, 0, 1_000_000), (188_319, 6, 1_000_000), (999, -2, 1_270_001), (-1500, 0, 1_000_000), (16_711_675_110_590_123, 0, 843_057), (None, 0, 1)], "m long, p int, r long")
    got = [r.x for r in d.select(units.scaled_down(F.col("m"), F.col("p"), F.col("r")).alias("x")).collect()]
    assert got == [1, 188_319_000, 0, -2, 16_711_675_110_590_123 * 843_057 // 10**9, None]


NESTED = "id long, pk string, a struct<b:struct<n:int>,list:array<struct<x:int,list:array<int>>>>, m map<string,struct<y:int>>, tags array<string>"


def test_nested(spark):
    d = spark.createDataFrame([
        (1, "clash", {"b": {"n": 7}, "list": [{"x": 1, "list": [5, None, 6]}, None, {"x": None, "list": []}]}, {"k": {"y": 2}}, ["t", None]),
        (1, "clash", {"b": {"n": 7}, "list": [{"x": 1, "list": [5, None, 6]}, None, {"x": None, "list": []}]}, {"k": {"y": 2}}, ["t", None]),
        (2, None, None, None, None), (None, None, {"b": None, "list": []}, {}, []),
    ], NESTED)
    e = nested.distinct_rows(nested.shred(d, key="id"))
    tables = {t.tag: t for t in nested.flat_tables(d.schema)}
    assert set(tables) == {"root", "root/a.list", "root/a.list/list", "root/m", "root/tags"}
    rows = lambda tag: sorted((tuple(r) for r in nested.table_of(e, tables[tag]).collect()), key=str)
    assert rows("root/a.list") == [("1/a.list:0", "1", "1", [0], 1), ("1/a.list:2", "1", "1", [2], None)]
    assert rows("root/a.list/list") == [("1/a.list:0/list:0", "1/a.list:0", "1", [0, 0], 5), ("1/a.list:0/list:2", "1/a.list:0", "1", [0, 2], 6)]
    assert rows("root/m") == [("1/m:0", "1", "1", [0], "k", 2)] and rows("root/tags") == [("1/tags:0", "1", "1", [0], "t")]
    assert "field.pk" in nested.table_of(e, tables["root"]).columns and len(rows("root")) == 3
    assert nested.shred(d.limit(0), key="id").count() == 0


def test_nested_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, [{"x": 1}, {"x": 2}])], "id long, xs array<struct<x:int>>")
    nested.write_tables(d, str(tmp_path / "t"), key="id")
    t = nested.flat_tables(d.schema)
    assert [r.x for r in nested.read_table(spark, str(tmp_path / "t"), t[1]).orderBy("pk").collect()] == [1, 2]


def tree(**fields):
    """A tree of fields name=(type, amount of 2020, names or nodes of the fields below)."""
    return drift.Node("", children=[drift.Node(k, v[0], {"2020": v[1]} if v[1] is not None else {}, [c if isinstance(c, drift.Node) else drift.Node(c, "") for c in v[2:]]) for k, v in fields.items()])


def test_edit_script():
    years = frozenset(["2020"])
    old, new = tree(a=("number", 5), b=("number", 6), c=("object", 7, "amount", "unit")), tree(a=("text", 5), b2=("number", 6), c=("object", 7, "amount"), d=("number", 9))
    cost, edits = drift.edit_script(old, new, years)
    assert [(e.change, e.path, e.old_path) for e in edits] == [("retyped", "/a", ""), ("renamed", "/b2", "/b"), ("removed", "/c/unit", ""), ("added", "/d", "")]
    assert abs(cost - (drift.RETYPE + drift.RENAME + 1 + 1)) < 1e-9
    assert drift.edit_script(old, old, years) == (0, [])
    # Two new fields with one vanished amount: one is the rename, by the likeness of the names, the other is added.
    _, e = drift.edit_script(tree(Mac=("number", 1)), tree(MAC=("number", 1), Other=("number", 1)), years)
    assert {(x.change, x.path) for x in e} == {("renamed", "/MAC"), ("added", "/Other")}
    # Moved under another parent.
    a = drift.Node("", children=[drift.Node("p", children=[drift.Node("z", "number")]), drift.Node("q", children=[drift.Node("y", "text")])])
    b = drift.Node("", children=[drift.Node("p", children=[drift.Node("w", "text")]), drift.Node("q", children=[drift.Node("y", "text"), drift.Node("z", "number")])])
    assert ("moved", "/q/z") in {(x.change, x.path) for x in drift.edit_script(a, b)[1]}


def test_moves_between_levels():
    """A null field at the top and a vanished one below look like a move: the report of top-level fields must show it."""
    below = ("object", None, "x")
    _, e = drift.edit_script(tree(y=below, k=("number", 1)), tree(y=("object", None), k=("number", 1), x=("", None)))
    assert [(c.change, c.path, c.old_path, c.depth, c.old_depth) for c in e] == [("moved", "/x", "/y/x", 1, 2)]
    _, e = drift.edit_script(tree(y=("object", None), k=("number", 1), x=("", None)), tree(y=below, k=("number", 1)))
    assert [(c.change, c.path, c.old_path, c.depth, c.old_depth) for c in e] == [("moved", "/y/x", "/x", 2, 1)]


def test_drift_below_the_top(spark):
    """Renames, retypes and moves at depths 2 and 3, and moves between the top and below as rows of the top."""
    rows = [
        ("S", "f1", "2020", 2019, '{"a": {"n": 5, "d": {"z": 7, "t": "x"}, "l": [{"q": 1}]}, "gone": {"x": null}, "up": 3}'),
        ("S", "f2", "2021", 2019, '{"a": {"m": 5.0, "d": {"zz": "7", "t": 4}, "l": [{"q": "1"}]}, "gone": {"up": 3}, "x": null}'),
    ]
    d = spark.createDataFrame(rows, "s string, f string, d string, y int, j string")
    desc = drift.descriptors(d, entity="s", file="f", order="d", year="y", data="j")
    got = {(r.change, r.path, r.old_path, r.depth, r.old_depth) for r in drift.file_changes(desc).collect()}
    assert got == {
        ("renamed", "/a/m", "/a/n", 2, 2), ("renamed", "/a/d/zz", "/a/d/z", 3, 3), ("retyped", "/a/d/zz", "/a/d/z", 3, 3), ("retyped", "/a/d/t", "", 3, 3), ("retyped", "/a/l/[]/q", "", 4, 4),
        ("moved", "/x", "/gone/x", 1, 2), ("moved", "/gone/up", "/up", 2, 1),
    }
    seg = d.select(F.lit(1).alias("seg_id"), F.col("f").alias("file_name"), F.col("d").alias("file_date"), F.col("s").alias("symbol"), F.col("y").alias("fiscalYear"), F.col("j").alias("data"))
    assert {tuple(r) for r in problems.top_changes(drift.file_changes(problems._described(seg))).collect()} == {("f2", "added", "x", ""), ("f2", "removed", "up", "")}


def test_amounts_of_a_year_are_one_digest(spark):
    """Two rows of a year: the sets must be equal; names with slashes and tildes keep their spelling."""
    rows = [("S", "f1", "1", 2019, '{"a": 1, "b/~": 2}'), ("S", "f1", "1", 2019, '{"a": 3, "b/~": 4}'), ("S", "f2", "2", 2019, '{"A": "3", "B": 2}'), ("S", "f2", "2", 2019, '{"A": 1, "B": 5}')]
    d = spark.createDataFrame(rows, "s string, f string, d string, y int, j string")
    desc = drift.descriptors(d, entity="s", file="f", order="d", year="y", data="j")
    changes = drift.file_changes(desc)
    assert {(r.change, r.path, r.old_path) for r in changes.collect()} == {("renamed", "/A", "/a"), ("retyped", "/A", "/a"), ("added", "/B", ""), ("removed", "/b/~", "")}
    assert ("f1", "b/~", "b/~") in {(r.file, r.field, r.canonical) for r in drift.projections(desc, changes).collect()}


def test_assignment_against_all():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(30):
        n, m = sorted(rng.integers(1, 6, 2).tolist())
        c = rng.random((n, m)).tolist()
        best = min(sum(c[i][p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert abs(sum(c[i][j] for i, j in enumerate(drift.assign(c))) - best) < 1e-9


def test_drift_edges(spark):
    rows = [
        ("S", "f1", "2020-01-01", 2019, '{"a": 1, "b": "1,000", "n": null}'), ("S", "f2", "2020-02-01", 2019, '{"A": 1.0, "b": {"amount": 1000, "unit": "X"}, "n": 3}'), ("S", "f3", "2020-03-01", 2019, '{"AA": "1", "a": 7, "b": 5}'),
        ("S", "f4", "2020-03-01", 2019, None), ("T", "g1", "2020-01-01", 2019, "not json"), ("T", "g2", "2020-01-02", 2019, '[1, 2]'), ("T", "g3", "2020-01-03", 2019, '{"x": []}'),
    ]
    d = spark.createDataFrame(rows, "s string, f string, d string, y int, j string").withColumn("field", F.lit("clash"))
    desc = drift.descriptors(d, entity="s", file="f", order="d", year="y", data="j")
    got = {(r.file, r.change, r.path, r.old_path) for r in drift.file_changes(desc).where("depth = 1").collect()}
    assert got == {
        ("f2", "renamed", "/A", "/a"), ("f2", "retyped", "/b", ""), ("f3", "renamed", "/AA", "/A"), ("f3", "retyped", "/AA", "/A"), ("f3", "added", "/a", ""), ("f3", "removed", "/n", ""), ("f3", "retyped", "/b", ""),
        ("f4", "removed", "/AA", ""), ("f4", "removed", "/a", ""), ("f4", "removed", "/b", ""), ("g3", "added", "/x", ""),
    }
    p = {(r.file, r.field): r.canonical for r in drift.projections(desc, drift.file_changes(desc)).collect()}
    assert p["f3", "AA"] == "a" and p["f2", "A"] == "a" and p["f3", "a"] == "a" and p["f1", "b"] == "b"
    assert drift.descriptors(d.limit(0), entity="s", file="f", order="d", year="y", data="j").count() == 0
