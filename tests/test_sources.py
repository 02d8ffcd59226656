"""Readers, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filings
from tidemark.sources import feeds, readers, rest, sinks
from tidemark.streaming import streams


def test_bars_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"symbol": "A", "date": "2024-01-02", "close": 2.0, "other": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "B", "historical": [{"date": "2024-01-03", "close": 3.0}, {"date": "2024-01-04", "close": None}]}))
    r = {(x.symbol, x.date, x.close) for x in readers.bars_json(spark, str(tmp_path)).collect()}
    assert r == {("A", "2024-01-02", 2.0), ("B", "2024-01-03", 3.0), ("B", "2024-01-04", None)}


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    assert [tuple(r) for r in readers.csv_text(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()] == [("1", 'x, "y"'), ("2", None)]
    assert readers.csv_text(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    (tmp_path / "k.tsv").write_text("k\tv\n#c\tno\na\t1\n")
    assert [tuple(r) for r in readers.csv_text(spark, str(tmp_path / "k.tsv"), ["k", "v"], "\t", "#").collect()] == [("a", "1")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, 2]
    assert readers.csv_fresh(spark, str(tmp_path / "x.csv"), ["a", "b"], 1).count() == 2 and readers.csv_fresh(spark, str(tmp_path / "x.csv"), ["a", "b"], -1).count() == 0
    assert readers.load(spark, str(tmp_path / "l.jsonl"), "a int").where("a is not null").count() == 2
    with pytest.raises(ValueError):
        readers.load(spark, "x.odt")
    (tmp_path / "m.md").write_text('---\nname: "one"\ntags: x\n---\nbody\n')
    r = readers.front_matter(spark, str(tmp_path / "m.md"), ["name", "missing"]).first()
    assert (r.name, r.missing, r.body.strip()) == ("one", None, "body")
    (tmp_path / "e.json").write_text(json.dumps({"ticker": "A", "events": [{"type": "earn", "date": "2024-01-01"}]}))
    assert readers.event_documents(spark, str(tmp_path / "e.json")).select("ticker", "type", "ref").first() == ("A", "earn", None)


def test_parallel_arrays(spark):
    d = spark.createDataFrame([(1, {"form": ["10-K", "8-K"], "items": ["", "2.02"], "period": None})], "cik int, r struct<form:array<string>,items:array<string>,period:array<string>>")
    z = readers.zipped(d, F.col("r"), ["form", "items", "period"], ["cik"])
    assert [tuple(r) for r in z.orderBy("row_no").collect()] == [(1, 0, "10-K", "", ""), (1, 1, "8-K", "2.02", "")]


def test_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<informationTable><infoTable><nameOfIssuer>X</nameOfIssuer><cusip>123</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>7</sshPrnamt><sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt></infoTable><infoTable><nameOfIssuer>Y</nameOfIssuer><putCall>Put</putCall></infoTable></informationTable>")
    r = readers.holdings_xml(spark, str(tmp_path / "t.xml")).orderBy("issuer").collect()
    assert (r[0].issuer, r[0].value, r[0].shares, r[0].putcall) == ("X", 5, 7, None) and r[1].putcall == "Put"
    x = '<xbrl><context id="c1"><entity/><period><endDate>2024-12-31</endDate></period></context><context id="c2"><entity><segment><xbrldi:explicitMember dimension="d">m:A</xbrldi:explicitMember></segment></entity></context><dei:EntityName contextRef="c1">Acme</dei:EntityName><dei:Symbol contextRef="c2">ACM</dei:Symbol><dei:Gone contextRef="c1" xsi:nil="true"/></xbrl>'
    f = readers.instance_facts(spark.createDataFrame([(1, x), (2, None)], "id int, xml string"), id="id", xml="xml").orderBy("tag").collect()
    assert [tuple(r) for r in f] == [(1, "EntityName", "Acme", "c1", None, "2024-12-31"), (1, "Symbol", "ACM", "c2", "m:A", None)]
    c = spark.createDataFrame([(1, json.dumps({"taxonomy": "t", "tag": "R", "units": {"USD": [{"end": "2024-12-31", "val": 5, "fy": 2024}], "X": []}}))], "id int, j string")
    assert readers.concept_facts(c, id="id", json="j").select("tag", "unit", "val").collect() == [("R", "USD", 5.0)]


def test_rest_source(spark, tmp_path):
    (tmp_path / "id=7.json").write_text(json.dumps({"data": [{"v": 1}, {"v": 2}]}))
    rest.register(spark)
    d = spark.read.format("rest_json").option("recorded", str(tmp_path)).option("requests", json.dumps([{"id": "7"}, {"id": "8"}])).load()
    assert sorted(r.v for r in d.select(F.from_json("record", "v int").alias("x")).select("x.v").collect()) == [1, 2]


def test_cache_rules(spark):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2023-01-01 2023-02-01", False), (2, "2024-01-01 00:00:00", "today 3-m", False), (3, "2024-01-09 23:00:00", "today 3-m", True), (4, "2024-01-01 00:00:00", "2023-01-01 2023-02-01", True), (5, None, None, None)], "i int, f string, w string, p boolean").withColumn("f", F.to_timestamp("f"))
    ok = d.where(readers.cached_fresh(d, fetched="f", window="w", partial=F.col("p"), now=F.to_timestamp(F.lit("2024-01-10 01:00:00")))).select("i")
    assert sorted(r.i for r in ok.collect()) == [1, 3]
    a, b = (spark.range(1).select(readers.request_key(p)).first()[0] for p in ({"q": F.lit("x"), "a": F.lit("1")}, {"a": F.lit("1"), "q": F.lit("x")}))
    assert a == b and len(a) == 20


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, v int")
    sinks.replace_partitions(d, str(tmp_path / "p"), ["day"])
    sinks.replace_partitions(spark.createDataFrame([("2024-01-02", 9)], "day string, v int"), str(tmp_path / "p"), ["day"])
    p = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(r.v for r in p.collect()) == [1, 9] and [r.v for r in readers.latest_partition(p, "day").collect()] == [9]
    sinks.to_csv(d, str(tmp_path / "c"), ["v", "day"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "day"]
    sinks.append_lines(d, str(tmp_path / "j"))
    sinks.append_lines(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.ranked_text(spark.createDataFrame([(1, "a")], "r int, t string"), str(tmp_path / "r"), "r", "t")
    assert json.loads(sinks.to_json_document(d, {"k": 1}))["columns"] == ["day", "v"]


def test_rest_lanes_and_errors(monkeypatch):
    import urllib.error

    r = rest.RestReader({"url": "http://x", "requests": json.dumps([{"id": str(i)} for i in range(5)]), "lanes": "2", "pause": "0", "throttle": "0"})
    assert [len(p.requests) for p in r.partitions()] == [3, 2]
    codes = iter([429, 503, TimeoutError(), 402])

    def fail(*a, **k):
        c = next(codes)
        raise c if isinstance(c, Exception) else urllib.error.HTTPError("http://x", c, "no", {}, None)

    monkeypatch.setattr("urllib.request.urlopen", fail)
    with pytest.raises(rest.QuotaError):
        r.fetch({"id": "1"})
    codes = iter([404])
    with pytest.raises(urllib.error.HTTPError):
        r.fetch({"id": "1"})
    codes = iter([500] * 4)
    with pytest.raises(RuntimeError, match="no response"):
        r.fetch({"id": "1"})


def one(spark, doc):
    return spark.createDataFrame([(doc if isinstance(doc, str) else json.dumps(doc),), ("broken{",), (None,)], "j string")


def test_feeds(spark):
    cal = feeds.coming_earnings(one(spark, [{"symbol": "a", "date": "2026-07-01"}, {"symbol": "a", "date": "2026-07-01"}, {"symbol": "b", "date": "2026-05-01"}, {"symbol": "c"}]), json="j", today=F.lit("2026-06-01").cast("date"))
    assert [tuple(r) for r in cal.collect()] == [("A", "earnings", "2026-07-01", "estimated", "calendar")]
    roster = spark.createDataFrame([(" a",), ("A",)], "t string")
    n = feeds.news(one(spark, [{"symbol": "a", "publishedDate": "2026-06-02 10:00", "text": "x" * 600}, {"symbol": "a", "publishedDate": "2026-01-01"}, {"symbol": "a"}, {"symbol": "z"}]), roster, json="j", ticker="t", since="2026-06-01").collect()
    assert sorted((r.date or "", len(r.text)) for r in n) == [("", 0), ("2026-06-02", 500)]
    f = feeds.frames(one(spark, {"taxonomy": "t", "tag": "R", "ccp": "CY2024", "uom": "USD", "data": [{"cik": 5, "entityName": "E", "accn": "1", "end": "2024-12-31", "val": 7}]}), json="j").collect()
    assert [(r.cik, r.value, r.period) for r in f] == [("0000000005", 7.0, "CY2024")]
    c = feeds.company_facts(one(spark, {"cik": 5, "facts": {"dei": {"Rev": {"units": {"USD": [{"end": "2024", "val": 1}], "EUR": [{"val": 2}]}}}}}), json="j")
    assert [(r.tag, r.n_facts, r.units) for r in filings.concepts(c, keys=["taxonomy", "tag"], unit="unit", like="re").collect()] == [("Rev", 2, ["EUR", "USD"])]
    t = feeds.tickers(one(spark, {"0": {"cik_str": 12, "ticker": "brk.b", "title": "B"}}), json="j").collect()
    assert [tuple(r) for r in t] == [("BRK-B", "0000000012", "B")]
    p = feeds.pages(spark.createDataFrame([("a", 250), ("b", 0), ("c", 20_000)], "q string, n long"), query="q", total="n").collect()
    assert [r.start for r in p if r.q == "a"] == [0, 100, 200] and sum(r.q == "c" for r in p) == 100 and not any(r.reachable for r in p if r.q == "c")
    h = feeds.hits(one(spark, {"hits": {"hits": [{"_id": "x", "_source": {"ciks": ["1"], "form": "8-K"}}, {"_id": "x", "_source": {"ciks": ["1"], "form": "8-K"}}]}}), json="j").collect()
    assert [(r.id, r.cik, r.form) for r in h] == [("x", "1", "8-K")]
    assert feeds.endpoint(one(spark, [{"symbol": "A", "close": 1.5}]), "prices", json="j").first().close == 1.5


def test_filer_search(spark):
    one_ = "<feed><company-info><cik>123</cik><conformed-name>Acme Corp</conformed-name></company-info></feed>"
    many = "<feed><entry><content><company-info><cik>7</cik></company-info></content><title>Seven</title></entry><entry><cik>8</cik></entry><entry><cik>7</cik><title>again</title></entry></feed>"
    get = lambda x: sorted(tuple(r) for r in feeds.filers(spark.createDataFrame([(x,)], "x string"), xml="x").collect())
    assert get(one_) == [("0000000123", "Acme Corp")] and get(many) == [("0000000007", "Seven"), ("0000000008", "(name unavailable)")] and get("") == []


def test_submissions_and_manifest(spark):
    doc = {"name": "Acme", "filings": {"recent": {"form": ["10-K", "8-K"], "filingDate": ["2025-01-02", "2025-03-04"], "accessionNumber": ["0-1", "0-2"], "items": ["", "2.02, 9.01"]}}}
    more = {"form": ["10-K"], "filingDate": ["2020-01-01"], "accessionNumber": ["0-0"]}
    docs = spark.createDataFrame([(5, json.dumps(doc)), (6, "broken")], "cik int, json string")
    rows = filings.submission_rows(docs, cik="cik", json="json", overflow=spark.createDataFrame([(5, json.dumps(more))], "cik int, json string"))
    assert sorted((r.accession, r.form, r.primary_doc) for r in rows.collect()) == [("0-0", "10-K", ""), ("0-1", "10-K", ""), ("0-2", "8-K", "")]
    how = {"entity": "cik", "filed": "filed", "accession": "accession"}
    assert [r.accession for r in filings.select_filings(rows, **how, form="10-K").orderBy("place").collect()] == ["0-1", "0-0"]
    assert [r.accession for r in filings.select_filings(rows, **how, item="9.01", limit=1).collect()] == ["0-2"] and filings.latest_filing(rows, **how).first().accession == "0-2"
    assert filings.by_accession(rows, "02").count() == 1 and filings.select_filings(rows.limit(0), **how).count() == 0
    ix = spark.createDataFrame([("0000000005", "0-2", json.dumps({"directory": {"item": [{"name": n} for n in ("a-index.html", "R2.htm", "main.htm", "ex99_1.htm", "letter.htm", "x.xml")]}}))], "cik string, accession string, j string")
    m = filings.manifest(ix, cik="cik", accession="accession", json="j")
    assert m.count() == 6 and m.where("name = 'main.htm'").first().url == filings.ARCHIVE + "/5/02/main.htm"
    e = filings.exhibits(m, primary=F.lit("main.htm")).orderBy("place").collect()
    assert [(r.name, r.label) for r in e] == [("ex99_1.htm", "EX-99.1"), ("letter.htm", "")]
    assert feeds.latest_filings_news(rows, spark.createDataFrame([(5,)], "cik int"), cik="cik").count() == 1


def test_resolution_can_be_required(spark):
    f = spark.createDataFrame([(1, "Acme Corp", "AC.B"), (2, "Acme Inc", None), (3, None, "")], "id int, n string, t string")
    q = spark.createDataFrame([("ac-b",), ("acme i",), ("Acme",), ("9",), (None,), (" ",), ("nobody",)], "q string")
    r = {x.identifier: x for x in filings.resolve(q, f, identifier="q", id="id", name="n", ticker="t").collect()}
    assert r["ac-b"].id == "0000000001" and r["acme i"].name == "Acme Inc" and r["9"].id == "0000000009" and r["9"].name is None
    assert r["Acme"].status == "ambiguous" and r["Acme"].candidates == ["0000000001 Acme Corp", "0000000002 Acme Inc"] and {r[x].status for x in (None, " ", "nobody")} == {"unknown"}
    assert filings.required(filings.resolve(q.where("q = '9'"), f, identifier="q", id="id", name="n")).first().id == "0000000009"
    with pytest.raises(Exception, match="cannot resolve nobody"):
        filings.required(filings.resolve(q.where("q = 'nobody'"), f, identifier="q", id="id", name="n")).collect()
    assert filings.resolve(q.limit(0), f, identifier="q", id="id", name="n").count() == 0


def test_more_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 2.0, 12.345), ("a", 3.0, 50.0), ("c|d", None, None)], "n string, v double, p double")
    sinks.ranked_csv(d, str(tmp_path / "r"), [F.col("v").desc_nulls_last()], ["n", "p"], ["p"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("1", "a", "50.00"), ("2", "b", "12.35"), ("3", "c|d", None)]
    assert sinks.csv_text(d.orderBy("n"), ["n", "v"]) == "n,v\na,3.0\nb,2.0\nc|d,\n"
    c = json.loads(sinks.chart_document(d.withColumn("s", F.lit("x")), title="t", category="n", series="s", value="v"))
    assert c["axis"]["categories"] == ["a", "b", "c|d"] and c["series"][0]["data"] == [3.0, 2.0, None]
    assert sinks.markdown_table(d.orderBy("n"), ["n"], 2).splitlines() == ["| n |", "|---|", "| a |", "| b |", "... 1 more"]
    sinks.empty_table(spark, str(tmp_path / "e"), ["a", "b"])
    with pytest.raises(FileExistsError):
        sinks.empty_table(spark, str(tmp_path / "e"), ["a"])
    sinks.to_arrow(d.repartition(2), str(tmp_path / "arrow"))
    back = readers.arrow_files(spark, [str(p) for p in (tmp_path / "arrow").glob("*.arrow")], "n string, v double, p double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
    (tmp_path / "ev").mkdir()
    for t in ("b", "A"):
        (tmp_path / "ev" / f"{t}.json").write_text("{}")
    assert [r.ticker for r in readers.entities(spark, str(tmp_path / "ev")).collect()] == ["A", "B"]
    assert readers.dated_changes(spark, str(tmp_path), "2026-01-01", "a string").count() == 0


def test_cache_plan(spark):
    w = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "k string")
    c = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("a", 3, True)], "k string, t int, ok boolean")
    assert sorted(r.k for r in feeds.missing_requests(w, c, key="k", fetched="t", fresh=F.col("ok")).collect()) == ["b", "c"]
    assert sorted((r.k, r.t) for r in feeds.newest_responses(c, key="k", fetched="t").collect()) == [("a", 3), ("b", 2)]


def run(spark, q, name):
    s = q.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    s.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    rows = [[("A", f"2024-01-0{d} 10:00:00", float(d))] for d in (1, 1, 2, 5, 9)]
    s = stream(spark, tmp_path, rows, "symbol string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    bars = run(spark, streams.window_bars(s, symbol="symbol", time="ts", price="v", lateness="1 day"), "bars").collect()
    # The window of the last event hasn't closed.
    assert {(str(r.start)[:10], r.n_events) for r in bars} == {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-05", 1)}
    e = run(spark, streams.running_ema(s, key="symbol", time="ts", value="v", n=3), "ema").orderBy("ts").collect()
    assert [r.ema for r in e] == [1.0, 1.0, 1.5, 3.25, 6.125]
    assert run(spark, streams.first_arrivals(s, keys=["symbol", "ts"], time="ts"), "firsts").count() == 4


def test_merging_stream(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", 1, 1)], [("a", 3, 2), ("b", 1, 1)], [("a", 2, 9)]], "k string, o int, v int")
    streams.merge_into(s, str(tmp_path / "t"), keys=["k"], order="o", checkpoint=str(tmp_path / "c")).awaitTermination(120)
    now = spark.read.parquet(streams.current(spark, str(tmp_path / "t")))
    assert sorted((r.k, r.v) for r in now.collect()) == [("a", 2), ("b", 1)]
    assert streams.current(spark, str(tmp_path / "nothing")) is None
    # A fresh checkpoint begins at batch 0 again: its batches are merged all the same.
    spark.createDataFrame([("c", 1, 7)], "k string, o int, v int").write.parquet(str(tmp_path / "in2"))
    more = spark.readStream.schema("k string, o int, v int").parquet(str(tmp_path / "in2"))
    streams.merge_into(more, str(tmp_path / "t"), keys=["k"], order="o", checkpoint=str(tmp_path / "c2")).awaitTermination(120)
    rows = lambda: sorted((r.k, r.v) for r in spark.read.parquet(streams.current(spark, str(tmp_path / "t"))).collect())
    assert rows() == [("a", 2), ("b", 1), ("c", 7)]
    # A batch that comes again after its state was written changes nothing.
    last = streams.state(spark, str(tmp_path / "t"))
    streams.merge_into(more, str(tmp_path / "t"), keys=["k"], order="o", checkpoint=str(tmp_path / "c2")).awaitTermination(120)
    assert streams.state(spark, str(tmp_path / "t")) == last and rows() == [("a", 2), ("b", 1), ("c", 7)]


def test_state_that_cannot_be_read(spark, tmp_path, monkeypatch):
    """Any other failure than a missing table is raised, so no batch overwrites what it couldn't read."""
    (tmp_path / "t" / "log").mkdir(parents=True)
    (tmp_path / "t" / "log" / "x.json").write_text("{}")
    monkeypatch.setattr(streams, "LOG", "no such type")
    with pytest.raises(Exception):
        streams.state(spark, str(tmp_path / "t"))


def test_running_wilder(spark, tmp_path):
    rows = [[("A", f"2024-01-0{d} 10:00:00", v)] for d, v in ((1, 1.0), (2, 3.0), (3, 8.0), (4, None), (5, 4.0))]
    s = stream(spark, tmp_path, rows, "symbol string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = run(spark, streams.running_wilder(s, key="symbol", time="ts", value="v", n=2), "wilder").orderBy("ts").collect()
    assert [r.average for r in got] == [None, 2.0, 5.0, 4.5]


def test_sliding_bars(spark, tmp_path):
    rows = [[("A", f"2024-01-0{d} 10:00:00", float(d))] for d in (1, 2, 9)]
    s = stream(spark, tmp_path, rows, "symbol string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    bars = run(spark, streams.window_bars(s, symbol="symbol", time="ts", price="v", unit="2 days", slide="1 day", lateness="1 day"), "slide").collect()
    assert sum(r.n_events for r in bars) == 4 and max(r.n_events for r in bars) == 2


def test_polled_changes(spark, tmp_path):
    schema = "k string, kind string, ref string, day date, status string"
    poll = streams.polled_changes(str(tmp_path), by="k", kind="kind", ref="ref", day="day", status="status", today="2024-01-01")
    day = lambda rows: spark.createDataFrame([(k, "e", r, d, s) for k, r, d, s in rows], "k string, kind string, ref string, day string, status string").withColumn("day", F.to_date("day"))
    first = day([("a", "r1", "2024-02-01", "est"), ("a", "r2", "2024-03-01", "est")])
    second = day([("a", "r1", "2024-02-05", "est"), ("a", "r2", "2024-03-01", "conf"), ("b", None, "2024-05-01", "est")])
    poll(first, 0)
    poll(second, 1)
    told = lambda n: sorted((r.k, r.change) for r in spark.read.parquet(str(tmp_path / "changes" / f"n={n}")).collect())
    assert told(0) == [("a", "new"), ("a", "new")] and told(1) == [("a", "moved"), ("a", "status_changed"), ("b", "new")]
    poll(second, 1)
    assert told(1) == [("a", "moved"), ("a", "status_changed"), ("b", "new")]
    now = spark.read.schema(schema).parquet(str(tmp_path / "snapshot" / "n=1"))
    assert sorted((r.k, r.ref or "", str(r.day), r.status) for r in now.collect()) == [("a", "r1", "2024-02-05", "est"), ("a", "r2", "2024-03-01", "conf"), ("b", "", "2024-05-01", "est")]
