"""Queries over filings and lookups. Orders stand for filings, customers for filers, lines for the holdings of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filings
from tidemark.sources.tables import table


def _filings(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return o.select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("form"), F.col("o_orderdate").cast("date").alias("filed"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.concat_ws(", ", F.col("o_orderstatus"), F.expr("cast(o_orderkey % 5 as string)")).alias("items"))


_KEYS = {"entity": "cik", "filed": "filed", "accession": "accession"}


def filings_newest(s: SparkSession, d: str) -> DataFrame:
    return filings.select_filings(_filings(s, d), **_KEYS, form="1-URGENT", limit=3).select("cik", "accession", "filed", "place")


def filings_by_item(s: SparkSession, d: str) -> DataFrame:
    """The item is looked for before the limit."""
    return filings.select_filings(_filings(s, d), **_KEYS, item="3", limit=2).select("cik", "accession", "place")


def filings_latest(s: SparkSession, d: str) -> DataFrame:
    return filings.latest_filing(_filings(s, d), **_KEYS, forms=["1-URGENT", "2-HIGH"]).select("cik", "accession", "form", "filed")


def filings_of_period(s: SparkSession, d: str) -> DataFrame:
    return filings.select_filings(_filings(s, d), **_KEYS, period="1996-03").select("cik", "accession", "place")


def filing_urls(s: SparkSession, d: str) -> DataFrame:
    c, a = F.lpad(F.col("cik").cast("string"), 10, "0"), F.concat(F.lit("0000-"), F.col("accession").cast("string"))
    f = _filings(s, d).select("cik", "accession", filings.document_url(c, a, F.when(F.col("form") != "5-LOW", F.concat("form", F.lit(".htm")))).alias("url"))
    return f


def filing_exhibits(s: SparkSession, d: str) -> DataFrame:
    """Each order is a folder whose files are its lines."""
    li = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    kinds = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("EX99_"), F.col("l_linenumber"), F.lit(".htm"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("a"), F.col("l_suppkey"), F.lit("report.HTML"))).otherwise(F.concat(F.lit("R"), F.col("l_linenumber"), F.lit(".htm")))
    files = li.select(F.col("l_suppkey").alias("cik"), F.col("l_orderkey").alias("accession"), kinds.alias("name")).distinct()
    return filings.exhibits(files).select("cik", "accession", "name", "label", "place")


def resolved_names(s: SparkSession, d: str) -> DataFrame:
    """Numbers, tickers, whole names, beginnings of names and unknown ones."""
    filers = table(s, d, "customer", "c_custkey", "c_name").withColumn("ticker", F.concat(F.lit("CU-"), F.col("c_custkey")))
    n = table(s, d, "nation", "n_nationkey", "n_name")
    asked = n.select(F.explode(F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" cu."), F.col("n_nationkey")), F.concat(F.lit("CUSTOMER#0000000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")), F.concat(F.lit("customer#000000"), F.col("n_nationkey")), F.col("n_name"))).alias("q"))
    r = filings.resolve(asked, filers, identifier="q", id="c_custkey", name="c_name", ticker="ticker")
    return r.select("identifier", "id", "name", "status", "n_candidates", F.array_join("candidates", "|").alias("candidates"))


def found_parts(s: SparkSession, d: str) -> DataFrame:
    """'17' is a part's number, so names and types that hold it don't count."""
    p = table(s, d, "part", "p_partkey", "p_name", "p_type")
    one = filings.lookup(p, "17", id="p_partkey", columns=["p_name", "p_type"]).withColumn("asked", F.lit("17"))
    return one.unionByName(filings.lookup(p, "RED", id="p_partkey", columns=["p_name", "p_type"]).withColumn("asked", F.lit("RED"))).select("asked", "p_partkey", "p_name")


def concept_counts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part", "p_type", "p_name", "p_brand")
    return filings.concepts(p, keys=["p_type", "p_name"], unit="p_brand", like="RED").select("p_type", "p_name", "n_facts", F.array_join("units", "|").alias("units"))


def fund_overlap(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    return filings.fund_overlap(li, fund="l_suppkey", issuer="l_partkey", value="q", least=3)


QUERIES = {f.__name__: f for f in (filings_newest, filings_by_item, filings_latest, filings_of_period, filing_urls, filing_exhibits, resolved_names, found_parts, concept_counts, fund_overlap)}

_F = "WITH f AS (SELECT o_custkey AS cik, o_orderkey AS accession, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed, strftime(o_orderdate, '%Y-%m') AS period, [o_orderstatus, CAST(o_orderkey % 5 AS VARCHAR)] AS items FROM orders)"
_PLACE = "CAST(row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) AS INTEGER) AS place"
_NAMES = "SELECT CAST(n_nationkey AS VARCHAR) AS i FROM nation UNION SELECT ' cu.' || n_nationkey FROM nation UNION SELECT 'CUSTOMER#0000000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation UNION SELECT 'customer#000000' || n_nationkey FROM nation UNION SELECT n_name FROM nation"
SQL = {
    "filings_newest": _F + f" SELECT cik, accession, filed, {_PLACE} FROM f WHERE form = '1-URGENT' QUALIFY place <= 3",
    "filings_by_item": _F + f" SELECT cik, accession, {_PLACE} FROM f WHERE list_contains(items, '3') QUALIFY place <= 2",
    "filings_latest": _F + f" SELECT cik, accession, form, filed FROM (SELECT *, {_PLACE} FROM f WHERE form IN ('1-URGENT', '2-HIGH')) WHERE place = 1",
    "filings_of_period": _F + f" SELECT cik, accession, {_PLACE} FROM f WHERE period = '1996-03'",
    "filing_urls": _F + " SELECT cik, accession, CASE WHEN form <> '5-LOW' THEN 'https://www.sec.gov/Archives/edgar/data/' || cik || '/0000' || accession || '/' || form || '.htm' END AS url FROM f",
    "filing_exhibits": "WITH x AS (SELECT DISTINCT l_suppkey AS cik, l_orderkey AS accession, CASE WHEN l_returnflag = 'R' THEN 'EX99_' || l_linenumber || '.htm' ELSE 'a' || l_suppkey || 'report.HTML' END AS name, CASE WHEN l_returnflag = 'R' THEN 'EX-99.' || l_linenumber ELSE '' END AS label FROM lineitem WHERE l_returnflag IN ('R', 'A')) SELECT *, CAST(row_number() OVER (PARTITION BY cik, accession ORDER BY label = '', name) AS INTEGER) AS place FROM x",
    "resolved_names": f"WITH q AS ({_NAMES}), c AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS id FROM customer), h AS (SELECT i, id, c_name FROM q JOIN c ON NOT regexp_full_match(trim(i), '[0-9]+') AND ('CU-' || c_custkey = replace(upper(trim(i)), '.', '-') OR starts_with(lower(c_name), lower(trim(i))))), g AS (SELECT i, count(*) AS n, min(id) AS id, min(c_name) AS nm, array_to_string(list_sort(list(id || ' ' || c_name))[1:15], '|') AS cs FROM h GROUP BY 1) "
    "SELECT q.i AS identifier, CASE WHEN c.id IS NOT NULL THEN c.id WHEN n = 1 THEN g.id END AS id, CASE WHEN c.id IS NOT NULL THEN c.c_name WHEN n = 1 THEN nm END AS name, CASE WHEN c.id IS NOT NULL OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN c.id IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS n_candidates, CASE WHEN n > 1 THEN cs ELSE '' END AS candidates FROM q LEFT JOIN g USING (i) LEFT JOIN c ON regexp_full_match(q.i, '[0-9]+') AND lpad(q.i, 10, '0') = c.id",
    "found_parts": "SELECT '17' AS asked, p_partkey, p_name FROM part WHERE p_partkey = 17 UNION ALL SELECT 'RED', p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%'",
    "concept_counts": "SELECT p_type, p_name, count(*) AS n_facts, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS units FROM part WHERE lower(p_name) LIKE '%red%' GROUP BY 1, 2",
    "fund_overlap": "WITH p AS (SELECT l_partkey, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2) SELECT l_partkey, count(*) AS n_funds, CAST(sum(v) AS BIGINT) AS value FROM p GROUP BY 1 HAVING count(*) >= 3",
}
