"""Documents of data services as tables: what each answers, with the schema it has, and how requests are planned.

Every function takes a table of documents (their text in one column), so the same code serves recorded files, a REST
source and tests. Unreadable documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields of the services' records and their types.
ENDPOINTS = {
    "prices": "symbol string, date string, open double, high double, low double, close double, adjClose double, volume double",
    "screener": "symbol string, companyName string, marketCap double, sector string, industry string, beta double, price double, volume double, exchangeShortName string, country string, isEtf string, isActivelyTrading string",
    "profile": "symbol string, companyName string, price double, marketCap double, beta double, sector string, industry string, cik string, currency string, exchange string, isEtf string",
    "core": "symbol string, cik string, exchange string, sicCode string, fiscalYearEnd string, registrantName string",
    "income": "date string, symbol string, reportedCurrency string, cik string, filingDate string, acceptedDate string, fiscalYear string, period string, revenue bigint, costOfRevenue bigint, operatingIncome bigint, netIncome bigint, eps double, epsDiluted double",
    "calendar": "symbol string, date string, epsActual double, epsEstimated double, revenueActual bigint, revenueEstimated bigint, lastUpdated string, fiscalDateEnding string, time string",
    "transcripts": "symbol string, quarter int, year int, date string, content string",
    "news": "symbol string, publishedDate string, title string, site string, url string, text string",
}


def records(docs: DataFrame, *, json: str, schema: str, keep: Sequence[str] = (), field: str | None = None) -> DataFrame:
    """(keep, fields of schema): the objects of documents that are arrays, or whose field holds the array."""
    item = "struct<" + ",".join(f"`{x.split()[0]}`:{x.split()[1]}" for x in schema.split(", ")) + ">"
    rows = F.from_json(json, f"array<{item}>") if field is None else F.from_json(json, f"struct<`{field}`:array<{item}>>")[field]
    return docs.select(*keep, F.explode(rows).alias("__x")).where("__x is not null").select(*keep, "__x.*")


def endpoint(docs: DataFrame, name: str, *, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """The records of one of the ENDPOINTS."""
    return records(docs, json=json, schema=ENDPOINTS[name], keep=keep)


def coming_earnings(docs: DataFrame, *, json: str, today: Column) -> DataFrame:
    """(ticker, type, date, status, source): announced dates from today on, as calendar entries; one per ticker and day."""
    d = endpoint(docs, "calendar", json=json).withColumn("date", F.substring("date", 1, 10)).where(F.try_to_date("date", "yyyy-MM-dd") >= today)
    return d.select(F.upper("symbol").alias("ticker"), F.lit("earnings").alias("type"), "date", F.lit("estimated").alias("status"), F.lit("calendar").alias("source")).distinct()


def news(docs: DataFrame, roster: DataFrame, *, json: str, ticker: str, since: str | None = None, longest: int = 500) -> DataFrame:
    """(ticker, date, title, site, url, text): news of the roster's tickers, from since on (undated news stays), the text cut
    to so many characters. An equi-join with the roster's distinct tickers; others' news is dropped."""
    d = endpoint(docs, "news", json=json).select(F.upper("symbol").alias("ticker"), F.substring("publishedDate", 1, 10).alias("date"), "title", "site", "url", F.substring(F.coalesce("text", F.lit("")), 1, longest).alias("text"))
    d = d.join(roster.select(F.upper(F.trim(ticker)).alias("ticker")).distinct(), "ticker", "left_semi")
    return d.where(F.col("date").isNull() | (F.col("date") == "") | (F.col("date") >= since)) if since else d


def frames(docs: DataFrame, *, json: str) -> DataFrame:
    """(taxonomy, tag, unit, period, cik, entity, accession, end, value): one tag of one period across all filers."""
    fact = "struct<accn:string,cik:bigint,entityName:string,loc:string,start:string,end:string,val:double>"
    d = docs.select(F.from_json(json, f"struct<taxonomy:string,tag:string,ccp:string,uom:string,data:array<{fact}>>").alias("j"))
    d = d.select("j.taxonomy", "j.tag", F.col("j.uom").alias("unit"), F.col("j.ccp").alias("period"), F.explode("j.data").alias("x"))
    return d.select("taxonomy", "tag", "unit", "period", F.lpad(F.col("x.cik").cast("string"), 10, "0").alias("cik"), F.col("x.entityName").alias("entity"), F.col("x.accn").alias("accession"), F.col("x.end").alias("end"), F.col("x.val").alias("value"))


def company_facts(docs: DataFrame, *, json: str) -> DataFrame:
    """(cik, taxonomy, tag, unit, end, value, fy, fp, form, filed) of documents with all facts of a company."""
    fact = "struct<end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
    d = docs.select(F.from_json(json, f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<{fact}>>>>>>").alias("j"))
    d = d.select("j.cik", F.explode("j.facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "u"))
    d = d.select("cik", "taxonomy", "tag", F.explode("u.units").alias("unit", "fs")).select("cik", "taxonomy", "tag", "unit", F.explode("fs").alias("f"))
    return d.select("cik", "taxonomy", "tag", "unit", "f.end", F.col("f.val").alias("value"), "f.fy", "f.fp", "f.form", "f.filed")


def tickers(docs: DataFrame, *, json: str) -> DataFrame:
    """(ticker, cik, title) of the official list; tickers in upper case with dashes."""
    d = docs.select(F.explode(F.from_json(json, "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("k", "v"))
    return d.select(F.translate(F.upper("v.ticker"), ".", "-").alias("ticker"), F.lpad("v.cik_str", 10, "0").alias("cik"), F.col("v.title").alias("title"))


def filers(docs: DataFrame, *, xml: str) -> DataFrame:
    """(cik, name): answers of a search for filers. A document about one company gives that one; a list gives each entry
    once, by its first place, with '(name unavailable)' where it has no title."""
    tag = lambda c, n: F.trim(F.regexp_extract(c, rf"(?is)<(?:\w+:)?{n}\b[^>]*>([^<]*)<", 1))
    whole = F.regexp_replace(xml, r"(?is)<(?:\w+:)?entry\b.*?</(?:\w+:)?entry>", "")
    one = F.struct(tag(whole, "cik").alias("cik"), tag(whole, "conformed-name").alias("name"))
    entries = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?entry\b.*?</(?:\w+:)?entry>"), 0), lambda e: F.struct(tag(e, "cik").alias("cik"), tag(e, "title").alias("name")))
    found = F.when((one["cik"] != "") & (one["name"] != ""), F.array(one)).otherwise(entries)
    d = docs.select(F.monotonically_increasing_id().alias("__d"), F.posexplode(found).alias("__p", "x")).where("x.cik <> ''")
    first = d.groupBy(F.lpad("x.cik", 10, "0").alias("cik")).agg(F.min_by(F.struct("x.name"), F.struct("__d", "__p")).alias("n"))
    return first.select("cik", F.coalesce(F.nullif(F.col("n.name"), F.lit("")), F.lit("(name unavailable)")).alias("name"))


#: A full-text search answers a page at a time and no more than so many hits in all.
PAGE, MOST_HITS = 100, 10_000


def pages(totals: DataFrame, *, query: str, total: str) -> DataFrame:
    """(query, start, reachable): the pages to ask for; hits behind MOST_HITS can't be reached, reachable tells if all can."""
    n = F.least(F.col(total), F.lit(MOST_HITS))
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"), F.lit(PAGE).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return totals.select(query, F.explode(starts).alias("start"), (F.col(total) <= MOST_HITS).alias("reachable"))


def hits(docs: DataFrame, *, json: str) -> DataFrame:
    """(id, cik, form, filed, name): the hits of full-text search pages, each document once."""
    src = "struct<ciks:array<string>,form:string,file_date:string,display_names:array<string>>"
    d = docs.select(F.explode(F.from_json(json, f"struct<hits:struct<hits:array<struct<_id:string,_source:{src}>>>>")["hits"]["hits"]).alias("h"))
    return d.select(F.col("h._id").alias("id"), F.get("h._source.ciks", F.lit(0)).alias("cik"), F.col("h._source.form").alias("form"), F.col("h._source.file_date").alias("filed"), F.get("h._source.display_names", F.lit(0)).alias("name")).distinct()


def missing_requests(wanted: DataFrame, cached: DataFrame, *, key: str, fetched: str, fresh: Column) -> DataFrame:
    """The wanted requests for which the cache holds no response that may be used; fresh is a condition over the cache's
    columns, see readers.cached_fresh(). A request asked for twice comes out once."""
    usable = cached.where(fresh).select(key).distinct()
    return wanted.dropDuplicates([key]).join(usable, key, "left_anti")


def newest_responses(cached: DataFrame, *, key: str, fetched: str) -> DataFrame:
    """The last response of each request."""
    w = Window.partitionBy(key).orderBy(F.col(fetched).desc_nulls_last())
    return cached.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_filings_news(filed: DataFrame, roster: DataFrame, *, cik: str, most: int = 5) -> DataFrame:
    """The last current reports (8-K) of each filer of the roster, newest first, with place."""
    from tidemark.operators.filings import select_filings

    return select_filings(filed.join(roster.select(cik).distinct(), cik, "left_semi"), entity=cik, filed="filed", accession="accession", form="8-K", limit=most)
