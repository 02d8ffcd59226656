"""Lists of filings: selection, newest first, document addresses, exhibits, and who a name or number stands for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.strings import has_code, padded_id

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
#: The parallel arrays of a submissions document and the columns they become.
ARRAYS = {"form": "form", "filingDate": "filed", "reportDate": "period", "accessionNumber": "accession", "primaryDocument": "primary_doc", "items": "items", "acceptanceDateTime": "acceptance"}


def submission_rows(docs: DataFrame, *, cik: str, json: str, overflow: DataFrame | None = None, overflow_json: str = "json") -> DataFrame:
    """(cik, name, row_no, form, filed, period, accession, primary_doc, items, acceptance): the filings of submissions
    documents, and those of the overflow documents (cik and the same arrays without a wrapper) behind them.

    Row i holds element i of each array; a missing or short array gives ''. As many rows come out as there are forms.
    """
    from tidemark.sources.readers import zipped

    arrays = "struct<" + ",".join(f"{a}:array<string>" for a in ARRAYS) + ">"
    d = docs.select(F.col(cik).alias("cik"), F.from_json(json, f"struct<name:string,filings:struct<recent:{arrays}>>").alias("j"))
    d = d.select("cik", F.col("j.name").alias("name"), F.col("j.filings.recent").alias("r"))
    if overflow is not None:
        more = overflow.select(F.col(cik).alias("cik"), F.lit(None).cast("string").alias("name"), F.from_json(overflow_json, arrays).alias("r"))
        d = d.unionByName(more)
    n = F.coalesce(F.size("r.form"), F.lit(0))
    rows = zipped(d.withColumn("n", n), F.col("r"), list(ARRAYS), ["cik", "name", "n"]).where("row_no < n")
    return rows.select("cik", "name", "row_no", *[F.col(a).alias(b) for a, b in ARRAYS.items()])


def select_filings(df: DataFrame, *, entity: str, filed: str, accession: str, form: str | None = None, forms: Sequence[str] = (), form_column: str = "form", item: str | None = None, items: str = "items", period: str | None = None, period_column: str = "period", limit: int = 0) -> DataFrame:
    """The filings of each entity newest first, with place (1 is the newest); limit rows of each, 0 for all.

    form matches exactly, in case and spaces; forms is a set of them. item must be among the comma-separated codes of
    items, period must equal the period column. All filters act before the limit. Filings of one day follow their
    accession, the greatest first; those without a day are oldest. Null entities count as one.
    """
    d = df
    if form is not None:
        d = d.where(F.col(form_column) == form)
    if forms:
        d = d.where(F.col(form_column).isin(*forms))
    if item is not None:
        d = d.where(has_code(F.col(items), item))
    if period is not None:
        d = d.where(F.col(period_column) == period)
    w = Window.partitionBy(entity).orderBy(F.col(filed).desc_nulls_last(), F.col(accession).desc_nulls_last())
    d = d.withColumn("place", F.row_number().over(w))
    return d.where(F.col("place") <= limit) if limit else d


def latest_filing(df: DataFrame, **how) -> DataFrame:
    """The newest filing of each entity; the arguments are those of select_filings()."""
    return select_filings(df, **how, limit=1).drop("place")


def by_accession(df: DataFrame, accession: str, column: str = "accession") -> DataFrame:
    """The filings with this accession number, dashes aside."""
    return df.where(F.replace(F.col(column), F.lit("-"), F.lit("")) == accession.replace("-", ""))


def folder_url(cik: Column, accession: Column) -> Column:
    """The address of a filing's folder: the number without leading zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(ARCHIVE), cik.cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")))


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    """The address of a filing's document, null where it names none."""
    return F.when(F.coalesce(F.trim(document), F.lit("")) != "", F.concat(folder_url(cik, accession), F.lit("/"), document))


def manifest(indexes: DataFrame, *, cik: str, accession: str, json: str) -> DataFrame:
    """(cik, accession, name, type, size, url): every file of the folders whose index documents are given."""
    item = "struct<name:string,type:string,size:string>"
    d = indexes.select(F.col(cik).alias("cik"), F.col(accession).alias("accession"), F.from_json(json, f"struct<directory:struct<item:array<{item}>>>").alias("j"))
    d = d.select("cik", "accession", F.inline("j.directory.item"))
    return d.withColumn("url", F.concat(folder_url(F.col("cik"), F.col("accession")), F.lit("/"), F.col("name")))


# Names of pages that only render data, and of exhibits.
_VIEWER = r"^r\d+\.htm$|-index(-headers)?\.html?$"
_EXHIBIT = r"ex(?:hibit)?[-_]?(\d{1,2})[._-]?(\d)?"


def exhibits(files: DataFrame, *, name: str = "name", primary: Column | None = None) -> DataFrame:
    """Readable documents of a folder but the primary one and viewer pages, with label (such as EX-99.1, else '') and
    place: labelled ones first, then by name, within a folder (cik, accession)."""
    low = F.lower(F.col(name))
    d = files.where(low.rlike(r"\.html?$") & ~low.rlike(_VIEWER))
    if primary is not None:
        d = d.where(~F.coalesce(F.col(name) == primary, F.lit(False)))
    number, part = F.regexp_extract(low, _EXHIBIT, 1), F.regexp_extract(low, _EXHIBIT, 2)
    d = d.withColumn("label", F.when(number == "", "").otherwise(F.concat(F.lit("EX-"), number, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))))
    w = Window.partitionBy("cik", "accession").orderBy(F.col("label") == "", name)
    return d.withColumn("place", F.row_number().over(w))


def resolve(identifiers: DataFrame, filers: DataFrame, *, identifier: str, id: str, name: str, ticker: str | None = None, listed: int = 15) -> DataFrame:
    """(identifier, id, name, status, n_candidates, candidates) for each distinct identifier.

    Up to ten digits are a number, padded to ten; else a ticker ('.' and '-' alike, any case) counts, else a name that
    begins with the text, in any case. status is 'resolved', 'ambiguous' (id and name are null; candidates lists the
    first of them by id) or 'unknown'. Numbers resolve without being listed among the filers, with a null name. Null
    and blank identifiers are unknown.

    Names meet by equality of their beginnings: of each filer's name those lengths are formed that some identifier has.
    """
    q = identifiers.select(F.col(identifier).alias("identifier")).distinct().withColumn("t", F.trim("identifier"))
    f = filers.select(padded_id(F.col(id)).alias("id"), F.col(name).alias("name"), *([F.translate(F.upper(F.trim(ticker)), ".", "-").alias("tk")] if ticker else [])).distinct()
    digits = F.col("t").rlike(r"^\d{1,10}$")
    numbers = q.where(digits).withColumn("k", padded_id(F.col("t"))).join(f.select(F.col("id").alias("k"), F.col("name").alias("hit")), "k", "left")
    out = numbers.groupBy("identifier", "k").agg(F.min("hit").alias("name")).select("identifier", F.col("k").alias("id"), "name", F.lit("resolved").alias("status"), F.lit(1).cast("bigint").alias("n_candidates"), F.array().cast("array<string>").alias("candidates"))
    rest = q.where(~digits | F.col("t").isNull())
    hits = None
    if ticker:
        hits = rest.withColumn("k", F.translate(F.upper("t"), ".", "-")).join(f.where("tk <> ''").select(F.col("tk").alias("k"), "id", "name"), "k").select("identifier", "id", "name")
        named = rest.join(hits.select("identifier").distinct(), "identifier", "left_anti")
    else:
        named = rest
    low = named.where("t <> ''").select("identifier", F.lower("t").alias("k"))
    lengths = low.agg(F.collect_set(F.length("k")).alias("ls"))
    # One row: the distinct lengths of the names asked for.
    starts = f.join(F.broadcast(lengths)).select("id", "name", F.explode(F.filter("ls", lambda n: n <= F.length("name"))).alias("n")).select("id", "name", F.lower(F.expr("left(name, n)")).alias("k"))
    begun = low.join(starts, "k").select("identifier", "id", "name")
    hits = begun if hits is None else hits.unionByName(begun)
    ranked = hits.distinct().withColumn("n", F.row_number().over(Window.partitionBy("identifier").orderBy("id", "name")))
    found = ranked.groupBy(F.col("identifier").alias("__i")).agg(F.count_distinct("id").alias("n_candidates"), F.min("id").alias("id"), F.min(F.when(F.col("n") == 1, F.col("name"))).alias("name"), F.array_sort(F.collect_list(F.when(F.col("n") <= listed, F.concat_ws(" ", "id", "name")))).alias("candidates"))
    one = F.col("n_candidates") == 1
    found = rest.select("identifier").join(found, F.col("identifier") == F.col("__i"), "left")
    found = found.select("identifier", F.when(one, F.col("id")).alias("id"), F.when(one, F.col("name")).alias("name"), F.when(one, "resolved").when(F.col("n_candidates") > 1, "ambiguous").otherwise("unknown").alias("status"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(F.col("n_candidates") > 1, F.col("candidates")).otherwise(F.array().cast("array<string>")).alias("candidates"))
    return out.unionByName(found)


def required(resolved: DataFrame) -> DataFrame:
    """resolved, but an identifier that isn't resolved fails the query with a message that names it."""
    told = F.concat(F.lit("cannot resolve "), F.coalesce("identifier", F.lit("null")), F.lit(": "), F.col("status"), F.lit(" "), F.concat_ws("; ", "candidates"))
    return resolved.withColumn("id", F.when(F.col("status") == "resolved", F.col("id")).otherwise(F.raise_error(told).cast("string")))


def lookup(df: DataFrame, text: str, *, id: str, columns: Sequence[str]) -> DataFrame:
    """The rows with id equal to text; if there's none, those with text in one of the columns, in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    exact = F.coalesce(F.col(id).cast("string") == text, F.lit(False))
    any_exact = df.where(exact).agg((F.count("*") > 0).alias("__any"))
    return df.where(exact | found).withColumn("__exact", exact).join(F.broadcast(any_exact)).where("__exact or not __any").drop("__exact", "__any")


def concepts(facts: DataFrame, *, keys: Sequence[str], unit: str, like: str | None = None) -> DataFrame:
    """(keys, n_facts, units): facts and sorted distinct units of each concept whose last key holds like, in any case."""
    d = facts.where(F.lower(F.col(keys[-1])).contains(like.lower())) if like else facts
    return d.groupBy(*keys).agg(F.count("*").alias("n_facts"), F.array_sort(F.collect_set(unit)).alias("units"))


def fund_overlap(positions: DataFrame, *, fund: str, issuer: str, value: str, least: int = 2) -> DataFrame:
    """(issuer, n_funds, value): issuers that at least so many funds hold, with what they hold together."""
    per = positions.groupBy(issuer, fund).agg(F.sum(value).alias("v"))
    return per.groupBy(issuer).agg(F.count("*").alias("n_funds"), F.sum("v").alias("value")).where(F.col("n_funds") >= least)
