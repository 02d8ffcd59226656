"""The queries of the clean-up problems that belong to the core, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.norm import calendar_day, quarter_of, symbol_key
from tidemark.operators import drift, nested, timestamps, units, validity
from tidemark.session import cut, own_dir
from tidemark.sources.tables import once, table

#: Slashed dates are month first in these tables, so the day-first reading takes no part in the mixture.
TIME_FORMATS = tuple(f for f in timestamps.FORMATS if f != "dmy_slash")
ZONES = {"acceptedDate": "America/New_York"}


def income(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Income records, each once."""
    return once(table(spark, folder, "aapl_income_quarter", "inc_id", *columns), "inc_id", spread=True)


def quarter_records(spark: SparkSession, folder: str, *columns: str, repeated: bool = False) -> DataFrame:
    """Income records whose period names a quarter and whose date is not null, with key (the symbol's) and day; with
    repeated as often as they were delivered, for operators that count equal rows once."""
    names = list(dict.fromkeys(["symbol", "date", "period", *columns]))
    df = table(spark, folder, "aapl_income_quarter", "inc_id", *names) if repeated else income(spark, folder, *names)
    return df.where(F.col("date").isNotNull() & quarter_of(F.col("period")).isNotNull()).withColumns({"key": symbol_key(F.col("symbol")), "day": calendar_day(F.col("date"))})


def _times(spark: SparkSession, folder: str) -> DataFrame:
    env = once(table(spark, folder, "vsco_3m_daily").select("env_id", "fetched_at", F.col("raw_response.search_metadata.created_at").alias("created_at")), "env_id", spread=True)
    pairs = F.array(F.struct(F.lit("fetched_at").alias("src"), F.col("fetched_at").alias("value")), F.struct(F.lit("created_at").alias("src"), F.col("created_at").alias("value")))
    both = env.select(F.col("env_id").alias("record_id"), F.explode(pairs).alias("x")).select("x.src", "record_id", "x.value")
    filed = income(spark, folder, "acceptedDate").select(F.lit("acceptedDate").alias("src"), F.col("inc_id").alias("record_id"), F.col("acceptedDate").alias("value"))
    return both.unionByName(filed)


def p5_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every time value with its instant, format, posterior and status."""
    return timestamps.normalise_times(_times(spark, folder), source="src", value="value", zones=ZONES, formats=TIME_FORMATS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_times(spark, folder).where("time_status = 'resolved'").select("src", "record_id", "epoch_ms")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each source were read under each format, and with what status."""
    return p5_times(spark, folder).groupBy("src", "time_format", "time_status").agg(F.count("*").alias("n_values"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    q = quarter_records(spark, folder, "acceptedDate", "filingDate", repeated=True).where("key is not null and day is not null")
    q = q.select("inc_id", "key", "day", "filingDate", "acceptedDate", F.lit("acceptedDate").alias("src"))
    q = timestamps.normalise_times(q, source="src", value="acceptedDate", zones=ZONES, formats=TIME_FORMATS)
    filed = (F.unix_date(calendar_day(F.col("filingDate"))).cast("long") + 1) * validity.DAY
    known = q.select("key", "inc_id", F.unix_date("day").cast("bigint").alias("day"), F.coalesce("epoch_ms", filed).alias("known")).where("known is not null")
    seen = table(spark, folder, "universe_events", "event_id", "ticker", "fetched_at").where("fetched_at is not null")
    seen = seen.select("event_id", symbol_key(F.col("ticker")).alias("key"), F.unix_millis(F.col("fetched_at").try_cast("timestamp")).alias("at"))
    return validity.as_known_at(seen, known, entity="key", event_id="event_id", event_time="at", attribute_id="inc_id", valid_from="known", precedence=["day", "known"])


def _amounts(spark: SparkSession, folder: str) -> DataFrame:
    """All revenue amounts of both sources in one shape, with what their texts and records say of the unit."""
    inc = income(spark, folder, "symbol", "date", "period", "fiscalYear", "reportedCurrency", "revenue", "eps", "weightedAverageShsOut", "bottomLineNetIncome")
    # Per-share income is always in whole currency: times the shares it shows the unit of the record's own income.
    ratio = F.abs(F.try_divide(F.col("eps") * F.col("weightedAverageShsOut"), F.nullif(F.col("bottomLineNetIncome").cast("double"), F.lit(0.0))))
    rc = F.col("reportedCurrency")
    a = inc.where("revenue is not null").select(
        F.lit("aapl_income_quarter").alias("src"), F.col("inc_id").alias("record_id"), symbol_key(F.col("symbol")).alias("key"), F.regexp_extract("fiscalYear", r"(\d{4})", 1).try_cast("int").alias("year"),
        F.coalesce(calendar_day(F.col("date")), F.make_date(F.regexp_extract("fiscalYear", r"(\d{4})", 1).try_cast("int"), F.lit(12), F.lit(31))).alias("day"),
        (F.col("revenue").cast("decimal(19,0)") * 1000).cast("decimal(19,0)").alias("milli"), (F.col("revenue") / F.when(quarter_of(F.col("period")).isNotNull(), 1).otherwise(4)).alias("level"),
        units.stated_power(rc).alias("stated"), F.when(ratio > 0, F.log10(ratio)).alias("estimate"), units.stated_currency(rc).alias("currency"),
    )
    rm = once(table(spark, folder, "revenue_margins", "point_id", "symbol", "title", "category", "name", "axis_name", "data", "unit", "currency"), "point_id", spread=True)
    year = F.regexp_extract("category", r"(\d{4})", 1).try_cast("int")
    texts = [F.col("axis_name"), F.col("title")]
    b = rm.where("name = 'Revenue' and data is not null").select(
        F.lit("revenue_margins").alias("src"), F.col("point_id").alias("record_id"), symbol_key(F.col("symbol")).alias("key"), year.alias("year"), F.make_date(year, F.lit(12), F.lit(31)).alias("day"),
        (F.col("data").cast("decimal(22,3)") * 1000).cast("decimal(19,0)").alias("milli"), F.col("data").alias("level"),
        F.coalesce(units.stated_power(F.col("unit"), alone=True), *[units.stated_power(t) for t in texts], F.lit(0)).alias("stated"), F.lit(None).cast("double").alias("estimate"),
        F.coalesce(*[units.stated_currency(t) for t in (F.col("currency"), F.col("unit"), *texts)]).alias("currency"),
    )
    return a.unionByName(b)


def p2_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-null amount with its decoded power of ten, its currency and its whole US dollars."""
    # Read for the units, the symbols' currencies and the result: the texts are searched once.
    rows = cut(_amounts(spark, folder).withColumns({"series": F.concat_ws("|", "src", "key"), "id": F.concat_ws("|", "src", F.col("record_id").cast("string"))}))
    power = units.decode_powers(rows, record="id", series="series", day="day", level="level", stated="stated", estimate="estimate")
    main = units.currency_of(rows, key="key", currency="currency")
    rates = table(spark, folder, "fx_rates").select(F.col("currency").alias("cur"), F.col("fiscal_year").alias("year"), "usd_micros")
    full = rows.join(power, "id").join(main, "key", "left").withColumn("cur", F.coalesce("currency", "main_currency", F.lit("USD")))
    full = full.join(rates, ["cur", "year"], "left").withColumn("usd_micros", F.when(F.col("cur") == "USD", 1_000_000).otherwise(F.col("usd_micros")))
    return full.select("src", "record_id", "key", "year", "cur", "power", units.scaled_down(F.col("milli"), F.col("power"), F.col("usd_micros")).alias("usd"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_units(spark, folder).where("(cur <> 'USD' or power <> 0) and usd is not null").select("src", "record_id", "usd")


RESPONSE = "response"
BRANCHES = {"timeline": "interest_over_time.timeline_data/values", "top": "related_queries.top", "rising": "related_queries.rising"}


def _responses(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """The responses as delivered, with their keys: copies are dropped as flat rows, so nothing nested is shuffled."""
    df = table(spark, folder, "vsco_3m_daily")
    own = F.col("raw_response.search_metadata.id")
    return df, F.when(F.trim(own) != "", own).otherwise(F.col("env_id").cast("string"))


def p3_emitted(spark: SparkSession, folder: str) -> DataFrame:
    df, key = _responses(spark, folder)
    # q travels in the key so that each innermost row leads to its search term without a join.
    q = F.coalesce("request_params.q", "raw_response.search_parameters.q")
    return nested.shred(df, key=F.to_json(F.struct(key.alias("k"), q.alias("q"))), root=RESPONSE)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    e = p3_emitted(spark, folder)
    tag = {f"{RESPONSE}/raw_response.{path}": b for b, path in BRANCHES.items()}
    rows = e.where(F.col("tag").isin(list(tag))).select(F.from_json("root_key", "k string, q string").alias("r"), "tag", "ordinals")
    branch = F.try_element_at(F.create_map(*[F.lit(x) for kv in tag.items() for x in kv]), F.col("tag"))
    return rows.select(F.col("r.k").alias("parent_key"), F.col("r.q").alias("q"), branch.alias("branch"), F.get("ordinals", F.lit(0)).alias("outer_no"), F.coalesce(F.get("ordinals", F.lit(1)), F.lit(0)).alias("inner_no")).distinct()


def p3_written(spark: SparkSession, folder: str) -> DataFrame:
    """The flat tables written by tag and read back, each with its own schema: rows, and those whose parent is there."""
    df, key = _responses(spark, folder)
    at = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    nested.write_tables(df, at, key=key, root=RESPONSE)
    flats = {f.tag: nested.read_table(spark, at, f) for f in nested.flat_tables(df.schema, RESPONSE)}
    out = None
    for tag, rows in flats.items():
        above = tag.rsplit("/", 1)[0]
        d = rows.select(F.lit(tag).alias("tag"), "parent_pk")
        if above in flats:
            d = d.join(flats[above].select(F.col("pk").alias("parent_pk"), F.lit(1).alias("there")), "parent_pk", "left")
        else:
            d = d.withColumn("there", F.lit(None).cast("int"))
        d = d.groupBy("tag").agg(F.count("*").alias("n_rows"), F.count("there").alias("n_linked"))
        out = d if out is None else out.unionByName(d)
    return out


def p3_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct parents of each flat table, copies of a response counted once."""
    df, key = _responses(spark, folder)
    rows = nested.distinct_rows(nested.shred(df, key=key, root=RESPONSE))
    return rows.groupBy("tag").agg(F.count("*").alias("n_rows"), F.count_distinct("parent_pk").alias("n_parents"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "aapl_segmentation", "seg_id", "file_name", "file_date", "symbol", "fiscalYear", "data"), "seg_id", spread=True)


def _described(df: DataFrame) -> DataFrame:
    return drift.descriptors(df, entity="symbol", file="file_name", order="file_date", year="fiscalYear", data="data")


def top_changes(changes: DataFrame) -> DataFrame:
    """(file_name, change, field, old_field): what the edits of drift.file_changes() mean for the top-level fields."""
    name = lambda c: F.expr(f"substr({c}, 2)")
    row = lambda change, field, old: F.struct(change.alias("change"), field.alias("field"), old.alias("old_field"))
    # A field that came to the top level from below is new among the top-level fields, one that went below is gone.
    moved = F.array_compact(F.array(F.when(F.col("depth") == 1, row(F.lit("added"), name("path"), F.lit(""))), F.when(F.col("old_depth") == 1, row(F.lit("removed"), name("old_path"), F.lit("")))))
    plain = F.when(F.col("depth") == 1, F.array(row(F.col("change"), name("path"), F.when(F.col("change") == "renamed", name("old_path")).otherwise(F.lit("")))))
    # A renamed field that also has another type is reported as renamed only.
    told = changes.where("change <> 'retyped' or old_path = ''")
    return told.select(F.col("file").alias("file_name"), F.explode(F.when(F.col("change") == "moved", moved).otherwise(plain)).alias("x")).select("file_name", "x.*")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_changes(drift.file_changes(_described(_segments(spark, folder))))


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table: every segment amount under the name its field first had."""
    seg = _segments(spark, folder)
    d = _described(seg)
    long = drift.unify(seg, drift.projections(d, drift.file_changes(d)), entity="symbol", file="file_name", data="data", keep=["symbol", "file_name", "fiscalYear"])
    return long.select("symbol", "file_name", F.col("fiscalYear").alias("fiscal_year"), F.col("canonical").alias("segment"), drift.amount_text(F.col("value")).alias("amount"))


QUERIES = {"p2_found": p2_found, "p2_units": p2_units, "p3_found": p3_found, "p3_tables": p3_tables, "p3_written": p3_written, "p4_found": p4_found, "p4_table": p4_table, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found}

_FLAT = """
WITH r AS (SELECT DISTINCT coalesce(CASE WHEN trim(raw_response.search_metadata.id) <> '' THEN raw_response.search_metadata.id END, CAST(env_id AS VARCHAR)) AS k,
       raw_response.interest_over_time.timeline_data AS tl, raw_response.related_queries.top AS tp, raw_response.related_queries.rising AS rs FROM vsco_3m_daily),
t1 AS (SELECT k, tl, unnest(generate_series(1, len(tl))) AS i FROM r WHERE len(tl) > 0),
t2 AS (SELECT DISTINCT k, i FROM t1 WHERE tl[i] IS NOT NULL),
t3 AS (SELECT k, i, tl[i].values AS vs, unnest(generate_series(1, len(tl[i].values))) AS j FROM t1 WHERE len(tl[i].values) > 0),
t4 AS (SELECT DISTINCT k, i, j FROM t3 WHERE vs[j] IS NOT NULL),
a AS (SELECT k, tp, unnest(generate_series(1, len(tp))) AS i FROM r WHERE len(tp) > 0), a2 AS (SELECT DISTINCT k, i FROM a WHERE tp[i] IS NOT NULL),
b AS (SELECT k, rs, unnest(generate_series(1, len(rs))) AS i FROM r WHERE len(rs) > 0), b2 AS (SELECT DISTINCT k, i FROM b WHERE rs[i] IS NOT NULL),
n AS (SELECT 'response' AS tag, count(DISTINCT k) AS n_rows, 0 AS n_parents FROM r
UNION ALL SELECT 'response/raw_response.interest_over_time.timeline_data', count(*), count(DISTINCT k) FROM t2
UNION ALL SELECT 'response/raw_response.interest_over_time.timeline_data/values', count(*), count(DISTINCT (k, i)) FROM t4
UNION ALL SELECT 'response/raw_response.related_queries.top', count(*), count(DISTINCT k) FROM a2
UNION ALL SELECT 'response/raw_response.related_queries.rising', count(*), count(DISTINCT k) FROM b2)
"""
SQL = {
    "p3_found": """
WITH r AS (SELECT DISTINCT coalesce(CASE WHEN trim(raw_response.search_metadata.id) <> '' THEN raw_response.search_metadata.id END, CAST(env_id AS VARCHAR)) AS parent_key,
       coalesce(request_params.q, raw_response.search_parameters.q) AS q, raw_response.interest_over_time.timeline_data AS tl, raw_response.related_queries.top AS tp, raw_response.related_queries.rising AS rs FROM vsco_3m_daily),
t1 AS (SELECT parent_key, q, tl, unnest(generate_series(1, len(tl))) AS i FROM r WHERE tl IS NOT NULL AND len(tl) > 0),
t2 AS (SELECT parent_key, q, i, tl[i].values AS vs FROM t1),
t3 AS (SELECT parent_key, q, i, vs, unnest(generate_series(1, len(vs))) AS j FROM t2 WHERE vs IS NOT NULL AND len(vs) > 0),
p1 AS (SELECT parent_key, q, tp, unnest(generate_series(1, len(tp))) AS i FROM r WHERE tp IS NOT NULL AND len(tp) > 0),
p2 AS (SELECT parent_key, q, rs, unnest(generate_series(1, len(rs))) AS i FROM r WHERE rs IS NOT NULL AND len(rs) > 0)
SELECT DISTINCT * FROM (
SELECT parent_key, q, 'timeline' AS branch, CAST(i - 1 AS INTEGER) AS outer_no, CAST(j - 1 AS INTEGER) AS inner_no FROM t3 WHERE vs[j] IS NOT NULL
UNION ALL SELECT parent_key, q, 'top', CAST(i - 1 AS INTEGER), 0 FROM p1 WHERE tp[i] IS NOT NULL
UNION ALL SELECT parent_key, q, 'rising', CAST(i - 1 AS INTEGER), 0 FROM p2 WHERE rs[i] IS NOT NULL)
""",
    "p3_tables": _FLAT + "SELECT tag, n_rows, CAST(n_parents AS BIGINT) AS n_parents FROM n WHERE n_rows > 0",
    "p3_written": _FLAT + "SELECT tag, n_rows, CASE WHEN tag = 'response' THEN 0 ELSE n_rows END AS n_linked FROM n WHERE n_rows > 0",
}
