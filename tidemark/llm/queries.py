"""Queries of the language-model problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.norm import calendar_day, symbol_key
from tidemark.llm import mixing, nearest, splitting, tokens
from tidemark.plans.problems import quarter_records
from tidemark.session import cut
from tidemark.sources.tables import once, table

#: The curriculum of p8_mix: filings and notes grow towards the end, short captions and comments fade.
SLOPES = {"filing_section": 0.4, "earnings_note": 0.2, "news_brief": -0.2, "trends_comment": -0.4, "chart_caption": -0.5}
TOLERANCE = 45


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each announcement with its nearest quarter record and the days between them."""
    said = once(table(spark, folder, "aapl_earnings", "earn_id", "symbol", "date"), "earn_id").select("earn_id", symbol_key(F.col("symbol")).alias("key"), F.unix_date(calendar_day(F.col("date"))).alias("at"))
    filed = quarter_records(spark, folder).select("inc_id", "key", F.unix_date("day").alias("until"))
    return nearest.nearest_in_time(said, filed, entity="key", left_id="earn_id", left_time="at", right_id="inc_id", right_time="until", tolerance=TOLERANCE)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pairs(spark, folder).select("earn_id", "inc_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents", "doc_id", "text"), id="doc_id", text="text")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose decoded ids aren't their text: none."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    back = tokens.decoded(tokens.token_ids(docs, id="doc_id", text="text"), id="doc_id", ids="ids").withColumnRenamed("text", "again")
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("again")).select("doc_id")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source and tokens of all documents with a source; written once, since the mixture reads it thrice."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source").where("source is not null")
    return cut(tokens.token_counts(docs, text="text", keep=["doc_id", "source"]))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_targets"), id="doc_id", source="source", size="n_tokens", slopes=SLOPES)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"), source="source", id="doc_id", size="n_tokens")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_texts(table(spark, folder, "documents", "doc_id", "text"), id="doc_id", text="text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    cuts = splitting.split_texts(table(spark, folder, "documents", "doc_id", "text"), id="doc_id", text="text", with_text=False)
    return cuts.where("piece_no = 2").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_pieces": p9_pieces}

_P1 = """
WITH said AS (SELECT DISTINCT earn_id, nullif(replace(upper(trim(symbol)), '.', '-'), '') AS k,
    CASE WHEN regexp_matches(trim(date), '^[0-9]{4}([-/]?)[0-9]{2}[-/]?[0-9]{2}([T ].*)?$') THEN try_cast(regexp_replace(trim(date), '^([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2}).*$', '\\1-\\2-\\3') AS DATE) END AS d FROM aapl_earnings),
filed AS (SELECT DISTINCT inc_id, nullif(replace(upper(trim(symbol)), '.', '-'), '') AS k,
    CASE WHEN regexp_matches(trim(date), '^[0-9]{4}([-/]?)[0-9]{2}[-/]?[0-9]{2}([T ].*)?$') THEN try_cast(regexp_replace(trim(date), '^([0-9]{4})[-/]?([0-9]{2})[-/]?([0-9]{2}).*$', '\\1-\\2-\\3') AS DATE) END AS u FROM aapl_income_quarter
    WHERE regexp_matches(lower(trim(period)), '^([0-9]{4}[-_ /]*)?(q(uarter|tr)?[ -]*[1-4]|[1-4][ -]*q(uarter|tr)?)([ -_/]*[0-9]{4})?$')),
p AS (SELECT earn_id, inc_id, abs(date_diff('day', d, u)) AS distance, row_number() OVER (PARTITION BY earn_id ORDER BY abs(date_diff('day', d, u)), u, inc_id) AS n
    FROM said JOIN filed USING (k) WHERE abs(date_diff('day', d, u)) <= 45)
"""
SQL = {"p1_found": _P1 + "SELECT earn_id, inc_id FROM p WHERE n = 1", "p1_pairs": _P1 + "SELECT earn_id, inc_id, CAST(distance AS BIGINT) AS distance FROM p WHERE n = 1"}
