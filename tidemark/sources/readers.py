"""Readers: files of every kind the operators take, with explicit schemas where they are known.

No reader acts on its data; a missing path raises, unless the reader says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = "symbol string, date string, open double, high double, low double, close double, volume double, adjClose double"
EVENT = "type string, date string, status string, source string, source_url string, ref string, fetched_at string, note string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def bars_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars from JSON files that hold an array of bars or an object {symbol, historical: [...]} or {symbol, data: [...]}."""
    bar = f"struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in BAR.split(', '))}>"
    raw = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"array<{bar}>")
    wrapped = F.from_json("value", f"struct<symbol:string,historical:array<{bar}>,data:array<{bar}>>")
    rows = F.when(F.ltrim("value").startswith("["), plain).otherwise(F.coalesce(wrapped["historical"], wrapped["data"]))
    return raw.select(wrapped["symbol"].alias("__s"), F.posexplode(rows).alias("arrival", "b")).select(F.coalesce("b.symbol", "__s").alias("symbol"), "arrival", *[f"b.{x.split()[0]}" for x in BAR.split(", ")[1:]])


def records_json(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = False) -> DataFrame:
    """Records of JSON arrays (or of one object per line) under the schema; fields it lacks are not read."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One record per line; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_text(spark: SparkSession, path: str, columns: list[str], sep: str = ",", comment: str | None = None) -> DataFrame:
    """A CSV with header as text columns; a missing file gives an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def csv_fresh(spark: SparkSession, path: str, columns: list[str], max_age_days: float) -> DataFrame:
    """Rows of those CSV files that were written within max_age_days."""
    df = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).csv(path)
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("_metadata.file_modification_time")
    return df.where(age <= max_age_days * 86400).select(*columns)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The reader by the path's suffix: csv, tsv, json, jsonl, ndjson, parquet, orc, txt; others raise."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read.schema(schema) if schema and suffix != "txt" else spark.read
    if suffix in ("csv", "tsv"):
        return r.option("header", True).option("inferSchema", schema is None).option("sep", "\t" if suffix == "tsv" else ",").csv(path)
    if suffix in ("json", "jsonl", "ndjson"):
        return r.json(path, multiLine=suffix == "json")
    if suffix in ("parquet", "orc"):
        return r.format(suffix).load(path)
    if suffix == "txt":
        return spark.read.text(path)
    if suffix == "xml":
        raise ValueError("XML needs a row tag: use holdings_xml or spark.read.format('xml')")
    if suffix in ("xlsx", "xls"):
        return _sheet(spark, path)
    raise ValueError(f"no reader for .{suffix}")


def _sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, whose rows a workbook's own limit bounds; needs a library that reads workbooks."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path))
    except ImportError as e:
        raise ValueError(f"no reader for {path}: workbooks need openpyxl") from e


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(ticker): those with a document among the files, sorted; the names come from the files' paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")
    return files.select(F.upper(F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("ticker")).distinct().orderBy("ticker")


def dated_changes(spark: SparkSession, path: str, day: str, schema: str) -> DataFrame:
    """The change log of a day (path/day.json), without rows if nothing was written on it."""
    at = f"{path}/{day}.json"
    if not _exists(spark, at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(at, multiLine=True)


def arrow_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of Arrow files (stream or file form), one task a file; the paths must be readable on every executor."""
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with pa.memory_map(path) as f:
                    try:
                        t = pa.ipc.open_file(f).read_all()
                    except pa.ArrowInvalid:
                        f.seek(0)
                        t = pa.ipc.open_stream(f).read_all()
                yield from t.to_batches()

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(read, schema)


def event_documents(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON documents {ticker, events: [...]}, one row each; documents without events give none."""
    docs = spark.read.schema(f"ticker string, events array<struct<{', '.join(f'{x.split()[0]}:string' for x in EVENT.split(', '))}>>").json(path, multiLine=True)
    return docs.select("ticker", F.inline("events"))


def latest_partition(df: DataFrame, day: str) -> DataFrame:
    """The rows of the greatest day; on a partitioned table only that partition is read."""
    return df.where(F.col(day) == df.agg(F.max(day).alias("d")).select("d").scalar())


def zipped(df: DataFrame, arrays: Column, names: list[str], keep: list[str]) -> DataFrame:
    """Rows from parallel arrays in a struct of arrays: element i of each is row i; missing arrays and short ones give ''."""
    cells = F.arrays_zip(*[F.coalesce(arrays[n], F.array().cast("array<string>")).alias(n) for n in names])
    return df.select(*keep, F.posexplode(cells).alias("row_no", "r")).select(*keep, "row_no", *[F.coalesce(F.col("r")[str(n)], F.lit("")).alias(n) for n in names])


def holdings_xml(spark: SparkSession, path: str) -> DataFrame:
    """Lines of holdings information tables, whatever their namespace prefix is left at: one row per infoTable."""
    schema = "nameOfIssuer string, titleOfClass string, cusip string, value bigint, shrsOrPrnAmt struct<sshPrnamt:bigint, sshPrnamtType:string>, putCall string"
    df = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", True).schema(schema).load(path)
    return df.select(F.col("nameOfIssuer").alias("issuer"), F.col("titleOfClass").alias("class"), "cusip", "value", F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"), F.col("shrsOrPrnAmt.sshPrnamtType").alias("shtype"), F.col("putCall").alias("putcall"))


_FACT = r"<(dei):(\w+)\b([^>]*?)(?:/>|>([^<]*)</\1:\2\s*>)"
_CONTEXT = r"(?s)<(?:\w+:)?context\b[^>]*?\bid=\"([^\"]*)\"[^>]*>(.*?)</(?:\w+:)?context>"


def instance_facts(docs: DataFrame, *, id: str, xml: str) -> DataFrame:
    """(id, tag, value, context, member, period_end) of the dei facts of XBRL instances; nil facts are left out.

    Facts and contexts are two tables taken from the text, joined by context; member is null without a dimension.
    """
    facts = docs.select(id, F.explode(F.regexp_extract_all(xml, F.lit(_FACT), 0)).alias("f"))
    attrs = F.regexp_extract("f", _FACT, 3)
    facts = facts.where(~attrs.rlike(r'nil\s*=\s*"(?:true|1)"')).select(id, F.regexp_extract("f", _FACT, 2).alias("tag"), F.trim(F.regexp_extract("f", _FACT, 4)).alias("value"), F.regexp_extract(F.regexp_extract("f", _FACT, 3), r'contextRef\s*=\s*"([^"]*)"', 1).alias("context"))
    ctx = docs.select(id, F.explode(F.regexp_extract_all(xml, F.lit(_CONTEXT), 0)).alias("c"))
    body = F.regexp_extract("c", _CONTEXT, 2)
    ctx = ctx.select(id, F.regexp_extract("c", _CONTEXT, 1).alias("context"), F.nullif(F.trim(F.regexp_extract(body, r"explicitMember\b[^>]*>([^<]*)<", 1)), F.lit("")).alias("member"), F.nullif(F.regexp_extract(body, r"<(?:\w+:)?(?:endDate|instant)>\s*([^<\s]*)", 1), F.lit("")).alias("period_end"))
    return facts.join(ctx.groupBy(id, "context").agg(F.first("member").alias("member"), F.first("period_end").alias("period_end")), [id, "context"], "left").select(id, "tag", "value", "context", "member", "period_end")


def concept_facts(docs: DataFrame, *, id: str, json: str) -> DataFrame:
    """Facts of company-concept JSON: one row per unit and fact."""
    fact = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
    parsed = docs.select(id, F.from_json(json, f"struct<taxonomy:string,tag:string,units:map<string,array<{fact}>>>").alias("j"))
    units = parsed.select(id, "j.taxonomy", "j.tag", F.explode("j.units").alias("unit", "facts"))
    return units.select(id, "taxonomy", "tag", "unit", F.inline("facts"))


def front_matter(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Markdown files with a front-matter block: path, the fields as text, and the body."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    block = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    head = F.regexp_extract("v", block, 1)
    unquoted = lambda f: F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{f}:[ \t]*(.*)$", 1)), r"^([\"'])(.*)\1$", "$2")
    return raw.select("path", *[F.nullif(unquoted(f), F.lit("")).alias(f) for f in fields], F.when(head == "", F.col("v")).otherwise(F.regexp_extract("v", block, 2)).alias("body"))


def cached_fresh(df: DataFrame, *, fetched: str, window: str, partial: Column, now: Column, ttl_hours: float = 6.0) -> Column:
    """Whether a cached response may be used: a closed window of two dates without partial buckets always, others for
    ttl_hours after they were fetched."""
    closed = F.col(window).rlike(r"^\d{4}-\d{2}-\d{2} \d{4}-\d{2}-\d{2}$") & (F.to_date(F.substring(window, 12, 10)) < now.cast("date")) & ~F.coalesce(partial, F.lit(False))
    age = F.unix_seconds(now) - F.unix_seconds(F.col(fetched))
    return F.coalesce(closed | (age <= ttl_hours * 3600), F.lit(False))


def request_key(params: dict[str, Column]) -> Column:
    """Twenty hex digits that stand for a request's parameters, whatever their order."""
    body = F.to_json(F.struct(*[params[k].alias(k) for k in sorted(params)]))
    return F.substring(F.sha2(body, 256), 1, 20)
