"""Writers. Big results go to partitioned files; only bounded rows ever reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: to_json_document refuses more rows than this.
MOST_ROWS = 10_000


def to_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with header, columns in the order given, replacing what was there."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; only the partitions that df has rows for are replaced. Rows of a partition are gathered
    before the write, so it gets few files."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, added to the folder."""
    df.write.mode("append").json(path)


def ranked_text(df: DataFrame, path: str, rank: str, text: str) -> None:
    """One folder of text per rank."""
    df.select(F.col(rank), F.col(text).alias("value")).write.mode("overwrite").partitionBy(rank).text(path)


def to_json_document(df: DataFrame, meta: dict | None = None) -> str:
    """A small result as one JSON document {meta, columns, rows}; more than MOST_ROWS rows raise an error."""
    rows = df.limit(MOST_ROWS + 1).toJSON().collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write them to a table instead")
    return json.dumps({"meta": meta or {}, "columns": df.columns, "rows": [json.loads(r) for r in rows]}, ensure_ascii=False)


def ranked_csv(df: DataFrame, path: str, order: list, columns: list[str], percents: list[str] = ()) -> None:
    """A report as CSV: rank by order in front, then the columns, percents as text with two decimals. The rows of a report
    are few enough for one file."""
    from pyspark.sql import Window

    d = df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
    d = d.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double"))) for c in percents})
    to_csv(d.orderBy("rank"), path, ["rank", *columns], one_file=True)


def csv_text(df: DataFrame, columns: list[str]) -> str:
    """A small result as CSV text with header; more than MOST_ROWS rows raise an error."""
    import csv
    import io

    rows = df.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write them to a table instead")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if x is None else x for x in r] for r in rows])
    return out.getvalue()


def chart_document(points: DataFrame, *, title: str, category: str, series: str, value: str, kind: str = "column", unit: str = "", currency: str = "", axis: str = "category") -> str:
    """A chart contract as JSON: categories in order, each series' values by category (null where it has none)."""
    rows = points.select(F.col(category).cast("string").alias("c"), F.col(series).cast("string").alias("s"), F.col(value).cast("double").alias("v")).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} points in one chart")
    categories, names = sorted({r.c for r in rows if r.c is not None}), sorted({r.s for r in rows if r.s is not None})
    cells = {(r.s, r.c): r.v for r in rows}
    lines = [{"name": n, "kind": kind, "yAxis": "v", "data": [cells.get((n, c)) for c in categories]} for n in names]
    return json.dumps({"title": title, "axis": {"type": axis, "categories": categories}, "yAxes": [{"id": "v", "unit": unit, "currency": currency}], "series": lines}, ensure_ascii=False)


def markdown_table(df: DataFrame, columns: list[str], most: int = 25) -> str:
    """The first rows of a report as a Markdown table, with a line that tells how many more there are."""
    rows, n = df.select(*columns).limit(most).collect(), df.count()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)]
    return "\n".join(lines + ([f"... {n - most} more"] if n > most else []))


def empty_table(spark, path: str, columns: list[str]) -> None:
    """A new CSV table with a header and no rows; an existing one is never overwritten."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(path)
    to_csv(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)), path, columns)


def to_arrow(df: DataFrame, folder: str) -> None:
    """Arrow files, one a partition, each written by the task that holds it. The folder must be one that all executors
    and the reader share."""
    import pyarrow as pa

    schema = df.limit(0).toArrow().schema

    def write(batches):
        import os
        import uuid

        batches = list(batches)
        if batches:
            os.makedirs(folder, exist_ok=True)
            name = os.path.join(folder, f"part-{uuid.uuid4().hex}.arrow")
            with pa.OSFile(name + ".tmp", "wb") as f, pa.ipc.new_file(f, schema) as out:
                for b in batches:
                    out.write_batch(pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(b.columns, schema)], schema=schema))
            os.replace(name + ".tmp", name)
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches)]})

    df.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
