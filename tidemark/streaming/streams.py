"""The same analytics over unbounded input with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.upsert import keep_last


def window_bars(stream: DataFrame, *, symbol: str, time: str, price: str, unit: str = "1 day", lateness: str = "2 days", slide: str | None = None) -> DataFrame:
    """Bars per symbol and tumbling window (or sliding, one every slide); a window comes out once the watermark has passed its end, so buckets in
    progress never show. Events later than lateness are dropped."""
    seq = F.struct(F.col(time), F.col(price))
    return stream.withWatermark(time, lateness).groupBy(F.col(symbol).alias("symbol"), F.window(time, unit, slide)).agg(F.min(seq)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(seq)[price].alias("close"), F.count("*").alias("n_events")).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n_events")


def sessions(stream: DataFrame, *, key: str, time: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    return stream.withWatermark(time, lateness).groupBy(F.col(key), F.session_window(time, gap)).agg(F.count("*").alias("n_events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def first_arrivals(stream: DataFrame, *, keys: Sequence[str], time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once; its state is forgotten behind the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def paired_runs(starts: DataFrame, ends: DataFrame, *, key: str, time: str, longest: str = "1 hour") -> DataFrame:
    """Starts with their ends by key; a start without an end within longest comes out with outcome 'crash'."""
    s = starts.select(F.col(key).alias("run"), F.col(time).alias("started")).withWatermark("started", longest)
    e = ends.select(F.col(key).alias("run_e"), F.col(time).alias("ended")).withWatermark("ended", longest)
    j = s.join(e, (F.col("run") == F.col("run_e")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {longest}")), "leftOuter")
    return j.select("run", "started", "ended", F.when(F.col("ended").isNull(), "crash").otherwise("done").alias("outcome"))


def running_ema(stream: DataFrame, *, key: str, time: str, value: str, n: int = 12) -> DataFrame:
    """(key, time, value, ema): the exponential average carried in state over the events of each key.

    Within a micro-batch a key's events are taken in order of time; the seed is the first value.
    """
    alpha = 2.0 / (n + 1)
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time, ignore_index=True)
        out = []
        for v in rows[value].astype(float):
            last = v if last is None else last + alpha * (v - last)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(rows), time: rows[time], value: rows[value], "ema": out})

    return stream.select(key, time, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}, {value} {kinds[value]}, ema double", "last double", "append", "NoTimeout")


def running_wilder(stream: DataFrame, *, key: str, time: str, value: str, n: int = 14) -> DataFrame:
    """(key, time, value, average): Wilder's average carried in state: the mean of the first n values, then each value
    moves it by 1/n; null before. Within a micro-batch a key's events are taken in order of time."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, total, last = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(time, ignore_index=True)
        out = []
        for v in rows[value].astype(float):
            seen += 1
            if seen <= n:
                total += v
                last = total / n
            else:
                last += (v - last) / n
            out.append(last if seen >= n else None)
        state.update((seen, total, last))
        yield pd.DataFrame({key: [k[0]] * len(rows), time: rows[time], value: rows[value], "average": pd.Series(out, dtype="float64")})

    return stream.select(key, time, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}, {value} {kinds[value]}, average double", "seen int, total double, last double", "append", "NoTimeout")


def polled_changes(path: str, *, by: str, kind: str, ref: str, day: str, status: str, today: str) -> Callable[[DataFrame, int], None]:
    """What to do with each poll of a calendar, for foreachBatch: the poll is compared with the stored snapshot, the
    changes are added to path/changes (with the batch and the day), and the merged snapshot becomes the next one.

    Snapshots are folders numbered by batch; a repeated batch compares with the same one as before and replaces its own
    results, so nothing is reported twice.
    """
    from tidemark.operators.joins import snapshot_diff
    from tidemark.operators.upsert import upsert

    columns = [by, kind, ref, day, status]

    def poll(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns)
        try:
            old = spark.read.schema(new.schema).parquet(f"{path}/snapshot/n={number - 1}") if number else new.limit(0)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = new.limit(0)
        slot = F.coalesce(F.nullif(F.trim(F.col(ref)), F.lit("")), F.col(day).cast("string"))
        diff = snapshot_diff(old, new, by=by, kind=kind, ref=ref, day=day, status=status, today=today)
        told = diff.where("change not in ('kept', 'unchanged')").withColumn("day", F.lit(today))
        told.write.mode("overwrite").parquet(f"{path}/changes/n={number}")
        # Entries that dropped or moved away leave the snapshot; null fields of the poll keep what is stored.
        gone = diff.where("change in ('dropped', 'moved')").select(by, kind, F.coalesce(F.nullif(F.trim(F.col(ref)), F.lit("")), F.col("old_day").cast("string")).alias("__slot")).distinct()
        kept = old.withColumn("__slot", slot).join(gone, [by, kind, "__slot"], "left_anti")
        upsert(kept, new.withColumn("__slot", slot), [by, kind, "__slot"]).select(*columns).write.mode("overwrite").parquet(f"{path}/snapshot/n={number}")

    return poll


LOG = "seq bigint, at string, query string, batch bigint"


def merge_into(stream: DataFrame, path: str, *, keys: Sequence[str], order: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep a Parquet table at path current: each micro-batch is merged by key, the greatest order wins.

    A new state is written beside the present one, then a line that names it, its batch and the streaming query is
    added to the table's log, which is what makes it current: readers never see a half-written state. A batch that
    was merged before a failure and comes again is known by query and number and left out; a new checkpoint is a new
    query, whose batches are merged whatever their numbers. A log that can't be read is an error, never an empty table.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        query = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        last = state(spark, path)
        if last and last["query"] == query and last["batch"] >= number:
            return
        seq = last["seq"] + 1 if last else 0
        at = f"{path}/state-{seq % 2}"
        both = spark.read.parquet(last["at"]).unionByName(batch, allowMissingColumns=True) if last else batch
        keep_last([both], list(keys), order).write.mode("overwrite").parquet(at)
        spark.createDataFrame([(seq, at, query, number)], LOG).coalesce(1).write.mode("append").json(f"{path}/log")
        if after:
            after(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str) -> dict | None:
    """The last line of the table's log, None before the first batch. Any other failure to read it is raised."""
    try:
        line = spark.read.schema(LOG).json(f"{path}/log").orderBy(F.col("seq").desc()).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return line.asDict() if line else None


def current(spark: SparkSession, path: str) -> str | None:
    """The folder with the table's state, None before the first batch."""
    last = state(spark, path)
    return last["at"] if last else None
