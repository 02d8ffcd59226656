"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session for tests and the benchmark. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a session on one machine (tests, the benchmark) is given a folder of its own, which
    goes when the process ends; on a cluster, whose executors couldn't see it, an error is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir isn't set: with master {master!r} it must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application: its cut tables and nothing else."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{spark.conf.get('spark.app.id', 'none')}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read from there: a plan that uses it several times
    computes it once, readers take only the columns they need, and a lost executor costs nothing that lies before.

    The write is a job at once. The tables belong to the application; it drops them with clear() when the results
    that read them have been written.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Drop all cut tables of this application; whether there were any. Results not yet written can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
