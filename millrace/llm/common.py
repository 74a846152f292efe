"""Shared plumbing of the training-data operators: shared-folder tables and column helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.shipping import ship_package

MAX_BATCH_ROWS = 500
#: Spark's setting that deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, or, where it is unset and Spark runs in one
    process (as in tests), a fresh temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for ``path``, whatever its store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


class Table:
    """A DataFrame written once as Parquet in the shared folder: lineage ends there, and losing an executor loses
    nothing. ``drop()`` deletes it as soon as no later plan reads it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_table_path(self.spark, name)
        schema = df.schema
        old = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # the exchanges of the plan end with it: nothing reads them again
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, old)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        fs, p = hadoop_path(self.spark, self.path)
        fs.delete(p, True)


def prepare(spark: SparkSession) -> None:
    """Before Python code runs on executors: ship the package, and keep Arrow batches of whole texts small (the session's
    limit of rows a batch is lowered to MAX_BATCH_ROWS; it changes no result)."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > MAX_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_BATCH_ROWS))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
