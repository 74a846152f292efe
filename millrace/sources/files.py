"""Sources and sinks: tables as envelopes, bounded or streaming, and where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.envelope import ERR, META, is_error, payload, wrap

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """A bounded table of one of FORMATS."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """The same files as a stream; ``files_per_trigger`` is the back-pressure of a file source."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """A demonstration stream as an envelope: ``timestamp, value``."""
    return wrap(spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load(), "timestamp", "value")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as an envelope: events of type ``error`` are error rows."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return wrap(df, "ts", "event_id", failed=F.col("event_type") == "error", message="error event")


def place_in_files() -> Column:
    """The file of a row read from Parquet and its number there: what breaks ties the same way however the files are cut and
    whichever executor reads them. Files come by name."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def from_rows(spark: SparkSession, rows: list[tuple], schema: str, ts: str, seq: str, failed: Column | None = None, message: str = "failed") -> DataFrame:
    """A small envelope from Python rows."""
    return wrap(spark.createDataFrame(rows, schema), ts, seq, failed, message)


def write_split(df: DataFrame, good_path: str, bad_path: str, mode: str = "errorifexists") -> None:
    """Successes to one folder, errors to another."""
    df.filter(~is_error()).select(*payload(df)).write.mode(mode).parquet(good_path)
    df.filter(is_error()).select(ERR, META).write.mode(mode).parquet(bad_path)


def write_routes(df: DataFrame, path: str, column: str = "route", mode: str = "errorifexists") -> None:
    """One folder a route, so that readers of a route skip the others."""
    df.drop(META).write.mode(mode).partitionBy(column).parquet(path)
