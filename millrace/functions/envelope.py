"""Success and error rows, and metadata, as columns.

An envelope is a DataFrame with payload columns and four more: ``_seq`` and ``_ts`` give the arrival order and the
clock reading at arrival, ``_err`` is null for a success and a struct for an error (the struct decides, not its
message), ``_meta`` is a map of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ, TS, ERR, META = "_seq", "_ts", "_err", "_meta"
ENVELOPE = (SEQ, TS, ERR, META)
#: Reserved metadata keys (fixed values).
WINDOW_START, WINDOW_END, WINDOW_TYPE, WINDOW_SIZE, WINDOW_SLIDE, WINDOW_GAP, SESSION_KEY = (
    "window_start", "window_end", "window_type", "window_size", "window_slide", "window_gap", "session_key")
SOURCE, TIMESTAMP, PROCESSOR, RETRY_COUNT, SESSION_ID, ROUTE = "source", "timestamp", "processor", "retry_count", "session_id", "route"
PARTITION_INDEX, PARTITION_TOTAL, PARTITION_STRATEGY = "partition_index", "partition_total", "partition_strategy"


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ENVELOPE]


def no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def error_struct(item: Column, message: Column, processor: str | Column, ts: Column) -> Column:
    processor = F.lit(processor) if isinstance(processor, str) else processor
    return F.struct(item.alias("item"), message.alias("message"), processor.alias("processor"), ts.cast("timestamp_ntz").alias("ts"))


def wrap(df: DataFrame, ts: str, seq: str, failed: Column | None = None, message: Column | str = "", processor: str = "source") -> DataFrame:
    """An envelope over ``df``: rows where ``failed`` holds are errors whose item is the row."""
    item = F.struct(*[F.col(c) for c in df.columns])
    message = F.lit(message) if isinstance(message, str) else message
    failed = F.lit(False) if failed is None else failed
    return df.withColumns({
        SEQ: F.col(seq), TS: F.col(ts), ERR: F.when(F.coalesce(failed, F.lit(False)), error_struct(item, message, processor, F.col(ts))), META: no_metadata()})


def is_error() -> Column:
    return F.col(ERR).isNotNull()


def is_success() -> Column:
    return F.col(ERR).isNull()


def value(c: str) -> Column:
    """The value of a success; evaluating it on an error raises."""
    return F.when(is_success(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("value of an error row: "), F.coalesce(F.col(ERR)["message"], F.lit("")))))


def value_or(c: str, fallback: Column) -> Column:
    """Value or fallback; a null success stays null."""
    return F.when(is_success(), F.col(c)).otherwise(fallback)


def map_value(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Transform successes; errors and metadata stay as they are."""
    return df.withColumns({c: F.when(is_success(), e).otherwise(F.col(c)) if c in df.columns else F.when(is_success(), e) for c, e in changes.items()})


def map_error(df: DataFrame, message: Column | None = None, processor: Column | None = None) -> DataFrame:
    """Transform errors; successes and metadata stay as they are."""
    e = F.col(ERR)
    if message is not None:
        e = e.withField("message", message)
    if processor is not None:
        e = e.withField("processor", processor)
    return df.withColumn(ERR, F.when(is_error(), e))


def error_text() -> Column:
    """``StreamError[processor]: message (item: ..., time: RFC 3339)``."""
    e = F.col(ERR)
    return F.format_string("StreamError[%s]: %s (item: %s, time: %s)", e["processor"], e["message"], e["item"].cast("string"),
                           F.date_format(e["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def with_metadata(df: DataFrame, entries: dict[str, Column]) -> DataFrame:
    """Add or overwrite metadata; empty keys are ignored and null values leave a key out."""
    entries = {k: v for k, v in entries.items() if k}
    if not entries:
        return df
    new = F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    old = F.map_filter(F.col(META), lambda k, _: ~k.isin(*entries))
    return df.withColumn(META, F.map_concat(old, new))


def get_metadata(key: str) -> Column:
    return F.col(META)[F.lit(key)]


def has_metadata() -> Column:
    return F.size(META) > 0


def metadata_keys() -> Column:
    """Keys in a stable order."""
    return F.sort_array(F.map_keys(META))


def typed_metadata(key: str, kind: str) -> Column:
    """``value``, ``found`` and ``wrong_type``: absent, there but of another type, or there (kinds: string, int, timestamp,
    duration, which is microseconds)."""
    raw = get_metadata(key)
    cast = raw if kind == "string" else raw.try_cast({"int": "bigint", "duration": "bigint", "timestamp": "timestamp_ntz"}[kind])
    return F.struct(cast.alias("value"), cast.isNotNull().alias("found"), (raw.isNotNull() & cast.isNull()).alias("wrong_type"))


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, read as UTC."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def in_window(t: Column) -> Column:
    """Whether ``t`` lies in the row's window: at its start or later, before its end."""
    return (t >= F.col(WINDOW_START)) & (t < F.col(WINDOW_END))


def window_duration() -> Column:
    """Microseconds from the row's window start to its end."""
    return micros(F.col(WINDOW_END)) - micros(F.col(WINDOW_START))


def valid_window() -> Column:
    """Whether the row has window bounds and a known window type."""
    return F.coalesce(F.col(WINDOW_START).isNotNull() & F.col(WINDOW_END).isNotNull() & F.col(WINDOW_TYPE).isin("tumbling", "sliding", "session"), F.lit(False))
