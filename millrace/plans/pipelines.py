"""Composed pipelines: several operators from end to end."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.envelope import ERR, SEQ, TS, is_error, is_success, wrap
from millrace.operators.aggregate import by_count, by_time, sum_of
from millrace.operators.basic import enrich, filter_ok, mapper, sample_by_key
from millrace.operators.flow import batch, collect_batches, dedupe, flatten, number_successes, unbatch
from millrace.operators.route import fan_in, fan_out, partition_custom, partition_hash, router, split
from millrace.operators.window import collect_windows, tumbling
from millrace.sources.files import place_in_files, read_events

HOUR, DAY = 3_600_000_000, 86_400_000_000


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Operators in a row as one operator."""
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)


def window_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows with counts and the share of successes."""
    out = collect_windows(tumbling(read_events(spark, sf_dir), DAY))
    return out.withColumn("success_rate", F.round(F.col("success_count") / F.col("item_count"), 6))


def etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map, filter, look up, batch: batches of 50 large orders with their customers' segments, by segment."""
    orders = wrap(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_orderkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    big = filter_ok(orders, F.col("o_totalprice") > 100_000)
    found = enrich(big, customers, "o_custkey", "c_custkey", "no such customer")
    out = batch(found, 50, keys=["c_mktsegment"])
    return out.filter(is_success()).groupBy("c_mktsegment", "batch_id").agg(F.count("*").alias("n"), sum_of("o_totalprice").alias("total"), F.min(SEQ).alias("low_key"))


def analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, first event of each user, type and day, daily sums by type."""
    rows = sample_by_key(read_events(spark, sf_dir), 0.5, "event_id").filter(is_success())
    rows = dedupe(rows.withColumn("day", F.date_trunc("day", TS)), ["user_id", "event_type", "day"], None)
    return by_time(rows.drop("day"), DAY, {"total": sum_of("value")}, keys=["event_type"])


def multi_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for three aggregates: count by type, revenue of purchases, distinct users, all daily."""
    a, b, c = fan_out(read_events(spark, sf_dir), 3)
    counts = by_time(a, DAY, {}, keys=["event_type"]).select("start_ts", F.concat(F.lit("count:"), "event_type").alias("metric"), F.col("n").cast("double").alias("amount"))
    revenue = by_time(b.filter(F.col("event_type") == "purchase"), DAY, {"amount": sum_of("value")}).select("start_ts", F.lit("revenue").alias("metric"), "amount")
    users = by_time(c, DAY, {"amount": F.count_distinct("user_id").cast("double")}).select("start_ts", F.lit("users").alias("metric"), "amount")
    return fan_in(counts, revenue, users)


def group_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 10 events of each user, made flat again: every event with its batch and place."""
    rows = batch(read_events(spark, sf_dir), 10, keys=["user_id"])
    lists = collect_batches(rows, ["event_id", "value"], keys=["user_id"])
    return unbatch(lists, "items").select("user_id", "batch_id", "place", F.col("item.event_id").alias("event_id"), F.col("item.value").alias("value"))


def quality_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items split by discount, each side in count windows of 100 rows of a ship mode's flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Order key and line number are no key: lines that agree in both and in the date come as they stand in the files.
    items = wrap(lines.withColumn("line_id", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), place_in_files().alias("place"))), "l_shipdate", "line_id")
    high, low = split(items, F.col("l_discount") >= 0.05)
    sums = {"quantity": F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")}
    a = by_count(high, 100, sums, keys=["l_returnflag"]).withColumn("side", F.lit("high"))
    b = by_count(low, 100, sums, keys=["l_returnflag"]).withColumn("side", F.lit("low"))
    return fan_in(a, b).select("side", "l_returnflag", "emission", "n", "quantity")


def fan_in_batch_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers merged, batched by 25 of a nation, on two branches."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("source"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("source"))
    rows = fan_in(*[d.withColumns({"at": F.timestamp_micros(F.col("key")).cast("timestamp_ntz"), "order_id": F.col("key") * 2 + F.col("source")}) for d in (c, s)])
    rows = wrap(rows, "at", "order_id", failed=F.col("balance") < 0, message="negative balance")
    a, b = fan_out(batch(rows, 25, keys=["nation"]), 2)
    sums = lambda d, i: d.filter(is_success()).groupBy("nation", "batch_id").agg(F.count("*").alias("n"), sum_of("balance").alias("total")).withColumn("branch", F.lit(i))
    return fan_in(sums(a, 0), sums(b, 1))


def recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan out to three branches, recombine two: counts of successes and errors."""
    branches = fan_out(read_events(spark, sf_dir), 3)
    both = fan_in(branches[0], branches[1])
    return both.groupBy("event_type").agg(F.count_if(is_success()).alias("good"), F.count_if(is_error()).alias("bad"))


def multi_stage_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders routed by status, then open ones by price."""
    orders = wrap(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_orderkey")
    first = router(orders, {"open": F.col("o_orderstatus") == "O", "done": F.col("o_orderstatus") == "F"}, default="other")
    second = router(first.filter(F.col("route") == "open").withColumnRenamed("route", "stage1"), {"large": F.col("o_totalprice") > 200_000, "medium": F.col("o_totalprice") > 50_000}, default="small")
    rest = first.filter(F.col("route") != "open").select(F.col("route").alias("stage1"), F.lit("-").alias("stage2"))
    return fan_in(second.select("stage1", F.col("route").alias("stage2")), rest).groupBy("stage1", "stage2").agg(F.count("*").alias("n"))


def keyed_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to 10 partitions by user; in each, every user's running number."""
    rows = partition_hash(read_events(spark, sf_dir), "user_id", 10)
    return number_successes(rows, ["user_id"]).filter(is_success()).select("event_id", "partition_index", F.col("_n").alias("nth_of_user"))


def geographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to the region of their nation."""
    customers = wrap(spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("at", F.timestamp_micros("c_custkey").cast("timestamp_ntz")), "at", "c_custkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")  # 25 rows
    rows = partition_custom(enrich(customers, nations, "c_nationkey", "n_nationkey", "no such nation", small=True), F.col("n_regionkey"), 5)
    return rows.groupBy("partition_index").agg(F.count("*").alias("n"), sum_of("c_acctbal").alias("balance"))


def filter_map_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even event ids, doubled, in batches of 50 over all events."""
    rows = filter_ok(read_events(spark, sf_dir), F.col("event_id") % 2 == 0)
    rows = mapper(rows, {"doubled": F.col("event_id") * 2})
    return batch(rows, 50).filter(is_success()).groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("doubled").alias("total"))


def enrich_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams merged, each value times 100; errors stay errors."""
    rows = read_events(spark, sf_dir)
    merged = fan_in(rows.filter(F.col("user_id") % 2 == 0), rows.filter(F.col("user_id") % 2 == 1))
    out = mapper(merged, {"id": F.col("event_id"), "scaled": F.round(F.col("value") * 100).cast("long")})
    return out.agg(F.count_if(is_success()).alias("good"), F.count_if(F.col(ERR).isNotNull()).alias("bad"), F.sum("scaled").alias("total"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of arrays made flat by one level, then row by row."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("v"), F.lit(2)), lambda i: F.slice("v", i, F.lit(2)))
    rows = flatten(rows.filter(F.size("v") > 0).withColumn("v", pairs), "v")
    return unbatch(rows, "v", "x").select("vec_id", "place", F.round(F.col("x").cast("double"), 5).alias("x"))
