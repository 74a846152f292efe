"""The registered queries of the stream operators, with an equivalent SQL text for each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import envelope as E
from millrace.functions.envelope import ERR, is_error, is_success, wrap
from millrace.operators import aggregate as A
from millrace.operators import basic as B
from millrace.operators import flow as L
from millrace.operators import panes as N
from millrace.operators import resilience as S
from millrace.operators import route as R
from millrace.operators import window as W
from millrace.sources.files import read_events

from . import pipelines as P

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000

#: SQL of the event envelope, in the order of arrival.
EV = "e AS (SELECT *, event_type <> 'error' AS ok, epoch_us(ts) AS us FROM events)"
#: FNV-1a in SQL, over a list of numbers: basis, prime and modulus are the algorithm's fixed values.
FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {bytes}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
LONG_BYTES = "list_transform(range(0, 8), lambda i: ((({k}) >> (8 * i)) & 255)::HUGEINT)"
TEXT_BYTES = "list_transform(range(1, length({k}) + 1), lambda i: ord({k}[i])::HUGEINT)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_events(spark, d)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return wrap(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_orderkey")


# Results: values, errors, metadata.


@query("SELECT count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS error_count FROM events")
def result_partition_counts(spark, d):
    return events(spark, d).agg(F.count_if(is_success()).alias("success_count"), F.count_if(is_error()).alias("error_count"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN value ELSE -1.0 END AS v FROM events")
def result_value_or(spark, d):
    return events(spark, d).select("event_id", E.value_or("value", F.lit(-1.0)).alias("v"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN value * 2 ELSE value END AS value FROM events")
def result_map(spark, d):
    return E.map_value(events(spark, d), {"value": F.col("value") * 2}).select("event_id", "value")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'wrapped: error event' END AS message, CASE WHEN event_type = 'error' THEN 'source' END AS processor FROM events")
def result_map_error(spark, d):
    out = E.map_error(events(spark, d), message=F.concat(F.lit("wrapped: "), F.col(ERR)["message"]))
    return out.select("event_id", F.col(ERR)["message"].alias("message"), F.col(ERR)["processor"].alias("processor"))


@query("SELECT event_id, 'StreamError[source]: error event (item: ' || event_id || ', time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ')' AS text FROM events WHERE event_type = 'error'")
def error_format(spark, d):
    df = events(spark, d).filter(is_error())
    df = df.withColumn(ERR, F.col(ERR).withField("item", F.col(ERR)["item"]["event_id"].cast("string")))
    return df.select("event_id", E.error_text().alias("text"))


@query("""SELECT event_id, 'api' AS source, CASE WHEN event_type = 'click' THEN 'none' ELSE 'retry_count' END AS second_key, event_id % 3 AS retries,
  event_type <> 'click' AS found, FALSE AS wrong_type, TRUE AS has_any FROM events WHERE event_type <> 'click'
  UNION ALL SELECT event_id, 'api', 'none', NULL, FALSE, FALSE, TRUE FROM events WHERE event_type = 'click'""")
def metadata_with_get(spark, d):
    df = E.with_metadata(events(spark, d), {"source": F.lit("api"), "": F.lit("ignored")})
    df = E.with_metadata(df, {"retry_count": F.when(F.col("event_type") != "click", F.col("event_id") % 3)})
    n = E.typed_metadata("retry_count", "int")
    return df.select("event_id", E.get_metadata("source").alias("source"), F.coalesce(F.get(F.filter(E.metadata_keys(), lambda k: k != "source"), F.lit(0)), F.lit("none")).alias("second_key"),
                     n["value"].alias("retries"), n["found"].alias("found"), n["wrong_type"].alias("wrong_type"), E.has_metadata().alias("has_any"))


@query(f"""WITH {EV} SELECT event_id, 86400000000::BIGINT AS duration, TRUE AS inside, (us + 86400000000) < (us - us % 86400000000 + 86400000000) AS later_inside, TRUE AS valid FROM e""")
def window_info_checks(spark, d):
    df = W.tumbling(events(spark, d), DAY)
    return df.select("event_id", E.window_duration().alias("duration"), E.in_window(F.col("_ts")).alias("inside"),
                     E.in_window(F.col("_ts") + F.expr("interval 1 day")).alias("later_inside"), E.valid_window().alias("valid"))


# One to one.


@query("""SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS kind, CASE WHEN event_type <> 'error' THEN value * 2 END AS doubled,
  event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 'doubler' END AS processor FROM events""")
def mapper_project(spark, d):
    out = B.mapper(events(spark, d), {"kind": F.upper("event_type"), "doubled": F.col("value") * 2}, name="doubler")
    return out.select(F.col("_seq").alias("id"), "kind", "doubled", is_error().alias("failed"), F.col(ERR)["processor"].alias("processor"))


@query("""WITH p AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
  SELECT event_id AS id, CASE WHEN event_type <> 'error' AND k >= 10 THEN k END AS k,
  CASE WHEN event_type = 'error' THEN 'error event' WHEN k < 10 THEN 'k too small' END AS message FROM p""")
def mapper_fallible(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    out = B.mapper(events(spark, d), {"k": k}, fails=k < 10, message=F.lit("k too small"), name="parse")
    return out.select(F.col("_seq").alias("id"), "k", F.col(ERR)["message"].alias("message"))


ENRICH = """SELECT o_orderkey AS id, c_mktsegment AS segment, CASE WHEN c_custkey IS NULL THEN 'no such customer' END AS message
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey"""


@query(ENRICH)
def async_mapper_enrich(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").filter("c_nationkey < 20").select("c_custkey", "c_mktsegment")
    out = B.enrich(orders(spark, d), customers, "o_custkey", "c_custkey", "no such customer")
    return out.select(F.col("_seq").alias("id"), F.col("c_mktsegment").alias("segment"), F.col(ERR)["message"].alias("message"))


def _square(pdf: pd.DataFrame) -> pd.DataFrame:
    k = pdf["user_id"]
    return pd.DataFrame({"square": (k * k).where(k % 7 != 0), "_message": pd.Series("multiple of seven", index=pdf.index).where(k % 7 == 0, None)}, index=pdf.index)


SQUARES = """SELECT event_id AS id, CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN user_id * user_id END AS square,
  CASE WHEN event_type = 'error' THEN 'error event' WHEN user_id % 7 = 0 THEN 'multiple of seven' END AS message FROM events"""


@query(SQUARES)
def async_mapper_ordered(spark, d):
    out = B.async_mapper(events(spark, d), _square, "square bigint", ordered=True)
    return out.select(F.col("_seq").alias("id"), "square", F.col(ERR)["message"].alias("message"))


@query(SQUARES)
def async_mapper_unordered(spark, d):
    out = B.async_mapper(events(spark, d), _square, "square bigint", ordered=False, workers=4)
    return out.select(F.col("_seq").alias("id"), "square", F.col(ERR)["message"].alias("message"))


@query("SELECT event_id, value, CASE WHEN event_type = 'error' THEN 'over50' END AS processor FROM events WHERE event_type = 'error' OR value > 50")
def filter_pred(spark, d):
    return B.filter_ok(events(spark, d), F.col("value") > 50, name="over50").select("event_id", "value", F.col(ERR)["processor"].alias("processor"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events")
def tap_metrics(spark, d):
    df, seen = B.tap(events(spark, d), {"n": F.count("*"), "good": F.count_if(is_success()), "bad": F.count_if(is_error()), "total": A.sum_of("value")}, name="tap_metrics")
    df.write.format("noop").mode("overwrite").save()
    m = seen.get
    return spark.createDataFrame([(m["n"], m["good"], m["bad"], m["total"])], "n long, good long, bad long, total double")


@query(f"SELECT event_id, event_type FROM events WHERE event_type = 'error' OR {FNV.format(bytes=LONG_BYTES.format(k='event_id'))} % 1000 < 300")
def sample_hash(spark, d):
    return B.sample_by_key(events(spark, d), 0.3, "event_id").select("event_id", "event_type")


@query()
def sample_rand(spark, d):
    return B.sample(events(spark, d), 0.3, seed=11).select("event_id", "event_type")


@query("SELECT event_id, user_id, event_type, value FROM events")
def buffer_identity(spark, d):
    return B.buffer(events(spark, d), 1000).select("event_id", "user_id", "event_type", "value")


# Flow.


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM e WHERE ok)
  SELECT event_type, CAST(rn // 100 + 1 AS BIGINT) AS batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY ALL""")
def batcher_size(spark, d):
    out = L.batch(events(spark, d), 100, keys=["event_type"]).filter(is_success())
    return out.groupBy("event_type", "batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM e WHERE ok)
  SELECT CAST(rn // 64 + 1 AS BIGINT) AS batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY ALL""")
def batcher_size_global(spark, d):
    out = L.batch(events(spark, d), 64).filter(is_success())
    return out.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


GREEDY_BATCH = f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e WHERE ok),
  r AS (SELECT user_id, event_id, us, value, rn, 1::BIGINT AS batch_id, 1 AS c, us AS t0 FROM n WHERE rn = 1
    UNION ALL SELECT n.user_id, n.event_id, n.us, n.value, n.rn, CASE WHEN r.c >= 5 OR n.us - r.t0 >= 21600000000 THEN r.batch_id + 1 ELSE r.batch_id END,
      CASE WHEN r.c >= 5 OR n.us - r.t0 >= 21600000000 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c >= 5 OR n.us - r.t0 >= 21600000000 THEN n.us ELSE r.t0 END
    FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)"""


@query(GREEDY_BATCH + " SELECT user_id, batch_id, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL")
def batcher_size_latency(spark, d):
    out = L.batch(events(spark, d), 5, 6 * HOUR, ["user_id"]).filter(is_success())
    return out.groupBy("user_id", "batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


#: SQL of the starts of a greedy chain over all successes: from one to the next by time, or by count.
CHAIN = """WITH RECURSIVE {ev}, n AS (SELECT event_id, us, row_number() OVER (ORDER BY ts, event_id) AS rn FROM e WHERE ok),
  r AS (SELECT rn, us FROM n WHERE rn = 1 UNION ALL SELECT min(n.rn), min(n.us) FROM r, n WHERE n.us >= r.us + {wait} OR n.rn = r.rn + {size} HAVING count(*) > 0)"""


@query(CHAIN.format(ev=EV, wait=2 * HOUR, size=40) + """, b AS (SELECT rn, row_number() OVER (ORDER BY rn) AS batch_id, coalesce(lead(rn) OVER (ORDER BY rn), (SELECT count(*) + 1 FROM n)) - rn AS n FROM r)
  SELECT batch_id, b.n, event_id AS first_id FROM b JOIN n ON b.rn = n.rn""")
def batcher_latency_global(spark, d):
    out = L.batch(events(spark, d), 40, 2 * HOUR).filter(is_success())
    return out.groupBy("batch_id").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("_ts", "_seq")).alias("first_id"))


def _greedy(keys: str, wait: int) -> str:
    """SQL of the rows at least ``wait`` after the last one kept."""
    on = " AND ".join(f"n.{k} = r.{k}" for k in keys.split(", "))
    cols = ", ".join(f"n.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {EV}, n AS (SELECT {keys}, event_id, us, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM e WHERE ok),
  r AS (SELECT {keys}, event_id, rn, us AS last, TRUE AS keep FROM n WHERE rn = 1
    UNION ALL SELECT {cols}, n.event_id, n.rn, CASE WHEN n.us - r.last >= {wait} THEN n.us ELSE r.last END, n.us - r.last >= {wait} FROM r JOIN n ON {on} AND n.rn = r.rn + 1)
  SELECT event_id, FALSE AS failed FROM r WHERE keep UNION ALL SELECT event_id, TRUE FROM e WHERE NOT ok"""


@query(_greedy("user_id", DAY))
def throttle_keyed(spark, d):
    return L.throttle(events(spark, d), DAY, ["user_id"]).select("event_id", is_error().alias("failed"))


@query(CHAIN.format(ev=EV, wait=HOUR, size="NULL") + " SELECT event_id, FALSE AS failed FROM n SEMI JOIN r ON n.rn = r.rn UNION ALL SELECT event_id, TRUE FROM e WHERE NOT ok")
def throttle_global(spark, d):
    return L.throttle(events(spark, d), HOUR).select("event_id", is_error().alias("failed"))


@query("SELECT event_id, event_type = 'error' AS failed FROM events")
def throttle_zero(spark, d):
    return L.throttle(events(spark, d), 0).select("event_id", is_error().alias("failed"))


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e WHERE ok),
  r AS (SELECT user_id, event_id, rn, us AS last, 3 * 43200000000::BIGINT - 43200000000 AS tokens, TRUE AS keep FROM n WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, us, t - CASE WHEN t >= 43200000000 THEN 43200000000 ELSE 0 END, t >= 43200000000 FROM
      (SELECT n.user_id, n.event_id, n.rn, n.us, least(3 * 43200000000, r.tokens + n.us - r.last) AS t FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1))
  SELECT event_id FROM r WHERE keep""")
def token_bucket(spark, d):
    return L.token_bucket(events(spark, d), 12 * HOUR, 3, ["user_id"]).filter(is_success()).select("event_id")


@query(f"""WITH {EV}, n AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM e WHERE ok)
  SELECT event_id, ts + INTERVAL 6 HOUR AS emitted_at FROM n WHERE nxt IS NULL OR nxt - us >= 21600000000 UNION ALL SELECT event_id, NULL FROM e WHERE NOT ok""")
def debounce_keyed(spark, d):
    return L.debounce(events(spark, d), 6 * HOUR, ["user_id"]).select("event_id", "emitted_at")


@query(f"""WITH {EV}, n AS (SELECT *, lead(us) OVER (ORDER BY ts, event_id) AS nxt FROM e WHERE ok)
  SELECT event_id, ts + INTERVAL 10 MINUTE AS emitted_at FROM n WHERE nxt IS NULL OR nxt - us >= 600000000 UNION ALL SELECT event_id, NULL FROM e WHERE NOT ok""")
def debounce_global(spark, d):
    return L.debounce(events(spark, d), 10 * MINUTE).select("event_id", "emitted_at")


@query("""WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events WHERE event_type <> 'error')
  SELECT event_type, event_id, CAST(rn // 7 AS BIGINT) AS chunk_id, CAST(rn % 7 AS BIGINT) AS chunk_place FROM n""")
def chunk(spark, d):
    return L.chunk(events(spark, d), 7, ["event_type"]).filter(is_success()).select("event_type", "event_id", "chunk_id", "chunk_place")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events WHERE event_type <> 'error')
  SELECT user_id, CAST(rn // 10 + 1 AS BIGINT) AS batch_id, CAST(rn % 10 AS INTEGER) AS place, event_id FROM n""")
def unbatch(spark, d):
    rows = L.collect_batches(L.batch(events(spark, d), 10, keys=["user_id"]), ["event_id"], ["user_id"])
    return L.unbatch(rows, "items").select("user_id", "batch_id", "place", F.col("item.event_id").alias("event_id"))


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS place, round(CAST(embedding[i] AS DOUBLE), 5) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def flatten(spark, d):
    return P.nested(spark, d)


@query("(SELECT event_id, FALSE AS failed FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 500) UNION ALL SELECT event_id, TRUE FROM events WHERE event_type = 'error'")
def take(spark, d):
    return L.take(events(spark, d), 500).select("event_id", is_error().alias("failed"))


NUMBERED = "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'error') SELECT event_id, FALSE AS failed FROM n WHERE {where} UNION ALL SELECT event_id, TRUE FROM events WHERE event_type = 'error'"


@query(NUMBERED.format(where="rn > 700"))
def skip(spark, d):
    return L.skip(events(spark, d), 700).select("event_id", is_error().alias("failed"))


@query(NUMBERED.format(where="rn > 200 AND rn <= 300"))
def paginate(spark, d):
    return L.paginate(events(spark, d), 200, 100).select("event_id", is_error().alias("failed"))


@query("""SELECT event_id, event_type FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
  UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'""")
def dedupe_first(spark, d):
    return L.dedupe(events(spark, d), ["user_id", "event_type"], None).select("event_id", "event_type")


@query(_greedy("user_id, event_type", 6 * HOUR))
def dedupe_ttl(spark, d):
    return L.dedupe(events(spark, d), ["user_id", "event_type"], 6 * HOUR).select("event_id", is_error().alias("failed"))


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT event_type, event_id, us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM e WHERE ok),
  r AS (SELECT event_type, rn, us FROM n WHERE rn = 1 UNION ALL SELECT r.event_type, min(n.rn), min(n.us) FROM r JOIN n ON n.event_type = r.event_type AND n.us >= r.us + 21600000000 GROUP BY r.event_type)
  SELECT event_id, FALSE AS failed FROM n SEMI JOIN r ON n.event_type = r.event_type AND n.rn = r.rn UNION ALL SELECT event_id, TRUE FROM e WHERE NOT ok""")
def dedupe_ttl_hot(spark, d):
    """A handful of keys with all rows."""
    return L.dedupe(events(spark, d), ["event_type"], 6 * HOUR, ranges=16).select("event_id", is_error().alias("failed"))


@query("SELECT count(DISTINCT (user_id, event_type)) AS unique_count, count(*) - count(DISTINCT (user_id, event_type)) AS duplicate_count FROM events WHERE event_type <> 'error'")
def dedupe_stats(spark, d):
    df = events(spark, d)
    return L.statistics(df, L.dedupe(df, ["user_id", "event_type"], None))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type <> 'error')
  SELECT event_id, greatest(c - 20, 0) AS dropped_count FROM n WHERE rn <= 20""")
def dropping_buffer(spark, d):
    return L.dropping_buffer(events(spark, d), 20, ["user_id"]).filter(is_success()).select("event_id", "dropped_count")


@query("""SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w, 4) AS moving_average, count(*) OVER w AS held FROM events WHERE event_type <> 'error'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def sliding_buffer_avg(spark, d):
    out = L.sliding_buffer(events(spark, d), 5, {"s": F.sum(F.col("value").cast("decimal(18,2)")), "held": F.count("*")}, ["user_id"])
    return out.filter(is_success()).select("event_id", F.round(F.col("s").cast("double") / F.col("held"), 4).alias("moving_average"), "held")


# Routing.


@query("SELECT c_custkey AS key, c_name AS name, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def fan_in_union(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return R.fan_in(c, s)


@query("SELECT CAST(b AS INTEGER) AS branch, event_id FROM events, (SELECT unnest(range(0, 3)) AS b)")
def fan_out_dup(spark, d):
    return R.fan_out_long(events(spark, d), 3).select("branch", "event_id")


def _partition(key: str, n: int) -> str:
    return f"CAST(CASE WHEN event_type = 'error' THEN 0 ELSE {FNV.format(bytes=key)} % {n} END AS INTEGER)"


@query(f"SELECT event_id, {_partition(LONG_BYTES.format(k='user_id'), 4)} AS partition_index, CASE WHEN event_type = 'error' THEN 'error' ELSE 'hash' END AS strategy, '4' AS total FROM events")
def partition_hash(spark, d):
    return R.partition_hash(events(spark, d), "user_id", 4).select(
        "event_id", "partition_index", E.get_metadata(E.PARTITION_STRATEGY).alias("strategy"), E.get_metadata(E.PARTITION_TOTAL).alias("total"))


@query(f"SELECT event_id, {_partition(TEXT_BYTES.format(k='event_type'), 7)} AS partition_index FROM events")
def partition_hash_text(spark, d):
    return R.partition_hash(events(spark, d), "event_type", 7).select("event_id", "partition_index")


@query("""SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 5 AS INTEGER) AS partition_index FROM events WHERE event_type <> 'error'
  UNION ALL SELECT event_id, 0 FROM events WHERE event_type = 'error'""")
def partition_rr(spark, d):
    return R.partition_round_robin(events(spark, d), 5).select("event_id", "partition_index")


@query("SELECT event_id, CAST(CASE WHEN event_type = 'error' OR user_id % 9 > 5 THEN 0 ELSE user_id % 9 END AS INTEGER) AS partition_index FROM events")
def partition_custom(spark, d):
    return R.partition_custom(events(spark, d), F.col("user_id") % 9, 6).select("event_id", "partition_index")


@query(f"""WITH p AS (SELECT {_partition(LONG_BYTES.format(k='user_id'), 4)} AS partition_index FROM events)
  SELECT partition_index, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1""")
def partition_stats(spark, d):
    return R.partition_stats(R.partition_hash(events(spark, d), "user_id", 4))


@query(f"""WITH p AS (SELECT {_partition(LONG_BYTES.format(k='user_id'), 4)} AS partition_index FROM events),
  c AS (SELECT i, count(partition_index) AS n FROM (SELECT unnest(range(0, 4)) AS i) LEFT JOIN p ON partition_index = i GROUP BY i)
  SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, round(stddev_pop(n) / avg(n), 6) AS balance FROM c""")
def partition_balance(spark, d):
    return R.partition_balance(R.partition_hash(events(spark, d), "user_id", 4), 4)


CASES = "CASE WHEN o_totalprice > 250000 THEN 'high_value' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'standard' END"


def _switch(default: str | None) -> R.Switch:
    key = F.when(F.col("o_totalprice") > 250_000, "high_value").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("standard")
    s = R.Switch(key, default=default).add_route("high_value").add_route("urgent")
    return s.add_route("fallback") if default else s


@query(f"SELECT o_orderkey, {CASES} AS route, 'switch' AS processor FROM orders WHERE {CASES} <> 'standard'")
def switch_route(spark, d):
    return _switch(None).process(orders(spark, d)).select("o_orderkey", "route", E.get_metadata("processor").alias("processor"))


@query(f"SELECT o_orderkey, CASE WHEN {CASES} = 'standard' THEN 'fallback' ELSE {CASES} END AS route FROM orders")
def switch_default(spark, d):
    return _switch("fallback").process(orders(spark, d)).select("o_orderkey", "route")


@query(f"SELECT CASE WHEN {CASES} = 'standard' THEN 'fallback' ELSE {CASES} END AS route, count(*) AS n FROM orders GROUP BY 1")
def switch_stats(spark, d):
    return R.route_stats(_switch("fallback").process(orders(spark, d)))


@query("SELECT event_id, value FROM events WHERE event_type <> 'error'")
def dlq_success(spark, d):
    return R.dead_letter(events(spark, d))[0].select("event_id", "value")


@query("SELECT event_id, 'error event' AS error, ts AS timestamp, 1 AS attempts FROM events WHERE event_type = 'error'")
def dlq_failure(spark, d):
    return R.dead_letter_items(events(spark, d)).select(F.col("item.event_id").alias("event_id"), "error", "timestamp", "attempts")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND value >= 60")
def split_true(spark, d):
    return R.split(events(spark, d), F.col("value") >= 60)[0].select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value < 60")
def split_false(spark, d):
    return R.split(events(spark, d), F.col("value") >= 60)[1].select("event_id")


@query("SELECT count(*) FILTER (value >= 60) AS true_count, count(*) FILTER (value < 60) AS false_count, round(avg(CAST(value >= 60 AS INTEGER)), 6) AS true_ratio FROM events WHERE event_type <> 'error'")
def split_stats(spark, d):
    return R.split_stats(events(spark, d), F.col("value") >= 60)


def _routes() -> dict:
    return {"big": F.col("value") > 90, "even_user": F.col("user_id") % 2 == 0, "purchase": F.col("event_type") == "purchase"}


@query("""SELECT event_id, CASE WHEN value > 90 THEN 'big' WHEN user_id % 2 = 0 THEN 'even_user' WHEN event_type = 'purchase' THEN 'purchase' ELSE 'rest' END AS route FROM events WHERE event_type <> 'error'
  UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'""")
def router_first(spark, d):
    return R.router(events(spark, d), _routes(), default="rest").select("event_id", "route")


@query("""SELECT event_id, 'big' AS route FROM events WHERE event_type <> 'error' AND value > 90 UNION ALL SELECT event_id, 'even_user' FROM events WHERE event_type <> 'error' AND user_id % 2 = 0
  UNION ALL SELECT event_id, 'purchase' FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'""")
def router_all(spark, d):
    return R.router(events(spark, d), _routes(), all_matches=True).select("event_id", "route")


# Windows.


@query(f"WITH {EV} SELECT event_id, make_timestamp(us - us % 86400000000) AS window_start, make_timestamp(us - us % 86400000000 + 86400000000) AS window_end, 'tumbling' AS window_type, 86400000000::BIGINT AS window_size FROM e")
def tumbling_rows(spark, d):
    return W.tumbling(events(spark, d), DAY).select("event_id", "window_start", "window_end", "window_type", "window_size")


@query(f"""WITH {EV} SELECT make_timestamp(us - us % 86400000000) AS window_start, make_timestamp(us - us % 86400000000 + 86400000000) AS window_end, count(*) AS item_count,
  count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS error_count, round(count(*) FILTER (ok) / count(*), 6) AS success_rate FROM e GROUP BY ALL""")
def tumbling_stats(spark, d):
    return P.window_success_rate(spark, d)


def _sliding_sql(size: int, slide: int) -> str:
    return f"""WITH {EV}, f AS (SELECT min(us) AS f FROM e), b AS (SELECT DISTINCT (us - f) // {slide} AS b FROM e, f),
  w AS (SELECT event_id, ok, f + b * {slide} AS s FROM e, f, b WHERE us >= f + b * {slide} AND us < f + b * {slide} + {size})"""


@query(_sliding_sql(6 * HOUR, HOUR) + " SELECT event_id, make_timestamp(s) AS window_start, make_timestamp(s + 21600000000) AS window_end FROM w")
def sliding_rows(spark, d):
    return W.sliding(events(spark, d), 6 * HOUR, HOUR).select("event_id", "window_start", "window_end")


@query(_sliding_sql(30 * MINUTE, 5 * MINUTE) + " SELECT make_timestamp(s) AS window_start, make_timestamp(s + 1800000000) AS window_end, count(*) AS item_count, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS error_count FROM w GROUP BY ALL")
def sliding_stats(spark, d):
    return N.collect_sliding(events(spark, d), 30 * MINUTE, 5 * MINUTE)


MEASURES = """count(*) AS item_count, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS error_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
  min(value) AS low, max(value) AS high, arg_min(event_id, (us, event_id)) AS first_id, arg_max(event_id, (us, event_id)) AS last_id"""


def _measures() -> dict[str, N.Mergeable]:
    total = N.total(F.col("value").cast("decimal(18,2)"))
    return {"total": N.Mergeable(total.partial, total.merge, lambda m: m["s"].cast("double")), "low": N.least(F.col("value")), "high": N.greatest(F.col("value")),
            "first_id": N.earliest(F.col("event_id")), "last_id": N.latest(F.col("event_id"))}


def _sliding_measures_sql(size: int, slide: int) -> str:
    w = _sliding_sql(size, slide).replace("SELECT event_id, ok,", "SELECT e.*,")
    return w + f" SELECT make_timestamp(s) AS window_start, make_timestamp(s + {size}) AS window_end, {MEASURES} FROM w GROUP BY s"


@query(_sliding_measures_sql(5 * HOUR, 5 * MINUTE))
def sliding_long(spark, d):
    """Every row is in sixty windows."""
    return N.collect_sliding(events(spark, d), 5 * HOUR, 5 * MINUTE, _measures())


@query(_sliding_measures_sql(90 * MINUTE, 60 * MINUTE))
def sliding_uneven(spark, d):
    """The slide does not divide the size."""
    return N.collect_sliding(events(spark, d), 90 * MINUTE, 60 * MINUTE, _measures())


@query(f"""WITH {EV}, f AS (SELECT user_id, min(us) AS f FROM e GROUP BY user_id), b AS (SELECT DISTINCT user_id, f, (us - f) // 14400000000 AS b FROM e JOIN f USING (user_id)),
  w AS (SELECT e.*, f + b * 14400000000 AS s FROM e JOIN b USING (user_id) WHERE us >= f + b * 14400000000 AND us < f + b * 14400000000 + 86400000000)
  SELECT user_id, make_timestamp(s) AS window_start, make_timestamp(s + 86400000000) AS window_end, {MEASURES} FROM w GROUP BY user_id, s""")
def sliding_keyed(spark, d):
    return N.collect_sliding(events(spark, d), DAY, 4 * HOUR, _measures(), ["user_id"])


SESSIONS = f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS new FROM e),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)"""


@query(SESSIONS + """ SELECT event_id, make_timestamp(min(us) OVER w) AS window_start, make_timestamp(max(us) OVER w + 43200000000) AS window_end, CAST(user_id AS VARCHAR) AS session_key FROM s
  WINDOW w AS (PARTITION BY user_id, s)""")
def session_rows(spark, d):
    return W.session(events(spark, d), "user_id", 12 * HOUR).select("event_id", "window_start", "window_end", "session_key")


@query(SESSIONS + " SELECT user_id, make_timestamp(min(us)) AS window_start, make_timestamp(max(us) + 43200000000) AS window_end, count(*) AS n, count(*) FILTER (ok) AS good FROM s GROUP BY user_id, s")
def session_stats(spark, d):
    return W.sessions(events(spark, d), "user_id", 12 * HOUR, {"n": F.count("*"), "good": F.count_if(is_success())})


@query(SESSIONS + """, x AS (SELECT make_timestamp(min(us)) AS window_start, make_timestamp(max(us) + 43200000000) AS window_end, count(*) AS n, count(*) FILTER (ok) AS good FROM s GROUP BY user_id, s)
  SELECT window_start, window_end, CAST(sum(n) AS BIGINT) AS item_count, CAST(sum(good) AS BIGINT) AS success_count, CAST(sum(n - good) AS BIGINT) AS error_count FROM x GROUP BY ALL""")
def session_collected(spark, d):
    return W.collect_windows(W.session(events(spark, d), "user_id", 12 * HOUR))


CAPPED = f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_id, us, ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e),
  r AS (SELECT user_id, event_id, us, ok, rn, us AS t0, us AS last, 1 AS s FROM n WHERE rn = 1
    UNION ALL SELECT user_id, event_id, us, ok, rn, CASE WHEN new THEN us ELSE t0 END, us, s + CAST(new AS INTEGER)
    FROM (SELECT n.*, r.t0, r.s, n.us - r.last > 43200000000 OR n.us - r.t0 >= 86400000000 AS new FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1))"""


@query(CAPPED + """ SELECT event_id, make_timestamp(t0) AS window_start, make_timestamp(least(max(us) OVER w + 43200000000, t0 + 86400000000)) AS window_end, CAST(user_id AS VARCHAR) AS session_key
  FROM r WINDOW w AS (PARTITION BY user_id, s)""")
def session_capped_rows(spark, d):
    return W.session(events(spark, d), "user_id", 12 * HOUR, most=DAY).select("event_id", "window_start", "window_end", "session_key")


@query(CAPPED + """ SELECT user_id, make_timestamp(min(us)) AS window_start, make_timestamp(least(max(us) + 43200000000, min(us) + 86400000000)) AS window_end, count(*) AS n, count(*) FILTER (ok) AS good
  FROM r GROUP BY user_id, s""")
def session_capped_stats(spark, d):
    return W.sessions(events(spark, d), "user_id", 12 * HOUR, {"n": F.count("*"), "good": F.count_if(is_success())}, most=DAY)


@query(f"""WITH {EV}, h AS (SELECT *, us - us % 3600000000 AS w FROM e)
  SELECT make_timestamp(w) AS window_start, make_timestamp(w + 3600000000) AS window_end, coalesce(string_agg(CASE WHEN NOT ok THEN event_id || ':error event' END, ',' ORDER BY ts, event_id), '') AS errors FROM h GROUP BY w""")
def window_errors(spark, d):
    out = W.collect_errors(W.tumbling(events(spark, d), HOUR))
    return out.withColumn("errors", F.array_join(F.transform("errors", lambda e: F.concat(e["item"]["event_id"].cast("string"), F.lit(":"), e["message"])), ","))


# Aggregation and monitoring.


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS emission FROM events WHERE event_type <> 'error')
  SELECT event_type, CAST(emission AS BIGINT) AS emission, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM n GROUP BY ALL""")
def agg_count_window(spark, d):
    return A.by_count(events(spark, d), 100, {"total": A.sum_of("value")}, ["event_type"])


DAYS = "make_timestamp(us - us % 86400000000) AS start_ts, make_timestamp(us - us % 86400000000 + 86400000000) AS end_ts"


@query(f"WITH {EV} SELECT {DAYS}, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS high FROM e WHERE ok GROUP BY ALL")
def agg_time_window(spark, d):
    return A.by_time(events(spark, d), DAY, {"total": A.sum_of("value"), "high": F.max("value")})


@query(f"""WITH {EV}, w AS (SELECT us - us % 60000000 AS w, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM e WHERE ok GROUP BY 1),
  s AS (SELECT unnest(range((SELECT min(w) FROM w), (SELECT max(w) FROM w) + 1, 60000000)) AS w)
  SELECT make_timestamp(s.w) AS start_ts, make_timestamp(s.w + 60000000) AS end_ts, coalesce(n, 0) AS n, total FROM s LEFT JOIN w ON s.w = w.w""")
def agg_empty_windows(spark, d):
    return A.by_time(events(spark, d), MINUTE, {"total": A.sum_of("value")}, empty=True)


@query(f"""WITH {EV}, w AS (SELECT user_id, us - us % 86400000000 AS w, count(*) AS n, max(value) AS high FROM e WHERE ok GROUP BY ALL),
  s AS (SELECT user_id, unnest(range(min(w), max(w) + 1, 86400000000)) AS w FROM w GROUP BY user_id)
  SELECT s.user_id, make_timestamp(s.w) AS start_ts, make_timestamp(s.w + 86400000000) AS end_ts, coalesce(n, 0) AS n, high FROM s LEFT JOIN w ON s.w = w.w AND s.user_id = w.user_id""")
def agg_empty_windows_keyed(spark, d):
    return A.by_time(events(spark, d), DAY, {"high": F.max("value")}, ["user_id"], empty=True)


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS emission FROM events WHERE event_type <> 'error'),
  c AS (SELECT user_id, emission, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, list(event_id ORDER BY ts, event_id) AS ids FROM n GROUP BY user_id, emission)
  SELECT user_id, CAST(emission AS BIGINT) AS emission, start_ts, end_ts, n, CAST(list_reduce(list_prepend(7::BIGINT, ids), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS state FROM c""")
def agg_user_fold(spark, d):
    return A.fold_by_count(events(spark, d), 8, F.lit(7).cast("long"), lambda a, x: (a * 31 + x["event_id"]) % 1000003, ["event_id"], ["user_id"])


@query(GREEDY_BATCH + """ SELECT user_id, batch_id - 1 AS emission, make_timestamp(min(us)) AS start_ts, make_timestamp(max(us)) AS end_ts, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM r GROUP BY user_id, batch_id""")
def agg_multi_trigger(spark, d):
    return A.by_either(events(spark, d), 5, 6 * HOUR, {"total": A.sum_of("value")}, ["user_id"])


@query(f"WITH {EV} SELECT {DAYS}, count(*) AS n, count(DISTINCT user_id) AS users FROM e WHERE ok GROUP BY ALL")
def agg_unique(spark, d):
    return A.by_time(events(spark, d), DAY, {"users": F.count_distinct("user_id")})


@query(f"""WITH {EV} SELECT {DAYS}, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high,
  round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean, round(var_pop(value), 2) AS variance, round(stddev_samp(value), 4) AS deviation FROM e WHERE ok GROUP BY ALL""")
def agg_stats(spark, d):
    s = A.statistics_of("value")
    s["mean"] = F.round(A.sum_of("value") / F.count("*"), 4)
    return A.by_time(events(spark, d), DAY, s)


@query(f"WITH {EV} SELECT event_type, {DAYS}, count(*) AS n FROM e WHERE ok GROUP BY ALL")
def agg_type_counts(spark, d):
    return A.count_by(events(spark, d), DAY, "event_type")


@query(f"WITH {EV} SELECT {DAYS}, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS revenue FROM e WHERE ok GROUP BY ALL")
def agg_revenue(spark, d):
    revenue = F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))).cast("double")
    return A.by_time(events(spark, d), DAY, {"revenue": revenue})


@query("""SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total, count(*) OVER w AS n FROM events WHERE event_type <> 'error'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def agg_running_state(spark, d):
    out = A.running_state(events(spark, d), {"total": F.sum(F.col("value").cast("decimal(18,2)")), "n": F.count("*")}, ["user_id"])
    return out.select("event_id", F.col("total").cast("double").alias("total"), "n")


@query(f"""WITH {EV}, l AS (SELECT *, us - lag(us) OVER (ORDER BY ts, event_id) AS lat, us - us % 3600000000 AS w FROM e)
  SELECT make_timestamp(w) AS start_ts, make_timestamp(w + 3600000000) AS end_ts, count(*) AS item_count, round(count(*) / 3600.0, 6) AS rate, round(avg(lat), 2) AS avg_latency,
  min(lat) AS min_latency, max(lat) AS max_latency FROM l GROUP BY w""")
def monitor_stats(spark, d):
    return A.monitor(events(spark, d), HOUR)


@query(f"""WITH {EV}, l AS (SELECT us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lat FROM e)
  SELECT round(quantile_cont(lat, 0.5), 2) AS p50, round(quantile_cont(lat, 0.95), 2) AS p95, round(quantile_cont(lat, 0.99), 2) AS p99 FROM l""")
def monitor_percentiles(spark, d):
    out = A.latency_percentiles(events(spark, d), ["user_id"])
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


# Resilience.


SCHEDULE = """SELECT event_id, CAST(a AS INTEGER) AS attempt, CAST(CASE WHEN a <= 1 THEN 0 ELSE least(100000 * power(2, a - 2), 30000000) END AS BIGINT) AS wait
  FROM (SELECT event_id, unnest(range(1, user_id % 12 + 2)) AS a FROM events WHERE event_type <> 'error')"""


@query(SCHEDULE)
def retry_schedule(spark, d):
    """Every attempt of each success, which fails as often as its user's number says, with the wait before it."""
    rows = events(spark, d).filter(is_success()).select("event_id", F.explode(F.sequence(F.lit(1), (F.col("user_id") % 12 + 1).cast("int"))).alias("attempt"))
    return rows.select("event_id", "attempt", S.delay(F.col("attempt")).alias("wait"))


def _flaky(row: dict, n: int) -> int:
    if row["user_id"] % 5 >= n:
        raise ValueError("not yet")
    return int(row["user_id"]) * n


RETRY = """SELECT event_id, CASE WHEN user_id % 5 < 3 THEN user_id * (user_id % 5 + 1) END AS result, CAST(least(user_id % 5 + 1, 3) AS INTEGER) AS attempts,
  CASE WHEN user_id % 5 >= 3 THEN 'not yet' END AS failure FROM events WHERE event_type <> 'error'"""


@query(RETRY)
def retry_rows(spark, d):
    return S.retry(events(spark, d), _flaky, "bigint", 3).filter("attempts is not null").select("event_id", "result", "attempts", "failure")


@query("SELECT event_id, 3 AS attempts FROM events WHERE event_type <> 'error' AND user_id % 5 >= 3")
def dlq_after_retry(spark, d):
    return S.dead_letters_after_retry(events(spark, d), _flaky, "bigint", 3)[1].select("event_id", "attempts")


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_id, us, NOT ok AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e),
  r AS (SELECT user_id, event_id, rn, 'closed' AS mode, 1 AS n, CAST(failed AS INTEGER) AS bad, 0::BIGINT AS since, CASE WHEN failed THEN 'failed' ELSE 'passed' END AS outcome, 'closed' AS circuit FROM n WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn,
      CASE WHEN m = 'open' THEN 'open' WHEN m = 'half-open' AND failed THEN 'open' WHEN m = 'half-open' AND c >= 2 THEN 'closed' WHEN m = 'half-open' THEN m WHEN c >= 5 AND b / c >= 0.3 THEN 'open' ELSE 'closed' END,
      CASE WHEN m = 'open' THEN c - 1 WHEN (m = 'half-open' AND (failed OR c >= 2)) OR (m = 'closed' AND c >= 5 AND b / c >= 0.3) THEN 0 ELSE c END,
      CASE WHEN m = 'open' THEN b - CAST(failed AS INTEGER) WHEN (m = 'half-open' AND (failed OR c >= 2)) OR (m = 'closed' AND c >= 5 AND b / c >= 0.3) THEN 0 ELSE b END,
      CASE WHEN m <> 'open' AND ((m = 'half-open' AND (failed OR c >= 2)) OR (m = 'closed' AND c >= 5 AND b / c >= 0.3)) THEN us ELSE since END,
      CASE WHEN m = 'open' THEN 'rejected' WHEN failed THEN 'failed' ELSE 'passed' END,
      CASE WHEN m = 'open' THEN 'open' WHEN m = 'half-open' AND failed THEN 'open' WHEN m = 'half-open' AND c >= 2 THEN 'closed' WHEN m = 'half-open' THEN m WHEN c >= 5 AND b / c >= 0.3 THEN 'open' ELSE 'closed' END
    FROM (SELECT x.user_id, x.event_id, x.rn, x.us, x.failed, r.since, CASE WHEN r.mode = 'open' AND x.us - r.since >= 86400000000 THEN 'half-open' ELSE r.mode END AS m,
      CASE WHEN r.mode = 'open' AND x.us - r.since >= 86400000000 THEN 0 ELSE r.n END + 1 AS c, CASE WHEN r.mode = 'open' AND x.us - r.since >= 86400000000 THEN 0 ELSE r.bad END + CAST(x.failed AS INTEGER) AS b
      FROM r JOIN n x ON x.user_id = r.user_id AND x.rn = r.rn + 1))
  SELECT event_id, outcome, circuit FROM r""")
def circuit_breaker(spark, d):
    return S.circuit_breaker(events(spark, d), is_error(), ["user_id"], rate=0.3, least=5, pause=DAY, probes=2).select("event_id", "outcome", "circuit")


# Pipelines.


@query("""WITH j AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000)
  SELECT c_mktsegment, CAST(rn // 50 + 1 AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_orderkey) AS low_key FROM j GROUP BY ALL""")
def pipe_etl(spark, d):
    return P.etl(spark, d)


@query(f"""WITH {EV}, s AS (SELECT * FROM e WHERE ok AND {FNV.format(bytes=LONG_BYTES.format(k='event_id'))} % 1000 < 500),
  f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) = 1)
  SELECT event_type, {DAYS}, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM f GROUP BY ALL""")
def pipe_analytics(spark, d):
    return P.analytics(spark, d)


@query(f"""WITH {EV}, w AS (SELECT *, make_timestamp(us - us % 86400000000) AS start_ts FROM e WHERE ok)
  SELECT start_ts, 'count:' || event_type AS metric, CAST(count(*) AS DOUBLE) AS amount FROM w GROUP BY ALL
  UNION ALL SELECT start_ts, 'revenue', CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM w WHERE event_type = 'purchase' GROUP BY ALL
  UNION ALL SELECT start_ts, 'users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM w GROUP BY ALL""")
def pipe_multi_aggregate(spark, d):
    return P.multi_aggregate(spark, d)


@query("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events WHERE event_type <> 'error')
  SELECT user_id, CAST(rn // 10 + 1 AS BIGINT) AS batch_id, CAST(rn % 10 AS INTEGER) AS place, event_id, value FROM n""")
def pipe_group_batch(spark, d):
    return P.group_batch(spark, d)


@query("""WITH s AS (SELECT CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS side, * FROM lineitem),
  n AS (SELECT *, (row_number() OVER (PARTITION BY side, l_returnflag ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) - 1) // 100 AS emission FROM s)
  SELECT side, l_returnflag, CAST(emission AS BIGINT) AS emission, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM n GROUP BY ALL""")
def pipe_quality(spark, d):
    return P.quality_control(spark, d)


@query("""WITH u AS (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, 0 AS source FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 1 FROM supplier),
  n AS (SELECT *, (row_number() OVER (PARTITION BY nation ORDER BY key, key * 2 + source) - 1) // 25 + 1 AS batch_id FROM u WHERE balance >= 0)
  SELECT nation, CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(b AS INTEGER) AS branch FROM n, (SELECT unnest(range(0, 2)) AS b) GROUP BY ALL""")
def pipe_fan_in_batch_fan_out(spark, d):
    return P.fan_in_batch_fan_out(spark, d)


@query("SELECT event_type, CAST(2 * count(*) FILTER (event_type <> 'error') AS BIGINT) AS good, CAST(2 * count(*) FILTER (event_type = 'error') AS BIGINT) AS bad FROM events GROUP BY 1")
def pipe_recombine(spark, d):
    return P.recombine(spark, d)


@query("""SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS stage1,
  CASE WHEN o_orderstatus <> 'O' THEN '-' WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS stage2, count(*) AS n FROM orders GROUP BY ALL""")
def pipe_multi_stage(spark, d):
    return P.multi_stage_routing(spark, d)


@query(f"""SELECT event_id, {_partition(LONG_BYTES.format(k='user_id'), 10)} AS partition_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth_of_user FROM events WHERE event_type <> 'error'""")
def pipe_keyed(spark, d):
    return P.keyed_processing(spark, d)


@query("SELECT CAST(n_regionkey AS INTEGER) AS partition_index, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pipe_geographic(spark, d):
    return P.geographic(spark, d)


@query("""WITH n AS (SELECT event_id * 2 AS doubled, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 + 1 AS batch_id FROM events WHERE event_type <> 'error' AND event_id % 2 = 0)
  SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(doubled) AS BIGINT) AS total FROM n GROUP BY 1""")
def pipe_filter_map_batch(spark, d):
    return P.filter_map_batch(spark, d)


@query("SELECT count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type <> 'error') AS BIGINT) AS total FROM events")
def pipe_enrich(spark, d):
    return P.enrich_scaled(spark, d)

