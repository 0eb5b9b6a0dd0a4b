"""Queries that run as streams to their end and give the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.registry import Registry
from panelwright.session import checkpoint_dir
from panelwright.streaming import streams as T

query = Registry()


def _run(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Write a stream's micro-batches, each twice and to its own folder, and read what is there at the end."""
    base = f"{checkpoint_dir(spark)}/panelwright-stream-{uuid.uuid4().hex[:8]}"
    schema = df.schema
    T.run_to_end(df, f"{base}/state", T.repeated(T.exactly_once(f"{base}/out")), mode)
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.fieldNames())


#: Files that the events arrive in, one in each micro-batch.
ARRIVALS = 5


def _events(spark: SparkSession, d: str, late: bool = False) -> DataFrame:
    """The events as a stream of files in the order of time, one file a micro-batch.

    With ``late``, the last file brings the first day's events again, which a watermark must leave out, and two
    more follow with a row far ahead of all (type ``end``) that closes all windows before it.
    """
    path = f"{checkpoint_dir(spark)}/panelwright-arrivals-{uuid.uuid4().hex[:8]}"
    e = spark.read.parquet(f"{d}/events.parquet")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        e.write.parquet(path)
        return T.parquet_stream(spark, path, 1)
    step = (hi - lo) / ARRIVALS
    for k in range(ARRIVALS):
        part = e.where((F.col("ts") >= F.lit(lo + k * step)) & (F.col("ts") < F.lit(lo + (k + 1) * step)) if k + 1 < ARRIVALS else F.col("ts") >= F.lit(lo + k * step))
        if late and k + 1 == ARRIVALS:
            part = part.unionByName(e.where(F.col("ts") < F.lit(lo + step / 10)))
        part.coalesce(1).write.mode("append").parquet(path)
    if late:
        end = e.limit(1).withColumns({"ts": F.lit(hi + 2 * (hi - lo)).cast(e.schema["ts"].dataType), "event_type": F.lit("end")})
        for _ in range(2):
            end.coalesce(1).write.mode("append").parquet(path)
    return T.parquet_stream(spark, path, 1)


@query("t1_exactly_once", "select event_id, user_id from events where event_type='purchase'")
def _(spark, d):
    return _run(spark, _events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id"))


@query("t2_first_seen", "select distinct user_id, event_type from events")
def _(spark, d):
    # State of a key is let go once the watermark is so far behind its first row; here farther than the table reaches.
    e = T.event_time(_events(spark, d), "ts", "400 days").select("user_id", "event_type", "event_ts")
    return _run(spark, T.first_seen(e, ["user_id", "event_type"], within_watermark=True).select("user_id", "event_type"))


@query("t3_daily_windows", "select cast(date_trunc('day', ts) as varchar) as day, event_type, count(*) as n from events group by 1,2")
def _(spark, d):
    s = T.tumbling(T.event_time(_events(spark, d, late=True), "ts", "1 hour"), "1 day", ["event_type"], [F.count("*").alias("n")])
    return _run(spark, s).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


@query(
    "t4_split_windows",
    """with recursive c as (select cast(day(ts) as int) as k, count(*) as n from events group by 1), m as (select greatest(1, sum(n) // 6) as cap from c),
    w as (select 1 as a, 30 as b union all select case h when 0 then a else (a + b) // 2 + 1 end, case h when 0 then (a + b) // 2 else b end from w, (values (0), (1)) x(h), m where b > a and (select sum(n) from c where k between a and b) > cap),
    x as (select a, b, (select sum(n) from c where k between a and b) as n from w) select a, b, cast(n as bigint) as n from x, m where n > 0 and (n <= cap or a = b)""",
)
def _(spark, d):
    counts = dict(spark.read.parquet(f"{d}/events.parquet").groupBy(F.dayofmonth("ts").alias("k")).count().collect())
    plan = T.split_windows(1, 30, lambda a, b: sum(counts.get(k, 0) for k in range(a, b + 1)), max(1, sum(counts.values()) // 6))
    return spark.createDataFrame(plan, "a int, b int, n long")


@query("t5_latest_state", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def _(spark, d):
    base = f"{checkpoint_dir(spark)}/panelwright-state-{uuid.uuid4().hex[:8]}"
    s = _events(spark, d).select("user_id", "event_type", "event_id")
    T.run_to_end(s, f"{base}/state", T.repeated(T.latest_state(spark, f"{base}/out", ["user_id"], [F.desc("event_id")])))
    return T.last_version(spark, f"{base}/out")


@query(
    "t6_sessions",
    """with t as (select user_id, ts, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from t)
    select user_id, count(*) as n, cast(epoch_us(min(ts)) as bigint) as start_us from s group by user_id, k""",
)
def _(spark, d):
    e = T.event_time(_events(spark, d, late=True), "ts", "1 hour")
    return _run(spark, T.sessions(e, "6 hours", ["user_id"], [F.count("*").alias("n")])).select("user_id", "n", F.unix_micros("session_start").alias("start_us"))


@query(
    "t7_sliding",
    """with w as (select unnest(generate_series(timestamp '2023-12-31 12:00:00', timestamp '2024-01-31 00:00:00', interval 12 hour)) as a) select cast(a as varchar) as window_start, count(*) as n, round(sum(value),2) as total from w join events on ts >= a and ts < a + interval 1 day group by 1""",
)
def _(spark, d):
    e = T.event_time(_events(spark, d, late=True), "ts", "1 hour")
    t = T.tumbling(e, "1 day", [], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")], "12 hours")
    return _run(spark, t).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "total")


QUERIES, ORACLES = query.queries, query.oracles
