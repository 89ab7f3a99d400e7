"""Streaming jobs drained over the tables: their results must equal the batch statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query = catalog.queries, catalog.sql, catalog.query


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x11_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = jobs.windowed_counts(jobs.table_stream(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")
    return jobs.run_available(w, "complete").withColumn("total", F.round("total", 6))


@query("SELECT start_us, count(*) AS n FROM (SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - 1800000000 * unnest([0, 1]) AS start_us FROM events) GROUP BY start_us")
def x11_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = jobs.windowed_counts(jobs.table_stream(spark, sf_dir, "events"), "ts", "1 hour", [], "value", "30 minutes")
    return jobs.run_available(w, "complete").select("start_us", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def x05_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.sessions(jobs.table_stream(spark, sf_dir, "events"), "ts", "2 hours", "user_id")
    return jobs.run_available(s, "complete")


@query("SELECT run AS key, milestone FROM (SELECT run, max(step) AS top FROM loss WHERE step IS NOT NULL AND run IS NOT NULL GROUP BY run), (SELECT unnest([100, 1000, 10000, 100000]) AS milestone) WHERE top >= milestone")
def x06_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = jobs.milestones(jobs.table_stream(spark, sf_dir, "loss"), "run", "step", (100, 1000, 10000, 100000))
    return jobs.run_available(m, "append").select("key", "milestone")


@query("SELECT run, kind AS last_kind FROM (SELECT run, kind, row_number() OVER (PARTITION BY run ORDER BY attempt DESC NULLS LAST, line_no DESC NULLS LAST, kind DESC NULLS LAST) AS n FROM loss) WHERE n = 1")
def x08_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = jobs.last_marker(jobs.table_stream(spark, sf_dir, "loss"), "run", ["attempt", "line_no"], "kind")
    return jobs.run_available(m, "complete")


@query("SELECT count(*) AS messages FROM (SELECT DISTINCT run, attempt, kind, step FROM loss WHERE step IS NOT NULL)")
def x10_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.table_stream(spark, sf_dir, "loss").where("step IS NOT NULL").select("run", "attempt", "kind", "step", "delivered_at")
    return jobs.run_available(jobs.first_deliveries(rows, "delivered_at", ["run", "attempt", "kind", "step"]), "append", jobs.LARGE_STATE).agg(F.count(F.lit(1)).alias("messages"))
