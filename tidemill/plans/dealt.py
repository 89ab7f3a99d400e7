"""Queries of the training-data problems that concern logs and activity tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clocks, control_charts, delivery, malformed, references, schema_drift
from ..sources.tables import table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query = catalog.queries, catalog.sql, catalog.query
_ID = {"texts": ["run", "attempt", "kind"], "number": "step", "delivered_at": "delivered_at", "row_id": "row_id"}


# 1. Messages delivered more than once


@query("""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY run, attempt, kind, step ORDER BY delivered_at, row_id) AS n
FROM loss WHERE step IS NOT NULL) WHERE n > 1""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.surplus_copies(table(spark, sf_dir, "loss"), **_ID)


@query("""SELECT row_id, run, attempt, kind, step, val_bpb FROM (SELECT *, row_number() OVER (PARTITION BY run, attempt, kind, step
ORDER BY delivered_at, row_id) AS n FROM loss) WHERE n = 1 OR step IS NULL""")
def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.keep_one(table(spark, sf_dir, "loss").select("row_id", "run", "attempt", "kind", "step", "val_bpb", "delivered_at"), **_ID).drop("delivered_at")


@query("""SELECT run, kind, count(*) AS messages, count_if(n > 1) AS repeated, CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
count_if(coalesce(low <> high, false) OR (filled > 0 AND filled < n)) AS differing
FROM (SELECT run, attempt, kind, step, count(*) AS n, min(val_bpb) AS low, max(val_bpb) AS high, count(val_bpb) AS filled
FROM loss WHERE step IS NOT NULL GROUP BY run, attempt, kind, step) GROUP BY run, kind""")
def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.copy_report(table(spark, sf_dir, "loss"), value="val_bpb", by=["run", "kind"], **_ID)


# 2. Implausible spikes in measurements


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_charts.suspicious_readings(table(spark, sf_dir, "loss"))


@query()
def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious readings per source and field."""
    return p2_found(spark, sf_dir).groupBy("run", "attempt", "field_name").agg(F.count(F.lit(1)).alias("n_suspicious"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


# 3. References to records that do not exist

_REASONS = """WITH t AS (SELECT id, min(loaded_at) AS valid_from, min(deleted_at) AS valid_to FROM tasks WHERE id IS NOT NULL GROUP BY id),
j AS (SELECT id, min(loaded_at) AS valid_from, min(deleted_at) AS valid_to FROM jobs WHERE id IS NOT NULL GROUP BY id),
refs AS (
SELECT 'task_events' AS source_table, CAST(e.id AS VARCHAR) AS row_key, e.loaded_at, e.task_id AS ref, t.id AS parent, t.valid_from, t.valid_to
FROM task_events e LEFT JOIN t ON e.task_id = t.id
UNION ALL
SELECT 'executions', e.id, e.loaded_at, e.job_id, j.id, j.valid_from, j.valid_to FROM executions e LEFT JOIN j ON e.job_id = j.id),
found AS (SELECT source_table, row_key, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS loaded_month,
CASE WHEN parent IS NULL THEN 'missing' WHEN valid_from > loaded_at THEN 'late' WHEN valid_to <= loaded_at THEN 'deleted' END AS reason
FROM refs WHERE ref IS NOT NULL AND regexp_matches(ref, '[^\\s\\x{a0}\\x{3000}]'))
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    events = references.orphans(t("task_events"), "id", "task_id", t("tasks"), "id", "task_events")
    return events.unionByName(references.orphans(t("executions"), "id", "job_id", t("jobs"), "id", "executions"))


@query(_REASONS + "SELECT source_table, row_key, loaded_month FROM found WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).drop("reason")


@query(_REASONS + "SELECT source_table, loaded_month, reason, count(*) AS n_orphans FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, sf_dir))


# 4. Rows that fail to parse


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.failed_lines(table(spark, sf_dir, "loss_lines")).select("line_id")


@query()
def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.failed_lines(table(spark, sf_dir, "loss_lines"))


@query()
def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.loaded_rows(table(spark, sf_dir, "loss_lines"))


# 5. Mixed timestamp formats and time zones

CLOCKS = {"executions": "started_at", "task_events": "created_at", "request_log": "ts", "consolidation_log": "created_at"}


def _clock_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = None
    for name, column in CLOCKS.items():
        part = table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col("id").cast("string").alias("row_key"), F.col(column).alias("text"), "host", "loaded_at")
        values = part if values is None else values.unionByName(part)
    return values


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.normalise(_clock_values(spark, sf_dir), table(spark, sf_dir, "hosts"))


@query()
def p5_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone estimated for each host beside the listed one."""
    return clocks.host_zones(_clock_values(spark, sf_dir), table(spark, sf_dir, "hosts"))


# 6. Schemas that drift between files


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "loss_file_records"))


@query()
def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.one_table(table(spark, sf_dir, "loss_file_records"))


@query()
def p6_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.failed_casts(table(spark, sf_dir, "loss_file_records"))
