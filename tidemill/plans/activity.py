"""Activity streams: events, last-hour statistics, tallies, and the node and link map. ``now`` is the newest load of a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..operators.offsets import numbered
from ..sources.tables import table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query, relational = catalog.queries, catalog.sql, catalog.query, catalog.relational

relational("l01_newest_requests", "SELECT id, model, provider, status FROM (SELECT DISTINCT id, model, provider, status, loaded_at FROM request_log) AS r ORDER BY loaded_at DESC, id DESC, model, provider, status LIMIT 100")
relational(
    "a13_last_hour",
    """SELECT count(*) AS n, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents, CAST(coalesce(sum(tokens_prompt + tokens_completion), 0) AS BIGINT) AS tokens,
    CAST(coalesce(sum(CASE WHEN error IS NOT NULL OR status >= 400 THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors FROM (SELECT DISTINCT * FROM request_log) AS r
    WHERE loaded_at > (SELECT max(loaded_at) FROM request_log) - INTERVAL 1 HOUR""",
)
relational(
    "x11_hourly_requests",
    """SELECT CAST(floor(extract(epoch FROM loaded_at) / 3600) AS BIGINT) AS hour_no, count(*) AS n, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents FROM (SELECT DISTINCT * FROM request_log) AS r GROUP BY CAST(floor(extract(epoch FROM loaded_at) / 3600) AS BIGINT)""",
    """SELECT CAST(floor(unix_micros(loaded_at) / 3600000000) AS BIGINT) AS hour_no, count(*) AS n, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents FROM (SELECT DISTINCT * FROM request_log) AS r GROUP BY CAST(floor(unix_micros(loaded_at) / 3600000000) AS BIGINT)""",
)
_NEWEST_TASKS = "(SELECT id, max(title) AS title, max(status) AS status, max(assignee) AS assignee FROM (SELECT id, title, status, assignee, loaded_at, max(loaded_at) OVER (PARTITION BY id) AS newest FROM tasks WHERE id IS NOT NULL) AS x WHERE loaded_at = newest GROUP BY id)"
relational("j02_events_with_tasks", f"SELECT e.id, e.task_id, e.kind, substring(coalesce(t.title, ''), 1, 120) AS title, t.status, t.assignee FROM task_events AS e LEFT JOIN {_NEWEST_TASKS} AS t ON t.id = e.task_id")
relational("g05_kanban", f"SELECT coalesce(status, '?') AS status, count(*) AS n, coalesce(status, '?') NOT IN ('done', 'archived') AS still_open FROM {_NEWEST_TASKS} AS t GROUP BY coalesce(status, '?')")
relational("a12_status_counts", "SELECT coalesce(status, '?') AS status, count(*) AS n FROM tasks GROUP BY coalesce(status, '?')")
_NAMES = "(SELECT id, max(name) AS name FROM (SELECT id, name, loaded_at, max(loaded_at) OVER (PARTITION BY id) AS newest FROM jobs WHERE id IS NOT NULL) AS x WHERE loaded_at = newest GROUP BY id)"
relational("j03_job_names", f"SELECT e.id, coalesce(j.name, e.job_id) AS job, e.status, substring(e.error, 1, 160) AS error FROM executions AS e LEFT JOIN {_NAMES} AS j ON j.id = e.job_id")
relational("g04_cron", f"SELECT coalesce(j.name, e.job_id, '?') AS job, coalesce(e.status, '?') AS status, count(*) AS n, coalesce(e.status, '?') IN ('failed', 'error', 'timeout') AS failed FROM executions AS e LEFT JOIN {_NAMES} AS j ON j.id = e.job_id GROUP BY coalesce(j.name, e.job_id, '?'), coalesce(e.status, '?')")
relational("a28_memory_counts", "SELECT count(*) AS consolidations, CAST(coalesce(sum(items_consolidated), 0) AS BIGINT) AS items FROM (SELECT DISTINCT * FROM consolidation_log) AS c")
relational(
    "l03_merged_tiers",
    """SELECT tier, id, preview FROM (SELECT 'working' AS tier, CAST(id AS VARCHAR(40)) AS id, substring(coalesce(summary_preview, ''), 1, 120) AS preview, loaded_at FROM (SELECT DISTINCT * FROM consolidation_log) AS c
    UNION ALL SELECT 'episodic', id, substring(coalesce(title, ''), 1, 120), loaded_at FROM tasks WHERE id IS NOT NULL) AS u ORDER BY loaded_at DESC, tier, id, preview LIMIT 100""",
)
relational(
    "l02_heaviest_edges",
    "SELECT task_id AS source, kind AS target, count(*) AS weight FROM task_events WHERE task_id IS NOT NULL GROUP BY task_id, kind ORDER BY count(*) DESC, task_id, kind LIMIT 60",
)
relational("l08_top_per_group", "SELECT provider, model, cost FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY cost DESC, model) AS n FROM (SELECT provider, model, CAST(sum(cost_cents) AS BIGINT) AS cost FROM (SELECT DISTINCT * FROM request_log) AS d GROUP BY provider, model) AS s WHERE cost IS NOT NULL) AS r WHERE n <= 5")
relational("r23_panel_stats", "SELECT coalesce(provider, '?') AS provider, round(sum(cost_cents) / CAST(100 AS DOUBLE), 6) AS spend, count(DISTINCT model) AS models FROM (SELECT DISTINCT * FROM request_log) AS r GROUP BY coalesce(provider, '?')")
relational("x04_live_hosts", "SELECT host, max(loaded_at) > (SELECT max(loaded_at) FROM request_log) - INTERVAL 1 HOUR AS live FROM request_log GROUP BY host")
relational(
    "p18_payload_fields",
    """SELECT id, kind, coalesce(json_extract_string(payload, '$.to'), kind) AS target FROM task_events WHERE payload IS NOT NULL""",
    """SELECT id, kind, coalesce(get_json_object(payload, '$.to'), kind) AS target FROM task_events WHERE payload IS NOT NULL""",
)

_NODES = f"""WITH k AS (SELECT e.id, e.task_id, t.title FROM task_events e LEFT JOIN {_NEWEST_TASKS} t ON t.id = e.task_id),
r AS (SELECT DISTINCT id, model FROM request_log WHERE id IS NOT NULL)"""


@query(_NODES + """ SELECT 'pod:kanban' AS id, 'pod' AS kind, 'Kanban' AS label UNION ALL SELECT 'pod:inference', 'pod', 'Inference'
UNION ALL SELECT 'kanban:' || CAST(id AS VARCHAR), 'event', coalesce(title, 'kanban') FROM k UNION ALL SELECT DISTINCT 'task:' || task_id, 'hub', max(coalesce(title, task_id)) FROM k WHERE task_id IS NOT NULL GROUP BY task_id
UNION ALL SELECT 'inference:' || CAST(id AS VARCHAR), 'event', max(coalesce(model, 'inference')) FROM r GROUP BY id""")
def g08_map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods, one node per event and one hub per task: hubs are deduplicated by aggregation."""
    return _map(spark, sf_dir)[0]


@query(_NODES + """ SELECT 'kanban:' || CAST(id AS VARCHAR) AS source, CASE WHEN task_id IS NOT NULL THEN 'task:' || task_id ELSE 'pod:kanban' END AS target FROM k
UNION ALL SELECT DISTINCT 'task:' || task_id, 'pod:kanban' FROM k WHERE task_id IS NOT NULL UNION ALL SELECT DISTINCT 'inference:' || CAST(id AS VARCHAR), 'pod:inference' FROM r""")
def g08_map_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir)[1]


def _map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = QUERIES["j02_events_with_tasks"](spark, sf_dir).select("id", "task_id", F.nullif("title", F.lit("")).alias("title"))
    requests = table(spark, sf_dir, "request_log").where("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce("model", F.lit("inference"))).alias("label"))
    event_id, request_id, hub_id = F.concat(F.lit("kanban:"), F.col("id")), F.concat(F.lit("inference:"), F.col("id")), F.concat(F.lit("task:"), F.col("task_id"))
    pods = spark.createDataFrame([("pod:kanban", "pod", "Kanban"), ("pod:inference", "pod", "Inference")], "id string, kind string, label string")
    hubs = events.where("task_id IS NOT NULL").groupBy("task_id").agg(F.max(F.coalesce("title", "task_id")).alias("label"))
    nodes = pods.unionByName(events.select(event_id.alias("id"), F.lit("event").alias("kind"), F.coalesce("title", F.lit("kanban")).alias("label")))
    nodes = nodes.unionByName(hubs.select(hub_id.alias("id"), F.lit("hub").alias("kind"), "label")).unionByName(requests.select(request_id.alias("id"), F.lit("event").alias("kind"), "label"))
    links = events.select(event_id.alias("source"), F.coalesce(hub_id, F.lit("pod:kanban")).alias("target"))
    links = links.unionByName(hubs.select(hub_id.alias("source"), F.lit("pod:kanban").alias("target"))).unionByName(requests.select(request_id.alias("source"), F.lit("pod:inference").alias("target")))
    return nodes, links


@query(f"""SELECT e.id FROM task_events e WHERE e.task_id IN (SELECT id FROM tasks) AND e.host IN (SELECT host FROM hosts)""")
def j18_links_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose both ends are nodes: two semi joins."""
    e = table(spark, sf_dir, "task_events")
    return e.join(table(spark, sf_dir, "tasks").select(F.col("id").alias("task_id")), "task_id", "left_semi").join(table(spark, sf_dir, "hosts").select("host"), "host", "left_semi").select("id")




# Collectors: what a panel shows of each stream. ``now`` is the newest load of any stream; repeated rows of a log count once.

_NOW = "(SELECT max(t) AS now FROM (SELECT max(loaded_at) AS t FROM request_log UNION ALL SELECT max(loaded_at) FROM task_events UNION ALL SELECT max(loaded_at) FROM executions UNION ALL SELECT max(loaded_at) FROM consolidation_log))"
_STREAMS = ("request_log", "task_events", "executions", "consolidation_log")


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = [table(spark, sf_dir, n).agg(F.max("loaded_at").alias("t")) for n in _STREAMS]
    return newest[0].unionByName(newest[1]).unionByName(newest[2]).unionByName(newest[3]).agg(F.max("t").alias("now"))


@query(f"""WITH r AS (SELECT DISTINCT * FROM request_log), h AS (SELECT * FROM r WHERE loaded_at > (SELECT now FROM {_NOW}) - INTERVAL 1 HOUR)
SELECT (SELECT count(*) FROM h) AS last_hour, (SELECT CAST(coalesce(sum(cost_cents), 0) AS BIGINT) FROM h) AS cost_cents, (SELECT CAST(coalesce(sum(tokens_prompt + tokens_completion), 0) AS BIGINT) FROM h) AS tokens,
(SELECT count(*) FROM h WHERE error IS NOT NULL OR status >= 400) AS errors, CASE WHEN (SELECT max(loaded_at) FROM r) > (SELECT now FROM {_NOW}) - INTERVAL 1 MINUTE THEN 'LIVE' ELSE 'FILE' END AS freshness""")
def g01_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the last hour, their cost, tokens and errors, and whether the stream is live (a row within a minute) or only a file."""
    now = _now(spark, sf_dir).first().now  # one moment
    r = table(spark, sf_dir, "request_log").distinct()
    late = F.col("loaded_at") > F.lit(now) - F.expr("INTERVAL 1 HOUR")
    bad = F.coalesce(F.col("error").isNotNull() | (F.col("status") >= 400), F.lit(False))
    fresh = F.max("loaded_at") > F.lit(now) - F.expr("INTERVAL 1 MINUTE")
    return r.agg(
        F.count_if(late).alias("last_hour"), F.coalesce(F.sum(F.when(late, F.col("cost_cents"))), F.lit(0)).alias("cost_cents"),
        F.coalesce(F.sum(F.when(late, F.col("tokens_prompt") + F.col("tokens_completion"))), F.lit(0)).alias("tokens"), F.count_if(late & bad).alias("errors"), F.when(fresh, "LIVE").otherwise("FILE").alias("freshness"),
    )


_TOOL_ROWS = "(SELECT id, task_id, host, kind, CASE WHEN kind IN ('completed', 'blocked') THEN 'result' ELSE 'invocation' END AS side, coalesce(json_extract_string(payload, '$.to'), kind) AS tool FROM task_events WHERE payload IS NOT NULL OR kind IS NOT NULL ORDER BY id DESC LIMIT 100)"


def _tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "task_events").where("payload IS NOT NULL OR kind IS NOT NULL").orderBy(F.desc("id")).limit(100)
    side = F.when(F.col("kind").isin("completed", "blocked"), "result").otherwise("invocation")
    return e.select("id", "task_id", "host", "kind", side.alias("side"), F.coalesce(F.get_json_object("payload", "$.to"), "kind").alias("tool"))


@query(f"SELECT r.id, r.task_id, r.side, r.tool, t.title, t.assignee FROM {_TOOL_ROWS} AS r LEFT JOIN {_NEWEST_TASKS} AS t ON t.id = r.task_id")
def j01_left_join_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred tool rows, each with its task as it is now, if there is one. Only their tasks are looked up."""
    rows = _tool_rows(spark, sf_dir)
    t = table(spark, sf_dir, "tasks").join(F.broadcast(rows.select(F.col("task_id").alias("id")).distinct()), "id", "left_semi").where("loaded_at IS NOT NULL")
    newest = t.groupBy("id", "loaded_at").agg(*[F.max(c).alias(c) for c in ("title", "assignee")]).groupBy(F.col("id").alias("t_id")).agg(F.max_by(F.struct("title", "assignee"), "loaded_at").alias("t"))
    return rows.join(newest, F.col("task_id") == F.col("t_id"), "left").select("id", "task_id", "side", "tool", "t.title", "t.assignee")


@query(f"SELECT tool, count(*) AS n, count_if(side = 'invocation') AS invocations, count_if(side = 'result') AS results FROM {_TOOL_ROWS} AS r WHERE tool IS NOT NULL GROUP BY tool")
def g02_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies by tool of the newest hundred rows."""
    return _tool_rows(spark, sf_dir).where("tool IS NOT NULL").groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "invocation").alias("invocations"), F.count_if(F.col("side") == "result").alias("results"))


_TIERS = """(SELECT 'working' AS tier, CAST(id AS VARCHAR) AS id, substring(coalesce(summary_preview, ''), 1, 120) AS preview, items_consolidated AS recalled FROM (SELECT DISTINCT * FROM consolidation_log) AS c
UNION ALL SELECT 'episodic', id, substring(coalesce(title, ''), 1, 120), 0 FROM tasks WHERE id IS NOT NULL)"""


@query(f"SELECT tier, id, preview, recalled FROM {_TIERS} AS t")
def u01_tier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both memory tiers in one bag, each row with its tier."""
    log = table(spark, sf_dir, "consolidation_log").distinct()
    working = log.select(F.lit("working").alias("tier"), F.col("id").cast("string").alias("id"), F.substring(F.coalesce("summary_preview", F.lit("")), 1, 120).alias("preview"), F.col("items_consolidated").alias("recalled"))
    tasks = table(spark, sf_dir, "tasks").where("id IS NOT NULL")
    return working.unionByName(tasks.select(F.lit("episodic").alias("tier"), "id", F.substring(F.coalesce("title", F.lit("")), 1, 120).alias("preview"), F.lit(0).alias("recalled")))


@query(f"""SELECT count_if(tier = 'working') AS working, count_if(tier = 'episodic') AS episodic, CAST(coalesce(sum(recalled), 0) AS BIGINT) AS recalled_total, (SELECT count(*) FROM (SELECT DISTINCT * FROM consolidation_log)) AS consolidations,
(SELECT count(*) FROM (SELECT DISTINCT task_id, kind FROM task_events WHERE task_id IS NOT NULL)) AS graph_edges FROM {_TIERS} AS t""")
def g03_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the memory panel: tiers, recalls, consolidations, edges of the graph."""
    tiers = u01_tier_union(spark, sf_dir).agg(F.count_if(F.col("tier") == "working").alias("working"), F.count_if(F.col("tier") == "episodic").alias("episodic"), F.coalesce(F.sum("recalled"), F.lit(0)).alias("recalled_total"))
    edges = table(spark, sf_dir, "task_events").where("task_id IS NOT NULL").select("task_id", "kind").distinct().count()
    log = table(spark, sf_dir, "consolidation_log").distinct().count()
    return tiers.withColumn("consolidations", F.lit(log).cast("bigint")).withColumn("graph_edges", F.lit(edges).cast("bigint"))


@query("""SELECT 'inference' AS stream, true AS ok, count(*) AS n, epoch_us(max(loaded_at)) AS newest_us FROM (SELECT DISTINCT * FROM request_log) UNION ALL SELECT 'kanban', true, count(*), epoch_us(max(loaded_at)) FROM task_events
UNION ALL SELECT 'cron', true, count(*), epoch_us(max(loaded_at)) FROM executions UNION ALL SELECT 'memory', true, count(*), epoch_us(max(loaded_at)) FROM (SELECT DISTINCT * FROM consolidation_log) UNION ALL SELECT 'mesh', false, 0, NULL""")
def g09_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All streams in one payload: ok, events and newest event; a stream that cannot be read (here there is no mesh table) is not ok, and
    takes no other with it."""
    out = None
    for name, source, repeats in (("inference", "request_log", True), ("kanban", "task_events", False), ("cron", "executions", False), ("memory", "consolidation_log", True), ("mesh", "mesh_peers", False)):
        try:
            rows = table(spark, sf_dir, source)
            part = (rows.distinct() if repeats else rows).agg(F.lit(True).alias("ok"), F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("loaded_at")).alias("newest_us"))
        except AnalysisException:
            part = spark.range(1).select(F.lit(False).alias("ok"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("newest_us"))
        part = part.select(F.lit(name).alias("stream"), "ok", "n", "newest_us")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT name, id, row_number() OVER (ORDER BY name, id) AS place FROM (SELECT DISTINCT name, id FROM jobs WHERE deleted_at IS NULL AND id IS NOT NULL AND name IS NOT NULL)""")
def l09_sorted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are not deleted in order of name and id, with their places."""
    jobs = table(spark, sf_dir, "jobs").where("deleted_at IS NULL AND id IS NOT NULL AND name IS NOT NULL").select("name", "id").distinct()
    return numbered(jobs, ["name", "id"], "at").select("name", "id", (F.col("at") + 1).alias("place"))


@query("SELECT id, task_id, kind FROM task_events WHERE loaded_at > (SELECT loaded_at FROM task_events ORDER BY loaded_at, id LIMIT 1) + INTERVAL 30 DAY")
def x12_cursor_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a cursor: those loaded more than thirty days after the first. Only rows past the cursor leave the scan."""
    e = table(spark, sf_dir, "task_events")
    cursor = e.agg(F.min("loaded_at")).first()[0]
    return e.where(F.col("loaded_at") > F.lit(cursor) + F.expr("INTERVAL 30 DAY")).select("id", "task_id", "kind")


@query("""SELECT id, json_extract_string(payload, '$.from') AS "from", json_extract_string(payload, '$.to') AS "to" FROM task_events WHERE json_extract_string(payload, '$.to') IS NOT NULL""")
def r10_reply_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays out of replies that wrap them in words and a fence: the fence is stripped, the outermost brackets are read."""
    e = table(spark, sf_dir, "task_events").where(F.get_json_object("payload", "$.to").isNotNull())
    reply = F.concat(F.lit("Here is what you asked for:\n```json\n["), "payload", F.lit("]\n```\nAnything else?"))
    return corpus.reply_items(e.select("id", reply.alias("reply")), "reply", "from string, to string").select("id", "from", "to")


@query("""SELECT e.id, h.tz_name, CASE WHEN e.host IS NULL THEN 'none named' WHEN h.host IS NULL THEN 'missing' ELSE 'found' END AS state FROM executions AS e LEFT JOIN hosts AS h ON e.host = h.host""")
def j20_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's record by the name it gives: found, missing (its user must refuse), or none named."""
    h = table(spark, sf_dir, "hosts").select(F.col("host").alias("h"), "tz_name")
    met = table(spark, sf_dir, "executions").join(h, F.col("host") == F.col("h"), "left")
    return met.select("id", "tz_name", F.when(F.col("host").isNull(), "none named").when(F.col("h").isNull(), "missing").otherwise("found").alias("state"))
