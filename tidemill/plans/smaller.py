"""The smaller operators: shard bookkeeping, set operations, picks, gates and name parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PY_SPACE, pieces_of, py_strip
from ..operators import corpus
from ..sources.tables import table
from .catalog import Catalog
from .curves import over as _over

catalog = Catalog()
QUERIES, SQL, query, relational = catalog.queries, catalog.sql, catalog.query, catalog.relational


def over(name: str, base: str, body: str) -> None:
    """As in the curve queries, registered here."""
    from . import curves

    _over(name, base, body)
    QUERIES[name], SQL[name] = curves.QUERIES.pop(name), curves.SQL.pop(name)


_STRIP = f"regexp_replace(coalesce(text, ''), '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g')"


@query(f"SELECT source, count(*) AS texts, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT source, {_STRIP} AS t FROM documents WHERE source IS NOT NULL) WHERE length(t) > 100 GROUP BY source")
def k04_text_shards(spark: SparkSession, sf_dir: str, done: tuple[str, ...] = ()) -> DataFrame:
    """Texts of the shards still to be written: stripped, over 100 characters; the shards already done are a parameter."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").where(~F.col("source").isin(*done)).select("source", py_strip(F.coalesce("text", F.lit(""))).alias("t"))
    return d.where(F.length("t") > 100).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("t").cast("bigint")).alias("chars"))


relational("t17_end_marks", "SELECT source, count(*) - 1 AS marks FROM documents WHERE text <> '' GROUP BY source")
relational("r03_fallback_chain", "SELECT doc_id, round(coalesce(CASE WHEN n_chars > 0 THEN CAST(n_chars AS DOUBLE) END, CASE WHEN length(text) > 0 THEN CAST(length(text) AS DOUBLE) END, 1.0), 6) AS per_unit FROM documents")
relational("l05_ascending_report", "SELECT r.name, r.v FROM (SELECT c_mktsegment AS name, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY c_mktsegment) AS r WHERE r.v IS NOT NULL ORDER BY r.v, r.name")
relational("l06_newest_loads", "SELECT id FROM task_events ORDER BY loaded_at DESC, id DESC LIMIT 25")


over("l07_last_twenty", "evals", "SELECT run, attempt, step FROM (SELECT *, row_number() OVER (PARTITION BY run, attempt ORDER BY step DESC) AS n FROM evals) AS r WHERE n <= 20")
over("r16_mode_gap", "steps", """SELECT run, CASE WHEN gap > 0.5 THEN 'large' WHEN gap < 0.2 THEN 'small' ELSE 'middle' END AS verdict FROM (SELECT run, abs(avg(avg50) - avg(val)) AS gap FROM steps
WHERE val > 0 AND val < 20 AND avg50 > 0 AND avg50 < 20 GROUP BY run) AS g""")
over("p22_like_for_like", "evals", """WITH a AS (SELECT run, attempt, count(*) AS n, max(step) AS top, min(step) AS low FROM evals GROUP BY run, attempt)
SELECT x.run, x.attempt AS a, y.attempt AS b, x.n = y.n AS same_draws, x.top - x.low = y.top - y.low AS same_span FROM a AS x JOIN a AS y ON x.run = y.run AND y.attempt = x.attempt + 1""")


@query("""SELECT run_stamp, count(*) AS n FROM (SELECT substring(run, length(run) - 11, 6) AS run_stamp FROM (SELECT DISTINCT run FROM loss WHERE run IS NOT NULL) AS r) AS s GROUP BY run_stamp""")
def p20_stem_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month stamps of run names: the last run of twelve digits of the stem."""
    runs = table(spark, sf_dir, "loss").where("run IS NOT NULL").select("run").distinct()
    stamp = F.regexp_extract("run", "([0-9]{12})$", 1)
    return runs.select(F.substring(stamp, 1, 6).alias("run_stamp")).groupBy("run_stamp").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT a.run FROM (SELECT DISTINCT run FROM loss WHERE run IS NOT NULL) AS a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT run FROM loss WHERE run IS NOT NULL) AS b
WHERE b.run <> a.run AND substring(b.run, length(b.run) - 11, 8) = substring(a.run, length(a.run) - 11, 8))""")
def j08_unmatched_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose day stamp no other run has: containment of a stamp of fixed form, so an equality anti join on its day."""
    runs = table(spark, sf_dir, "loss").where("run IS NOT NULL").select("run").distinct().withColumn("day", F.expr("substring(run, length(run) - 11, 8)"))
    alone = runs.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("run")).where("n = 1")
    return alone.select("run")


@query()
def z03_random_crops(spark: SparkSession, sf_dir: str, draws: int = 32, context: int = 512, seed: int = 1) -> DataFrame:
    """Random window offsets per shard; repeatable for a seed, unlike the deterministic windows not comparable across engines."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("n")).where(F.col("n") > context + 1)
    d = n.select("source", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw_ix"))
    return d.select("source", "draw_ix", F.pmod(F.xxhash64("source", "draw_ix", F.lit(seed)), F.col("n") - context - 1).alias("offset"))


@query("""SELECT doc_id, right(hex(encode(text)), CAST(2 * (octet_length(encode(text)) - floor(octet_length(encode(text)) * 0.9::DOUBLE)) AS BIGINT)) AS tail FROM documents WHERE text <> ''""")
def s14_tail_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of every text's bytes, as hex."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    n = F.octet_length("b")
    return d.select("doc_id", F.hex(F.substr("b", (F.floor(n * 0.9) + 1).cast("int"), n)).alias("tail"))


@query("""SELECT to_json({'row_key': CAST(e.id AS VARCHAR), 'reason': 'missing'}) AS finding FROM task_events e LEFT JOIN (SELECT DISTINCT id FROM tasks) t ON e.task_id = t.id
WHERE t.id IS NULL AND e.task_id IS NOT NULL AND trim(e.task_id) <> ''""")
def k11_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON lines, ready for a text sink."""
    from ..operators import references

    found = references.orphans(table(spark, sf_dir, "task_events"), "id", "task_id", table(spark, sf_dir, "tasks"), "id", "task_events").where("reason = 'missing'")
    return found.select(F.to_json(F.struct("row_key", "reason")).alias("finding"))


@query()
def g07_newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest files of a tree with their sizes in MB and kind."""
    from ..sources.tokenfiles import file_table

    files = file_table(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.round(F.col("n_bytes") / 1048576, 1).alias("size_mb"), "modified_at")
    return files.orderBy(F.desc("modified_at"), "name").limit(25).select("name", "size_mb", F.when(F.contains("name", F.lit("_best")), "best").otherwise("step").alias("kind"))
