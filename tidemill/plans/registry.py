"""Arms, ownership, reconciliation and retention over the run and shard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry
from ..sources.tables import table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query, relational = catalog.queries, catalog.sql, catalog.query, catalog.relational

_ARMS = f"""h AS (SELECT producer, file_seq, first(body ORDER BY rec_id) AS body FROM loss_file_records WHERE json_extract(body, '$.args') IS NOT NULL GROUP BY 1, 2),
k AS (SELECT producer, file_seq, unnest(json_keys(body, '$.args')) AS key, body FROM h),
kv AS (SELECT producer, file_seq, key, json_extract_string(body, '$.args.' || key) AS v FROM k),
eff AS (SELECT producer, file_seq, 'eff_batch' AS key, CAST(try_cast(max(CASE WHEN key = 'batch' THEN v END) AS BIGINT) * coalesce(nullif(try_cast(max(CASE WHEN key = 'accum' THEN v END) AS BIGINT), 0), 1) AS VARCHAR) AS v
FROM kv GROUP BY 1, 2 HAVING max(CASE WHEN key = 'batch' THEN v END) IS NOT NULL),
voc AS (SELECT producer, file_seq, 'vocab' AS key, string_split(coalesce(v, ''), '/')[-1] AS v FROM kv WHERE key = 'tokenizer'),
norm AS (SELECT * FROM kv WHERE key NOT IN ('batch', 'accum', 'tokenizer', 'tok_cache') UNION ALL SELECT * FROM eff UNION ALL SELECT * FROM voc),
prev AS (SELECT producer, file_seq, lag(file_seq) OVER (PARTITION BY producer ORDER BY file_seq) AS control_seq FROM h),
keys AS (SELECT p.producer, p.file_seq, p.control_seq, n.key FROM prev p JOIN norm n ON n.producer = p.producer AND n.file_seq IN (p.file_seq, p.control_seq) WHERE p.control_seq IS NOT NULL GROUP BY ALL),
diff AS (SELECT k.producer, k.file_seq, k.key FROM keys k LEFT JOIN norm a ON a.producer = k.producer AND a.file_seq = k.file_seq AND a.key = k.key
LEFT JOIN norm b ON b.producer = k.producer AND b.file_seq = k.control_seq AND b.key = k.key WHERE a.v IS DISTINCT FROM b.v AND k.key NOT IN ({", ".join(f"'{x}'" for x in registry.NON_LEVER)}))"""


@query(f"WITH {_ARMS} SELECT producer, file_seq, key FROM diff")
def u03_lever_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = registry.arms(table(spark, sf_dir, "loss_file_records")).where("control_seq IS NOT NULL")
    return d.select("producer", "file_seq", F.explode(registry.lever_names(registry.normal_args(F.col("args")), registry.normal_args(F.col("control_args")))).alias("key"))


@query(f"WITH {_ARMS} SELECT producer, file_seq, key, try_cast(v AS DOUBLE) AS number, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END AS word FROM norm")
def p16_normal_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header's settings in their normal form, one row a setting."""
    h = registry.header_args(table(spark, sf_dir, "loss_file_records"))
    d = h.select("producer", "file_seq", F.explode(registry.normal_args(F.col("args"))).alias("key", "v")).withColumn("number", F.col("v").try_cast("double"))
    return d.select("producer", "file_seq", "key", "number", F.when(F.col("number").isNull(), F.col("v")).alias("word"))


@query(f"""WITH {_ARMS} SELECT p.producer, p.file_seq, p.control_seq, try_cast(a.v AS DOUBLE) AS lr, try_cast(b.v AS DOUBLE) AS control_lr FROM prev p LEFT JOIN norm a ON a.producer = p.producer AND a.file_seq = p.file_seq AND a.key = 'lr'
LEFT JOIN norm b ON b.producer = p.producer AND b.file_seq = p.control_seq AND b.key = 'lr'""")
def j05_arm_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm, its control, and one setting of the newest header of either."""
    d = registry.arms(table(spark, sf_dir, "loss_file_records"))
    return d.select("producer", "file_seq", "control_seq", F.col("args")["lr"].try_cast("double").alias("lr"), F.col("control_args")["lr"].try_cast("double").alias("control_lr"))


@query(f"""WITH {_ARMS}, t AS (SELECT p.producer, p.file_seq, count(d.key) AS touched, coalesce(count_if(d.key NOT IN ('lr', 'eff_batch')), 0) AS undeclared, 2 - coalesce(count_if(d.key IN ('lr', 'eff_batch')), 0) AS unchanged
FROM prev p LEFT JOIN diff d ON p.producer = d.producer AND p.file_seq = d.file_seq WHERE p.control_seq IS NOT NULL GROUP BY 1, 2) SELECT *, touched > 1 AS confounded FROM t""")
def u04_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = registry.verdicts(registry.arms(table(spark, sf_dir, "loss_file_records")).where("control_seq IS NOT NULL"))
    return v.select("producer", "file_seq", *[F.size(c).cast("bigint").alias(c) for c in ("touched", "undeclared", "unchanged")], "confounded")


relational("j06_unregistered", "SELECT DISTINCT e.job_id FROM executions AS e LEFT JOIN jobs AS j ON e.job_id = j.id WHERE j.id IS NULL AND e.job_id IS NOT NULL")
relational("j06_phantom", "SELECT DISTINCT j.id FROM jobs AS j LEFT JOIN executions AS e ON e.job_id = j.id WHERE e.job_id IS NULL AND j.id IS NOT NULL")

# Claimed and actual: order headers against their lines.


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS grp, l_linenumber AS ix FROM lineitem), o AS (SELECT grp, ix, ix - row_number() OVER (PARTITION BY grp ORDER BY ix) AS island FROM d)
SELECT grp, 0 AS part, min(ix) AS first_ix, max(ix) AS last_ix, count(*) AS n FROM o GROUP BY grp, island""")
def w17_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("ix")).distinct()
    return registry.islands(rows)


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS grp, l_linenumber AS ix, min(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) >= 10 AS present FROM lineitem),
g AS (SELECT grp, min(CASE WHEN NOT present THEN ix END) AS gap FROM d GROUP BY grp) SELECT d.grp, count(*) AS kept FROM d JOIN g ON d.grp = g.grp WHERE gap IS NULL OR ix < gap GROUP BY d.grp""")
def w20_adopt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("ix")).agg((F.min("l_quantity") >= 10).alias("present"))
    return registry.longest_prefix(rows, F.col("present")).groupBy("grp").agg(F.count(F.lit(1)).alias("kept"))


_CKPT = """ck AS (SELECT run AS family, step, CASE WHEN min(kind) = 'chunk_complete' THEN 'chunk' ELSE 'step' END AS kind, count(*) * 1048576 AS n_bytes
FROM (SELECT DISTINCT run, attempt, kind, step FROM loss WHERE step IS NOT NULL AND kind IN ('step', 'chunk_complete')) WHERE run IS NOT NULL GROUP BY run, step)"""


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = table(spark, sf_dir, "loss").where("step IS NOT NULL AND run IS NOT NULL AND kind IN ('step', 'chunk_complete')").select("run", "attempt", "kind", "step").distinct()
    files = loss.groupBy(F.col("run").alias("family"), "step").agg(F.when(F.min("kind") == "chunk_complete", "chunk").otherwise("step").alias("kind"), (F.count(F.lit(1)) * 1048576).alias("n_bytes"))
    return registry.retention(files.withColumn("keeper", F.lit(False)), 3, 5000)


_KEEP = f"""{_CKPT}, kept AS (SELECT *, kind <> 'step' OR row_number() OVER (PARTITION BY family ORDER BY step DESC NULLS LAST, kind) <= 3 OR step % 5000 = 0 AS keep FROM ck)"""


@query(f"WITH {_KEEP} SELECT family, step, kind FROM kept WHERE keep")
def p21_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).where("keep").select("family", "step", "kind")


@query(f"WITH {_KEEP} SELECT family, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM kept WHERE NOT keep GROUP BY family ORDER BY n_bytes DESC, family LIMIT 6")
def a25_retention_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).where("NOT keep").groupBy("family").agg(F.sum("n_bytes").alias("n_bytes")).orderBy(F.desc("n_bytes"), "family").limit(6)


@query("""SELECT keyset, count(*) AS n FROM (SELECT array_to_string(list_sort(json_keys(body)), ',') AS keyset FROM loss_file_records WHERE json_valid(body)) GROUP BY keyset""")
def s08_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema drift as distinct key sets of the raw rows."""
    keys = F.array_sort(F.expr("json_object_keys(body)"))
    return table(spark, sf_dir, "loss_file_records").select(F.array_join(keys, ",").alias("keyset")).where("keyset IS NOT NULL").groupBy("keyset").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, 'rows' AS label, count(*) > 0 AS ok FROM documents GROUP BY source UNION ALL SELECT source, 'unique ids', count(*) = count(DISTINCT doc_id) FROM documents GROUP BY source
UNION ALL SELECT source, 'no stale lengths', count_if(n_chars IS DISTINCT FROM coalesce(length(text), 0)) = 0 FROM documents GROUP BY source""")
def r14_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks, one row each, in one pass."""
    d = table(spark, sf_dir, "documents").groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("n_chars").eqNullSafe(F.coalesce(F.length("text"), F.lit(0)))).alias("stale"))
    d = d.groupBy("source").agg((F.sum("c") > 0).alias("rows"), (F.max("c") == 1).alias("unique ids"), (F.sum("stale") == 0).alias("no stale lengths"))
    return d.unpivot("source", ["rows", "unique ids", "no stale lengths"], "label", "ok")


@query("""WITH a AS (SELECT id, max(loaded_at) AS at FROM tasks GROUP BY id) SELECT t.id, max(t.status) AS status FROM tasks t JOIN a ON t.id = a.id AND t.loaded_at = a.at GROUP BY t.id""")
def r11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace-or-append by key: the newest load of each id (ties: the larger status)."""
    t = table(spark, sf_dir, "tasks").where("id IS NOT NULL AND loaded_at IS NOT NULL")
    return t.groupBy("id").agg(F.max(F.struct("loaded_at", "status")).alias("m")).select("id", F.col("m.status").alias("status"))


