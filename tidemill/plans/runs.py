"""Runs beside their earlier attempts, checkpoints and logs: pairs, guards, findings, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curves, offsets, registry
from ..operators.curves import CURVE
from ..sources import tokenfiles
from ..sources.tables import table
from .catalog import Catalog
from .curves import _EVALS, _KEPT, _STEPS

catalog = Catalog()
QUERIES, SQL, query, relational = catalog.queries, catalog.sql, catalog.query, catalog.relational


def _loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loss")


# Pairs by position: each attempt of a run against the attempt before it


_PAIRS = f"""{_EVALS}, pairs AS (SELECT a.run, b.attempt, a.ix, a.v AS a, b.v AS b FROM evals a JOIN evals b ON a.run = b.run AND b.attempt = a.attempt + 1 AND a.ix = b.ix),
stats AS (SELECT run, attempt, count(*) AS n, avg(b - a) AS mean, stddev_samp(b - a) AS sd FROM pairs GROUP BY run, attempt HAVING count(*) > 1)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def j13_paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.paired_attempts(curves.evaluations(_loss(spark, sf_dir)))


@query(f"""WITH {_PAIRS} SELECT run, attempt, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(sd / sqrt(n), 9) AS se, round(mean - 1.96 * sd / sqrt(n), 9) AS low, round(mean + 1.96 * sd / sqrt(n), 9) AS high FROM stats""")
def a17_paired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, error and 95 % interval of the differences."""
    s = curves.pair_statistics(curves.paired_attempts(curves.evaluations(_loss(spark, sf_dir))))
    return s.select("run", "attempt", "n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "se", "low", "high")])


@query(f"""WITH {_PAIRS} SELECT run, attempt, CASE WHEN abs(mean) <= 0.005 THEN 'same' WHEN abs(mean) <= 1.96 * sd / sqrt(n) THEN 'undecided' WHEN mean > 0 THEN 'worse' ELSE 'better' END AS verdict FROM stats""")
def a18_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mean difference: within the tolerance, beyond it but not beyond chance, or beyond both."""
    s = curves.pair_statistics(curves.paired_attempts(curves.evaluations(_loss(spark, sf_dir))))
    size = F.abs("mean")
    return s.select("run", "attempt", F.when(size <= 0.005, "same").when(size <= 1.96 * F.col("se"), "undecided").when(F.col("mean") > 0, "worse").otherwise("better").alias("verdict"))


@query()
def a20_block_bootstrap(spark: SparkSession, sf_dir: str, resamples: int = 4000, regions: int = 16) -> DataFrame:
    """95 % interval of a curve's mean from 4,000 resamples of its 16 contiguous regions, drawn by hash."""
    return curves.block_bootstrap(curves.evaluations(_loss(spark, sf_dir)), resamples, regions)


# Guards and findings


@query(f"""WITH {_STEPS}, c AS (SELECT run, attempt, step, served_bpb, random_train_bpb FROM steps WHERE served_bpb IS NOT NULL OR random_train_bpb IS NOT NULL),
p AS (SELECT run, attempt, step, 'served' AS side, coalesce(served_bpb < random_train_bpb - 0.03, false) AS hit FROM c UNION ALL SELECT run, attempt, step, 'random', coalesce(random_train_bpb < served_bpb - 0.03, false) FROM c)
SELECT run, attempt, side, step, hit, step >= 100 AND hit AND coalesce(lag(hit AND step >= 100) OVER (PARTITION BY run, attempt, side ORDER BY step), false) AS trips FROM p""")
def w10_recycling_tripwire(spark: SparkSession, sf_dir: str, margin: float = 0.03) -> DataFrame:
    """Every check of the tripwire: does the served buffer (and, as a control, a random crop) beat the other by more than the margin,
    twice in a row from step 100 on?"""
    s = curves.step_rows(_loss(spark, sf_dir), ["served_bpb", "random_train_bpb"]).where("served_bpb IS NOT NULL OR random_train_bpb IS NOT NULL")
    a, b = F.col("served_bpb"), F.col("random_train_bpb")
    return curves.tripwire(s, {"served": (a, b), "random": (b, a)}, margin)


@query(f"""WITH {_KEPT}, f AS (SELECT run, attempt, step, unnest(['train', 'val', 'val_bpb']) AS field, unnest([train, val, val_bpb]) AS v FROM kept WHERE kind = 'step')
SELECT run, attempt, step, field AS finding FROM f WHERE v IS NOT NULL AND NOT (v > 0 AND v < 20 AND NOT isnan(v))
UNION ALL SELECT run, attempt, step, 'early_stop without best' FROM kept WHERE kind = 'early_stop' AND (step IS NULL OR best_val IS NULL OR best_bpb IS NULL)""")
def p24_value_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside 0 to 20, and early stops that don't say what the best was."""
    k = curves.kept_rows(_loss(spark, sf_dir), ["train", "val", "val_bpb", "best_val", "best_bpb"])
    bad = lambda c: F.col(c).isNotNull() & ~((F.col(c) > 0) & (F.col(c) < 20) & ~F.isnan(c))
    of_step = F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in ("train", "val", "val_bpb")]))
    short = F.col("step").isNull() | F.col("best_val").isNull() | F.col("best_bpb").isNull()
    found = F.when(F.col("kind") == "step", of_step).when((F.col("kind") == "early_stop") & short, F.array(F.lit("early_stop without best")))
    return k.select("run", "attempt", "step", F.explode(found).alias("finding"))


@query(f"""WITH {_KEPT} SELECT run, count(*) - count(DISTINCT (attempt, step)) AS repeated_steps, count(val) - count(DISTINCT CASE WHEN val IS NOT NULL THEN step END) AS repeated_checks,
count(DISTINCT (val IS NULL, gnorm IS NULL, lmax IS NULL, lstd IS NULL, ent IS NULL, tval IS NULL, served IS NULL)) AS schemas FROM kept WHERE kind = 'step' AND step IS NOT NULL GROUP BY run""")
def a16_schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: steps and held-out checks that occur again, and how many sets of filled columns its rows have."""
    optional = ["val", "gnorm", "lmax", "lstd", "ent", "tval", "served"]
    s = curves.step_rows(_loss(spark, sf_dir), optional)
    shape = F.concat(*[F.col(c).isNull().cast("string") for c in optional])
    one = s.groupBy("run", "step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("attempt").alias("a"), F.count("val").alias("checks"), F.collect_set(shape).alias("shapes"))
    return one.groupBy("run").agg(
        F.sum(F.col("n") - F.col("a")).alias("repeated_steps"), F.sum(F.greatest(F.col("checks") - 1, F.lit(0))).alias("repeated_checks"), F.size(F.array_distinct(F.flatten(F.collect_set("shapes")))).cast("bigint").alias("schemas")
    )


# Logs


@query(f"""WITH {_STEPS} SELECT run, attempt, step, 40000 AS horizon, round(val, 6) AS val, round(val_bpb, 6) AS bpb FROM steps WHERE val IS NOT NULL AND val_bpb IS NOT NULL AND NOT isnan(val_bpb) AND abs(val_bpb) < 1000""")
def s12_console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console lines, as a run prints them (``step N/T  val=...  bpb=...``), scraped again."""
    s = curves.step_rows(_loss(spark, sf_dir), ["val", "val_bpb"]).where("val IS NOT NULL AND val_bpb IS NOT NULL AND NOT isnan(val_bpb) AND abs(val_bpb) < 1000")
    lines = s.select(*CURVE, F.format_string("step %d/%d  val=%s  bpb=%s  29966 tok/s", "step", F.lit(40000), F.round("val", 6).cast("string"), F.round("val_bpb", 6).cast("string")).alias("line"))
    return tokenfiles.log_scrape(lines).select(*CURVE, "step", "horizon", "val", "bpb")


@query("""WITH l AS (SELECT file_name, line_no, line, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file_name ORDER BY line_no DESC) AS upto FROM (SELECT file_name, line_no, min(line) AS line FROM loss_lines WHERE file_name IS NOT NULL AND line IS NOT NULL GROUP BY 1, 2)),
m AS (SELECT file_name, line_no, try_cast(regexp_extract(line, '"step" *: *([0-9]+)', 1) AS BIGINT) AS step FROM l WHERE upto <= 65536) SELECT file_name, max_by(step, line_no) AS last_step FROM m WHERE step IS NOT NULL GROUP BY file_name""")
def s13_last_step(spark: SparkSession, sf_dir: str, tail: int = 65_536) -> DataFrame:
    """The last step that the last 64 KiB of each log name; the lines before them are not looked at."""
    lines = table(spark, sf_dir, "loss_lines").where("file_name IS NOT NULL AND line IS NOT NULL").groupBy("file_name", "line_no").agg(F.min("line").alias("line"))
    sized = lines.withColumn("from_end", -F.col("line_no").cast("bigint")).withColumn("n", F.octet_length("line").cast("bigint") + 1)
    last = offsets.running_total(sized, "from_end", F.col("n"), ["file_name"]).where(F.col("before") + F.col("n") <= tail)
    named = last.withColumn("step", F.regexp_extract("line", '"step" *: *([0-9]+)', 1).try_cast("bigint")).where("step IS NOT NULL")
    return named.groupBy("file_name").agg(F.max_by("step", "line_no").alias("last_step"))


@query("""SELECT producer, file_seq, line_no, CASE WHEN json_extract(body, '$.args') IS NOT NULL THEN 'header' WHEN json_extract(body, '$.early_stop') IS NOT NULL THEN 'early_stop' ELSE 'step' END AS kind FROM loss_file_records
WHERE (line_no = 1 AND json_extract(body, '$.args') IS NOT NULL) OR json_extract(body, '$.early_stop') IS NOT NULL OR (json_extract_string(body, '$.step') IS NOT NULL AND json_extract_string(body, '$.train') IS NOT NULL AND json_extract(body, '$.args') IS NULL)""")
def p12_row_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that count: step rows with a train value, early stops, and a header only as a file's first line."""
    r = table(spark, sf_dir, "loss_file_records")
    has = lambda k: F.get_json_object("body", f"$.{k}").isNotNull()
    kind = F.when(has("args"), F.when(F.col("line_no") == 1, "header")).when(has("early_stop"), "early_stop").when(has("step") & has("train"), "step")
    return r.select("producer", "file_seq", "line_no", kind.alias("kind")).where("kind IS NOT NULL")


# Checkpoints and identities


@query(f"""WITH {_KEPT}, f AS (SELECT run, max(attempt) AS a FROM kept WHERE run IS NOT NULL GROUP BY run), fl AS (SELECT k.run, min(delivered_at) AS since FROM kept k JOIN f ON k.run = f.run AND k.attempt = f.a GROUP BY k.run)
SELECT k.run, max(step) AS newest FROM kept k JOIN fl ON k.run = fl.run WHERE kind IN ('chunk_complete', 'throughput') AND step IS NOT NULL AND delivered_at >= since AND regexp_matches(k.run, '_[0-9]{{12}}$') GROUP BY k.run""")
def j16_newest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The furthest saved step of each run, of files that bear the run's stamp and are not older than its last start. Rows of a run are
    never gathered: the start is a minimum per attempt, then joined."""
    k = curves.kept_rows(_loss(spark, sf_dir).where("run IS NOT NULL"), ["delivered_at"]).where(F.col("run").rlike("_[0-9]{12}$"))
    starts = k.groupBy("run", "attempt").agg(F.min("delivered_at").alias("since"), F.max(F.when(F.col("kind").isin("chunk_complete", "throughput"), F.struct("delivered_at", "step"))).alias("x"))
    last = starts.groupBy(F.col("run").alias("r")).agg(F.max_by("since", "attempt").alias("since"))
    saved = k.where(F.col("kind").isin("chunk_complete", "throughput") & F.col("step").isNotNull())
    return saved.join(last, (F.col("run") == F.col("r")) & (F.col("delivered_at") >= F.col("since"))).groupBy("run").agg(F.max("step").alias("newest"))


#: Tokens of one reference step, and the step of an unversioned snapshot.
REFERENCE_TOKENS, FINAL_STEP = 2_097_152, 143_000


@query(f"""WITH {_KEPT}, n AS (SELECT DISTINCT run || CASE WHEN kind = 'chunk_complete' THEN '_step' || step ELSE '' END AS name FROM kept WHERE run IS NOT NULL)
SELECT name, coalesce(try_cast(regexp_extract(name, 'step([0-9]+)', 1) AS BIGINT), 143000) * 2097152 AS tokens FROM n WHERE name IS NOT NULL""")
def r01_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a snapshot has seen, by the step in its name; without one it is the final snapshot."""
    k = curves.kept_rows(_loss(spark, sf_dir).where("run IS NOT NULL"), [])
    names = k.select(F.concat("run", F.when(F.col("kind") == "chunk_complete", F.concat(F.lit("_step"), F.col("step").cast("string"))).otherwise("")).alias("name")).distinct()
    step = F.coalesce(F.regexp_extract("name", "step([0-9]+)", 1).try_cast("bigint"), F.lit(FINAL_STEP))
    return names.where("name IS NOT NULL").select("name", (step * REFERENCE_TOKENS).alias("tokens"))


@query("""WITH l AS (SELECT split_part(run, '_', 2) AS arm, run, min(delivered_at) AS first_seen FROM loss WHERE run IS NOT NULL GROUP BY run)
SELECT arm, max_by(run, (first_seen, run)) AS pinned, list_sort(list(run)) AS run_dirs FROM l GROUP BY arm""")
def r08_last_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm pinned to the run that started last, which joins the arm's runs if it is not among them."""
    runs = _loss(spark, sf_dir).where("run IS NOT NULL").groupBy("run").agg(F.min("delivered_at").alias("first_seen")).withColumn("arm", F.element_at(F.split("run", "_"), 2))
    d = runs.groupBy("arm").agg(F.max_by("run", F.struct("first_seen", "run")).alias("pinned"), F.collect_set("run").alias("known"))
    return d.select("arm", "pinned", F.array_sort(F.array_union("known", F.array("pinned"))).alias("run_dirs"))


@query("""WITH b AS (SELECT (min(batch_id) + max(batch_id)) // 2 AS half FROM loss), s AS (SELECT run, count_if(batch_id <= half) AS n0, max(CASE WHEN batch_id <= half THEN delivered_at END) AS t0, count(*) AS n1, max(delivered_at) AS t1 FROM loss, b WHERE run IS NOT NULL GROUP BY run)
SELECT run, CASE WHEN n0 = 0 THEN 'new' WHEN n0 = n1 AND t0 = t1 THEN 'unchanged' ELSE 'changed' END AS state FROM s""")
def x02_changed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose signature (rows, newest row) after all batches differs from the one after half of them: only these are derived anew."""
    loss = _loss(spark, sf_dir).where("run IS NOT NULL")
    r = _loss(spark, sf_dir).agg(F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).first()
    early = F.col("batch_id") <= (0 if r.a is None else (r.a + r.b) // 2)
    s = loss.groupBy("run").agg(F.count_if(early).alias("n0"), F.max(F.when(early, F.col("delivered_at"))).alias("t0"), F.count(F.lit(1)).alias("n1"), F.max("delivered_at").alias("t1"))
    return s.select("run", F.when(F.col("n0") == 0, "new").when((F.col("n0") == F.col("n1")) & (F.col("t0") == F.col("t1")), "unchanged").otherwise("changed").alias("state"))


@query("""WITH c AS (SELECT l_suppkey AS arm, list(DISTINCT l_partkey) AS claims FROM lineitem GROUP BY l_suppkey), u AS (SELECT arm, unnest(claims) AS part FROM c)
SELECT part, count(*) AS owners FROM u GROUP BY part HAVING count(*) > 1""")
def j07_duplicate_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is claimed by more than one owner, of owners with lists of claims; claims are pairs, so no owner's list is ever gathered."""
    claims = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("part")).distinct()
    return claims.groupBy("part").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


_RUN_KEYS = "run, attempt, kind, step, train, avg50, val, val_bpb, lr, gnorm, lmax, served_bpb, random_train_bpb, best_val, best_bpb, tok_per_sec, peak_mem_mb, schedule_steps"


@query(f"SELECT {_RUN_KEYS} FROM loss WHERE kind <> 'step'")
def p17_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighteen keys of a run's summary rows; no other column is read."""
    return _loss(spark, sf_dir).where("kind <> 'step'").select(*_RUN_KEYS.split(", "))


_KEEP = """ck AS (SELECT run AS family, step, count(*) AS n FROM (SELECT DISTINCT run, attempt, step FROM loss WHERE step IS NOT NULL AND run IS NOT NULL AND kind = 'step') GROUP BY run, step),
k AS (SELECT family, step FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY step DESC) AS r FROM ck) WHERE r <= 3 UNION SELECT family, step FROM ck WHERE step % 5000 = 0)"""


@query(f"WITH {_KEEP} SELECT family, count(*) AS dropped, min(step) AS first_step, max(step) AS last_step FROM (SELECT family, step FROM ck EXCEPT SELECT family, step FROM k) GROUP BY family")
def u06_drop_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to drop per family: all less those to keep (the last three, every five-thousandth). The last three come from an
    aggregate of the largest steps, not from a window over the family."""
    all_steps = _loss(spark, sf_dir).where("step IS NOT NULL AND run IS NOT NULL AND kind = 'step'").select(F.col("run").alias("family"), "step").distinct()
    keep = registry.largest(all_steps, "family", "step", 3).unionByName(all_steps.where("step % 5000 = 0"))
    return all_steps.join(keep.distinct(), ["family", "step"], "left_anti").groupBy("family").agg(F.count(F.lit(1)).alias("dropped"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("""SELECT source, i AS draw_ix, CAST(floor(((i * 0.6180339887::DOUBLE) - floor(i * 0.6180339887::DOUBLE)) * (n - 513)) AS BIGINT) AS "offset" FROM (SELECT source, sum(octet_length(encode(coalesce(text, '')))) AS n FROM documents GROUP BY source), (SELECT unnest(range(64)) AS i) WHERE n > 513""")
def z04_fixed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of 64 places between 0 and 1, drawn once and used for every shard, so all are measured at the same places."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("n")).where("n > 513")
    draws = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("draw_ix"), (i * F.lit(0.6180339887) - F.floor(i * F.lit(0.6180339887))).alias("u")))
    return n.select("source", "n", F.inline(draws)).select("source", "draw_ix", F.floor(F.col("u") * (F.col("n") - 513)).alias("offset"))
