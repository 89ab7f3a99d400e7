"""Run-log queries over the ``loss`` table: harvest, audit, best values, ordered rules, leaderboards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curves, offsets
from ..operators.curves import CURVE
from ..sources.tables import table
from .catalog import Catalog, statement

catalog = Catalog()
QUERIES, SQL, query = catalog.queries, catalog.sql, catalog.query

_KEPT = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, attempt, kind, step ORDER BY delivered_at, row_id) AS copy_no FROM loss) AS c WHERE copy_no = 1 OR step IS NULL)"""
_STEPS = _KEPT + ", steps AS (SELECT * FROM kept WHERE kind = 'step' AND step IS NOT NULL)"
_EVALS = _STEPS + """, evals AS (SELECT run, attempt, step, val_bpb AS v, row_number() OVER (PARTITION BY run, attempt ORDER BY step) - 1 AS ix
FROM steps WHERE val_bpb IS NOT NULL AND NOT isnan(val_bpb) AND abs(val_bpb) < CAST('Infinity' AS DOUBLE))"""
_SHARED = {"kept": curves.kept_rows, "steps": curves.step_rows}


def over(name: str, base: str, body: str) -> None:
    """A relational query over the kept rows, the step rows or the evaluations of ``loss``; the Spark side takes that relation
    from the operator, the twin from its own definition."""
    prefix = {"kept": _KEPT, "steps": _STEPS, "evals": _EVALS}[base]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        loss = table(spark, sf_dir, "loss")
        used = [c for c in loss.columns if re.search(rf"\b{c}\b", body)]
        rows = curves.evaluations(loss) if base == "evals" else _SHARED[base](loss, used)
        return statement(spark, sf_dir, body, **{base: rows})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"WITH {prefix} " + (body.replace("WITH ", ", ", 1) if body.startswith("WITH ") else body)


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.evaluations(table(spark, sf_dir, "loss"))


over("s07_run_harvest", "kept", """SELECT run, attempt, step, train, val_bpb, kind FROM kept WHERE (kind = 'step' AND step IS NOT NULL AND train IS NOT NULL) OR kind = 'early_stop'""")
over(
    "s08_curve_audit",
    "kept",
    """SELECT run, count(*) AS n_rows, count(DISTINCT kind) AS kinds, sum(CASE WHEN step IS NULL THEN 1 ELSE 0 END) AS without_step, min(step) AS first_step, max(step) AS last_step,
    sum(CASE WHEN kind = 'step' AND val IS NOT NULL THEN 1 ELSE 0 END) AS val_checks, count(DISTINCT attempt) AS attempts FROM kept GROUP BY run""",
)
over("p13_truthy_values", "steps", "SELECT run, attempt, count(*) AS n FROM steps WHERE val_bpb IS NOT NULL AND val_bpb <> 0 GROUP BY run, attempt")
over("p14_comparable", "evals", "SELECT run, best, best_step FROM (SELECT run, v AS best, step AS best_step, row_number() OVER (PARTITION BY run ORDER BY v, attempt, step) AS n FROM evals) AS r WHERE n = 1 AND best_step >= 1000")
over("a14_best", "evals", "SELECT run, attempt, v AS best_bpb, step AS best_step FROM (SELECT *, row_number() OVER (PARTITION BY run, attempt ORDER BY v, step) AS n FROM evals) AS r WHERE n = 1")
over("a16_repeated_steps", "steps", "SELECT run, step, count(*) AS attempts FROM steps GROUP BY run, step HAVING count(*) > 1")
over("w01_lag_change", "evals", "SELECT run, attempt, step, round(abs(v - lag(v) OVER (PARTITION BY run, attempt ORDER BY step)), 9) AS change FROM evals")


@query(
    f"""WITH {_EVALS}, c AS (SELECT run, attempt, abs(v - lag(v) OVER (PARTITION BY run, attempt ORDER BY step)) AS change FROM evals),
r AS (SELECT *, row_number() OVER (PARTITION BY run, attempt ORDER BY change) - 1 AS rn, count(*) OVER (PARTITION BY run, attempt) AS n FROM c WHERE change IS NOT NULL)
SELECT run, attempt, max(n) AS n, round(CASE WHEN max(n) % 2 = 1 THEN max(CASE WHEN rn = n // 2 THEN change END) ELSE (max(CASE WHEN rn = n // 2 - 1 THEN change END) + max(CASE WHEN rn = n // 2 THEN change END)) / 2 END, 9) AS median,
round(max(CASE WHEN rn = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) THEN change END), 9) AS p90, round(max(change), 9) AS largest FROM r GROUP BY run, attempt"""
)
def a30_noise_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.noise_band(_evals(spark, sf_dir))


@query()
def w02_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence kept as avg50, recomputed; checked against a row-by-row loop in the tests."""
    return curves.smoothed(curves.step_rows(table(spark, sf_dir, "loss"), ["train"]), "train")


over("w03_last_eight", "evals", "SELECT run, attempt, step, count(v) OVER w AS held, round(avg(v) OVER w, 9) AS mean_of_last FROM evals WINDOW w AS (PARTITION BY run, attempt ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")


@query()
def w04_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value, strikes since, and the step at which ten strikes in a row end the curve."""
    return curves.strikes(curves.series(_evals(spark, sf_dir)), F.lit(10)).select(*CURVE, "best", "strikes", "stop_step")


@query()
def w05_cycle_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.cycle_lengths(curves.series(_evals(spark, sf_dir))).select(*CURVE, F.size("vs").alias("n"), "period")


@query()
def w06_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.envelope(curves.series(_evals(spark, sf_dir))).select(*CURVE, "period", F.posexplode("means").alias("round", "mean"))


@query(f"WITH {_EVALS} SELECT run, attempt, ix // 5 AS block, min(v) AS low, max(step) - min(step) AS span FROM evals GROUP BY 1, 2, 3 HAVING count(*) = 5")
def w07_block_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.block_statistic(_evals(spark, sf_dir), 5, F.min, "low")


@query(f"WITH {_EVALS} SELECT run, attempt, ix // 4 AS block, round(avg(v), 9) AS mean, max(step) - min(step) AS span FROM evals GROUP BY 1, 2, 3 HAVING count(*) = 4")
def w25_block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.block_statistic(_evals(spark, sf_dir), 4, lambda v: F.round(F.avg(v), 9), "mean")


@query()
def w08_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.stalled(curves.series(_evals(spark, sf_dir)), "stalled", 0.005, F.element_at("steps", -1), 0.25, 100).select(*CURVE, "stalled")


@query()
def w09_flat_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at("steps", -1)
    return curves.flat_stop(curves.series(_evals(spark, sf_dir)), "stop", 0.005, last, last, 0.25, 100, 1000).select(*CURVE, "stop")


over("w11_degrade_guard", "evals", "SELECT run, attempt, step FROM (SELECT *, min(v) OVER (PARTITION BY run, attempt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM evals) AS r WHERE v > best * 1.02")


@query()
def w12_plateau_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patience is a quarter of the curve in checks of a hundred steps."""
    rows = curves.series(_evals(spark, sf_dir)).withColumn("patience", F.greatest(F.lit(1), F.bround(0.25 * F.element_at("steps", -1) / 100).cast("int")))
    return curves.strikes(rows, F.col("patience")).select(*CURVE, "patience", "stop_step")


@query(f"WITH {_EVALS} SELECT run, attempt, step, coalesce(v < before, true) AS is_best FROM (SELECT *, min(v) OVER (PARTITION BY run, attempt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM evals) AS r")
def w13_new_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.running_best(_evals(spark, sf_dir)).select(*CURVE, "step", "is_best")


over(
    "w14_replay_inflation",
    "evals",
    """WITH best AS (SELECT run, step AS best_step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY v, step, attempt) AS n FROM evals) AS r WHERE n = 1)
    SELECT e.run, max(b.best_step) AS best_step, sum(CASE WHEN e.step = b.best_step THEN 1 ELSE 0 END) > 1 AS inflated FROM evals AS e JOIN best AS b ON e.run = b.run GROUP BY e.run""",
)
over(
    "w16_leaderboard",
    "evals",
    """WITH best AS (SELECT run, v AS best_bpb, step AS best_step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY v, step, attempt) AS n FROM evals) AS r WHERE n = 1),
    slices AS (SELECT run, best_bpb, best_step, split_part(run, '_', 3) AS slice FROM best)
    SELECT slice, run, best_bpb, place FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY best_bpb, run) AS place FROM slices) AS p WHERE place <= 6""",
)
over("w22_complete_rounds", "evals", "SELECT run, attempt, block, low, mean FROM (SELECT run, attempt, CAST(floor(ix / 5) AS BIGINT) AS block, min(v) AS low, round(avg(v), 9) AS mean, count(*) AS n, max(step) - min(step) AS span FROM evals GROUP BY run, attempt, CAST(floor(ix / 5) AS BIGINT)) AS b WHERE n = 5 AND span <= 800")
over(
    "w23_ladder_verdict",
    "evals",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run, attempt ORDER BY v, step) AS up, row_number() OVER (PARTITION BY run, attempt ORDER BY step DESC) AS from_end FROM evals)
    SELECT run, attempt, champion, last_v, CASE WHEN last_v - champion <= 0.005 THEN 'artifact' ELSE 'overfit' END AS verdict
    FROM (SELECT run, attempt, max(CASE WHEN up = 1 THEN v END) AS champion, max(CASE WHEN from_end = 1 THEN v END) AS last_v FROM r GROUP BY run, attempt) AS t""",
)
over("w24_milestones", "steps", "WITH last_steps AS (SELECT run, max(step) AS last_step FROM steps GROUP BY run) SELECT run, milestone FROM last_steps CROSS JOIN (VALUES (100), (1000), (10000), (100000)) AS m(milestone) WHERE last_step >= milestone".replace("CROSS JOIN (VALUES (100), (1000), (10000), (100000)) AS m(milestone)", "JOIN (VALUES (100), (1000), (10000), (100000)) AS m(milestone) ON last_step >= milestone").replace(" WHERE last_step >= milestone", ""))
over("w26_lr_schedule", "steps", """SELECT run, attempt, step, round(CASE WHEN step < 500 THEN 0.0006 * (step + 1) / 500 ELSE 0.1 * 0.0006 + 0.9 * 0.0006 * 0.5 * (1 + cos(pi() * (step - 500) / greatest(1, 500000 - 500))) END, 12) AS scheduled FROM steps""")
over("w27_tokens_axis", "steps", "SELECT run, attempt, step, step * 32 * 4 * 512 AS tokens, round(step * 32 * 4 * 512 / CAST(3204328669 AS DOUBLE), 9) AS epochs FROM steps WHERE train IS NOT NULL")
over("j04_last_attempt", "steps", """SELECT s.run, s.attempt AS last_attempt, max(s.step) AS last_step FROM steps AS s JOIN (SELECT run, max(attempt) AS attempt FROM steps GROUP BY run) AS m ON s.run = m.run AND s.attempt = m.attempt GROUP BY s.run, s.attempt""")
over("j14_offset_self_join", "evals", """SELECT a.run, a.attempt, count(*) AS pairs, round(avg(abs(b.v - a.v)), 9) AS mean_change FROM evals AS a JOIN evals AS b ON a.run = b.run AND a.attempt = b.attempt AND b.step = a.step + 1000 GROUP BY a.run, a.attempt""")
over("j17_newest_of_family", "steps", """SELECT family, run, last_step FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY last_step DESC, run) AS n FROM (SELECT run, split_part(run, '_', 2) AS family, max(step) AS last_step FROM steps GROUP BY run) AS f) AS r WHERE n = 1""")
over("r06_progress", "kept", "SELECT run, greatest(max(CASE WHEN kind = 'step' THEN step END), max(CASE WHEN kind = 'chunk_complete' THEN step END)) AS progress FROM kept GROUP BY run")
over("r07_run_family", "kept", "SELECT DISTINCT run, regexp_replace(run, '_[0-9]{12}$', '') AS family FROM kept")
over("r19_throughput", "kept", "SELECT run, count(*) AS windows, round(avg(tok_per_sec), 6) AS tok_per_sec, round(max(peak_mem_mb), 6) AS peak_mem_mb FROM kept WHERE kind = 'throughput' GROUP BY run")
over("r13_quiet_runs", "steps", """WITH l AS (SELECT run, attempt, max(delivered_at) AS newest FROM steps GROUP BY run, attempt)
    SELECT run, min(CASE WHEN newest < (SELECT max(newest) FROM l) - INTERVAL 1 HOUR THEN 1 ELSE 0 END) = 1 AS quiet FROM l GROUP BY run""")
over("p19_run_name", "kept", "SELECT DISTINCT run, split_part(run, '_', 1) AS experiment, regexp_extract(run, '_([0-9]{12})$', 1) AS stamp FROM kept")
over("a19_regions", "evals", "SELECT run, attempt, part_no, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd FROM (SELECT *, ntile(16) OVER (PARTITION BY run, attempt ORDER BY step) AS part_no FROM evals) AS r GROUP BY run, attempt, part_no")
over("a21_sample_size", "evals", "SELECT run, count(*) AS n, CAST(ceil(power(1.96 * stddev_samp(v) / 0.01, 2)) AS BIGINT) AS needed FROM evals GROUP BY run HAVING count(*) > 1")
over(
    "a22_nll_to_bits",
    "steps",
    """SELECT run, attempt, step, round(exp(val), 6) AS perplexity, round(val / 3.87428, 9) AS nats_per_byte, round(val / ln(2) / 3.87428, 9) AS bits_per_byte FROM steps WHERE val > 0 AND val < 20""",
)
over("r17_draw_variance", "evals", "SELECT run, attempt, count(*) AS k, min(v) AS low, max(v) AS high, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(stddev_samp(v) / sqrt(count(*)), 9) AS se FROM evals GROUP BY run, attempt HAVING count(*) > 1")




# First and last picks are aggregates, ranks and neighbours run in two levels: a run that holds a tenth of all rows is never one task's.


@query(f"""WITH {_STEPS} SELECT run, attempt, round(val_bpb / val, 9) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY run, attempt ORDER BY step) AS n FROM steps
    WHERE val > 0 AND val_bpb > 0 AND val < 1000000 AND val_bpb < 1000000) AS r WHERE n = 1""")
def a15_first_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = curves.step_rows(table(spark, sf_dir, "loss"), ["val", "val_bpb"]).where("val > 0 AND val_bpb > 0 AND val < 1000000 AND val_bpb < 1000000")
    return s.groupBy(*CURVE).agg(F.round(F.min_by(F.col("val_bpb") / F.col("val"), "step"), 9).alias("factor"))


@query(f"""WITH {_STEPS} SELECT run, attempt, round(avg50 - val, 9) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY run, attempt ORDER BY step DESC) AS n FROM steps WHERE val > 0 AND val < 1000 AND avg50 > 0 AND avg50 < 1000) AS r WHERE n = 1""")
def w28_last_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = curves.step_rows(table(spark, sf_dir, "loss"), ["val", "avg50"]).where("val > 0 AND val < 1000 AND avg50 > 0 AND avg50 < 1000")
    return s.groupBy(*CURVE).agg(F.round(F.max_by(F.col("avg50") - F.col("val"), "step"), 9).alias("gap"))


@query(f"""WITH {_KEPT} SELECT run, last_kind, last_kind IN ('early_stop', 'chunk_complete') AS finished FROM (SELECT run, kind AS last_kind, row_number() OVER (PARTITION BY run ORDER BY attempt DESC, line_no DESC, row_id DESC) AS n FROM kept) AS r WHERE n = 1""")
def x08_terminal_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker ends a run only if it is its last row."""
    k = curves.kept_rows(table(spark, sf_dir, "loss"), ["line_no", "row_id"])
    last = k.groupBy("run").agg(F.max_by("kind", F.struct("attempt", "line_no", "row_id")).alias("last_kind"))
    return last.select("run", "last_kind", F.col("last_kind").isin("early_stop", "chunk_complete").alias("finished"))


@query(f"""WITH {_KEPT} , o AS (SELECT run, attempt, kind, step, lag(step) OVER (PARTITION BY run, attempt ORDER BY line_no, row_id) AS before, row_number() OVER (PARTITION BY run, attempt ORDER BY line_no DESC, row_id DESC) AS from_end FROM kept WHERE step IS NOT NULL)
    SELECT run, attempt, sum(CASE WHEN before > step THEN 1 ELSE 0 END) AS backward, max(CASE WHEN from_end = 1 THEN kind END) AS last_kind FROM o GROUP BY run, attempt""")
def w15_order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that go back from one line to the next, and the kind of the last line."""
    k = curves.kept_rows(table(spark, sf_dir, "loss"), ["line_no", "row_id"]).where("step IS NOT NULL")
    o = offsets.previous(k, ["line_no", "row_id"], "step", CURVE, "before")
    return o.groupBy(*CURVE).agg(F.coalesce(F.count_if(F.col("before") > F.col("step")), F.lit(0)).alias("backward"), F.max_by("kind", F.struct("line_no", "row_id")).alias("last_kind"))


@query(f"""WITH {_STEPS} SELECT run, attempt, count(*) AS stalls FROM (SELECT run, attempt, delivered_at, lag(delivered_at) OVER (PARTITION BY run, attempt ORDER BY delivered_at, row_id) AS before FROM steps) AS r
    WHERE delivered_at > before + INTERVAL 30 MINUTE GROUP BY run, attempt""")
def x05_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves that were quiet for more than half an hour between two deliveries, and how often."""
    k = curves.step_rows(table(spark, sf_dir, "loss"), ["delivered_at", "row_id"]).where("delivered_at IS NOT NULL").withColumn("us", F.unix_micros("delivered_at"))
    o = offsets.previous(k, ["us", "row_id"], "us", CURVE, "before", stretch=86_400_000_000)
    return o.where(F.col("us") > F.col("before") + 1_800_000_000).groupBy(*CURVE).agg(F.count(F.lit(1)).alias("stalls"))


@query(f"""WITH {_STEPS} SELECT run, attempt, step FROM (SELECT run, attempt, step, val, row_number() OVER (PARTITION BY run, attempt ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run, attempt) AS n FROM steps) AS r
    WHERE i % greatest(CAST(1 AS BIGINT), CAST(floor(n / 600) AS BIGINT)) = 0 OR val IS NOT NULL OR i = n - 1""")
def w21_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every so many rows of a curve (about 600 in all), its held-out checks, and its last row."""
    s = curves.step_rows(table(spark, sf_dir, "loss"), ["val"])
    placed = offsets.running_total(s.select(*CURVE, "step", "val"), "step", F.lit(1).cast("bigint"), CURVE, "i")
    n = s.groupBy(F.col("run").alias("n_run"), F.col("attempt").alias("n_attempt")).agg(F.count(F.lit(1)).alias("n"))
    d = placed.join(n, F.col("run").eqNullSafe(F.col("n_run")) & F.col("attempt").eqNullSafe(F.col("n_attempt")))
    stride = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / 600))
    return d.where((F.col("i") % stride == 0) | F.col("val").isNotNull() | (F.col("i") == F.col("n") - 1)).select(*CURVE, "step")


@query(f"""WITH {_KEPT}, s AS (SELECT DISTINCT run, regexp_extract(run, '_([0-9]{{12}})$', 1) AS stamp FROM kept), m AS (SELECT run, epoch(strptime(stamp, '%Y%m%d%H%M')) // 60 AS minutes FROM s WHERE stamp <> '')
SELECT a.run, count(*) AS near_runs FROM m AS a JOIN m AS b ON a.run <> b.run AND abs(a.minutes - b.minutes) <= 90 GROUP BY a.run""")
def j09_stamp_band(spark: SparkSession, sf_dir: str, band: int = 90) -> DataFrame:
    """Runs that others started within an hour and a half of, and how many: a range window over spans of four bands (no pairs are made);
    every run is also in the neighbouring spans that its band reaches into, and counted in its own only."""
    runs = table(spark, sf_dir, "loss").where("run IS NOT NULL").select("run").distinct()
    minutes = F.floor(F.unix_timestamp(F.try_to_timestamp(F.regexp_extract("run", "_([0-9]{12})$", 1), F.lit("yyyyMMddHHmm"))) / 60)
    m = runs.select("run", minutes.alias("minutes")).where("minutes IS NOT NULL").withColumn("span", F.floor(F.col("minutes") / (4 * band)))
    m = m.withColumn("at", F.explode(F.array_distinct(F.array(F.floor((F.col("minutes") - band) / (4 * band)), "span", F.floor((F.col("minutes") + band) / (4 * band))))))
    near = Window.partitionBy("at").orderBy("minutes").rangeBetween(-band, band)
    return m.withColumn("near_runs", F.count(F.lit(1)).over(near) - 1).where("at = span AND near_runs > 0").select("run", "near_runs")
