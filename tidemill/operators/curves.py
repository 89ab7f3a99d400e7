"""Ordered analytics over training curves: noise, cycles, envelopes, stop rules, guards.

A curve is a run and attempt in order of step. Rules that only look at neighbours or at running extremes are window expressions.
Rules that carry state from row to row are array aggregates over the *evaluation* rows of a curve, which are first packed into an
ordered array per curve (evaluations are rare: one row in many), so no row-level group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .offsets import running_total

CURVE = ["run", "attempt"]


_MESSAGE = {"texts": ["run", "attempt", "kind"], "number": "step", "delivered_at": "delivered_at", "row_id": "row_id"}


def kept_rows(loss: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One copy of each message; rows without step stay. The identity is always there, of the other columns those named (all)."""
    from .delivery import first_copies

    key = [*_MESSAGE["texts"], _MESSAGE["number"]]
    return first_copies(loss, **_MESSAGE, columns=[*key, *[c for c in (loss.columns if columns is None else columns) if c not in key]])


def step_rows(loss: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The kept step rows; the kind is part of the identity, so the filter is applied to the scan."""
    return kept_rows(loss.where((F.col("kind") == "step") & F.col("step").isNotNull()), columns)


def evaluations(loss: DataFrame, value: str = "val_bpb") -> DataFrame:
    """run, attempt, step, v of the evaluation rows with a finite value, numbered from 0."""
    rows = step_rows(loss, [value]).select(*CURVE, "step", F.col(value).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    return rows.withColumn("ix", F.row_number().over(Window.partitionBy(*CURVE).orderBy("step")) - 1)


def series(evals: DataFrame) -> DataFrame:
    """run, attempt, vs, steps: the evaluations of each curve as ordered arrays."""
    packed = evals.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("ix", "v", "step"))).alias("rows_"))
    return packed.select(*CURVE, F.col("rows_.v").alias("vs"), F.col("rows_.step").alias("steps"))


# Stateful rules as array expressions over ``series``: what is carried from value to value is an aggregate over the array.


def strikes(rows: DataFrame, patience: Column, min_delta: float = 1e-4) -> DataFrame:
    """Adds best (so far), strikes (since the last improvement of more than ``min_delta``) and stop_step (where ``patience``, if above
    zero, first ran out)."""
    begin = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("strikes"), F.lit(None).cast("bigint").alias("stop_step"))

    def step(acc: Column, x: Column) -> Column:
        better = acc["best"].isNull() | (x["v"] < acc["best"] - min_delta)
        count = F.when(better, 0).otherwise(acc["strikes"] + 1)
        out = (patience > 0) & (count >= patience) & (count > 0)
        return F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), count.alias("strikes"), F.coalesce(acc["stop_step"], F.when(out, x["step"])).alias("stop_step"))

    pairs = F.arrays_zip(F.col("vs").alias("v"), F.col("steps").alias("step"))
    return rows.withColumn("_f", F.aggregate(pairs, begin, step)).select("*", "_f.*").drop("_f")


def cycle_lengths(rows: DataFrame, vs: str = "vs", name: str = "period", longest: int = 8, share: float = 0.6) -> DataFrame:
    """Adds the period of the sampler behind a series: among the lags from 2 to ``longest`` the one with the smallest (upper) median
    change over the later half, if that is at most ``share`` of the median change from one value to the next; else 1. The smaller lag
    wins ties. Series of fewer than two rounds of ``longest`` and two values have none."""
    late = F.slice(vs, F.floor(F.size(vs) / 2).cast("int") + 1, F.size(vs))
    m = F.size("_late")

    def change(p: int) -> Column:
        moved = F.transform(F.slice("_late", p + 1, m), lambda x, i: F.abs(x - F.element_at("_late", i + 1)))
        return F.try_element_at(F.array_sort(moved), (F.floor((m - p) / 2) + 1).cast("int"))

    d = rows.withColumn("_late", F.when(F.size(vs) >= 2 * longest + 2, late))
    d = d.withColumn("_one", change(1)).withColumn("_best", F.array_min(F.array(*[F.struct(change(p).alias("c"), F.lit(p).alias("p")) for p in range(2, longest + 1)])))
    cyclic = (F.col("_one") > 0) & (F.col("_best.c") <= share * F.col("_one"))
    return d.withColumn(name, F.when(F.coalesce(cyclic, F.lit(False)), F.col("_best.p")).otherwise(1)).drop("_late", "_one", "_best")


def envelope(rows: DataFrame, vs: str = "vs", name: str = "means", period: str = "period") -> DataFrame:
    """Adds the period and the mean of each whole round (a partial last round is left out); without at least two rounds the series itself,
    of period 1."""
    d = cycle_lengths(rows, vs, period)
    whole = (F.col(period) > 1) & (F.size(vs) >= 2 * F.col(period))
    starts = F.sequence(F.lit(1), F.size(vs) - F.col(period) + 1, F.greatest(F.col(period), F.lit(1)))
    means = F.transform(starts, lambda i: F.aggregate(F.slice(vs, i, F.col(period)), F.lit(0.0), lambda a, x: a + x) / F.col(period))
    return d.withColumn(name, F.when(whole, means).otherwise(F.col(vs))).withColumn(period, F.when(whole, F.col(period)).otherwise(1))


def stalled(rows: DataFrame, name: str, delta: float, total: Column, share: float, every: int, vs: str = "vs", at_least: int = 8) -> DataFrame:
    """Adds whether no round within the last ``share`` of ``total`` steps is worse than the newest by more than ``delta``. A series without
    two rounds is looked at value by value, if it has ``at_least`` of them."""
    d = envelope(rows, vs, "_m", "_p").withColumn("_rounds", (F.col("_p") > 1) & (F.size("_m") >= 2))
    d = d.withColumn("_r", F.when(F.col("_rounds"), F.col("_m")).otherwise(F.col(vs))).withColumn("_q", F.when(F.col("_rounds"), F.col("_p")).otherwise(1))
    back = F.greatest(F.lit(1), F.bround(share * total / F.greatest(F.lit(1), F.col("_q") * max(1, every))).cast("int"))
    d = d.withColumn("_back", back)
    worst = F.array_max(F.slice("_r", F.greatest(F.size("_r") - F.col("_back"), F.lit(1)), F.col("_back")))
    enough = F.col("_rounds") | (F.size(vs) >= at_least)
    flat = enough & (F.size("_r") > F.col("_back")) & (worst <= F.try_element_at("_r", F.lit(-1)) + delta)
    return d.withColumn(name, F.coalesce(flat, F.lit(False))).drop("_m", "_p", "_rounds", "_r", "_q", "_back")


def flat_stop(rows: DataFrame, name: str, delta: float, step: Column, total: Column, share: float, every: int, min_step: int = 0) -> DataFrame:
    """Adds whether the curve is stalled now and was one evaluation earlier, past ``min_step``."""
    d = rows.withColumn("_early", F.slice("vs", F.lit(1), F.greatest(F.size("vs") - 1, F.lit(0))))
    d = stalled(stalled(d, "_now", delta, total, share, every), "_then", delta, total, share, every, "_early")
    armed = (F.lit(share) > 0) & (total > 0) & (step >= min_step) & (F.size("vs") >= 2)
    return d.withColumn(name, armed & F.col("_now") & F.col("_then")).drop("_early", "_now", "_then")


# Window forms


def lag_change(evals: DataFrame) -> DataFrame:
    """Absolute change from the previous non-null value of the curve."""
    w = Window.partitionBy(*CURVE).orderBy("step")
    return evals.withColumn("change", F.abs(F.col("v") - F.lag("v").over(w)))


def noise_band(evals: DataFrame) -> DataFrame:
    """median (mean of the middle two if even), p90 (``sorted[min(n - 1, int(0.9 n))]``), max and number of changes."""
    c = lag_change(evals).where("change IS NOT NULL")
    w = Window.partitionBy(*CURVE)
    r = c.withColumn("rn", F.row_number().over(w.orderBy("change")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    pick = lambda at: F.max(F.when(F.col("rn") == at, F.col("change")))
    half = F.floor(F.col("n") / 2)
    middle = F.when(F.max("n") % 2 == 1, pick(half)).otherwise((pick(half - 1) + pick(half)) / 2)
    return r.groupBy(*CURVE).agg(F.max("n").alias("n"), F.round(middle, 9).alias("median"), F.round(pick(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))), 9).alias("p90"), F.round(F.max("change"), 9).alias("largest"))


def block_statistic(evals: DataFrame, size: int, how: Callable[[str], Column], name: str) -> DataFrame:
    """One value per whole block of ``size`` evaluations."""
    blocks = evals.groupBy(*CURVE, F.floor(F.col("ix") / size).alias("block")).agg(how("v").alias(name), F.count(F.lit(1)).alias("c"), (F.max("step") - F.min("step")).alias("span"))
    return blocks.where(F.col("c") == size).drop("c")


def running_best(evals: DataFrame) -> DataFrame:
    """best so far (this row included), best before, and whether the row is a new best."""
    w = Window.partitionBy(*CURVE).orderBy("step")
    d = evals.withColumn("best", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return d.withColumn("is_best", F.col("before").isNull() | (F.col("v") < F.col("before")))


def smoothed(rows: DataFrame, value: str, span: int = 50, block: int = 4096) -> DataFrame:
    """The recurrence r += (x - r) / min(i, span) over each curve, i counting from 1: a mean that turns into an exponential one.

    Each row maps r to a r + b. Rows are numbered, cut into blocks, and each block composed into one such map; only the block
    maps are chained along a curve. Blocks are bounded, so a curve of any length is spread over many tasks.
    """
    import numpy as np

    numbered = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))).select(*CURVE, "step", F.col(value).alias("x"))
    numbered = running_total(numbered, "step", F.lit(1).cast("bigint"), CURVE, "i").withColumn("i", F.col("i") + 1)
    packed = numbered.groupBy(*CURVE, F.floor((F.col("i") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "step", "x"))).alias("r"))
    packed = packed.select(*CURVE, "block", F.col("r.step").alias("steps"), F.col("r.x").alias("xs"), F.col("r.i").alias("is"))

    def weights(i):
        return 1.0 / np.minimum(np.asarray(i, dtype=float), span)

    @F.pandas_udf("struct<a:double,b:double>")
    def compose(xs: pd.Series, index: pd.Series) -> pd.DataFrame:
        out = []
        for x, i in zip(xs, index):
            a, b = 1.0, 0.0
            for v, w in zip(x, weights(i)):
                a, b = a * (1 - w), b * (1 - w) + v * w
            out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    # Maps are chained in two levels, so what meets in one row is at most ``block`` block maps.
    def chain(maps: DataFrame, by: list[str], at: str, start: Column) -> DataFrame:
        """The value before each map of a group, given the value before the group."""
        held = maps.groupBy(*by, start.alias("s")).agg(F.array_sort(F.collect_list(F.struct(at, "a", "b"))).alias("maps"))
        held = held.withColumn("a", F.col("maps.a")).withColumn("b", F.col("maps.b"))
        return held.select(*by, F.explode(F.arrays_zip(F.col(f"maps.{at}").alias(at), before("a", "b", "s").alias("start"))).alias("z")).select(*by, F.col(f"z.{at}").alias(at), F.col("z.start").alias("start"))

    @F.pandas_udf("array<double>")
    def before(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for xs, ys, r in zip(a, b, s):
            got = []
            for x, y in zip(xs, ys):
                got.append(r)
                r = x * r + y
            out.append(got)
        return pd.Series(out)

    @F.pandas_udf("struct<a:double,b:double>")
    def joined_map(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for xs, ys in zip(a, b):
            p, q = 1.0, 0.0
            for x, y in zip(xs, ys):
                p, q = p * x, x * q + y
            out.append((p, q))
        return pd.DataFrame(out, columns=["a", "b"])

    maps = cut(packed.select(*CURVE, "block", F.floor(F.col("block") / block).alias("upper"), compose("xs", "is").alias("m")).select(*CURVE, "block", "upper", "m.*"))
    uppers = maps.groupBy(*CURVE, "upper").agg(F.array_sort(F.collect_list(F.struct("block", "a", "b"))).alias("maps"))
    uppers = uppers.select(*CURVE, "upper", joined_map("maps.a", "maps.b").alias("m")).select(*CURVE, "upper", "m.*")
    tops = chain(uppers, CURVE, "upper", F.lit(0.0)).select(F.col("run").alias("t_run"), F.col("attempt").alias("t_attempt"), F.col("upper").alias("t_upper"), F.col("start").alias("top"))
    inside = maps.join(tops, F.col("run").eqNullSafe(F.col("t_run")) & F.col("attempt").eqNullSafe(F.col("t_attempt")) & (F.col("upper") == F.col("t_upper")))
    chained = chain(inside, [*CURVE, "upper"], "block", F.col("top"))

    @F.pandas_udf("array<double>")
    def scan(xs: pd.Series, index: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for x, i, r in zip(xs, index, start):
            got = []
            for v, w in zip(x, weights(i)):
                r = r + (v - r) * w
                got.append(r)
            out.append(got)
        return pd.Series(out)

    k = chained.select(F.col("run").alias("k_run"), F.col("attempt").alias("k_attempt"), F.col("block").cast("bigint").alias("k_block"), "start")
    joined = packed.join(k, F.col("run").eqNullSafe(F.col("k_run")) & F.col("attempt").eqNullSafe(F.col("k_attempt")) & (F.col("block") == F.col("k_block")))
    return joined.select(*CURVE, F.explode(F.arrays_zip("steps", scan("xs", "is", "start").alias("r"))).alias("z")).select(*CURVE, F.col("z.steps").alias("step"), F.col("z.r").alias("smoothed"))


def paired_attempts(evals: DataFrame) -> DataFrame:
    """run, attempt, ix, a, b: the evaluations of an attempt (b) beside those of the attempt before it (a), by position."""
    before = evals.select("run", (F.col("attempt") + 1).alias("attempt"), "ix", F.col("v").alias("a"))
    return evals.select("run", "attempt", "ix", F.col("v").alias("b")).join(before, ["run", "attempt", "ix"]).select("run", "attempt", "ix", "a", "b")


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """run, attempt, n, mean, sd, se, low and high (95 %) of the differences of at least two pairs."""
    d = F.col("b") - F.col("a")
    s = pairs.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).where("n > 1").withColumn("se", F.col("sd") / F.sqrt("n"))
    return s.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def tripwire(checks: DataFrame, sides: dict[str, tuple[Column, Column]], margin: float, from_step: int = 100) -> DataFrame:
    """run, attempt, side, step, hit, trips: per side, whether its first value is below the second by more than ``margin`` (never with a
    margin of zero or less, or a null), and whether this and the check before it, both from ``from_step`` on, were hits."""
    hit = lambda a, b: F.coalesce(a < b - margin, F.lit(False)) if margin > 0 else F.lit(False)
    each = F.array(*[F.struct(F.lit(s).alias("side"), hit(a, b).alias("hit")) for s, (a, b) in sides.items()])
    d = checks.select(*CURVE, "step", F.inline(each))
    late = F.col("hit") & (F.col("step") >= from_step)
    before = F.coalesce(F.lag(late).over(Window.partitionBy(*CURVE, "side").orderBy("step")), F.lit(False))
    return d.select(*CURVE, "side", "step", "hit", (late & before).alias("trips"))


def block_bootstrap(evals: DataFrame, resamples: int, regions: int) -> DataFrame:
    """run, attempt, low, high: order statistics of the means of ``resamples`` draws, with replacement, of the means of ``regions``
    contiguous regions. A curve's draws are made, sorted and read inside its own row: nothing is multiplied or shuffled."""
    n = evals.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.ceil(F.col("n") / regions), F.lit(1))
    means = evals.join(n, CURVE).groupBy(*CURVE, F.floor(F.col("ix") / size).alias("region")).agg(F.avg("v").alias("mean"))
    rows = means.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("region", "mean"))).alias("r")).select(*CURVE, F.col("r.mean").alias("means"))
    k = F.size("means")

    def drawn(b: Column) -> Column:
        pick = lambda i: F.element_at("means", (F.pmod(F.xxhash64("run", "attempt", b, i), k) + 1).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + pick(i)) / k

    d = rows.select(*CURVE, F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(resamples)), drawn)).alias("m"))
    return d.select(*CURVE, F.element_at("m", int(0.025 * resamples) + 1).alias("low"), F.element_at("m", int(0.975 * resamples) + 1).alias("high"))
