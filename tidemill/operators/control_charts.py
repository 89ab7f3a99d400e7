"""Spikes, stuck values and impossible readings, flagged against what is normal for their own source.

A source is a run and attempt; each field of a source is a series in order of step. Three tests mark a reading:

* physical limits: it is not a finite number above zero;
* run-length counter: it belongs to at least ``STUCK`` consecutive equal readings;
* robust exponentially weighted control chart: it lies further than ``LIMIT`` scales from the chart's level. The chart keeps
  a mean and a scale, both exponentially weighted; every reading is clipped to ``CLIP`` scales around the mean *before* it
  updates them, so a spike cannot move the normal. Readings that failed the first two tests do not enter the chart. It runs
  forwards and backwards over the series and compares each reading with the average of both levels, which cancels the lag
  behind a drifting level; near an end the direction that has just started there counts little, so there is no cold start.

Sources may hold a third of all rows, so a series is never processed whole. Messages are first reduced to one copy (hash
aggregate), packed into arrays per stretch of ``STRETCH`` steps, and numbered exactly: the running count of readings per field
is taken over the packed stretches, in two levels, so that no window ever holds more than a thousandth of the rows. The
position then cuts each series into blocks of ``BLOCK`` readings with ``HALO`` readings of overlap on either side: enough for
the run-length counter to be exact and for the chart (memory 1/LAMBDA readings) to have forgotten where it began. All blocks
of an Arrow batch run through the chart in step, one vector operation per position.

Defined results: null readings and rows without step are ignored; null runs or attempts form a source of their own; a
message's copies count once (the smallest reading if they disagree); NaN and infinities are cases; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FIELDS = ("train", "gnorm", "lmax")
STUCK = 6
#: Ordinary readings stay within four times their scatter, cases lie beyond eight: the limit is as many times four as eight is of it.
LIMIT = (4.0 * 8.0) ** 0.5
CLIP = 3.0
LAMBDA = 0.06
LAMBDA_SCALE = 0.03
WARM = 64
STRETCH = 4096
SUPER = 1024
BLOCK = 2048
HALO = 256
#: Readings held at once by a task's chart.
AT_ONCE = 1 << 20


def run_lengths(values: np.ndarray) -> np.ndarray:
    """Length of the stretch of equal values that each value belongs to."""
    if not len(values):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    lengths = np.diff(np.r_[starts, len(values)])
    return np.repeat(lengths, lengths)


def _pass(x: np.ndarray, size: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted level and squared scale before each reading; one row per position, one column per series, NaN-padded.

    Readings marked in ``out`` are known cases: they get a prediction but update nothing.
    """
    rows, columns = x.shape
    level, square = np.empty_like(x), np.empty_like(x)
    head = np.where(out, np.nan, x)[: min(WARM, rows)]
    head = np.where(np.isnan(head).all(axis=0), 0.0, head)
    mean = np.nanmedian(head, axis=0)
    spread = 1.4826 * np.nanmedian(np.abs(head - mean), axis=0)
    floor = 1e-9 * np.abs(mean) + 1e-300
    var = np.maximum(spread, floor) ** 2
    for t in range(rows):
        level[t], square[t] = mean, var
        error = x[t] - mean
        bound = CLIP * np.sqrt(var)
        error = np.clip(error, -bound, bound)
        live = (t < size) & ~out[t]
        mean = np.where(live, mean + LAMBDA * error, mean)
        var = np.where(live, np.maximum(var + LAMBDA_SCALE * (error * error - var), floor * floor), var)
    return level, square


def _blend(forward: np.ndarray, backward: np.ndarray, memory: float) -> np.ndarray:
    """Average of both directions, each weighted by how much of it comes from readings rather than from its starting value."""
    seen = 1 - (1 - memory) ** np.arange(len(forward)) + 1e-3
    return (seen * forward + seen[::-1] * backward) / (seen + seen[::-1])


def chart(series: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Distance of every reading from the level around it, in scales; the series must be finite.

    The chart runs twice. What the first run finds to be far out is left out of the second, whose level and scale are thus those
    of the ordinary readings alone.
    """
    size = np.array([len(s) for s in series])
    if not len(size) or not size.max(initial=0):
        return [np.zeros(len(s)) for s in series]
    x = np.full((size.max(), len(size)), np.nan)
    y = x.copy()
    for k, s in enumerate(series):
        x[: len(s), k] = s
        y[: len(s), k] = s[::-1]
    out, back_out = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    distances: list[np.ndarray] = []
    for _ in range(2):
        level, square = _pass(x, size, out)
        back, back_square = _pass(y, size, back_out)
        distances = []
        for k, n in enumerate(size):
            middle = _blend(level[:n, k], back[:n, k][::-1], LAMBDA)
            scale = np.sqrt(_blend(square[:n, k], back_square[:n, k][::-1], LAMBDA_SCALE))
            distances.append(np.abs(x[:n, k] - middle) / scale)
            far = distances[-1] > LIMIT
            out[:n, k], back_out[:n, k] = far, far[::-1]
    return distances


def flag_series(series: Sequence[np.ndarray]) -> list[np.ndarray]:
    """True for each suspicious reading of each series."""
    bad, clean = [], []
    for v in series:
        impossible = ~np.isfinite(v) | (v <= 0)
        stuck = run_lengths(v) >= STUCK
        bad.append(impossible | stuck)
        clean.append(v[~bad[-1]])
    for mark, distance in zip(bad, chart(clean)):
        keep = np.flatnonzero(~mark)
        mark[keep[distance > LIMIT]] = True
    return bad


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by series, block and position in; flagged (run, attempt, field_name, step) out."""
    schema = pa.schema([("run", pa.string()), ("attempt", pa.int32()), ("step", pa.int64()), ("field_name", pa.string())])
    open_key, pieces = None, []
    ready: list[tuple] = []
    held = 0

    def close() -> None:
        nonlocal held, pieces
        if pieces:
            steps, values, at = (np.concatenate(p) for p in zip(*pieces))
            ready.append((open_key, steps, values, (at >= open_key[3] * BLOCK) & (at < (open_key[3] + 1) * BLOCK)))
            held += len(steps)
        pieces = []

    def flush() -> pa.RecordBatch:
        nonlocal held
        out: dict[str, list] = {n: [] for n in schema.names}
        ready.sort(key=lambda r: len(r[1]))
        for at in range(0, len(ready), 512):
            part = ready[at : at + 512]
            for (key, steps, _, core), mark in zip(part, flag_series([r[2] for r in part])):
                hits = steps[mark & core].tolist()
                for name, value in zip(schema.names, (key[0], key[1], None, key[2])):
                    out[name] += hits if name == "step" else [value] * len(hits)
        ready.clear()
        held = 0
        return pa.RecordBatch.from_pydict(out, schema=schema)

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("run", "attempt", "field_name", "block")]
        start = batch.column("start").to_numpy(zero_copy_only=False)
        readings = batch.column("readings")
        lo = readings.offsets.to_numpy()
        flat = readings.values
        steps, values = flat.field("step").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
        for i, key in enumerate(zip(*keys)):
            if key != open_key:
                close()
                open_key = key
                if held >= AT_ONCE:
                    yield flush()
            a, b = lo[i], lo[i + 1]
            pieces.append((steps[a:b], values[a:b], start[i] + np.arange(b - a)))
    close()
    if ready:
        yield flush()


def one_copy(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per (run, attempt, step); copies agree in the readings, so the smallest of them is any of them."""
    return rows.groupBy("run", "attempt", "step").agg(*[F.min(f).alias(f) for f in fields])


def suspicious_readings(rows: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """run, attempt, step, field_name of each reading that is impossible, stuck or out of control."""
    key = ["run", "attempt", "stretch"]
    some = None
    for f in fields:
        some = F.col(f).isNotNull() if some is None else some | F.col(f).isNotNull()
    steps = rows.where((F.col("kind") == "step") & F.col("step").isNotNull() & some).select("run", "attempt", "step", *fields)
    packed = (
        one_copy(steps, fields)
        .withColumn("stretch", F.floor(F.col("step") / F.lit(STRETCH)).cast("bigint"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("step", *fields))).alias("rows_"))
    )

    def readings_of(f: str):
        filled = F.filter("rows_", lambda r: r[f].isNotNull())
        return F.transform(filled, lambda r: F.struct(r["step"].alias("step"), r[f].alias("value")))

    readings = {f: readings_of(f) for f in fields}
    packed = cut(packed.select(*key, *[r.alias(f"readings_{f}") for f, r in readings.items()]))  # read three times below
    counts = packed.select(*key, *[F.size(f"readings_{f}").cast("bigint").alias(f"n_{f}") for f in fields]).withColumn(
        "super", F.floor(F.col("stretch") / F.lit(SUPER)).cast("bigint")
    )
    # Running counts in two levels: whole super-stretches first, then the stretches inside each.
    outer_w = Window.partitionBy("run", "attempt").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    inner_w = Window.partitionBy("run", "attempt", "super").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    supers = counts.groupBy("run", "attempt", "super").agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in fields])
    supers = supers.select(
        F.col("run").alias("s_run"), F.col("attempt").alias("s_attempt"), F.col("super").alias("s_super"), *[F.coalesce(F.sum(f"n_{f}").over(outer_w), F.lit(0)).alias(f"s_{f}") for f in fields]
    )
    inner = counts.select("run", "attempt", "stretch", "super", *[F.coalesce(F.sum(f"n_{f}").over(inner_w), F.lit(0)).alias(f"i_{f}") for f in fields])
    same = F.col("run").eqNullSafe(F.col("s_run")) & F.col("attempt").eqNullSafe(F.col("s_attempt")) & (F.col("super") == F.col("s_super"))
    offsets = inner.join(supers, same).select(
        F.col("run").alias("o_run"), F.col("attempt").alias("o_attempt"), F.col("stretch").alias("o_stretch"), *[(F.col(f"i_{f}") + F.col(f"s_{f}")).alias(f"o_{f}") for f in fields]
    )
    same = F.col("run").eqNullSafe(F.col("o_run")) & F.col("attempt").eqNullSafe(F.col("o_attempt")) & (F.col("stretch") == F.col("o_stretch"))
    placed = packed.join(offsets, same).select(
        "run",
        "attempt",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"o_{f}").alias("first"), F.col(f"readings_{f}").alias("readings")) for f in fields])).alias("p"),
    )
    placed = placed.select("run", "attempt", "p.*").withColumn("n", F.size("readings")).where("n > 0")
    lowest = F.greatest(F.lit(0), F.floor((F.col("first") - HALO) / F.lit(BLOCK)))
    highest = F.floor((F.col("first") + F.col("n") - 1 + HALO) / F.lit(BLOCK))
    pieces = placed.withColumn("block", F.explode(F.sequence(lowest, highest)))
    begin = F.greatest(F.col("first"), F.col("block") * BLOCK - HALO)
    end = F.least(F.col("first") + F.col("n"), (F.col("block") + 1) * BLOCK + HALO)
    pieces = pieces.select(
        "run", "attempt", "field_name", "block", begin.alias("start"), F.slice("readings", (begin - F.col("first") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")).alias("readings")
    ).where(F.size("readings") > 0)
    return (
        pieces.repartition("run", "attempt", "field_name", "block")
        .sortWithinPartitions("run", "attempt", "field_name", "block", "start")
        .mapInArrow(_flag_batches, "run string, attempt int, step bigint, field_name string")
    )
