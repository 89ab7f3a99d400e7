import math
import random
from collections.abc import Sequence

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import curves as c


def evals(spark, vs, run="r"):
    rows = [(run, 1, 100 * (i + 1), v, i) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run string, attempt int, step bigint, v double, ix int")


def test_noise_band_golden(spark):
    r = c.noise_band(evals(spark, [1.70, 1.71, 1.70, 1.72, 1.71, 1.73, 1.74, 1.75])).first()
    assert r.n == 7 and r.median < 0.02 and r.largest < 0.03
    assert c.noise_band(evals(spark, [1.70, 1.72, 1.71])).first().n == 2
    assert c.noise_band(evals(spark, [1.7])).count() == 0


# The rules once more as plain loops over a list, for comparison.


def strikes(values: Sequence[float], patience: int, min_delta: float = 1e-4) -> tuple[float | None, int, int | None]:
    """Brute force: best value, strikes since the last improvement of more than ``min_delta``, and the index where patience ran out."""
    best, bad, stop = None, 0, None
    for i, v in enumerate(values):
        if best is None or v < best - min_delta:
            best, bad = v, 0
        else:
            bad += 1
            if patience > 0 and bad >= patience and stop is None:
                stop = i
    return best, bad, stop


def _upper_median(values: Sequence[float]) -> float:
    return sorted(values)[len(values) // 2]


def cycle_length(values: Sequence[float], longest: int = 8, share: float = 0.6) -> int:
    """Period of the sampler behind a series: the lag whose median change over the later half is smallest, if that is at most
    ``share`` of the median change from one value to the next; else 1. The smallest lag wins ties."""
    if len(values) < 2 * longest + 2:
        return 1
    late = values[len(values) // 2 :]
    change = {p: _upper_median([abs(b - a) for a, b in zip(late, late[p:])]) for p in range(1, min(longest, len(late) - 1) + 1)}
    lags = [p for p in change if p > 1]
    if not lags:
        return 1
    best = min(lags, key=lambda p: (change[p], p))
    return best if change[1] > 0 and change[best] <= share * change[1] else 1


def round_means(values: Sequence[float], period: int = 0) -> tuple[list[float], int]:
    """Mean of each whole round (a partial last round is dropped), or the series itself if it has no cycle."""
    p = period or cycle_length(values)
    if p <= 1 or len(values) < 2 * p:
        return list(values), 1
    return [sum(values[i : i + p]) / p for i in range(0, len(values) - p + 1, p)], p


def stalled(values: Sequence[float], delta: float, steps: int, share: float, every: int, at_least: int = 8) -> bool:
    """No round within the budget is worse than the newest by more than ``delta``."""
    rounds, period = round_means(values)
    if period <= 1 or len(rounds) < 2:
        if len(values) < at_least:
            return False
        rounds, period = list(values), 1
    back = max(1, round(share * steps / max(1, period * max(1, every))))
    return len(rounds) > back and max(rounds[-back - 1 : -1]) <= rounds[-1] + delta


def flat_stop(values: Sequence[float], delta: float, step: int, steps: int, share: float, every: int, min_step: int = 0) -> bool:
    """Stalled now and one evaluation earlier, past ``min_step``."""
    if share <= 0 or steps <= 0 or step < min_step or len(values) < 2:
        return False
    return stalled(values, delta, steps, share, every) and stalled(values[:-1], delta, steps, share, every)


def random_curves(n=120):
    r = random.Random(11)
    out = [[], [1.0], [1.0, 1.0, 1.0], [3.0, 2.0, 2.0, 1.99995, 1.0], [1.0] * 40]
    for k in range(n):
        size, p = r.randrange(1, 90), r.choice([1, 3, 5, 7])
        wave = [r.random() * 0.05 for _ in range(p)]
        out.append([2 - r.choice([0.0, 0.001, 0.02]) * i + wave[i % p] + r.choice([0.0, 0.001]) * r.random() for i in range(size)])
    return out


def as_series(spark, vss):
    return spark.createDataFrame([(str(k), 1, [float(v) for v in vs], [100 * (i + 1) for i in range(len(vs))]) for k, vs in enumerate(vss)], "run string, attempt int, vs array<double>, steps array<bigint>")


def test_array_rules_equal_loops(spark):
    vss = random_curves()
    d = as_series(spark, vss)
    rows = {int(r.run): r for r in c.strikes(c.envelope(d), F.lit(3)).collect()}
    for k, vs in enumerate(vss):
        best, bad, stop = strikes(vs, 3)
        assert (rows[k].best, rows[k].strikes, rows[k].stop_step) == (best, bad, None if stop is None else 100 * (stop + 1)), vs
        means, p = round_means(vs)
        assert rows[k].period == p and len(rows[k].means) == len(means) and all(math.isclose(x, y) for x, y in zip(rows[k].means, means))
    last = F.coalesce(F.try_element_at("steps", F.lit(-1)), F.lit(0))
    flat = c.flat_stop(c.stalled(d, "stalled", 0.005, last, 0.25, 100), "stop", 0.005, last, last, 0.25, 100, 1000).collect()
    for r in flat:
        vs = vss[int(r.run)]
        n = 100 * len(vs)
        assert r.stalled == stalled(vs, 0.005, n, 0.25, 100) and r.stop == flat_stop(vs, 0.005, n, n, 0.25, 100, 1000), vs
    assert sum(r.stalled for r in flat) > 5 and sum(r.period > 1 for r in rows.values()) > 20
    assert c.strikes(d, F.lit(0)).where("stop_step IS NOT NULL").count() == 0


def test_flat_guard(spark):
    # A spiky curve that must not stop.
    spiky = [1.5566, 1.5426, 1.5095, 1.4933, 1.5856]
    falling = [3 - 0.02 * i for i in range(80)]
    flat = [1.5 + 0.001 * (-1) ** i for i in range(80)]
    d = as_series(spark, [falling[:70] + spiky, flat, falling, falling[:79] + [9.0]])
    stops = lambda **k: [r.stop for r in c.flat_stop(d, "stop", 0.005, F.lit(24000), F.lit(24694), 0.25, 100, **k).orderBy("run").collect()]
    assert stops() == [False, True, False, False] and not any(stops(min_step=25000))


def test_running_best(spark):
    assert [r.is_best for r in c.running_best(evals(spark, [3.0, 2.0, 2.5, 1.0])).orderBy("step").collect()] == [True, True, False, True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.1, 9), min_size=1, max_size=300))
def test_smoothed_equals_loop(spark, xs):
    df = spark.createDataFrame([("r", 1, 5 * i, x) for i, x in enumerate(xs)], "run string, attempt int, step bigint, train double")
    got = [r.smoothed for r in c.smoothed(df, "train", block=64).orderBy("step").collect()]
    r = 0.0
    for i, x in enumerate(xs):
        r += (x - r) / min(i + 1, 50)
        assert math.isclose(got[i], r, rel_tol=1e-9, abs_tol=1e-12)


def test_tripwire(spark):
    # Four checks of a run.
    checks = [(100 * (i + 1), s, r) for i, (s, r) in enumerate([(1.1724, 1.2954), (1.2097, 1.3427), (1.1762, 1.3289), (1.1718, 1.3358)])]
    d = spark.createDataFrame([("r", 1, *x) for x in checks] + [("r", 2, 50, 1.0, 2.0), ("r", 2, 100, 1.0, 2.0), ("r", 2, 150, 1.0, 2.0), ("r", 3, 200, None, 2.0)], "run string, attempt int, step bigint, s double, r double")

    def hits(margin, attempt=1):
        got = c.tripwire(d, {"served": (F.col("s"), F.col("r"))}, margin).where(F.col("attempt") == attempt).orderBy("step").collect()
        return [r.hit for r in got], [r.trips for r in got]

    assert hits(0.15) == ([False, False, True, True], [False, False, False, True])
    assert hits(0.30)[0] == hits(0.0)[0] == hits(-1.0)[0] == [False] * 4
    assert hits(0.15, 2) == ([True, True, True], [False, False, True]) and hits(0.15, 3) == ([False], [False])


def test_pairs_and_bootstrap(spark):
    e = spark.createDataFrame([("r", a, i, i * 10, float(v)) for a, vs in ((1, [1, 2, 3, 4]), (2, [2, 3, 5, 5, 9]), (4, [1])) for i, v in enumerate(vs)], "run string, attempt int, ix int, step bigint, v double")
    p = c.paired_attempts(e)
    assert sorted((r.attempt, r.ix, r.a, r.b) for r in p.collect()) == [(2, 0, 1.0, 2.0), (2, 1, 2.0, 3.0), (2, 2, 3.0, 5.0), (2, 3, 4.0, 5.0)]
    s = c.pair_statistics(p).first()
    assert s.n == 4 and abs(s.mean - 1.25) < 1e-12 and abs(s.sd - 0.5) < 1e-12 and s.low < s.mean < s.high
    b = {(r.run, r.attempt): (r.low, r.high) for r in c.block_bootstrap(e, 400, 16).collect()}
    assert b["r", 4] == (1.0, 1.0) and 1 <= b["r", 1][0] < 2.5 < b["r", 1][1] <= 4
