import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.operators import control_charts as cc

SCHEMA = "run string, attempt int, kind string, step bigint, train double, gnorm double, lmax double, block int"


def series(n, seed=0, level=4.0, sd=0.1):
    return level + 0.0001 * np.arange(n) + np.random.default_rng(seed).normal(0, sd, n).clip(-3.5 * sd, 3.5 * sd)


def test_spikes_stuck_and_impossible():
    v = series(500)
    v[100], v[200:203], v[300:306], v[400], v[401], v[402] = 6.0, 2.0, 4.0, np.nan, np.inf, -1.0
    want = {100, 200, 201, 202, *range(300, 306), 400, 401, 402}
    assert set(np.flatnonzero(cc.flag_series([v])[0])) == want


def test_five_equal_are_not_stuck_and_short_series():
    v = series(50)
    v[10:15] = v[10]
    assert not cc.flag_series([v])[0].any()
    assert not cc.flag_series([np.array([])])[0].any()
    assert not cc.flag_series([np.array([3.0])])[0].any()
    assert cc.flag_series([np.array([2.0] * 6)])[0].all()


def test_first_reading_spike():
    v = series(200)
    v[0] = 9.0
    assert list(np.flatnonzero(cc.flag_series([v])[0])) == [0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_run_lengths(xs):
    want = []
    for i, x in enumerate(xs):
        a = i
        while a and xs[a - 1] == x:
            a -= 1
        b = i
        while b + 1 < len(xs) and xs[b + 1] == x:
            b += 1
        want.append(b - a + 1)
    assert cc.run_lengths(np.array(xs, float)).tolist() == want


def make(spark, curves):
    rows = [
        (run, attempt, "step", 10 * i, *(None if np.isnan(x) and gap else float(x) for x in (t, g, m)), 1)
        for (run, attempt), (ts, gs, ms, gap) in curves.items()
        for i, (t, g, m) in enumerate(zip(ts, gs, ms))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_blocks_give_what_the_whole_series_gives(spark):
    n = 6000  # several blocks and stretches
    t, g, m = series(n, 1), series(n, 2, 1.0, 0.02), series(n, 3, 20.0, 0.5)
    for v in (t, g, m):
        v[np.arange(37, n, 411)] *= 2
    t[2045:2053] = t[2045]  # stuck across a block edge
    g[5:4000] = np.nan  # a long gap of nulls
    whole = {}
    for name, v in (("train", t), ("gnorm", g), ("lmax", m)):
        at = np.flatnonzero(~np.isnan(v))
        whole[name] = {int(10 * at[i]) for i in np.flatnonzero(cc.flag_series([v[at]])[0])}
    df = make(spark, {("a", 1): (t, g, m, True), (None, None): (series(300, 5), series(300, 6), series(300, 7), True)})
    got = {}
    for r in cc.suspicious_readings(df.unionByName(df.limit(500))).collect():
        got.setdefault((r.run, r.field_name), set()).add(r.step)
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == whole


def test_nulls_nan_other_kinds_and_empty(spark):
    df = spark.createDataFrame(
        [("a", 1, "step", 1, float("nan"), None, 3.0, 1), ("a", 1, "step", None, -1.0, 1.0, 1.0, 1), ("a", 1, "throughput", 2, -1.0, None, None, 1), ("a", 1, "step", 3, 2.0, float("inf"), 3.1, 1)], SCHEMA
    )
    got = {(r.step, r.field_name) for r in cc.suspicious_readings(df).collect()}
    assert got == {(1, "train"), (3, "gnorm")}
    assert cc.suspicious_readings(df.limit(0)).count() == 0
