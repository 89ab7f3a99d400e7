import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import packing as p


def check(capacity, items, windows):
    assert sorted(i for w in windows for i in w) == sorted(n for _, _, n in items)
    size = {n: s for _, s, n in items}
    assert all(w and sum(size[i] for i in w) <= capacity for w in windows)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=60))
def test_every_item_in_one_window(capacity, raw):
    sizes = [min(n, capacity) for n in raw]
    windows = p.pack(capacity, sizes)
    check(capacity, [(0, s, i) for i, s in enumerate(sizes)], windows)
    assert [w[0] for w in windows] == sorted(w[0] for w in windows)  # the oldest item opens each window
    # no two windows could have been one
    fill = sorted(sum(sizes[i] for i in w) for w in windows)
    assert len(fill) < 2 or fill[0] + fill[1] > capacity


def test_little_room_is_left():
    r = random.Random(3)
    sizes = [min(1024, int(r.lognormvariate(5, 0.8)) + 1) for _ in range(6000)]
    windows = p.pack(1024, sizes)
    check(1024, [(0, n, i) for i, n in enumerate(sizes)], windows)
    assert len(windows) <= -(-sum(sizes) // 1024) + 3
    # windows follow the order of service: an item is packed little before or after its turn
    at = {i: w for w, window in enumerate(windows) for i in window}
    turn = sum(sizes) / len(sizes)
    late = sorted(abs(at[i] - i * turn / 1024) for i in range(5000))
    assert late[len(late) // 2] < 0.02 * len(windows) and late[-1] < 0.1 * len(windows)


def in_service(capacity, queues, shares):
    """Deficit round-robin, round by round."""
    deficit, order, at = [0.0] * len(queues), [], [0] * len(queues)
    k = 0
    while any(at[s] < len(q) for s, q in enumerate(queues)):
        k += 1
        for s in sorted(range(len(queues)), key=lambda s: (s + k) % len(queues)):
            deficit[s] += shares[s] * capacity / p.A_WINDOW
            while at[s] < len(queues[s]) and queues[s][at[s]] <= deficit[s] + 1e-9:
                deficit[s] -= queues[s][at[s]]
                order.append((s, at[s]))
                at[s] += 1
    return order


def served(capacity, queues, shares):
    flat = [(s, i) for s, q in enumerate(queues) for i in range(len(q))]
    upto = np.concatenate([np.cumsum(q) for q in queues]).astype(float)
    order = p.service_order(capacity, np.array([s for s, _ in flat], int), upto, np.array([shares[s] for s, _ in flat]))
    return [flat[i] for i in order]


def test_service_order_equals_rounds():
    r = random.Random(4)
    for _ in range(30):
        shares = [0.5, 0.25, 0.125, 0.125]
        queues = [[r.randrange(1, 65) for _ in range(r.randrange(1, 40))] for _ in shares]
        assert served(64, queues, shares) == in_service(64, queues, shares)


def packed_mixture(capacity, queues, shares):
    items = [(s, queues[s][i]) for s, i in served(capacity, queues, shares)]
    return [[items[i] for i in w] for w in p.pack(capacity, [n for _, n in items])]


def test_mixture_follows_the_shares():
    windows = packed_mixture(1024, [[64] * 3000, [64] * 1000], [0.75, 0.25])
    assert all(abs(sum(s == 0 for s, _ in w) - 12) <= 1 for w in windows)


def test_every_prefix_holds_the_mixture():
    r = random.Random(8)
    queues = [[min(512, int(r.lognormvariate(4.5, 0.7)) + 1) for _ in range(n)] for n in (4000, 2000, 1000, 500, 250)]
    total = sum(map(sum, queues))
    shares = [sum(q) / total for q in queues]
    got, every = [0] * 5, 0
    for w in packed_mixture(2048, queues, shares):
        for s, n in w:
            got[s] += n
            every += n
        assert all(abs(got[s] - shares[s] * every) < 2 * 2048 for s in range(5))


def test_given_targets_hold_until_a_source_runs_out(spark):
    rows = [(i, "a" if i % 4 else "b", 40 + i % 60) for i in range(4000)]
    got = p.pack_windows(frame(spark, [*rows, (9000, "c", 50), (9001, None, 0)]), spark.createDataFrame([(1, 1024)], "window_id int, capacity int"), {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == 4002
    first = [r for r in got if r.window_no < 100]
    assert abs(sum(r.piece_tokens for r in first if r.source == "b") / sum(r.piece_tokens for r in first) - 0.5) < 0.01
    late = sorted({r.window_no for r in got})[-3:]  # what has no target is served last
    assert {r.window_no for r in got if r.source == "c"} <= set(late)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_frame(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, i % 50) for i in range(300)] + [(900, "s1", 1000), (901, "s1", 128), (902, None, None), (5, "s2", 5)]
    windows = spark.createDataFrame([(1, 64), (2, 128), (2, 128), (3, 0)], "window_id int, capacity int")
    got = p.pack_windows(frame(spark, rows), windows).collect()
    for w, capacity in ((1, 64), (2, 128)):
        mine = [r for r in got if r.window_id == w]
        assert len({(r.doc_id, r.piece) for r in mine}) == len(mine) - 1  # one id occurs twice
        fill = {}
        for r in mine:
            fill[r.window_no] = fill.get(r.window_no, 0) + r.piece_tokens
        assert max(fill.values()) <= capacity
        assert sum(fill.values()) == sum(n or 0 for _, _, n in rows)
        big = sorted((r.piece_start, r.piece_tokens) for r in mine if r.doc_id == 900)
        assert big == [(x, min(capacity, 1000 - x)) for x in range(0, 1000, capacity)]
        assert all(r.piece == 0 for r in mine if r.doc_id != 900 and not (w == 1 and r.doc_id == 901))
    assert p.pack_windows(frame(spark, rows).limit(0), windows).count() == 0
    assert p.pack_windows(frame(spark, rows), windows.limit(0)).count() == 0


def test_partitions_continue_one_ledger(spark, monkeypatch):
    monkeypatch.setattr(p, "TOKENS", 100_000)  # three partitions; each may leave one window open
    rows = [(i, "a" if i % 4 else "b", 40 + i % 60) for i in range(4000)]
    got = p.pack_windows(frame(spark, rows), spark.createDataFrame([(1, 1024)], "window_id int, capacity int"))
    report = p.fill_report(got).first()
    assert report.pieces == 4000 and report.unused / (report.windows * 1024) < 0.02
    assert report.prefix_distance < 0.01 and report.least_distance == 0 and report.window_distance < 0.15
    by = {}
    for r in got.collect():
        w = by.setdefault(r.window_no, {"a": 0, "b": 0})
        w[r.source] += r.piece_tokens
    off = sorted(abs(w["b"] / (w["a"] + w["b"]) - 0.25) for w in by.values())
    assert off[len(off) // 2] < 0.08
    assert {w >> 32 for w in by} == {0, 1, 2}
