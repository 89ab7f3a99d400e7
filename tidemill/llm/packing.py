"""Mixture-controlled packing of whole texts into windows of fixed capacity.

Deficit round-robin. Every source is a queue of items and has a quantum, its target share of a part of the capacity. In every round each
source's deficit grows by its quantum, and the source serves items while its deficit covers them; what is left is carried on. So
item ``i`` of a source is served in the first round in which all quanta so far, and what the source was owed before, cover the
first ``i`` items: rounds are computed directly, and the order of service is the sort by round. Along this order every source has
its target share of all tokens served so far, up to one item.

Windows are filled along this order for as long as the next item fits. The room that is then left is closed exactly by a set of
the items that follow, as few of the next ones as needed: the sums that sets of the next items can reach are one bit mask, shifted
and merged per item until it has the exact sum. If the next ``NEAR`` items have no such set, the window gives its last item back
and the larger room is tried; a window down to its oldest item looks ``LOOK`` items ahead, and if nothing is exact, the fullest set
of all that was tried is taken. Items that are passed over are the oldest of the next window, so a window departs from the order of
service by its last items only.

Deficits are carried from window to window and from partition to partition by that order itself: how many tokens of its source come
before a text is a prefix sum over the whole input, in two levels (buckets of a source by hash of the id, then inside a bucket), so
rounds are those of one round-robin over everything, and a partition is a stretch of rounds: about ``TOKENS`` tokens or ``ITEMS``
texts. Each partition thus begins with the deficits that the one before ended with, and a source that holds a third of all rows
is spread over all of them. Texts of a source are queued by the hash of the id: long and short ones are spread over the windows.

A text longer than the capacity is cut into full pieces, each a window of its own at its place in the order, and a rest that is
packed like any other item. Target shares are the sources' shares of all tokens unless given; then a source that runs out leaves
the rounds to the others, and a source without a target is served last.

Defined results: null and empty texts have no tokens and go into a window without taking room; a null source is a source of its
own; equal ids are separate items; no text is dropped or cut unless it exceeds the capacity; without texts there are no windows;
every positive capacity of the table gets its windows, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TOKENS = 8_000_000
ITEMS = 100_000
BUCKET = 4096
LOOK = 1024
#: Rounds that together serve as many tokens as a window holds: short rounds mix the sources inside a window.
A_WINDOW = 16
NEAR = 128
PREFIXES = 16
_OUT = "window_id int, capacity int, window_no bigint, position int, doc_id bigint, source string, piece int, piece_start bigint, piece_tokens bigint"


def service_order(capacity: int, sources: np.ndarray, upto: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Positions of items in the order in which deficit round-robin serves them; ``upto`` are the tokens of the item's source up to
    its end, ``shares`` the target share of each item's source, ``sources`` numbers of the sources."""
    rounds = np.maximum(np.ceil(upto / (shares * capacity / A_WINDOW) - 1e-9), 1.0)
    turn = (sources + rounds.astype(np.int64)) % (int(sources.max(initial=0)) + 1)  # each round begins with another source
    return np.lexsort((upto, turn, rounds))


def _fullest(room: int, sizes: Sequence[int], follow: Iterator[int], look: int) -> tuple[list[int], int]:
    """Of the next ``look`` items, a set that fills the room exactly (with as few items looked at as possible), else the fullest;
    and the room that it leaves."""
    mask = (2 << room) - 1
    seen: list[int] = []
    reach = [1]
    for item in islice(follow, look):
        size = sizes[item]
        if size > room:
            continue
        sums = (reach[-1] | reach[-1] << size) & mask
        if sums == reach[-1]:
            continue  # adds no sum that the items before cannot reach
        seen.append(item)
        reach.append(sums)
        if sums >> room:
            break
    full = left = reach[-1].bit_length() - 1
    chosen = []
    for k in range(len(seen), 0, -1):
        if not reach[k - 1] >> left & 1:
            chosen.append(seen[k - 1])
            left -= sizes[seen[k - 1]]
    return chosen[::-1], room - full


def pack(capacity: int, sizes: Sequence[int], look: int = LOOK, near: int = NEAR) -> list[list[int]]:
    """Windows as lists of item numbers; the items, of 1 to ``capacity`` tokens, come in their order of service."""
    n = len(sizes)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    head = 0
    windows: list[list[int]] = []

    def follow(at: int) -> Iterator[int]:
        at = after[at]
        while at < n:
            yield at
            at = after[at]

    while head < n:
        row, room = [head], capacity - sizes[head]
        for item in follow(head):
            if sizes[item] > room:
                break
            row.append(item)
            room -= sizes[item]
        window, least = row, room
        while least:
            more, left = _fullest(room, sizes, follow(row[-1]), near if len(row) > 1 else look)
            if left < least:
                window, least = row + more, left
            if len(row) == 1:
                break
            room += sizes[row[-1]]
            row = row[:-1]
        for item in window:
            b, a = before[item], after[item]
            if b >= 0:
                after[b] = a
            else:
                head = a
            if a < n:
                before[a] = b
        windows.append(window)
    return windows


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def placed_texts(counts: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """part, source, doc_id, n_tokens, before (tokens of the source before the text) and share, for every text."""
    counts = cut(counts.select(_source_key("source").alias("source"), "doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    buckets = max(1, total.n // BUCKET)
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    sums = counts.groupBy("source", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
    share = F.sum("t").over(Window.partitionBy("source")) / F.lit(max(1, total.tokens))
    if targets is not None:
        given = F.create_map(F.lit("?"), F.lit(0.0), *[F.lit(x) for s, t in targets.items() for x in (f"={s}", float(t))])
        share = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", share.alias("share"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("b"))
    rows = rows.join(sums, ["source", "bucket"]).select("source", "doc_id", "n_tokens", (F.col("b") + F.col("inside")).alias("before"), "share")
    # A place on the order of service of the whole input, in tokens; what has no share comes after everything else.
    end = total.tokens
    if targets is not None:
        end = rows.where("share > 0").agg(F.max((F.col("before") + F.col("n_tokens")) / F.col("share"))).first()[0] or 0
    width = max(1.0, total.tokens / max(1, -(-total.tokens // TOKENS), -(-total.n // ITEMS)))
    parts = max(1, -(-total.tokens // TOKENS), -(-total.n // ITEMS))
    part = F.when(F.col("n_tokens") == 0, F.pmod(F.xxhash64("doc_id"), F.lit(parts))).when(F.col("share") > 0, F.floor(F.col("before") / F.col("share") / F.lit(width))).otherwise(F.floor((F.lit(float(end)) + F.col("before")) / F.lit(width)))
    return rows.select(part.cast("int").alias("part"), "source", "doc_id", "n_tokens", F.when(F.col("share") > 0, F.col("before")).otherwise(F.col("before") + F.lit(float(end))).cast("double").alias("before"), F.when(F.col("share") > 0, F.col("share")).otherwise(1.0).alias("share"))


def pack_windows(counts: DataFrame, windows: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """``counts`` has doc_id, source and n_tokens; ``windows`` has window_id and capacity."""
    wanted = [(r.window_id, r.capacity) for r in windows.where("capacity > 0").select("window_id", "capacity").distinct().orderBy("window_id", "capacity").collect()]
    size_of = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity")) for w, c in wanted]) if wanted else F.array().cast("array<struct<window_id:int,capacity:int>>")
    items = placed_texts(counts, targets).select("part", F.explode(size_of).alias("w"), "doc_id", "source", "n_tokens", "before", "share")
    return items.select("part", "w.window_id", "w.capacity", "doc_id", "source", "n_tokens", "before", "share").groupBy("part", "window_id", "capacity").applyInPandas(_pack_part, _OUT)


def _pack_part(rows: pd.DataFrame) -> pd.DataFrame:
    capacity, window_id, part = int(rows["capacity"].iloc[0]), int(rows["window_id"].iloc[0]), int(rows["part"].iloc[0])
    rows = rows.sort_values(["source", "before", "doc_id", "n_tokens"])
    ids, keys, tokens = rows["doc_id"].astype("Int64").tolist(), rows["source"].tolist(), rows["n_tokens"].to_numpy(np.int64)
    full, rest = np.divmod(tokens, capacity)
    n_pieces = full + (rest > 0)
    owner = np.repeat(np.arange(len(tokens)), n_pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    sizes = np.where(number < full[owner], capacity, rest[owner])
    upto = rows["before"].to_numpy(float)[owner] + number * capacity + sizes
    order = service_order(capacity, np.unique(keys, return_inverse=True)[1][owner], upto, rows["share"].to_numpy(float)[owner])
    windows = [[int(order[i]) for i in w] for w in pack(capacity, sizes[order].tolist())]
    out = [(w, at, int(owner[i]), int(number[i]), int(sizes[i])) for w, window in enumerate(windows) for at, i in enumerate(window)]
    last = max(len(windows) - 1, 0)
    at = len(windows[-1]) if windows else 0
    out += [(last, at + k, int(d), 0, 0) for k, d in enumerate(np.flatnonzero(tokens == 0))]
    w, at, doc, piece, size = (list(x) for x in zip(*out)) if out else ([], [], [], [], [])
    return pd.DataFrame({
        "window_id": window_id, "capacity": capacity, "window_no": [(part << 32) | x for x in w], "position": at, "doc_id": pd.array([ids[d] for d in doc], dtype="Int64"),
        "source": [keys[d][1:] if keys[d] else None for d in doc], "piece": piece, "piece_start": [k * capacity for k in piece], "piece_tokens": size,
    })


def fill_report(packed: DataFrame, prefixes: int = PREFIXES) -> DataFrame:
    """Per capacity: windows, pieces, tokens, unused room; the mean distance of a window's mixture from the mixture of all tokens beside
    the least that its number of pieces allows; and the largest such distance of a prefix of all windows in their order, over
    ``prefixes`` prefixes of about equal length (the whole is the last, at no distance).

    The distance of two mixtures is half the sum of the differences of their shares. A window of k pieces has at most k sources, so
    it is at least as far as the shares of all but the k largest sources add up to.
    """
    key = ["window_id", "capacity"]
    packed = cut(packed.withColumn("source", _source_key("source")))
    by = packed.groupBy(*key, "window_no", "source").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_tokens").alias("tokens"))
    whole = by.groupBy(*key, "source").agg(F.sum("tokens").alias("t"))
    of_all = Window.partitionBy(*key)
    shares = whole.withColumn("share", F.col("t") / F.greatest(F.sum("t").over(of_all), F.lit(1))).withColumn("top", F.sum("share").over(of_all.orderBy(F.desc("share"), "source").rowsBetween(Window.unboundedPreceding, 0)))
    shares = cut(shares.withColumn("rank", F.row_number().over(of_all.orderBy(F.desc("share"), "source"))))
    windows = by.groupBy(*key, "window_no").agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    in_common = by.join(windows.select(*key, "window_no", F.col("tokens").alias("of_window")), [*key, "window_no"]).join(shares.select(*key, "source", "share"), [*key, "source"])
    in_common = in_common.where("of_window > 0").groupBy(*key, "window_no").agg((1 - F.sum(F.least("share", F.col("tokens") / F.col("of_window")))).alias("distance"))
    last = shares.groupBy(*key).agg(F.max("rank").alias("n_sources"))
    windows = windows.join(in_common, [*key, "window_no"], "left").join(last, key).withColumn("rank", F.least("pieces", "n_sources").cast("int"))
    windows = windows.join(shares.select(*key, "rank", "top"), [*key, "rank"])
    report = windows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity") - F.col("tokens")).alias("unused"),
        F.round(F.avg("distance"), 6).alias("window_distance"), F.round(F.avg(F.greatest(1 - F.col("top"), F.lit(0.0))), 6).alias("least_distance"),
    )
    # Places of windows in the order of service: partitions are stretches of it, so the place is the partition's and the one inside.
    part, inside = F.shiftright("window_no", 32), F.col("window_no").bitwiseAND(F.lit((1 << 32) - 1))
    lengths = packed.groupBy(*key, part.alias("part")).agg((F.max(inside) + 1).alias("n"))
    of_key = lengths.groupBy(*key).agg((F.max("part") + 1).alias("parts"))
    placed = by.withColumn("part", part).join(lengths, [*key, "part"]).join(of_key, key).withColumn("bin", F.floor((F.col("part") + inside / F.col("n")) * prefixes / F.col("parts")))
    binned = placed.groupBy(*key, "bin", "source").agg(F.sum("tokens").alias("t"))
    every = shares.select(*key, "source", "share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(prefixes - 1).cast("bigint"))).alias("bin"))
    upto = Window.partitionBy(*key, "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    grown = every.join(binned, [*key, "source", "bin"], "left").withColumn("t", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    grown = grown.withColumn("all", F.sum("t").over(Window.partitionBy(*key, "bin"))).where(F.col("all") > 0)
    far = grown.groupBy(*key, "bin").agg((F.sum(F.abs(F.col("t") / F.col("all") - F.col("share"))) / 2).alias("d")).groupBy(*key).agg(F.round(F.max("d"), 6).alias("prefix_distance"))
    return report.join(far, key, "left")
