import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidemill.operators import delivery

SCHEMA = "row_id bigint, run string, attempt int, kind string, step bigint, delivered_at timestamp, val_bpb double, quotient string"
ID = {"texts": ["run", "attempt", "kind"], "number": "step", "delivered_at": "delivered_at", "row_id": "row_id"}


def at(minute):
    return datetime(2026, 1, 1, 0, minute)


def rows(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1, "step", 5, at(2), 1.0, "x"),
            (2, "a", 1, "step", 5, at(1), 1.0, "x"),  # earliest delivery is kept
            (3, "a", 1, "step", 5, at(1), 2.0, None),  # tie: larger row id
            (4, None, 1, "step", 5, at(3), 1.0, "x"),
            (5, None, 1, "step", 5, None, None, "x"),  # null run is a key of its own; no time is late
            (6, "a", 1, "step", None, at(1), 1.0, "x"),
            (7, "a", 1, "step", None, at(1), 1.0, "x"),  # no step: never copies
            (8, "a", None, "step", 5, at(9), 1.0, "x"),
            (9, "a", 2, "step", 5, at(9), 1.0, "x"),
            (10, "a", 2, "chunk", 5, at(9), 1.0, "x"),
            (-11, "a", 2, "chunk", 5, at(9), 1.0, "x"),  # negative ids order as numbers
        ],
        SCHEMA,
    )


def test_surplus_copies(spark):
    got = {r.row_id for r in delivery.surplus_copies(rows(spark), **ID).collect()}
    assert got == {1, 3, 5, 10}


def test_keep_one_passes_other_columns(spark):
    got = delivery.keep_one(rows(spark), **ID)
    assert got.columns == rows(spark).columns
    assert {r.row_id for r in got.collect()} == {2, 4, 6, 7, 8, 9, -11}


def test_report_counts_differing_values(spark):
    got = {r.run: (r.messages, r.repeated, r.surplus_rows, r.differing) for r in delivery.copy_report(rows(spark), value="val_bpb", by=["run"], **ID).collect()}
    assert got == {"a": (4, 2, 3, 1), None: (1, 1, 1, 1)}


def messages(spark, n):
    return spark.range(n).select(F.lit("r").alias("run"), F.lit(1).alias("attempt"), F.lit("step").alias("kind"), F.col("id").alias("step"))


def test_permutation_is_one_to_one(spark):
    words = messages(spark, 20000).select(*delivery.permuted_identity(["run", "attempt", "kind"], "step"))
    assert words.distinct().count() == 20000
    assert words.select("quotient").distinct().count() > 10000
    low, high = words.agg(F.min("quotient"), F.max("quotient")).first()
    assert 0 <= low and high < 1 << delivery.QUOTIENT_BITS
    three = messages(spark, 5000).select(*delivery.permuted_identity(["run", "attempt", "kind"], "step", (0, 1)))
    assert three.columns == ["quotient", "r0", "r1", "r2"] and three.distinct().count() == 5000


def test_colliding_images_get_another_word(spark, monkeypatch):
    real = delivery._image
    monkeypatch.setattr(delivery, "_image", lambda texts, seed: F.lit(7).cast("bigint") if seed == 0 else real(texts, seed))
    assert delivery.identity_seeds(rows(spark), ID["texts"]) == [0, 1]
    assert {r.row_id for r in delivery.surplus_copies(rows(spark), **ID).collect()} == {1, 3, 5, 10}


def test_equal_quotients_do_not_match(spark):
    """With a single bit of quotient nearly all entries share a shard; with none in common they must all stay."""
    d = messages(spark, 3000).withColumn("row_id", F.col("step") + 10).withColumn("delivered_at", F.lit(at(1)))
    assert delivery.surplus_copies(d, **ID, quotient_bits=1).count() == 0
    twice = d.unionByName(d.withColumn("row_id", F.col("row_id") + 100_000))
    got = {r.row_id for r in delivery.surplus_copies(twice, **ID, quotient_bits=1).collect()}
    assert got == {i + 100_010 for i in range(3000)}


def test_shard_carries_an_open_word_over():
    a = np.array
    shard = delivery._Shard()
    assert shard.surplus([a([1, 1, 2]), a([5, 5, 5])], a([10, 11, 12])).tolist() == [False, True, False]
    assert shard.surplus([a([2, 2, 2]), a([5, 5, 6])], a([12, 13, 14])).tolist() == [False, True, False]
    assert shard.surplus([a([2]), a([6])], a([15])).tolist() == [True]


def test_random_rows_against_a_dictionary(spark, monkeypatch):
    r = random.Random(5)
    data = [(i, r.choice(["a", "b", None]), r.randrange(2), r.choice(["step", "x"]), r.choice([None, *range(40)]), r.choice([None, at(r.randrange(50))])) for i in range(3000)]
    d = spark.createDataFrame(data, "row_id bigint, run string, attempt int, kind string, step bigint, delivered_at timestamp").repartition(5)
    best = {}
    for i, *key, t in data:
        if key[3] is not None:
            best[tuple(key)] = min(best.get(tuple(key), (datetime.max, 1 << 62)), (t or datetime.max, i))
    want = {x[0] for x in data if x[4] is not None} - {i for _, i in best.values()}
    assert {x.row_id for x in delivery.surplus_copies(d, **ID).collect()} == want
    kept = delivery.first_copies(d, **ID, columns=["row_id", "step"])
    assert {x.row_id for x in kept.collect()} == {x[0] for x in data} - want


def test_one_hot_message_and_empty(spark):
    hot = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("r").alias("run"), F.lit(1).alias("attempt"), F.lit("step").alias("kind"), F.lit(7).cast("bigint").alias("step"), F.lit(at(1)).alias("delivered_at"))
    got = delivery.surplus_copies(hot, **ID)
    assert got.count() == 4999 and got.agg(F.min("row_id")).first()[0] == 1
    assert delivery.surplus_copies(hot.limit(0), **ID).count() == 0


def test_repeated_row_id_stands_for_one_row(spark):
    r = rows(spark)
    twice = r.unionByName(r.where("row_id = 2"))
    assert 2 not in {x.row_id for x in delivery.surplus_copies(twice, **ID).collect()}
