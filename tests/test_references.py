from datetime import datetime

from pyspark.sql import functions as F

from tidemill.operators import references


def at(day):
    return datetime(2026, 3, day)


def frames(spark):
    parents = spark.createDataFrame(
        [("p1", at(1), None, "x"), ("p1", at(5), at(9), "x"), ("p1", at(6), at(8), None), ("p2", at(7), None, "x"), ("p3", None, at(2), "x"), (None, at(1), None, "x"), ("P4", at(1), None, "x")],
        "id string, loaded_at timestamp, deleted_at timestamp, salt string",
    )
    refs = spark.createDataFrame(
        [
            (1, "p1", at(2)), (2, "p1", at(8)), (3, "p1", at(7)), (4, "p2", at(6)), (5, "p2", at(7)), (6, "p3", at(1)), (7, "p3", at(2)),
            (8, "p4", at(9)), (9, None, at(9)), (10, "  \t", at(9)), (11, "", at(9)), (12, "p9", None), (13, "p1", None), (14, "p1 ", at(3)), (14, "p1 ", at(3)),
        ],
        "id bigint, ref string, loaded_at timestamp",
    )
    return refs.withColumn("reason", F.lit(0)), parents


def test_missing_late_deleted(spark):
    refs, parents = frames(spark)
    got = sorted((int(r.row_key), r.reason, r.loaded_month) for r in references.orphans(refs, "id", "ref", parents, "id", "t").collect())
    m = "2026-03"
    assert got == [(2, "deleted", m), (4, "late", m), (7, "deleted", m), (8, "missing", m), (12, "missing", None), (14, "missing", m), (14, "missing", m)]


def test_empty_sides_and_plan(spark):
    refs, parents = frames(spark)
    assert references.orphans(refs.limit(0), "id", "ref", parents, "id", "t").count() == 0
    found = references.orphans(refs, "id", "ref", parents.limit(0), "id", "t")
    assert {r.reason for r in found.collect()} == {"missing"}
    plan = references.orphans(refs, "id", "ref", parents, "id", "t")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan


def test_hot_key_is_spread(spark):
    _, parents = frames(spark)
    hot = spark.range(4000).select("id", F.lit("p9").alias("ref"), F.lit(at(2)).alias("loaded_at"))
    report = references.orphan_report(references.orphans(hot, "id", "ref", parents, "id", "t")).collect()
    assert [(r.reason, r.n_orphans) for r in report] == [("missing", 4000)]


def test_hot_keys_are_spread_and_whole(spark):
    refs = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'gone' ELSE concat('k', id) END AS ref", "TIMESTAMP '2026-01-02 00:00:00' AS loaded_at")
    parents = spark.createDataFrame([("hot", "2026-01-01 00:00:00"), ("k2", "2026-01-03 00:00:00")], "id string, at string").selectExpr("id", "CAST(at AS timestamp) AS loaded_at", "CAST(NULL AS timestamp) AS deleted_at")
    for hot in (10, 700, 10**6):
        got = {r.reason: r["count"] for r in references.orphans(refs, "id", "ref", parents, "id", "t", hot=hot).groupBy("reason").count().collect()}
        assert got == {"missing": 1667 + 1665, "late": 1}
