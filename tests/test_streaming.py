from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemill.streaming import jobs

T0 = datetime(2026, 1, 1)


def stream(spark, tmp_path, rows, schema, files=3):
    """Rows as a stream of several small files, in order."""
    folder = tmp_path / "in"
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_milestones_fire_once(spark, tmp_path):
    s = stream(spark, tmp_path, [("a", 50), ("a", 150), ("b", 5), ("a", 120), ("a", 1500), ("b", None)], "run string, step bigint")
    got = jobs.run_available(jobs.milestones(s, "run", "step", (100, 1000)), "append")
    assert sorted((r.key, r.milestone) for r in got.collect()) == [("a", 100), ("a", 1000)]


def test_first_deliveries(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, T0), (2, T0), (1, T0 + timedelta(minutes=5)), (3, T0), (2, T0), (1, T0)], "k int, t timestamp")
    assert sorted(r.k for r in jobs.run_available(jobs.first_deliveries(s, "t", ["k"]), "append").collect()) == [1, 2, 3]


def test_first_deliveries_of_any_age(spark, tmp_path):
    """A first delivery that is late, and a copy that is later than any watermark."""
    s = stream(spark, tmp_path, [(1, T0), (2, T0 + timedelta(days=40)), (3, T0), (1, T0 + timedelta(days=50)), (4, T0 + timedelta(days=1)), (2, T0 + timedelta(days=90))], "k int, t timestamp")
    assert sorted(r.k for r in jobs.run_available(jobs.first_deliveries(s, "t", ["k"]), "append", jobs.LARGE_STATE).collect()) == [1, 2, 3, 4]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def many_files(spark, tmp_path):
    spark.range(12).selectExpr("concat('r', id % 2) AS run", "id * 20 AS step").repartition(12).write.parquet(str(tmp_path / "loss.parquet"))
    return str(tmp_path)


def test_small_files_share_a_batch(spark, tmp_path):
    m = jobs.milestones(jobs.table_stream(spark, many_files(spark, tmp_path), "loss"), "run", "step", (100, 200))
    got = jobs.run_available(m, "append").collect()
    assert sorted((r.key, r.milestone) for r in got) == [("r0", 100), ("r0", 200), ("r1", 100), ("r1", 200)]
    assert {r.batch for r in got} == {0}


def test_batches_are_bounded(spark, tmp_path):
    m = jobs.milestones(jobs.table_stream(spark, many_files(spark, tmp_path), "loss", 1), "run", "step", (100, 200))
    got = jobs.run_available(m, "append").collect()
    assert sorted((r.key, r.milestone) for r in got) == [("r0", 100), ("r0", 200), ("r1", 100), ("r1", 200)] and len({r.batch for r in got}) > 1


def test_stalls(spark, tmp_path):
    rows = [("quiet", T0), ("busy", T0), ("busy", T0 + timedelta(hours=1)), ("busy", T0 + timedelta(hours=2)), ("busy", T0 + timedelta(hours=3)), ("busy", T0 + timedelta(hours=3))]
    got = jobs.run_available(jobs.stalls(stream(spark, tmp_path, rows, "k string, t timestamp", 6), "k", "t", "90 minutes"), "append")
    assert [r.key for r in got.collect()] == ["quiet"]


def test_windows_and_last_marker(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=20 * i), i, "step" if i < 5 else "early_stop") for i in range(6)]
    s = stream(spark, tmp_path, rows, "k string, t timestamp, n int, kind string")
    w = jobs.run_available(jobs.windowed_counts(s, "t", "1 hour", ["k"], "n"), "complete")
    assert sorted(r.n for r in w.collect()) == [3, 3]
    assert jobs.run_available(jobs.last_marker(s, "k", ["n"], "kind"), "complete").first().last_kind == "early_stop"
    assert jobs.run_available(jobs.sessions(s, "t", "30 minutes", "k"), "complete").agg(F.sum("n")).first()[0] == 6
