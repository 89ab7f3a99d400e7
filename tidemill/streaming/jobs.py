"""Incremental forms: windows, sessions, deduplication, stalls, milestones and the supervisor's terminal marker.

Every job takes a streaming frame and returns one; ``run_available`` drains what is there and hands back a table, which is how
the batch queries and the tests use them. State is kept per key in the state store, so it survives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


#: Bytes of files that a batch takes: a batch costs a start of every state partition, however few rows it has.
BATCH_BYTES = 256 << 20


def table_stream(spark: SparkSession, sf_dir: str, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A table's files as a stream, in batches of ``batch_bytes`` (one file at least); naive timestamps become instants, since
    watermarks need them."""
    path = f"{sf_dir}/{name}.parque[t]"  # a pattern, as a stream takes no single file
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
    return rows.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


#: Settings of a job whose state grows with its input: it is kept on disk, in bounded memory beside the executor's heap.
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
LARGE_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "256",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    f"{_ROCKS}.trackTotalNumberOfRows": "false",
}


def run_available(stream: DataFrame, mode: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Drain the stream and return its result. ``complete`` keeps the last version of the result, ``append`` and ``update`` all
    emitted rows with their batch number (column ``batch``); batches are written to the shared folder, so a repeated batch
    replaces itself. ``settings`` hold for this stream only."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out, schema = f"{place}/out", T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    finally:  # the stream has taken a copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    try:
        got = spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        got = spark.createDataFrame([], schema)  # nothing was there, so nothing was written
    return got.drop("batch") if mode == "complete" else got


def windowed_counts(events: DataFrame, time: str, length: str, keys: list[str], value: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum per time window (tumbling, or sliding with ``slide``) and key."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.unix_micros("w.start").alias("start_us"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions per key that end after a gap; a quiet curve is a session that ended."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s.alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "n")


def first_deliveries(rows: DataFrame, time: str, keys: list[str], late: str | None = None) -> DataFrame:
    """At-least-once rows, each key once, however late it or its copies come: all keys stay in the state (drain it with
    ``LARGE_STATE``). With ``late`` keys are forgotten after that time and rows that come later than it are dropped."""
    return rows.dropDuplicates(keys) if late is None else rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def milestones(rows: DataFrame, key: str, step: str, at: tuple[int, ...]) -> DataFrame:
    """Each milestone of each key exactly once, when it is first reached (a latch)."""

    def latch(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else -1
        top = max((int(p[step].max()) for p in parts if len(p)), default=-1)
        new = [m for m in at if done < m <= top]
        if top > done:
            state.update((max(done, top),))
        yield pd.DataFrame({"key": [k[0]] * len(new), "milestone": new})

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = pa.Table.from_batches([batch]).group_by("key").aggregate([(step, "max")])
            yield from top.select(["key", f"{step}_max"]).rename_columns(["key", step]).to_batches()

    narrow = rows.where(F.col(step).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(step).cast("bigint").alias(step))
    # The latch needs the highest step only, so a key's rows meet in one task as one row for each Arrow batch.
    narrow = narrow.mapInArrow(highest, narrow.schema)
    return narrow.groupBy("key").applyInPandasWithState(latch, "key string, milestone bigint", "top bigint", "append", GroupStateTimeout.NoTimeout)


def last_marker(rows: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """The newest row kind per key, kept up to date; a marker is terminal only while it is the last row."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, kind)).alias("m")).select(key, F.col(f"m.{kind}").alias("last_kind"))


def stalls(rows: DataFrame, key: str, time: str, quiet: str) -> DataFrame:
    """Keys that have been quiet in event time: emitted once when the watermark passes their last row by ``quiet``."""

    def watch(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_us": [last]})
            return
        newest = max((int(p["us"].max()) for p in parts if len(p)), default=0)
        last = max(newest, state.get[0] if state.exists else 0)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [], "last_us": []}).astype({"key": object, "last_us": "int64"})

    number, unit = quiet.split()
    seconds = int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    narrow = rows.where(F.col(key).isNotNull()).withWatermark(time, "0 seconds").select(F.col(key).alias("key"), time, F.unix_micros(time).alias("us"))
    return narrow.groupBy("key").applyInPandasWithState(watch, "key string, last_us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
