"""Flat little-endian int32 token files: read by byte range, written as ordered shards with sidecars, resumed, merged; and other
file sources. Files are opened through Arrow's file systems, so any address that Spark lists can be read and written by tasks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = 1 << 20
COPY = 1 << 22


def _place(uri: str):
    """File system and path of an address; a plain path is local."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _put(system, path: str, data: bytes) -> None:
    """Write under another name, then rename: a reader sees the old content or the new, never half of it."""
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(held) as f:
        f.write(data)
    system.move(held, path)


def read_token_files(spark: SparkSession, path: str, tokens_per_row: int = RANGE, pattern: str = "*.bin") -> DataFrame:
    """path, first (position of the row's first token), torn and ids; each task reads its byte ranges only, the driver just lists files.

    A file whose size is no multiple of four is torn: its last bytes are left out and ``torn`` is true.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("n_bytes"))
    ranges = files.withColumn("n", F.floor(F.col("n_bytes") / 4)).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(tokens_per_row).cast("bigint"))))
    ranges = ranges.select("path", "n_bytes", "n", "first").repartition("path", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_bytes, n, first in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "n", "first"))):
                system, local = _place(name)
                with system.open_input_file(local) as f:
                    f.seek(first * 4)
                    ids = np.frombuffer(f.read(4 * min(tokens_per_row, n - first)), "<i4")
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([n_bytes % 4 != 0]), lists], names=["path", "first", "torn", "ids"])

    return ranges.mapInArrow(read, "path string, first bigint, torn boolean, ids array<int>")


def write_token_shards(tokens: DataFrame, folder: str, resume: bool = False) -> DataFrame:
    """Write ``tokens`` (shard_ix, chunk_ix from 0, ids) as one ``.bin`` with a sidecar per shard in a shared folder; the manifest comes
    back: shard_ix, tokens, resumed (tokens taken over) and n_bytes. ``ids`` is an array of ids, or binary: then every byte is an id, and
    only the file has four bytes for it.

    A shard's chunks are sorted into one task and streamed out; file and sidecar appear under their names only when they are whole,
    so a repeated task overwrites with the same bytes. With ``resume`` what a shard's sidecar has recorded is taken over: the file is
    cut to the recorded tokens (bytes after them are torn) and only later chunks are added; without a usable sidecar it starts anew.
    """

    raw = tokens.schema["ids"].dataType.typeName() == "binary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, out, held, count, chunks, taken, done = None, None, "", 0, 0, 0, []
        system, base = _place(folder)
        system.create_dir(base, recursive=True)

        def path(shard: int, end: str) -> str:
            return f"{base}/shard_{shard:06d}.{end}"

        def recorded(shard: int) -> tuple[int, int]:
            try:
                with system.open_input_file(path(shard, "json")) as f:
                    meta = json.loads(f.read())
                with system.open_input_file(path(shard, "bin")) as f:
                    return (meta["tokens"], meta["chunks"]) if f.size() >= 4 * meta["tokens"] else (0, 0)
            except (OSError, ValueError, KeyError):
                return 0, 0

        def begin(shard: int) -> None:
            nonlocal out, held, count, chunks, taken
            count, chunks = recorded(shard) if resume else (0, 0)
            taken, held = count, f"{base}/.{uuid.uuid4().hex}.tmp"
            out = system.open_output_stream(held)
            left = 4 * count
            if left:
                with system.open_input_file(path(shard, "bin")) as f:
                    while left:
                        out.write(f.read(min(COPY, left)))
                        left -= min(COPY, left)

        def close() -> None:
            if out is not None:
                out.close()
                system.move(held, path(open_shard, "bin"))
                _put(system, path(open_shard, "json"), json.dumps({"tokens": count, "chunks": chunks}).encode())
                done.append((open_shard, count, taken))

        for batch in batches:
            for shard, chunk, ids in zip(batch.column("shard_ix").to_pylist(), batch.column("chunk_ix").to_pylist(), batch.column("ids")):
                if shard != open_shard:
                    close()
                    open_shard = shard
                    begin(shard)
                if chunk < chunks:
                    continue
                if not ids.is_valid:
                    got = np.zeros(0, "<i4")
                else:
                    got = np.frombuffer(ids.as_buffer(), np.uint8).astype("<i4") if raw else np.asarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
                out.write(got.tobytes())
                count += len(got)
                chunks = chunk + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["shard_ix", "tokens", "resumed"])

    ordered = tokens.select(F.col("shard_ix").cast("int").alias("shard_ix"), F.col("chunk_ix").cast("bigint").alias("chunk_ix"), "ids").repartition("shard_ix").sortWithinPartitions("shard_ix", "chunk_ix")
    return ordered.mapInArrow(write, "shard_ix int, tokens bigint, resumed bigint").withColumn("n_bytes", F.col("tokens") * 4)


def _join(folder: str, target: str, shards: list[int]) -> None:
    """Copy the shards, one after the other, into one file, which appears under its name only when it is whole."""
    system, base = _place(folder)
    out_system, out_path = _place(target)
    out_system.create_dir(out_path.rpartition("/")[0], recursive=True)
    held = f"{out_path}.{uuid.uuid4().hex}.tmp"
    with out_system.open_output_stream(held) as out:
        for shard in shards:
            with system.open_input_file(f"{base}/shard_{shard:06d}.bin") as f:
                while block := f.read(COPY):
                    out.write(block)
    out_system.move(held, out_path)


def merge_shards(spark: SparkSession, folder: str, target: str) -> list[dict]:
    """Join all shards, in order, into one file. Every shard's size must equal its sidecar's tokens times four, else nothing is written
    and ValueError is raised. The parts come back with the position of their first token. One task copies (a file has one writer); the
    driver sees the sidecars only, never a token."""
    files = read_sidecars(spark, folder).orderBy("shard_ix").collect()
    bad = [r.shard_ix for r in files if r.n_bytes != 4 * r.tokens]
    if bad:
        raise ValueError(f"size and manifest differ in shards {bad}")
    shards = [r.shard_ix for r in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _join(folder, target, shards)
            yield batch

    spark.range(1, numPartitions=1).mapInArrow(run, "id bigint").collect()
    at, parts = 0, []
    for r in files:
        parts.append({"shard_ix": r.shard_ix, "first_token": at, "tokens": r.tokens})
        at += r.tokens
    return parts


def read_parts(spark: SparkSession, path: str, parts: list[dict], tokens_per_row: int = RANGE) -> DataFrame:
    """shard_ix, first_token, tokens, first and ids of the parts of a merged file: each task reads byte ranges that lie in one part."""
    ledger = spark.createDataFrame([(p["shard_ix"], p["first_token"], p["tokens"]) for p in parts], "shard_ix int, first_token bigint, tokens bigint")
    last = F.col("first_token") + F.col("tokens") - 1
    tasks = max(spark.sparkContext.defaultParallelism, sum(p["tokens"] for p in parts) // (64 * tokens_per_row))  # named, else small rows mean one task
    ranges = ledger.where("tokens > 0").withColumn("first", F.explode(F.sequence("first_token", last, F.lit(tokens_per_row).cast("bigint")))).repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, local = _place(path)
        with system.open_input_file(local) as f:
            for batch in batches:
                for i, (begin, tokens, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first_token", "tokens", "first")))):
                    f.seek(first * 4)
                    ids = np.frombuffer(f.read(4 * min(tokens_per_row, begin + tokens - first)), "<i4")
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, lists], names=[*batch.schema.names, "ids"])

    return ranges.mapInArrow(read, "shard_ix int, first_token bigint, tokens bigint, first bigint, ids array<int>")


def tear(spark: SparkSession, folder: str, garbage: bytes) -> None:
    """Append bytes to every shard, as a run that died while writing does (for checks of ``resume``)."""
    for r in read_sidecars(spark, folder).collect():
        system, base = _place(folder)
        path = f"{base}/shard_{r.shard_ix:06d}.bin"
        with system.open_input_file(path) as f:
            whole = f.read()
        _put(system, path, whole + garbage)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """shard_ix, tokens (as recorded), n_bytes (of the file, null if it is missing)."""
    listing = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("n_bytes"), "content")
    number = F.regexp_extract("path", r"shard_(\d+)\.", 1).cast("int").alias("shard_ix")
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "shard_*.json").load(folder).select(number, F.get_json_object(F.col("content").cast("string"), "$.tokens").cast("bigint").alias("tokens"))
    sizes = listing.where(F.col("path").endswith(".bin")).select(number, "n_bytes")
    return meta.join(sizes, "shard_ix", "left")


def write_texts(rows: DataFrame, folder: str, name: str, order: str, text: str, after: str = "\n\n") -> None:
    """One ``.txt`` per name in a shared folder: its texts in order, ``after`` behind each. A name's rows are sorted into one task and
    streamed out; the file appears under its name only when it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        open_name, out, held, done = None, None, "", []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(held, f"{base}/{open_name}.txt")
                done.append(open_name)

        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != open_name:
                    close()
                    open_name, held = n, f"{base}/.{uuid.uuid4().hex}.tmp"
                    out = system.open_output_stream(held)
                out.write((t + after).encode("utf-8", "replace"))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["name"])

    rows.select(name, order, text).repartition(name).sortWithinPartitions(name, order).mapInArrow(write, "name string").count()


def json_documents(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """One row per JSON file; a missing, broken or partial document gives the defaults for what it lacks."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("d"))
    fields = files.schema["d"].dataType.names
    return files.select("path", *[F.coalesce(F.col(f"d.{n}"), F.lit(defaults.get(n))).alias(n) for n in fields])


def write_sqlite(rows: DataFrame, path: str, name: str) -> None:
    """Rows as a table of a new SQLite file, by one task (SQLite has one writer); the file must be on a mounted path."""
    columns, local = rows.columns, _place(path)[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import sqlite3
        from contextlib import closing

        os.makedirs(os.path.dirname(local), exist_ok=True)
        held = f"{local}.{uuid.uuid4().hex}.tmp"
        with closing(sqlite3.connect(held)) as con:
            con.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
            for batch in batches:
                con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", zip(*(c.to_pylist() for c in batch.columns)))
            con.commit()
        os.replace(held, local)
        yield pa.RecordBatch.from_arrays([pa.array([local])], names=["path"])

    rows.coalesce(1).mapInArrow(write, "path string").collect()


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query over an SQLite file, opened read-only by the one task that reads it."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3
        from contextlib import closing

        for batch in batches:
            for name in batch.column(0).to_pylist():
                name = _place(name)[1]
                with closing(sqlite3.connect(f"file:{name}?mode=ro", uri=True, timeout=0.5)) as con:
                    cursor = con.execute(query)
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[d[0] for d in cursor.description])

    return spark.createDataFrame([(path,)], "path string").mapInArrow(read, schema)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files (``**/*.txt``, or one file) in sorted order: ordinal, path and whole text; raises when there is none."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if files.isEmpty():
        raise FileNotFoundError(f"no *.txt under {path}")
    return files.withColumn("ordinal", F.row_number().over(Window.orderBy("path")) - 1)


def byte_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw bytes of the corpus files in order: ordinal, path, first (position of the file's first byte) and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "length", "content")
    places = files.select("path", "length").withColumn("ordinal", F.row_number().over(Window.orderBy("path")) - 1)
    places = places.withColumn("first", F.coalesce(F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return places.join(files.select("path", "content"), "path").select("ordinal", "path", "first", "content")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """The file system as a table; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines run logs: path, kind, the parsed row as a map of texts, and ``corrupt`` for lines that are no object (kept)."""
    lines = spark.read.format("text").option("recursiveFileLookup", "true").load(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    fields = F.expr("from_json(line, 'map<string,string>')")
    kind = F.when(F.col("fields").isNull(), None).when(F.map_contains_key("fields", "args"), "header").when(F.map_contains_key("fields", "early_stop"), "early_stop").when(F.map_contains_key("fields", "train"), "step").otherwise("marker")
    return lines.where(F.trim("line") != "").withColumn("fields", fields).select("path", kind.alias("kind"), "fields", F.when(F.col("fields").isNull(), F.col("line")).alias("corrupt"))


def log_scrape(lines: DataFrame, line: str = "line") -> DataFrame:
    """``step N/T``, ``val=``, ``bpb=``, ``avg50=`` and tokens per second out of console lines; null where a line lacks them."""
    number = lambda p: F.regexp_extract(line, p, 1).try_cast("double")
    return lines.select(
        "*",
        F.regexp_extract(line, r"step\s+(\d+)", 1).try_cast("bigint").alias("step"),
        F.regexp_extract(line, r"step\s+\d+/(\d+)", 1).try_cast("int").alias("horizon"),
        number(r"val=\s*([0-9.eE+-]+)").alias("val"),
        number(r"bpb=\s*([0-9.eE+-]+)").alias("bpb"),
        number(r"avg50=\s*([0-9.eE+-]+)").alias("avg50"),
        number(r"([0-9.]+)\s*tok(?:ens)?/s").alias("tok_per_sec"),
    )
