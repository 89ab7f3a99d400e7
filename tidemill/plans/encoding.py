"""Encoding by a pair vocabulary, token files and their ledgers, and sources that are files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, offsets, tokens
from ..session import cut, shared_folder
from ..sources import tokenfiles
from ..sources.tables import spread, table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query = catalog.queries, catalog.sql, catalog.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _encoded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns, the text (null is empty) and its ids."""
    d = _docs(spark, sf_dir).select("doc_id", *columns, F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("e", tokens.encode_column(tokens.public_vocabulary(), "text")).select("doc_id", *columns, "text", F.col("e.ids").alias("ids"))


@query()
def t03_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text."""
    return _encoded(spark, sf_dir).select("doc_id", "ids")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def t04_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded: nothing may be lost."""
    return _encoded(spark, sf_dir).select("doc_id", tokens.decode_column(tokens.public_vocabulary(), "ids").alias("text"))


_END = tokens.END_MARK


@query(f"SELECT doc_id, len(string_split(coalesce(text, ''), '{_END}')) AS marks, true AS apart FROM documents")
def t05_end_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, end mark, language: the mark is one id of its own, and what is before and after it is encoded as if alone."""
    v = tokens.public_vocabulary()
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("a"), F.coalesce("lang", F.lit("")).alias("b"))
    d = d.withColumn("ea", tokens.encode_column(v, "a")).withColumn("eb", tokens.encode_column(v, "b")).withColumn("e", tokens.encode_column(v, F.concat("a", F.lit(_END), "b")))
    apart = F.concat("ea.ids", F.array(F.lit(v.end_id)), "eb.ids") == F.col("e.ids")
    return d.select("doc_id", F.size(F.filter("e.ids", lambda i: i == v.end_id)).cast("bigint").alias("marks"), apart.alias("apart"))


_SPACES = {" " * n: 60_000 + n for n in range(2, 17)}


@query("SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), ' {2,16}'), lambda x: length(x)) AS runs FROM documents")
def t06_added_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 2 to 16 blanks as literals of their own, longest first: the lengths of the runs in each text, read off the ids."""
    v = tokens.PairVocabulary(tokens.public_vocabulary().pieces, tokens.public_vocabulary().ranks, _SPACES)
    d = _docs(spark, sf_dir).select("doc_id", tokens.encode_column(v, "text").alias("e"))
    return d.select("doc_id", F.transform(F.filter("e.ids", lambda i: i >= 60_000), lambda i: (i - 60_000).cast("bigint")).alias("runs"))


@query("SELECT CAST(b AS INT) AS id, 1 AS n_bytes FROM range(256) AS r(b)")
def t07_base_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of one byte of a vocabulary that was saved as JSON and loaded again: all 256 are there, so any text can be encoded."""
    v = tokens.PairVocabulary.from_json(tokens.public_vocabulary().to_json())
    return spark.createDataFrame([(p[0], len(p)) for p in v.pieces if len(p) == 1], "id int, n_bytes int")


_AT_ONCE = 16_000


def _resilient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "text", tokens.encode_column(tokens.public_vocabulary(), "text", _AT_ONCE).alias("e"))


@query(f"SELECT doc_id, coalesce(text, '') AS text, coalesce(length(text), 0) > {_AT_ONCE} AS was_cut FROM documents")
def t12_resilient_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding with an encoder that refuses long texts: they are cut and encoded in order, and nothing is lost."""
    d = _resilient(spark, sf_dir)
    return d.select("doc_id", tokens.decode_column(tokens.public_vocabulary(), "e.ids").alias("text"), (F.size("e.errors") > 0).alias("was_cut"))


@query(f"SELECT doc_id, length(text) AS chars, substring(text, 1, 400) AS snippet FROM documents WHERE length(text) > {_AT_ONCE}")
def k07_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode failures as JSON lines in the shared folder, read back: one line per failing text, with all its errors and how it begins."""
    at = f"{shared_folder(spark)}/errors-{uuid.uuid4().hex}"
    failed = _resilient(spark, sf_dir).where(F.size("e.errors") > 0)
    lines = failed.select(F.to_json(F.struct("doc_id", F.current_timestamp().alias("when"), F.length("text").alias("chars"), F.col("e.errors").alias("errors"), F.substring("text", 1, 400).alias("snippet"))).alias("value"))
    lines.write.text(at)
    return spark.read.schema("doc_id bigint, chars bigint, errors array<string>, snippet string").json(at).where(F.size("errors") > 0).select("doc_id", "chars", "snippet")


_RANGES = 4


@query(f"""WITH t AS (SELECT doc_id, text, length(text) AS n, unnest(range(1, {_RANGES + 1})) AS k FROM documents WHERE text <> ''),
c AS (SELECT doc_id, n, k, CASE WHEN k = {_RANGES} OR strpos(substring(text, n * k // {_RANGES} + 1), chr(10)) = 0 THEN n ELSE n * k // {_RANGES} + strpos(substring(text, n * k // {_RANGES} + 1), chr(10)) END AS stop FROM t)
SELECT doc_id, k - 1 AS part, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY k), 0) AS start, stop FROM c""")
def t15_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in four ranges that end with a line: the ends are the first line ends at or after a quarter, half, three quarters."""
    return _line_ranges(_docs(spark, sf_dir)).select("doc_id", "part", "start", "stop")


def _line_ranges(docs: DataFrame, parts: int = _RANGES) -> DataFrame:
    """doc_id, text, part, start and stop (characters before the range, and up to its end)."""
    d = docs.where("text <> ''").select("doc_id", "text", F.length("text").alias("n"))
    stops = ", ".join([f"IF(locate('\\n', text, n * {k} div {parts} + 1) = 0, n, locate('\\n', text, n * {k} div {parts} + 1))" for k in range(1, parts)] + ["n"])
    d = d.withColumn("stops", F.expr(f"array({stops})"))
    return d.select("doc_id", "text", F.posexplode("stops").alias("part", "stop"), F.concat(F.array(F.lit(0)), "stops").alias("s")).select("doc_id", "text", "part", F.expr("s[part]").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query()
def t22_split_selftest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at their line ranges: of how many do the ranges' ids, joined, equal the ids of the whole?"""
    v = tokens.public_vocabulary()
    d = _line_ranges(_docs(spark, sf_dir)).where("stop > start").withColumn("p", tokens.encode_column(v, F.expr("substring(text, CAST(start + 1 AS INT), CAST(stop - start AS INT))")))
    joined = d.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col("p.ids").alias("ids")))), lambda x: x["ids"])).alias("joined"), F.count(F.lit(1)).alias("ranges"))
    both = joined.join(_encoded(spark, sf_dir).select("doc_id", "ids"), "doc_id")
    return both.groupBy("ranges").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("joined") == F.col("ids")).alias("agree"))


@query()
def t19_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven checks over the ids of the whole corpus: name, ok and a count."""
    e = cut(_encoded(spark, sf_dir))
    manifest = e.agg(F.sum(F.size("ids").cast("bigint"))).first()[0] or 0
    return tokens.check_stream(e, tokens.public_vocabulary(), manifest)


@query()
def t20_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: windows of 512 ids at twenty even places of each text, and how many survive decoding and encoding exactly."""
    d = _encoded(spark, sf_dir, "source").select("source", tokens.exact_windows(tokens.public_vocabulary(), "ids", 512, 20).alias("w"))
    return d.groupBy("source").agg(F.sum("w.windows").alias("windows"), F.sum("w.exact").alias("exact"))


@query()
def t23_chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: characters, tokens, their ratio, and the bytes that a file of the tokens takes."""
    d = _encoded(spark, sf_dir, "source").groupBy("source").agg(F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum(F.size("ids").cast("bigint")).alias("tokens"))
    return d.select("source", "chars", "tokens", F.round(F.col("chars") / F.nullif("tokens", F.lit(0)), 6).alias("chars_per_token"), (F.col("tokens") * 4).alias("n_bytes"))


def _id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, "source").select("source", F.explode("ids").alias("id")).groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"))


@query()
def a06_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per token of each source."""
    return corpus.entropy(_id_counts(spark, sf_dir), "source")


@query()
def a23_bytes_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the ids of a source decode to, by id (1.0 for a source without tokens)."""
    v = tokens.public_vocabulary()
    sizes = spark.createDataFrame([(i, len(p)) for i, p in v.names.items()], "id int, n_bytes int")  # one row per id of a fixed vocabulary
    held = _id_counts(spark, sf_dir).join(F.broadcast(sizes), "id").groupBy("source").agg(F.sum(F.col("n") * F.col("n_bytes")).alias("bytes"), F.sum("n").alias("tokens"))
    every = _docs(spark, sf_dir).select("source").distinct().withColumnRenamed("source", "s")
    d = every.join(held, F.col("s").eqNullSafe(F.col("source")), "left")
    return d.select(F.col("s").alias("source"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("bytes") / F.col("tokens"), F.lit(1.0)), 6).alias("bytes_per_token"))


# Token files: byte tokens of every source as one shard, in chunks of one text.

_SHARDS = """sh AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS shard_ix FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND text <> '')),
b AS (SELECT shard_ix, CAST('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) AS BIGINT) AS id FROM documents d JOIN sh ON d.source = sh.source),
t AS (SELECT CAST(shard_ix AS INT) AS shard_ix, count(*) AS tokens, CAST(sum(id) AS BIGINT) AS id_sum FROM b GROUP BY shard_ix)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_ix, chunk_ix and ids (the text's bytes); one row per source is all that the window without partition sees."""
    d = _docs(spark, sf_dir).where("text <> '' AND source IS NOT NULL").select("doc_id", "source", "text")
    shards = d.select("source").distinct().withColumn("shard_ix", F.row_number().over(Window.orderBy("source")) - 1)
    rows = d.select("doc_id", "source", F.col("text").cast("binary").alias("ids"))
    numbered = offsets.running_total(rows, "doc_id", F.lit(1).cast("bigint"), ["source"], "chunk_ix")
    return numbered.join(shards, "source").select("shard_ix", "chunk_ix", "ids")


def _written(spark: SparkSession, sf_dir: str) -> str:
    at = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_token_shards(_chunks(spark, sf_dir), at).count()
    return at


def _sums(rows: DataFrame) -> DataFrame:
    shard = F.regexp_extract("path", r"shard_(\d+)\.bin", 1).cast("int")
    return rows.select(shard.alias("shard_ix"), "first", "ids").groupBy("shard_ix").agg(
        F.sum(F.size("ids").cast("bigint")).alias("tokens"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + i)).alias("id_sum")
    )


@query(f"WITH {_SHARDS} SELECT * FROM t")
def s03_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as a token file, written to the shared folder and read back by byte ranges."""
    return _sums(tokenfiles.read_token_files(spark, _written(spark, sf_dir), 10_000))


@query(f"WITH {_SHARDS} SELECT * FROM t")
def k01_resumed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped after the first chunks and left torn bytes behind, resumed: the same files as without the stop."""
    chunks = cut(_chunks(spark, sf_dir))
    at = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_token_shards(chunks.where("chunk_ix < 3"), at).count()
    tokenfiles.tear(spark, at, b"\x01\x02\x03\x04\x05")
    tokenfiles.write_token_shards(chunks, at, resume=True).count()
    return _sums(tokenfiles.read_token_files(spark, at, 10_000))


@query(f"WITH {_SHARDS} SELECT shard_ix, CAST(coalesce(sum(tokens) OVER (ORDER BY shard_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_token, tokens, id_sum FROM t")
def k08_merged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards joined into one file in order, each shard's tokens found again at its place in it."""
    at = _written(spark, sf_dir)
    parts = tokenfiles.merge_shards(spark, at, f"{at}/merged/all.bin")
    rows = tokenfiles.read_parts(spark, f"{at}/merged/all.bin", parts)
    return rows.groupBy("shard_ix", "first_token", "tokens").agg(F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + i)).alias("id_sum"))


@query(f"WITH {_SHARDS} SELECT shard_ix, tokens, 4 * tokens AS n_bytes, true AS agrees FROM t")
def k02_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file's sidecar says beside the file's size."""
    return tokenfiles.read_sidecars(spark, _written(spark, sf_dir)).select("shard_ix", "tokens", "n_bytes", (F.col("n_bytes") == 4 * F.col("tokens")).alias("agrees"))


@query("SELECT id, status FROM executions WHERE job_id IS NOT NULL")
def s10_sqlite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an SQLite file, opened read-only. The file is a copy of a table, written by one task, as SQLite has one writer."""
    at = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}"
    tokenfiles.write_sqlite(table(spark, sf_dir, "executions").select("id", "job_id", "status"), at, "executions")
    return tokenfiles.sqlite_table(spark, at, "SELECT id, status FROM executions WHERE job_id IS NOT NULL", "id string, status string")
