"""Token-stream queries: byte streams per shard, splits, windows, probability arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, tokens
from ..operators.offsets import near_equal_chunks
from ..sources import tokenfiles
from ..sources.tables import table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query, relational = catalog.queries, catalog.sql, catalog.query, catalog.relational
_CTX = 512
_STREAMS = "s AS (SELECT source, sum(octet_length(encode(coalesce(text, '')))) AS n FROM documents GROUP BY source)"


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("n"))


@query(f"WITH {_STREAMS} SELECT source, CAST(floor(n * (1 - 0.01::DOUBLE)) AS BIGINT) AS cut, CASE WHEN n - floor(n * (1 - 0.01::DOUBLE)) >= {_CTX + 1} THEN CAST(n - floor(n * (1 - 0.01::DOUBLE)) AS BIGINT) END AS val_tokens FROM s")
def z01_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir).select("source", *tokens.tail_split(F.col("n"), 0.01, _CTX))


@query(f"WITH {_STREAMS} SELECT source, i AS draw_ix, CAST((i * 7919) % (n - {_CTX + 1}) AS BIGINT) AS \"offset\" FROM s, (SELECT unnest(range(64)) AS i) WHERE n > {_CTX + 1}")
def z05_strided_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.strided_offsets(_streams(spark, sf_dir), "n", _CTX, 64).select("source", "draw_ix", "offset")




@query(f"WITH {_STREAMS} SELECT source, i AS probe, CAST(i * greatest(1, (n - {_CTX + 1}) // 10) AS BIGINT) AS \"offset\" FROM s, (SELECT unnest(range(10)) AS i) WHERE n > {_CTX + 1}")
def z06_even_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.greatest(F.lit(1), F.floor((F.col("n") - _CTX - 1) / 10))
    return _streams(spark, sf_dir).where(F.col("n") > _CTX + 1).select("source", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("probe"), step.alias("step")).select("source", "probe", (F.col("probe") * F.col("step")).alias("offset"))


@query(f"WITH {_STREAMS} SELECT source, r AS region, CAST((n // 16) * r AS BIGINT) AS first_token, CAST((n // 16) // {_CTX} AS BIGINT) AS batches FROM s, (SELECT unnest(range(16)) AS r)")
def z07_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.floor(F.col("n") / 16)
    d = _streams(spark, sf_dir).select("source", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("region"), size.alias("size"))
    return d.select("source", "region", (F.col("size") * F.col("region")).alias("first_token"), F.floor(F.col("size") / _CTX).alias("batches"))


@query(f"WITH {_STREAMS} SELECT source, CAST(least(b * {_CTX}, greatest(n - {_CTX + 1}, 0)) AS BIGINT) AS start, b AS batch_ix FROM s, (SELECT unnest(range(8)) AS b)")
def z08_batch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _streams(spark, sf_dir).select("source", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("batch_ix"))
    return d.select("source", F.least((F.col("batch_ix") * _CTX).cast("bigint"), F.greatest(F.col("n") - _CTX - 1, F.lit(0))).alias("start"), "batch_ix")


@query(f"WITH {_STREAMS} SELECT source, count(*) AS windows, max(o) AS last_offset FROM (SELECT source, unnest(range(0::BIGINT, (n - {_CTX})::BIGINT, {_CTX // 2}::BIGINT)) AS o FROM s WHERE n >= {_CTX + 1}) GROUP BY source")
def z09_half_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.windows_of(_streams(spark, sf_dir), "n", _CTX, _CTX // 2).groupBy("source").agg(F.count(F.lit(1)).alias("windows"), F.max("offset").alias("last_offset"))


@query(f"WITH {_STREAMS} SELECT source, CAST(floor(n * 0.05::DOUBLE) AS BIGINT) AS head_end, CAST(n - floor(n * 0.05::DOUBLE) AS BIGINT) AS tail_start FROM s")
def z10_head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.floor(F.col("n") * 0.05)
    return _streams(spark, sf_dir).select("source", part.alias("head_end"), (F.col("n") - part).alias("tail_start"))


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) >= 2),
w AS (SELECT doc_id, h, n, unnest(range(0, n - 1, 16)) AS o FROM b)
SELECT doc_id, CAST(o AS INT) AS "offset", substr(h, 2 * o + 1, 2 * least(16, n - 1 - o)) AS x, substr(h, 2 * o + 3, 2 * least(16, n - 1 - o)) AS y FROM w""")
def d12_shifted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of each whole text and the same window one token later."""
    w = tokens.all_pairs(table(spark, sf_dir, "documents"), 16)
    return w.select("doc_id", "offset", F.hex("x").alias("x"), F.hex("y").alias("y"))


@query("WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) SELECT CAST('0x' || h AS INT) AS id, count(*) AS n FROM b GROUP BY h ORDER BY n DESC, id LIMIT 10")
def a24_top_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = corpus.byte_histogram(table(spark, sf_dir, "documents").withColumn("g", F.lit("all")), "g")
    return h.select(F.col("byte").alias("id"), "n").orderBy(F.desc("n"), "id").limit(10)


@query("WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) SELECT count(*) AS used, round(count(*) / 256::DOUBLE, 9) AS share FROM b")
def a27_vocabulary_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = corpus.byte_histogram(table(spark, sf_dir, "documents").withColumn("g", F.lit("all")), "g")
    return h.agg(F.count(F.lit(1)).alias("used")).withColumn("share", F.round(F.col("used") / 256.0, 9))


@query("WITH b AS (SELECT DISTINCT CAST('0x' || h AS INT) AS id FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)) SELECT CAST(i AS INT) AS id FROM range(256) AS r(i) WHERE i NOT IN (SELECT id FROM b)")
def u07_missing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = corpus.byte_histogram(table(spark, sf_dir, "documents").withColumn("g", F.lit("all")), "g")
    return spark.range(256).select(F.col("id").cast("int").alias("id")).join(h.select(F.col("byte").alias("id")), "id", "left_anti")


_SOFT = "list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))"


@query(f"""WITH p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, {_SOFT} AS e FROM embeddings))
SELECT vec_id, list_position(p, list_max(p)) - 1 AS top_id, round(list_max(p), 9) AS top_p, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 6) AS entropy FROM p""")
def a29_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", tokens.softmax(F.col("embedding")).alias("p")).select("vec_id", *tokens.distribution(F.col("p")))
    return d.select("vec_id", "top_id", F.round("top_p", 9).alias("top_p"), F.round("entropy", 6).alias("entropy"))


@query(f"""WITH p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, {_SOFT} AS e FROM embeddings)), u AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS id FROM p)
SELECT vec_id, id, rank FROM (SELECT vec_id, id, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) AS rank FROM u) WHERE rank <= 5""")
def l04_top_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", tokens.softmax(F.col("embedding")).alias("p"))
    pairs = F.transform("p", lambda v, i: F.struct((-v).alias("v"), i.alias("id")))
    return p.select("vec_id", F.posexplode(F.slice(F.array_sort(pairs), 1, 5)).alias("rank", "e")).select("vec_id", F.col("e.id").alias("id"), (F.col("rank") + 1).alias("rank"))


@query(f"""WITH p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, {_SOFT} AS e FROM embeddings))
SELECT vec_id, round(least(1, greatest(0, -list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p)))), 6) AS flatness FROM p""")
def a31_normalised_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", tokens.softmax(F.col("embedding")).alias("p"))
    h = F.aggregate("p", F.lit(0.0), lambda a, x: a - x * F.log(x))
    return p.select("vec_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h / F.log(F.size("p")))), 6).alias("flatness"))


@query("SELECT label, count(*) AS n, round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label % len(embedding) THEN 1 ELSE 0 END), 9) AS accuracy FROM embeddings GROUP BY label")
def r20_argmax_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.array_position("embedding", F.array_max("embedding")) - 1 == F.col("label") % F.size("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 9).alias("accuracy"))


@query("SELECT vec_id, round(embedding[len(embedding) // 2 + 1]::DOUBLE, 6) AS middle, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings")
def r18_middle_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(e, F.expr("CAST(size(embedding) div 2 + 1 AS INT)")).cast("double"), 6).alias("middle"), F.round(F.element_at(e, -1).cast("double"), 6).alias("last"))





@query()
def s11_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale directory as a table of files."""
    return tokenfiles.file_table(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "n_bytes")


@query("""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, CAST(least((row_number() OVER (ORDER BY doc_id) - 1) // greatest((SELECT count(*) FROM documents) // 4, 1), 3) AS BIGINT) AS chunk FROM documents""")
def r05_line_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts, and four near-equal chunks with the remainder in the last."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"))
    return near_equal_chunks(lines, "doc_id", 4)
