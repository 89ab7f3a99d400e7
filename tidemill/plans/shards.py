"""Shard ledgers, comparisons of headers and sequences, keep and drop sets, and files as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, offsets, registry
from ..session import shared_folder
from ..sources import tokenfiles
from ..sources.tables import table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query = catalog.queries, catalog.sql, catalog.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Ledgers: what a shard's records claim (n_chars) beside what its texts hold


@query("""WITH d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS claimed, coalesce(length(text), 0) AS held FROM documents WHERE source IS NOT NULL),
s AS (SELECT source, sum(claimed) AS claimed, sum(held) AS held FROM d GROUP BY source),
r AS (SELECT d.source, d.claimed, sum(d.claimed) OVER (PARTITION BY d.source ORDER BY doc_id) AS upto, s.claimed AS total, s.held FROM d JOIN s ON d.source = s.source)
SELECT source, CASE WHEN any_value(held) = any_value(total) THEN 'equal' WHEN any_value(held) > any_value(total) THEN 'trim' ELSE 'shrink' END AS state,
count_if(held >= total OR upto <= held) AS records, CAST(coalesce(sum(CASE WHEN held >= total OR upto <= held THEN claimed END), 0) AS BIGINT) AS kept FROM r GROUP BY source""")
def j10_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each shard against what is there: equal; more is there (cut to the records); less is there (the longest prefix of
    records that fits is kept)."""
    d = _docs(spark, sf_dir).where("source IS NOT NULL").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("claimed"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("held"))
    return registry.reconciled(d, "source", "doc_id", "claimed", "held")


@query("""SELECT source, CAST(sum(n_chars) AS BIGINT) AS claimed, CAST(sum(length(text)) AS BIGINT) AS actual, CASE WHEN sum(n_chars) IS NULL OR sum(length(text)) IS NULL THEN 'no sidecar'
WHEN sum(n_chars) <> sum(length(text)) THEN 'sidecar is stale' ELSE 'usable' END AS verdict FROM documents GROUP BY source""")
def z02_stale_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards whose recorded length differs from their actual one are refused, with the reason."""
    d = _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("claimed"), F.sum(F.length("text").cast("bigint")).alias("actual"))
    same = F.col("claimed") == F.col("actual")
    return d.withColumn("verdict", F.when(same.isNull(), "no sidecar").when(~same, "sidecar is stale").otherwise("usable"))


@query()
def j11_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as parts of a run: the stretches of 100 steps that each covers. Parts with holes and parts that overlap an earlier
    one are set aside; the stretches that no trusted part covers are the gaps."""
    steps = table(spark, sf_dir, "loss").where("kind = 'step' AND step IS NOT NULL AND run IS NOT NULL").select("run", F.col("attempt").alias("part"), F.floor(F.col("step") / 100).alias("ix"))
    return registry.scanned_parts(steps.distinct(), "run", "part", "ix")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents WHERE source IS NOT NULL AND text <> '') WHERE upto <= 20000""")
def l10_budget_limit(spark: SparkSession, sf_dir: str, budget: int = 20_000) -> DataFrame:
    """The texts of each shard, in order, that fit its character budget."""
    d = _docs(spark, sf_dir).where("source IS NOT NULL AND text <> ''").select("source", "doc_id", F.length("text").cast("bigint").alias("n"))
    return offsets.running_total(d, "doc_id", F.col("n"), ["source"]).where(F.col("before") + F.col("n") <= budget).select("source", "doc_id")


_SHARD_ROWS = "(SELECT source, row_number() OVER (ORDER BY source) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"


@query(f"""SELECT worker, min(source) AS first_shard, max(source) AS last_shard, count(*) AS shards FROM (SELECT source, CASE WHEN ix < (n % 8) * (n // 8 + 1) THEN ix // (n // 8 + 1)
ELSE (n % 8) + (ix - (n % 8) * (n // 8 + 1)) // greatest(n // 8, 1) END AS worker FROM {_SHARD_ROWS}) GROUP BY worker""")
def w18_blocks(spark: SparkSession, sf_dir: str, workers: int = 8) -> DataFrame:
    """Contiguous blocks of shards for eight workers, the first ones larger by one; never a worker without a shard."""
    shards = _docs(spark, sf_dir).where("source IS NOT NULL").select("source").distinct()
    placed = shards.withColumn("worker", F.ntile(workers).over(Window.orderBy("source")) - 1)
    return placed.groupBy("worker").agg(F.min("source").alias("first_shard"), F.max("source").alias("last_shard"), F.count(F.lit(1)).alias("shards"))


_DONE = "SELECT DISTINCT d.source FROM documents d JOIN doc_labels l ON d.doc_id = l.doc_id WHERE d.source IS NOT NULL"


@query(f"SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT IN ({_DONE})")
def u05_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with nothing done yet: no text of theirs has a label."""
    d = _docs(spark, sf_dir).where("source IS NOT NULL")
    return d.select("source").distinct().exceptAll(d.join(table(spark, sf_dir, "doc_labels").select("doc_id"), "doc_id", "left_semi").select("source").distinct())


@query("SELECT DISTINCT source FROM documents WHERE lang = 'de' AND source IN (SELECT source FROM documents WHERE lang = 'es')")
def u05_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that hold texts of both languages."""
    d = _docs(spark, sf_dir).where("source IS NOT NULL")
    return d.where("lang = 'de'").select("source").intersect(d.where("lang = 'es'").select("source"))


@query("""SELECT 'tasks' AS part, id, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT DISTINCT id FROM tasks WHERE id IS NOT NULL)
UNION ALL SELECT 'jobs', id, (SELECT count(DISTINCT id) FROM tasks) + row_number() OVER (ORDER BY id) - 1 FROM (SELECT DISTINCT id FROM jobs WHERE id IS NOT NULL)""")
def u08_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts one after the other, each in order, with every row's place in the whole: range partitions numbered by their sizes."""
    ids = lambda name, no: table(spark, sf_dir, name).where("id IS NOT NULL").select(F.lit(no).alias("no"), F.lit(name).alias("part"), "id").distinct()
    return offsets.numbered(ids("tasks", 0).unionByName(ids("jobs", 1)), ["no", "id"], "place").select("part", "id", "place")


@query("SELECT p AS pattern, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents, (VALUES ('web_*', '^web_.*$'), ('b?ok_*1', '^b.ok_.*1$'), ('*', '^.*$')) AS g(p, r) WHERE regexp_matches(source, r) GROUP BY p")
def r09_pattern_sizes(spark: SparkSession, sf_dir: str, patterns: tuple[str, ...] = ("web_*", "b?ok_*1", "*")) -> DataFrame:
    """Files and bytes that match each glob pattern, all patterns in one pass."""
    regex = {p: "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in p) + "$" for p in patterns}
    hits = F.array_compact(F.array(*[F.when(F.col("source").rlike(r), F.lit(p)) for p, r in regex.items()]))
    return _docs(spark, sf_dir).select(F.explode(hits).alias("pattern"), "n_chars").groupBy("pattern").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("n_bytes"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), k AS (SELECT DISTINCT split_part(source, '_', 1) AS stem FROM s)
SELECT stem, CASE WHEN n = 1 THEN picked END AS picked, n = 1 AS taken, (SELECT min(source) FROM s WHERE NOT contains(source, stem)) AS other
FROM (SELECT stem, count(*) AS n, min(source) AS picked FROM k JOIN s ON contains(source, stem) GROUP BY stem)""")
def r02_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stem the one shard whose name holds it, refused if there are several; and the first shard that does not hold it."""
    s = _docs(spark, sf_dir).where("source IS NOT NULL").select("source").distinct()
    names = s.agg(F.array_sort(F.collect_set("source")).alias("names"))  # one row: the names of the shards
    k = names.select("names", F.explode(F.array_distinct(F.transform("names", lambda n: F.element_at(F.split(n, "_"), 1)))).alias("stem"))
    k = k.withColumn("hits", F.filter("names", lambda n: F.contains(n, F.col("stem")))).withColumn("rest", F.filter("names", lambda n: ~F.contains(n, F.col("stem"))))
    one = F.size("hits") == 1
    return k.select("stem", F.when(one, F.element_at("hits", 1)).alias("picked"), one.alias("taken"), F.try_element_at("rest", F.lit(1)).alias("other"))


# Copies against their keepers


@query("""WITH g AS (SELECT doc_id, text, md5(substring(text, 1, 40)) AS k FROM documents WHERE text <> ''), m AS (SELECT k, min(doc_id) AS keeper FROM g GROUP BY k),
h AS (SELECT g.k, substring(md5(g.text), 1, 12) AS hash FROM g JOIN m ON g.doc_id = m.keeper)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 'missing' WHEN starts_with(md5(d.text), h.hash) THEN 'ok' ELSE 'mismatch' END AS state FROM documents d LEFT JOIN h ON md5(substring(d.text, 1, 40)) = h.k""")
def j12_keeper_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against the index entry of its opening (a hash of twelve digits, so compared by prefix): missing, ok or mismatch."""
    d = _docs(spark, sf_dir).select("doc_id", "text", F.md5(F.substring("text", 1, 40)).alias("k"))
    index = d.where("text <> ''").groupBy("k").agg(F.min_by(F.substring(F.md5("text"), 1, 12), "doc_id").alias("hash")).withColumnRenamed("k", "key")
    met = d.join(index, (F.col("k") == F.col("key")) & (F.col("text") != ""), "left")
    return met.select("doc_id", F.when(F.col("hash").isNull(), "missing").when(F.startswith(F.md5("text"), F.col("hash")), "ok").otherwise("mismatch").alias("state"))


@query("SELECT doc_id, sha256(text) AS sha, true AS verified FROM documents WHERE text IS NOT NULL")
def k14_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verified copy: texts are written to the shared folder beside a manifest of their hashes, read back and hashed again."""
    at = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    d = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text")
    d.write.parquet(f"{at}/texts")
    d.select("doc_id", F.sha2("text", 256).alias("sha")).write.parquet(f"{at}/manifest")
    back = spark.read.parquet(f"{at}/texts").select("doc_id", F.sha2("text", 256).alias("copied"))
    return spark.read.parquet(f"{at}/manifest").join(back, "doc_id").select("doc_id", "sha", (F.col("sha") == F.col("copied")).alias("verified"))


_LAGGED = "(SELECT doc_id, lag(doc_id) OVER w AS before, hex(encode(text)) AS h, lag(hex(encode(text))) OVER w AS h0 FROM documents WHERE text <> '' WINDOW w AS (PARTITION BY source ORDER BY doc_id))"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, x and y (bytes of the text before it in its shard, and its own): positions are numbered in two levels, then joined."""
    d = _docs(spark, sf_dir).where("text <> ''").select("doc_id", "source")
    n = offsets.running_total(d, "doc_id", F.lit(1).cast("bigint"), ["source"], "ix")
    before = n.select(F.col("source").alias("s"), (F.col("ix") + 1).alias("i"), F.col("doc_id").alias("before"))
    pairs = n.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("ix") == F.col("i"))).select("doc_id", "before")
    raw = corpus.byte_ids(_docs(spark, sf_dir).where("text <> ''")).select("doc_id", "ids")
    return pairs.join(raw, "doc_id").withColumnRenamed("ids", "y").join(raw.select(F.col("doc_id").alias("before"), F.col("ids").alias("x")), "before")


def _shared(x: Column, y: Column) -> Column:
    return F.least(F.size(x), F.size(y), F.lit(1_000_000))


@query(f"""SELECT doc_id, CASE WHEN length(h0) < length(h) THEN -1 ELSE len(list_filter(range(1, least(length(h), length(h0)) // 2 + 1), lambda i: substring(h, 2 * i - 1, 2) = substring(h0, 2 * i - 1, 2))) END AS agree
FROM {_LAGGED} WHERE before IS NOT NULL""")
def t21_prefix_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first ids (a million at most) of a text and the one before it in its shard, how many agree; -1 if the older is shorter."""
    d = _neighbours(spark, sf_dir)
    n = _shared(F.col("x"), F.col("y"))
    same = F.size(F.filter(F.arrays_zip(F.slice("x", F.lit(1), n).alias("a"), F.slice("y", F.lit(1), n).alias("b")), lambda z: z["a"] == z["b"]))
    return d.select("doc_id", F.when(F.size("x") < F.size("y"), -1).otherwise(same).cast("bigint").alias("agree"))


@query(f"""SELECT doc_id, length(h) // 2 AS n, length(h0) // 2 AS n_before, h = h0 AS identical FROM {_LAGGED} WHERE before IS NOT NULL""")
def r15_sequence_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text's ids are, position by position, those of the text before it in its shard; and both lengths."""
    d = _neighbours(spark, sf_dir)
    differing = F.exists(F.arrays_zip(F.col("x").alias("a"), F.col("y").alias("b")), lambda z: ~z["a"].eqNullSafe(z["b"]))
    return d.select("doc_id", F.size("y").cast("bigint").alias("n"), F.size("x").cast("bigint").alias("n_before"), (~differing).alias("identical"))


# Headers against the headers before them

_HEAD = """h AS (SELECT producer, file_seq, first(body ORDER BY rec_id) AS body FROM loss_file_records WHERE json_extract(body, '$.args') IS NOT NULL GROUP BY 1, 2)"""
_SETTINGS = ("tokenizer", "corpus", "ctx", "val_frac")
_TEXTS = ", ".join(f"json_extract_string(body, '$.args.{k}') AS {k}" for k in _SETTINGS)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.header_args(table(spark, sf_dir, "loss_file_records"))


@query(f"""WITH {_HEAD}, s AS (SELECT producer, file_seq, {_TEXTS} FROM h), p AS (SELECT *, lag(file_seq) OVER w AS before, {", ".join(f"lag({k}) OVER w AS {k}0" for k in _SETTINGS)} FROM s WINDOW w AS (PARTITION BY producer ORDER BY file_seq))
SELECT producer, file_seq, {" OR ".join(f"{k} IS DISTINCT FROM {k}0" for k in _SETTINGS)} AS invalid FROM p WHERE before IS NOT NULL""")
def r04_settings_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was made under the settings of the file before is invalid now: any of them differs, null being a value."""
    a = registry.arms(table(spark, sf_dir, "loss_file_records")).where("control_seq IS NOT NULL")
    changed = F.lit(False)
    for k in _SETTINGS:
        changed = changed | ~F.col("args")[k].eqNullSafe(F.col("control_args")[k])
    return a.select("producer", "file_seq", changed.alias("invalid"))


@query(f"""WITH {_HEAD}, k AS (SELECT producer, file_seq, list_sort(list_transform(json_keys(body, '$.args'), lambda x: x || '=' || coalesce(json_extract_string(body, '$.args."' || x || '"'), ''))) AS a FROM h),
p AS (SELECT *, lag(a) OVER (PARTITION BY producer ORDER BY file_seq) AS b FROM k)
SELECT producer, file_seq, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS differing, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) = 1 AS one FROM p WHERE b IS NOT NULL""")
def r22_positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which a header's sorted arguments and those of the file before differ, and whether it is exactly one."""
    a = registry.arms(table(spark, sf_dir, "loss_file_records")).where("control_seq IS NOT NULL")
    words = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    n = F.size(F.filter(F.arrays_zip(words("args").alias("a"), words("control_args").alias("b")), lambda z: ~z["a"].eqNullSafe(z["b"]))).cast("bigint")
    return a.select("producer", "file_seq", n.alias("differing"), (n == 1).alias("one"))


@query(f"""WITH {_HEAD}, s AS (SELECT producer, file_seq, {_TEXTS} FROM h WHERE json_extract_string(body, '$.args.tokenizer') IS NOT NULL AND json_extract_string(body, '$.args.corpus') IS NOT NULL AND json_extract_string(body, '$.args.val_frac') IS NOT NULL)
SELECT producer, file_seq, first_value(producer || ':' || file_seq) OVER (PARTITION BY tokenizer, corpus, val_frac ORDER BY producer, file_seq) AS class, count(*) OVER (PARTITION BY tokenizer, corpus, val_frac) - 1 AS comparable FROM s""")
def p23_comparable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that may be compared share tokenizer, corpus and held-out share, none of them null: each run's class and its number of
    partners (pairs are not written out)."""
    keys = ["tokenizer", "corpus", "val_frac"]
    s = _headers(spark, sf_dir).select("producer", "file_seq", *[F.col("args")[k].alias(k) for k in keys]).dropna(subset=keys)
    first = F.min(F.struct("producer", "file_seq")).alias("f")
    classes = s.groupBy(*keys).agg(first, (F.count(F.lit(1)) - 1).alias("comparable")).select(*keys, F.concat("f.producer", F.lit(":"), F.col("f.file_seq").cast("string")).alias("class"), "comparable")
    return s.join(classes, keys).select("producer", "file_seq", "class", "comparable")


#: The tokens after which checkpoints are kept for comparison.
ANCHOR_TOKENS = (2_097_152_000, 4_194_304_000)


@query(f"""WITH d AS (SELECT DISTINCT producer, file_seq, CAST(json_extract(body, '$.args') AS VARCHAR) AS a FROM loss_file_records WHERE json_extract(body, '$.args') IS NOT NULL),
o AS (SELECT producer, file_seq, any_value(a) AS a FROM d GROUP BY 1, 2 HAVING count(*) = 1),
e AS (SELECT producer, file_seq, try_cast(json_extract_string(a, '$.batch') AS BIGINT) * coalesce(try_cast(json_extract_string(a, '$.accum') AS BIGINT), 1) * try_cast(json_extract_string(a, '$.ctx') AS BIGINT) AS eff FROM o)
SELECT producer, file_seq, t // eff AS anchor FROM e, (VALUES (2097152000), (4194304000)) AS v(t) WHERE eff > 0 AND t % eff = 0""")
def j15_anchor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each run that are token-exact for an anchor, by the run's own tokens a step. A file with no or several different
    headers has none: a guessed batch would protect the wrong step."""
    r = table(spark, sf_dir, "loss_file_records").select("producer", "file_seq", F.get_json_object("body", "$.args").alias("a")).where("a IS NOT NULL").distinct()
    one = r.groupBy("producer", "file_seq").agg(F.min("a").alias("a"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return registry.anchor_steps(one.select("producer", "file_seq", F.from_json("a", "map<string,string>").alias("args")), ANCHOR_TOKENS)


# Files


def _text_tree(spark: SparkSession, sf_dir: str) -> str:
    """Every shard as a text file in the shared folder: its texts in order, a blank line after each."""
    at = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    d = _docs(spark, sf_dir).where("source IS NOT NULL AND text <> ''").select("source", "doc_id", "text")
    tokenfiles.write_texts(d, at, "source", "doc_id", "text")
    return at


_JOINED = "(SELECT source, string_agg(text || chr(10) || chr(10), '' ORDER BY doc_id) AS t FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY source)"


@query(f"SELECT row_number() OVER (ORDER BY source) - 1 AS ordinal, source || '.txt' AS name, length(t) AS chars, md5(t) AS hash FROM {_JOINED}")
def s01_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as sorted text files, resolved and read whole; line ends arrive as they are."""
    files = tokenfiles.text_files(spark, _text_tree(spark, sf_dir))
    return files.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.element_at(F.split("path", "/"), -1).alias("name"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("hash"))


@query(f"SELECT row_number() OVER (ORDER BY source) - 1 AS ordinal, CAST(coalesce(sum(octet_length(encode(t))) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_byte, octet_length(encode(t)) AS n_bytes, md5(t) AS hash FROM {_JOINED}")
def s02_byte_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as raw bytes, each with the place of its first byte in the whole."""
    files = tokenfiles.byte_corpus(spark, _text_tree(spark, sf_dir))
    return files.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.col("first").alias("first_byte"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("hash"))


@query(f"""WITH {_HEAD} SELECT producer || '-' || file_seq AS name, coalesce(json_extract_string(body, '$.args.tokenizer'), 'bytes') AS tokenizer, coalesce(try_cast(json_extract_string(body, '$.args.accum') AS BIGINT), 1) AS accum FROM h
UNION ALL SELECT 'broken', 'bytes', 1""")
def s09_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as JSON files, one broken: what a file lacks, or all if it cannot be read, is the default."""
    at = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    h = _headers(spark, sf_dir).select(F.concat("producer", F.lit("-"), F.col("file_seq").cast("string")).alias("name"), F.lit(0).alias("n"), F.to_json("args").alias("text"))
    broken = spark.createDataFrame([("broken", 0, '{"tokenizer": "x')], "name string, n int, text string")
    tokenfiles.write_texts(h.unionByName(broken), at, "name", "n", "text", after="")
    d = tokenfiles.json_documents(spark, at, "tokenizer string, accum string", {"tokenizer": "bytes", "accum": "1"})
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return d.select(name.alias("name"), "tokenizer", F.coalesce(F.col("accum").try_cast("bigint"), F.lit(1)).alias("accum"))
