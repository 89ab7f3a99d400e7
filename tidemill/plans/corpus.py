"""Corpus queries: duplicate audit, filters, sniffers, cleansing, shards, order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PY_SPACE, is_blank, pieces_of, py_strip, ws_norm
from ..operators import corpus, offsets
from ..sources.tables import spread, table
from .catalog import Catalog

catalog = Catalog()
QUERIES, SQL, query, relational = catalog.queries, catalog.sql, catalog.query, catalog.relational


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


_STRIP = f"regexp_replace(coalesce(text, ''), '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g')"
_NORM = f"trim(regexp_replace(lower({_STRIP}), '[{PY_SPACE}]+', ' ', 'g'))"
_GROUPS = f"""groups AS (SELECT 'exact' AS kind, md5({_STRIP}) AS key, count(*) AS copies FROM documents GROUP BY 1, 2
UNION ALL SELECT 'norm', md5({_NORM}), count(*) FROM documents GROUP BY 1, 2)"""


@query(f"""WITH {_GROUPS} SELECT kind, CAST(sum(copies) AS BIGINT) AS docs, count(*) AS unique_texts, count_if(copies > 1) AS dup_groups,
CAST(sum(copies - 1) AS BIGINT) AS dup_docs, round(100.0 * sum(copies - 1) / sum(copies), 6) AS dup_rate FROM groups GROUP BY kind""")
def a01_dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_audit(_docs(spark, sf_dir))


@query(f"""SELECT count(*) AS docs, count_if(coalesce(text, '') = '') AS empty, count_if(length({_STRIP}) < 100) AS short FROM documents""")
def a02_empty_and_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.count_if(text == "").alias("empty"), F.count_if(F.length(py_strip(text)) < 100).alias("short"))


@query(f"""WITH {_GROUPS} SELECT kind, copies, n FROM (SELECT kind, copies, row_number() OVER (PARTITION BY kind ORDER BY copies DESC, key) AS n FROM groups) WHERE n <= 5""")
def a03_top_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = corpus.duplicate_groups(_docs(spark, sf_dir)).withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("copies"), "key")))
    return ranked.where("n <= 5").select("kind", "copies", "n")


@query(f"""WITH {_GROUPS} SELECT kind, key FROM (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key) AS n FROM groups WHERE copies > 1) WHERE n <= 10000""")
def k15_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    many = corpus.duplicate_groups(_docs(spark, sf_dir)).where("copies > 1")
    return many.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("key"))).where("n <= 10000").select("kind", "key")


relational("s05_projection", "SELECT doc_id, text FROM documents")
relational("s06_row_count", "SELECT count(*) AS docs FROM documents")


@query(f"SELECT doc_id, length(t) > 100 AS over_100, length(t) >= 50 AS from_50, length(t) >= 100 AS from_100, length(t) >= 200 AS from_200 FROM (SELECT doc_id, {_STRIP} AS t FROM documents)")
def p01_length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(py_strip(F.coalesce("text", F.lit(""))))
    return _docs(spark, sf_dir).select("doc_id", (n > 100).alias("over_100"), (n >= 50).alias("from_50"), (n >= 100).alias("from_100"), (n >= 200).alias("from_200"))


_N, _W = (x.replace("(?i)", "") for x in (corpus.HTML_NARROW, corpus.HTML_WIDE))


@query(f"SELECT doc_id, regexp_matches(text, '{_N}', 'i') AS narrow, regexp_matches(text, '{_W}', 'i') AS wide FROM documents WHERE regexp_matches(text, '{_W}', 'i')")
def p02_html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.col("text").rlike(corpus.HTML_NARROW).alias("narrow"), F.col("text").rlike(corpus.HTML_WIDE).alias("wide")).where("wide")


@query("SELECT doc_id FROM documents WHERE contains(text, 'http://') OR contains(text, 'https://')")
def p03_url_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.contains("text", F.lit("http://")) | F.contains("text", F.lit("https://"))).select("doc_id")


@query(f"""SELECT source, CAST(sum(len(regexp_extract_all(t, '{corpus.CONTROL}'))) AS BIGINT) AS control, CAST(sum(len(string_split(t, chr(65533))) - 1) AS BIGINT) AS replaced,
CAST(sum(len(regexp_extract_all(t, '{corpus.CLOSING}'))) AS BIGINT) AS closing_tags, CAST(sum(len(regexp_extract_all(t, 'https?://'))) AS BIGINT) AS urls
FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY source""")
def p04_character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    total = lambda p: F.sum(F.regexp_count(t, F.lit(p)).cast("bigint"))
    return _docs(spark, sf_dir).groupBy("source").agg(
        total(corpus.CONTROL).alias("control"), total("�").alias("replaced"), total(corpus.CLOSING).alias("closing_tags"), total("https?://").alias("urls")
    )


@query(f"SELECT count(*) AS docs, round(100.0 * count_if(regexp_matches(coalesce(text, ''), '{_W}', 'i')) / count(*), 6) AS html_rate, round(100.0 * count_if(regexp_matches(coalesce(text, ''), 'https?://')) / count(*), 6) AS url_rate FROM documents")
def a08_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    rate = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 6)
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), rate(t.rlike(corpus.HTML_WIDE)).alias("html_rate"), rate(t.rlike("https?://")).alias("url_rate"))


_CLEANSE = f"""lines AS (SELECT doc_id, coalesce(text, '') AS raw, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
found AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '{corpus.START_MARK}')), true), 0) AS first FROM lines),
bodies AS (SELECT *, CASE WHEN first > 0 THEN ls[first + 1:] END AS body FROM found),
ends AS (SELECT *, coalesce(list_position(list_transform(body, lambda x: regexp_matches(x, '{corpus.END_MARK}')), true), 0) AS stop FROM bodies),
judged AS (SELECT *, CASE WHEN regexp_matches(substring(raw, 1, 2000), '{corpus.AUSTRALIA}') THEN 'australia' WHEN first > 0 THEN 'ok'
WHEN list_bool_or(list_transform(ls[1:5], lambda x: regexp_matches(x, '{corpus.OLD_STYLE.replace("'", "''")}'))) THEN 'oldstyle' ELSE 'no_markers' END AS status FROM ends),
cleansed AS (SELECT doc_id, status, CASE WHEN status = 'ok' THEN regexp_replace(array_to_string(CASE WHEN stop > 0 THEN body[1:stop - 1] ELSE body END, chr(10)),
'^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g') || chr(10) ELSE raw END AS body FROM judged)"""


@query(f"WITH {_CLEANSE} SELECT doc_id, status, md5(body) AS body_key FROM cleansed")
def p05_cleanse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.marker_cleanse(_docs(spark, sf_dir)).select("doc_id", "status", F.md5("body").alias("body_key"))


@query(f"WITH {_CLEANSE} SELECT status, count(*) AS docs, CAST(sum(length(body)) AS BIGINT) AS chars FROM cleansed GROUP BY status")
def p06_cleanse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.marker_cleanse(_docs(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("body").cast("bigint")).alias("chars"))


@query(f"WITH {_CLEANSE} SELECT status || chr(9) || CAST(doc_id AS VARCHAR) AS line FROM cleansed WHERE status <> 'ok'")
def k09_quarantine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = corpus.marker_cleanse(_docs(spark, sf_dir)).where("status <> 'ok'")
    return bad.select(F.concat_ws("\t", "status", F.col("doc_id").cast("string")).alias("line"))


_Q = lambda xs: "|".join(xs).replace("'", "''")
_BOOKS = f"""l AS (SELECT doc_id, i, ls[i] AS line, regexp_replace(ls[i], '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g') AS bare, len(ls) AS n FROM
(SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, bare = '' AS blank, regexp_matches(bare, '{_Q(x.replace(".", "[.]") for x in corpus.BOILERPLATE)}', 'i') AS noise, regexp_matches(bare, '{_Q(corpus.HEADERS)}', 'i') AS head,
regexp_matches(bare, '{_Q(corpus.FOOTERS)}', 'i') AS tail FROM l),
k2 AS (SELECT *, lag(blank) OVER w AS after_blank, bool_or(head) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had_head FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, coalesce(min(CASE WHEN NOT blank AND NOT noise AND (NOT head OR (after_blank AND had_head)) THEN i END), 1) AS begin FROM k2 GROUP BY doc_id),
z AS (SELECT k.doc_id, max(begin) AS begin, max(CASE WHEN i > begin AND (tail OR noise) THEN i END) AS last FROM k JOIN b ON k.doc_id = b.doc_id GROUP BY k.doc_id),
e AS (SELECT k.doc_id, max(z.begin) AS begin, max(n) AS n, max(z.last) AS last, bool_or(tail AND i = z.last) AS at_tail, max(CASE WHEN i > z.begin AND i < z.last AND NOT blank AND NOT noise THEN i END) AS above
FROM k JOIN z ON k.doc_id = z.doc_id GROUP BY k.doc_id),
kept AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM k JOIN e ON k.doc_id = e.doc_id
WHERE i >= begin AND i <= CASE WHEN last IS NULL THEN e.n WHEN at_tail THEN last - 1 ELSE coalesce(above, e.n) END AND NOT noise AND NOT regexp_matches(bare, '{corpus.DECORATION}') GROUP BY k.doc_id),
books AS (SELECT d.doc_id, regexp_replace(regexp_replace(coalesce(body, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g') AS body, length(coalesce(d.text, '')) AS chars_before
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id)"""


@query(f"WITH {_BOOKS} SELECT doc_id, body, chars_before, length(body) AS chars_after FROM books")
def p07_clean_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean_books(_docs(spark, sf_dir))


@query(f"""WITH {_BOOKS} SELECT CAST(sum(chars_before) AS BIGINT) AS chars_before, CAST(sum(length(body)) AS BIGINT) AS chars_after,
round(100 * (1 - sum(length(body)) / nullif(sum(chars_before), 0)), 6) AS removed_pct FROM books""")
def a26_cleaning_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = corpus.clean_books(_docs(spark, sf_dir)).agg(F.sum("chars_before").alias("chars_before"), F.sum("chars_after").alias("chars_after"))
    return totals.withColumn("removed_pct", F.round(100 * (1 - F.col("chars_after") / F.nullif("chars_before", F.lit(0))), 6))


@query(f"SELECT doc_id, md5({_NORM}) AS norm_key FROM documents")
def p08_whitespace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(ws_norm(py_strip(F.coalesce("text", F.lit(""))))).alias("norm_key"))


_SECTIONS = f"""parts AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{corpus.SECTION_BREAK}')) AS s, generate_subscripts(string_split_regex(coalesce(text, ''), '{corpus.SECTION_BREAK}'), 1) - 1 AS section_no FROM documents),
sections AS (SELECT doc_id, section_no, regexp_replace(s, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g') AS section FROM parts)"""


@query(f"WITH {_SECTIONS} SELECT doc_id, section_no, length(section) AS chars FROM sections WHERE length(section) > 200")
def p09_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sections(_docs(spark, sf_dir)).select("doc_id", "section_no", F.length("section").alias("chars"))


@query(f"""SELECT doc_id, count(*) AS paragraphs FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p FROM documents)
WHERE length(regexp_replace(p, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g')) > 100 GROUP BY doc_id""")
def p09_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n\n", -1)).alias("p"))
    return parts.where(F.length(py_strip("p")) > 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))


_CASE = " ".join(f"WHEN regexp_matches(lower(fact), '{'|'.join(words)}') THEN '{category}'" for words, _, category in corpus.QUESTION_RULES)
_ASK = " ".join("WHEN regexp_matches(lower(fact), '{}') THEN '{}'".format("|".join(words), question.replace("'", "''")) for words, question, _ in corpus.QUESTION_RULES)
_FACTS = f"""{_SECTIONS}, cut AS (SELECT doc_id, section_no, unnest(string_split_regex(section, '[.!?]+')) AS s FROM sections WHERE length(section) > 200),
sents AS (SELECT doc_id, section_no, regexp_replace(s, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g') AS fact FROM cut),
facts AS (SELECT doc_id, fact, CASE {_CASE} ELSE 'general' END AS category, CASE {_ASK} ELSE '{corpus.GENERAL_QUESTION}' END AS question FROM sents WHERE length(fact) BETWEEN 30 AND 300 AND regexp_matches(lower(fact), '{'|'.join(corpus.FACT_WORDS)}'))"""


@query(f"WITH {_FACTS} SELECT doc_id, fact FROM facts")
def p10_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.facts(_docs(spark, sf_dir)).select("doc_id", "fact")


@query(f"WITH {_FACTS} SELECT category, count(*) AS n FROM facts GROUP BY category")
def p11_question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.facts(_docs(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FACTS} SELECT question AS instruction, fact AS response, category, 'corpus_extraction' AS source FROM facts""")
def k10_question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs extracted from the texts, one JSON-able row each."""
    found = corpus.facts(_docs(spark, sf_dir))
    return found.select(F.col("question").alias("instruction"), F.col("fact").alias("response"), "category", F.lit("corpus_extraction").alias("source"))


@query(f"""WITH {_FACTS} SELECT question AS instruction, '' AS input, fact AS output FROM facts UNION ALL SELECT subject, '', about FROM subjects""")
def u02_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted and curated pairs in one bag, in the three-field form."""
    found = k10_question_answers(spark, sf_dir).select("instruction", F.lit("").alias("input"), F.col("response").alias("output"))
    return found.unionByName(table(spark, sf_dir, "subjects").select(F.col("subject").alias("instruction"), F.lit("").alias("input"), F.col("about").alias("output")))


@query("""SELECT source, count(*) AS docs, max(CASE WHEN rn = n // 10 THEN len END) AS p10, max(CASE WHEN rn = n // 2 THEN len END) AS p50,
max(CASE WHEN rn = 9 * n // 10 THEN len END) AS p90, max(len) AS longest FROM (SELECT source, coalesce(length(text), 0) AS len,
row_number() OVER (PARTITION BY source ORDER BY coalesce(length(text), 0)) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source""")
def a04_length_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_ranks(_docs(spark, sf_dir), "source", F.coalesce(F.length("text"), F.lit(0)), {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("""WITH bytes AS (SELECT source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
h AS (SELECT source, b, count(*) AS n FROM bytes GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS symbols, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM h GROUP BY source""")
def a05_byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.entropy(corpus.byte_histogram(_docs(spark, sf_dir), "source"), "source")


@query("""WITH w AS (SELECT source, md5(substring(text, 1 + 2000 * i, 2000)) AS k FROM (SELECT source, text, unnest(range((length(text) + 1999) // 2000)) AS i FROM documents WHERE text <> ''))
SELECT source, count(*) AS windows, count(DISTINCT k) AS distinct_windows FROM w GROUP BY source""")
def a07_window_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in windows of 2,000 characters: how many are distinct. Every window is read, none is drawn."""
    w = _docs(spark, sf_dir).where("text <> ''").select("source", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 2000).cast("int"))).alias("i"))
    keyed = w.select("source", F.md5(F.substr("text", F.col("i") * 2000 + 1, F.lit(2000))).alias("k"))
    return keyed.groupBy("source", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("source").agg(F.sum("c").alias("windows"), F.count(F.lit(1)).alias("distinct_windows"))


# The twin's engine has no look-ahead: a mark before the last white space of a run that something else follows takes its place.
_MARK = "chr(1114109)"
_SPACED = f"regexp_replace(coalesce(text, ''), '([{PY_SPACE}])([^{PY_SPACE}])', {_MARK} || '\\1\\2', 'g')"
_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|@? ?[A-Za-z]+|@? ?[0-9]+|@? ?[^{PY_SPACE}@A-Za-z0-9]+|@[{PY_SPACE}]|[{PY_SPACE}]+"
_MARKED = "'" + _SPLIT.replace("'", "''") + "'"
_PIECES = f"list_transform(regexp_extract_all({_SPACED}, replace({_MARKED}, '@', {_MARK})), lambda p: replace(p, {_MARK}, ''))"


@query(f"SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece")
def a10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.piece_counts(_docs(spark, sf_dir))


@query(f"SELECT doc_id, {_PIECES} AS pieces FROM documents")
def t02_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word pieces of every text, in order; joined, they are the text."""
    return _docs(spark, sf_dir).select("doc_id", pieces_of(F.col("text")).alias("pieces"))


@query(f"""WITH p AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece),
b AS (SELECT regexp_extract_all(hex(encode(piece)), '..') AS hs, n FROM p)
SELECT hs[i] || hs[i + 1] AS pair, CAST(sum(n) AS BIGINT) AS n FROM (SELECT hs, n, unnest(range(1, len(hs))) AS i FROM b) GROUP BY 1""")
def a11_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pair_counts(corpus.piece_counts(_docs(spark, sf_dir)))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS INT)) AS ids FROM documents")
def t01_byte_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.byte_ids(_docs(spark, sf_dir))


# Shards (documents.source) and their layout

_BYTES = "octet_length(encode(coalesce(text, '')))"


@query(f"SELECT source, count(*) AS docs, CAST(sum({_BYTES}) AS BIGINT) AS tokens, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source")
def k03_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length(t).cast("bigint")).alias("tokens"), F.sum(F.length(t).cast("bigint")).alias("chars"))


@query("""SELECT doc_id, source, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset
FROM (SELECT doc_id, source, text AS t FROM documents WHERE text <> '')""")
def k05_concat_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text begins in its shard when texts are joined in order with a blank line after each."""
    filled = _docs(spark, sf_dir).where("text <> ''").select("doc_id", "source", F.length("text").alias("len"))
    return offsets.running_total(filled, "doc_id", (F.col("len") + 2).cast("bigint"), ["source"], "char_offset").drop("len")


@query("""WITH p AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, CAST(coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM documents),
s AS (SELECT unnest(range(pos // 1000000, (pos + n - 1) // 1000000 + 1)) AS shard_ix, pos, n FROM p WHERE n > 0)
SELECT shard_ix, count(*) AS pieces, CAST(sum(least(pos + n, (shard_ix + 1) * 1000000) - greatest(pos, shard_ix * 1000000)) AS BIGINT) AS tokens FROM s GROUP BY shard_ix""")
def k06_reshard(spark: SparkSession, sf_dir: str, size: int = 1_000_000) -> DataFrame:
    """Byte tokens of the whole corpus, in order, re-cut to shards of a fixed size."""
    n = _docs(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    placed = offsets.running_total(n, "doc_id", F.col("n"), name="at").where("n > 0")
    cut = placed.withColumn("shard_ix", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    inside = F.least(F.col("at") + F.col("n"), (F.col("shard_ix") + 1) * size) - F.greatest(F.col("at"), F.col("shard_ix") * size)
    return cut.groupBy("shard_ix").agg(F.count(F.lit(1)).alias("pieces"), F.sum(inside).alias("tokens"))


@query("""SELECT doc_id FROM (SELECT doc_id, CAST(coalesce(sum(length(coalesce(text, '')) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
FROM documents WHERE length(coalesce(text, '')) >= 50) WHERE before < 250000""")
def s17_character_budget(spark: SparkSession, sf_dir: str, budget: int = 250_000) -> DataFrame:
    """Texts in order until the character budget is first reached (that text included)."""
    rows = _docs(spark, sf_dir).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len")).where("len >= 50")
    return offsets.running_total(rows, "doc_id", (F.col("len") + 2).cast("bigint")).where(F.col("before") < budget).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS upto FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)) WHERE upto <= 262144""")
def s15_head_by_bytes(spark: SparkSession, sf_dir: str, limit: int = 262_144) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    return offsets.running_total(rows, "doc_id", F.col("n")).where(F.col("before") + F.col("n") <= limit).select("doc_id")



@query("""SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ix FROM documents) AS d WHERE ix % 10 = 0 AND trim(coalesce(text, '')) <> ''""")
def s16_strided_sample(spark: SparkSession, sf_dir: str, stride: int = 10) -> DataFrame:
    """Every tenth text of each shard, in order, unless it is blank."""
    d = _docs(spark, sf_dir).select("doc_id", "source", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("filled"))
    return offsets.running_total(d, "doc_id", F.lit(1).cast("bigint"), ["source"], "ix").where((F.col("ix") % stride == 0) & F.col("filled")).select("doc_id")


@query("""SELECT source, shard_ix, tokens, CAST(coalesce(sum(tokens) OVER (ORDER BY shard_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_token, ntile(8) OVER (ORDER BY shard_ix) AS worker
FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS shard_ix, sum(octet_length(encode(coalesce(text, '')))) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY source)""")
def w19_shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in order with exclusive prefix sums and near-equal contiguous blocks for eight workers (W18); one row per shard."""
    from pyspark.sql import Window

    shards = k03_manifest(spark, sf_dir).where("source IS NOT NULL").withColumn("shard_ix", F.row_number().over(Window.orderBy("source")) - 1)
    w = Window.orderBy("shard_ix")
    return shards.select(
        "source", "shard_ix", "tokens", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_token"), F.ntile(8).over(w).alias("worker")
    )



relational(
    "a09_size_consistency",
    """SELECT source, CAST(sum(n_chars) AS BIGINT) AS claimed, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS actual,
    CAST(sum(CASE WHEN n_chars IS DISTINCT FROM coalesce(length(text), 0) THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM documents GROUP BY source""",
)
relational(
    "p15_corpus_label",
    """SELECT label, count(*) AS docs FROM (SELECT CASE WHEN source LIKE 'web%' THEN 'web' WHEN source LIKE 'mix%' THEN 'mixture' WHEN source LIKE 'book%' THEN 'books' ELSE source END AS label FROM documents) AS d GROUP BY label""",
)


@query(f"SELECT source, count(*) AS texts FROM documents WHERE regexp_matches(text, '[^{PY_SPACE}]') GROUP BY source")
def t16_line_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that line mode would encode: blank ones are skipped."""
    return _docs(spark, sf_dir).where(~is_blank("text")).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
