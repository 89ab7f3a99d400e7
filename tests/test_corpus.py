import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemill.functions.text import PIECE_PATTERN, is_blank, pieces_of, py_strip, ws_norm
from tidemill.operators import corpus, offsets


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")


SPACES = [None, "", " a ", "\x1c a\x85", " a　b\n", "a\tB", "\x0b\x0c", "​a"]


def test_strip_and_norm_equal_python(spark):
    got = docs(spark, SPACES).select("text", py_strip("text").alias("s"), ws_norm(py_strip("text")).alias("n"), is_blank("text").alias("b")).collect()
    for r in got:
        if r.text is not None:
            assert r.s == r.text.strip() and r.n == " ".join(r.text.lower().split()) and r.b == (not r.text.strip())


def test_duplicate_audit(spark):
    got = {r.kind: r for r in corpus.duplicate_audit(docs(spark, ["a b", "a b ", "A  B", None, "", "c"])).collect()}
    assert (got["exact"].docs, got["exact"].unique_texts, got["exact"].dup_groups, got["exact"].dup_docs) == (6, 4, 2, 2)
    assert (got["norm"].unique_texts, got["norm"].dup_docs) == (3, 3)
    assert corpus.duplicate_audit(docs(spark, []).where("false")).count() == 0


def test_cleanse_goldens(spark):
    texts = ["head\n*** START OF THIS\nOnce upon a time.\n*** END OF THIS\nlicense", "The Project Gutenberg Etext\nx", "see gutenberg.net.au\n*** START OF", "plain", None, "*** START OF x\n*** END OF x\n", "*** START OF x\nbody"]
    got = {r.doc_id: (r.status, r.body) for r in corpus.marker_cleanse(docs(spark, texts)).collect()}
    assert got[0] == ("ok", "Once upon a time.\n") and got[1][0] == "oldstyle" and got[2][0] == "australia" and got[3] == ("no_markers", "plain")
    assert got[4] == ("no_markers", "") and got[5] == ("ok", "\n") and got[6] == ("ok", "body\n")


BOOKS = [
    ("Produced by x\nProject Gutenberg y\n\nTitle\n\n\n\n*****\nBody\nThe official release date is\nmore\n\nEnd of the Project Gutenberg z\nlegal", "Title\n\nBody\nmore"),
    ("", ""),
    (None, ""),
    ("just text", "just text"),
    ("Produced by x\nrest", "rest"),  # a header that runs into text
    ("Produced by x\n\nE-text prepared by y\nrest", "E-text prepared by y\nrest"),  # a header line after a blank line and a header
    ("\nProduced by x", "Produced by x"),
    ("one\ntwo\nabout Gutenberg-tm", "one\ntwo"),
    ("one\nabout Gutenberg-tm", "one"),
    ("one\ntwo\nTHE END\nthree\nGUTENBERG LICENSE\nfour", "one\ntwo\nTHE END\nthree"),
    ("one\nTHE END\nfour", "one"),
    ("PROJECT GUTENBERG\n\nGutenberg License", ""),
    ("one\r\n\r\n\r\n\r\ntwo\n-----\n----", "one\r\n\r\n\r\n\r\ntwo\n----"),
]


def test_books(spark):
    got = {r.doc_id: r for r in corpus.clean_books(docs(spark, [t for t, _ in BOOKS])).collect()}
    for i, (text, body) in enumerate(BOOKS):
        assert (got[i].body, got[i].chars_before, got[i].chars_after) == (body, len(text or ""), len(body)), text


def test_pieces_equal_the_pattern(spark):
    texts = ["café über", "don't  stop,\n\n 12 now\n", "a\x1c\x1cb", "x\u3000 y \x85z", " 's 't'll 123abc _x_ \t", "", None, "😀 é!?", "   "]
    got = {r.doc_id: r.p for r in docs(spark, texts).select("doc_id", pieces_of(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == re.findall(PIECE_PATTERN, t or "") and "".join(got[i]) == (t or "")
    assert got[0] == ["caf", "é", " ", "ü", "ber"] or got[0] == ["caf", "é", " ü", "ber"]


def test_length_ranks_equal_sorted_lists(spark):
    texts = ["x" * (i * 7 % 23) for i in range(41)]
    got = {r.source: r for r in corpus.length_ranks(docs(spark, texts), "source", F.length("text"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    for s in (0, 1):
        ls = sorted(len(t) for t in texts[s::2])
        n = len(ls)
        r = got[f"s{s}"]
        assert (r.docs, r.p10, r.p50, r.p90, r.longest) == (n, ls[math.floor(n * 0.1)], ls[math.floor(n * 0.5)], ls[math.floor(n * 0.9)], ls[-1])


def test_entropy_and_pieces(spark):
    d = docs(spark, ["abab é", None, ""]).withColumn("source", F.lit("s"))
    raw = "abab é".encode()
    c = Counter(raw)
    want = -sum(n / len(raw) * math.log2(n / len(raw)) for n in c.values())
    assert abs(corpus.entropy(corpus.byte_histogram(d, "source"), "source").first().bits - want) < 1e-6
    pieces = {r.piece: r.n for r in corpus.piece_counts(docs(spark, ["don't  stop, 12 now\n", "now"])).collect()}
    assert "".join(sorted(pieces)) and sum(len(p) * n for p, n in pieces.items()) == len("don't  stop, 12 now\n") + 3
    pairs = {r.pair: r.n for r in corpus.pair_counts(spark.createDataFrame([("aba", 3), ("ab", 2), ("x", 9)], "piece string, n bigint")).collect()}
    assert pairs == {"6162": 5, "6261": 3}


def test_byte_ids(spark):
    got = {r.doc_id: (r.n, r.ids) for r in corpus.byte_ids(docs(spark, ["é", None, "", "x" * 100_000])).collect()}
    assert got[0] == (2, [195, 169]) and got[1] == (0, []) and got[2] == (0, []) and got[3][0] == 100_000


def test_running_total(spark):
    rows = spark.range(10_000).select((F.col("id") * 3 - 500).alias("k"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    for by in ([], ["g"]):
        got = {r.k: r.before for r in offsets.running_total(rows, "k", F.col("v"), by, stretch=64).collect()}
        assert len(got) == 10_000
        acc = {}
        for i in range(10_000):
            g = None if not by or i % 3 == 0 else i % 3
            assert got[i * 3 - 500] == acc.get(g, 0)
            acc[g] = acc.get(g, 0) + i % 7


def test_near_equal_chunks_follow_the_total(spark):
    from tidemill.operators.offsets import near_equal_chunks

    sizes = lambda d: [r["count"] for r in near_equal_chunks(d, "k", 4).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes(spark.range(10_003).selectExpr("id * 7 + 90000 AS k")) == [2500, 2500, 2500, 2503]
    assert sizes(spark.range(3).selectExpr("id AS k")) == [1, 1, 1] and sizes(spark.range(0).selectExpr("id AS k")) == []


def test_text_shards_leave_out_only_what_is_done(spark, sf):
    from tidemill.plans.smaller import QUERIES

    shards = lambda *done: {r.source for r in QUERIES["k04_text_shards"](spark, sf, *done).collect()}
    every = shards()
    assert {"web_0001", "web_0002"} & every and shards(("web_0001",)) == every - {"web_0001"}


def test_reply_items(spark):
    replies = ["Sure:\n```json\n[{\"q\": \"a]\", \"n\": 1}, {\"q\": \"b\"}]\n```\nMore [1]?", "[{\"q\": \"c\"}]", "```\n[{\"q\": \"d\"}]\n```", "no array", "[broken", None]
    got = corpus.reply_items(spark.createDataFrame(list(enumerate(replies)), "id int, reply string"), "reply", "q string, n int").collect()
    assert [(r.id, r.q, r.n) for r in got] == [(0, "a]", 1), (0, "b", None), (1, "c", None), (2, "d", None)]


def test_numbered_rows_follow_their_order(spark):
    rows = spark.range(5000).selectExpr("concat('k', lpad(CAST((id * 7919) % 5000 AS string), 5, '0')) AS k", "id").repartition(7)
    got = {r.k: r.place for r in offsets.numbered(rows, ["k"], "place").collect()}
    assert got == {f"k{i:05d}": i for i in range(5000)} and offsets.numbered(rows.limit(0), ["k"], "place").count() == 0


def test_previous_value_across_stretches(spark):
    rows = spark.range(3000).selectExpr("id * 3 - 700 AS k", "id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g").where("k < 900 OR k > 5000")
    for by in ([], ["g"]):
        got = {r.k: r.before for r in offsets.previous(rows, ["k"], "id", by, "before", stretch=64).collect()}
        last = {}
        for r in rows.orderBy("k").collect():
            key = r.g if by else None
            assert got[r.k] == last.get(key)
            last[key] = r.id
