import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import tokens as t
from tidemill.sources import tokenfiles


def vocabulary(added=None, end_mark=False):
    merges = [(b"t", b"h"), (b"th", b"e"), (b" ", b"the"), (b"a", b"a")]
    pieces = {bytes([b]): b for b in range(256)}
    for i, (a, b) in enumerate(merges):
        pieces[a + b] = 256 + i
    return t.PairVocabulary(pieces, {m: i for i, m in enumerate(merges)}, added, end_mark)


TEXTS = ["the ball and the the", "café ñ “quotes”", "a  b   c\n    indented\n\tcode  123  don't", "aaaaa", "", "princess<|endoftext|>ball", "a\x1cb 😀", "A brave bird played!"]


def test_encode_and_decode():
    v = vocabulary()
    for text in TEXTS:
        assert v.decode(v.encode(text)) == text
    assert v.encode("the") == [257] and v.encode(" the") == [258] and v.encode("aaaaa") == [259, 259, ord("a")]


def test_end_mark_is_one_id_and_nothing_merges_across_it():
    v = vocabulary(end_mark=True)
    ids = v.encode("princess<|endoftext|>ball")
    assert v.end_id == 260 and ids.count(260) == 1 and v.decode(ids) == "princess<|endoftext|>ball"
    assert ids == [*v.encode("princess"), 260, *v.encode("ball")]
    assert vocabulary().end_id is None


def test_longest_added_literal_wins():
    v = vocabulary({"  ": 300, "    ": 301, "\n\n": 302})
    assert v.encode("a      b") == [97, 301, 300, 98] and v.encode("x\n\n\ny") == [120, 302, 10, 121]
    assert v.decode(v.encode("a      b\n\n")) == "a      b\n\n"


def slow_fuse(v, raw):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, at = min((v.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="the a", max_size=40).map(str.encode))
def test_fuse_takes_the_lowest_rank_leftmost_first(raw):
    assert vocabulary().fuse(raw) == slow_fuse(vocabulary(), raw)


def test_save_and_load():
    v = vocabulary({"  ": 300}, True)
    w = t.PairVocabulary.from_json(v.to_json())
    assert (w.pieces, w.ranks, w.added, w.end_id) == (v.pieces, v.ranks, v.added, v.end_id)
    old = t.PairVocabulary.from_json('{"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}')
    assert old.end_id is None and old.added == {} and old.encode("abab") == [2, 2]


def test_byte_level_files(tmp_path):
    import json

    def file(merges, vocab=None, added=()):
        p = tmp_path / "v.json"
        p.write_text(json.dumps({"model": {"vocab": vocab or {"Ġ": 0, "t": 1, "Ġt": 2}, "merges": merges}, "added_tokens": list(added)}), encoding="utf-8")
        return t.PairVocabulary.from_byte_level(str(p))

    v = file([["Ġ", "t"]])
    assert v.encode(" t") == [2] and v.end_id is None and v.ranks == {(b" ", b"t"): 0}
    assert file(["Ġ t"]).ranks == v.ranks
    assert file([], added=[{"content": t.END_MARK, "id": 9}]).end_id == 9
    for bad in ([["Ġ"]], [["Ġ", "t", "t"]], [["Ġ", "€"]]):
        with pytest.raises(ValueError):
            file(bad)
    assert len(t.byte_letters()) == 256 and sorted(t.byte_letters().values()) == list(range(256))


def test_columns_and_checks(spark):
    v = vocabulary()
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, None])], "k int, text string").withColumn("e", t.encode_column(v, "text")).withColumn("back", t.decode_column(v, F.col("e.ids")))
    for r in df.collect():
        assert r.back == (r.text or "") and r.e.errors == []
    rows = df.select("text", F.col("e.ids").alias("ids"))
    n = sum(len(v.encode(x)) for x in TEXTS)
    checks = {r.name: r.ok for r in t.check_stream(rows, v, n).collect()}
    assert checks == dict.fromkeys(["shape", "range", "roundtrip", "roundtrip-text", "boundary", "manifest", "loadable"], True)
    bad = {r.name for r in t.check_stream(rows.withColumn("ids", F.concat("ids", F.array(F.lit(ord("x"))))), v, n).where("NOT ok").collect()}
    assert bad == {"roundtrip-text", "boundary", "manifest"}


def test_exact_windows(spark):
    v = vocabulary()
    w = spark.createDataFrame([([97] * 10,), ([97],), ([],), (v.encode("the ball and " * 50),)], "ids array<int>").select(t.exact_windows(v, "ids", 4, 5).alias("w")).collect()
    assert [(r.w.windows, r.w.exact) for r in w[1:3]] == [(1, 1), (0, 0)] and w[0].w.exact == 0 and w[3].w.windows == 5


def test_resilient_cuts_and_drops_nothing():
    limited = t.at_most(lambda text: [ord(c) for c in text], 4)
    ids, errors = t.resilient(limited, "abcdefghij")
    assert bytes(ids) == b"abcdefghij" and len(errors) == 3
    with pytest.raises(OverflowError):
        t.resilient(limited, "a" * 1000, splits=32)

    def picky(text):
        if "!" in text:
            raise ValueError("no")
        return [ord(c) for c in text]

    with pytest.raises(ValueError):  # a single character that fails is raised, never dropped
        t.resilient(picky, "abc!def")


def test_limited_encoder_takes_texts_of_any_length(spark, monkeypatch):
    v = vocabulary()
    long = "the ball " * 300_000
    df = spark.createDataFrame([(long,), ("the",), (None,)], "text string").withColumn("e", t.encode_column(v, "text", 16_000))
    got = df.select(F.length("text").alias("n"), F.size("e.errors").alias("cuts"), (t.decode_column(v, "e.ids") == F.col("text")).alias("same")).collect()
    assert [(r.n, r.cuts > 32, r.same) for r in got[:2]] == [(2_700_000, True, True), (3, False, True)]


def test_tables(spark):
    v = spark.createDataFrame([(i, bytes([i])) for i in range(256)] + [(256, b"th")], "id int, piece binary")
    m = spark.createDataFrame([(0, b"t", b"h")], "rank int, l binary, r binary")
    assert t.PairVocabulary.from_tables(v, m).encode("th") == [256]
    with pytest.raises(ValueError):
        t.PairVocabulary.from_tables(v, m, limit=10)


def test_splits_and_windows(spark):
    s = spark.createDataFrame([("n", 20000), ("t", 6000), ("e", 0)], "source string, n bigint")
    got = {r.source: (r.cut, r.val_tokens) for r in s.select("source", *t.tail_split(F.col("n"), 0.01, 128)).collect()}
    assert got["n"] == (19800, 200) and got["t"] == (5940, None)
    w = t.strided_offsets(s, "n", 512, 5)
    assert {r.offset for r in w.where("source = 't'").collect()} == {i * 7919 % (6000 - 513) for i in range(5)}
    assert t.windows_of(s, "n", 512, 256).where("source = 'e'").count() == 0


def chunks(spark, shards=3, n=2, size=5):
    return spark.createDataFrame([(s, c, [1000 * s + 10 * c + k for k in range(size)]) for s in range(shards) for c in reversed(range(n))], "shard_ix int, chunk_ix int, ids array<int>")


def whole(spark, folder, step=4):
    flat = {}
    for r in tokenfiles.read_token_files(spark, str(folder), step).orderBy("path", "first").collect():
        flat.setdefault(r.path.rsplit("/", 1)[1], []).extend(r.ids)
    return flat


def test_token_files_round_trip(spark, tmp_path):
    manifest = tokenfiles.write_token_shards(chunks(spark), str(tmp_path)).collect()
    assert sorted((r.shard_ix, r.tokens, r.n_bytes, r.resumed) for r in manifest) == [(s, 10, 40, 0) for s in range(3)]
    with open(tmp_path / "shard_000001.bin", "ab") as f:
        f.write(b"\x01\x02")
    assert whole(spark, tmp_path)["shard_000001.bin"] == [1000, 1001, 1002, 1003, 1004, 1010, 1011, 1012, 1013, 1014]
    assert {r.path.rsplit("/", 1)[1] for r in tokenfiles.read_token_files(spark, str(tmp_path), 4).collect() if r.torn} == {"shard_000001.bin"}


def test_a_torn_tail_is_cut_and_the_rest_added(spark, tmp_path):
    c = chunks(spark, 2, 3)
    tokenfiles.write_token_shards(c.where("chunk_ix < 2"), str(tmp_path)).count()
    with open(tmp_path / "shard_000000.bin", "ab") as f:
        f.write(b"\x01" * (4 * 300 + 3))
    (tmp_path / "shard_000001.json").write_text("{broken")
    again = {r.shard_ix: (r.tokens, r.resumed) for r in tokenfiles.write_token_shards(c, str(tmp_path), resume=True).collect()}
    assert again == {0: (15, 10), 1: (15, 0)}  # without a usable sidecar a shard starts anew
    assert whole(spark, tmp_path)["shard_000000.bin"] == [10 * k + i for k in range(3) for i in range(5)]
    assert not [x for x in tmp_path.iterdir() if "tmp" in x.name]


def test_merge_refuses_a_mismatch(spark, tmp_path):
    tokenfiles.write_token_shards(chunks(spark), str(tmp_path)).count()
    parts = tokenfiles.merge_shards(spark, str(tmp_path), str(tmp_path / "out" / "all.bin"))
    assert [(p["shard_ix"], p["first_token"], p["tokens"]) for p in parts] == [(0, 0, 10), (1, 10, 10), (2, 20, 10)]
    assert np.fromfile(tmp_path / "out" / "all.bin", "<i4").tolist()[10:12] == [1000, 1001]
    (tmp_path / "shard_000002.bin").write_bytes(b"\0" * 36)
    with pytest.raises(ValueError, match="2"):
        tokenfiles.merge_shards(spark, str(tmp_path), str(tmp_path / "late" / "all.bin"))
    assert not (tmp_path / "late").exists()


def test_only_tasks_open_files_to_merge(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(s, c, bytes([s, c, 200 + c])) for s in (2, 0, 1) for c in (1, 0)] + [(1, 2, None)], "shard_ix int, chunk_ix int, ids binary")
    tokenfiles.write_token_shards(raw, str(tmp_path)).count()
    driver, place = os.getpid(), tokenfiles._place

    def elsewhere(uri):
        assert os.getpid() != driver, "the driver opens a file"
        return place(uri)

    monkeypatch.setattr(tokenfiles, "_place", elsewhere)
    parts = tokenfiles.merge_shards(spark, str(tmp_path), str(tmp_path / "out" / "all.bin"))
    monkeypatch.undo()
    assert np.fromfile(tmp_path / "out" / "all.bin", "<i4").tolist() == [x for s in range(3) for c in range(2) for x in (s, c, 200 + c)]
    rows = tokenfiles.read_parts(spark, str(tmp_path / "out" / "all.bin"), parts, 4).collect()
    assert sorted((r.shard_ix, r.first, r.ids) for r in rows) == [(s, 6 * s + k, ids) for s in range(3) for k, ids in ((0, [s, 0, 200, s]), (4, [1, 201]))]


def test_other_sources(spark, tmp_path):
    tokenfiles.write_texts(spark.createDataFrame([("b", 2, "y"), ("b", 1, "x\r"), ("a", 1, "é")], "n string, o int, t string"), str(tmp_path / "c"), "n", "o", "t")
    assert [(r.ordinal, r.text) for r in tokenfiles.text_files(spark, str(tmp_path / "c")).orderBy("ordinal").collect()] == [(0, "é\n\n"), (1, "x\r\n\ny\n\n")]
    assert [(r.ordinal, r.first, bytes(r.content)) for r in tokenfiles.byte_corpus(spark, str(tmp_path / "c")).orderBy("ordinal").collect()] == [(0, 0, "é\n\n".encode()), (1, 4, b"x\r\n\ny\n\n")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tokenfiles.text_files(spark, str(tmp_path / "none"))
    tokenfiles.write_sqlite(spark.range(5).selectExpr("id", "CAST(id AS string) AS s"), str(tmp_path / "db.sqlite"), "t")
    assert [tuple(r) for r in tokenfiles.sqlite_table(spark, str(tmp_path / "db.sqlite"), "SELECT s, id FROM t WHERE id > 2", "s string, id bigint").collect()] == [("3", 3), ("4", 4)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "loss.jsonl").write_text('{"args": {"lr": 1}}\n{"step": 1, "train": 2.5}\nbroken {\n\n{"early_stop": true}\n')
    kinds = [r.kind for r in tokenfiles.run_log(spark, str(tmp_path / "runs")).collect()]
    assert sorted(map(str, kinds)) == ["None", "early_stop", "header", "step"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.txt").write_bytes(b"x\r\ny")
    assert tokenfiles.text_files(spark, str(tmp_path / "c")).first().text == "x\r\ny"
    r = tokenfiles.log_scrape(spark.createDataFrame([("step 120/500 train=2.1 avg50=2.2 val=2.3 bpb=1.1 29966 tok/s",), ("noise",)], "line string")).collect()
    assert (r[0].step, r[0].val, r[0].bpb, r[0].avg50, r[0].tok_per_sec) == (120, 2.3, 1.1, 2.2, 29966.0) and r[1].step is None


def test_distribution(spark):
    d = spark.createDataFrame([([0.0, 1.0, 2.0],)], "v array<double>").select(t.softmax(F.col("v")).alias("p")).select("p", *t.distribution(F.col("p"))).first()
    p = np.exp([0.0, 1.0, 2.0]) / np.exp([0.0, 1.0, 2.0]).sum()
    assert np.allclose(d.p, p) and d.top_id == 2 and abs(d.entropy + (p * np.log(p)).sum()) < 1e-9


def test_all_pairs_cover_every_byte(spark):
    texts = {1: "x" * 40 + "é😀", 2: "ab", 3: "a", 4: "", 5: None, 6: "0123456789abcdef", 7: "0123456789abcdefg"}
    rows = t.all_pairs(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.offset)):
        got.setdefault(r.doc_id, []).append((r.offset, bytes(r.x), bytes(r.y)))
    assert sorted(got) == [1, 2, 6, 7] and [len(got[k]) for k in (1, 2, 6, 7)] == [3, 1, 1, 1]
    for k, windows in got.items():
        raw = texts[k].encode()
        assert b"".join(x for _, x, _ in windows) == raw[:-1] and b"".join(y for _, _, y in windows) == raw[1:]
        assert all(o % 16 == 0 and raw[o:].startswith(x) for o, x, _ in windows)
