import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import tokens as t

RANKS = t.read_ranks(f"{t.FOLDER}/{t.VOCABULARY}")
ENCODE = t.encoder(RANKS)
P50K = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER = tiktoken.Encoding("own", pat_str=P50K, mergeable_ranks=RANKS, special_tokens={})

TEXTS = ["", "<|endoftext|> x", "don't I'LL it's", "\r\n\r\n  \t", "é́ñ 日本語 😀👩‍👩‍👧", "a" * 3000, "0123abc" * 400, "a\x1c\x1d b\x85 c 　d", "​﻿" * 5, "x\x00\x07y", " " * 500 + "end", "İſẞ"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_public_encoder(text):
    assert ENCODE(text) == OTHER.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = ENCODE(text)
    assert ids == OTHER.encode_ordinary(text)
    names = {i: b for b, i in RANKS.items()}
    assert b"".join(names[i] for i in ids).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_heap_and_scan_merge_alike(raw):
    assert t.merge_short(raw, RANKS) == t.merge_long(raw, RANKS)


def test_frame(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", None), (1, "a b", "x"), (None, "z", "x"), (5, long, "x")], "doc_id bigint, text string, ids string")
    rows = t.token_ids(df).collect()
    got = {r.doc_id: list(r.ids) for r in rows}
    assert len(rows) == 6 and got[1] == ENCODE("a b") and got[2] == [] and got[3] == [] and got[None] == ENCODE("z") and got[5] == ENCODE(long)
    n = {r.doc_id: r.n_tokens for r in t.token_counts(df, ["doc_id", "ids"]).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert t.token_ids(df.limit(0)).count() == 0
    assert t.token_ids(df).select(F.max(F.size("ids"))).first()[0] == len(ENCODE(long))


def test_rank_bound(tmp_path, monkeypatch):
    p = tmp_path / "v"
    p.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(20)))
    monkeypatch.setattr(t, "MAX_RANKS", 10)
    with pytest.raises(ValueError):
        t.read_ranks(str(p))
