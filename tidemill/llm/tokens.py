"""Token ids of whole texts by a byte-level pair vocabulary, by a contiguous rank array.

A text is cut into words by the vocabulary's pattern. A word that is a token is its own id. Any other word becomes a contiguous
array of part boundaries with, beside each part, the rank of the pair it forms with the next part; the lowest rank (leftmost
among equals) is searched by scanning, its inner boundary deleted, and the ranks of the two neighbouring pairs looked up again,
until no pair is known. Words are short, so the scan beats any tree. For the rare word of more than ``SHORT`` bytes (long
unbroken strings) the same merges, in the same order, are found through a heap over linked parts, which keeps the work at
n log n. Ids of words are kept per task while they fit in ``CACHED_WORDS`` entries.

The ranks (one fixed public vocabulary of some 50,000 short byte strings, under ``MAX_RANKS``) are read on the driver from a
path parameter and broadcast.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; ids follow the
order of the text and are never cut, however long the text; repeated rows are encoded again; other columns are left alone.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RANKS = 300_000
SHORT = 128
CACHED_WORDS = 300_000
IDS_AT_ONCE = 1 << 26
# Fixed value: the vocabulary's word pattern, with white space spelled as the Unicode property.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path}: {len(ranks)} ranks are more than a broadcast is meant for")
    return ranks


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == _NONE:
            break
        i = pair.index(low)
        del bounds[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            pair[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(a: int) -> None:
        b = after[a]
        if b < n:
            r = ranks.get(word[a : after[b]])
            if r is not None:
                heapq.heappush(heap, (r, a, b, after[b]))

    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not alive[a] or after[a] != b or b >= n or not alive[b] or after[b] != c:
            continue
        alive[b] = False
        after[a] = c
        if c < n:
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : after[a]]])
        a = after[a]
    return out


def encoder(ranks: dict[bytes, int]) -> Callable[[str | None], list[int]]:
    """A function from text to ids with its own cache of words."""
    import regex

    words = regex.compile(PATTERN).findall
    known: dict[str, tuple[int, ...]] = {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        for word in words(text) if text else ():
            got = known.get(word)
            if got is None:
                raw = word.encode("utf-8", "replace")
                whole = ranks.get(raw)
                got = (whole,) if whole is not None else tuple((merge_short if len(raw) <= SHORT else merge_long)(raw, ranks))
                if len(raw) <= SHORT:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = got
            ids.extend(got)
        return ids

    return encode


def shared_ranks(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY):
    return spark.sparkContext.broadcast(read_ranks(os.path.join(folder, vocabulary)))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The key and ``ids`` of every row."""
    ranks = shared_ranks(documents.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value)
        for batch in batches:
            first, lists, held = 0, [], 0
            for at, text_at in enumerate(batch.column(1)):
                lists.append(np.array(encode(text_at.as_py()), np.int32))
                held += len(lists[-1])
                if at + 1 == batch.num_rows or len(lists) == 1024 or held > IDS_AT_ONCE:  # list offsets are of 32 bits
                    offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), ids], names=["key", "ids"])
                    first, lists, held = at + 1, [], 0

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; the ids themselves never leave the task."""
    ranks = shared_ranks(documents.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value)
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*(f"c{i}" for i in range(batch.num_columns - 1)), "n_tokens"])

    kinds = ", ".join(f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return documents.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint").toDF(*keep, "n_tokens")
