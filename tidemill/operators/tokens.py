"""Token streams over a pair vocabulary held as tables: encode, decode, acceptance checks, windows."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PIECE_PATTERN

END_MARK = "<|endoftext|>"
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose ids a task keeps.
CACHED_PIECES = 200_000
#: Characters that a chunked encode reads at a time.
CHUNK = 500_000
_PIECES = re.compile(PIECE_PATTERN)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class PairVocabulary:
    """Ids of byte strings and ranks of mergeable pairs. The end mark, if there is one, and ``added`` literals are cut out of the text
    before pieces are, the end mark first and the longest literal first, so nothing is ever merged across them."""

    def __init__(self, pieces: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int], added: dict[str, int] | None = None, end_mark: bool = False) -> None:
        self.pieces, self.ranks, self.added = dict(pieces), ranks, dict(added or {})
        self.end_id = self.pieces.setdefault(END_MARK.encode(), max(self.pieces.values(), default=-1) + 1) if end_mark else None
        self.names = {i: p for p, i in self.pieces.items()} | {i: x.encode() for x, i in self.added.items()}
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    @classmethod
    def from_tables(cls, vocab: DataFrame, merges: DataFrame, added: dict[str, int] | None = None, limit: int = 300_000) -> PairVocabulary:
        """``vocab`` (id, piece) and ``merges`` (rank, l, r); both are dictionaries of one vocabulary and checked for size."""
        v, m = vocab.limit(limit + 1).collect(), merges.limit(limit + 1).collect()
        if max(len(v), len(m)) > limit:
            raise ValueError("a vocabulary of this size is not meant to be shipped to every task")
        return cls({bytes(r.piece): r.id for r in v}, {(bytes(r.l), bytes(r.r)): r.rank for r in m}, added)

    @classmethod
    def from_byte_level(cls, path: str, added: dict[str, int] | None = None) -> PairVocabulary:
        """A byte-level vocabulary file of a public tokenizer library. A merge that is no pair or a letter that stands for no byte
        is an error; there is an end mark only if the file has its literal."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        letters = byte_letters()

        def plain(piece: str) -> bytes:
            if any(c not in letters for c in piece):
                raise ValueError(f"no bytes for {piece!r}")
            return bytes(letters[c] for c in piece)

        specials = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        pieces = {plain(p): i for p, i in raw["model"]["vocab"].items() if p not in specials}
        ranks = {}
        for rank, merge in enumerate(raw["model"]["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            if len(pair) != 2:
                raise ValueError(f"{merge!r} is no pair")
            ranks[plain(pair[0]), plain(pair[1])] = rank
        if END_MARK in specials:
            pieces[END_MARK.encode()] = specials[END_MARK]
        return cls(pieces, ranks, added, END_MARK in specials)

    def to_json(self) -> str:
        """All of the vocabulary, bytes as Latin-1 letters."""
        t = lambda b: b.decode("latin-1")
        merges = [[t(a), t(b)] for (a, b), _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        return json.dumps({"vocab": {t(p): i for p, i in self.pieces.items()}, "merges": merges, "eos": self.end_id is not None, "added": self.added})

    @classmethod
    def from_json(cls, text: str) -> PairVocabulary:
        """Ranks are the order of the merges; a file without ``eos`` or ``added`` has neither."""
        raw = json.loads(text)
        b = lambda t: t.encode("latin-1")
        return cls({b(p): i for p, i in raw["vocab"].items()}, {(b(x), b(y)): r for r, (x, y) in enumerate(raw["merges"])}, raw.get("added"), raw.get("eos", False))

    def fuse(self, raw: bytes) -> list[bytes]:
        """Join the lowest-ranked neighbouring pair, leftmost first, until none is left: a heap of pairs over linked parts."""
        n = len(raw)
        ends = list(range(1, n + 1))  # of the part that begins here
        prior = list(range(-1, n - 1))
        gone = bytearray(n + 1)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if i >= 0 and j < n:
                rank = self.ranks.get((raw[i:j], raw[j : ends[j]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if gone[i] or gone[j] or ends[i] != j or ends[j] != k:
                continue
            gone[j] = 1
            ends[i] = k
            if k < n:
                prior[k] = i
            offer(i)
            if prior[i] >= 0:
                offer(prior[i])
        return [raw[i : ends[i]] for i in range(n) if not gone[i]]

    def _ids(self, text: str) -> Iterator[int]:
        for piece in _PIECES.findall(text):
            got = self._known.get(piece)
            if got is None:
                got = tuple(self.pieces[p] for p in self.fuse(piece.encode("utf-8", "replace")))
                if len(self._known) >= CACHED_PIECES:
                    self._known.clear()
                self._known[piece] = got
            yield from got

    def encode(self, text: str) -> list[int]:
        marks = ([END_MARK] if self.end_id is not None else []) + sorted(self.added, key=len, reverse=True)
        if not marks:
            return list(self._ids(text))
        out: list[int] = []
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, marks)) + ")", text)):
            if k % 2:
                out.append(self.end_id if part == END_MARK and self.end_id is not None else self.added[part])
            else:
                out.extend(self._ids(part))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.names[i] for i in ids).decode("utf-8", "replace")


def resilient(encode: Callable[[str], list[int]], text: str, splits: int = 32) -> tuple[list[int], list[str]]:
    """Ids in order, and what failed on the way: a text whose encoding raises is cut in half, and so are its halves, for at most
    ``splits`` cuts in all. Nothing is dropped: beyond that, or at a single character, the error is raised again."""
    ids: list[int] = []
    errors: list[str] = []
    todo = [text]
    while todo:
        part = todo.pop()
        try:
            ids += encode(part)
        except Exception as e:
            if len(part) <= 1 or len(errors) >= splits:
                raise
            errors.append(f"{type(e).__name__}: {e} ({len(part)} characters)")
            half = len(part) // 2
            todo += [part[half:], part[:half]]
    return ids, errors


def at_most(encode: Callable[[str], list[int]], characters: int) -> Callable[[str], list[int]]:
    """An encoder that refuses longer texts, as native encoders with a size limit do."""

    def limited(text: str) -> list[int]:
        if len(text) > characters:
            raise OverflowError(f"over {characters} characters")
        return encode(text)

    return limited


def encode_column(vocabulary: PairVocabulary, text: Column | str, at_once: int | None = None) -> Column:
    """struct<ids, errors> per text; null and empty texts have no ids. The vocabulary (a dictionary of bounded size) is broadcast.

    Whole texts are encoded, however long; only for an encoder that refuses more than ``at_once`` characters are they read in chunks of
    ``CHUNK``, so that no text needs more cuts than ``resilient`` makes."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(vocabulary)

    @F.pandas_udf("struct<ids:array<int>,errors:array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if at_once is None or not t:
                out.append((shared.value.encode(t) if t else [], []))
                continue
            got = [resilient(at_most(shared.value.encode, at_once), t[a : a + CHUNK]) for a in range(0, len(t), CHUNK)]
            out.append(([i for ids, _ in got for i in ids], [e for _, errors in got for e in errors]))
        return pd.DataFrame(out, columns=["ids", "errors"])

    return run(text)


def decode_column(vocabulary: PairVocabulary, ids: Column | str) -> Column:
    shared = SparkSession.getActiveSession().sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode([int(i) for i in x]) for x in lists])

    return run(ids)


def exact_windows(vocabulary: PairVocabulary, ids: Column | str, size: int, draws: int) -> Column:
    """struct<windows, exact>: of ``draws`` windows of ``size`` ids at even distances (all of a shorter list as one), how many come back
    from decoding and encoding as they were."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(vocabulary)

    @F.pandas_udf("struct<windows:int,exact:int>")
    def run(lists: pd.Series) -> pd.DataFrame:
        v, out = shared.value, []
        for x in lists:
            got = [int(i) for i in x]
            room = max(len(got) - size, 0)
            parts = [got[a : a + size] for a in sorted({room * k // max(draws - 1, 1) for k in range(draws)})] if got else []
            out.append((len(parts), sum(v.encode(v.decode(w)) == w for w in parts)))
        return pd.DataFrame(out, columns=["windows", "exact"])

    return run(ids)


def check_stream(encoded: DataFrame, vocabulary: PairVocabulary, manifest_tokens: int) -> DataFrame:
    """Acceptance checks over (text, ids): one row (name, ok, detail) per check, in one pass over the rows."""
    back = decode_column(vocabulary, "ids")
    again = encode_column(vocabulary, "back")
    rows = encoded.select("text", "ids").withColumn("back", back).withColumn("again", F.col("ids")).withColumn("again", again["ids"])
    top = max(vocabulary.names, default=-1)
    facts = rows.agg(
        F.count_if(F.col("ids").isNull() | F.exists("ids", lambda i: i.isNull())).alias("shape"),
        F.sum(F.size("ids").cast("bigint")).alias("tokens"),
        F.count_if(F.exists("ids", lambda i: (i < 0) | (i > top))).alias("range"),
        F.count_if(F.col("again") != F.col("ids")).alias("roundtrip"),
        F.count_if(F.col("back") != F.coalesce("text", F.lit(""))).alias("roundtrip_text"),
        F.count_if((F.size("ids") == 0) != (F.coalesce("text", F.lit("")) == "")).alias("boundary"),
    )
    loadable = PairVocabulary.from_json(vocabulary.to_json())
    same = loadable.pieces == vocabulary.pieces and loadable.ranks == vocabulary.ranks and loadable.added == vocabulary.added
    check = lambda name, bad, detail: F.struct(F.lit(name).alias("name"), (bad == 0).alias("ok"), detail.cast("bigint").alias("detail"))
    lost = F.coalesce("tokens", F.lit(0)) - manifest_tokens
    plain = [check(n, F.col(c), F.col(c)) for n, c in (("shape", "shape"), ("range", "range"), ("roundtrip", "roundtrip"), ("roundtrip-text", "roundtrip_text"), ("boundary", "boundary"))]
    return facts.select(F.explode(F.array(*plain, check("manifest", lost, F.col("tokens")), check("loadable", F.lit(0 if same else 1), F.lit(len(vocabulary.pieces))))).alias("c")).select("c.*")


def tail_split(total: Column, val_frac: float, context: int) -> list[Column]:
    """Cut position, and the length of the held-out tail (null if it is shorter than one window)."""
    cut = F.floor(total * (1 - val_frac))
    return [cut.alias("cut"), F.when(total - cut >= context + 1, total - cut).alias("val_tokens")]


def strided_offsets(streams: DataFrame, total: str, context: int, draws: int, stride: int = 7919) -> DataFrame:
    """Deterministic windows: offset ``(i * stride) mod (n - context - 1)`` for each draw."""
    room = F.col(total) - context - 1
    return streams.where(room > 0).withColumn("draw_ix", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("offset", F.pmod(F.col("draw_ix") * stride, room))


def windows_of(streams: DataFrame, total: str, context: int, step: int) -> DataFrame:
    """Every window start ``0, step, 2 step, ...`` that leaves room for one window and its next token."""
    last = F.col(total) - context - 1
    return streams.where(last >= 0).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))))


def pairs_of(ids: Column, offset: Column, context: int) -> list[Column]:
    """Input window and the same window one token later."""
    return [F.slice(ids, offset + 1, context).alias("x"), F.slice(ids, offset + 2, context).alias("y")]


def all_pairs(texts: DataFrame, context: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, offset, x, y (binary): the byte windows at 0, context, 2 context, ... of every text, each with the same window one
    byte later. The last window is as short as what is left, so every byte but the last is in one x; texts under two bytes have none."""
    raw = texts.select(key, F.col(text).cast("binary").alias("b")).where(F.octet_length("b") >= 2)
    starts = F.sequence(F.lit(0), F.octet_length("b") - 2, F.lit(context))
    size = lambda o: F.least(F.lit(context), F.octet_length("b") - 1 - o)
    windows = F.transform(starts, lambda o: F.struct(o.alias("offset"), F.substring(F.col("b"), o + 1, size(o)).alias("x"), F.substring(F.col("b"), o + 2, size(o)).alias("y")))
    return raw.select(key, F.inline(windows))


def top_ids(encoded: DataFrame, k: int = 10) -> DataFrame:
    return encoded.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)


@cache
def public_vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> PairVocabulary:
    return PairVocabulary.from_byte_level(os.path.join(folder, name))


def distribution(probabilities: Column) -> list[Column]:
    """Top entry and entropy ``-sum p ln(p + 1e-12)`` of a probability array."""
    top = F.array_max(probabilities)
    return [
        (F.array_position(probabilities, top) - 1).alias("top_id"),
        top.alias("top_p"),
        F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - p * F.log(p + 1e-12)).alias("entropy"),
    ]


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v.cast("double") - top.cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)

