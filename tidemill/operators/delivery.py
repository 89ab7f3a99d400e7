"""Exactly-once view over at-least-once deliveries: exact quotient hash tables over message identifiers.

An identifier (some text columns and one whole number, such as run, attempt, kind and step) becomes a word of fixed width: one
64-bit image of the text columns, or more, beside the number itself. ``identity_seeds`` first counts the distinct texts and their
distinct images; only if both counts agree are the images one to one *for this input*, else another 64-bit image is added. A
Feistel network then permutes the whole word; as it can be undone, different words stay different. The leading bits of the
permuted word are the *quotient*, all others the *remainder*.

The quotient names the table's shard: rows are partitioned by quotient, sorted there by quotient and remainder (both spill), and
``_Shard`` holds the shard's complete remainders in that order and inserts each identifier once: the first of equal entries, in
order of delivery, is the kept copy, all others are surplus. Complete words are compared, so no match is ever false. Before the
shuffle each task inserts its own rows into such a table of at most ``AT_ONCE`` rows; copies that lose there cannot win anywhere
and travel on as plain surplus, dealt to all shards, so that one message that makes up a third of all rows does not gather in one.

Defined results: null texts equal each other; a message without its number (``step``) is never a copy; a null delivery time
counts as later than any other; a null row id is never reported and is kept only if it has no rival; a row id that occurs
twice in a message stands for one row; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTIENT_BITS = 16
ROUNDS = 4
AT_ONCE = 1 << 20
_LAST = (1 << 63) - 1


def _image(texts: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[x for c in texts for x in (F.col(c).isNull(), F.col(c))])


def identity_seeds(rows: DataFrame, texts: Sequence[str]) -> list[int]:
    """Seeds of the images that, together, are one to one over the texts of these rows."""
    known = rows.select(*texts).distinct()
    seeds = [0]
    while True:
        images = F.count_distinct(*[_image(texts, s) for s in seeds])
        got = known.agg(F.count(F.lit(1)).alias("texts"), images.alias("images")).first()
        if got.texts == got.images:
            return seeds
        seeds.append(len(seeds))


def permuted_identity(texts: Sequence[str], number: str, seeds: Sequence[int] = (0,), quotient_bits: int = QUOTIENT_BITS) -> list[Column]:
    """Quotient and the complete remainder words (r0, r1, ...) of the permuted identifier."""
    words: list[Column] = [*[_image(texts, s) for s in seeds], F.col(number).cast("bigint")]
    for k in range(ROUNDS * (len(words) - 1)):
        words = [*words[1:], words[0].bitwiseXOR(F.xxhash64(*words[1:], F.lit(k)))]
    return [
        F.shiftrightunsigned(words[0], 64 - quotient_bits).cast("int").alias("quotient"),
        words[0].bitwiseAND(F.lit((1 << (64 - quotient_bits)) - 1)).alias("r0"),
        *[w.alias(f"r{i}") for i, w in enumerate(words[1:], 1)],
    ]


def _insert_once(words: list[np.ndarray], delivered: np.ndarray, row_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by word and delivery, and, in that order, which are the first of their word."""
    order = np.lexsort((row_id, delivered, *reversed(words)))
    first = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for w in words:
        w = w[order]
        same &= w[1:] == w[:-1]
    first[1:] = ~same
    return order, first


class _Shard:
    """Streams sorted entries of any number of shards; a word that goes on in the next batch is carried over."""

    def __init__(self) -> None:
        self.word: tuple[int, ...] | None = None
        self.kept = 0

    def surplus(self, words: list[np.ndarray], row_id: np.ndarray) -> np.ndarray:
        """True for each entry that is a copy of an entry before it (and not the kept row itself once more)."""
        n = len(row_id)
        new = np.zeros(n, bool)
        new[0] = self.word != tuple(int(w[0]) for w in words)
        for w in words:
            new[1:] |= w[1:] != w[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        kept = np.where(at >= 0, row_id[at], self.kept)
        self.word, self.kept = tuple(int(w[-1]) for w in words), int(kept[-1])
        return ~new & (row_id != kept)


def _partial_tables(n_words: int, shards: int):
    """Insert a task's own rows; entries that lose are marked and dealt to all shards."""
    names = ["quotient", *[f"r{i}" for i in range(n_words)], "delivered", "row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(c).to_numpy() for c in names]
            words, delivered, row_id = columns[: n_words + 1], columns[-2], columns[-1]
            order, first = _insert_once(words, delivered, row_id)
            group = np.cumsum(first) - 1
            kept = row_id[order][first][group]
            lost = ~first & (row_id[order] != kept)
            out = [c[order] for c in columns]
            out[0] = np.where(lost, out[-1] % shards, out[0]).astype(np.int32)  # any shard will do: only its row id still counts
            for i in range(1, n_words + 2):
                out[i] = np.where(lost, 0, out[i])
            held.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in out], pa.array(lost)], names=[*names, "lost"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run, ", ".join(["quotient int", *[f"r{i} bigint" for i in range(n_words)], "delivered bigint", "row_id bigint", "lost boolean"])


def surplus_copies(rows: DataFrame, texts: Sequence[str], number: str, delivered_at: str, row_id: str, quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """Row ids of every row that is not the kept copy of its message."""
    numbered = rows.where(F.col(number).isNotNull())
    seeds = identity_seeds(numbered, texts)
    n_words = len(seeds) + 1
    entries = numbered.select(
        *permuted_identity(texts, number, seeds, quotient_bits),
        F.coalesce(F.unix_micros(F.col(delivered_at)), F.lit(_LAST)).alias("delivered"),
        F.coalesce(F.col(row_id), F.lit(_LAST)).alias("row_id"),
    )
    partial, schema = _partial_tables(n_words, 1 << quotient_bits)
    words = ["quotient", *[f"r{i}" for i in range(n_words)]]
    table = entries.mapInArrow(partial, schema).repartition("quotient").sortWithinPartitions("lost", *words, "delivered", "row_id")

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            if not batch.num_rows:
                continue
            lost = batch.column("lost").to_numpy(zero_copy_only=False)
            ids = batch.column("row_id").to_numpy()
            surplus, live = lost.copy(), np.flatnonzero(~lost)
            if len(live):
                surplus[live] = shard.surplus([batch.column(w).to_numpy()[live] for w in words], ids[live])
            yield pa.RecordBatch.from_arrays([pa.array(ids[surplus & (ids != _LAST)])], names=["row_id"])

    return table.mapInArrow(insert, "row_id bigint").withColumnRenamed("row_id", row_id)


def keep_one(rows: DataFrame, texts: Sequence[str], number: str, delivered_at: str, row_id: str) -> DataFrame:
    """All columns of the kept copies and of the rows that are no message (no number)."""
    return rows.join(surplus_copies(rows, texts, number, delivered_at, row_id), row_id, "left_anti")


def delivery_rank(delivered_at: str, row_id: str) -> Column:
    """One fixed-width number that orders rows by delivery time, then row id; nulls come last."""
    time = F.coalesce(F.unix_micros(F.col(delivered_at)), F.lit(10**17)).cast("decimal(18,0)")
    tie = F.coalesce(F.col(row_id), F.lit(_LAST)).cast("decimal(19,0)")
    return (time * F.lit("1" + "0" * 20).cast("decimal(21,0)") + tie).cast("decimal(38,0)")


def first_copies(rows: DataFrame, texts: Sequence[str], number: str, delivered_at: str, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the kept copy of each message, and of the rows without number: one aggregate with one shuffle, for callers
    that need few columns. A filter on the texts or the number reaches the scan."""
    key = [*texts, number]
    rest = [c for c in columns if c not in key]
    messages = rows.where(F.col(number).isNotNull())
    if not rest:
        kept = messages.select(*key).distinct()
    else:
        # Few columns are held in fixed-width buffers (a hash aggregate), many as one structure (a sort aggregate).
        ranked = messages.select(*key, *rest, delivery_rank(delivered_at, row_id).alias("delivery_rank"))
        held = [F.min_by(c, "delivery_rank").alias(c) for c in rest] if len(rest) <= 8 else [F.min_by(F.struct(*rest), "delivery_rank").alias("kept")]
        kept = ranked.groupBy(*key).agg(*held).select(*key, *(rest if len(rest) <= 8 else ["kept.*"]))
    return kept.select(*columns).unionByName(rows.where(F.col(number).isNull()).select(*columns))


def copy_report(rows: DataFrame, texts: Sequence[str], number: str, delivered_at: str, row_id: str, value: str, by: Sequence[str]) -> DataFrame:
    """Per ``by`` group: messages, messages with copies, surplus rows, and messages whose copies differ in ``value``."""
    messages = rows.where(F.col(number).isNotNull()).groupBy(*texts, number)
    table = messages.agg(F.count(F.lit(1)).alias("n_copies"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("filled"))
    differs = F.coalesce(F.col("low") != F.col("high"), F.lit(False)) | ((F.col("filled") > 0) & (F.col("filled") < F.col("n_copies")))
    return table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("n_copies") > 1).alias("repeated"),
        F.sum(F.col("n_copies") - 1).alias("surplus_rows"),
        F.count_if(differs).alias("differing"),
    )
