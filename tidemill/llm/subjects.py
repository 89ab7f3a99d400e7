"""Subject areas of texts by interpolated n-gram language models, one per subject, against a background model.

Training (all texts, in Arrow batches): labels belong to texts, not sentences, and some are wrong or missing, so rounds of
expectation-maximisation share every sentence out among the subjects of its text and a background class for sentences about
nothing; each class is a bigram model interpolated with its unigram model and with the unigram model of everything. All texts
without a label join in the later rounds: any subject may be theirs, but one with less than ``CONFIDENT`` of a text's sentences
gets nothing of it, so they add words to the subjects that they are clearly about. Texts are parsed once into the shared folder; a
round is one pass that counts pairs by class in tasks (as whole numbers of 2^-24, so that their order doesn't matter), and the
driver holds the sums: one row for each word and pair of the corpus. ``train`` and ``calibrate`` are the same for texts in memory.

Scoring (all texts, in Arrow batches): a sentence's per-token cross-entropy under each subject's model is compared with that under
the background model; the differences, times the sentence's tokens, are its log-odds, and the text's own mixture, found by a few
rounds over its sentences, is the prior. A subject is accepted if its share of the text's sentences about any subject reaches its
acceptance level. The level is calibrated on the labelled texts by best agreement of the accepted subjects with the labels, less
``DOUBT`` per hundredth of distance from the nominal quarter, so that few labels move it little and many as far as they say.

What counts as a sentence: mark-up, code, URLs, tool output and page furniture are taken out first; letters are compared in lower
case after compatibility normalisation; numbers are one token; an unknown word says nothing, however long it is.

Defined results: null, empty, blank and furniture-only texts have no subjects; labels of unknown texts or subjects are ignored;
repeated labels count once; conflicting annotators each count in part; without labels no text gets a subject; repeated texts are
scored again; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import spread

MAX_TEXTS = 4_000
MAX_CHARS = 16_000_000
ROUNDS = 8
OPEN_ROUNDS = 4
CONFIDENT = 0.2
#: Weight of a subject that a text's labels don't name (labels may be incomplete); small, so that a wrong label can't draw the
#: same sentences of rightly labelled texts to its subject.
UNLABELLED = 1e-5
LOUD = 15.0
EARLY_ROUNDS = 2
EARLY_AHEAD = 1.3  # times log(subjects): what one term of one subject only is worth
TEXT_ROUNDS = 6
NOMINAL = 0.25
DOUBT = 0.5
CLEAR_GAIN = 12.0
LEVELS = tuple(x / 100 for x in range(10, 61))
#: Tokens whose table rows are held at once.
AT_ONCE = 1 << 16

_BREAK = re.compile("[\x0b\x0c\x85]")
_OTHER = regex.compile(r"[^\P{C}\n\r\t]")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"<[^<>\n]{0,400}>|&[a-z]{2,8};|&#\d{1,6};")
_URL = re.compile(r"\b(?:https?://|www\.)\S+")
_FURNITURE = re.compile(r"^\s*(?:tool\s*:.*|[-=*_#~|+.\s]+|\*\*\*.*\*\*\*|#+\s*\w*:?\s*|Page \d+.*|CHAPTER \d+)\s*$")
_ROLE = re.compile(r"^\s*(?:user|assistant|system|tool)\s*:\s*", re.I)
_END = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[.!?])(?=[A-ZÀ-Ý¿¡])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|0")
_DIGITS = re.compile(r"\d+")


def _parts(text: str | None) -> Iterator[str]:
    """The sentences of a text in lower case, numbers as ``0``."""
    if not text:
        return
    text = unicodedata.normalize("NFKC", _OTHER.sub("", _BREAK.sub("\n", text)))
    text = _URL.sub(" ", _TAG.sub("\n", _CODE.sub("\n", text)))
    for line in text.splitlines():
        if not _FURNITURE.match(line):
            yield from _END.split(_DIGITS.sub("0", _ROLE.sub("", line).lower()))


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lists of normalised words."""
    return [words for part in _parts(text) if (words := _WORD.findall(part))]


@dataclass
class Model:
    """Log-probability tables: rows are words or known pairs, columns the subjects and last the background."""

    subjects: list[str]
    words: dict[str, int] = field(default_factory=dict)
    unigram: np.ndarray | None = None
    pairs: np.ndarray | None = None
    bigram: np.ndarray | None = None
    prior: np.ndarray | None = None
    levels: np.ndarray | None = None


@dataclass
class Batch:
    """Sentences of several texts: word numbers (0 is unknown), where each sentence starts, and each text's first sentence."""

    flat: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _encode(docs: Sequence[list[list[str]]], words: dict[str, int], grow: bool) -> Batch:
    flat: list[int] = []
    starts: list[int] = []
    bounds = [0]
    for doc in docs:
        for s in doc:
            starts.append(len(flat))
            flat += [words.setdefault(w, len(words) + 1) for w in s] if grow else [words.get(w, 0) for w in s]
        bounds.append(len(starts))
    return Batch(np.array(flat, np.int64), np.array(starts, np.int64), np.array(bounds, np.int64))


def _pair_keys(flat: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    before = np.r_[0, flat[:-1]] if len(flat) else flat
    before = before.copy()
    before[starts] = size  # sentence start
    return before * (size + 1) + flat


def cross_entropies(model: Model, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Per-token cross-entropy of every sentence under every class (the background is last), and the sentences' tokens."""
    flat, starts = batch.flat, batch.starts
    lengths = np.diff(np.r_[starts, len(flat)])
    out = np.zeros((len(starts), len(model.subjects) + 1))
    if not len(starts):
        return out, lengths
    keys = _pair_keys(flat, starts, len(model.words) + 1)
    at = np.minimum(np.searchsorted(model.pairs, keys), len(model.pairs) - 1)
    known = model.pairs[at] == keys
    sentence = np.repeat(np.arange(len(starts)), lengths)
    for a in range(0, len(flat), AT_ONCE):  # a sentence that goes on in the next stretch is added up
        z = slice(a, a + AT_ONCE)
        logs = np.where(known[z, None], model.bigram[at[z]], model.unigram[flat[z]])
        cuts = np.flatnonzero(np.r_[True, sentence[z][1:] != sentence[z][:-1]])
        out[sentence[z][cuts]] -= np.add.reduceat(logs, cuts, axis=0)
    return out / lengths[:, None], lengths


def log_odds(model: Model, batch: Batch) -> np.ndarray:
    """How much less every sentence's cross-entropy is under each class than under the background, over all its tokens."""
    entropy, tokens = cross_entropies(model, batch)
    return (entropy[:, -1:] - entropy) * tokens[:, None]


def _estimate(weights: np.ndarray, sentence: np.ndarray, keys: np.ndarray, model: Model) -> None:
    """Interpolated tables from fractional counts; ``weights`` is sentences x classes."""
    _tables(model, *_pair_counts(weights, sentence, keys))


def _pair_counts(weights: np.ndarray, sentence: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, sorted, and their fractional counts by class."""
    pairs, where = np.unique(keys, return_inverse=True)
    bi = np.zeros((len(pairs), weights.shape[1]))
    for c in range(weights.shape[1]):  # one class at a time: the token-by-class table would be the largest object in memory
        bi[:, c] = np.bincount(where, weights[sentence, c], len(pairs))
    return pairs, bi


def _tables(model: Model, pairs: np.ndarray, bi: np.ndarray) -> None:
    """The model's tables from the counts of all pairs; every token is the second of one pair."""
    size, k = len(model.words) + 1, bi.shape[1]
    uni = np.zeros((size, k))
    np.add.at(uni, pairs % (size + 1), bi)
    everything = uni.sum(1)
    base = (everything + 0.5) / (everything.sum() + 0.5 * size)
    total = uni.sum(0)
    low = 0.9 * uni / np.maximum(total, 1e-9) + 0.1 * base[:, None]
    context = pairs // (size + 1)
    firsts = np.zeros((size + 1, k))
    np.add.at(firsts, context, bi)
    trust = firsts / (firsts + 3.0)
    lam = 0.6 * trust[context]
    word = pairs % (size + 1)
    model.unigram = np.log(low)
    model.pairs = pairs
    model.bigram = np.log(lam * bi / np.maximum(firsts[context], 1e-9) + (1 - lam) * low[word])
    model.unigram[0] = model.unigram[0].mean()  # an unknown word says nothing
    model.prior = total / max(total.sum(), 1e-9)


def _mixtures(odds: np.ndarray, batch: Batch, allowed: np.ndarray, rounds: int = TEXT_ROUNDS) -> np.ndarray:
    """Posterior of each sentence, with its text's mixture as prior; ``allowed`` weighs the classes of each text."""
    text_of, n = batch.text_of, np.diff(batch.bounds)
    filled = np.flatnonzero(n)
    mix = allowed / allowed.sum(1, keepdims=True)
    even = 1.0 / odds.shape[1]
    post = odds
    for _ in range(rounds):
        z = odds + np.log(mix + 1e-12)[text_of]
        z -= z.max(1, keepdims=True)
        post = np.exp(z)
        post /= post.sum(1, keepdims=True)
        sums = np.zeros_like(mix)
        if len(filled):
            sums[filled] = np.add.reduceat(post, batch.bounds[:-1][filled], axis=0)
        mix = (sums + even) / (n[:, None] + 1.0) * allowed
        mix /= mix.sum(1, keepdims=True)
    return post


def batch_shares(model: Model, batch: Batch) -> np.ndarray:
    """Per text, the share by subject of its sentences about any subject; where these are fewer than half, of half the sentences."""
    k, n = len(model.subjects), np.diff(batch.bounds)
    about = np.zeros((len(n), k))
    filled = np.flatnonzero(n)
    if model.unigram is None or not len(filled):
        return about
    post = _mixtures(log_odds(model, batch), batch, np.ones((len(n), k + 1)))
    about[filled] = np.add.reduceat(post[:, :k], batch.bounds[:-1][filled], axis=0)
    return about / np.maximum(np.maximum(about.sum(1), n / 2), 1e-9)[:, None]


def text_shares(model: Model, doc: list[list[str]]) -> np.ndarray:
    return batch_shares(model, _encode([doc], model.words, False))[0]


class Labels(dict):
    """Share of a text's annotators by subject; ``sure`` if there were several and they agreed. Empty: no label."""

    sure = False


def train(texts: list[tuple[list[list[str]], Labels]], subjects: list[str], rounds: int = ROUNDS, open_rounds: int = OPEN_ROUNDS) -> Model:
    """``texts`` are (sentences, label weights by subject); those without weights join in the ``open_rounds``."""
    model = Model(subjects)
    k = len(subjects)
    model.levels = np.full(k, NOMINAL)
    texts = sorted(((d, lab) for d, lab in texts if d), key=lambda t: not t[1])  # labelled texts first
    n_labelled = sum(bool(lab) for _, lab in texts)
    if not n_labelled:
        return model
    whole = _encode([d for d, _ in texts], model.words, True)
    place = {s: j for j, s in enumerate(subjects)}
    allowed = np.full((len(texts), k + 1), UNLABELLED)
    for i, (_, lab) in enumerate(texts):
        for s, weight in lab.items():
            allowed[i, place[s]] = max(UNLABELLED, weight)
        if not lab:
            allowed[i] = 1.0
        allowed[i, k] = 0.5

    def view(n: int) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray]:
        """The first n texts: their batch, the sentence and pair of every token, and the weight of every sentence's voice."""
        sentences_ = whole.bounds[n]
        end = whole.starts[sentences_] if sentences_ < len(whole.starts) else len(whole.flat)
        batch = Batch(whole.flat[:end], whole.starts[:sentences_], whole.bounds[: n + 1])
        sentence = np.repeat(np.arange(len(batch.starts)), np.diff(np.r_[batch.starts, len(batch.flat)]))
        # A very long text counts no more than a text of LOUD sentences: one wrong label on it would outvote many right ones.
        voice = np.minimum(1.0, LOUD / np.maximum(np.diff(batch.bounds), 1))[batch.text_of][:, None]
        return batch, sentence, _pair_keys(batch.flat, batch.starts, len(model.words) + 1), voice

    batch, sentence, keys, voice = view(n_labelled)
    weights = (allowed / allowed.sum(1, keepdims=True))[batch.text_of]
    for r in range(rounds + (open_rounds if n_labelled < len(texts) else 0)):
        _estimate(weights * voice, sentence, keys, model)
        if r == 0:  # the background starts as everything
            model.unigram[:, k] = np.log(np.exp(model.unigram[:, :k]).mean(1))
            model.bigram[:, k] = np.log(np.exp(model.bigram[:, :k]).mean(1))
        # At first a sentence must be clearly about a subject, else the background would never get the sentences all share.
        ahead = np.zeros(k + 1)
        ahead[k] = EARLY_AHEAD * np.log(k + 1e-9) if r < EARLY_ROUNDS else 0.0
        if r == rounds - 1 and n_labelled < len(texts):
            batch, sentence, keys, voice = view(len(texts))
        weights = _mixtures(log_odds(model, batch) + ahead, batch, allowed[: len(batch.bounds) - 1])
        if len(batch.bounds) - 1 > n_labelled:
            about = np.add.reduceat(weights[:, :k], batch.bounds[:-1], axis=0)
            clear = np.c_[about >= CONFIDENT * about.sum(1, keepdims=True), np.ones(len(about), bool)]
            clear[:n_labelled] = True
            weights = weights * clear[batch.text_of]
    _estimate(weights * voice, sentence, keys, model)
    return model


def calibrate(model: Model, texts: list[tuple[list[list[str]], Labels]], levels: tuple[float, ...] = LEVELS) -> None:
    """Acceptance levels by best agreement with the labels, first one for all subjects (the middle of the best stretch), then
    another for a subject where it wins at least ``CLEAR_GAIN`` texts. Texts whose annotators agree count in full, others half."""
    texts = [(d, lab) for d, lab in texts if d and lab]
    if not texts:
        return
    shares = batch_shares(model, _encode([d for d, _ in texts], model.words, False))
    truth = np.array([[(2 * lab.get(s, 0.0) - 1) * (1.0 if lab.sure else 0.5) for s in model.subjects] for _, lab in texts])
    _set_levels(model, np.array([((shares >= t) * truth).sum(0) for t in levels]), levels)


def _set_levels(model: Model, gain: np.ndarray, levels: tuple[float, ...]) -> None:
    """``gain`` is levels x subjects."""
    total = gain.sum(1) - DOUBT * np.abs(np.array(levels) - NOMINAL) * 100
    best = np.flatnonzero(total >= total.max() - 1e-9)
    common = int(best[len(best) // 2])
    model.levels[:] = levels[common]
    for j in range(len(model.subjects)):
        own = int(gain[:, j].argmax())
        if gain[own, j] >= gain[common, j] + CLEAR_GAIN:
            model.levels[j] = levels[own]


def training_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS) -> list[tuple[list[list[str]], Labels]]:
    """Sentences and label weights (share of the text's annotators) of a bounded sample: labelled texts first, then others (for
    ``train`` in memory; ``fit`` takes all texts).

    Ids and lengths of at most ``max_texts`` texts come to the driver first; texts are fetched only as far as ``max_chars`` allows.
    """
    per = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).select("doc_id", "subject", "annotator").distinct()
    per = per.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "annotator")).alias("marks"))
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    sizes = texts.select("doc_id", F.length("text").alias("n")).join(per, "doc_id", "left").orderBy(F.col("marks").isNull(), F.xxhash64("doc_id"), "doc_id").limit(max_texts)
    marks, left = {}, max_chars
    for row in sizes.collect():
        if row.n <= left:
            left -= row.n
            marks[row.doc_id] = row.marks or []
    if not any(marks.values()):
        return []
    out = []
    for row in texts.where(F.col("doc_id").isin(list(marks))).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        annotators = {m.annotator for m in marks[row.doc_id]}
        lab = Labels()
        for m in marks[row.doc_id]:
            lab[m.subject] = lab.get(m.subject, 0.0) + 1.0 / len(annotators)
        lab.sure = len(annotators) > 1 and all(v > 0.999 for v in lab.values())
        out.append((sentences(row.text), lab))
    return out


def _parsed(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> str:
    """The folder of all texts with a sentence: words in sequence, words of each sentence, and the label weights by subject (null
    without a label), apart in ``labelled``."""
    per = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).select("doc_id", "subject", "annotator").distinct()
    per = per.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "annotator")).alias("marks"))
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    place = {s: j for j, s in enumerate(subjects)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for text, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not (doc := sentences(text)):
                        continue
                    annotators, weights = {m["annotator"] for m in marks or []}, [0.0] * len(subjects)
                    for m in marks or []:
                        weights[place[m["subject"]]] += 1.0 / len(annotators)
                    sure = len(annotators) > 1 and all(v > 0.999 or not v for v in weights)
                    out.append(([w for s in doc for w in s], [len(s) for s in doc], weights if marks else None, sure, bool(marks)))
                kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["words", "lengths", "weights", "sure", "labelled"])

    rows = spread(texts.join(per, "doc_id", "left").select("text", "marks"))
    at = f"{shared_folder(documents.sparkSession)}/parsed-{uuid.uuid4().hex}"
    rows.mapInArrow(run, "words array<string>, lengths array<int>, weights array<double>, sure boolean, labelled boolean").write.partitionBy("labelled").parquet(at)
    return at


def _batches(part: pa.RecordBatch, vocabulary: pa.Array, k: int) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
    """Some texts at a time: their batch, label weights (texts x subjects, nan without a label) and whether annotators agree."""
    for at in range(0, part.num_rows, 512):
        words, lengths, weights, sure = part.slice(at, 512).columns
        flat = pc.index_in(words.flatten(), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        sizes = lengths.flatten().to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lengths).to_numpy(zero_copy_only=False))]
        shares = np.array([w if w is not None else [np.nan] * k for w in weights.to_pylist()]).reshape(-1, k)
        yield Batch(flat, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), bounds.astype(np.int64)), shares, np.array(sure.to_pylist(), bool)


def _shared_out(model: Model, batch: Batch, shares: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """The weight of every sentence for every class, as in ``train``."""
    k = len(model.subjects)
    labelled = ~np.isnan(shares).any(1)
    allowed = np.c_[np.where(labelled[:, None], np.maximum(UNLABELLED, np.nan_to_num(shares)), 1.0), np.full(len(shares), 0.5)]
    if model.unigram is None:
        weights = (allowed / allowed.sum(1, keepdims=True))[batch.text_of]
    else:
        weights = _mixtures(log_odds(model, batch) + ahead, batch, allowed)
        about = np.add.reduceat(weights[:, :k], batch.bounds[:-1], axis=0)
        clear = np.c_[about >= CONFIDENT * about.sum(1, keepdims=True), np.ones(len(about), bool)] | labelled[:, None]
        weights = weights * clear[batch.text_of]
    return weights * np.minimum(1.0, LOUD / np.diff(batch.bounds))[batch.text_of][:, None]


def _counted(rows: DataFrame, model: Model, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over ``rows``: all pairs, sorted, and their counts by class."""
    k = len(model.subjects)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"c{c}" for c in range(k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocabulary = shared.value, pa.array(list(shared.value.words), pa.string())
        pairs, bi = np.zeros(0, np.int64), np.zeros((0, k + 1))
        for part in batches:
            for batch, shares, _ in _batches(part, vocabulary, k):
                weights = _shared_out(m, batch, shares, ahead)
                sentence = np.repeat(np.arange(len(batch.starts)), np.diff(np.r_[batch.starts, len(batch.flat)]))
                more, counts = _pair_counts(weights, sentence, _pair_keys(batch.flat, batch.starts, len(m.words) + 1))
                both, where = np.unique(np.r_[pairs, more], return_inverse=True)
                total = np.zeros((len(both), k + 1))
                total[where[: len(pairs)]] = bi
                total[where[len(pairs) :]] += counts
                pairs, bi = both, total
        whole = np.rint(bi * (1 << 24)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), *(pa.array(whole[:, c]) for c in range(k + 1))], names=["pair", *names])

    sums = rows.mapInArrow(run, "pair bigint, " + ", ".join(f"{n} bigint" for n in names)).groupBy("pair").agg(*[F.sum(n).alias(n) for n in names]).toArrow().sort_by("pair")
    shared.unpersist()
    return sums.column("pair").to_numpy(), np.column_stack([sums.column(n).to_numpy() for n in names]) / (1 << 24)


def _calibrate_on(rows: DataFrame, model: Model) -> None:
    """``calibrate`` on all labelled texts."""
    k = len(model.subjects)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocabulary = shared.value, pa.array(list(shared.value.words), pa.string())
        gain = np.zeros((len(LEVELS), k))
        for part in batches:
            for batch, shares, sure in _batches(part, vocabulary, k):
                truth = (2 * shares - 1) * np.where(sure, 1.0, 0.5)[:, None]
                got = batch_shares(m, batch)
                gain += np.array([((got >= t) * truth).sum(0) for t in LEVELS])
        yield pa.RecordBatch.from_arrays([pa.array([np.rint(gain * (1 << 24)).astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], names=["gain"])

    parts = rows.mapInArrow(run, "gain array<bigint>").collect()
    _set_levels(model, sum((np.array(r.gain, np.int64) for r in parts), np.zeros(len(LEVELS) * k, np.int64)).reshape(-1, k) / (1 << 24), LEVELS)


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS, open_rounds: int = OPEN_ROUNDS) -> Model:
    """The models and acceptance levels from all texts and all labels."""
    names = sorted(r[0] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().collect())
    model = Model(names)
    k = len(names)
    model.levels = np.full(k, NOMINAL)
    if labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).isEmpty():
        return model
    spark, at = documents.sparkSession, _parsed(documents, labels, names)
    whole = spark.read.schema("words array<string>, lengths array<int>, weights array<double>, sure boolean, labelled boolean").parquet(at)
    rows, labelled = whole.select("words", "lengths", "weights", "sure"), whole.where("labelled").select("words", "lengths", "weights", "sure")
    if labelled.isEmpty():
        return model
    found = whole.select(F.explode("words").alias("w")).distinct().toArrow().column("w").to_pylist()
    model.words = {w: i + 1 for i, w in enumerate(sorted(found))}
    opened = not whole.where("NOT labelled").isEmpty()
    _tables(model, *_counted(labelled, model, np.zeros(k + 1)))
    model.unigram[:, k] = np.log(np.exp(model.unigram[:, :k]).mean(1))  # the background starts as everything
    model.bigram[:, k] = np.log(np.exp(model.bigram[:, :k]).mean(1))
    for r in range(rounds + (open_rounds if opened else 0)):
        ahead = np.zeros(k + 1)
        ahead[k] = EARLY_AHEAD * np.log(k + 1e-9) if r < EARLY_ROUNDS else 0.0
        _tables(model, *_counted(rows if r >= rounds - 1 else labelled, model, ahead))
    _calibrate_on(labelled, model)
    return model


def subject_areas(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, subject, share of every accepted subject of every text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                got = batch_shares(m, _encode([sentences(t) for t in part.column(1).to_pylist()], m.words, False))
                at, subject = np.nonzero((got >= m.levels - 1e-9) & (got > 0))
                names = [m.subjects[j] for j in subject]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(got[at, subject])], names=["doc_id", "subject", "share"])

    return documents.select(key, text).mapInArrow(run, f"doc_id {kind}, subject string, share double")
