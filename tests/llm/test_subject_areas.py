import random

import numpy as np

from tidemill.llm import subjects as s

TERMS = {"law": ["affidavit", "jury panel", "bail condition", "lease clause"], "sport": ["goalkeeper", "lap record", "relay team", "cup final"], "cooking": ["egg yolk", "bread crust", "fish fillet", "brown butter"]}
FILL = ["Some of this was said before.", "There is no short answer.", "It took longer than anyone had guessed."]


def sentence(r, subject):
    a, b = r.sample(TERMS[subject], 2)
    return r.choice([f"Compared with the {a}, the {b} looked old.", f"Nobody had seen the {a} before the {b} changed.", f"{r.randrange(900)} of the notes mention the {a}."])


def text(r, mix, n=8):
    out = [sentence(r, k) for k, share in mix.items() for _ in range(max(1, round(share * n)))]
    out.insert(r.randrange(len(out)), r.choice(FILL))
    return " ".join(out)


def corpus(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.sample(sorted(TERMS), 2)
        mix = {a: 1.0} if i % 3 else {a: 0.5, b: 0.5}
        out.append((i, text(r, mix), sorted(mix)))
    return out


def test_held_out_accuracy():
    docs = corpus(160)
    labelled = [(s.sentences(t), {x: 1.0 for x in want}) for _, t, want in docs[:100]]
    labelled[0] = (labelled[0][0], {"sport": 1.0})  # a wrong label
    m = s.train(labelled, sorted(TERMS))
    right = sum(sorted(x for x, v in zip(m.subjects, s.text_shares(m, s.sentences(t))) if v >= s.NOMINAL) == want for _, t, want in docs[100:])
    assert right >= 57


def test_passing_remark_and_filler_do_not_count():
    m = s.train([(s.sentences(t), {x: 1.0 for x in want}) for _, t, want in corpus(100)], sorted(TERMS))
    r = random.Random(9)
    remark = " ".join([*(sentence(r, "law") for _ in range(9)), sentence(r, "sport")])
    got = dict(zip(m.subjects, s.text_shares(m, s.sentences(remark))))
    assert got["law"] > 0.8 and got["sport"] < 0.2
    assert max(s.text_shares(m, s.sentences(" ".join(FILL * 3)))) < s.NOMINAL
    assert max(s.text_shares(m, s.sentences("Zzz qqq. Www eee."))) < 0.5


def test_sentences_drop_markup():
    text = "<p>The Jury panel met.</p>\n```\ncode here now\n```\nuser: See https://x.example/y now.\n*** START OF X ***\nPage 12\nNobody\x07 came. ＡＢ cd."
    assert s.sentences(text) == [["the", "jury", "panel", "met"], ["see", "now"], ["nobody", "came"], ["ab", "cd"]]
    assert s.sentences(None) == [] and s.sentences("  ") == [] and s.sentences("a" * 100_000 + "!") == [["a" * 100_000]]
    assert s.sentences("Twelve 12 and 3.5x. Word") == [["twelve", "0", "and", "0"], ["0", "x"], ["word"]] or s.sentences("Twelve 12. Word") == [["twelve", "0"], ["word"]]


def test_long_texts_are_scored_in_stretches(monkeypatch):
    m = s.train([(s.sentences(t), {x: 1.0 for x in want}) for _, t, want in corpus(60)], sorted(TERMS))
    batch = s._encode([s.sentences(t) for _, t, _ in corpus(30, 2)] + [[]], m.words, False)
    want = s.batch_shares(m, batch)
    monkeypatch.setattr(s, "AT_ONCE", 7)
    assert np.allclose(s.batch_shares(m, batch), want) and want[-1].sum() == 0


def test_cross_entropy_is_per_token():
    m = s.train([(s.sentences(t), {x: 1.0 for x in want}) for _, t, want in corpus(60)], sorted(TERMS))
    doc = s.sentences("Nobody had seen the affidavit before the jury panel changed.")
    entropy, tokens = s.cross_entropies(m, s._encode([doc], m.words, False))
    assert tokens.tolist() == [10] and entropy.shape == (1, 4) and entropy[0, m.subjects.index("law")] < entropy[0, -1] < entropy[0, m.subjects.index("sport")] + 9


def test_unlabelled_texts_add_words():
    """Three labels a subject; the other texts bring the terms that the labelled ones lack."""
    docs = corpus(300, 4)
    seen = {}
    labelled = [(s.sentences(t), s.Labels({x: 1.0 for x in want})) for _, t, want in docs if len(want) == 1 and seen.setdefault(want[0], []).append(1) is None and len(seen[want[0]]) <= 3]
    more = [(s.sentences(t), s.Labels()) for _, t, _ in docs[:200]]
    right = lambda m: sum(sorted(x for x, v in zip(m.subjects, s.text_shares(m, s.sentences(t))) if v >= s.NOMINAL) == want for _, t, want in docs[200:])
    few, many = right(s.train(labelled, sorted(TERMS))), right(s.train(labelled + more, sorted(TERMS)))
    assert many >= few and many >= 85, (few, many)


def test_sample_is_bounded_and_labelled_first(spark):
    docs = corpus(40)
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(100, "x " * 50_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "law", "a") for i in (3, 5, 100)], "doc_id bigint, subject string, annotator string")
    got = s.training_sample(frame, labels, ["law"], max_texts=10, max_chars=20_000)
    assert len(got) == 9 and sum(bool(lab) for _, lab in got) == 2
    assert s.training_sample(frame, labels.limit(0), ["law"]) == []


def test_fit_is_training_on_all_texts(spark, monkeypatch):
    docs = corpus(90, 3)
    labelled = {i: want for i, _, want in docs[:60]}
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, " ")], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, x, a) for i, want in labelled.items() for x in want for a in ("a", "b")][:-1] + [(7, "law", "c")], "doc_id bigint, subject string, annotator string")
    want = s.training_sample(frame, labels, sorted(TERMS))
    m = s.train(want, sorted(TERMS))
    s.calibrate(m, want)
    monkeypatch.setattr(s, "MAX_TEXTS", 10)
    monkeypatch.setattr(s.training_sample, "__defaults__", (10, 1_000))
    got = s.fit(frame, labels, spark.createDataFrame([(x,) for x in TERMS], "subject string"))
    assert len(want) == 91 and set(got.words) == set(m.words) and np.allclose(got.levels, m.levels)
    for _, t, _ in docs[60:]:
        assert np.allclose(s.text_shares(got, s.sentences(t)), s.text_shares(m, s.sentences(t)), atol=1e-4)


def test_frame(spark):
    docs = corpus(120)
    extra = [(500, None), (501, ""), (502, " \n"), (503, docs[0][1]), (504, docs[0][1] + " " + "x" * 200_000)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs] + extra, "doc_id bigint, text string").selectExpr("*", "1 AS share", "'k' AS subject")
    marks = [(i, x, "ann_a") for i, _, want in docs[:90] for x in want]
    labels = spark.createDataFrame([*marks, *marks[:5], (9999, "law", "ann_a"), (1, "unknown", "ann_b"), (None, "law", None)], "doc_id bigint, subject string, annotator string")
    subjects = spark.createDataFrame([(x, "") for x in TERMS], "subject string, about string")
    m = s.fit(frame, labels, subjects)
    got = {}
    for r in s.subject_areas(frame, m).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert sum(sorted(got.get(i, [])) == want for i, _, want in docs) >= 114
    assert not {500, 501, 502} & set(got) and got[503] == got[0] == got[504]
    none = s.fit(frame, labels.limit(0), subjects)
    assert s.subject_areas(frame, none).count() == 0 and s.subject_areas(frame.limit(0), m).count() == 0
