"""Operator 4: the kernel by hand, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa

from metaloom.llm import langid
from metaloom.llm.bytesvec import slices
from tests.llm.helpers import awkward, empty

WORDS = {
    "en": "the of and to in is that for it with as was on are this be at by not have from which or had but what".split(),
    "de": "der die und das ist nicht ein zu mit auf für sich dem auch werden aus hat dass sie nach wird bei einer über".split(),
    "fr": "le de et la les des est dans que une pour qui sur pas avec sont par plus ce ne cette été aux même être".split(),
}


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 40))), lang) for i in range(n) for lang in [sorted(WORDS)[i % 3]]]


def test_held_out_accuracy(spark):
    rows = texts(600, 3)
    model = langid.train(spark.createDataFrame(rows[:300], "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows[300:], "doc_id bigint, text string, lang string"), model).collect()}
    assert sum(got[i].lang == lang for i, _, lang in rows[300:]) >= 295


def test_scores_are_the_kernel_expansion():
    rows = texts(60, 4)
    model = langid.fit([t for _, t, _ in rows], [lang for _, _, lang in rows], landmarks=20)
    column = pa.array([t for _, t, _ in texts(10, 5)])
    direct = sum(m @ w for m, w in zip(langid.dense(column), model.weights))
    assert np.allclose(np.concatenate([langid.score(model, s) for s in slices(column)]), direct, atol=1e-4)


def test_unknown_script_is_rejected(spark):
    model = langid.train(spark.createDataFrame(texts(300, 6), "doc_id bigint, text string, lang string"))
    df = spark.createDataFrame([(1, "漢字仮名交じり文は日本語の文章である", "ja"), (2, "!!! ??? ...", "en"), (3, "the of and to in is that for it", None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.accepted for r in langid.identify(df, model).collect()} == {1: False, 2: False, 3: True}
    assert [r.doc_id for r in langid.keep_identified(df, model).collect()] == [3]


def test_odd_rows(spark):
    df = awkward(spark, "1 AS score, 2 AS accepted")
    rows = langid.identify(df).collect()
    assert len(rows) == df.count() and all(not r.accepted and r.lang is None for r in rows if r.doc_id in (2, 3, 4))
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1, 5}
    assert langid.identify(empty(spark)).collect() == [] and langid.keep_identified(empty(spark)).collect() == []


def test_scores_are_those_of_kernel_ridge_over_n_gram_sets():
    """By the definition, from sets of byte n-grams and dense matrices."""
    rows = texts(60, 3)
    train, langs, asked = [t for _, t, _ in rows[:40]], [x for _, _, x in rows[:40]], [t for _, t, _ in rows[40:]]

    def grams(t, n):
        b = " ".join(t.lower().split()).encode()
        return {b[i : i + n] for i in range(len(b) - n + 1)}

    def kernel(x, y):
        return np.mean([len(grams(x, n) & grams(y, n)) / max(1, np.sqrt(len(grams(x, n)) * len(grams(y, n)))) for n in langid.ORDERS])

    languages = sorted(set(langs))
    k = np.array([[kernel(x, y) for y in train] for x in train])
    y = np.array([[float(x == language) for language in languages] for x in langs])
    # all rows are landmarks: features phi with phi phi' = k
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k @ root
    beta = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(train) * np.eye(phi.shape[1]), phi.T @ y)
    want = np.array([[kernel(x, t) for t in train] for x in asked]) @ root @ beta
    model = langid.fit(train, langs, landmarks=len(train))
    got = np.concatenate([langid.score(model, s) for s in slices(pa.array(asked))])
    # n-grams are hashed into buckets, so scores agree nearly and verdicts fully
    assert model.languages == languages and np.abs(got - want).max() < 0.05
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_rows_that_repeat_an_id_do_not_widen_the_sample(spark, monkeypatch):
    rows = [(7, t, "en") for _, t, _ in texts(30, 5)] + [(i + 10, t, x) for i, t, x in texts(30, 6)]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda t, x: seen.append(len(t)) or langid.Model([], []))
    langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=31)
    langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=5)
    assert seen == [31, 5]
