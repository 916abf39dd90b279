"""Operator 5 against brute force over all windows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from metaloom.llm import sadedup
from tests.llm.helpers import LONG, awkward, empty


def brute(rows, length):
    where = defaultdict(list)
    for doc, text in sorted(r for r in rows if r[0] is not None and r[1]):
        words = text.split()
        for p in range(len(words) - length + 1):
            where[tuple(words[p : p + length])].append((doc, p))
    marks = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            places.sort()
            for n, (doc, p) in enumerate(places):
                marks[doc, n == 0].add(p)
    out = set()
    for (doc, first), starts in marks.items():
        begin = end = None
        for p in sorted(starts):
            if end is None or p > end:
                if end is not None:
                    out.add((doc, begin, end, first))
                begin = p
            end = p + length
        out.add((doc, begin, end, first))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 30))] for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            words += p[a:] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 20))]
            if rng.random() < 0.1:
                words += ["same"] * 25
        rows.append((i, " ".join(words)))
    return rows


def spans(df, **k):
    return {(r.doc_id, r.start_word, r.end_word, r.is_first) for r in sadedup.repeated_spans(df, **k).collect()}


@pytest.mark.parametrize("seed,length,anchor", [(1, 10, 4), (2, 10, 10), (3, 6, 1), (4, 15, 5)])
def test_spans_are_all_repeated_windows(spark, seed, length, anchor):
    rows = corpus(seed)
    got = spans(spark.createDataFrame(rows, "doc_id bigint, text string"), length=length, anchor=anchor)
    want = brute(rows, length)
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])


def test_merged_transforms_are_the_one_of_all_strings():
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 3, rng.integers(5, 30)) for _ in range(40)]
    size = np.array([len(x) for x in lists])
    stop = np.cumsum(size + 1)
    start = stop - size - 1
    symbols = np.zeros(stop[-1], np.int32)
    for a, x in zip(start, lists):
        symbols[a : a + len(x)] = x
    half = 20
    parts = [(0, half), (half, 40)]
    bwt, lf, order = [], [], []
    for p, q in parts:
        a, b = start[p], stop[q - 1]
        o, t, m = sadedup.shard_transform(symbols[a:b], start[p:q] - a, stop[p:q] - a, 4)
        bwt.append(t), lf.append(m), order.append(o + a)
    rows, block, prefixes = sadedup.merge_transforms(bwt, lf, 4)
    place = np.concatenate(order)[rows]
    groups = defaultdict(set)
    for at, b in zip(place.tolist(), block.tolist()):
        groups[b].add(at)
    text = np.searchsorted(stop, np.arange(stop[-1]), side="right")
    cyclic = defaultdict(set)
    for at in range(stop[-1]):
        i = text[at]
        s = symbols[start[i] : stop[i]]
        cyclic[tuple(np.take(s, range(at - start[i], at - start[i] + 4), mode="wrap"))].add(at)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in cyclic.values() if len(g) > 1)
    assert prefixes.sum() == len(cyclic) - 1


def test_later_occurrences_go(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, "alpha " + shared + " beta", "en", "a", 1), (2, "gamma\n" + shared + "\n\ndelta é", "en", "a", 1), (3, shared, "en", "a", 1), (4, "left alone", "en", "a", 10)]
    out = {r.doc_id: r for r in sadedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert out[1].text == rows[0][1] and out[4] == rows[3] and 3 not in out
    assert out[2].text == "gamma\ndelta é" and out[2].n_chars == len("gamma\ndelta é")


def test_odd_rows(spark):
    df = awkward(spark, "1 AS h, 2 AS start_word, 3 AS pos")
    assert {r[0] for r in spans(df)} <= {5}
    out = sadedup.remove_repeats(df)
    assert out.columns == df.columns
    assert sorted(str(r) for r in out.collect() if r.doc_id != 5) == sorted(str(r) for r in df.collect() if r.doc_id != 5)
    assert sadedup.repeated_spans(empty(spark)).collect() == [] and sadedup.remove_repeats(empty(spark)).collect() == []
    assert LONG.split()


def test_positions_beyond_a_million_words(spark):
    filler = [f"f{i}" for i in range(1 << 20)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(["a b c"] + passage + ["x y"])), (2, " ".join(filler + [f"odd{i}" for i in range(500)] + passage + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in sadedup.repeated_spans(df).collect() if r.doc_id == 1 or r.start_word > (1 << 20) + 490)
    at = (1 << 20) + 500
    assert (1, 3, 63, True) in got and (2, at, at + 60, False) in got
    assert all(r.end_word - r.start_word >= sadedup.LENGTH for r in sadedup.repeated_spans(df).collect())


def test_columns_with_the_names_used_inside(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, "one " + passage), (2, "two " + passage)], "doc_id bigint, text string").selectExpr("*", "1 AS spans", "2 AS doc", "3 AS key", "4 AS row", "5 AS c0", "6 AS __spans", "7 AS __doc")
    out = sadedup.remove_repeats(df)
    assert out.columns == df.columns and {r.doc_id: r.text.strip() for r in out.collect()} == {1: "one " + passage, 2: "two"}


def test_words_that_only_a_weak_hash_confuses_do_not_repeat(spark):
    one = ["ab"[bin(i).count("1") & 1] for i in range(2048)]
    x, y = "".join(one), "".join("ba"[c == "b"] for c in one)
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage + " " + x), (2, passage + " " + y)], "doc_id bigint, text string")
    assert {(r.start_word, r.end_word) for r in sadedup.repeated_spans(df).collect()} == {(0, 60)}
