"""Quality classifier on document statistics (operator 1).

Statistics of each text (lengths, shares of character classes, repetition,
entropies) are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Ridge regression on the quality labels needs only
the features' second moments and their products with the labels: each partition
sums its own, executors add them up, one system is solved. Scores are calibrated
by isotonic regression to probabilities.

All labelled rows are used. They fall in two halves by a hash of the id; the
model of one half scores the other, and these scores, which no model has seen in
fitting, are what the calibration is fitted on. The final scores come from the
sum of both halves' equations. The calibration works on counts in score steps of
1/STEPS, summed on the executors.

Definitions: a null or empty text, or one without words, has probability 0 and
is not kept; labels of null doc_id or null quality do not count, quality above 0
is good; several labels of a document each count; with no usable label at all
scores and probabilities are null and every document with words is kept; rows
are scored each for itself; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bytesvec import Slice, pieces, slices, words
from metaloom.llm.durable import durable

#: Fourier features, ridge, score steps, probability from which a document is kept.
FEATURES, RIDGE, STEPS, KEEP_FROM = 256, 1e-4, 1024, 0.5
SEED = 20

STATISTICS = [
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digit", "punctuation", "symbol", "space", "beyond_ascii",
    "log_lines", "line_repeats", "word_variety", "top_word", "pair_repeats", "byte_entropy", "word_entropy", "sentence_ends", "long_words", "capital_words",
]

_UPPER, _DIGIT, _SPACE, _PUNCT, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[33:127] = True
_SYMBOL[65:91] = _SYMBOL[97:123] = _SYMBOL[48:58] = False
_SYMBOL &= ~_PUNCT
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _groups(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of values h by row: how many there are, how many differ, the commonest's count, the entropy."""
    total = np.bincount(row, minlength=rows)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    start = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]))) if len(r) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(r)))
    owner = r[start]
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, owner, count)
    p = count / total[owner]
    entropy = np.bincount(owner, weights=-p * np.log2(p), minlength=rows)
    return total, np.bincount(owner, minlength=rows), top, entropy


def statistics(s: Slice) -> np.ndarray:
    """One row a text, in the order of STATISTICS; zeros for a text without words."""
    n = s.rows
    d = s.data
    edge = s.offsets

    def count(mask: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(d) + 1, np.int64)
        np.cumsum(mask, out=acc[1:])
        return acc[edge[1:]] - acc[edge[:-1]]

    chars = count((d & 0xC0) != 0x80)
    size = np.diff(edge)
    w = words(s)
    total, kinds, top, entropy = _groups(w.row, w.hash, n)
    length = (w.end - w.start).astype(np.float64)
    mean = _share(np.bincount(w.row, weights=length, minlength=n), total)
    spread = np.sqrt(np.maximum(_share(np.bincount(w.row, weights=length**2, minlength=n), total) - mean**2, 0))
    near = np.flatnonzero(w.row[1:] == w.row[:-1]) if len(w.row) > 1 else np.zeros(0, np.int64)
    pairs, pair_kinds, _, _ = _groups(w.row[near], w.hash[near] * np.uint64(0x9E3779B97F4A7C15) + w.hash[near + 1], n)
    # lines, each with the hash of its words
    feeds = np.flatnonzero(d == 10)
    line = np.searchsorted(feeds, w.start)
    fresh = np.append(True, (w.row[1:] != w.row[:-1]) | (line[1:] != line[:-1])) if len(w.row) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    place = np.arange(len(w.row)) - np.repeat(begin, np.diff(np.append(begin, len(w.row)))) if len(begin) else np.zeros(0, np.int64)
    code = w.hash * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    lines = np.add.reduceat(code, begin) if len(begin) else np.zeros(0, np.uint64)
    n_lines, line_kinds, _, _ = _groups(w.row[begin], lines, n)
    seen = np.bincount(np.repeat(np.arange(n), size) * 256 + d, minlength=n * 256).reshape(n, 256)
    p = seen / np.maximum(size, 1)[:, None]
    byte_entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    first = d[w.start] if len(w.start) else np.zeros(0, np.uint8)
    last = d[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    out = np.stack(
        [
            np.log1p(chars), np.log1p(total), mean, spread, _share(count(_UPPER[d]), chars), _share(count(_DIGIT[d]), chars), _share(count(_PUNCT[d]), chars), _share(count(_SYMBOL[d]), chars),
            _share(count(_SPACE[d]), chars), _share(count(d >= 0xC0), chars), np.log1p(n_lines), 1 - _share(line_kinds, n_lines), _share(kinds, total), _share(top, total),
            1 - _share(pair_kinds, pairs), byte_entropy, _share(entropy, np.log2(np.maximum(total, 2))), _share(np.bincount(w.row[_END[last]], minlength=n), total),
            _share(np.bincount(w.row[length > 12], minlength=n), total), _share(np.bincount(w.row[_UPPER[first]], minlength=n), total),
        ],
        axis=1,
    )
    out[total == 0] = 0
    return out


def projection(count: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases for a Gaussian kernel whose width is the root of the number of statistics."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(count, features)) / np.sqrt(count), rng.uniform(0, 2 * np.pi, features)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    #: weights of the features and of the constant
    weights: np.ndarray
    #: score steps and their probabilities, both ascending
    steps: np.ndarray
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, (len(self.weights) - 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrate(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.steps, self.probability)


def fourier(z: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    directions, phases = projection(z.shape[1], features)
    z = np.clip(z, -8, 8)
    return np.concatenate([np.sqrt(2 / features) * np.cos(z @ directions + phases), np.ones((len(z), 1))], axis=1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nondecreasing fit of least squares (pool adjacent violators)."""
    means: list[float] = []
    loads: list[float] = []
    sizes: list[int] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        means.append(v)
        loads.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            v2, w2, s2 = means.pop(), loads.pop(), sizes.pop()
            means[-1] = (means[-1] * loads[-1] + v2 * w2) / (loads[-1] + w2)
            loads[-1] += w2
            sizes[-1] += s2
    return np.repeat(means, sizes)


_STATS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.BinaryType())])
_SUM = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("sums", T.BinaryType())])


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: each document's statistics as doubles, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in (p for whole in slices(batch.column(1)) for p in pieces(whole, 1024)):
                x = statistics(s)
                raw = [r.tobytes() if r[1] > 0 else None for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(raw, pa.binary())], names=_STATS.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STATS)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(STATISTICS))


def _summed(rows: DataFrame, each) -> dict[int, np.ndarray]:
    """Sums by number of what ``each(batch)`` gives, added up in partitions, then on executors."""

    def add(got: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for k, v in got:
            sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=_SUM.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(x for b in batches if len(b) for x in each(b))

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add((k, np.frombuffer(v)) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    return {r.part: np.frombuffer(r.sums) for r in rows.mapInArrow(first, _SUM).repartition("part").mapInArrow(then, _SUM).collect()}


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """Model from ``stats`` (of ``measured``) and labels ``(doc_id, quality)``."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y"))
    half = (F.xxhash64("doc_id") % 2 != 0).cast("int").alias("half")
    rows = durable(stats.filter("x IS NOT NULL").join(known, "doc_id").select("x", "y", half))
    width = len(STATISTICS)

    def moments(b: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
        x = _rows(b.column(0))
        return [(0, np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))]

    got = _summed(rows, moments)
    if not got:
        return None
    n, s, q = got[0][0], got[0][1 : width + 1], got[0][width + 1 :]
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    side = features + 1

    def equations(b: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
        x, y, h = _rows(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
        z = fourier((x - mean) / scale, features)
        return [(k, np.append((z[h == k].T @ z[h == k]).ravel(), np.append(z[h == k].T @ y[h == k], (h == k).sum()))) for k in (0, 1)]

    got = _summed(rows, equations)

    def solve(e: np.ndarray) -> np.ndarray:
        keep = np.full(side, ridge * max(e[-1], 1))
        keep[-1] = 1e-9
        return np.linalg.solve(e[: side * side].reshape(side, side) + np.diag(keep), e[side * side : -1])

    halves = [solve(got[k]) for k in (0, 1)]
    final = solve(got[0] + got[1])
    crossed = np.stack([halves[1] if got[1][-1] else final, halves[0] if got[0][-1] else final])

    def outcomes(b: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
        x, y, h = _rows(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
        f = np.einsum("ij,ij->i", fourier((x - mean) / scale, features), crossed[h])
        step = np.clip(np.rint((f + 1) * STEPS), 0, 3 * STEPS).astype(np.int64)
        return [(0, np.concatenate([np.bincount(step, minlength=3 * STEPS + 1), np.bincount(step, weights=y, minlength=3 * STEPS + 1)]).astype(np.float64))]

    c = _summed(rows, outcomes)[0].reshape(2, -1)
    some = np.flatnonzero(c[0])
    return Model(mean, scale, final, some / STEPS - 1, isotonic(c[1][some] / c[0][some], c[0][some]))


_VERDICT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def classify(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """``(doc_id, score, probability, keep)`` of every document."""
    stats = durable(measured(docs))  # texts are read once
    model = fit(stats, labels, features)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            has = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            score, probability, keep = np.zeros(len(batch)), np.zeros(len(batch)), has.copy()
            if m is not None and has.any():
                score[has] = m.score(_rows(batch.column(1).filter(pa.array(has))))
                probability[has] = m.calibrate(score[has])
                keep[has] = probability[has] >= KEEP_FROM
            unknown = has & (m is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=~has | unknown), pa.array(probability, mask=unknown), pa.array(keep)], names=_VERDICT.names)

    return stats.mapInArrow(run, _VERDICT)
