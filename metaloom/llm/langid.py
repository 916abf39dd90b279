"""Language identification with string kernels (operator 4).

Blended-spectrum presence kernel: for n = 1..4 a text is the set of its distinct
byte n-grams (lower case, white-space runs as one space), hashed into a fixed
number of buckets for each n; the kernel of two texts is the mean over n of
|common| / sqrt(|a| |b|). Nystroem landmarks turn it into features, on which
kernel ridge regression is fitted one language against the rest. As the fitted
score is linear in a text's presence vector, texts are scored in batches by one
sparse product a length n.

The model is fitted on a bounded, documented sample of labelled rows
(``SAMPLE_DOCS``, those whose ids hash lowest, one row an id), of which ``LANDMARKS`` are the
landmarks. Everything is scored, whole texts, never prefixes.

Definitions: a null text, or one without any letter or digit, has no language
and is rejected (``lang`` null); with no labelled row at all every document is
kept with a null language. Rows are scored each for itself; ties between
languages go to the first in alphabetical order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bytesvec import Slice, pieces, slices
from metaloom.llm.durable import tidy

#: Bound of the labelled sample, landmarks among it, and the ridge.
SAMPLE_DOCS, LANDMARKS, RIDGE = 2000, 256, 1e-3
#: A text is rejected below this score of its best language (1 is a clear member, 0 none).
REJECT_BELOW = 0.2
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = {1: 8, 2: 13, 3: 15, 4: 15}


def presence(s: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: rows and buckets of the n-grams that occur, each once a row."""
    d = s.data
    lower = d + (((d >= 65) & (d <= 90)) * np.uint8(32)).astype(np.uint8)
    blank = (lower >= 9) & (lower <= 13) | (lower == 32)
    lower = np.where(blank, np.uint8(32), lower)
    row = np.repeat(np.arange(s.rows), np.diff(s.offsets))
    keep = np.ones(len(d), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    lower, row = lower[keep].astype(np.uint64), row[keep]
    out = []
    for n in ORDERS:
        m = len(lower) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        code = np.zeros(m, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | lower[i : i + m]
        whole = row[:m] == row[n - 1 :]
        bits = BUCKET_BITS[n]
        bucket = code if n == 1 else (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        seen = np.zeros(s.rows << bits, dtype=bool)
        seen[((row[:m] << bits) + bucket.astype(np.int64))[whole]] = True
        at = np.flatnonzero(seen)
        out.append((at >> bits, at & ((1 << bits) - 1)))
    return out


def dense(column: pa.Array) -> list[np.ndarray]:
    """Normalised presence matrices of a few texts, one for each n."""
    parts: list[list[np.ndarray]] = [[] for _ in ORDERS]
    for whole in slices(column):
        for s in pieces(whole, 128):
            for j, (n, (row, bucket)) in enumerate(zip(ORDERS, presence(s))):
                m = np.zeros((s.rows, 1 << BUCKET_BITS[n]), np.float32)
                m[row, bucket] = 1
                parts[j].append(m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1)))
    return [np.concatenate(p) if p else np.zeros((0, 1 << BUCKET_BITS[n]), np.float32) for n, p in zip(ORDERS, parts)]


@dataclass
class Model:
    languages: list[str]
    #: for each n: buckets x languages
    weights: list[np.ndarray]


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge, one language against the rest, on Nystroem features of the texts."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], [])
    chosen: list[int] = []  # landmarks in turn from each language
    queues = [[i for i, x in enumerate(langs) if x == language] for language in languages]
    for turn in range(max(map(len, queues))):
        chosen += [q[turn] for q in queues if turn < len(q)]
    chosen = chosen[:landmarks]
    marks = dense(pa.array([texts[i] for i in chosen], pa.string()))
    k = np.zeros((len(texts), len(chosen)))
    for at in range(0, len(texts), 128):
        part = dense(pa.array(texts[at : at + 128], pa.string()))
        k[at : at + 128] = sum((p @ m.T) for p, m in zip(part, marks)) / len(ORDERS)
    inner = k[chosen]
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, good] / np.sqrt(value[good])
    phi = k @ root
    y = np.array([[1.0 if x == language else 0.0 for language in languages] for x in langs])
    beta = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ y)
    alpha = root @ beta
    return Model(languages, [(m.T @ alpha / len(ORDERS)).astype(np.float32) for m in marks])


def score(model: Model, s: Slice) -> np.ndarray:
    """Scores of a slice's texts, rows x languages."""
    out = np.zeros((s.rows, len(model.languages)))
    for p in pieces(s, 128):
        for w, (row, bucket) in zip(model.weights, presence(p)):
            count = np.bincount(row, minlength=p.rows)
            edge = np.concatenate([[0], np.cumsum(count)])
            sums = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w[bucket], axis=0, dtype=np.float64)])
            out[p.first - s.first : p.first - s.first + p.rows] += (sums[edge[1:]] - sums[edge[:-1]]) / np.sqrt(np.maximum(count, 1))[:, None]
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model from labelled rows of ``docs`` (columns doc_id, text, lang)."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("text", "lang", F.xxhash64("doc_id").alias("h"))
    lowest = known.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    # of rows that repeat an id one counts, so there are no more rows than ids
    one = F.min(F.struct("lang", "text")).alias("row")
    rows = known.filter(F.col("h") <= F.lit(lowest)).groupBy("h").agg(one).select("h", "row.*").collect() if lowest is not None else []
    rows.sort(key=lambda r: (r.h, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


def _verdicts(model: Model, s: Slice) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    n = s.rows
    marks = np.concatenate([[0], np.cumsum((s.data >= 128) | ((s.data >= 48) & (s.data <= 57)) | ((s.data | 32) >= 97) & ((s.data | 32) <= 122))])
    has = marks[s.offsets[1:]] > marks[s.offsets[:-1]]
    if not model.languages:
        return [None] * n, np.zeros(n), np.zeros(n), has
    f = score(model, s)
    best = np.argmax(f, axis=1)
    top = f[np.arange(n), best]
    rest = np.where(np.arange(f.shape[1]) == best[:, None], -np.inf, f).max(axis=1, initial=-np.inf) if f.shape[1] > 1 else np.zeros(n)
    ok = has & (top >= REJECT_BELOW)
    return [model.languages[b] if k else None for b, k in zip(best.tolist(), ok.tolist())], np.where(has, top, 0.0), np.where(has, top - rest, 0.0), ok


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language, score and margin of every document; accepted says whether it has one."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                lang, top, margin, ok = _verdicts(shared.value, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(lang, pa.string()), pa.array(top), pa.array(margin), pa.array(ok)], names=SCHEMA.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that have a language, all their columns as they were."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_verdicts(shared.value, s)[3] for s in slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(ok) if ok else np.zeros(0, bool)))

    return docs.mapInArrow(tidy(run), docs.schema)
