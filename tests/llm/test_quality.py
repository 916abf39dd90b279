"""Operator 1: held-out accuracy, the kernel, the calibration, odd rows."""

import numpy as np
import pyarrow as pa

from metaloom.llm import quality
from metaloom.llm.bytesvec import slices
from tests.llm.helpers import awkward, empty

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        k = int(rng.integers(20, 200))
        if i % 3:
            text = ". ".join(" ".join(rng.choice(vocab, 9)).capitalize() for _ in range(k // 9 + 1)) + "."
        else:
            text = " ".join([str(rng.choice(vocab)).upper() + "!!"] * k) if i % 2 else " ".join(f"{w}$$#" for w in rng.choice(vocab[:20], k))
        docs.append((i, text))
        labels.append((i, int(i % 3 > 0), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 1)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = spark.createDataFrame(labels[:500], LABELS)
    got = {r.doc_id: r for r in quality.classify(d, known).collect()}
    right = sum(got[i].keep == bool(q) for i, q, _ in labels[500:])
    assert len(got) == 900 and right / 400 > 0.95
    assert all(0 <= r.probability <= 1 for r in got.values())


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(50, 20))
    f = quality.fourier(z, 4096)[:, :-1]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * 20))
    assert np.abs(f @ f.T - want).max() < 0.1


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    y, w = rng.random(30), rng.integers(1, 5, 30).astype(float)
    fit = quality.isotonic(y, w)
    brute = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(fit, brute)


def test_statistics_of_one_text():
    s = next(slices(pa.array(["Ab cd cd.\nAb cd cd.\nx 1 é"])))
    x = dict(zip(quality.STATISTICS, quality.statistics(s)[0]))
    assert np.isclose(x["log_words"], np.log1p(9)) and np.isclose(x["log_lines"], np.log1p(3))
    assert np.isclose(x["line_repeats"], 1 / 3) and np.isclose(x["word_variety"], 6 / 9) and np.isclose(x["beyond_ascii"], 1 / 25)


def test_odd_rows_and_labels(spark):
    df = awkward(spark, "1 AS x, 2 AS y, 3 AS score")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (6, 0, None), (5, None, 0), (None, 1, 0)], LABELS)
    rows = quality.classify(df, labels).collect()
    assert len(rows) == df.count()
    assert all(not r.keep and r.probability == 0 and r.score is None for r in rows if r.doc_id in (2, 3, 4))
    none = quality.classify(df, spark.createDataFrame([], LABELS)).collect()
    assert all(r.probability is None and r.keep for r in none if r.doc_id in (1, 5, 6))
    assert quality.classify(empty(spark), labels).collect() == []


def test_ridge_is_the_direct_solution(spark):
    """Partition-summed equations against one least-squares problem over all rows."""
    rng = np.random.default_rng(4)
    width = len(quality.STATISTICS)
    x = rng.normal(size=(300, width))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    stats = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "doc_id bigint, x binary").repartition(7)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, quality int")
    model = quality.fit(stats, labels, features=40, ridge=1e-2)
    z = quality.fourier((x - x.mean(axis=0)) / x.std(axis=0), 40)
    keep = np.full(z.shape[1], 1e-2 * len(x))
    keep[-1] = 1e-9
    rows = np.concatenate([z, np.diag(np.sqrt(keep))])
    want = np.linalg.lstsq(rows, np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.score(x), z @ want, atol=1e-6)
