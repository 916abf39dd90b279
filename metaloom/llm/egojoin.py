"""Embedding near-duplicates with an epsilon grid order join (operator 10).

Vectors are turned to their principal axes; the leading ones carry a grid of
cells as wide as the radius. Sorted by cell, axis after axis (epsilon grid
order), the table is one sequence, cut into intervals. Each interval has a
bounding box on the leading axes; turning keeps distances, so two intervals
whose boxes are further apart than the radius are provably distant and never
meet. The others are joined recursively: the longer interval is halved, boxes
are compared again, and short intervals are compared by partial distances on the
leading axes first. What passes is computed in double precision from the vectors
themselves, so the join is exact.

Equal vectors are one with a number of ids, so copies cost nothing in the join. Each
pair of intervals returns, for every vector, how many ids it is linked with there and
one vector that it hangs together with: pairs are never written.

Definitions: those of ``vectors``; vectors exactly at the radius are linked; a class
is named by its least id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bytesvec import united
from metaloom.llm.durable import durable, shuffle_width
from metaloom.llm.partenum import components
from metaloom.llm.vectors import BLOCK_ROWS, blocks, matrix, rotation, unpack, usable

#: Radius: cosine similarity of 0.955 for unit vectors.
RADIUS = 0.3
#: Leading axes with cells and boxes, leading axes of partial distances, rows of a short interval (cost only).
GRID_AXES, PARTIAL_AXES, SHORT = 8, 16, 512

_GRID = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("weight", T.LongType()), T.StructField("cell", T.ArrayType(T.LongType()))])
_BOX = T.StructType([T.StructField("block", T.LongType()), T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType()))])
_LINK = T.StructType([T.StructField("id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("other", T.LongType())])


class Interval:
    """A run of the sequence: ids, vectors and turned leading coordinates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turned: np.ndarray):
        self.ids, self.x, self.turned = ids, x, turned
        self.low, self.high = turned[:, :GRID_AXES].min(axis=0), turned[:, :GRID_AXES].max(axis=0)

    def halves(self) -> tuple[Interval, Interval]:
        m = len(self.ids) // 2
        return Interval(self.ids[:m], self.x[:m], self.turned[:m]), Interval(self.ids[m:], self.x[m:], self.turned[m:])


def interval(ids: np.ndarray, x: np.ndarray, axes: np.ndarray) -> Interval:
    return Interval(ids, x, x.astype(np.float64) @ axes[:, :PARTIAL_AXES])


def join(a: Interval, b: Interval, radius: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs within the radius of two intervals, or of one with itself."""
    gap = np.maximum(np.maximum(a.low - b.high, b.low - a.high), 0)
    if (gap**2).sum() > radius**2 * (1 + 1e-6) + 1e-9:
        return
    if max(len(a.ids), len(b.ids)) > SHORT:
        if same:
            p, q = a.halves()
            yield from join(p, p, radius, True)
            yield from join(p, q, radius, False)
            yield from join(q, q, radius, True)
        elif len(a.ids) >= len(b.ids):
            for p in a.halves():
                yield from join(p, b, radius, False)
        else:
            for q in b.halves():
                yield from join(a, q, radius, False)
        return
    centre = a.turned.mean(axis=0)
    p, q = (a.turned - centre).astype(np.float32), (b.turned - centre).astype(np.float32)
    sp, sq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    margin = 1e-5 * (float(sp.max()) + float(sq.max())) + 1e-12
    near = sp[:, None] + sq[None, :] - 2 * (p @ q.T) <= radius**2 * (1 + 1e-6) + margin
    i, j = np.nonzero(near)
    if same:
        i, j = i[i < j], j[i < j]
    for at in range(0, len(i), 1 << 16):
        m, n = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d = a.x[m].astype(np.float64) - b.x[n]
        d = np.sqrt((d * d).sum(axis=1))
        ok = d <= radius
        yield a.ids[m[ok]], b.ids[n[ok]], d[ok]


def linked(a: Interval, b: Interval, radius: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of two intervals' linked vectors, the weight that each is linked with, and
    another of its group. The intervals' ids are ``(id, weight)``."""
    rows = a.ids if same else np.concatenate([a.ids, b.ids])
    rows = rows[np.argsort(rows[:, 0])]
    links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for p, q, _ in join(a, b, radius, same):
        x, y = np.searchsorted(rows[:, 0], p[:, 0]), np.searchsorted(rows[:, 0], q[:, 0])
        np.add.at(links, x, q[:, 1])
        np.add.at(links, y, p[:, 1])
        label = united(label, x, y)
    some = np.flatnonzero(links)
    return rows[some, 0], links[some], rows[label[some], 0]


def near_duplicates(rows: DataFrame, radius: float = RADIUS, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, class_id, links)``, one row an id: how many other ids have a vector at
    most ``radius`` away, copies among them, and the least id of those that it hangs
    together with by such links (its own where there are none).
    """
    if radius <= 0:
        raise ValueError("the radius is positive")
    # negative zeros become zeros and vectors get one length, so equal vectors are equal arrays
    found = usable(rows, key, vector)
    count, dim = found.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    padded = F.transform(F.concat("v", F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size("v"))), lambda x: x + F.lit(0.0).cast("float"))
    same = durable(found.select("id", padded.alias("v")))
    groups = durable(same.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    axes = rotation(groups, dim, centred=True)
    lead = min(GRID_AXES, dim)

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = matrix(batch.column(1), dim).astype(np.float64) @ axes[:, :lead]
            cell = np.floor(np.clip(t / radius, -1e15, 1e15)).astype(np.int64)
            offs = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * lead)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(offs, pa.array(cell.ravel()))], names=_GRID.names)

    ordered = groups.select("id", "v", "weight").mapInArrow(grid, _GRID)
    packed = blocks(ordered, [F.asc("cell"), F.asc("id")], count, dim, block_rows, weighted=True)

    def opened(ids: pa.Scalar, data: pa.Scalar) -> Interval:
        i, x = unpack(ids, data, dim)
        return interval(i.reshape(-1, 2), x, axes)

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, x in zip(*(batch.column(c) for c in (0, 2, 3))):
                b = opened(i, x)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()]), pa.array([b.low.tolist()], pa.list_(pa.float64())), pa.array([b.high.tolist()], pa.list_(pa.float64()))], names=_BOX.names)

    boxes = durable(packed.mapInArrow(box, _BOX))
    # intervals meet by the cells of the first axis, then by the distance of their boxes
    cells = F.explode(F.sequence(F.floor(F.col("low")[0] / radius), F.floor(F.col("high")[0] / radius))).alias("cell")
    around = F.explode(F.sequence(F.floor(F.col("low")[0] / radius) - 1, F.floor(F.col("high")[0] / radius) + 1)).alias("cell")
    left = boxes.select(F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), cells)
    right = boxes.select(F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), around)
    gaps = F.zip_with(F.zip_with("low_i", "high_j", lambda x, y: x - y), F.zip_with("low_j", "high_i", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    pairs = left.join(right, "cell").filter(F.col("i") <= F.col("j")).filter(apart <= radius**2 * (1 + 1e-6) + 1e-9).select("i", "j").distinct()
    # the task of interval i meets it first, then its later partners
    tasks = pairs.withColumnRenamed("j", "block").join(packed, "block").select("i", "block", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = None, None
        for batch in batches:
            for k, other, i, x in zip(*(batch.column(c) for c in range(4))):
                b = opened(i, x)
                if k.as_py() != own:
                    own, first = k.as_py(), b
                got = linked(first, b, radius, other.as_py() == own)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=_LINK.names)

    width = max(shuffle_width(rows), -(-count // block_rows))
    near = durable(tasks.repartition(width, "i").sortWithinPartitions("i", "block").mapInArrow(run, _LINK))
    roots = components(near.select(F.col("id").alias("x"), F.col("other").alias("y")).filter("x <> y").distinct())
    links = near.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links")).join(roots, "node", "left")
    known = groups.join(links, F.col("id") == F.col("node"), "left").select("v", F.coalesce("root", "id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return same.join(known, "v").select(F.col("id").alias("vec_id"), "class_id", "links")


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, max(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_distance(a.e::DOUBLE[], b.e::DOUBLE[]) <= {RADIUS}
), u AS (
  SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), r AS (
  SELECT x AS vec_id, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.vec_id WHERE r.root < u.y
), k AS (
  SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id
), l AS (
  SELECT x AS vec_id, count(*) AS links FROM u GROUP BY x
)
SELECT v.vec_id, coalesce(k.root, v.vec_id) AS class_id, coalesce(l.links, 0) AS links FROM v LEFT JOIN k USING (vec_id) LEFT JOIN l USING (vec_id)
"""
