"""Exact top-k inner-product search, every row a query (operator 8).

Vectors stand in blocks of descending length. A task holds a group of queries
and meets item blocks in that order; per query it keeps the k best so far.

1. Length: once |q| times the longest item of a block cannot reach a query's
   k-th best, neither can any later block, and the query is done.
2. Rotation: vectors are turned to the axes of their second moments (the right
   singular vectors of the table), so leading coordinates carry the most. The
   product over the leading coordinates plus the product of the two residual
   lengths bounds the whole (Cauchy-Schwarz); only pairs whose bound reaches the
   k-th best are finished.

Partial sums are single precision with a margin above their rounding error;
whatever passes is computed anew in double precision from the vectors
themselves, so results are exact. Every range of items begins with the longest
block of all, for a good k-th best from the start.

Definitions: those of ``vectors``; a vector is no neighbour of itself; ties go
to the smaller id; with fewer than k others all of them are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.vectors import BLOCK_ROWS, blocks, rotation, unpack, usable

K = 10
#: Bytes of items that one task meets, and most query blocks in a group (cost only).
RANGE_BYTES, GROUP_BLOCKS = 64 << 20, 16

_HIT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("neighbor_id", T.LongType()), T.StructField("p", T.DoubleType())])


class Queries:
    """The k best of a block of queries, from items shown in descending length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x.astype(np.float64), k
        self.head = max(1, min(x.shape[1], max(8, x.shape[1] // 4)))
        turned = (self.x @ axes).astype(np.float32)
        self.lead, self.rest = np.ascontiguousarray(turned[:, : self.head]), np.ascontiguousarray(turned[:, self.head :])
        self.tail = np.sqrt((self.rest.astype(np.float64) ** 2).sum(axis=1))
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.bar = np.full(len(ids), -np.inf)
        self.row = np.zeros(0, np.int64)
        self.who = np.zeros(0, np.int64)
        self.value = np.zeros(0)
        self.finished = 0

    def meet(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray) -> bool:
        """False when no later, shorter block can matter."""
        wide = x.astype(np.float64)
        longest = float(np.sqrt((wide**2).sum(axis=1)).max(initial=0))
        slack = 3e-7 * x.shape[1] * (self.length * longest + 1e-30)
        live = np.flatnonzero(self.length * longest >= self.bar - slack)
        if not len(live):
            return False
        turned = (wide @ axes).astype(np.float32)
        lead, rest = turned[:, : self.head], turned[:, self.head :]
        tail = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
        for at in range(0, len(live), 1024):
            q = live[at : at + 1024]
            least = (self.bar[q] - slack[q]).astype(np.float32)
            part = self.lead[q] @ lead.T
            if np.isneginf(least).any():
                part += self.rest[q] @ rest.T
                if part.shape[1] > self.k + 1:  # one more than k, for the query itself
                    least = np.partition(part, -(self.k + 1), axis=1)[:, -(self.k + 1)] - 2 * slack[q].astype(np.float32)
                r, c = np.nonzero(part >= least[:, None])
            else:
                reach = part + self.tail[q].astype(np.float32)[:, None] * tail[None, :] >= least[:, None]
                if np.count_nonzero(reach) * 12 > reach.size:
                    part += self.rest[q] @ rest.T
                    r, c = np.nonzero(part >= least[:, None])
                else:
                    r, c = np.nonzero(reach)
                    full = part[r, c] + np.einsum("ij,ij->i", self.rest[q[r]], rest[c])
                    r, c = r[full >= least[r]], c[full >= least[r]]
            self.finished += len(r)
            other = self.ids[q[r]] != ids[c]
            r, c = q[r[other]], c[other]
            self._take(q, r, ids[c], np.einsum("ij,ij->i", self.x[r], wide[c]))
        return True

    def _take(self, q: np.ndarray, row: np.ndarray, who: np.ndarray, value: np.ndarray) -> None:
        if not len(row):
            return
        mine = np.isin(self.row, q)
        row, who, value = (np.concatenate([a[mine], b]) for a, b in ((self.row, row), (self.who, who), (self.value, value)))
        order = np.lexsort((who, -value, row))
        row, who, value = row[order], who[order], value[order]
        # a block met twice brings the same items
        again = np.append(False, (row[1:] == row[:-1]) & (who[1:] == who[:-1]))
        row, who, value = row[~again], who[~again], value[~again]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        full = rank == self.k - 1
        self.bar[row[full]] = value[full]
        best = rank < self.k
        self.row, self.who, self.value = (np.concatenate([a[~mine], b[best]]) for a, b in ((self.row, row), (self.who, who), (self.value, value)))


def neighbours(rows: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(vec_id, rank, neighbor_id, inner_product)``, rank 1 for the best."""
    if k < 1:
        raise ValueError("k is at least 1")
    vectors = usable(rows, key, vector)
    count, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    axes = rotation(vectors, dim, centred=False)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    packed = blocks(vectors.withColumn("length", length), [F.desc("length"), F.asc("id")], count, dim, block_rows)
    # one small row a block: its number in the order
    order = [r.block for r in packed.select("block").orderBy("block").collect()]
    n = len(order)
    group = min(GROUP_BLOCKS, max(1, n // 24))
    span = max(1, min(n or 1, range_bytes // max(1, block_rows * dim * 4)))
    groups, spans = -(-n // group), -(-n // span)
    spark = rows.sparkSession
    numbered = packed.join(spark.createDataFrame(list(zip(order, range(n))), "block bigint, idx bigint"), "block")
    g, s = F.expr(f"idx div {group}"), F.expr(f"idx div {span}")
    fields = ["g", "s", "item", "idx", "ids", "data"]
    asked = numbered.select(g.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(spans - 1, 0)).cast("long"))).alias("s"), F.lit(False).alias("item"), "idx", "ids", "data")
    items = numbered.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(groups - 1, 0)).cast("long"))).alias("g"), s.alias("s"), F.lit(True).alias("item"), "idx", "ids", "data")
    first = numbered.filter("idx = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(groups - 1, 0)).cast("long"))).alias("g"), F.lit(True).alias("item"), "idx", "ids", "data")
    first = first.crossJoin(spark.range(1, max(spans, 1)).withColumnRenamed("id", "s")).select(*fields)
    tasks = asked.select(*fields).unionByName(items.select(*fields)).unionByName(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, done = None, [], []

        def result() -> Iterator[pa.RecordBatch]:
            for q in held:
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[q.row]), pa.array(q.who), pa.array(q.value)], names=_HIT.names)

        for batch in batches:
            for i in range(len(batch)):
                now = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if now != task:
                    yield from result()
                    task, held, done = now, [], []
                ids, x = unpack(batch.column(4)[i], batch.column(5)[i], dim)
                if not batch.column(2)[i].as_py():
                    held.append(Queries(ids, x, axes, k))
                    done.append(False)
                    continue
                for j, q in enumerate(held):
                    if not done[j]:
                        done[j] = not q.meet(ids, x, axes)
        yield from result()

    # one partition a task; inside it queries come before items, items by descending length
    hits = tasks.repartition(max(1, groups * spans), "g", "s").sortWithinPartitions("g", "s", "item", "idx").mapInArrow(run, _HIT)
    if spans > 1:  # the longest block was met in each span
        hits = hits.dropDuplicates(["vec_id", "neighbor_id"])
    best = Window.partitionBy("vec_id").orderBy(F.desc("p"), F.asc("neighbor_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.round("p", 6).alias("inner_product"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, max(embedding)::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id
), p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_dot_product(a.e, b.e) AS p FROM v a JOIN v b ON a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, neighbor_id) AS rank FROM p
)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(p, 6) AS inner_product FROM r WHERE rank <= {K}
"""
