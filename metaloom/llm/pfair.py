"""Mixing sources to target weights by Pfair scheduling (operator 6).

The documents of each source, in the order of a hash of their ids, are cut into
blocks of ``BLOCK_DOCS``; the output has one slot a block. With integer weights a
that add up to A, block j of a source (from 0) is released at slot
floor(j * A / a) and has its deadline at slot ceil((j + 1) * A / a). Earliest
deadline first, among released blocks, gives each block a slot within its window,
so at any slot a source is less than one block from its weight's share.

All lags are zero after A slots, where the schedule repeats. It is therefore
worked out for one period only, whatever the data's size: block q * a + r of a
source has slot q * A + (slot of block r). When a source has no block left, a new
phase begins with the weights of those that remain, so no document is dropped and
none is repeated; the bound holds within each phase. There are at most as many
phases as sources, and only the sources' block counts reach the driver.

Ranks within a source come from counts of hash ranges, so the largest source is
spread over many tasks.

Definitions: a null source is a source of its own (null); without given weights a
source's weight is the square root of its number of documents, in shares of
``PARTS``, one part at least; a given weight of 0, or none for a source where
weights are given, puts the source's documents after all others; repeated rows
and rows of null doc_id are documents each for itself; an empty table gives an
empty result. A source's last block may hold fewer documents than others.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a block, and parts that weights are rounded to.
BLOCK_DOCS, PARTS = 16, 1000
#: Documents of a hash range, about; entries of the schedule up to which it is broadcast (cost only).
RANGE_DOCS, BROADCAST_ENTRIES = 20_000, 200_000

SCHEDULE = "source string, phase int, j_from bigint, j_to bigint, start bigint, share bigint, period bigint, places array<int>"


def period(shares: dict) -> dict:
    """Slots of each source's blocks in one period of earliest deadline first."""
    total = sum(shares.values())
    names = list(shares)
    placed: dict = {s: [] for s in names}
    ready: list[tuple[int, int]] = []  # (deadline, number of the source)
    waiting: dict[int, list[int]] = {0: list(range(len(names)))}
    for slot in range(total):
        for n in waiting.pop(slot, ()):
            a, j = shares[names[n]], len(placed[names[n]])
            heapq.heappush(ready, (-(-(j + 1) * total // a), n))
        _, n = heapq.heappop(ready)
        placed[names[n]].append(slot)
        a, j = shares[names[n]], len(placed[names[n]])
        if j < a:
            release = max(j * total // a, slot + 1)
            waiting.setdefault(release, []).append(n)
    return placed


def phases(blocks: dict, weights: dict) -> list[tuple]:
    """Rows of SCHEDULE for sources' block counts and integer weights."""
    done = {s: 0 for s in blocks}
    left = {s for s, n in blocks.items() if n > 0}
    key = lambda s: (s is None, s or "")
    out, start, number = [], 0, 0
    while left:
        active = sorted((s for s in left if weights.get(s, 0) > 0), key=key) or sorted(left, key=key)
        shares = {s: max(1, weights.get(s, 0)) for s in active}
        placed, total = period(shares), sum(shares.values())

        def slot(s, j):
            return j // shares[s] * total + placed[s][j % shares[s]]

        end = min(slot(s, blocks[s] - done[s] - 1) for s in active) + 1
        for s in active:
            whole, rest = divmod(end, total)
            served = whole * shares[s] + sum(p < rest for p in placed[s])
            if served:
                out.append((s, number, done[s], done[s] + served, start, shares[s], total, placed[s]))
            done[s] += served
            if done[s] == blocks[s]:
                left.discard(s)
        start, number = start + end, number + 1
    return out


def default_weights(docs: dict) -> dict:
    """Square roots of document counts, in parts of PARTS."""
    roots = {s: n**0.5 for s, n in docs.items()}
    total = sum(roots.values()) or 1
    return {s: max(1, round(PARTS * r / total)) for s, r in roots.items()}


def _ranked(rows: DataFrame) -> tuple[DataFrame, list]:
    """``rows`` (doc_id, source and, at will, row) with ``rank``, that of each in its source (from 0), and the sources' counts.

    Rows without an id go by a hash of their whole row, where they carry it, and are
    spread at random otherwise: they are all alike then.
    """
    h = F.xxhash64(F.lit(6), "doc_id")
    carried = "row" in rows.columns
    tie = F.xxhash64("row") if carried else F.rand(6)
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(7), tie)).otherwise(h)
    keyed = rows.withColumn("h", spread)
    counts = keyed.groupBy("source").count().collect()
    bits = min(20, (max((r["count"] for r in counts), default=1) // RANGE_DOCS).bit_length())
    keyed = keyed.withColumn("part", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = keyed.groupBy("source", "part").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    order = ["h", "doc_id", *([F.xxhash64("row")] if carried else [])]
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy(*order))
    ranked = keyed.withColumn("own", own).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return ranked.select(*rows.columns, (F.col("own") - 1 + F.col("before")).alias("rank")), counts


def _placed(rows: DataFrame, weights: dict | None, block_docs: int) -> DataFrame:
    """``rows`` with their places in the schedule."""
    if block_docs < 1:
        raise ValueError("a block has one document at least")
    if weights is not None and any(int(w) != w or w < 0 for w in weights.values()):
        raise ValueError("weights are whole numbers, 0 or more")
    ranked, counts = _ranked(rows)
    sizes = {r["source"]: r["count"] for r in counts}
    table = phases({s: -(-n // block_docs) for s, n in sizes.items()}, default_weights(sizes) if weights is None else {s: int(w) for s, w in weights.items()})
    periods = rows.sparkSession.createDataFrame(table, SCHEDULE).withColumnRenamed("source", "__source")
    if sum(len(r[-1]) for r in table) <= BROADCAST_ENTRIES:
        periods = F.broadcast(periods)
    j = F.col("block") - F.col("j_from")
    blocked = ranked.withColumn("block", F.expr(f"rank div {int(block_docs)}"))
    joined = blocked.join(periods, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") >= F.col("j_from")) & (F.col("block") < F.col("j_to")))
    slot = F.col("start") + F.expr("(block - j_from) div share") * F.col("period") + F.element_at("places", (j % F.col("share") + 1).cast("int"))
    return joined.select(
        *rows.columns, F.col("rank").cast("long").alias("rank"), F.col("block").cast("long").alias("block"), "phase",
        (F.col("start") + F.expr("((block - j_from) * period) div share")).alias("release"),
        (F.col("start") + F.expr("((block - j_from + 1) * period + share - 1) div share")).alias("deadline"),
        slot.cast("long").alias("slot"), (slot * block_docs + F.col("rank") % block_docs).cast("long").alias("position"),
    )


def schedule(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(doc_id, source, rank, block, phase, release, deadline, slot, position)``.

    rank: of the document in its source; release, deadline and slot: of its block
    (counted over all phases; a deadline is the slot by whose begin it is served);
    position: of the document in the mixed order, without gaps in a block.
    """
    return _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")), weights, block_docs)


def mixed(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of ``docs`` in the mixed order, their columns as they were.

    Rows of one source take its places in the order of a hash of their ids, as in
    ``schedule``; those that tie there (null or repeated ids) in the order of a hash
    of the whole row, so that no task gets all of them.
    """
    # the row travels as one value, so its columns' names clash with none here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), whole.alias("row"))
    return _placed(rows, weights, block_docs).select("row", "position").sort("position").select("row.*")
