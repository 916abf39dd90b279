"""Exact removal of repeated passages by merged Burrows-Wheeler transforms (operator 5).

A passage is repeated when a window of ``LENGTH`` words occurs twice or more,
in one document or several. Which windows repeat is decided as follows.

1. Winnowing picks anchors: the word k-grams that are the least by hash in some
   window. Every window has one, the leftmost on a tie, picked from its own words
   alone, so all copies of a window agree in it.
2. Around an anchor that occurs twice or more stands a context, the words of the
   windows of which it is the least. Equal contexts are one string with a count. Where
   an anchor has one context only, that whole context repeats.
3. Anchors with several contexts go, by anchor, to shards. Each shard's
   transform comes from its own suffixes; the shards are merged by iterative
   refinement of their interleave: one pass a symbol, a stable distribution by
   the transforms' symbols through their LF mappings, without sorting the
   suffixes again. Where a pass first separates two neighbours is their common
   prefix; rows that stand alone can meet no other and leave the passes. After
   LENGTH passes the intervals that remain are the repeated windows.

The first occurrence of a window, by (doc_id, position), is the one that stays.

Definitions: words are split at ASCII white space, case counts; words are equal
where their 64-bit hashes are (two given words differ and meet with a chance of
1e-17 or so); rows with null text or null doc_id, and texts of fewer than LENGTH
words, hold no repeats; rows that repeat a doc_id count as one document; of windows
that tie, that is, have the same words, the first by (doc_id, position) stays; texts
of any length are taken whole; other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bytesvec import mix, ragged_ranges, slices, window_hash, words
from metaloom.llm.durable import durable, shuffle_width, tidy

LENGTH = 50
#: Words of an anchor. Longer ones bring fewer false meetings and more anchors.
ANCHOR = 16
#: Words merged at once; an anchor's contexts are never split.
CHUNK_WORDS = 250_000
SHARDS = 4


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i:i+width] for each i; shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors among all words, their hashes, and the first and
    last begin of the windows of which each is the (leftmost) least; these follow
    each other."""
    n = len(h)
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(n)
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    ok = at + k <= last
    if not ok.any():
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    gram[ok] = window_hash(h, at[ok], at[ok] + k)
    width = length - k + 1
    low = _slide(gram, width, np.minimum)
    low[at + length > last] = 0  # no whole window begins here
    high = _slide(low[::-1].copy(), width, np.maximum)[::-1]
    picked = np.flatnonzero((high == gram) & ok & (high > 0))
    value = gram[picked]
    first, last_begin = np.full(len(picked), n), np.full(len(picked), -1)
    for back in range(width):
        begin = picked - back
        mine = (begin >= 0) & (low[begin] == value)
        first[mine] = np.minimum(first[mine], begin[mine])
        last_begin[mine] = np.maximum(last_begin[mine], begin[mine])
    # of equal grams in a window the leftmost is its anchor, so a window has one
    tie = np.zeros(len(picked), bool)
    tie[1:] = (value[1:] == value[:-1]) & (picked[1:] - picked[:-1] < width)
    first[1:] = np.where(tie[1:], np.maximum(first[1:], picked[:-1] + 1), first[1:])
    some = first <= last_begin
    return picked[some], value[some], first[some], last_begin[some]


_ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "ch", "doc_id")] + [T.StructField(c, T.IntegerType()) for c in ("pos", "before", "size")])


def _context_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(window_hash(h, start, end) + before.astype(np.uint64)).view(np.int64)


def _anchor_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                w = words(s)
                at, gram, low, high = anchors(w.hash, w.bounds, length, k)
                row = w.row[at]
                pos = at - w.bounds[row]
                before = at - low
                end = high + length
                ch = _context_hash(w.hash, at - before, end, before)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(ch), batch.column(0).slice(s.first, s.rows).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (pos, before, end - at + before))],
                    names=_ROW.names,
                )

    return docs.mapInArrow(tidy(run), _ROW)


_CONTEXT = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "ch", "n", "doc_id")] + [T.StructField("pos", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("words", T.BinaryType())])


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The words (64-bit hashes) of each wanted context, read from its first occurrence."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "before", "size", "h", "ch", "n")).alias("wants"))
    joined = docs.join(lists, "doc_id").select("doc_id", "text", "wants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for s in slices(batch.column(1)):
                w = words(s)
                mine = lists.slice(s.first, s.rows)
                count = np.diff(mine.offsets.to_numpy())
                flat = mine.flatten()
                pos, before, size, h, ch, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                row = np.repeat(np.arange(s.rows), count)
                start = w.bounds[row] + pos - before
                inside = start + size <= w.bounds[row + 1]
                same = np.zeros(len(pos), bool)  # rows of one doc_id may hold different texts
                same[inside] = _context_hash(w.hash, start[inside], (start + size)[inside], before[inside]) == ch[inside]
                row, start, size, h, ch, n, pos, before = (x[same] for x in (row, start, size, h, ch, n, pos, before))
                texts = [w.hash[a:b].tobytes() for a, b in zip(start.tolist(), (start + size).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(ch), pa.array(n), batch.column(0).slice(s.first, s.rows).take(pa.array(row)), pa.array(pos), pa.array(before), pa.array(texts, pa.binary())],
                    names=_CONTEXT.names,
                )

    return joined.mapInArrow(tidy(run), _CONTEXT)


def shard_transform(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, Burrows-Wheeler transform and LF mapping of a shard's strings.

    String i is symbols[start[i]:end[i]], its last symbol a terminator 0; the
    strings follow each other without a gap. Suffixes are ordered to the given
    depth by doubling; each string is a cycle for the transform.
    """
    n = len(symbols)
    stop = np.repeat(end, end - start)
    at = np.arange(n)
    rank = symbols.astype(np.int64)
    reach = 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        after = np.zeros(n, np.int64)
        inside = at + reach < stop
        after[inside] = rank[at[inside] + reach] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        reach *= 2
        if n and rank[order[-1]] == n - 1:
            break
    before = at - 1
    before[start] = end - 1
    place = np.empty(n, np.int64)
    place[order] = at
    return order, symbols[before[order]], place[before[order]]


def merge_transforms(bwt: list[np.ndarray], lf: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave of several transforms ``depth`` times.

    Returns the rows (numbered through all shards) that share their first
    ``depth`` symbols with another row, in merged order; the number of the
    interval of each; and how many neighbours each pass first told apart, that
    is, a histogram of common prefixes.
    """
    first = np.cumsum([0, *map(len, bwt)])
    symbol = np.concatenate(bwt)
    if symbol.max(initial=0) < 1 << 16:
        symbol = symbol.astype(np.uint16)
    step = np.concatenate([x + f for x, f in zip(lf, first)]).astype(np.int32)
    rows = np.arange(len(symbol), dtype=np.int32)
    block = np.zeros(len(symbol), np.int32)
    prefixes = np.zeros(depth, np.int64)
    blocks = 1
    for h in range(depth):
        c = symbol[rows]
        order = np.argsort(c, kind="stable")
        c, source = c[order], block[order]
        rows = step[rows[order]]
        edge = np.ones(len(rows) + 1, bool)
        edge[1:-1] = (c[1:] != c[:-1]) | (source[1:] != source[:-1])
        prefixes[h] = int(edge[:-1].sum()) - blocks
        shared = ~(edge[:-1] & edge[1:])
        rows = rows[shared]
        block = (np.cumsum(edge[:-1], dtype=np.int32) - 1)[shared]
        blocks = int(edge[:-1][shared].sum())
        if not len(rows):
            break
    return rows, block, prefixes


def repeated_windows(lists: list[np.ndarray], weight: np.ndarray, doc: np.ndarray, begin: np.ndarray, length: int, shards: int = SHARDS) -> np.ndarray:
    """For each string: first and past-last word covered by repeated windows, by
    repeated windows that are not the first of their kind (for the string's own
    first occurrence, at document ``doc`` and word ``begin``), and by those that
    are; -1 where there is none. weight: occurrences of each string.
    """
    size = np.array([len(x) for x in lists], np.int64)
    stop = np.cumsum(size + 1)
    start = stop - size - 1
    spots = ragged_ranges(start, size)
    _, code = np.unique(np.concatenate(lists), return_inverse=True)
    symbols = np.zeros(int(stop[-1]), np.int32)
    symbols[spots] = code + 1
    parts = np.array_split(np.arange(len(lists)), min(shards, len(lists)))
    order, bwt, lf = [], [], []
    for p in parts:
        a, b = start[p[0]], stop[p[-1]]
        o, t, m = shard_transform(symbols[a:b], start[p] - a, stop[p] - a, length)
        order.append(o + a)
        bwt.append(t)
        lf.append(m)
    rows, block, _ = merge_transforms(bwt, lf, length)
    place = np.concatenate(order)[rows]
    text = np.searchsorted(stop, place, side="right")
    offset = place - start[text]
    whole = offset + length <= size[text]
    text, offset, block = text[whole], offset[whole], block[whole]
    # a string that stands for several occurrences repeats all its windows
    alone = np.flatnonzero(weight > 1)
    extra = np.maximum(size[alone] - length + 1, 0)
    t2, o2 = np.repeat(alone, extra), ragged_ranges(np.zeros(len(alone), np.int64), extra)
    have = text * (1 << 20) + offset
    new = ~np.isin(t2 * (1 << 20) + o2, have)
    t2, o2 = t2[new], o2[new]
    block = np.concatenate([block, np.arange(len(t2)) + (int(block.max(initial=-1)) + 1)])
    text, offset = np.concatenate([text, t2]), np.concatenate([offset, o2])
    out = np.full((len(lists), 6), -1, np.int64)
    if not len(text):
        return out
    rank = np.lexsort((begin[text] + offset, doc[text], block))
    lead = np.append(True, block[rank][1:] != block[rank][:-1])
    is_first = np.zeros(len(text), bool)
    group = np.cumsum(lead) - 1
    heads = rank[lead]
    is_first[rank] = (doc[text[rank]] == doc[text[heads]][group]) & ((begin[text] + offset)[rank] == (begin[text] + offset)[heads][group])
    for c, chosen in ((0, np.ones(len(text), bool)), (2, ~is_first), (4, is_first)):
        low = np.full(len(lists), 1 << 40, np.int64)
        high = np.full(len(lists), -1, np.int64)
        np.minimum.at(low, text[chosen], offset[chosen])
        np.maximum.at(high, text[chosen], offset[chosen])
        some = high >= 0
        # windows of one context overlap each other, so they cover one span
        out[some, c], out[some, c + 1] = low[some], high[some] + length
    return out


_FOUND = T.StructType([T.StructField("h", T.LongType()), T.StructField("ch", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("all_a", "all_b", "dup_a", "dup_b", "own_a", "own_b")])


def _merge(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Repeated parts of each context, relative to its anchor."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        h, ch, n, doc, pos, before = (t.column(i).to_numpy() for i in range(6))
        fresh = np.append(True, (h[1:] != h[:-1]) | (ch[1:] != ch[:-1]))
        raw = t.column(6).to_pylist()
        keep = np.flatnonzero(fresh)
        lists = [np.frombuffer(raw[i], np.uint64) for i in keep.tolist()]
        h, ch, n, doc, pos, before = (x[keep] for x in (h, ch, n, doc, pos, before))
        spans = repeated_windows(lists, n, doc, pos.astype(np.int64) - before, length)
        none = spans < 0
        spans = (spans - before[:, None]).astype(np.int32)
        some = np.flatnonzero(~none[:, 0])
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(ch[some]), *(pa.array(spans[some, i], mask=none[some, i]) for i in range(6))], names=_FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        load = 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            sizes = np.diff(batch.column(6).offsets.to_numpy() if hasattr(batch.column(6), "offsets") else np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset : batch.column(6).offset + len(batch) + 1]) // 8 + 1
            at = 0
            edges = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            done = np.concatenate([[0], np.cumsum(sizes)])
            last = held[-1].column(0)[-1].as_py() if held else None
            for e in edges.tolist():
                if load + done[e] - done[at] >= CHUNK_WORDS and h[e] != last:
                    if e > at:
                        held.append(batch.slice(at, e - at))
                    if held:
                        yield solve(held)
                    held, load, at = [], 0, e
                last = h[e]
            if len(h) > at:
                held.append(batch.slice(at))
                load += int(done[-1] - done[at])
        if held:
            yield solve(held)

    return contexts.repartition(width, "h").sortWithinPartitions("h", "ch").mapInArrow(tidy(run), _FOUND)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, start_word, end_word, is_first)``: the longest runs of words that
    repeated windows cover. is_first: covered by the first occurrence of windows
    that come again later; otherwise by later occurrences. A word can be in both.
    """
    if not 1 <= anchor <= length:
        raise ValueError("the anchor has between 1 word and the length")
    width = shuffle_width(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    by_anchor = Window.partitionBy("h")
    # rows of one partitioning serve the distinct, the count and the contexts' groups
    rows = _anchor_rows(texts, length, anchor).repartition(width, "h").dropDuplicates(["h", "ch", "doc_id", "pos"])
    rows = durable(rows.withColumn("c", F.count("*").over(by_anchor)).filter("c > 1").drop("c"))
    kinds = rows.groupBy("h", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"), F.first("before").alias("before"), F.first("size").alias("size"))
    kinds = durable(kinds.withColumn("kinds", F.count("*").over(by_anchor)).select("h", "ch", "n", "first.doc_id", "first.pos", "before", "size", "kinds"))
    several = _contexts(texts, kinds.filter("kinds > 1"), length)
    none = F.lit(None).cast("int")
    whole = (-F.col("before")).cast("int"), (F.col("size") - F.col("before")).cast("int")
    single = kinds.filter("kinds = 1").select("h", "ch", whole[0].alias("all_a"), whole[1].alias("all_b"), none.alias("dup_a"), none.alias("dup_b"), whole[0].alias("own_a"), whole[1].alias("own_b"))
    found = _merge(several, length, width).unionByName(single)
    heads = kinds.select("h", "ch", F.col("doc_id").alias("first_doc"), F.col("pos").alias("first_pos"))
    seen = rows.select("h", "ch", "doc_id", "pos").join(heads, ["h", "ch"]).join(found, ["h", "ch"])
    head = (F.col("doc_id") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))
    spans = seen.select(
        "doc_id",
        F.explode(
            F.when(head, F.array(F.struct((F.col("pos") + F.col("dup_a")).alias("a"), (F.col("pos") + F.col("dup_b")).alias("b"), F.lit(False).alias("is_first")), F.struct((F.col("pos") + F.col("own_a")).alias("a"), (F.col("pos") + F.col("own_b")).alias("b"), F.lit(True).alias("is_first")))).otherwise(
                F.array(F.struct((F.col("pos") + F.col("all_a")).alias("a"), (F.col("pos") + F.col("all_b")).alias("b"), F.lit(False).alias("is_first")))
            )
        ).alias("s"),
    ).select("doc_id", "s.a", "s.b", "s.is_first").filter("a IS NOT NULL")
    order = Window.partitionBy("doc_id", "is_first").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "is_first", "island").agg(F.min("a").cast("long").alias("start_word"), F.max("b").cast("long").alias("end_word")).select("doc_id", "start_word", "end_word", "is_first")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Documents without the later occurrences of repeated passages.

    The words of such spans go with the white space after them; ``n_chars``, where
    there is such a column, is counted anew for texts that change. A document
    whose words all go is left out. All others keep every column as it was.
    """
    spans = repeated_spans(docs, length, anchor).filter("NOT is_first").groupBy(F.col("doc_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    # the row travels as one value, so its columns' names clash with none here
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    columns = docs.columns
    inner = [f"c{i}" for i in range(len(columns))]
    joined = rows.join(spans, F.col("key") == F.col("doc"), "left").select(*[F.col("row").getField(c).alias(i) for c, i in zip(columns, inner)], "spans")
    at, counted = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            lists = batch.column(len(columns))
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            arrays = [batch.column(i) for i in range(len(columns))]
            keep = np.ones(len(batch), bool)
            if len(hit):
                texts, counts = [], []
                for s in slices(batch.column(at).take(pa.array(hit))):
                    w = words(s, hashed=False)
                    for r in range(s.rows):
                        lo, hi = w.bounds[r], w.bounds[r + 1]
                        gone = np.zeros(hi - lo, bool)
                        for x in lists[int(hit[s.first + r])].as_py():
                            gone[x["start_word"] : x["end_word"]] = True
                        begin, end = s.offsets[r], s.offsets[r + 1]
                        head = np.append(w.start[lo:hi], end)
                        kept = [s.data[begin : head[0]]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
                        kept += [s.data[head[a] : head[b]] for a, b in zip(edge[::2], edge[1::2])]
                        texts.append(np.concatenate(kept).tobytes().decode("utf-8", "replace"))
                        counts.append(len(texts[-1]))
                        keep[hit[s.first + r]] = not gone.all()
                changed = pa.array(np.isin(np.arange(len(batch)), hit))
                arrays[at] = pc.replace_with_mask(arrays[at], changed, pa.array(texts, arrays[at].type))
                if counted is not None:
                    arrays[counted] = pc.replace_with_mask(arrays[counted], changed, pa.array(counts, arrays[counted].type))
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    return joined.mapInArrow(tidy(run), docs.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS (
  SELECT doc_id, p, array_to_string(w[p + 1 : p + 50], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) = 1 AS is_first, count(*) OVER (PARTITION BY s) AS c FROM g
), e AS (
  SELECT doc_id, p, is_first, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, is_first ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM r WHERE c > 1
), i AS (
  SELECT doc_id, p, is_first, sum(fresh) OVER (PARTITION BY doc_id, is_first ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM e
)
SELECT doc_id, min(p)::BIGINT AS start_word, (max(p) + 50)::BIGINT AS end_word, is_first
FROM i GROUP BY doc_id, is_first, island
"""
