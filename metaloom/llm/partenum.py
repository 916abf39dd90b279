"""N-gram Jaccard join with PartEnum signatures (operator 9).

A document's features are its distinct word n-grams (54-bit hashes; a text of 500
n-grams has two that meet in one hash with a chance of 1e-11). Words are compared in
lower case and without punctuation at their edges (a word of nothing else stays as
it is), so that ordinary edits don't count as other words.

Two feature sets with Jaccard similarity of at least t differ in at most
k = (1-t)/(1+t) * (|r|+|s|) features. Sizes fall in bands of ratio 1/t, so such a
pair lies in one band or two neighbouring ones; instance j of the scheme serves the
pairs within band j-1 and those between j-1 and j. An instance cuts the feature
domain by hash into n1 groups of n2 = 2 parts; a group that differs in at most one
feature has a part that is the same in both sets. The content of a part, that is, of
a subset of its group's parts, is a signature, and a pair shares all but k of the
2 * n1 at least.

A signature of few, frequent features would be shared by very many sets. Each
therefore has an information content, the sum of log2(documents / document
frequency) of its features, which depends on the content alone. A set sends its
k + 1 + c most informative signatures (ties go by hash), with the k of its own size:
all but k are shared with a similar set. Of two sets, the one whose least sent
signature is the more informative has c + 1 among them that both contain, and the
other, whose bar is lower, sends these too: the join stays exact whatever the
frequencies are. They come from a hashed count over all documents (of a fixed size;
it can only overestimate). c is 0 for small sets and grows with the instance.

Sets that meet in a signature are candidates. Those of a small gathering are listed
as pairs with their number of meetings, and what stays below the c + 1 of its
instance goes before any text is sent; a listed pair is compared by itself. A larger
gathering is listed as edges to its least member, its hub. All sets at one hub are
compared with each other, which covers every pair of a gathering without listing it
once a signature. Hubs that share members are one task; a task of more than
``TASK_FEATURES`` or ``TASK_SETS`` is cut into blocks and each pair of blocks is a
task of its own, so no task holds more. A pair that meets at several hubs counts at
the least of them only, which is found by bits of their hubs for many pairs at once. Tasks return, for each set,
how many documents it is linked with and one set that it hangs together with: pairs
are never written.

Where only classes are asked for and no links (``duplicates``), the domain is cut as
fine as it goes: a part is one feature. Then only features that a set has and its
partner lacks take parts from it, (1 - t) * |r| at most, or (1-t)/(1+t) * 2 * |r| if the
partner is not smaller; so a set sends the (1 - t) * |r| + 1 + c most informative
features, and those that only a smaller set may meet are marked. One list serves
partners of all sizes. (For parts of one feature, the argument is that of prefix
filters.) c is the smaller one of the two sets. Tasks then compare only what does not
hang together already.

Documents with equal feature sets are one set (128 bits of hash: a set id of 64 that
is checked against another 64, and salted anew should two sets meet in it).

Definitions: words are split at ASCII white space; a text of fewer than n words has
its whole word sequence as its one feature; a null text and a text without words
have no links; rows of null doc_id take no part; rows that repeat a doc_id with the
same features count once, and a doc_id with several texts is one document that has
the links of each of them; texts of any length are taken whole; pairs exactly at the
threshold are links; a class is named by its least doc_id; other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bytesvec import Slice, Words, column_bytes, mix, ragged_ranges, slices, span_hash, united, words
from metaloom.llm.durable import durable, shuffle_width, tidy

#: Words of an n-gram, and the threshold; the README gives the recall on edited copies by which it was chosen.
N, THRESHOLD = 3, 0.6
#: Counters of the document-frequency sketch, and the pieces that they travel in (cost only).
SKETCH_BITS, PIECES = 21, 64
#: The same counters for the finest cut: with many features a counter, the order of rare ones is chance (cost only).
FINE_BITS = 25
#: Parts of a group; groups beyond the k/2 + 1 that the argument needs, as a share (cost only).
PARTS, SPARE = 2, 1.4
#: Groups of any instance beyond these: parts without features are the same in all sets, so none should be among those sent (cost only).
MORE = 64
_BITS = 54
#: Sets up to which a signature's pairs are listed one by one (cost only).
GATHERING = 128
#: (differences from which on, c): meetings that a similar pair has beyond one (cost only).
#: c + 1 divides _MET, the sum that a listed pair needs when each meeting counts _MET / (c + 1).
SURPLUS = ((0, 0), (12, 2), (64, 5), (160, 11))
_MET = 12
#: What a meeting in a larger gathering counts.
_STAR = 1 << 20
#: Signatures that a worker packs at once, features and sets that a task holds, features compared at once (cost only).
_FLUSH, TASK_FEATURES, TASK_SETS, BATCH_FEATURES = 800_000, 8_000_000, 4096, 1_000_000
#: Features that a worker counts before it packs their counters (cost only).
_COUNTED = 2_000_000
#: zstandard level of what travels (cost only).
LEVEL = 3


class Bands:
    """Size bands and the parameters of the instance that serves each."""

    def __init__(self, threshold: float, largest: int):
        self.threshold = threshold
        lows = [1]
        while lows[-1] <= largest:
            lows.append(int(np.floor(lows[-1] / threshold + 1e-9)) + 1)
        lows.append(int(np.floor(lows[-1] / threshold + 1e-9)) + 1)
        self.low = np.array(lows, dtype=np.int64)
        self.top = np.append(self.low[1:], int(np.floor(self.low[-1] / threshold + 1e-9)) + 1) - 1
        most = self.differences(2 * self.top)
        #: of each instance, its place in SURPLUS and its c
        self.kind = np.searchsorted([k for k, _ in SURPLUS], most, side="right") - 1
        self.surplus = np.array([c for _, c in SURPLUS])[self.kind]
        need = (most + self.surplus) // 2 + 1
        self.groups = need + np.ceil(need * SPARE).astype(np.int64) + MORE

    def differences(self, total: np.ndarray) -> np.ndarray:
        """Most features in which a similar pair of so many features in all differs."""
        return np.floor((1 - self.threshold) / (1 + self.threshold) * total + 1e-9).astype(np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def partner(self, size: np.ndarray, up: int) -> np.ndarray:
        """Largest size of a set that one of this size must meet in its own band's
        instance, where all partners are of the band below, or in the next, where
        they are of its own band or the one above."""
        j = self.of(size)
        return self.low[j] - 1 if not up else np.minimum(np.floor(size / self.threshold + 1e-9).astype(np.int64), self.top[j + 1])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_MARKS = np.zeros(256, dtype=bool)
_ASCII_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LATIN_MARKS = np.zeros(256, dtype=bool)
_LATIN_MARKS[[0xA1, 0xA7, 0xAB, 0xB6, 0xB7, 0xBB, 0xBF]] = True


def _lower(s: Slice) -> Slice:
    """The rows in lower case; one that is no UTF-8 only in its ASCII letters."""
    if not len(s.data):
        return s
    upper = (s.data >= 65) & (s.data <= 90)
    plain = s.data + (upper.astype(np.uint8) << 5)
    if s.data.max() < 128:
        return Slice(s.first, plain, s.offsets)
    column = pa.Array.from_buffers(pa.large_string(), s.rows, [None, pa.py_buffer(np.ascontiguousarray(s.offsets)), pa.py_buffer(np.ascontiguousarray(s.data))])
    try:
        return Slice(s.first, *column_bytes(pa.compute.utf8_lower(column)))
    except pa.ArrowInvalid:
        if s.rows == 1:
            return Slice(s.first, plain, s.offsets)
    each = [_lower(Slice(0, s.data[a:b], np.array([0, b - a]))).data for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist())]
    return Slice(s.first, np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64))


def _marks(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to punctuation: ASCII, Latin-1, general (U+2010 to U+203E) and CJK (U+3001 to U+3011)."""
    out = _ASCII_MARKS[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[_LATIN_MARKS[data[two + 1]]]
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x90) & (data[2:] <= 0xBE))
    wide = np.flatnonzero((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] >= 0x81) & (data[2:] <= 0x91))
    for at, n in ((two, 2), (three, 3), (wide, 3)):
        for i in range(n):
            out[at + i] = True
    return out


def normal_words(s: Slice) -> Words:
    """Words of every row in lower case and without punctuation at their edges."""
    s = _lower(s)
    w = words(s, hashed=False)
    mark = _marks(s.data)
    start, end = w.start.copy(), w.end.copy()
    at = np.flatnonzero(mark[start] | mark[end - 1])
    if len(at):
        kept = np.flatnonzero(~mark & ~_SPACE[s.data])
        first, after = np.searchsorted(kept, start[at]), np.searchsorted(kept, end[at])
        some = after > first
        at, first, after = at[some], first[some], after[some]
        start[at], end[at] = kept[first], kept[after - 1] + 1
    return Words(start, end, w.row, span_hash(s.data, start, end), w.bounds)


class Sets:
    """Distinct features of the rows of a slice: sorted, with row bounds and set ids."""

    def __init__(self, s: Slice, n: int, salt: int = 0):
        w = normal_words(s)
        count = np.diff(w.bounds)
        grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        start = ragged_ranges(w.bounds[:-1], grams)
        row = np.repeat(np.arange(s.rows), grams)
        # whole n-grams word by word; the one of a shorter text with its length
        h = np.zeros(len(start), np.uint64)
        last = w.bounds[1:][row] - 1
        for i in range(n):
            h = mix(h * np.uint64(3) + w.hash[np.minimum(start + i, last)])
        short = np.flatnonzero(count[row] < n)
        h[short] = mix(h[short] ^ mix(count[row[short]].astype(np.uint64)))
        key = np.sort((row.astype(np.uint64) << np.uint64(_BITS)) | (h >> np.uint64(64 - _BITS)))
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        self.row = (key >> np.uint64(_BITS)).astype(np.int64)
        self.feature = key & np.uint64((1 << _BITS) - 1)
        self.bounds = np.searchsorted(self.row, np.arange(s.rows + 1))
        self.size = np.diff(self.bounds)
        self.mixed = mix(self.feature + np.uint64(1))
        self.set_id = self._sum(2 * salt + 1)
        self.check = self._sum(2 * salt + 2)

    def _sum(self, salt: int) -> np.ndarray:
        acc = np.zeros(len(self.mixed) + 1, np.uint64)
        np.cumsum(mix(self.mixed + np.uint64(salt)), out=acc[1:])
        return mix((acc[self.bounds[1:]] - acc[self.bounds[:-1]]) + self.size.astype(np.uint64)).view(np.int64)


def _small(s: Slice) -> Iterator[Slice]:
    """Pieces of so many rows that a row number fits beside a feature."""
    step = 1 << (64 - _BITS)
    for at in range(0, s.rows, step):
        o = s.offsets[at : at + step + 1]
        yield Slice(s.first + at, s.data[o[0] : o[-1]], o - o[0])


def information(sketch: np.ndarray, total: int) -> np.ndarray:
    """Information of a feature in 1/16 bit for each counter of the sketch."""
    return np.rint(16 * np.log2(max(total, 1) / np.clip(sketch, 1, max(total, 1)))).astype(np.int64)


def signatures(sets: Sets, bands: Bands, info: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that the (given) rows' sets send, and the row of each. The two
    lowest bits are the place of the instance in SURPLUS."""
    chosen = np.flatnonzero(sets.size > 0) if rows is None else rows
    size = sets.size[chosen]
    at = ragged_ranges(sets.bounds[chosen], size)
    mixed = sets.mixed[at]
    bits = info[(mixed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    which = np.repeat(np.arange(len(chosen)), size)
    sigs, owners = [], []
    for up in (0, 1):
        inst = bands.of(size) + up
        sent = bands.differences(size + bands.partner(size, up)) + 1 + bands.surplus[inst]
        parts = PARTS * bands.groups[inst]
        base = np.cumsum(parts) - parts
        salted = mix(mixed ^ mix(inst.astype(np.uint64) + np.uint64(977))[which])
        cell = base[which] + (((salted >> np.uint64(32)) * parts[which].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(content, cell, salted)
        worth = np.zeros(len(content), np.uint64)
        np.add.at(worth, cell, bits)
        owner = np.repeat(np.arange(len(chosen)), parts)
        place = np.arange(len(owner)) - base[owner]
        sig = mix(content + mix((place.astype(np.uint64) << np.uint64(20)) + inst[owner].astype(np.uint64)))
        rank = (np.minimum(worth, np.uint64((1 << 20) - 1)) << np.uint64(34)) | (sig >> np.uint64(30))
        # in each owner the most informative first
        order = np.argsort(~rank & np.uint64((1 << 54) - 1) | (owner.astype(np.uint64) << np.uint64(54)))
        sig = (sig[order] & ~np.uint64(3)) | bands.kind[inst][owner].astype(np.uint64)
        # what travels is the lower half; where two of a set's are the same there, it sends more
        low = (owner.astype(np.uint64) << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF))
        kept = np.sort(low[place < sent[owner]])
        for o in np.unique(kept[1:][kept[1:] == kept[:-1]] >> np.uint64(32)).astype(np.int64).tolist():
            own = low[base[o] : base[o] + parts[o]]
            _, first = np.unique(own, return_index=True)
            sent[o] = np.sort(first)[sent[o] - 1] + 1 if len(first) >= sent[o] else parts[o]
        keep = place < sent[owner]
        sigs.append(sig[keep])
        owners.append(chosen[owner[keep]])
    return np.concatenate(sigs), np.concatenate(owners)


def fine_signatures(sets: Sets, threshold: float, info: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same for the finest cut, where a part is one feature. The lowest bit says
    whether a larger set may meet this one here, the next two are the place in SURPLUS."""
    chosen = np.flatnonzero(sets.size > 0) if rows is None else rows
    size = sets.size[chosen]
    mixed = sets.mixed[ragged_ranges(sets.bounds[chosen], size)]
    bits = info[(mixed >> np.uint64(64 - FINE_BITS)).astype(np.int64)].astype(np.uint64)
    which = np.repeat(np.arange(len(chosen), dtype=np.uint64), size)
    # in each owner the most informative first; what is left of the feature is its signature
    key = np.sort((which << np.uint64(54)) | (np.uint64(1023) - np.minimum(bits, np.uint64(1023)) << np.uint64(44)) | (mixed >> np.uint64(20)))
    owner = (key >> np.uint64(54)).astype(np.int64)
    hashed = mix(key & np.uint64((1 << 44) - 1))
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    most = np.floor((1 - threshold) / (1 + threshold) * 2 * size + 1e-9)
    kind = np.zeros(len(size), np.int64)
    for place, (begin, c) in enumerate(SURPLUS):
        kind[(most >= begin) & (least > c)] = place
    surplus = np.array([c for _, c in SURPLUS])[kind]
    sent = size - least + 1 + surplus
    met = size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + 1 + surplus
    # what travels is the lower half; where two of a set's are the same there, it sends all
    place = np.arange(len(key)) - (np.cumsum(size) - size)[owner]
    low = np.sort(((owner.astype(np.uint64) << np.uint64(29)) | (hashed & np.uint64((1 << 29) - 1)))[place < sent[owner]])
    again = (low[1:][low[1:] == low[:-1]] >> np.uint64(29)).astype(np.int64)
    sent[again], met[again] = size[again], size[again]
    keep = place < sent[owner]
    owner, place, hashed = owner[keep], place[keep], hashed[keep]
    upper, key = hashed >> np.uint64(32) << np.uint64(32), (hashed & np.uint64((1 << 29) - 1)) << np.uint64(3)
    return upper | key | (kind[owner] * 2 + (place < met[owner])).astype(np.uint64), chosen[owner]


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _BINARY = T.LongType(), T.IntegerType(), T.BinaryType()
_MEMBER = _schema(doc_id=_LONG, set_id=_LONG, check=_LONG, size=_LONG, piece=_INT, counts=_BINARY)
_BLOB = _schema(bucket=_INT, sigs=_BINARY, at=_BINARY, ids=_BINARY)
_EDGE = _schema(a=_LONG, b=_LONG, met=_INT)


def _packed(counters: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Counters that features fall on: in order, as differences, piece by piece."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    at = np.sort(np.concatenate(counters))
    each = np.uint32((1 << FINE_BITS) // PIECES)
    cut = np.searchsorted(at, np.arange(PIECES + 1, dtype=np.uint32) * each)
    for piece in np.flatnonzero(np.diff(cut)).tolist():
        step = np.diff(at[cut[piece] : cut[piece + 1]], prepend=np.uint32(piece) * each)
        yield piece, press.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes())


def _members(docs: DataFrame, n: int, salt: int, fine: bool = False) -> DataFrame:
    """Set of each document, and each task's pieces of the frequency sketch."""

    def piecewise(got: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
        number, raw = zip(*got)
        none = [pa.nulls(len(number), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*none, pa.array(number, pa.int32()), pa.array(raw, pa.binary())], names=_MEMBER.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(0 if fine else 1 << SKETCH_BITS, np.int32)
        counters, held = [], 0
        for batch in batches:
            for whole in slices(batch.column(1)):
                for s in _small(whole):
                    sets = Sets(s, n, salt)
                    some = np.flatnonzero(sets.size > 0)
                    if fine:
                        counters.append((sets.mixed >> np.uint64(64 - FINE_BITS)).astype(np.uint32))
                        held += len(counters[-1])
                    else:
                        np.add.at(sketch, (sets.mixed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                    if held >= _COUNTED:
                        yield piecewise(_packed(counters))
                        counters, held = [], 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(s.first, s.rows).take(pa.array(some)),
                            *(pa.array(x[some]) for x in (sets.set_id, sets.check, sets.size)),
                            pa.nulls(len(some), pa.int32()),
                            pa.nulls(len(some), pa.binary()),
                        ],
                        names=_MEMBER.names,
                    )
        if held:
            yield piecewise(_packed(counters))
        if sketch.any():
            yield piecewise((i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(sketch, PIECES)))

    return docs.mapInArrow(tidy(run), _MEMBER)


def _sketch(seen: DataFrame) -> np.ndarray:
    """The tasks' sketches added up, piece by piece on the executors."""
    schema = _schema(piece=_INT, counts=_BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(raw.as_buffer()), np.int32).astype(np.int64)
                sums[piece] = sums[piece] + x if piece in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=schema.names)

    out = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.int64)
    for r in seen.filter("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(tidy(run), schema).collect():
        out[r.piece] += np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out.ravel()


def _fine_information(seen: DataFrame, total: int) -> np.ndarray:
    """Information of a feature in 1/8 bit for each counter, worked out piece by piece on the executors."""
    schema = _schema(piece=_INT, bits=_BINARY)
    width = (1 << FINE_BITS) // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                planes = np.frombuffer(open_.decompress(raw.as_buffer()), np.uint8).reshape(4, -1)
                at = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
                sums.setdefault(piece, np.zeros(width, np.int64))
                sums[piece] += np.bincount(at, minlength=width)
        bits = [np.rint(8 * np.log2(max(total, 1) / np.clip(x, 1, max(total, 1)))).clip(0, 255).astype(np.uint8) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in bits], pa.binary())], names=schema.names)

    out = np.zeros((PIECES, width), np.uint8)
    for r in seen.filter("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(tidy(run), schema).collect():
        out[r.piece] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out.ravel()


#: Bits by which a set goes in the search for candidates, 40 at most (cost only).
SHORT_BITS = 40


def _pack(sig: np.ndarray, sid: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Signatures by bucket, 32 bits each, sorted and as differences, byte by byte.
    Sets: 40 bits each, or a number into their list where that is shorter."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    bucket = (sig >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort((bucket << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF)))
    bucket, sig, sid = bucket[order], sig[order].astype(np.uint32), sid[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    out: list[list] = [[], [], [], []]
    for b in np.flatnonzero(np.diff(cut)).tolist():
        x, y = sig[cut[b] : cut[b + 1]], sid[cut[b] : cut[b + 1]]
        own, at = np.unique(y, return_inverse=True)
        if len(own) <= 65536 and 5 * len(own) + 2 * len(y) < 5 * len(y):
            number = at.astype(np.uint16).tobytes()
        else:
            own, number = y, b""
        step = np.diff(x, prepend=np.uint32(0))
        planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T)
        wide = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :5])
        for c, v in zip(out, (b, press.compress(planes.tobytes()), number, wide.tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=_BLOB.names)


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    for sigs, at, ids in zip(*(batch.column(c) for c in ("sigs", "at", "ids"))):
        planes = np.frombuffer(open_.decompress(sigs.as_buffer()), np.uint8).reshape(4, -1)
        x = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
        wide = np.frombuffer(ids.as_buffer(), np.uint8).reshape(-1, 5)
        own = np.zeros((len(wide), 8), np.uint8)
        own[:, :5] = wide
        own = own.view(np.uint64).ravel()
        i = np.frombuffer(at.as_buffer(), np.uint16)
        yield x, own[i] if len(i) else own


def _blobs(docs: DataFrame, n: int, salt: int, send: Callable[[Sets, np.ndarray, np.ndarray], tuple], info: np.ndarray, buckets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(info)
    cut = 64 - SHORT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, held = [], [], 0
        seen: set[int] = set()  # the sets of this packing; copies send nothing
        for batch in batches:
            for whole in slices(batch.column(1)):
                for s in _small(whole):
                    sets = Sets(s, n, salt)
                    _, first = np.unique(sets.set_id, return_index=True)
                    new = np.array([i for i in first.tolist() if sets.size[i] and int(sets.set_id[i]) not in seen], np.int64)
                    seen.update(sets.set_id[new].tolist())
                    sig, row = send(sets, shared.value, new)
                    sigs.append(sig)
                    ids.append(sets.set_id[row].view(np.uint64) >> np.uint64(cut))
                    held += len(sig)
                    if held >= _FLUSH:
                        yield _pack(np.concatenate(sigs), np.concatenate(ids), buckets)
                        sigs, ids, held = [], [], 0
                        seen.clear()
        if held:
            yield _pack(np.concatenate(sigs), np.concatenate(ids), buckets)

    return docs.mapInArrow(tidy(run), _BLOB)


def _run_pairs(sig: np.ndarray, ids: np.ndarray, fine: bool = False, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of ids that share a key and what the meeting counts, some at a time: all
    of a small gathering, those with the least id of a larger one, which count _STAR.
    fine: signatures of the finest cut; one of two that meet must be there for larger sets."""
    order = np.argsort(sig, kind="stable")
    sig, ids = sig[order], ids[order]
    key = sig >> np.uint32(3) if fine else sig
    if len(key):  # what stands alone goes first, the rest is sorted in full
        edge = np.append(True, key[1:] != key[:-1])
        shared = ~(edge & np.append(edge[1:], True))
        sig, key, ids = sig[shared], key[shared], ids[shared]
        order = np.lexsort((ids, key))
        sig, key, ids = sig[order], key[order], ids[order]
    if len(key):
        fresh = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        sig, key, ids = sig[fresh], key[fresh], ids[fresh]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    place = (sig >> np.uint32(1) & np.uint32(3) if fine else sig & np.uint32(3)).astype(np.int64)
    small = (sig & np.uint32(1)).astype(bool) | (not fine)
    if len(key):
        some = np.logical_or.reduceat(small, start)
        start, size = start[some], size[some]
    large = size > GATHERING
    rest = size[large] - 1
    hub = np.repeat(ids[start[large]], rest), ids[ragged_ranges(start[large] + 1, rest)]
    for at in range(0, len(hub[0]), chunk):
        a, b = hub[0][at : at + chunk], hub[1][at : at + chunk]
        yield a, b, np.full(len(a), _STAR)
    start, size = start[~large & (size > 1)], size[~large & (size > 1)]
    counts = (_MET // (np.array([c for _, c in SURPLUS]) + 1))[place]
    # the i-th member of a run meets those after it
    first = ragged_ranges(start, size)
    after = np.repeat(start + size, size) - first - 1
    todo = np.cumsum(after)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + chunk, side="right")))
        x, y = np.repeat(first[at:to], after[at:to]), ragged_ranges(first[at:to] + 1, after[at:to])
        meet = small[x] | small[y]
        x, y = x[meet], y[meet]
        yield ids[x], ids[y], np.maximum(counts[x], counts[y])
        at = to


def _candidates(blobs: DataFrame, width: int, fine: bool = False) -> DataFrame:
    """``(a, b, met)`` of sets that share a signature, by their short ids; a bucket is solved by itself."""

    def solve(got: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b, met in _run_pairs(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]), fine):
            order = np.lexsort((b, a))
            a, b, met = a[order], b[order], met[order]
            fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            total = np.minimum(np.add.reduceat(met, fresh), _STAR if met[0] == _STAR else _MET) if len(a) else met
            yield pa.RecordBatch.from_arrays([pa.array(a[fresh].view(np.int64)), pa.array(b[fresh].view(np.int64)), pa.array(total.astype(np.int32))], names=_EDGE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, bucket = [], None
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket and got:
                    yield from solve(got)
                    got = []
                bucket = b
                got += _unpack(batch.slice(i, 1))
        if got:
            yield from solve(got)

    return blobs.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), _EDGE)


def _named(met: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, wide)``: candidates with enough meetings, by their set ids; wide: b is
    compared with all that meet at a, not with a alone. Sets that share a short id are
    candidates as well."""
    short = F.shiftrightunsigned("set_id", 64 - SHORT_BITS)
    one, two = (sets.select(short.alias(f"short_{x}"), F.col("set_id").alias(f"set_{x}")) for x in "ab")
    same = sets.groupBy(short.alias("a")).agg(F.count("*").alias("c")).filter("c > 1").select("a", F.col("a").alias("b"), F.lit(True).alias("wide"))
    asked = met.groupBy("a", "b").agg(F.sum("met").alias("met")).filter(F.col("met") >= _MET).select("a", "b", (F.col("met") >= _STAR).alias("wide")).unionByName(same)
    # where a short id stands for several sets, each of them is a hub of what the id meets
    joined = asked.join(one, F.col("a") == F.col("short_a")).join(two, F.col("b") == F.col("short_b"))
    return joined.filter("set_a <> set_b AND (a <> b OR set_a < set_b)").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "wide")


def _compressed(docs: DataFrame) -> DataFrame:
    """``(doc_id, z)``: texts as zstandard frames, which are smaller than their features."""
    schema = _schema(doc_id=_LONG, z=_BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t.as_buffer()) for t in batch.column(1)], pa.binary())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def overlaps(features: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """Common features of set pairs (a[i], b[i]); features: sorted in each set."""
    _, code = np.unique(features, return_inverse=True)
    n = int(code.max()) + 1 if len(code) else 1
    size = np.diff(bounds)
    key = np.repeat(np.arange(len(size), dtype=np.int64), size) * n + code
    out = np.zeros(len(a), np.int64)
    small = np.where(size[a] <= size[b], a, b)
    large = np.where(size[a] <= size[b], b, a)
    todo = np.cumsum(size[small])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + chunk, side="right")))
        lens = size[small[at:to]]
        own = code[ragged_ranges(bounds[small[at:to]], lens)]
        ask = np.repeat(large[at:to] * n, lens) + own
        place = np.searchsorted(key, ask)
        hit = key[np.minimum(place, len(key) - 1)] == ask
        out[at:to] = np.add.reduceat(hit, np.cumsum(lens) - lens) if len(hit) else 0
        at = to
    return out


def gathered(features: np.ndarray, bounds: np.ndarray, members: np.ndarray, threshold: float, group: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs among the members at or above the threshold, by blocks of products. With
    group, only pairs between groups: it says the group of each set as known so far."""
    size = np.diff(bounds)[members]
    members, size = members[np.argsort(size, kind="stable")], np.sort(size)
    flat = features[ragged_ranges(bounds[members], size)]
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row = np.repeat(np.arange(len(members)), size)[shared]
    _, code = np.unique(code[shared], return_inverse=True)
    width = int(code.max(initial=-1)) + 1
    step = int(np.clip(6_000_000 // max(width, 1), 16, 1024))
    cut = np.searchsorted(row, np.arange(0, len(members) + step, step))

    def block(i: int) -> np.ndarray:
        m = np.zeros((min(step, len(members) - i * step), width), np.float32)
        m[row[cut[i] : cut[i + 1]] - i * step, code[cut[i] : cut[i + 1]]] = 1
        return m

    blocks = -(-len(members) // step)
    for i in range(blocks):
        x, sx = block(i), size[i * step : (i + 1) * step]
        for j in range(i, blocks):
            sy = size[j * step : (j + 1) * step]
            if sy[0] * threshold > sx[-1] + 1e-9:
                break
            jobs = [(np.arange(len(sx)), np.arange(len(sy)))]
            if group:
                g = group()
                gx, gy = g[members[i * step : (i + 1) * step]], g[members[j * step : (j + 1) * step]]
                labels, times = np.unique(np.append(gx, gy), return_counts=True)
                most = labels[np.argmax(times)]
                jobs = [(np.flatnonzero(gx != most), jobs[0][1]), (np.flatnonzero(gx == most), np.flatnonzero(gy != most))][: 1 + (i < j)]
            jobs = [(a, b) for a, b in jobs if len(a) and len(b)]
            y = x if j == i or not jobs else block(j)
            for a, b in jobs:
                common = np.rint(x[a] @ y[b].T).astype(np.int64)
                jaccard = common / np.maximum(sx[a][:, None] + sy[b][None, :] - common, 1)
                p, q = np.nonzero(jaccard >= threshold - 1e-12)
                p, q = a[p], b[q]
                if i == j and not group:
                    p, q = p[p < q], q[p < q]
                yield members[i * step + p], members[j * step + q]


_LINK = _schema(set_id=_LONG, links=_LONG, other=_LONG)
#: Sets that hang together by hubs up to which their pairs are listed rather than found by products (cost only).
_LISTED = 24


def _found(keys: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Which of ask are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, ask), len(keys) - 1)] == ask if len(keys) else np.zeros(len(ask), bool)


class _Meetings:
    """At which hub two rows meet first. A row has wide hubs, where it meets all that
    have the hub as a wide one, and others, where it meets the hub itself only. Hubs
    are numbered in the order of their ids; ``none`` stands for no hub."""

    def __init__(self, row: np.ndarray, hub: np.ndarray, wide: np.ndarray, own: np.ndarray, none: int):
        self.own, self.none = own, none
        self.near = np.sort(row[~wide] * none + hub[~wide])
        self.key = np.sort(row[wide] * none + hub[wide])
        self.hub = self.key % max(none, 1)
        self.first = np.searchsorted(self.key, np.arange(len(own) + 1) * none)
        self.count = np.diff(self.first)

    def _single(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        for x, y in ((a, b), (b, a)):
            hub = self.own[x]
            met = (hub < self.none) & _found(self.near, y * self.none + hub)
            least = np.where(met, np.minimum(least, hub), least)
        return least

    def listed(self, a: np.ndarray, b: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
        """The least hub of each pair, by looking up the hubs of one row at the other."""
        least = np.full(len(a), self.none, np.int64)
        small, large = np.where(self.count[a] <= self.count[b], a, b), np.where(self.count[a] <= self.count[b], b, a)
        some = np.flatnonzero(self.count[small] > 0)
        todo = np.cumsum(self.count[small[some]])
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + chunk, side="right")))
            i = some[at:to]
            lens = self.count[small[i]]
            hub = self.hub[ragged_ranges(self.first[small[i]], lens)]
            met = _found(self.key, np.repeat(large[i] * self.none, lens) + hub)
            least[i] = np.minimum.reduceat(np.where(met, hub, self.none), np.cumsum(lens) - lens)
            at = to
        return self._single(a, b, least)

    def among(self, members: np.ndarray):
        """The same for many pairs among the members: a function that ands bits of their wide hubs."""
        lens = self.count[members]
        hubs, bit, times = np.unique(self.hub[ragged_ranges(self.first[members], lens)], return_inverse=True, return_counts=True)
        place = np.zeros(len(self.own), np.int64)
        place[members] = np.arange(len(members))
        shared = times > 1
        row, bit = np.repeat(np.arange(len(members)), lens)[shared[bit]], (np.cumsum(shared) - 1)[bit[shared[bit]]]
        hubs = hubs[shared]
        bits = np.zeros((-(-len(hubs) // 64), len(members)), np.uint64)
        np.bitwise_or.at(bits, (bit >> 6, row), np.uint64(1) << (bit & 63).astype(np.uint64))

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out, todo = np.full(len(a), self.none, np.int64), np.arange(len(a))
            for w, word in enumerate(bits):
                both = word[place[a[todo]]] & word[place[b[todo]]]
                hit = both > 0
                low = np.bitwise_count((both[hit] & (~both[hit] + np.uint64(1))) - np.uint64(1))
                out[todo[hit]] = hubs[64 * w + low.astype(np.int64)]
                todo = todo[~hit]
                if not len(todo):
                    break
            return self._single(a, b, out)

        return least


def _links(task: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, weight: np.ndarray, features: np.ndarray, bounds: np.ndarray, hub_row: np.ndarray, hub: np.ndarray, hub_task: np.ndarray, hub_wide: np.ndarray, threshold: float, counted: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(set ids, linked documents, another set of the group)`` of rows of whole cells.

    A row is a set in one cell of a task: on the left side, the right, or (in an
    undivided task or block) both. hub_row, hub, hub_task, hub_wide: the hubs of each
    row, the task of each hub, and whether the row meets all at the hub or it alone.
    Not counted: only what hangs together is of interest, so pairs of sets that do so
    already are left out, and links is 1.
    """
    n = len(ids)
    cell = np.cumsum(np.append(True, (task[1:] != task[:-1]).any(axis=1))) - 1
    names, code = np.unique(hub, return_inverse=True)
    task_of = np.zeros(len(names), np.int64)
    task_of[code] = hub_task
    at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    own = np.where(names[at] == ids, at, len(names))
    meetings = _Meetings(hub_row, code, hub_wide, own, len(names))
    # the rows of each hub in each cell
    order = np.lexsort((hub_row, code, cell[hub_row]))
    r, h, wide = hub_row[order], code[order], hub_wide[order]
    run = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (cell[r[1:]] != cell[r[:-1]]))) - 1
    center = np.full(run[-1] + 1, -1)
    center[run[own[r] == h]] = r[own[r] == h]
    single = ~wide & (center[run] >= 0)
    x, y = [r[single]], [center[run[single]]]
    r, run = r[wide], run[wide]
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(r) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(r)))
    few = size <= _LISTED
    members = ragged_ranges(start[few], size[few])
    after = np.repeat(start[few] + size[few], size[few]) - members - 1
    x.append(r[np.repeat(members, after)])
    y.append(r[ragged_ranges(members + 1, after)])
    # large gatherings that share members are compared in one
    near = ragged_ranges(start[~few], size[~few] - 1)
    label = united(np.arange(n), r[near], r[near + 1])
    x, y = np.concatenate(x), np.concatenate(y)
    apart = label[x] != label[y]
    key = np.unique(np.minimum(x, y)[apart] * n + np.maximum(x, y)[apart])
    a, b = key // n, key % n
    length = np.diff(bounds)
    fits = np.minimum(length[a], length[b]) >= threshold * np.maximum(length[a], length[b]) - 1e-9
    a, b = a[fits], b[fits]
    common = overlaps(features, bounds, a, b)
    ok = common / np.maximum(length[a] + length[b] - common, 1) >= threshold - 1e-12
    foreign = np.zeros(n, bool)
    foreign[hub_row[hub_task != task[hub_row, 0]]] = True

    def found() -> Iterator[tuple]:
        yield a[ok], b[ok], meetings.listed
        by = np.argsort(label, kind="stable")
        begin = np.flatnonzero(np.append(True, label[by][1:] != label[by][:-1]))
        count = np.diff(np.append(begin, n))
        for e in np.flatnonzero(count > 1).tolist():
            group = by[begin[e] : begin[e] + count[e]]
            least = meetings.among(group)
            for p, q in gathered(features, bounds, group, threshold):
                yield p, q, least

    def joined() -> Iterator[tuple]:
        yield a[ok], b[ok]
        by = np.argsort(label, kind="stable")
        begin = np.flatnonzero(np.append(True, label[by][1:] != label[by][:-1]))
        for members in np.split(by, begin[1:]):
            if len(members) > 1:
                yield from gathered(features, bounds, members, threshold, lambda: group)

    links, group = np.zeros(n, np.int64), np.arange(n)
    if not counted:
        for p, q in joined():
            links[p] = links[q] = 1
            group = united(group, p, q)
    for p, q, least in found() if counted else ():
        # in a pair of blocks, only pairs across them count
        across = (left[p] & right[q]) | (left[q] & right[p])
        p, q = p[across], q[across]
        # where both have hubs of other tasks, the task of the first hub at which they meet counts them
        unsure = np.flatnonzero(foreign[p] & foreign[q])
        first = least(p[unsure], q[unsure])
        mine = np.ones(len(p), bool)
        mine[unsure] = (first < len(names)) & (task_of[np.minimum(first, len(names) - 1)] == task[p[unsure], 0])
        p, q = p[mine], q[mine]
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        group = united(group, p, q)
    some = np.flatnonzero(links > 0)
    yield ids[some], links[some], ids[group[some]]


def _verify(edges: DataFrame, sets: DataFrame, texts: DataFrame, n: int, salt: int, threshold: float, width: int, counted: bool = True) -> DataFrame:
    """``(set_id, links, other)``: rows of similar sets, from each task in which they are.

    sets: ``(set_id, doc_id, size, n_docs)``, doc_id being one of its documents.
    """
    pairs = edges.select("a", "b")
    hubs = pairs.select("a").distinct()
    # hubs meet at the least set within two steps
    least = pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("s")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    far = least.select(F.col("s").alias("m"), F.col("m").alias("task"))
    placed = hubs.join(least, F.col("a") == F.col("s")).join(far, "m").select(F.col("a").alias("hub"), "task")
    at = durable(edges.select(F.col("a").alias("hub"), F.col("b").alias("set_id"), "wide").union(hubs.select("a", F.col("a").alias("set_id"), F.lit(True))).join(placed, "hub"))
    shown = at.select("task", "set_id").distinct().join(sets.select("set_id", "size"), "set_id")
    loads = shown.groupBy("task").agg(F.greatest(F.ceil(F.sum("size") / TASK_FEATURES), F.ceil(F.count("*") / TASK_SETS)).cast("int").alias("blocks"))
    # cells (task, i, j) with i <= j; a set of block x is on the left of (x, j) and on the right of (i, x)
    x = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    cells = shown.join(loads, "task").withColumn("x", x).select(
        "set_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct("task", F.least("x", y).alias("i"), F.greatest("x", y).alias("j"), (F.col("x") <= y).alias("left"), (F.col("x") >= y).alias("right")))).alias("cell")
    )
    own = at.groupBy("set_id").agg(F.collect_set(F.struct("hub", "task", "wide")).alias("hubs"))
    wanted = cells.groupBy("set_id").agg(F.collect_list("cell").alias("cells")).join(own, "set_id").join(sets.select("set_id", "doc_id", "n_docs"), "set_id")
    shipped = _compressed(texts).join(wanted, "doc_id")
    rows = shipped.select(F.explode("cells").alias("cell"), "set_id", "n_docs", F.col("hubs.hub").alias("hub"), F.col("hubs.task").alias("hub_task"), F.col("hubs.wide").alias("hub_wide"), "z").select("cell.*", "set_id", "n_docs", "hub", "hub_task", "hub_wide", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        parts: list[tuple] = []
        load, last, kept = 0, None, None

        def solve() -> Iterator[pa.RecordBatch]:
            task, left, right, ids, weight, size, feature, count, hub, hub_task, hub_wide = (np.concatenate([p[c] for p in parts]) for c in range(11))
            bounds = np.concatenate([[0], np.cumsum(size)])
            for found in _links(task, left, right, ids, weight, feature, bounds, np.repeat(np.arange(len(ids)), count), hub, hub_task, hub_wide, threshold, counted):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=_LINK.names)

        for batch in batches:
            for piece in range(0, len(batch), 256):
                b = batch.slice(piece, 256)
                task = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
                left, right = (b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                ids, weight = b.column(5).to_numpy(), b.column(6).to_numpy()
                frames = pa.array([open_.decompress(z.as_buffer()) for z in b.column(10)], pa.large_binary())
                got = [Sets(s, n, salt) for whole in slices(frames) for s in _small(whole)]
                of = np.concatenate([g.set_id for g in got])
                size, feature = np.concatenate([g.size for g in got]), np.concatenate([g.feature for g in got])
                bounds = np.concatenate([[0], np.cumsum(size)])
                count = pa.compute.list_value_length(b.column(7)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(count)
                hub, hub_task, hub_wide = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (7, 8, 9))
                # rows of a doc_id with another text are none of ours, repeated rows are one
                mine = np.flatnonzero(of == ids)
                named = np.concatenate([task[mine], ids[mine, None]], axis=1)
                again = np.zeros(len(mine), bool)
                again[1:] = (named[1:] == named[:-1]).all(axis=1)
                if len(mine):
                    again[0] = kept is not None and (named[0] == kept).all()
                    kept = named[-1]
                fine = np.zeros(len(b), bool)
                fine[mine[~again]] = True
                # cells are cut apart where enough is held
                edge = np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1
                if last is not None and (task[0] != last).any():
                    edge = np.append(0, edge)
                begin = 0
                for e in [*edge.tolist(), len(b)]:
                    rows_ = np.arange(begin, e)
                    rows_ = rows_[fine[rows_]]
                    if len(rows_):
                        sel, hubs_ = ragged_ranges(bounds[rows_], size[rows_]), ragged_ranges(ends[rows_] - count[rows_], count[rows_])
                        parts.append((task[rows_], left[rows_], right[rows_], ids[rows_], weight[rows_], size[rows_], feature[sel], count[rows_], hub[hubs_], hub_task[hubs_], hub_wide[hubs_]))
                        load += len(sel)
                    if e < len(b) and load >= BATCH_FEATURES:
                        yield from solve()
                        parts, load = [], 0
                    begin = e
                last = task[-1]
        if parts:
            yield from solve()

    return rows.repartition(width, "task", "i", "j").sortWithinPartitions("task", "i", "j", "set_id").mapInArrow(tidy(run), _LINK)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node of each node's connected component.

    edges: ``(x, y)``. Minimum labels move along edges and through the labels
    themselves (pointer jumping), a logarithmic number of rounds in practice.
    """
    both = durable(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct())
    label = durable(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        heard = both.join(label.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("heard"))
        moved = label.join(heard, "node").select("node", "root", F.least("root", "heard").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = durable(moved.join(jump, "low").select("node", F.least("low", "far").alias("next"), (F.least("low", "far") < F.col("root")).alias("changed")))
        label = after.select("node", F.col("next").alias("root"))
        if after.filter("changed").isEmpty():
            return label


def _grouped(texts: DataFrame, n: int, salt: int, fine: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``_members`` says; ``(set_id, doc_id)``; and the sets."""
    seen = durable(_members(texts, n, salt, fine))
    members = seen.filter("set_id IS NOT NULL").groupBy("set_id", "doc_id").agg(F.max("size").alias("size"), F.min("check").alias("low"), F.max("check").alias("high"))
    sets = members.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"), F.max("size").alias("size"), (F.min("low") != F.max("high")).alias("mixed"))
    return seen, members.select("set_id", "doc_id"), durable(sets)


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, links)``, one row a document: how many other documents have a
    Jaccard similarity >= threshold with it, copies among them, and the least doc_id
    of those that it hangs together with by such links (its own where there are none).
    """
    return _similar(docs, n, threshold, True)


def _met(texts: DataFrame, n: int, salt: int, threshold: float, seen: DataFrame, sets: DataFrame, width: int, fine: bool) -> DataFrame:
    """Candidates by the signatures of PartEnum, or (fine) of its finest cut."""
    total, largest = sets.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    # of a fixed size, whatever the input
    info = _fine_information(seen, total) if fine else information(_sketch(seen), total).astype(np.int16)
    bands = Bands(threshold, largest)
    send = lambda own, about, rows: fine_signatures(own, threshold, about, rows) if fine else signatures(own, bands, about, rows)
    return _candidates(_blobs(texts, n, salt, send, info, width), width, fine)


def _similar(docs: DataFrame, n: int, threshold: float, counted: bool) -> DataFrame:
    """What ``similar_documents`` says; links are of no meaning where they aren't counted."""
    if n < 1 or not 0 < threshold <= 1:
        raise ValueError("n is at least 1 and the threshold in (0, 1]")
    width = shuffle_width(docs)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    texts = named.filter("text IS NOT NULL")
    for salt in range(8):
        seen, members, sets = _grouped(texts, n, salt, not counted)
        if sets.filter("mixed").isEmpty():
            break
    met = _met(texts, n, salt, threshold, seen, sets, width, not counted)
    edges = durable(_named(met, sets))
    found = durable(_verify(edges, sets.select("set_id", "doc_id", "size", "n_docs"), texts, n, salt, threshold, width, counted))
    # a class hangs together by similar sets, and by documents that have several texts
    first = sets.select("set_id", F.col("doc_id").alias("first"))
    ties = found.select("set_id", "other").filter("set_id <> other").distinct().join(first.withColumnRenamed("first", "x"), "set_id").join(first.select(F.col("set_id").alias("other"), F.col("first").alias("y")), "other").select("x", "y")
    several = members.groupBy("doc_id").agg(F.count("*").alias("c"), F.collect_set("set_id").alias("sets")).filter("c > 1").select("doc_id", F.explode("sets").alias("set_id")).join(first, "set_id").select(F.col("doc_id").alias("x"), F.col("first").alias("y"))
    roots = components(ties.union(several).filter("x <> y"))
    linked = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    about = sets.filter("n_docs > 1").select("set_id").union(linked.select("set_id")).union(sets.join(roots, F.col("doc_id") == F.col("node")).select("set_id")).distinct()
    known = about.join(sets.select("set_id", "doc_id", "n_docs"), "set_id").join(linked, "set_id", "left").join(roots, F.col("doc_id") == F.col("node"), "left")
    known = known.select("set_id", F.coalesce("root", "doc_id").alias("class"), (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    rows = members.join(known, "set_id").groupBy("doc_id").agg(F.min("class").alias("class"), F.sum("links").alias("links"))
    return named.select("doc_id").distinct().join(rows, "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, keeper)`` of every document that goes when one of each class
    stays: the least doc_id does."""
    return _similar(docs, n, threshold, False).filter("doc_id <> class_id").select("doc_id", F.col("class_id").alias("keeper"))


ORACLE_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT DISTINCT doc_id, list_transform(list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''), lambda x: CASE WHEN trim(x, m.marks) = '' THEN lower(x) ELSE trim(lower(x), m.marks) END) AS w
  FROM documents, (SELECT '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~¡§«¶·»¿' || array_to_string(list_transform(range(8208, 8255), lambda c: chr(c::INTEGER)), '') || array_to_string(list_transform(range(12289, 12306), lambda c: chr(c::INTEGER)), '') AS marks) m
  WHERE doc_id IS NOT NULL AND text IS NOT NULL
), f AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + {N - 1}], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS p FROM t WHERE len(w) > 0)
), s AS (
  SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE c.n >= {THRESHOLD} * (p.n + q.n - c.n) - 1e-9
), u AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT x AS doc_id, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id WHERE r.root < u.y
), k AS (
  SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id
), l AS (
  SELECT x AS doc_id, count(*) AS links FROM u GROUP BY x
)
SELECT d.doc_id, coalesce(k.root, d.doc_id) AS class_id, coalesce(l.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)
"""
