"""Byte-level BPE encoding and decoding over Arrow batches (operator 3).

The ``tokenizers`` library encodes each distinct pre-token run once per worker;
texts are assembled from those by vectorised gathers. A run ends where the
byte-level split rule always ends a piece: before a single space, and around a
single line feed, that stands between two characters which are not white space.
Anything else (runs of spaces, exotic white space, text edges) stays inside one
run, so the ids equal those of encoding the whole text.

Definitions: a null or empty text has no tokens and decodes to an empty text;
strings of special tokens are ordinary text; texts are never cut; repeated rows
are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metaloom.llm.bytesvec import HashIndex, Slice, list_array, ragged_ranges, slices, span_hash
from metaloom.llm.durable import tidy

#: Distinct runs that a worker remembers; beyond it the memory starts afresh (no effect on results).
MEMORY_RUNS = 800_000
_MAYBE_SPACE2 = np.zeros(256, dtype=bool)
_MAYBE_SPACE2[0xC2] = True
_MAYBE_SPACE3 = np.zeros(256, dtype=bool)
_MAYBE_SPACE3[[0xE1, 0xE2, 0xE3]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return shown | {chr(256 + i): b for i, b in enumerate(rest)}


def run_bounds(s: Slice) -> np.ndarray:
    """Start of every run in a slice, followed by the total length."""
    d, n = s.data, len(s.data)
    if not n:
        return np.zeros(1, np.int64)
    blank = _BLANK[d]
    before = np.ones(n, dtype=bool)
    before[1:] = blank[:-1]
    before[2:] |= _MAYBE_SPACE2[d[:-2]]
    before[3:] |= _MAYBE_SPACE3[d[:-3]]
    after = np.ones(n, dtype=bool)
    after[:-1] = blank[1:] | _MAYBE_SPACE2[d[1:]] | _MAYBE_SPACE3[d[1:]]
    edges = s.offsets[(s.offsets > 0) & (s.offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    simple = ~before & ~after
    cut = simple & ((d == 32) | (d == 10))
    feed = np.flatnonzero(simple & (d == 10)) + 1
    cut[feed] = True
    cut[0] = True
    cut[edges] = True
    return np.append(np.flatnonzero(cut), n)


class RunEncoder:
    """Ids of distinct runs, remembered by hash. The ids of every slice are decoded and
    compared with its bytes, so a run that meets another's hash gets its own ids."""

    def __init__(self, path: str, library: str = "tokenizers"):
        self.path, self.library = path, library
        if library == "tokenizers":
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.encode_special_tokens = True
            vocab = self.tok.get_vocab(with_added_tokens=False)
            shown = byte_table()
            self.table = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.table[i] = bytes(shown[c] for c in token)
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.table = [b""] * (max(ranks.values()) + 1)
            for token, i in ranks.items():
                self.table[i] = token
        self.byte_len = np.array([len(b) for b in self.table], dtype=np.int64)
        self.byte_start = np.cumsum(self.byte_len) - self.byte_len
        self.bytes = np.frombuffer(b"".join(self.table), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex()
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, s: Slice, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        raw = s.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())]
        if self.library == "tokenizers":
            ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            ids = [self.tok.encode_ordinary(t) for t in texts]
        length = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        total = int(length.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), total), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=total)
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += total
        self.index.add(h)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows of a slice, and the number of ids of each row."""
        bounds = run_bounds(s)
        begin, end = bounds[:-1], bounds[1:]
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(s.rows, np.int64)
        if self.index.size > MEMORY_RUNS:
            self._forget()
        h = span_hash(s.data, begin, end)
        number = self.index.find(h)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            self._learn(s, begin[at], end[at], new)
            number[miss] = self.index.find(h[miss])
        length = self.length[number].astype(np.int64)
        ids = self.flat[ragged_ranges(self.start[number], length)]
        done = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(length, out=done[1:])
        count = np.diff(done[np.searchsorted(begin, s.offsets, side="left")])
        if not np.array_equal(self.decode_bytes(ids), s.data):  # runs met in one hash, or bytes are no UTF-8: ask the library for the rows themselves
            rows = [self.tok.encode(s.text(r), add_special_tokens=False).ids if self.library == "tokenizers" else self.tok.encode_ordinary(s.text(r)) for r in range(s.rows)]
            count = np.array([len(r) for r in rows], dtype=np.int64)
            ids = np.array([i for r in rows for i in r], dtype=np.int32)
        return ids, count

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids; characters split between tokens come together again."""
        return self.bytes[ragged_ranges(self.byte_start[ids], self.byte_len[ids])]


_encoders: dict[tuple[str, str], RunEncoder] = {}


def encoder(path: str, library: str = "tokenizers") -> RunEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, library) not in _encoders:
        _encoders[path, library] = RunEncoder(path, library)
    return _encoders[path, library]


@dataclass
class Encoded:
    """Tokens of a slice. start/end: characters of the row that a token touches."""

    ids: np.ndarray
    count: np.ndarray
    start: np.ndarray
    end: np.ndarray


def encode_slice(enc: RunEncoder, s: Slice) -> Encoded:
    """Ids with character offsets: a token covers the characters that own any of its bytes."""
    ids, count = enc.encode(s)
    to = np.cumsum(enc.byte_len[ids])
    lead = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data & 0xC0) != 0x80, out=lead[1:])
    row = np.repeat(np.arange(s.rows), count)
    base = lead[s.offsets[:-1]][row]
    start = lead[to - enc.byte_len[ids] + 1] - 1 - base if len(ids) else to
    end = lead[to] - base
    return Encoded(ids, count, start, end)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("exact", T.BooleanType()),
    ]
)


def encode_documents(docs: DataFrame, path: str | None = None, along: str | None = None) -> DataFrame:
    """One row a document: ids, first and past-last character of each token, and
    whether decoding the ids gives the text's bytes back.

    A token that holds a part of a character covers that character, so tokens of
    a split character share it. Null texts give empty arrays. along: a bigint
    column that is kept, as the last.
    """
    place = path or tokenizer_path()
    schema = T.StructType([*SCHEMA.fields, T.StructField(along, T.LongType())]) if along else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(place)
        for batch in batches:
            for s in slices(batch.column(1)):
                e = encode_slice(enc, s)
                back = enc.decode_bytes(e.ids)  # asked again of the ids that are returned, for the column ``exact``
                exact = np.ones(s.rows, dtype=bool)
                if not np.array_equal(back, s.data):
                    done = np.concatenate([[0], np.cumsum(e.count)])
                    for r in range(s.rows):
                        got = enc.decode_bytes(e.ids[done[r] : done[r + 1]])
                        exact[r] = np.array_equal(got, s.data[s.offsets[r] : s.offsets[r + 1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.rows),
                        pa.array(e.count.astype(np.int32)),
                        list_array(e.ids, e.count, pa.int32()),
                        list_array(e.start.astype(np.int32), e.count, pa.int32()),
                        list_array(e.end.astype(np.int32), e.count, pa.int32()),
                        pa.array(exact),
                        *([batch.column(2).slice(s.first, s.rows)] if along else []),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text", *([along] if along else [])).mapInArrow(tidy(run), schema)


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Texts of ``(doc_id, ids)``: the byte table is reversed over the whole array,
    so characters that tokens split come back; bytes that are no UTF-8 (from ids
    that never came from a text) become U+FFFD. Null ids give a null text; an id
    outside the vocabulary raises.
    """
    place = path or tokenizer_path()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(place)
        for batch in batches:
            col = batch.column(1)
            texts = []
            for r in range(len(col)):
                x = col[r]
                ids = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) if x.is_valid else None
                if ids is not None and len(ids) and (ids.min() < 0 or ids.max() >= len(enc.table)):
                    raise ValueError("a token id is outside the vocabulary")
                texts.append(None if ids is None else enc.decode_bytes(ids).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(tidy(run), schema)
