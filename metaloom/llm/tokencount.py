"""Token counts by section or field (operator 7).

Every text is encoded once as a whole; the character span of each token is then
joined to the sections' intervals (a sorted search inside the Arrow batch), so
the counts of a text's sections add up to the text's own count.

Rule for a token that crosses a boundary: it goes to the section that holds most
of its characters, the earlier one on a tie (``rule="majority"``), or to the one
that holds its first character (``rule="first"``). Tokens that share a split
character all count for that character's section.

Definitions: sections are lines, each with its line feed; a null or empty text
is one empty section 0 with no tokens; repeated rows are counted each for
itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bpe import encode_slice, encoder, tokenizer_path
from metaloom.llm.bytesvec import slices

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("n_crossing", T.IntegerType()),
    ]
)


def allocate(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and which tokens touch more than one.

    start/end: character span of each token; section_start: ascending first
    characters of the sections, which leave no gap.
    """
    first = np.searchsorted(section_start, start, side="right") - 1
    last = np.searchsorted(section_start, np.maximum(end - 1, start), side="right") - 1
    cross = last > first
    owner = first.copy()
    if rule == "majority":
        for i in np.flatnonzero(cross).tolist():
            edges = np.concatenate([[start[i]], section_start[first[i] + 1 : last[i] + 1], [end[i]]])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError("rule is 'majority' or 'first'")
    return owner, cross


def count_sections(docs: DataFrame, path: str | None = None, rule: str = "majority") -> DataFrame:
    """Tokens of each line of each document, from one encoding of the whole text.

    n_crossing: tokens counted here that also touch another line.
    """
    place = path or tokenizer_path()
    if rule not in ("majority", "first"):
        raise ValueError("rule is 'majority' or 'first'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(place)
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                e = encode_slice(enc, s)
                lead = np.zeros(len(s.data) + 1, np.int64)
                np.cumsum((s.data & 0xC0) != 0x80, out=lead[1:])
                row_char = lead[s.offsets]
                filled = np.flatnonzero(np.diff(s.offsets) > 0)
                feeds = np.flatnonzero(s.data == 10) + 1
                begin = np.union1d(s.offsets[filled], feeds[feeds < len(s.data)])
                sec_start = lead[begin]
                sec_end = np.append(sec_start[1:], lead[-1])
                sec_row = np.searchsorted(s.offsets, begin, side="right") - 1
                base = np.repeat(row_char[:-1], e.count)
                owner, cross = allocate(e.start + base, e.end + base, sec_start, rule)
                tokens = np.bincount(owner, minlength=len(begin))
                crossing = np.bincount(owner[cross], minlength=len(begin))
                first = np.searchsorted(sec_row, sec_row)
                empty = np.flatnonzero(np.diff(s.offsets) == 0)
                row = np.concatenate([sec_row, empty])
                zero = np.zeros(len(empty), np.int64)
                start_char = np.concatenate([sec_start - row_char[sec_row], zero])
                end_char = np.concatenate([sec_end - row_char[sec_row], zero])
                columns = [np.concatenate([np.arange(len(begin)) - first, zero]), start_char, end_char, np.concatenate([tokens, zero]), np.concatenate([crossing, zero])]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + s.first)), *(pa.array(c.astype(np.int32)) for c in columns)], names=SCHEMA.names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def count_fields(rows: DataFrame, key: str, fields: list[str], path: str | None = None, rule: str = "majority") -> DataFrame:
    """Tokens of each named text column when a row's columns are joined by line
    feeds and encoded as one text: ``(key, field, n_tokens)``.

    A null column is an empty one. The joining line feed belongs to the field
    before it. Columns may hold line feeds themselves.
    """
    place = path or tokenizer_path()
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("field", T.StringType()), T.StructField("n_tokens", T.IntegerType())])
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n" if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    shaped = rows.select(F.col(key).cast("string").alias("k"), F.concat(*parts).alias("t"), F.array(*[F.char_length(p) for p in parts]).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(place)
        for batch in batches:
            for s in slices(batch.column(1)):
                e = encode_slice(enc, s)
                done = np.concatenate([[0], np.cumsum(e.count)])
                keys, names, counts = [], [], []
                for r in range(s.rows):
                    size = np.array(batch.column(2)[s.first + r].as_py(), dtype=np.int64)
                    start = np.cumsum(size) - size
                    some = np.flatnonzero(size > 0)
                    n = np.zeros(len(fields), np.int64)
                    if len(some):
                        a, b = done[r], done[r + 1]
                        owner, _ = allocate(e.start[a:b], e.end[a:b], start[some], rule)
                        n[some] = np.bincount(owner, minlength=len(some))
                    keys += [batch.column(0)[s.first + r].as_py()] * len(fields)
                    names += fields
                    counts += n.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int32())], names=schema.names)

    return shaped.mapInArrow(run, schema)
