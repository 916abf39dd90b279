"""Token ids as compressed binary (operator 2).

Each document's ids become little-endian unsigned integers of 2 bytes (4 where
the vocabulary needs it) and one zstandard frame of their own, compressed with a
dictionary that all documents share. A short document is read alone: its shard,
offset and length come from the index, the dictionary from its hash.

The dictionary is trained on all documents, step by step: each task trains one on
the id arrays of ``TRAIN_BYTES`` at a time, and the parts of these dictionaries are
what the next, wider step trains on, until one is left. No step holds more than
``TRAIN_BYTES`` of arrays or ``FAN_IN`` dictionaries. Where the library finds too
little that repeats, as much as a dictionary holds goes to the next step, evenly
taken; if the last step has too little as well, frames carry no dictionary and the
hash is that of the empty string.

Definitions: a null text has null tokens, null frame and length 0; an empty text
is a frame of no ids; repeated rows, and rows of null doc_id, are stored each for
itself; texts of any length are stored whole; other columns are ignored. An empty
table gives the dictionary's row alone. There are no ties: frames depend on their own
text and on the dictionary, and the dictionary on the order in which tasks read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.bpe import encoder, tokenizer_path
from metaloom.llm.bytesvec import slices
from metaloom.llm.durable import durable

#: Size of the dictionary in bytes, of the pieces that a dictionary is cut into for
#: the next step, of what one training sees, and dictionaries that one step merges.
DICT_BYTES = 64 * 1024
PIECE_BYTES, TRAIN_BYTES, FAN_IN = 1024, 8 << 20, 64
LEVEL = 3

SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("id_bytes", T.IntegerType()),
        T.StructField("dict_hash", T.StringType()),
        T.StructField("frame", T.BinaryType()),
    ]
)


def _width(size: int) -> type:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _trained(samples: list[bytes], size: int, share: int = 2) -> bytes | None:
    """Dictionary of some samples, of a share of their size at most; None where the library finds too little that repeats."""
    import zstandard

    samples = [x for x in samples if len(x) >= 8]
    size = min(size, sum(map(len, samples)) // share)
    if len(samples) < 8 or size < 256:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8, f=20, accel=2).as_bytes()
    except zstandard.ZstdError:
        return None


def train_dictionary(docs: DataFrame, path: str, dict_bytes: int = DICT_BYTES) -> bytes:
    """Dictionary bytes, empty where there is too little to train on."""
    schema = T.StructType([T.StructField("piece", T.BinaryType())])

    def cut(dictionary: bytes) -> list[bytes]:
        size = max(256, min(PIECE_BYTES, dict_bytes // 8))
        return [dictionary[i : i + size] for i in range(0, len(dictionary), size)]

    def step(samples: list[bytes], share: int = 2) -> pa.RecordBatch:
        made = _trained(samples, dict_bytes, share)
        every = max(1, -(-sum(map(len, samples)) // dict_bytes))
        return pa.RecordBatch.from_arrays([pa.array(cut(made) if made else samples[::every], pa.binary())], names=schema.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "tiktoken")
        kind = _width(len(enc.table))
        samples, held = [], 0
        for batch in batches:
            for s in slices(batch.column(0)):
                ids, count = enc.encode(s)
                raw = ids.astype(kind).tobytes()
                to = (np.cumsum(count) * kind.itemsize).tolist()
                for a, b in zip([0, *to[:-1]], to):
                    # long documents are several samples: a sample is what a window of the library can see
                    samples += [raw[i : min(i + (1 << 16), b)] for i in range(a, b, 1 << 16)]
                held += len(raw)
                if held >= TRAIN_BYTES:
                    yield step(samples, 8)
                    samples, held = [], 0
        if samples:
            yield step(samples, 8)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                samples.append(x)
                held += len(x)
                if held >= TRAIN_BYTES:
                    yield step(samples)
                    samples, held = [], 0
        if samples:
            yield step(samples)

    pieces = durable(docs.filter("text IS NOT NULL").select("text").mapInArrow(first, schema))
    most = FAN_IN * dict_bytes
    while True:
        size = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
        if size <= most:
            return _trained(sorted(r.piece for r in pieces.collect()), dict_bytes) or b""
        # pieces of all tasks meet, so what repeats across tasks is seen to repeat
        pieces = durable(pieces.repartition(-(-size // most)).mapInArrow(again, schema))


def encode_frames(docs: DataFrame, path: str | None = None, dictionary: bytes | None = None) -> DataFrame:
    """One row ``kind='document'`` a document, and one ``kind='dictionary'`` whose
    frame is the dictionary itself (shard -1).

    shard: the input partition; offset: where the frame begins when the shard's
    frames stand in one file, in the order of their offsets.
    """
    place = path or tokenizer_path("byte_bpe_50k.tiktoken")
    if dictionary is None:
        dictionary = train_dictionary(docs, place)
    seen = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(place, "tiktoken")
        kind = _width(len(enc.table))
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1)):
                ids, count = enc.encode(s)
                here = known[s.first : s.first + s.rows]
                raw = memoryview(ids.astype(kind).tobytes())
                to = np.cumsum(count) * kind.itemsize
                frames = [press.compress(raw[b - n : b]) if k else None for b, n, k in zip(to.tolist(), (count * kind.itemsize).tolist(), here.tolist())]
                size = np.array([len(f) if f is not None else 0 for f in frames], dtype=np.int64)
                offset = at + np.cumsum(size) - size
                at += int(size.sum())
                n = s.rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["document"] * n),
                        batch.column(0).slice(s.first, n),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(offset),
                        pa.array(size.astype(np.int32)),
                        pa.array(count.astype(np.int32), mask=~here),
                        pa.array(np.full(n, kind.itemsize, np.int32)),
                        pa.array([seen] * n),
                        pa.array(frames, pa.binary()),
                    ],
                    names=SCHEMA.names,
                )

    spark = docs.sparkSession
    width = _width(len(encoder(place, "tiktoken").table)).itemsize
    head = spark.createDataFrame([("dictionary", None, -1, 0, len(dictionary), None, width, seen, dictionary)], SCHEMA)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA).unionByName(head)


def decode_frames(frames: DataFrame, dictionary: bytes) -> DataFrame:
    """``(doc_id, ids)`` of document rows; raises where the dictionary is another."""
    want = hashlib.sha256(dictionary).hexdigest()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        open_ = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            out = []
            for h, w, f in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if h != want:
                    raise ValueError("these frames were written with another dictionary")
                out.append(None if f is None else np.frombuffer(open_.decompress(f), dtype=f"<u{w}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return frames.filter("kind = 'document'").select("doc_id", "dict_hash", "id_bytes", "frame").mapInArrow(run, schema)


def write_shards(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write ``shard-N.bin`` files, ``index`` (Parquet) and ``dictionary.zdict``
    under a folder that all executors share; returns the index.

    A shard is written under another name and renamed, so a task that runs again
    replaces its own file only.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    place = path or tokenizer_path("byte_bpe_50k.tiktoken")
    dictionary = train_dictionary(docs, place)
    with store.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(dictionary)
    keep = [c for c in SCHEMA.names if c not in ("frame", "kind")]
    schema = T.StructType([SCHEMA[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{base}/shard-{task.partitionId()}.bin"
        rows = []
        with disk.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
            for batch in batches:
                for frame in batch.column("frame"):
                    if frame.is_valid:
                        f.write(frame.as_buffer())
                rows.append(batch.select(keep))
        disk.move(f"{name}.{task.taskAttemptId()}", name)
        yield from rows

    only = encode_frames(docs, place, dictionary).filter("kind = 'document'")
    only.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Token ids of a few documents: an index lookup, then one ranged read each."""
    import zstandard
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/dictionary.zdict") as f:
        dictionary = f.read()
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    open_ = zstandard.ZstdDecompressor(dict_data=shared)
    found = {}
    for r in spark.read.parquet(f"{folder}/index").filter(F.col("doc_id").isin(doc_ids) & F.col("n_tokens").isNotNull()).collect():
        if r.dict_hash != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("these frames were written with another dictionary")
        with store.open_input_file(f"{root}/shard-{r.shard}.bin") as f:
            raw = f.read_at(r.length, r.offset)
        found[r.doc_id] = np.frombuffer(open_.decompress(raw), dtype=f"<u{r.id_bytes}").tolist()
    return found
