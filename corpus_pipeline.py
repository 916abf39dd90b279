"""Corpus pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.

1. language ID: documents without a language that the classifier knows go;
2. n-gram Jaccard join: of each class of similar documents one stays, that with
   the least doc_id; rows without doc_id, or without words, are in no class and stay;
3. suffix-array dedup: later occurrences of repeated passages are cut out;
4. mixing: the rows in the order of the Pfair schedule, all of them;
5. byte-level BPE: token ids and character spans of each document, and its
   ``position`` in the mixed order (from 0, without gaps when read from Parquet).
   Readers take part files in any order, so the position comes from the number
   of a row's part file and the row's place in it.

The stages handle nulls, empty and very long texts, ties, repeated rows and extra
columns as their operators say; of rows that repeat a doc_id all stay or all go in
stage 2. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import bpe, langid, partenum, pfair, sadedup

#: The stages have no SQL equivalent.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row travels as one value, so its columns' names clash with none here
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gone = partenum.duplicates(docs).select(F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sadedup.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair.mixed(docs)


def _in_place(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, text, position)``: position is the order in which the rows were written, or that of the rows of an unwritten table."""
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        rows = docs.select("doc_id", "text", path.alias("__path"), row.alias("__at"))
    except AnalysisException:  # read from no Parquet files
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("position"))
    number = lambda p: (int((re.search(r"part-(\d+)[^/]*$", p) or [0, -1])[1]), p)
    counts = {r["p"]: r["count"] for r in docs.select(path.alias("p")).groupBy("p").count().collect()}
    begin, files = 0, []
    for p in sorted(counts, key=number):
        files.append((p, begin))
        begin += counts[p]
    starts = F.broadcast(spark.createDataFrame(files, "__path string, __begin bigint"))
    return rows.join(starts, "__path").select("doc_id", "text", (F.col("__begin") + F.col("__at")).alias("position"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_in_place(spark, docs), along="position")


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them stands in the folder
    that the cluster names in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("a cluster names its shared folder in spark.checkpoint.dir")
    shared = shared or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
