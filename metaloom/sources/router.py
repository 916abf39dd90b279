"""Routing of files to the sources A (documents), B (governance), C (schemas), D (code).

Everything is one projection over ``(path, head)``; only the first 8192 bytes are kept,
but for JSON: a file is JSON as a whole or not at all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.functions.code import whole_json
from metaloom.functions.text import any_of

HEAD = 8192
SKIPPED = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".zip", ".gz", ".tar", ".exe", ".dll", ".so", ".pyc", ".lock", ".ico", ".mp4", ".parquet"]
SKIPPED_NAMES = ["license", "readme.md", ".gitignore", "makefile", "dockerfile", "changelog.md"]
BY_EXTENSION = {".txt": "A", ".pdf": "A", ".docx": "A", ".rst": "A", ".html": "A", ".py": "D", ".java": "D", ".scala": "D", ".ddl": "C", ".xsd": "C"}
GOVERNED = ["element_name", "definition", "steward", "owner", "is_critical", "domain_name", "data element"]
SCHEMATIC = ["table_name", "column_name", "data_type", "nullable", "primary_key", "foreign_key"]


def _decision(sources: str, confidence: float, layer: str) -> Column:
    return F.struct(F.array(*[F.lit(s) for s in sources.split("+") if s]).alias("sources"), F.lit(confidence).alias("confidence"), F.lit(layer).alias("layer"))


def _hits(head: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)))


def _sql(head: Column) -> Column:
    ddl = _hits(head, r"(?i)\b(?:create\s+table|alter\s+table|primary\s+key|references)\b")
    steps = _hits(head, r"(?i)\b(?:create\s+(?:or\s+replace\s+)?(?:view|procedure|function)|select|insert\s+into|case\s+when)\b")
    return F.when((ddl >= steps) & (ddl >= 1), _decision("C", 0.90, "sniff")).when(steps >= 1, _decision("D", 0.85, "sniff")).otherwise(_decision("D", 0.60, "sniff"))


def _delimited(head: Column, sep: str) -> Column:
    cells = F.transform(F.split(F.lower(F.substring_index(head, "\n", 1)), sep), lambda c: F.trim(c))
    count = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.exists(cells, lambda c: F.contains(c, w))))
    g, s = count(GOVERNED), count(SCHEMATIC)
    return F.when((g >= s) & (g >= 1), _decision("B", 0.90, "sniff")).when(s >= 1, _decision("C", 0.90, "sniff")).otherwise(_decision("B", 0.60, "sniff"))


@F.pandas_udf(T.BooleanType())
def _whole_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t is not None and whole_json(t)).astype(bool)


def _json(head: Column, whole: Column, ext: Column) -> Column:
    """Only files of the extension go to Python, and of these such as begin with a
    bracket or a quote or are one number or word."""
    key = lambda k: F.contains(head, F.lit(f'"{k}"'))
    like = whole.rlike(r'^[ \t\n\r]*(?:[\[{"]|-?(?:[0-9][0-9.eE+-]*|(?i:nan|inf|infinity|true|false|null))[ \t\n\r]*\z)')
    return (
        F.when(~_whole_json(F.when((ext == ".json") & like, whole)), _decision("C", 0.60, "sniff"))
        .when(key("element_name"), _decision("B", 0.95, "sniff"))
        .when(any_of([key(k) for k in ("$schema", "openapi", "swagger")]), _decision("C", 0.95, "sniff"))
        .when(key("type") & key("fields"), _decision("C", 0.90, "sniff"))
        .otherwise(_decision("C", 0.50, "sniff"))
    )


def _markdown(head: Column) -> Column:
    fences = F.floor(_hits(head, "(?m)^```") / 2)
    return F.when(fences >= 3, _decision("A+D", 0.85, "sniff")).otherwise(_decision("A", 0.95, "sniff"))


def route(files: DataFrame) -> DataFrame:
    """``(path, sources, confidence, layer)``. files: ``(path, text)``; a
    file that is skipped has no source; spreadsheets route to B at .60 unread."""
    name = F.lower(F.substring_index("path", "/", -1))
    ext = F.regexp_extract(name, r"\.[^.]*$", 0)
    head = F.coalesce(F.left("text", F.lit(HEAD)), F.lit(""))
    plain = F.lit(None)
    for source in sorted(set(BY_EXTENSION.values())):
        plain = F.coalesce(plain, F.when(ext.isin([e for e, s in BY_EXTENSION.items() if s == source]), _decision(source, 0.95, "extension")))
    chosen = (
        F.when(ext.isin(SKIPPED) | name.isin(SKIPPED_NAMES), _decision("", 0.99, "skip").cast("struct<sources:array<string>,confidence:double,layer:string>"))
        .when(ext == ".sql", _sql(head)).when(ext == ".csv", _delimited(head, ",")).when(ext == ".tsv", _delimited(head, "\t"))
        .when(ext.isin(".xlsx", ".xls"), _decision("B", 0.60, "sniff")).when(ext == ".json", _json(head, F.col("text"), ext)).when(ext.isin(".md", ".markdown"), _markdown(head))
        .otherwise(F.coalesce(plain, _decision("", 0.95, "skip").cast("struct<sources:array<string>,confidence:double,layer:string>")))
    )
    return files.select("path", chosen.alias("r")).select("path", "r.*")


def admitted(routed: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """what is dispatched, and what is only logged."""
    fine = (F.col("confidence") > threshold) & (F.size("sources") > 0)
    return routed.filter(fine), routed.filter(~fine)


def files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder with their text, in the order of their paths (``ord``)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    from pyspark.sql import Window

    rows = reader.load(folder).select("path", F.col("content").cast("string").alias("text"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")))
