"""The review loop: bridge suggestions, induced attributes with their cache, versions of a triple table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.functions.text import name_key
from metaloom.operators.lineage import durable


def bridge_prompts(holes: DataFrame, groups: DataFrame, listed: int = 8) -> DataFrame:
    """One prompt a hole, from the first names of both communities."""
    names = groups.groupBy("community").agg(F.array_join(F.slice(F.array_sort(F.collect_set("node")), 1, listed), ", ").alias("names"))
    a, b = names.select(F.col("community").alias("i"), F.col("names").alias("first")), names.select(F.col("community").alias("j"), F.col("names").alias("second"))
    text = F.concat(F.lit("Two groups of terms hardly touch.\nGroup 1: "), "first", F.lit("\nGroup 2: "), "second", F.lit("\nName one concept that links them, its relationships as 'x -> verb -> y', and why."))
    return holes.join(a, "i").join(b, "j").select("i", "j", text.alias("prompt"))


def parse_bridges(answers: DataFrame) -> DataFrame:
    """Concept, arrows and rationale of answers ``(i, j, answer)``; absent parts are empty."""
    arrows = F.regexp_extract_all("answer", F.lit(r"(?m)^[\s*-]*([^\n>]+?\s*->\s*[^\n>]+?\s*->\s*[^\n]+?)\s*$"), F.lit(1))
    return answers.select("i", "j", F.trim(F.regexp_extract("answer", r"(?im)^\W*concept\W*:\s*\**\s*([^\n*]+)", 1)).alias("concept"), arrows.alias("links"), F.trim(F.regexp_extract("answer", r"(?im)^\W*(?:rationale|why)\W*:\s*\**\s*([^\n]+)", 1)).alias("rationale"))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` from 1 in a global order: range partitions are numbered each
    for itself and shifted by the counts of those before, so no task sees all rows."""
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return placed.withColumn("own", own).join(shift, "part").withColumn("rank", F.col("own") + F.col("before")).drop("at", "part", "own", "before")


def eligible(fused: DataFrame, attributes: DataFrame) -> DataFrame:
    """Elements of source A without attributes, the surest first, then by name (``rank``)."""
    rows = fused.filter(F.contains("sources", F.lit("A"))).join(attributes.select(name_key(F.col("element")).alias("element_key")).distinct(), "element_key", "left_anti")
    return ranked(rows, [F.desc("confidence"), F.lower("name").asc(), F.asc("element_key")])


def first_wins(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n = 1").drop("n")


def parse_attributes(answers: DataFrame) -> DataFrame:
    """Lines ``name :: type :: description`` of answers ``(element, answer)``; unknown types become text."""
    line = answers.select("element", F.posexplode(F.split("answer", "\n")).alias("pos", "line"))
    p = F.transform(F.split("line", "::"), lambda s: F.trim(s))
    known = ["string", "integer", "decimal", "double", "date", "time", "dateTime", "boolean"]
    kind = F.regexp_replace(p[1], "^xsd:", "")
    rows = line.filter(F.size(F.split("line", "::")) >= 2).select("element", "pos", F.regexp_replace(p[0], r"^[\s*-]+", "").alias("attribute"), F.concat(F.lit("xsd:"), F.when(kind.isin(known), kind).otherwise("string")).alias("xsd"), F.try_element_at(p, F.lit(3)).alias("description"))
    first = Window.partitionBy("element", name_key(F.col("attribute"))).orderBy("pos")
    return rows.filter("attribute <> ''").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "pos")


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that the cache has, and elements that it lacks."""
    hit = wanted.join(cache, "element")
    return hit, wanted.join(cache.select("element").distinct(), "element", "left_anti")


def cache_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace an element's old ones."""
    return old.join(new.select("element").distinct(), "element", "left_anti").unionByName(new)


class Versions:
    """Snapshots of a table as partitions ``v=<n>``, the newest ``depth`` of them; undo and redo move a pointer."""

    def __init__(self, spark: SparkSession, folder: str, depth: int = 50):
        self.spark, self.folder, self.depth, self.first, self.at, self.last = spark, folder.rstrip("/"), depth, 0, -1, -1

    def checkpoint(self, df: DataFrame) -> None:
        self.at += 1
        self.last = self.at
        self.first = max(self.first, self.at - self.depth)
        df.write.mode("overwrite").parquet(f"{self.folder}/v={self.at}")

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={self.at}")

    def undo(self) -> bool:
        if self.at <= self.first:
            return False
        self.at -= 1
        return True

    def redo(self) -> bool:
        if self.at >= self.last:
            return False
        self.at += 1
        return True
