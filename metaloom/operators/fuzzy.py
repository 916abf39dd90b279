"""Joins by similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.text import match_score, name_similarity


def duplicate_names(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Unordered pairs of names with similarity >= threshold.

    Similarity needs containment, so each name's substrings of at least the
    threshold's share of its length are joined by equality; no product of all pairs.
    """
    rows = names.select("name").distinct().withColumn("k", F.regexp_replace(F.lower("name"), "[_-]", ""))
    n = F.length("k")
    least = F.ceil(n * threshold - 1e-9)
    lengths = rows.filter(n > 0).withColumn("size", F.explode(F.sequence(F.greatest(least, F.lit(1)).cast("int"), n)))
    parts = lengths.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("k") - F.col("size") + 1))).select(F.col("name").alias("long"), F.expr("substring(k, at, size)").alias("k")).distinct()
    hits = rows.select(F.col("name").alias("short"), "k").join(parts, "k").filter("short <> long")
    pairs = hits.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    return pairs.withColumn("similarity", name_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold)


def best_matches(models: DataFrame, concepts: DataFrame, least: float = 0.4) -> DataFrame:
    """For each model name the concept with the best score, the first by name on ties.

    Models are a schema's names, a profile-sized side; the nested loop runs over the other.
    """
    scored = concepts.select("concept").distinct().crossJoin(models.select("model").distinct()).withColumn("score", match_score(F.col("model"), F.col("concept"))).filter(F.col("score") >= least)
    best = Window.partitionBy("model").orderBy(F.desc("score"), "concept")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def enriched(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """A term meets the concept of its name (.85), else the first that holds its
    name or is held by it (.75), else it is new (.40)."""
    t = terms.select("term").distinct()
    c = concepts.select("concept").distinct()
    equal = t.join(c, F.lower("term") == F.lower("concept")).groupBy("term").agg(F.min("concept").alias("concept")).withColumn("score", F.lit(0.85))
    rest = t.join(equal, "term", "left_anti")
    part = rest.join(c, F.contains(F.lower("term"), F.lower("concept")) | F.contains(F.lower("concept"), F.lower("term"))).groupBy("term").agg(F.min("concept").alias("concept")).withColumn("score", F.lit(0.75))
    new = rest.join(part, "term", "left_anti").select("term", F.lit(None).cast("string").alias("concept"), F.lit(0.40).alias("score"))
    return equal.union(part).union(new)
