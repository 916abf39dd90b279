"""Counters over fused elements, in long form ``(metric, value)``, and reference comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_counts(fused: DataFrame) -> DataFrame:
    """All, governed, of several sources, and by combination of sources, in one pass."""
    grouped = fused.groupBy("sources").agg(F.count("*").alias("n"), F.count_if("governed").alias("g"))
    rows = grouped.select(F.explode(F.array(
        F.struct(F.lit("total").alias("metric"), F.col("n").alias("value")),
        F.struct(F.lit("governed").alias("metric"), F.col("g").alias("value")),
        F.struct(F.lit("multi_source").alias("metric"), F.when(F.contains("sources", F.lit("+")), F.col("n")).otherwise(0).alias("value")),
        F.struct(F.concat(F.lit("sources "), F.col("sources")).alias("metric"), F.col("n").alias("value")),
    )).alias("r"))
    return rows.groupBy("r.metric").agg(F.sum("r.value").alias("value"))


def confidence_stats(fused: DataFrame) -> DataFrame:
    """Least, median, mean, greatest, buckets and reviews."""
    c = F.col("confidence")
    return fused.agg(
        F.min(c).alias("least"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.max(c).alias("greatest"),
        F.count_if(c < 0.5).alias("below_50"), F.count_if((c >= 0.5) & (c < 0.7)).alias("below_70"), F.count_if((c >= 0.7) & (c < 0.9)).alias("below_90"), F.count_if(c >= 0.9).alias("from_90"),
        F.count_if("needs_review").alias("needs_review"),
    )


def corroboration(fused: DataFrame) -> DataFrame:
    """Elements by their number of documents; none is not counted."""
    d = F.col("documents")
    return fused.filter(d > 0).groupBy(F.when(d == 1, "1").when(d == 2, "2").otherwise("3+").alias("documents")).agg(F.count("*").alias("elements"))


def comparison_key(eid: Column, kind: Column, name_key: Column) -> Column:
    """Comparison key: id, else type and name, else name."""
    return F.coalesce(F.concat(F.lit("id:"), eid), F.concat(F.lit("name:"), kind, F.lit(":"), name_key), F.concat(F.lit("name:"), name_key))


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counts and of precision, recall and F1 over distinct keys."""
    both = found.select(*keys).distinct().withColumn("in_found", F.lit(1)).join(truth.select(*keys).distinct().withColumn("in_truth", F.lit(1)), keys, "full_outer")
    counts = both.agg(F.count_if(F.col("in_found").isNotNull() & F.col("in_truth").isNotNull()).alias("tp"), F.count_if(F.col("in_truth").isNull()).alias("fp"), F.count_if(F.col("in_found").isNull()).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    scored = counts.withColumn("precision", p).withColumn("recall", r)
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
