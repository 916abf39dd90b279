"""Discovery: candidates from four sources, their strength, degree, relevance and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.text import label_key

WEIGHTS = {"a": 0.25, "b": 0.20, "c": 0.15, "d": 0.10, "degree": 0.10, "definition": 0.10, "naming": 0.10}
BANDS = {"core_business": 0.70, "supporting_technical": 0.40}
_RANKS = ["weak", "medium", "strong"]


def merge_keys(events: DataFrame) -> DataFrame:
    """Events ``(seq, source, label, kind, eid, ...)`` with ``merge_key``.

    Ids come first, as in fusion. Once a second id is known under a name, later
    mentions without id are ambiguous; before that they belong to the name, or,
    where their kind is not that of the name's first mention, to a name of their kind.
    """
    rows = events.withColumn("norm", label_key(F.col("label"))).filter("norm <> ''")
    rows = rows.withColumn("g", F.coalesce(F.concat(F.lit("i"), "eid"), F.concat(F.lit("n"), F.col("seq").cast("string"), F.col("norm"))))
    by_id = Window.partitionBy("g").orderBy("seq")
    rows = rows.withColumn("reg", F.col("eid").isNotNull() & (F.row_number().over(by_id) == 1)).withColumn("touch", F.col("reg") | F.col("eid").isNull())
    whole = Window.partitionBy("norm").orderBy("seq", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("base", F.first(F.when(F.col("touch"), F.col("eid")), ignorenulls=True).over(whole))
    rows = rows.withColumn("owner", F.first(F.when(F.col("touch"), F.col("kind")), ignorenulls=True).over(whole))
    rows = rows.withColumn("amb", F.min(F.when(F.col("reg") & (F.col("eid") != F.col("base")), F.col("seq"))).over(whole))
    plain = (
        F.when(F.col("eid").isNotNull(), F.when(F.col("eid") == F.col("base"), F.col("norm")).otherwise(F.concat("norm", F.lit("#id:"), "eid")))
        .when(F.col("seq") > F.col("amb"), F.concat("norm", F.lit("#ambiguous")))
        .when(F.col("kind") == F.col("owner"), F.col("norm"))
        .otherwise(F.concat("norm", F.lit("#kind:"), "kind"))
    )
    rows = rows.withColumn("own", plain)
    whole_id = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("merge_key", F.when(F.col("eid").isNull(), F.col("own")).otherwise(F.first("own").over(whole_id))).drop("g", "reg", "touch", "base", "owner", "amb", "own")


def boosted(strength: Column, source: Column) -> Column:
    """G05, as an aggregate: the strongest, one tier more with two axes (A or B, C, D)."""
    rank = F.array_position(F.array(*map(F.lit, _RANKS)), strength) - 1
    axis = F.when(source.isin("A", "B"), "semantic").when(source == "C", "structural").otherwise("executable")
    top = F.least(F.lit(2), F.max(F.when(rank < 0, 1).otherwise(rank)) + (F.count_distinct(axis) >= 2).cast("int"))
    return F.element_at(F.array(*map(F.lit, _RANKS)), (top + 1).cast("int"))


def candidates(events: DataFrame) -> DataFrame:
    """One row a merge key, with counts by source."""
    keyed = merge_keys(events)
    return keyed.groupBy("merge_key").agg(
        F.min_by("label", "seq").alias("label"), F.min_by("kind", "seq").alias("kind"), F.min("norm").alias("norm"), F.count_distinct("label").alias("aliases"),
        *[F.count_if(F.col("source") == s).alias(f"n_{s.lower()}") for s in "ABCD"], boosted(F.col("strength"), F.col("source")).alias("strength"), F.max(F.trim("definition")).alias("definition"),
    )


def degrees(triples: DataFrame) -> DataFrame:
    """Distinct undirected neighbours by label key; loops do not count."""
    e = triples.select(label_key(F.col("s")).alias("x"), label_key(F.col("o")).alias("y")).filter("x <> y").distinct()
    return e.union(e.select("y", "x")).distinct().groupBy(F.col("x").alias("norm")).agg(F.count("*").alias("degree"))


def relevance(found: DataFrame) -> DataFrame:
    """Weighted signals, their sum from left to right, and the band."""
    naming = F.when(F.lower("label").rlike("^tmp_|_id$"), 0.1).otherwise(0.8)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w = WEIGHTS
    score = w["a"] * clip(F.col("n_a") / 3) + w["b"] * (F.col("n_b") > 0).cast("double") + w["c"] * (F.col("n_c") > 0).cast("double") + w["d"] * (F.col("n_d") > 0).cast("double")
    score = score + w["degree"] * clip(F.coalesce("degree", F.lit(0)) / 5) + w["definition"] * (F.coalesce("definition", F.lit("")) != "").cast("double") + w["naming"] * naming
    return found.withColumn("score", score).withColumn("band", F.when(F.col("score") >= BANDS["core_business"], "core_business").when(F.col("score") >= BANDS["supporting_technical"], "supporting_technical").otherwise("noise"))


def disagreements(rules: DataFrame) -> DataFrame:
    """Subjects with two or more different predicates or values."""
    n = F.count_distinct("predicate", "tag", "value")
    return rules.groupBy("entity", "attribute").agg(n.alias("n"), F.count("*").alias("rules")).filter("n > 1")


def table_classes(fields: DataFrame, owners: dict[str, str]) -> DataFrame:
    """G08, with the table that each key name points to: columns, keys that point to other tables, keys that point here; a table
    of two such keys or more and nothing else is a bridge, one that is pointed to, has
    three columns at most and a name column is a code table."""
    key = F.regexp_extract("name", "^[a-z]+_([a-z]+)key$", 1)
    cols = fields.withColumn("target", F.when(key != "", key))
    target = F.create_map(*[F.lit(v) for p in owners.items() for v in p])
    cols = cols.withColumn("ref", F.try_element_at(target, F.col("target"))).withColumn("ref", F.when(F.col("ref") != F.col("model"), F.col("ref")))
    per = cols.groupBy("model").agg(F.count("*").alias("columns"), F.count("ref").alias("fk_out"), F.count_if(F.endswith("name", F.lit("_name"))).alias("names"))
    fk_in = cols.filter("ref IS NOT NULL").groupBy(F.col("ref").alias("model")).agg(F.count("*").alias("fk_in"))
    out = per.join(fk_in, "model", "left").withColumn("fk_in", F.coalesce("fk_in", F.lit(0)))
    code = (F.col("fk_in") > 0).cast("int") + (F.col("columns") <= 3).cast("int") + (F.col("names") > 0).cast("int") >= 2
    return out.withColumn("class", F.when((F.col("fk_out") >= 2) & (F.col("fk_out") == F.col("columns")), "bridge").when(code, "code_table").otherwise("entity")).drop("names")
