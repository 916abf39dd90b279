"""Identity and merge: which mentions are one element, and what its fields are.

Nothing here loops: identity is windows over first-seen order, the fold of a
field is one aggregation. ``seq`` carries the order of the sources' passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.text import name_key

PRIORITY = ["A", "B", "C", "D"]


def identify(mentions: DataFrame) -> DataFrame:
    """Mentions ``(seq, name, eid, ...)`` with ``element_key``; blank names go.

    An id is its element from its first mention on. A name without id is the
    name's element; the first id seen under a name is promoted to it, any other
    id under the same name stays an element of its own.
    """
    rows = mentions.withColumn("name_key", name_key(F.col("name"))).filter("name_key <> ''")
    # mentions without id are spread, each a group of its own
    rows = rows.withColumn("id_group", F.coalesce(F.concat(F.lit("i"), "eid"), F.concat(F.lit("n"), F.col("seq").cast("string"))))
    by_id = Window.partitionBy("id_group").orderBy("seq")
    rows = rows.withColumn("touches", F.row_number().over(by_id) == 1)
    whole = Window.partitionBy("name_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.when(F.col("touches"), F.col("eid")), ignorenulls=True).over(whole)
    own = F.when(F.col("eid").isNull() | (F.col("eid") == F.col("base")), F.col("name_key")).otherwise(F.concat("name_key", F.lit("#id:"), "eid"))
    rows = rows.withColumn("base", base).withColumn("own", own)
    whole_id = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("element_key", F.when(F.col("eid").isNull(), F.col("own")).otherwise(F.first("own").over(whole_id))).drop("id_group", "touches", "base", "own")


def fold(steps: Column, priority: list[str] | None = None) -> Column:
    """Fold an ordered array of ``(source, conf, value)`` to ``(source, conf,
    value, conflicts)``: a source replaces its own value; equal values (case and
    outer space aside) change nothing; otherwise priority, then confidence, then
    the newer value wins and the loser is logged."""
    order = F.array(*[F.lit(p) for p in (priority or PRIORITY)])
    lost = "struct<source:string,conf:double,value:string,resolution:string>"
    zero = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("string").alias("value"), F.array().cast(f"array<{lost}>").alias("conflicts"))

    def made(x: Column, conflicts: Column) -> Column:
        return F.struct(x["source"].alias("source"), x["conf"].alias("conf"), x["value"].alias("value"), conflicts.alias("conflicts"))

    def step(acc: Column, x: Column) -> Column:
        a, b = F.array_position(order, acc["source"]), F.array_position(order, x["source"])
        ranked = (a > 0) & (b > 0) & (a != b)
        keeps = F.when(ranked, a < b).otherwise(acc["conf"] > x["conf"])
        why = F.when(ranked, "priority").when(acc["conf"] != x["conf"], "confidence").otherwise("recency")
        loser = lambda y: F.array(F.struct(y["source"].alias("source"), y["conf"].alias("conf"), y["value"].alias("value"), why.alias("resolution")))
        return (
            F.when(acc["source"].isNull() | (acc["source"] == x["source"]), made(x, acc["conflicts"]))
            .when(F.lower(F.trim(acc["value"])) == F.lower(F.trim(x["value"])), acc)
            .when(keeps, made(acc, F.concat(acc["conflicts"], loser(x))))
            .otherwise(made(x, F.concat(acc["conflicts"], loser(acc))))
        )

    return F.aggregate(steps, zero, step)


def fold_field(rows: DataFrame, field: str, priority: list[str] | None = None) -> DataFrame:
    """``(element_key, source, conf, value, conflicts)`` of one field by the ordered fold."""
    filled = rows.filter(F.coalesce(F.trim(field), F.lit("")) != "")
    steps = filled.groupBy("element_key").agg(F.array_sort(F.collect_list(F.struct("seq", "source", "conf", F.col(field).alias("value")))).alias("steps"))
    return steps.select("element_key", fold(F.col("steps"), priority).alias("r")).select("element_key", "r.*")


def fold_in_passes(rows: DataFrame, field: str) -> DataFrame:
    """What ``fold_field`` gives with the default priority when sources come pass
    by pass in that order, with the number of conflicts instead of their log.

    The first source keeps its last value and every later, different value is a
    conflict, so counts by value are enough and a hot element is no long array.
    """
    filled = rows.filter(F.coalesce(F.trim(field), F.lit("")) != "")
    value = F.lower(F.trim(field)).alias("norm")
    counts = filled.groupBy("element_key", "source", value).agg(F.count("*").alias("n"), F.max(F.struct("seq", F.col(field).alias("value"), "conf")).alias("last"))
    first = F.min(F.struct("source", (-F.col("last.seq")).alias("at"), "norm", F.col("last.value").alias("value"), F.col("last.conf").alias("conf")))
    seen = counts.groupBy("element_key").agg(first.alias("w"), F.collect_list(F.struct("source", "norm", "n")).alias("all"))
    lost = F.aggregate(F.filter("all", lambda x: (x["source"] != F.col("w.source")) & (x["norm"] != F.col("w.norm"))), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return seen.select("element_key", F.col("w.source").alias("source"), F.col("w.conf").alias("conf"), F.col("w.value").alias("value"), lost.alias("conflicts"))


def fuse(mentions: DataFrame) -> DataFrame:
    """One row an element: name, sources, mentions, documents, fields with source
    and confidence, conflicts, mean confidence of the fields, review flag."""
    rows = identify(mentions)
    cited = F.col("citation") if "citation" in mentions.columns else F.lit(None).cast("string")
    base = rows.groupBy("element_key").agg(
        F.min_by("name", "seq").alias("name"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.count("*").alias("mentions"), F.count_distinct("document").alias("documents"),
        F.bool_or(F.coalesce("critical", F.lit(False))).alias("critical"), F.max(F.col("source") == "B").alias("governed"),
        F.min_by(F.trim(cited), F.when(F.coalesce(F.trim(cited), F.lit("")) != "", F.col("seq"))).alias("citation"),
    )
    definition = fold_in_passes(rows, "definition").select("element_key", F.col("value").alias("definition"), F.col("source").alias("definition_source"), F.col("conf").alias("definition_conf"), F.col("conflicts").alias("definition_conflicts"))
    domain = fold_in_passes(rows, "domain").select("element_key", F.col("value").alias("domain"), F.col("conf").alias("domain_conf"))
    out = base.join(definition, "element_key", "left").join(domain, "element_key", "left")
    scores = F.filter(F.array("definition_conf", "domain_conf"), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)
    conflicts = F.coalesce("definition_conflicts", F.lit(0))
    return out.withColumn("conflicts", conflicts.cast("long")).withColumn("confidence", mean).withColumn("needs_review", mean < 0.7).drop("definition_conflicts", "definition_conf", "domain_conf")


#: DuckDB: ``m`` (identified mentions of a and b) and ``f`` (fused elements).
def identified_sql(name_key: str) -> str:
    return f"""k AS (
  SELECT *, {name_key.format('name')} AS name_key FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
), k1 AS (
  SELECT *, CASE WHEN eid IS NULL THEN true ELSE row_number() OVER (PARTITION BY eid ORDER BY seq) = 1 END AS touches FROM k WHERE name_key <> ''
), k2 AS (
  SELECT *, first_value(CASE WHEN touches THEN eid END IGNORE NULLS) OVER (PARTITION BY name_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM k1
), k3 AS (
  SELECT *, CASE WHEN eid IS NULL OR eid = base THEN name_key ELSE name_key || '#id:' || eid END AS own FROM k2
), m AS (
  SELECT *, CASE WHEN eid IS NULL THEN own ELSE first_value(own) OVER (PARTITION BY eid ORDER BY seq) END AS element_key FROM k3
)"""


def fused_sql() -> str:
    def folded(field: str) -> str:
        start = f"struct_pack(source := source, conf := conf, value := {field}, n := 0)"
        return f"""SELECT element_key, list_reduce(list({start} ORDER BY seq), lambda x, y: CASE
    WHEN x.source = y.source THEN struct_pack(source := y.source, conf := y.conf, value := y.value, n := x.n)
    WHEN lower(trim(x.value)) = lower(trim(y.value)) THEN x
    WHEN x.source < y.source THEN struct_pack(source := x.source, conf := x.conf, value := x.value, n := x.n + 1)
    ELSE struct_pack(source := y.source, conf := y.conf, value := y.value, n := x.n + 1) END) AS r FROM m WHERE coalesce(trim({field}), '') <> '' GROUP BY element_key"""

    return f"""f AS (
  SELECT g.*, d.r.value AS definition, d.r.source AS definition_source, e.r.value AS domain, coalesce(d.r.n, 0)::BIGINT AS conflicts,
    CASE WHEN d.r IS NULL AND e.r IS NULL THEN 0.0 ELSE (coalesce(d.r.conf, 0) + coalesce(e.r.conf, 0)) / ((d.r IS NOT NULL)::INT + (e.r IS NOT NULL)::INT) END AS confidence
  FROM (SELECT element_key, arg_min(name, seq) AS name, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources, count(*) AS mentions, count(DISTINCT document) AS documents,
      bool_or(coalesce(critical, false)) AS critical, bool_or(source = 'B') AS governed, arg_min(trim(citation), seq) FILTER (WHERE coalesce(trim(citation), '') <> '') AS citation FROM m GROUP BY element_key) g
  LEFT JOIN ({folded('definition')}) d USING (element_key) LEFT JOIN ({folded('domain')}) e USING (element_key)
)"""
