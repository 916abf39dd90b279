"""Constraint queries: validation against a profile, and lint.

Every check gives findings ``(rule, severity, kind, target, detail)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.text import is_present, name_key


def finding(rows: DataFrame, rule: str, severity: str | Column, kind: str, target: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(kind).alias("kind"), target.alias("target"), detail.alias("detail"))


def arrow(s: str = "s", p: str = "p", o: str = "o") -> Column:
    return F.concat(F.col(s), F.lit("->"), F.col(p), F.lit("->"), F.col(o))


def entity_id(rows: DataFrame) -> Column:
    return F.coalesce(F.col("eid"), name_key(F.col("name")))


def unique(entities: DataFrame) -> DataFrame:
    """VR001: every entity after the first with an id (its name's key where it has none)."""
    w = Window.partitionBy("id").orderBy("seq")
    rows = entities.withColumn("id", entity_id(entities)).withColumn("n", F.row_number().over(w)).withColumn("first_name", F.first("name").over(w))
    return finding(rows.filter("n > 1"), "VR001", "error", "entity", F.col("id"), F.concat(F.col("name"), F.lit(" repeats "), F.col("first_name")))


def typed(entities: DataFrame, types: DataFrame) -> DataFrame:
    """VR002: entities without a type, or with one that the profile lacks (case aside)."""
    known = types.select(F.lower("type").alias("known"))
    rows = entities.join(F.broadcast(known), F.lower(F.trim("entity_type")) == F.col("known"), "left").filter("known IS NULL")
    return finding(rows, "VR002", "error", "entity", entity_id(entities), F.coalesce(F.nullif(F.trim("entity_type"), F.lit("")), F.lit("missing")))


def required_fields(entities: DataFrame, types: DataFrame, required: DataFrame, fields: list[str]) -> DataFrame:
    """VR003: one warning an entity with the fields missing; a subtype has its parent's."""
    present = F.array(*[F.when(is_present(F.col(f).cast("string")), F.lit(f)) for f in fields])
    parents = types.select(F.lower("type").alias("t"), F.coalesce("parent", "type").alias("owner"))
    rows = entities.withColumn("present", present).join(F.broadcast(parents), F.lower("entity_type") == F.col("t")).join(F.broadcast(required), F.lower("owner") == F.lower("type"))
    rows = rows.withColumn("missing", F.array_sort(F.array_except("fields", "present"))).filter(F.size("missing") > 0)
    return finding(rows, "VR003", "warning", "entity", entity_id(entities), F.array_join("missing", ","))


def known_predicates(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """VR004: triples with a predicate that the profile lacks."""
    rows = triples.join(F.broadcast(predicates.select(F.lower("predicate").alias("known"))), F.lower("p") == F.col("known"), "left_anti")
    return finding(rows, "VR004", "error", "relationship", arrow(), F.col("p"))


def endpoint_types(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Types of both ends, by id first, else by the name's key; the first entity counts."""
    by_id = entities.filter("eid IS NOT NULL").groupBy("eid").agg(F.min_by("entity_type", "seq").alias("t"))
    by_name = entities.groupBy(name_key(F.col("name")).alias("k")).agg(F.min_by("entity_type", "seq").alias("t"))
    out = triples
    for end in ("s", "o"):
        ids = by_id.select(F.col("eid").alias(f"{end}_eid"), F.col("t").alias(f"{end}_by_id"))
        names = by_name.select(F.col("k").alias(f"{end}_key"), F.col("t").alias(f"{end}_by_name"))
        out = out.join(ids, F.col(end) == F.col(f"{end}_eid"), "left").join(names, name_key(F.col(end)) == F.col(f"{end}_key"), "left")
        out = out.withColumn(f"{end}_type", F.coalesce(f"{end}_by_id", f"{end}_by_name")).drop(f"{end}_eid", f"{end}_by_id", f"{end}_key", f"{end}_by_name")
    return out


def domains_and_ranges(triples: DataFrame, entities: DataFrame, predicates: DataFrame, types: DataFrame) -> DataFrame:
    """VR005: a side whose type is neither allowed nor a subtype of one allowed; unknown types are skipped."""
    rows = endpoint_types(triples, entities).join(F.broadcast(predicates), F.lower("p") == F.lower("predicate")).filter("s_type IS NOT NULL AND o_type IS NOT NULL")
    out = []
    for end, allowed in (("s", "subjects"), ("o", "objects")):
        # a type stands for its declared name, case aside, a subtype for its parent
        declared = types.select(F.lower("type").alias("t"), F.coalesce("parent", "type").alias("declared"))
        side = rows.join(F.broadcast(declared), F.lower(F.col(f"{end}_type")) == F.col("t"), "left")
        bad = side.filter(~F.array_contains(allowed, F.col(f"{end}_type")) & ~F.coalesce(F.array_contains(allowed, F.col("declared")), F.lit(False)))
        out.append(finding(bad, "VR005", "warning", "relationship", arrow(), F.concat(F.lit(f"{allowed}: "), F.col(f"{end}_type"))))
    return out[0].union(out[1])


def cardinalities(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """VR006: several objects of a subject (1:1, N:1), several subjects of an object (1:1, 1:N); ends as they are written."""
    rows = triples.join(F.broadcast(predicates), F.lower("p") == F.lower("predicate"))
    out = []
    for one, many, kinds in (("s", "o", ["1:1", "N:1"]), ("o", "s", ["1:1", "1:N"])):
        n = rows.filter(F.col("cardinality").isin(kinds)).groupBy("p", one).agg(F.count_distinct(many).alias("n")).filter("n > 1")
        out.append(finding(n, "VR006", "warning", "relationship", F.concat(F.col(one), F.lit(" "), F.col("p")), F.col("n").cast("string")))
    return out[0].union(out[1])


def required_attributes(entities: DataFrame, attributes: DataFrame, types: DataFrame, required: DataFrame) -> DataFrame:
    """VR007: one warning a missing declared attribute. attributes: ``(name_key, attribute)``."""
    parents = types.select(F.lower("type").alias("t"), F.coalesce("parent", "type").alias("owner"))
    wanted = entities.join(F.broadcast(parents), F.lower("entity_type") == F.col("t")).join(F.broadcast(required.select(F.lower("type").alias("rt"), "attribute")), F.lower("owner") == F.col("rt"))
    wanted = wanted.withColumn("k", name_key(F.col("name"))).withColumn("ak", name_key(F.col("attribute")))
    have = attributes.select(F.col("name_key").alias("k"), name_key(F.col("attribute")).alias("ak")).filter("ak <> ''").distinct()
    return finding(wanted.join(have, ["k", "ak"], "left_anti"), "VR007", "warning", "entity", F.coalesce("eid", "k"), F.col("attribute"))


def survivors(entities: DataFrame, triples: DataFrame, types: DataFrame, predicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """the rows that filter mode keeps: no repeated or untyped entities, no
    unknown predicates, and no relationship of an entity that went."""
    w = Window.partitionBy("id").orderBy("seq")
    known = types.select(F.lower("type").alias("known"))
    first = entities.withColumn("id", entity_id(entities)).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    kept = first.join(F.broadcast(known), F.lower(F.trim("entity_type")) == F.col("known"), "left_semi")
    fine = triples.join(F.broadcast(predicates.select(F.lower("predicate").alias("known"))), F.lower("p") == F.col("known"), "left_semi")
    keys = kept.select(name_key(F.col("name")).alias("key")).union(kept.select("id")).distinct()
    for end in ("s", "o"):
        fine = fine.withColumn("key", name_key(F.col(end))).join(keys, "key", "left_semi").drop("key")
    return kept, fine


def ends(triples: DataFrame) -> DataFrame:
    """Both ends of each triple in long form ``(name, role)``."""
    return triples.select(F.explode(F.array(F.struct(F.col("s").alias("name"), F.lit("subject").alias("role")), F.struct(F.col("o").alias("name"), F.lit("object").alias("role")))).alias("e")).select("e.*")


def orphans(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities in no triple; none where there is no triple at all."""
    used = ends(triples).select(name_key(F.col("name")).alias("key")).distinct()
    some = triples.agg(F.count("*").alias("all_triples")).filter("all_triples > 0")
    rows = entities.withColumn("key", name_key(F.col("name"))).join(used, "key", "left_anti").crossJoin(F.broadcast(some))
    return finding(rows, "orphan", "warning", "entity", F.col("key"), F.col("name"))


def undefined(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Ends that no entity defines, each once with the role of the first (subjects first)."""
    known = entities.select(name_key(F.col("name")).alias("key")).distinct()
    used = ends(triples).withColumn("key", name_key(F.col("name"))).join(known, "key", "left_anti")
    rows = used.groupBy("key").agg(F.max("role").alias("role"), F.min("name").alias("name"))
    return finding(rows, "undefined", "warning", "entity", F.col("key"), F.concat("name", F.lit(" as "), "role"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_rule(findings: DataFrame) -> DataFrame:
    """Counts by rule and severity, with totals."""
    rolled = findings.rollup("rule", "severity").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("rule", F.lit("all")).alias("rule"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")
