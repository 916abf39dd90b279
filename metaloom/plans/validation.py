"""Queries of validation and lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions.text import name_key
from metaloom.operators import validate as v
from metaloom.sources import bindings as b
from metaloom.sources.bindings import NAME_KEY_SQL, table

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FIELDS = ["definition", "citation"]


def types(spark):
    return spark.createDataFrame([(t, None) for t in ("Region", "Nation", "Supplier", "Part")] + [(t, "Part") for t in PART_TYPES], "type string, parent string")


def predicates(spark):
    return spark.createDataFrame([("in", ["Nation"], ["Region"], "N:1"), ("based in", ["Supplier"], ["Region"], "1:1"), ("supplies", ["Supplier"], ["Part"], "1:N")], "predicate string, subjects array<string>, objects array<string>, cardinality string")


def entities(spark, d):
    n = F.lit(None).cast("string")
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("name"), n.alias("eid"), F.lit("Region").alias("entity_type"), n.alias("definition"), n.alias("citation"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 10**9).alias("seq"), F.col("n_name").alias("name"), n.alias("eid"), F.lit("nation").alias("entity_type"), F.lit("a nation").alias("definition"), n.alias("citation"))
    k = F.col("s_suppkey") % 10
    supplier = table(spark, d, "supplier").select((F.col("s_suppkey") + 2 * 10**9).alias("seq"), F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("eid"), F.when(k == 0, n).when(k == 1, "Vendor").otherwise("Supplier").alias("entity_type"), F.when(k > 5, "a supplier").otherwise(" ").alias("definition"), n.alias("citation"))
    part = table(spark, d, "part").select((F.col("p_partkey") + 10**12).alias("seq"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("P"), (F.col("p_partkey") % 300).cast("string"))).alias("eid"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("definition"), F.when(F.col("p_size") > 30, "annex 1").alias("citation"))
    return region.union(nation).union(supplier).union(part)


def triples(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return b.triples(spark, d).select("s", "p", "o").union(orders.select("c_name", F.lit("places"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))))


def vr001_duplicates(spark, d):
    return v.unique(entities(spark, d))


def vr002_types(spark, d):
    return v.typed(entities(spark, d), types(spark))


def vr003_required_fields(spark, d):
    required = spark.createDataFrame([("Part", ["definition", "citation"]), ("Supplier", ["definition"])], "type string, fields array<string>")
    return v.required_fields(entities(spark, d), types(spark), required, FIELDS)


def vr004_predicates(spark, d):
    return v.known_predicates(triples(spark, d), predicates(spark))


def vr005_domains(spark, d):
    return v.domains_and_ranges(triples(spark, d), entities(spark, d), predicates(spark), types(spark))


def vr006_cardinality(spark, d):
    return v.cardinalities(triples(spark, d), predicates(spark))


def vr007_required_attributes(spark, d):
    required = spark.createDataFrame([("Supplier", "based in"), ("Part", "size"), ("Nation", "Nation_key")], "type string, attribute string")
    have = triples(spark, d).select(name_key(F.col("s")).alias("name_key"), F.col("p").alias("attribute"))
    return v.required_attributes(entities(spark, d), have, types(spark), required)


def validate_filter_survivors(spark, d):
    kept, _ = v.survivors(entities(spark, d), triples(spark, d), types(spark), predicates(spark))
    return kept.select("id", "name", "entity_type")


def cascade_dropped_triples(spark, d):
    t = triples(spark, d)
    _, fine = v.survivors(entities(spark, d), t, types(spark), predicates(spark))
    return t.select("s", "p", "o").join(fine.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").groupBy("p").agg(F.count("*").alias("dropped"))


def orphans(spark, d):
    return v.orphans(entities(spark, d), triples(spark, d))


def undefined_used(spark, d):
    return v.undefined(entities(spark, d), triples(spark, d))


def lint_summary(spark, d):
    e, t = entities(spark, d), triples(spark, d)
    return v.by_rule(v.all_findings([v.unique(e), v.typed(e, types(spark)), v.known_predicates(t, predicates(spark)), v.cardinalities(t, predicates(spark)), v.orphans(e, t), v.undefined(e, t)]))


def profile_coverage(spark, d):
    """Declared types, subtypes and predicates that nothing uses."""
    used = entities(spark, d).select(F.lower("entity_type").alias("u")).filter("u IS NOT NULL").distinct()
    declared = types(spark).union(spark.createDataFrame([("Customer", None), ("Bulky", "Part")], "type string, parent string"))
    kinds = declared.select(F.when(F.col("parent").isNull(), "type").otherwise("subtype").alias("kind"), F.when(F.col("parent").isNull(), F.col("type")).otherwise(F.concat_ws(".", "parent", "type")).alias("name"), F.lower("type").alias("u"))
    unused = kinds.filter(~((F.col("kind") == "type") & (F.col("name") == "Part"))).join(used, "u", "left_anti").select("kind", "name")
    preds = predicates(spark).select("predicate").union(spark.createDataFrame([("owns",)], "predicate string"))
    spare = preds.withColumn("u", F.lower("predicate")).join(triples(spark, d).select(F.lower("p").alias("u")).distinct(), "u", "left_anti").select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"))
    return unused.union(spare)


_N = NAME_KEY_SQL
_E = f"""WITH {b.TRIPLES}, e0 AS (
  SELECT r_regionkey::BIGINT AS seq, r_name AS name, NULL::VARCHAR AS eid, 'Region' AS entity_type, NULL::VARCHAR AS definition, NULL::VARCHAR AS citation FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 1000000000, n_name, NULL, 'nation', 'a nation', NULL FROM nation
  UNION ALL SELECT s_suppkey + 2000000000, s_name, 'S' || s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Vendor' ELSE 'Supplier' END, CASE WHEN s_suppkey % 10 > 5 THEN 'a supplier' ELSE ' ' END, NULL FROM supplier
  UNION ALL SELECT p_partkey + 1000000000000, p_name, CASE WHEN p_partkey % 50 = 0 THEN 'P' || (p_partkey % 300) END, p_type, p_brand, CASE WHEN p_size > 30 THEN 'annex 1' END FROM part
), e AS (SELECT *, {_N.format('name')} AS k, coalesce(eid, {_N.format('name')}) AS id FROM e0),
ty AS (SELECT * FROM (VALUES ('Region', NULL), ('Nation', NULL), ('Supplier', NULL), ('Part', NULL), {', '.join(f"('{t}', 'Part')" for t in PART_TYPES)}) AS x(type, parent)),
pr AS (SELECT * FROM (VALUES ('in', ['Nation'], ['Region'], 'N:1'), ('based in', ['Supplier'], ['Region'], '1:1'), ('supplies', ['Supplier'], ['Part'], '1:N')) AS x(predicate, subjects, objects, cardinality)),
r AS (SELECT s, p, o FROM t UNION ALL SELECT c_name, 'places', 'order ' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
_F = {
    "001": "SELECT 'VR001' AS rule, 'error' AS severity, 'entity' AS kind, id AS target, name || ' repeats ' || first_name AS detail FROM (SELECT *, row_number() OVER w AS n, first_value(name) OVER w AS first_name FROM e WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE n > 1",
    "002": "SELECT 'VR002' AS rule, 'error' AS severity, 'entity' AS kind, id AS target, coalesce(nullif(trim(entity_type), ''), 'missing') AS detail FROM e LEFT JOIN ty ON lower(trim(entity_type)) = lower(type) WHERE type IS NULL",
    "004": "SELECT 'VR004' AS rule, 'error' AS severity, 'relationship' AS kind, s || '->' || p || '->' || o AS target, p AS detail FROM r WHERE lower(p) NOT IN (SELECT lower(predicate) FROM pr)",
    "006": "SELECT 'VR006' AS rule, 'warning' AS severity, 'relationship' AS kind, s || ' ' || p AS target, count(DISTINCT o)::VARCHAR AS detail FROM r JOIN pr ON lower(p) = lower(predicate) WHERE cardinality IN ('1:1', 'N:1') GROUP BY p, s HAVING count(DISTINCT o) > 1 UNION ALL SELECT 'VR006', 'warning', 'relationship', o || ' ' || p, count(DISTINCT s)::VARCHAR FROM r JOIN pr ON lower(p) = lower(predicate) WHERE cardinality IN ('1:1', '1:N') GROUP BY p, o HAVING count(DISTINCT s) > 1",
    "orphan": f"SELECT 'orphan' AS rule, 'warning' AS severity, 'entity' AS kind, k AS target, name AS detail FROM e WHERE k NOT IN (SELECT {_N.format('s')} FROM r UNION SELECT {_N.format('o')} FROM r)",
    "undefined": f"SELECT 'undefined' AS rule, 'warning' AS severity, 'entity' AS kind, k AS target, min(name) || ' as ' || max(role) AS detail FROM (SELECT {_N.format('s')} AS k, s AS name, 'subject' AS role FROM r UNION ALL SELECT {_N.format('o')}, o, 'object' FROM r) WHERE k NOT IN (SELECT k FROM e) GROUP BY k",
}
_OWNED = "(SELECT e.*, coalesce(parent, type) AS owner FROM e JOIN ty ON lower(entity_type) = lower(type))"
_KEPT = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM e) WHERE n = 1 AND lower(trim(entity_type)) IN (SELECT lower(type) FROM ty)), keys AS (SELECT k FROM kept UNION SELECT id FROM kept)"
_SIDE = "SELECT 'VR005' AS rule, 'warning' AS severity, 'relationship' AS kind, s || '->' || p || '->' || o AS target, '{a}: ' || {e}_type AS detail FROM x LEFT JOIN ty ON lower({e}_type) = lower(type) WHERE NOT list_contains({a}, {e}_type) AND NOT coalesce(list_contains({a}, coalesce(parent, type)), false)"

ORACLES = {
    "vr001_duplicates": f"{_E} {_F['001']}",
    "vr002_types": f"{_E} {_F['002']}",
    "vr003_required_fields": f"{_E}, q AS (SELECT *, CASE owner WHEN 'Part' THEN ['citation', 'definition'] ELSE ['definition'] END AS need FROM {_OWNED} WHERE owner IN ('Part', 'Supplier')), z AS (SELECT id, list_filter(need, lambda f: (f = 'definition' AND coalesce(trim(definition), '') = '') OR (f = 'citation' AND coalesce(trim(citation), '') = '')) AS m FROM q) SELECT 'VR003' AS rule, 'warning' AS severity, 'entity' AS kind, id AS target, array_to_string(m, ',') AS detail FROM z WHERE len(m) > 0",
    "vr004_predicates": f"{_E} {_F['004']}",
    "vr005_domains": f"{_E}, bi AS (SELECT eid, arg_min(entity_type, seq) AS ty0 FROM e WHERE eid IS NOT NULL GROUP BY eid), bn AS (SELECT k, arg_min(entity_type, seq) AS ty0 FROM e GROUP BY k), x AS (SELECT r.*, subjects, objects, coalesce(i.ty0, n.ty0) AS s_type, coalesce(i2.ty0, n2.ty0) AS o_type FROM r JOIN pr ON lower(p) = lower(predicate) LEFT JOIN bi i ON s = i.eid LEFT JOIN bn n ON {_N.format('s')} = n.k LEFT JOIN bi i2 ON o = i2.eid LEFT JOIN bn n2 ON {_N.format('o')} = n2.k WHERE coalesce(i.ty0, n.ty0) IS NOT NULL AND coalesce(i2.ty0, n2.ty0) IS NOT NULL) {_SIDE.format(a='subjects', e='s')} UNION ALL {_SIDE.format(a='objects', e='o')}",
    "vr006_cardinality": f"{_E} {_F['006']}",
    "vr007_required_attributes": f"{_E}, need AS (SELECT id, k, a FROM {_OWNED} JOIN (VALUES ('Supplier', 'based in'), ('Part', 'size'), ('Nation', 'Nation_key')) AS q(ty, a) ON owner = ty) SELECT 'VR007' AS rule, 'warning' AS severity, 'entity' AS kind, id AS target, a AS detail FROM need WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_N.format('s')} = need.k AND {_N.format('p')} = {_N.format('need.a')})",
    "validate_filter_survivors": f"{_E}, {_KEPT} SELECT id, name, entity_type FROM kept",
    "cascade_dropped_triples": f"{_E}, {_KEPT} SELECT p, count(*) AS dropped FROM r WHERE lower(p) NOT IN (SELECT lower(predicate) FROM pr) OR {_N.format('s')} NOT IN (SELECT * FROM keys) OR {_N.format('o')} NOT IN (SELECT * FROM keys) GROUP BY p",
    "orphans": f"{_E} {_F['orphan']}",
    "undefined_used": f"{_E} {_F['undefined']}",
    "lint_summary": f"{_E}, al AS ({' UNION ALL '.join('(' + q + ')' for q in _F.values())}) SELECT coalesce(rule, 'all') AS rule, coalesce(severity, 'all') AS severity, count(*) AS n FROM al GROUP BY ROLLUP (rule, severity)",
    "profile_coverage": f"{_E} SELECT 'type' AS kind, type AS name FROM (SELECT type FROM ty WHERE parent IS NULL AND type <> 'Part' UNION ALL SELECT 'Customer') WHERE lower(type) NOT IN (SELECT lower(entity_type) FROM e WHERE entity_type IS NOT NULL) UNION ALL SELECT 'subtype', 'Part.' || type FROM (SELECT type FROM ty WHERE parent = 'Part' UNION ALL SELECT 'Bulky') WHERE lower(type) NOT IN (SELECT lower(entity_type) FROM e WHERE entity_type IS NOT NULL) UNION ALL SELECT 'predicate', 'owns'",
}

QUERIES = {f.__name__: f for f in (vr001_duplicates, vr002_types, vr003_required_fields, vr004_predicates, vr005_domains, vr006_cardinality, vr007_required_attributes, validate_filter_survivors, cascade_dropped_triples, orphans, undefined_used, lint_summary, profile_coverage)}
