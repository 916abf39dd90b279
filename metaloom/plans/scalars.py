"""Queries of the scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import text as x
from metaloom.sources import bindings as b
from metaloom.sources.bindings import LABEL_KEY_SQL, NAME_KEY_SQL, table

NOISE_COLUMNS = ["*_ts", "*_timestamp", "*_at", "etag", "version", "row_version", "*key", "sys_*", "tenant_id"]


def normalize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", x.name_key(F.concat("p_name", F.lit("-_ "), "p_brand")).alias("key"))


def normalize_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", x.label_key(F.concat(F.lit("  Réf. "), "p_name", F.lit(" - "), "p_brand", F.lit("/ñ"))).alias("label"))


def deterministic_ids(spark, d):
    t = table(spark, d, "part").select("p_partkey", x.stable_id(F.lower("p_type"), x.label_key(F.col("p_name"))).alias("id"))
    return t.select("p_partkey", "id", x.id_parts(F.col("id")).alias("r")).select("p_partkey", "id", F.col("r.type").alias("type"), F.col("r.label").alias("label"), F.col("r.hash").alias("hash"))


def compact_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", x.compact(F.concat("s_name", F.lit(" a/b.c-d_e"))).alias("compact"))


def xsd_types(spark, d):
    c = b.schema_fields(spark, d)
    return c.select("model", "name", x.xsd_of_sql(F.col("field_type")).alias("xsd"), x.simple_of_xsd(x.xsd_of_sql(F.col("field_type"))).alias("simple"))


def glob_suppression(spark, d):
    return b.schema_fields(spark, d).select("model", "name", x.matches_glob(F.col("name"), NOISE_COLUMNS).alias("suppressed"))


def path_suppression(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.select("page_id", x.matches_path(F.col("path"), ["*/p1*", "tests/**"]).alias("suppressed"))


def name_policy(spark, d):
    n = F.concat("p_name", F.lit("  "), "p_type", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", x.is_compliant(n).alias("compliant"), x.compliant(n).alias("fixed"))


def singular_names(spark, d):
    n = F.concat(F.regexp_replace("p_name", ".* ", ""), F.element_at(F.array(*map(F.lit, ["s", "ies", "xes", "us", "ss", "ches"])), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", n.alias("plural"), x.canonical_label(F.concat(F.lit("dim_"), n)).alias("canonical"))


def case_styles(spark, d):
    return table(spark, d, "part").select("p_partkey", x.pascal_case(F.col("p_name")).alias("pascal"), x.camel_case(F.col("p_name")).alias("camel"), x.fragment(F.concat(F.lit(" "), "p_name")).alias("fragment"), x.truncated(F.concat_ws(" of ", "p_name", "p_brand", "p_type"), 24).alias("short"))


def text_field_scores(spark, d):
    source = F.concat("p_name", F.lit(" made of steel and  copper by "), "p_brand")
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("steel copper silver")).otherwise("golden platinum")
    return table(spark, d, "part").select("p_partkey", x.text_field_score(value, source).alias("score"), x.appears_score(value, source).alias("appears"))


def triple_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = x.appears_score(F.lit("license"), F.col("text"))
    o = x.appears_score(F.lit("the"), F.col("text"))
    return docs.select("doc_id", ((s + o) / 2).alias("score"))


def license_snippets(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.filter(F.contains(F.lower("text"), F.lit("licensed"))).select("doc_id", F.length(x.snippet(F.lit("licensed"), F.col("text"))).cast("long").alias("length"), F.instr(F.lower("text"), "licensed").cast("long").alias("hit"))


def citations(spark, d):
    line = F.concat(F.lit("See Section "), F.col("p_size").cast("string"), F.lit(", article 3 and section "), F.col("p_size").cast("string"), F.lit(" of Directive 2013; "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(x.citations(line), "|").alias("cited"))


def concept_lines(spark, d):
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat_ws(" :: ", "p_name", "p_type", "p_brand")).when(k == 1, F.concat_ws(" :: ", "p_name", "p_brand")).when(k == 2, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.concat("p_name", F.lit(" (NPL)")))
    return table(spark, d, "part").select("p_partkey", x.concept_parts(line).alias("r")).select("p_partkey", "r.name", "r.type", "r.definition")


def triple_lines(spark, d):
    sep = F.element_at(F.array(*map(F.lit, [" -> ", " --> ", " => ", " -- ", " | "])), (F.col("p_partkey") % 5 + 1).cast("int"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", sep, F.lit("is a"), sep, "p_type")).otherwise(F.concat("p_name", sep, "p_type"))
    return table(spark, d, "part").select("p_partkey", x.triple_parts(line).alias("r")).select("p_partkey", "r.subject", "r.predicate", "r.object")


def enum_lists(spark, d):
    v = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("; ", "p_type", "p_brand", F.lit(" "))).otherwise(F.concat_ws(",", "p_type", "p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(x.enum_values(v), "|").alias("enum"))


def rule_descriptions(spark, d):
    r = b.code_rules(spark, d)
    body = x.rule_label(F.col("entity"), F.col("attribute"), F.col("predicate"), F.col("value"))
    return r.select("rule", x.rule_description(F.col("kind"), body, F.array("entity"), F.lit("rules.py"), (F.col("seq") % 100).cast("int")).alias("description"))


def match_scores(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", x.name_similarity(F.col("p_name"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("_x"))).alias("similarity"), x.match_score(F.col("p_name"), F.concat_ws(" ", "p_type", F.regexp_extract("p_name", r"(\S+)$", 1))).alias("score"))


_LINE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' :: ' || p_type || ' :: ' || p_brand WHEN 1 THEN p_name || ' :: ' || p_brand WHEN 2 THEN p_name || ' (' || p_brand || ')' ELSE p_name || ' (NPL)' END"
_SIX = "regexp_replace(p_name, '.* ', '') || CASE p_partkey % 6 WHEN 0 THEN 's' WHEN 1 THEN 'ies' WHEN 2 THEN 'xes' WHEN 3 THEN 'us' WHEN 4 THEN 'ss' ELSE 'ches' END"
_MAP = "CASE field_type WHEN 'STRING' THEN 'string' WHEN 'INT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP_NTZ' THEN 'dateTime' ELSE 'string' END"

ORACLES = {
    "normalize_names": f"""SELECT p_partkey, {NAME_KEY_SQL.format("p_name || '-_ ' || p_brand")} AS key FROM part""",
    "normalize_labels": f"""SELECT p_partkey, {LABEL_KEY_SQL.format("'  Réf. ' || p_name || ' - ' || p_brand || '/ñ'")} AS label FROM part""",
    "deterministic_ids": f"""WITH l AS (SELECT p_partkey, lower(p_type) AS t, {LABEL_KEY_SQL.format('p_name')} AS l FROM part), h AS (SELECT *, left(sha256(t || '|' || l), 6) AS hash FROM l)
  SELECT p_partkey, t || '_' || l || '_' || hash AS id, t AS type, l AS label, hash FROM h""",
    "compact_names": r"SELECT s_suppkey, regexp_replace(lower(s_name || ' a/b.c-d_e'), '[\s_/.-]+', '', 'g') AS compact FROM supplier",
    "xsd_types": f"WITH {b.SCHEMA_FIELDS} SELECT model, name, 'xsd:' || {_MAP} AS xsd, CASE {_MAP} WHEN 'integer' THEN 'integer' WHEN 'double' THEN 'decimal' WHEN 'dateTime' THEN 'datetime' ELSE 'string' END AS simple FROM c",
    "glob_suppression": f"WITH {b.SCHEMA_FIELDS} SELECT model, name, regexp_matches(name, '_ts$|_timestamp$|_at$|^etag$|^version$|^row_version$|key$|^sys_|^tenant_id$') AS suppressed FROM c",
    "path_suppression": "SELECT page_id, regexp_matches(lower(regexp_replace(url, '^[a-z]+://', '')), '^(.*/)?([^/]*/p1[^/]*|tests/[^/]*)$') AS suppressed FROM pages",
    "name_policy": "WITH n AS (SELECT p_partkey, p_name || '  ' || p_type || '!' AS n FROM part) SELECT p_partkey, regexp_matches(n, '^[A-Za-z][A-Za-z0-9_]*$') AND length(n) <= 26 AS compliant, left(regexp_replace(regexp_replace(regexp_replace(n, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 26) AS fixed FROM n",
    "singular_names": f"WITH n AS (SELECT p_partkey, {_SIX} AS plural FROM part) SELECT p_partkey, plural, CASE WHEN regexp_matches(plural, '(us|ss|is)$') THEN plural WHEN regexp_matches(plural, '[^aeiou]ies$') THEN regexp_replace(plural, 'ies$', 'y') WHEN regexp_matches(plural, '(x|ch|sh|ss|z)es$') THEN regexp_replace(plural, 'es$', '') WHEN regexp_matches(plural, '[a-z]s$') THEN regexp_replace(plural, 's$', '') ELSE plural END AS canonical FROM n",
    "case_styles": "WITH n AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS p, p_name || ' of ' || p_brand || ' of ' || p_type AS t FROM part) SELECT p_partkey, p AS pascal, lower(left(p, 1)) || substr(p, 2) AS camel, replace(p_name, ' ', '_') AS fragment, CASE WHEN length(t) > 24 THEN left(t, 21) || '...' ELSE t END AS short FROM n",
    "text_field_scores": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.55 ELSE 0.35 END::DOUBLE AS score, CASE WHEN p_partkey % 3 = 0 THEN 0.95 ELSE 0.30 END::DOUBLE AS appears FROM part",
    "triple_scores": "SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 0.95 ELSE 0.3 END + CASE WHEN contains(lower(text), 'the') THEN 0.95 ELSE 0.3 END)::DOUBLE / 2 AS score FROM documents",
    "license_snippets": "WITH h AS (SELECT doc_id, text, strpos(lower(text), 'licensed') AS hit FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(trim(substr(text, greatest(hit - 50, 1), hit + 150 - greatest(hit - 50, 1)), ' '))::BIGINT AS length, hit::BIGINT AS hit FROM h WHERE hit > 0",
    "citations": "SELECT p_partkey, 'Section ' || p_size || '|article 3|Directive 2013' AS cited FROM part",
    "concept_lines": f"WITH n AS (SELECT *, {_LINE} AS line FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN line ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS type, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_brand END AS definition FROM n",
    "triple_lines": "SELECT p_partkey, p_name AS subject, CASE WHEN p_partkey % 2 = 0 THEN 'is a' ELSE 'related_to' END AS predicate, p_type AS object FROM part",
    "enum_lists": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || p_brand ELSE p_type || '|' || p_name END AS enum FROM part",
    "rule_descriptions": f"WITH {b.CODE_RULES} SELECT rule, '[' || kind || '] ' || entity || '.' || attribute || ' ' || predicate || ' ' || value || ' (ref: ' || entity || ') [rules.py:' || (seq % 100) || ']' AS description FROM d",
    "match_scores": r"""WITH n AS (SELECT p_partkey, p_name, regexp_replace(p_name, '[_-]', '', 'g') AS x, regexp_extract(p_name, '(\S+)$', 1) AS tail, p_type FROM part), w AS (SELECT *, list_distinct(string_split(lower(p_name), ' ')) AS wa, list_distinct(string_split(lower(p_type || ' ' || tail), ' ')) AS wb FROM n)
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 0.95 ELSE length(x) / (length(x) + 1) END::DOUBLE AS similarity, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) AS score FROM w""",
}

QUERIES = {f.__name__: f for f in (normalize_names, normalize_labels, deterministic_ids, compact_names, xsd_types, glob_suppression, path_suppression, name_policy, singular_names, case_styles, text_field_scores, triple_scores, license_snippets, citations, concept_lines, triple_lines, enum_lists, rule_descriptions, match_scores)}
