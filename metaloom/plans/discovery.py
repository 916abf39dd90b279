"""Queries of discovery: candidates, relevance, rules, schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions.text import label_key, name_key
from metaloom.operators import attributes, discover, review, suppress
from metaloom.sources import bindings as b
from metaloom.sources.bindings import LABEL_KEY_SQL, NAME_KEY_SQL, table


_GLOSSARY = [("Event Type", "varchar(20)", "view; click;buy", "what happened"), ("O TOTALPRICE", "DECIMAL(12,2)", None, "price"), ("n-name", None, "a,b", "name of a nation"), ("Margin", "double", None, "a ratio"), ("Colour", None, None, "nothing known"), ("Region", "text", None, "also a table")]
_CODE_ATTRIBUTES = [("Events", "value", "float", "measured value", False), ("events", "props", "dict", "", False), ("events", "derived", "int", "made in code", False), ("Orders", "o-totalprice", "decimal.Decimal", "total", False), ("Basket", "items", "str", "what is in it", True)]


def events(spark, d):
    """Candidate events of all sources in pass order."""
    n = F.lit(None).cast("string")
    a = b.concepts(spark, d).select("seq", "source", F.col("name").alias("label"), F.lit("entity").alias("kind"), "eid", F.lit("medium").alias("strength"), "definition")
    g = b.governance(spark, d).select("seq", "source", F.col("name").alias("label"), F.lit("entity").alias("kind"), "eid", F.lit("medium").alias("strength"), "definition")
    c = b.schema_fields(spark, d).select((F.col("pos") + 25 * 10**11).alias("seq"), F.lit("C").alias("source"), F.col("name").alias("label"), F.lit("attribute").alias("kind"), n.alias("eid"), F.lit("strong").alias("strength"), n.alias("definition"))
    t = table(spark, d, "part").select(F.col("p_type")).distinct().select(F.lit(26 * 10**11).alias("seq"), F.lit("C").alias("source"), F.col("p_type").alias("label"), F.lit("vocabulary").alias("kind"), n.alias("eid"), F.lit("weak").alias("strength"), n.alias("definition"))
    r = b.code_rules(spark, d).select("seq", F.lit("D").alias("source"), F.col("entity").alias("label"), F.lit("entity").alias("kind"), n.alias("eid"), F.when(F.col("conf") >= 0.85, "strong").otherwise("weak").alias("strength"), n.alias("definition"))
    f = b.code_rules(spark, d).select((F.col("seq") + 100).alias("seq"), F.lit("D").alias("source"), F.col("attribute").alias("label"), F.lit("attribute").alias("kind"), n.alias("eid"), F.lit("weak").alias("strength"), n.alias("definition"))
    p = table(spark, d, "part").select((F.col("p_partkey") + 35 * 10**11).alias("seq"), F.lit("D").alias("source"), F.col("p_name").alias("label"), F.when(F.col("p_size") > 48, "behavior").otherwise("entity").alias("kind"), n.alias("eid"), F.lit("weak").alias("strength"), n.alias("definition"))
    return a.union(g).union(c).union(t).union(r).union(f).union(p)


def candidate_merge(spark, d):
    return discover.candidates(events(spark, d)).select("merge_key", "kind", "norm", "aliases", "n_a", "n_b", "n_c", "n_d")


def corroboration_boost(spark, d):
    return discover.candidates(events(spark, d)).select("merge_key", "strength")


def graph_degree(spark, d):
    return discover.degrees(b.triples(spark, d))


def relevance_scores(spark, d):
    found = discover.candidates(events(spark, d)).join(discover.degrees(b.triples(spark, d)), "norm", "left")
    return discover.relevance(found).select("merge_key", "score", "band")


def relevance_bands(spark, d):
    return relevance_scores(spark, d).groupBy("band").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def induced_profile(spark, d):
    """The best 25 candidates: what an induced profile lists."""
    top = relevance_scores(spark, d).orderBy(F.desc("score"), "merge_key").limit(25)
    return top.select("merge_key", "score")


def rule_disagreement(spark, d):
    return discover.disagreements(b.code_rules(spark, d))


def table_classes(spark, d):
    return discover.table_classes(b.schema_fields(spark, d), b.KEY_OWNERS)


def fk_triples(spark, d):
    f = b.schema_fields(spark, d).select("model", "name", F.regexp_extract("name", "^[a-z]+_([a-z]+)key$", 1).alias("t")).filter("t <> ''")
    own = spark.createDataFrame(list(b.KEY_OWNERS.items()), "t string, target string")
    return f.join(own, "t").filter("model <> target").select(F.col("model").alias("s"), F.concat(F.lit("FK:"), "name").alias("p"), F.col("target").alias("o"))


def _glossary(spark, d):
    """Elements with names of columns, as a governance glossary has them."""
    return spark.createDataFrame(_GLOSSARY, "name string, data_type string, enum_values string, definition string")


def schema_enrichment(spark, d):
    """Columns and the elements that they enrich; columns without one become elements."""
    fields = b.schema_fields(spark, d).withColumn("nullable", ~F.col("name").endswith("key"))
    return attributes.schema_matches(_glossary(spark, d), fields)


def attribute_merge(spark, d):
    """Attributes of tables and of classes in code, by entity and name."""
    c = b.schema_fields(spark, d).select(F.col("model").alias("entity"), "name", "field_type", (F.col("pos") == 0).alias("is_id"), (F.col("pos") > 0).alias("nullable"))
    code = spark.createDataFrame(_CODE_ATTRIBUTES, "entity string, name string, python_type string, description string, many boolean")
    return attributes.merged(c, code)


def governed_attributes(spark, d):
    """Attributes of governance records for elements that neither a table nor a class has."""
    taken = b.schema_fields(spark, d).select(F.col("model").alias("entity"))
    return attributes.governed(_glossary(spark, d), taken)


_NOISE_NAMES = ["orders_audit", "tmp_load", "TMP_keep", "vw_orders_audit", "journal", "created_at", "birth_at", "Updated_By", "report_ts", "etag", "sys_id", "valuation_timestamp", "event_ts", "ts"]


def suppression_audit(spark, d):
    """tables, columns and a few noisy names, each with the reason for which it is left out."""
    extra = spark.createDataFrame([(n,) for n in _NOISE_NAMES], "name string")
    fields = b.schema_fields(spark, d)
    tables = fields.select(F.col("model").alias("name")).distinct().union(extra).select(F.lit("table").alias("kind"), "name", suppress.table_reason(F.col("name"), ["part"], ["tmp_keep"]).alias("reason"))
    columns = fields.select("name").union(extra).select(F.lit("column").alias("kind"), "name", suppress.column_reason(F.col("name"), ["*_comment", "props"], ["sys_*"]).alias("reason"))
    return tables.union(columns)


def eligible_concepts(spark, d):
    """Concepts of A without attributes, the surest first."""
    c = b.concepts(spark, d).groupBy(name_key(F.col("name")).alias("element_key")).agg(F.min("name").alias("name"), F.max("conf").alias("confidence")).withColumn("sources", F.lit("A"))
    having = b.governance(spark, d).select(F.col("name").alias("element"))
    return review.eligible(c, having).select("element_key", "confidence", F.col("rank").cast("long").alias("rank"))


def profile_subtypes(spark, d):
    """Subtypes of an induced profile: labels of a kind, the first of those that differ in case only."""
    e = events(spark, d).filter("kind IN ('vocabulary', 'attribute')").select("kind", "label", "seq")
    return review.first_wins(e, ["kind", F.lower(F.trim("label"))], ["seq", "label"]).groupBy("kind").agg(F.count("*").alias("subtypes"), F.min("label").alias("least"))


def rule_attach(spark, d):
    """A rule belongs to the first element that its name or its symbols name."""
    r = b.code_rules(spark, d).select("rule", F.posexplode(F.array("rule", F.concat("entity", F.lit(".x")), "entity")).alias("pos", "symbol"))
    keys = r.select("rule", "pos", label_key(F.substring_index("symbol", ".", -1)).alias("k"))
    elements = table(spark, d, "events").select(label_key(F.col("event_type")).alias("k")).distinct()
    hit = keys.join(elements, "k").groupBy("rule").agg(F.min_by("k", "pos").alias("element"))
    return b.code_rules(spark, d).select("rule").join(hit, "rule", "left")


def budget_admission(spark, d):
    """By confidence, then name; at most 60 with a token budget of 1000 that skips
    what does not fit and goes on."""
    c = b.concepts(spark, d).groupBy("name").agg(F.max("conf").alias("conf"), F.count("*").alias("cost"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("k"), F.lower("name").alias("name"), F.col("cost"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names"))
    step = lambda acc, x: F.when((acc["used"] + x["cost"] <= 1000) & (F.size(acc["names"]) < 60), F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["names"], F.array(x["name"])).alias("names"))).otherwise(acc)
    # profile-sized: one row a concept
    return c.agg(F.aggregate(order, zero, step).alias("r")).select(F.explode("r.names").alias("name"))


_EV = f"""WITH {b.CONCEPTS}, {b.GOVERNANCE}, {b.SCHEMA_FIELDS}, {b.CODE_RULES}, ev AS (
  SELECT seq, source, name AS label, 'entity' AS kind, eid, 'medium' AS strength, definition FROM a
  UNION ALL SELECT seq, source, name, 'entity', eid, 'medium', definition FROM b
  UNION ALL SELECT pos + 2500000000000, 'C', name, 'attribute', NULL, 'strong', NULL FROM c
  UNION ALL SELECT DISTINCT 2600000000000, 'C', p_type, 'vocabulary', NULL, 'weak', NULL FROM part
  UNION ALL SELECT seq, 'D', entity, 'entity', NULL, CASE WHEN conf >= 0.85 THEN 'strong' ELSE 'weak' END, NULL FROM d
  UNION ALL SELECT seq + 100, 'D', attribute, 'attribute', NULL, 'weak', NULL FROM d
  UNION ALL SELECT p_partkey + 3500000000000, 'D', p_name, CASE WHEN p_size > 48 THEN 'behavior' ELSE 'entity' END, NULL, 'weak', NULL FROM part
), e1 AS (SELECT *, {LABEL_KEY_SQL.format('label')} AS norm FROM ev),
e2 AS (SELECT *, eid IS NOT NULL AND row_number() OVER (PARTITION BY eid ORDER BY seq) = 1 AS reg FROM e1 WHERE norm <> ''),
e3 AS (SELECT *, first_value(CASE WHEN reg THEN eid END IGNORE NULLS) OVER w AS base, first_value(CASE WHEN reg OR eid IS NULL THEN kind END IGNORE NULLS) OVER w AS owner FROM e2 WINDOW w AS (PARTITION BY norm ORDER BY seq, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e4 AS (SELECT *, min(CASE WHEN reg AND eid <> base THEN seq END) OVER (PARTITION BY norm) AS amb FROM e3),
e5 AS (SELECT *, CASE WHEN eid IS NOT NULL THEN CASE WHEN eid = base THEN norm ELSE norm || '#id:' || eid END WHEN seq > amb THEN norm || '#ambiguous' WHEN kind = owner THEN norm ELSE norm || '#kind:' || kind END AS own FROM e4),
e6 AS (SELECT *, CASE WHEN eid IS NULL THEN own ELSE first_value(own) OVER (PARTITION BY eid ORDER BY seq) END AS merge_key FROM e5),
ca AS (SELECT merge_key, arg_min(label, seq) AS label, arg_min(kind, seq) AS kind, min(norm) AS norm, count(DISTINCT label) AS aliases, count_if(source = 'A')::BIGINT AS n_a, count_if(source = 'B')::BIGINT AS n_b, count_if(source = 'C')::BIGINT AS n_c, count_if(source = 'D')::BIGINT AS n_d,
  ['weak', 'medium', 'strong'][least(2, max(CASE strength WHEN 'weak' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) + (count(DISTINCT CASE WHEN source IN ('A', 'B') THEN 1 WHEN source = 'C' THEN 2 ELSE 3 END) >= 2)::INT) + 1] AS strength, max(trim(definition)) AS definition FROM e6 GROUP BY merge_key)"""
_DEG = f"""{b.TRIPLES}, g AS (SELECT DISTINCT {LABEL_KEY_SQL.format('s')} AS x, {LABEL_KEY_SQL.format('o')} AS y FROM t), de AS (SELECT x AS norm, count(DISTINCT y) AS degree FROM (SELECT x, y FROM g WHERE x <> y UNION SELECT y, x FROM g WHERE x <> y) GROUP BY x)"""
_REL = f"""{_EV}, {_DEG}, sc AS (SELECT merge_key, 0.25::DOUBLE * least(1, n_a / 3) + 0.2::DOUBLE * (n_b > 0)::INT + 0.15::DOUBLE * (n_c > 0)::INT + 0.1::DOUBLE * (n_d > 0)::INT + 0.1::DOUBLE * least(1, coalesce(degree, 0) / 5) + 0.1::DOUBLE * (coalesce(definition, '') <> '')::INT + 0.1::DOUBLE * CASE WHEN regexp_matches(lower(label), '^tmp_|_id$') THEN 0.1 ELSE 0.8 END::DOUBLE AS score FROM ca LEFT JOIN de USING (norm)),
re AS (SELECT *, CASE WHEN score >= 0.70 THEN 'core_business' WHEN score >= 0.40 THEN 'supporting_technical' ELSE 'noise' END AS band FROM sc)"""
_XSD = "'xsd:' || CASE field_type WHEN 'STRING' THEN 'string' WHEN 'INT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double' ELSE 'dateTime' END"
_REF = "CASE regexp_extract(name, '^[a-z]+_([a-z]+)key$', 1) WHEN 'region' THEN 'region' WHEN 'nation' THEN 'nation' WHEN 'cust' THEN 'customer' WHEN 'supp' THEN 'supplier' WHEN 'part' THEN 'part' WHEN 'order' THEN 'orders' END"

_GL = "gl AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in _GLOSSARY) + ") AS x(name, data_type, enum_values, definition))"
_SIMPLE = "CASE field_type WHEN 'INT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'TIMESTAMP_NTZ' THEN 'datetime' ELSE 'string' END"


def _globs(patterns: list[str]) -> str:
    return " ".join(f"WHEN lower(name) GLOB '{p}' THEN 'noise {p}'" for p in patterns)


ORACLES = {
    "candidate_merge": f"{_EV} SELECT merge_key, kind, norm, aliases, n_a, n_b, n_c, n_d FROM ca",
    "corroboration_boost": f"{_EV} SELECT merge_key, strength FROM ca",
    "graph_degree": f"WITH {_DEG} SELECT norm, degree FROM de",
    "relevance_scores": f"{_REL} SELECT merge_key, score, band FROM re",
    "relevance_bands": f"{_REL} SELECT band, count(*) AS n, avg(score) AS mean_score FROM re GROUP BY band",
    "induced_profile": f"{_REL} SELECT merge_key, score FROM re ORDER BY score DESC, merge_key LIMIT 25",
    "rule_disagreement": f"WITH {b.CODE_RULES} SELECT entity, attribute, count(DISTINCT predicate || ' ' || tag || ' ' || value) AS n, count(*) AS rules FROM d GROUP BY ALL HAVING count(DISTINCT predicate || ' ' || tag || ' ' || value) > 1",
    "table_classes": f"WITH {b.SCHEMA_FIELDS}, x AS (SELECT *, {_REF} AS r0 FROM c), y AS (SELECT *, CASE WHEN r0 <> model THEN r0 END AS ref FROM x), p AS (SELECT model, count(*) AS columns, count(ref) AS fk_out, count_if(suffix(name, '_name')) AS nm FROM y GROUP BY model), i AS (SELECT ref AS model, count(*) AS fk_in FROM y WHERE ref IS NOT NULL GROUP BY ref) SELECT model, columns, fk_out, coalesce(fk_in, 0) AS fk_in, CASE WHEN fk_out >= 2 AND fk_out = columns THEN 'bridge' WHEN (coalesce(fk_in, 0) > 0)::INT + (columns <= 3)::INT + (nm > 0)::INT >= 2 THEN 'code_table' ELSE 'entity' END AS class FROM p LEFT JOIN i USING (model)",
    "fk_triples": f"WITH {b.SCHEMA_FIELDS}, x AS (SELECT *, {_REF} AS ref FROM c) SELECT model AS s, 'FK:' || name AS p, ref AS o FROM x WHERE ref <> model",
    "schema_enrichment": f"WITH {b.SCHEMA_FIELDS}, {_GL} SELECT c.model, c.name, g.name AS element, {_SIMPLE} AS data_type, CASE WHEN suffix(c.name, 'key') THEN 'M' END AS mandatory, 0.95::DOUBLE AS confidence, CASE WHEN g.name IS NULL THEN 'new' ELSE 'enriched' END AS outcome FROM c LEFT JOIN gl g ON {NAME_KEY_SQL.format('c.name')} = {NAME_KEY_SQL.format('g.name')}",
    "attribute_merge": f"WITH {b.SCHEMA_FIELDS}, co AS (SELECT * FROM (VALUES ('Events', 'value', 'xsd:double', 'float', 'measured value', false), ('events', 'props', 'xsd:string', 'dict', '', false), ('events', 'derived', 'xsd:integer', 'int', 'made in code', false), ('Orders', 'o-totalprice', 'xsd:decimal', 'decimal.Decimal', 'total', false), ('Basket', 'items', 'xsd:string', 'str', 'what is in it', true)) AS x(entity, name, xsd, raw, description, many)), l AS (SELECT {NAME_KEY_SQL.format('model')} AS e, {NAME_KEY_SQL.format('name')} AS a, {_XSD} AS cx, field_type, pos FROM c), r AS (SELECT {NAME_KEY_SQL.format('entity')} AS e, {NAME_KEY_SQL.format('name')} AS a, xsd AS dx, raw, description, many FROM co) SELECT coalesce(l.e, r.e) AS entity_key, coalesce(l.a, r.a) AS attribute_key, coalesce(cx, dx) AS xsd, coalesce(field_type, raw) AS raw_type, coalesce(description, '') AS description, coalesce(pos = 0, false) AS is_id, coalesce(pos > 0, true) AS nullable, coalesce(many, false) AS many, CASE WHEN raw IS NULL THEN 'C' WHEN field_type IS NULL THEN 'D' ELSE 'C+D' END AS sources, CASE WHEN cx <> dx THEN dx END AS rejected FROM l FULL JOIN r ON l.e = r.e AND l.a = r.a",
    "governed_attributes": f"WITH {_GL} SELECT {NAME_KEY_SQL.format('name')} AS entity_key, name AS attribute, CASE upper(regexp_replace(coalesce(data_type, ''), '\\(.*\\)', '')) WHEN 'DECIMAL' THEN 'xsd:decimal' WHEN 'DOUBLE' THEN 'xsd:double' ELSE 'xsd:string' END AS xsd, definition AS description, CASE WHEN enum_values IS NULL THEN '' ELSE array_to_string(list_transform(string_split(replace(enum_values, ';', ','), ','), lambda v: trim(v)), ';') END AS enum_values, 0.7::DOUBLE AS confidence FROM gl WHERE (data_type IS NOT NULL OR enum_values IS NOT NULL) AND lower(name) NOT IN ('region')",
    "suppression_audit": f"WITH {b.SCHEMA_FIELDS}, x AS (SELECT unnest({_NOISE_NAMES}) AS name), ta AS (SELECT DISTINCT model AS name FROM c UNION ALL SELECT name FROM x), cn AS (SELECT name FROM c UNION ALL SELECT name FROM x) SELECT 'table' AS kind, name, CASE WHEN lower(name) GLOB 'part' THEN 'excluded by part' WHEN lower(name) GLOB 'tmp_keep' THEN NULL {_globs(suppress.TABLE_NOISE)} END AS reason FROM ta UNION ALL SELECT 'column', name, CASE WHEN lower(name) GLOB '*_comment' THEN 'excluded by *_comment' WHEN lower(name) GLOB 'props' THEN 'excluded by props' WHEN lower(name) GLOB 'sys_*' THEN NULL WHEN regexp_matches(lower(name), '^({'|'.join(suppress.MEANINGFUL)})') THEN NULL {_globs(suppress.COLUMN_NOISE)} END FROM cn",
    "eligible_concepts": f"WITH {b.CONCEPTS}, {b.GOVERNANCE}, k AS (SELECT {NAME_KEY_SQL.format('name')} AS element_key, min(name) AS name, max(conf) AS confidence FROM a GROUP BY 1) SELECT element_key, confidence, row_number() OVER (ORDER BY confidence DESC, lower(name), element_key) AS rank FROM k WHERE element_key NOT IN (SELECT {NAME_KEY_SQL.format('name')} FROM b)",
    "profile_subtypes": f"{_EV} SELECT kind, count(*) AS subtypes, min(label) AS least FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(trim(label)) ORDER BY seq, label) AS r FROM ev WHERE kind IN ('vocabulary', 'attribute')) WHERE r = 1 GROUP BY kind",
    "rule_attach": f"WITH {b.CODE_RULES} SELECT rule, {LABEL_KEY_SQL.format('entity')} AS element FROM d",
    "budget_admission": f"WITH RECURSIVE {b.CONCEPTS}, k AS (SELECT name, max(conf) AS conf, count(*) AS cost FROM a GROUP BY name), o AS (SELECT lower(name) AS name, cost, row_number() OVER (ORDER BY conf DESC, lower(name)) AS n FROM k), w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS got, NULL::VARCHAR AS name UNION ALL SELECT o.n, CASE WHEN used + cost <= 1000 AND got < 60 THEN used + cost ELSE used END, CASE WHEN used + cost <= 1000 AND got < 60 THEN got + 1 ELSE got END, CASE WHEN used + cost <= 1000 AND got < 60 THEN o.name END FROM w JOIN o ON o.n = w.n + 1) SELECT name FROM w WHERE name IS NOT NULL",
}

QUERIES = {f.__name__: f for f in (candidate_merge, corroboration_boost, graph_degree, relevance_scores, relevance_bands, induced_profile, rule_disagreement, table_classes, fk_triples, schema_enrichment, attribute_merge, governed_attributes, suppression_audit, eligible_concepts, profile_subtypes, rule_attach, budget_admission)}
