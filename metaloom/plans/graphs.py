"""Queries of the graph, fuzzy-join and ontology operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions.text import name_key, xsd_of_sql
from metaloom.operators import fuzzy, graph, merge, ontology
from metaloom.operators.lineage import durable
from metaloom.plans import validation
from metaloom.sources import bindings as b
from metaloom.sources.bindings import NAME_KEY_SQL, table

BASE = ontology.BASE


def _edges(spark, d):
    t = b.triples(spark, d).withColumn("seq", F.when(F.col("p") == "in", 1).when(F.col("p") == "based in", 2).otherwise(3))
    return graph.concept_graph(t, validation.entities(spark, d))


def _links(spark, d):
    """Pages and what they link to."""
    pages = table(spark, d, "pages").filter("html IS NOT NULL AND url IS NOT NULL")
    return pages.select(F.col("url").alias("s"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("o")).filter("s <> o").distinct()


def concept_graph(spark, d):
    return _edges(spark, d)


def components(spark, d):
    e = b.triples(spark, d).select(F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"))
    return graph.components(e)


def link_components(spark, d):
    e = _links(spark, d).select(F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y")).distinct()
    return graph.components(e).groupBy("component").agg(F.count("*").alias("n"))


def communities(spark, d):
    return graph.communities(_edges(spark, d).select("x", "y"))


def _holes(spark, d):
    """Holes between fixed groups: the entities by the first letter of their names."""
    groups = validation.entities(spark, d).select(name_key(F.col("name")).alias("node")).distinct().select("node", F.left("node", F.lit(1)).alias("community"))
    return graph.structural_holes(_edges(spark, d).select("x", "y"), groups)


def structural_holes(spark, d):
    return _holes(spark, d).select("i", "j", "n_i", "n_j", "edges", "density")


def worst_gaps(spark, d):
    """The ten worst holes, and a row with the number of those not shown."""
    return graph.worst(_holes(spark, d), [F.asc("density"), F.desc(F.col("n_i") + F.col("n_j")), F.asc("i"), F.asc("j")], 10).select("i", "j", "density", "more")


def bridge_concepts(spark, d):
    """The ten most central concepts, and a row with the number of those not shown."""
    e = durable(_edges(spark, d))
    n = e.select("x").union(e.select("y")).distinct().count()
    found = durable(graph.betweenness(e, n).filter(F.col("centrality") > 1 / max(1, n - 1)))
    return graph.worst(found, [F.desc("centrality"), F.asc("node")], 10)


def _hierarchy(spark, d):
    p = table(spark, d, "part").select("p_name", F.regexp_extract("p_name", r"(\S+)$", 1).alias("w"))
    low = p.select(F.col("p_name").alias("child"), F.col("w").alias("parent"))
    mid = p.select(F.col("w").alias("child"), F.concat(F.lit("kind "), F.left("w", F.lit(1))).alias("parent"))
    top = p.select(F.concat(F.lit("kind "), F.left("w", F.lit(1))).alias("child"), F.lit("thing").alias("parent"))
    return low.union(mid).union(top).distinct()


def subclass_closure(spark, d):
    return graph.closure(_hierarchy(spark, d))


def reasoned_types(spark, d):
    sub = _hierarchy(spark, d).select(F.col("child").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("parent").alias("o"))
    typed = table(spark, d, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("s"), F.lit("rdf:type").alias("p"), F.col("p_name").alias("o"))
    made = ontology.reasoned(sub.union(typed))
    return made.filter("p = 'rdf:type'").groupBy("o").agg(F.count("*").alias("n"))


def duplicate_names(spark, d):
    return fuzzy.duplicate_names(table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct())


def fuzzy_best_match(spark, d):
    models = b.schema_fields(spark, d).select(F.regexp_replace("name", "^[a-z]_", "").alias("model"))
    concepts = table(spark, d, "part").select(F.concat("p_name", F.lit(" name")).alias("concept")).union(spark.createDataFrame([(w,) for w in ("order key", "ship date", "type", "total price", "user id", "nation key")], "concept string"))
    return fuzzy.best_matches(models, concepts)


def definition_enrichment(spark, d):
    terms = table(spark, d, "part").select(F.regexp_extract("p_name", r"(\S+)$", 1).alias("term")).union(table(spark, d, "part").select(F.upper("p_name"))).union(table(spark, d, "nation").select("n_name"))
    return fuzzy.enriched(terms, table(spark, d, "part").select(F.col("p_name").alias("concept")))


def _ontology(spark, d):
    fused = merge.fuse(b.concepts(spark, d).unionByName(b.governance(spark, d)))
    fields = b.schema_fields(spark, d).select("model", "name", xsd_of_sql(F.col("field_type")).alias("xsd"))
    return ontology.project(fused, b.triples(spark, d), fields)


def owl_triples(spark, d):
    return _ontology(spark, d)


def _versions(spark, d):
    t = b.triples(spark, d).select("s", "p", "o")
    return t.filter("p <> 'in'"), t.filter("p <> 'based in'")


def ontology_diff(spark, d):
    return ontology.diff(*_versions(spark, d)).groupBy("change", "p").agg(F.count("*").alias("n"))


def ontology_merge(spark, d):
    label = lambda suffix: table(spark, d, "part").select(F.col("p_name").alias("s"), F.lit("rdfs:label").alias("p"), F.concat("p_type", F.lit(suffix)).alias("o"))
    base = label("").filter("o <> 'PROMO'").unionByName(table(spark, d, "nation").select(F.col("n_name").alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o")))
    other = label(" 2").unionByName(table(spark, d, "region").select(F.col("r_name").alias("s"), F.lit("rdfs:label").alias("p"), F.col("r_name").alias("o")))
    return ontology.merge(base, other, conservative=True)


def ontology_rename(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("old"), F.concat(F.lit("country "), F.col("n_nationkey").cast("string")).alias("new"))
    return ontology.rename(b.triples(spark, d), names)


def ontology_lint(spark, d):
    return ontology.lint(_ontology(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


def class_listing(spark, d):
    sub = _hierarchy(spark, d)
    t = sub.select(F.col("child").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("parent").alias("o")).union(sub.select("child", F.lit("rdf:type"), F.lit("owl:Class"))).union(sub.select("child", F.lit("rdfs:label"), F.initcap("child")))
    return ontology.class_listing(t)


def domain_range_rollup(spark, d):
    return ontology.domain_range(b.triples(spark, d))


_N = NAME_KEY_SQL
_G = f"""{validation._E}, ed AS (SELECT least(x, y) AS x, greatest(x, y) AS y, arg_max(conf, seq) AS w FROM (SELECT {_N.format('s')} AS x, {_N.format('o')} AS y, conf, CASE p WHEN 'in' THEN 1 WHEN 'based in' THEN 2 ELSE 3 END AS seq FROM t) WHERE x <> y AND x IN (SELECT k FROM e) AND y IN (SELECT k FROM e) GROUP BY 1, 2)"""
_HOLES = "gr AS (SELECT DISTINCT k AS node, left(k, 1) AS component FROM e), sz AS (SELECT component, count(*) AS n FROM gr GROUP BY component), cr AS (SELECT least(a.component, b.component) AS i, greatest(a.component, b.component) AS j, count(*) AS edges FROM ed JOIN gr a ON x = a.node JOIN gr b ON y = b.node GROUP BY 1, 2), ho AS (SELECT p.component AS i, q.component AS j, p.n AS n_i, q.n AS n_j, coalesce(edges, 0) AS edges, coalesce(edges, 0) / (p.n * q.n) AS density FROM sz p JOIN sz q ON p.component < q.component LEFT JOIN cr ON cr.i = p.component AND cr.j = q.component WHERE coalesce(edges, 0) / (p.n * q.n) < 0.05)"
_REACH = "both_ AS (SELECT s AS x, o AS y FROM {0} UNION SELECT o, s FROM {0}), reach AS (SELECT x AS node, x AS seen FROM both_ UNION SELECT node, y FROM reach JOIN both_ ON seen = x), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"
_H = r"h AS (SELECT DISTINCT p_name AS child, regexp_extract(p_name, '(\S+)$', 1) AS parent FROM part UNION SELECT regexp_extract(p_name, '(\S+)$', 1), 'kind ' || left(regexp_extract(p_name, '(\S+)$', 1), 1) FROM part UNION SELECT 'kind ' || left(regexp_extract(p_name, '(\S+)$', 1), 1), 'thing' FROM part), cl AS (SELECT child, parent FROM h UNION SELECT cl.child, h.parent FROM cl JOIN h ON cl.parent = h.child)"
_SIM = "CASE WHEN x = y THEN 1 WHEN x || 's' = y OR y || 's' = x OR x || 'es' = y OR y || 'es' = x THEN 0.95 WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE 0 END::DOUBLE"
_C = r"regexp_replace(lower({0}), '[\s_/.-]+', '', 'g')"
_W = r"list_distinct(list_filter(string_split_regex(lower({0}), '[\s_/.-]+'), lambda q: q <> ''))"
_O = f"""WITH {b.CONCEPTS}, {b.GOVERNANCE}, {merge.identified_sql(_N)}, {merge.fused_sql()}, {b.TRIPLES}, {b.SCHEMA_FIELDS},
pf AS (SELECT '{BASE}' || regexp_replace(lower(trim(element_key)), '[ /]', '_', 'g') AS i, * FROM f), pr AS (SELECT '{BASE}rel/' || regexp_replace(lower(trim(p)), '[ /]', '_', 'g') AS i, p, '{BASE}' || regexp_replace(lower(trim(s)), '[ /]', '_', 'g') AS s, '{BASE}' || regexp_replace(lower(trim(o)), '[ /]', '_', 'g') AS o FROM t),
pc AS (SELECT '{BASE}' || model || '/' || name AS i, model, name, 'xsd:' || CASE field_type WHEN 'STRING' THEN 'string' WHEN 'INT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double' ELSE 'dateTime' END AS xsd FROM c),
ow AS (SELECT i AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM pf UNION SELECT i, 'rdfs:label', name FROM pf UNION SELECT i, 'rdfs:comment', definition FROM pf WHERE definition IS NOT NULL UNION SELECT i, 'dc:source', sources FROM pf
  UNION SELECT i, 'rdf:type', 'owl:ObjectProperty' FROM pr UNION SELECT i, 'rdfs:label', p FROM pr UNION SELECT i, 'rdfs:domain', s FROM pr UNION SELECT i, 'rdfs:range', o FROM pr
  UNION SELECT i, 'rdf:type', 'owl:DatatypeProperty' FROM pc UNION SELECT i, 'rdfs:label', name FROM pc UNION SELECT i, 'rdfs:domain', '{BASE}' || model FROM pc UNION SELECT i, 'rdfs:range', xsd FROM pc)"""
_LINKS = "lk AS (SELECT DISTINCT url AS s, o FROM (SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS o FROM pages WHERE html IS NOT NULL AND url IS NOT NULL) WHERE url <> o)"

ORACLES = {
    "concept_graph": f"{_G} SELECT x, y, w FROM ed",
    "components": f"WITH RECURSIVE {b.TRIPLES}, tt AS (SELECT s, o FROM t), {_REACH.format('tt')} SELECT node, component FROM comp",
    "link_components": f"WITH RECURSIVE {_LINKS}, {_REACH.format('lk')} SELECT component, count(*) AS n FROM comp GROUP BY component",
    "structural_holes": f"{_G}, {_HOLES} SELECT * FROM ho",
    "worst_gaps": f"{_G}, {_HOLES}, ra AS (SELECT *, row_number() OVER (ORDER BY density, n_i + n_j DESC, i, j) AS r FROM ho) SELECT i, j, density, NULL::BIGINT AS more FROM ra WHERE r <= 10 UNION ALL SELECT NULL, NULL, NULL, count(*) - 10 FROM ra HAVING count(*) > 10",
    "subclass_closure": f"WITH RECURSIVE {_H} SELECT child, parent FROM cl",
    "reasoned_types": f"WITH RECURSIVE {_H}, ty AS (SELECT 'part ' || p_partkey AS s, p_name AS o FROM part), al AS (SELECT s, o FROM ty UNION SELECT s, parent FROM ty JOIN cl ON o = child) SELECT o, count(*) AS n FROM al GROUP BY o",
    "duplicate_names": f"WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), k AS (SELECT name, regexp_replace(lower(name), '[_-]', '', 'g') AS k FROM n), p AS (SELECT a.name AS a, b.name AS b, a.k AS x, b.k AS y FROM k a JOIN k b ON a.name < b.name) SELECT a, b, {_SIM} AS similarity FROM p WHERE {_SIM} >= 0.8",
    "fuzzy_best_match": f"WITH {b.SCHEMA_FIELDS}, mo AS (SELECT DISTINCT regexp_replace(name, '^[a-z]_', '') AS model FROM c), co AS (SELECT DISTINCT p_name || ' name' AS concept FROM part UNION SELECT * FROM (VALUES ('order key'), ('ship date'), ('type'), ('total price'), ('user id'), ('nation key'))), z AS (SELECT model, concept, {_C.format('model')} AS x, {_C.format('concept')} AS y, {_W.format('model')} AS wx, {_W.format('concept')} AS wy FROM mo, co), s AS (SELECT model, concept, CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE len(list_intersect(wx, wy)) / len(list_distinct(list_concat(wx, wy))) END::DOUBLE AS score FROM z) SELECT model, concept, score FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, concept) AS r FROM s WHERE score >= 0.4) WHERE r = 1",
    "definition_enrichment": r"WITH te AS (SELECT DISTINCT regexp_extract(p_name, '(\S+)$', 1) AS term FROM part UNION SELECT upper(p_name) FROM part UNION SELECT n_name FROM nation), co AS (SELECT DISTINCT p_name AS concept FROM part), eq AS (SELECT term, min(concept) AS concept FROM te JOIN co ON lower(term) = lower(concept) GROUP BY term), pa AS (SELECT term, min(concept) AS concept FROM te JOIN co ON contains(lower(term), lower(concept)) OR contains(lower(concept), lower(term)) WHERE term NOT IN (SELECT term FROM eq) GROUP BY term) SELECT term, concept, 0.85::DOUBLE AS score FROM eq UNION ALL SELECT term, concept, 0.75 FROM pa UNION ALL SELECT term, NULL, 0.4 FROM te WHERE term NOT IN (SELECT term FROM eq) AND term NOT IN (SELECT term FROM pa)",
    "owl_triples": f"{_O} SELECT s, p, o FROM ow",
    "ontology_lint": f"{_O}, cs AS (SELECT s FROM ow WHERE p = 'rdf:type' AND o = 'owl:Class'), ps AS (SELECT s FROM ow WHERE p = 'rdf:type' AND o <> 'owl:Class'), l AS (SELECT 'no_comment' AS rule FROM cs WHERE s NOT IN (SELECT s FROM ow WHERE p = 'rdfs:comment') UNION ALL SELECT 'lonely_class' FROM cs UNION ALL SELECT 'no_domain' FROM ps WHERE s NOT IN (SELECT s FROM ow WHERE p = 'rdfs:domain') UNION ALL SELECT 'no_range' FROM ps WHERE s NOT IN (SELECT s FROM ow WHERE p = 'rdfs:range') UNION ALL SELECT 'shared_label' FROM (SELECT lower(o) FROM cs JOIN ow USING (s) WHERE p = 'rdfs:label' GROUP BY 1 HAVING count(DISTINCT s) > 1)) SELECT rule, count(*) AS n FROM l GROUP BY rule",
    "ontology_diff": f"WITH {b.TRIPLES} SELECT CASE p WHEN 'in' THEN 'added' ELSE 'removed' END AS change, p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM t) WHERE p <> 'supplies' GROUP BY ALL",
    "ontology_merge": "WITH ba AS (SELECT DISTINCT p_name AS s, 'rdfs:label' AS p, p_type AS o FROM part WHERE p_type <> 'PROMO' UNION SELECT n_name, 'rdf:type', 'owl:Class' FROM nation), ot AS (SELECT DISTINCT p_name AS s, 'rdfs:label' AS p, p_type || ' 2' AS o FROM part UNION SELECT r_name, 'rdfs:label', r_name FROM region) SELECT s, p, o FROM ba UNION SELECT s, p, min(o) FROM ot WHERE (s, p) NOT IN (SELECT (s, p) FROM ba) GROUP BY s, p",
    "ontology_rename": f"WITH {b.TRIPLES}, n AS (SELECT n_name, 'country ' || n_nationkey AS new FROM nation) SELECT DISTINCT coalesce(x.new, s) AS s, p, coalesce(y.new, o) AS o FROM t LEFT JOIN n x ON s = x.n_name LEFT JOIN n y ON o = y.n_name",
    "class_listing": f"WITH RECURSIVE {_H} SELECT h.child AS s, array_to_string(list_transform(string_split(h.child, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS label, string_agg(DISTINCT h.parent, ',' ORDER BY h.parent) AS parents, (SELECT count(DISTINCT g.child) FROM h g WHERE g.parent = h.child) AS children FROM h GROUP BY h.child",
    "domain_range_rollup": f"WITH {b.TRIPLES} SELECT p, count(DISTINCT s) AS domains, count(DISTINCT o) AS ranges, min(s) AS first_domain, min(o) AS first_range FROM t GROUP BY p",
}

QUERIES = {f.__name__: f for f in (concept_graph, components, link_components, communities, structural_holes, worst_gaps, bridge_concepts, subclass_closure, reasoned_types, duplicate_names, fuzzy_best_match, definition_enrichment, owl_triples, ontology_diff, ontology_merge, ontology_rename, ontology_lint, class_listing, domain_range_rollup)}
