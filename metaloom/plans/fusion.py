"""Queries of the fusion layer: merge, conflicts, report, reference comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions.text import f1, is_plausible_term, name_key
from metaloom.operators import merge, report
from metaloom.sources import bindings as b

_ID = f"WITH {b.CONCEPTS}, {b.GOVERNANCE}, {merge.identified_sql(b.NAME_KEY_SQL)}"
_FUSED = f"{_ID}, {merge.fused_sql()}"


def _mentions(spark, d):
    return b.concepts(spark, d).unionByName(b.governance(spark, d))


def _fused(spark, d):
    return merge.fuse(_mentions(spark, d))


def fuse_ab_elements(spark, d):
    return _fused(spark, d).select("element_key", "name", "sources", "mentions", "documents", "critical", "definition", "definition_source", "domain", "conflicts", "confidence", "needs_review")


def conflict_log(spark, d):
    folded = merge.fold_field(merge.identify(_mentions(spark, d)), "definition")
    return folded.select("element_key", F.col("source").alias("winner"), F.posexplode("conflicts").alias("n", "c")).select("element_key", "winner", F.col("n").cast("long").alias("n"), F.col("c.source").alias("loser"), F.col("c.value").alias("rejected"), F.col("c.resolution").alias("resolution"))


def conflict_stats(spark, d):
    log = conflict_log(spark, d)
    return log.groupBy("resolution").agg(F.count("*").alias("conflicts"), F.count_distinct("element_key").alias("elements"))


def governance_unmatched(spark, d):
    a = merge.identify(b.concepts(spark, d)).select("element_key").distinct()
    g = b.governance(spark, d).withColumn("element_key", name_key(F.col("name")))
    return g.join(a, "element_key", "left_anti").select("name", "element_key")


def element_counts(spark, d):
    return report.element_counts(_fused(spark, d))


def confidence_stats(spark, d):
    return report.confidence_stats(_fused(spark, d))


def corroboration_distribution(spark, d):
    return report.corroboration(_fused(spark, d))


def document_corroboration(spark, d):
    rows = merge.identify(b.concepts(spark, d))
    first = rows.groupBy("element_key", "document").agg(F.min("seq").alias("seq"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "document"))), lambda x: x["document"])
    return first.groupBy("element_key").agg(F.array_join(docs, ",").alias("documents"), F.count("*").alias("n"))


def coverage_gaps(spark, d):
    f = _fused(spark, d)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = F.concat_ws(",", F.when(blank("definition"), "definition"), F.when(blank("citation"), "citation"))
    return f.filter(blank("definition") | blank("citation")).select("element_key", F.when(blank("definition"), "warning").otherwise("info").alias("severity"), missing.alias("missing"))


def reference_prf1(spark, d):
    found = merge.identify(_mentions(spark, d)).select("element_key")
    truth = merge.identify(b.concepts(spark, d).filter("definition NOT LIKE 'SMALL%'")).select("element_key").union(b.table(spark, d, "region").select(F.lower("r_name")))
    return report.precision_recall(found, truth, ["element_key"])


def relationship_prf1(spark, d):
    t = b.triples(spark, d).select(name_key(F.col("s")).alias("s"), "p", name_key(F.col("o")).alias("o"))
    return report.precision_recall(t, t.filter("p <> 'in'"), ["s", "p", "o"])


def anchor_coverage(spark, d):
    rows = merge.identify(_mentions(spark, d))
    entry = F.explode(F.create_map(F.lit("definition"), F.col("definition"), F.lit("domain"), F.col("domain"))).alias("field", "value")
    per = rows.select("element_key", "document", entry).filter("value IS NOT NULL").groupBy("element_key", "field").agg(F.max(F.col("document").isNotNull()).alias("anchored"))
    return per.groupBy("field").agg(F.count_if("anchored").alias("with_anchor"), F.count_if(~F.col("anchored")).alias("without_anchor"))


def lookup(spark, d):
    """Exact lookup of names taken from the suppliers' table of parts."""
    f = _fused(spark, d)
    asked = b.table(spark, d, "part").select(name_key(F.upper("p_name")).alias("element_key")).distinct()
    return f.join(asked, "element_key").select("element_key", "name", "definition")


def search(spark, d):
    return _fused(spark, d).filter(F.contains("element_key", name_key(F.lit("Red")))).select("element_key", "name", "sources")


def element_card(spark, d):
    f = _fused(spark, d)
    t = b.triples(spark, d)
    ends = t.select(name_key(F.col("s")).alias("element_key"), F.concat(F.lit("out "), "p").alias("role")).union(t.select(name_key(F.col("o")), F.concat(F.lit("in "), "p")))
    roles = ends.groupBy("element_key", "role").count().groupBy("element_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit("="), F.col("count").cast("string")))), "; ").alias("links"))
    line = F.concat_ws(" | ", "name", F.col("definition"), F.concat(F.lit("sources: "), "sources"), F.concat(F.lit("conflicts: "), F.col("conflicts").cast("string")), F.coalesce("links", F.lit("no links")))
    return f.join(roles, "element_key", "left").select("element_key", line.alias("card"))


def plausible_terms(spark, d):
    words = b.table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("term")).filter("term <> ''")
    return words.groupBy("term").count().filter(is_plausible_term(F.col("term"))).select("term", F.col("count").alias("n"))


def review_summary(spark, d):
    """Findings by severity and rule with their totals, by grouping sets."""
    f = _fused(spark, d)
    contradictions = f.filter("conflicts > 0").select(F.lit("contradiction").alias("rule"), F.lit("warning").alias("severity"))
    gaps = coverage_gaps(spark, d).select(F.lit("coverage_gap").alias("rule"), "severity")
    both = contradictions.union(gaps)
    return both.groupingSets([["rule", "severity"], ["rule"], []], "rule", "severity").agg(F.count("*").alias("n")).select(F.coalesce("rule", F.lit("all")).alias("rule"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


def f1_scores(spark, d):
    s = b.table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 10) / 10).alias("p"), ((F.col("p_size") % 7) / 7).alias("r"))
    return s.select("p_partkey", f1(F.col("p"), F.col("r")).alias("f1"))


_LOG = f"""{_ID}, o AS (
  SELECT element_key, list(struct_pack(s := source, v := definition, q := seq) ORDER BY seq) AS steps FROM m WHERE coalesce(trim(definition), '') <> '' GROUP BY element_key
), w AS (
  SELECT element_key, source, definition AS v, seq FROM (SELECT *, row_number() OVER (PARTITION BY element_key ORDER BY source, seq DESC) AS r FROM m WHERE coalesce(trim(definition), '') <> '') WHERE r = 1
), lost AS (
  SELECT w.element_key, w.source AS winner, row_number() OVER (PARTITION BY w.element_key ORDER BY m.seq) - 1 AS n, m.source AS loser, m.definition AS rejected, 'priority' AS resolution
  FROM w JOIN m ON w.element_key = m.element_key AND m.source <> w.source AND coalesce(trim(m.definition), '') <> '' AND lower(trim(m.definition)) <> lower(trim(w.v))
)"""
_KEY = b.NAME_KEY_SQL

ORACLES = {
    "fuse_ab_elements": f"{_FUSED} SELECT element_key, name, sources, mentions, documents, critical, definition, definition_source, domain, conflicts, confidence, confidence < 0.7 AS needs_review FROM f",
    "conflict_log": f"{_LOG} SELECT * FROM lost",
    "conflict_stats": f"{_LOG} SELECT resolution, count(*) AS conflicts, count(DISTINCT element_key) AS elements FROM lost GROUP BY resolution",
    "governance_unmatched": f"WITH {b.CONCEPTS}, {b.GOVERNANCE}, ak AS (SELECT *, {_KEY.format('name')} AS name_key FROM a), x AS (SELECT name, {_KEY.format('name')} AS element_key FROM b) SELECT * FROM x WHERE element_key NOT IN (SELECT name_key FROM ak)",
    "element_counts": f"{_FUSED} SELECT 'total' AS metric, count(*)::BIGINT AS value FROM f UNION ALL SELECT 'governed', count_if(governed)::BIGINT FROM f UNION ALL SELECT 'multi_source', count_if(contains(sources, '+'))::BIGINT FROM f UNION ALL SELECT 'sources ' || sources, count(*) FROM f GROUP BY sources",
    "confidence_stats": f"{_FUSED} SELECT min(confidence) AS least, median(confidence) AS median, avg(confidence) AS mean, max(confidence) AS greatest, count_if(confidence < 0.5)::BIGINT AS below_50, count_if(confidence >= 0.5 AND confidence < 0.7)::BIGINT AS below_70, count_if(confidence >= 0.7 AND confidence < 0.9)::BIGINT AS below_90, count_if(confidence >= 0.9)::BIGINT AS from_90, count_if(confidence < 0.7)::BIGINT AS needs_review FROM f",
    "corroboration_distribution": f"{_FUSED} SELECT CASE WHEN documents = 1 THEN '1' WHEN documents = 2 THEN '2' ELSE '3+' END AS documents, count(*) AS elements FROM f WHERE documents > 0 GROUP BY 1",
    "document_corroboration": f"WITH {b.CONCEPTS}, {b.GOVERNANCE}, {merge.identified_sql(_KEY).replace('SELECT * FROM a UNION ALL SELECT * FROM b', 'SELECT * FROM a')} SELECT element_key, string_agg(document, ',' ORDER BY q) AS documents, count(*) AS n FROM (SELECT element_key, document, min(seq) AS q FROM m GROUP BY ALL) GROUP BY element_key",
    "coverage_gaps": f"{_FUSED} SELECT element_key, CASE WHEN coalesce(trim(definition), '') = '' THEN 'warning' ELSE 'info' END AS severity, concat_ws(',', CASE WHEN coalesce(trim(definition), '') = '' THEN 'definition' END, CASE WHEN coalesce(trim(citation), '') = '' THEN 'citation' END) AS missing FROM f WHERE coalesce(trim(definition), '') = '' OR coalesce(trim(citation), '') = ''",
    "lookup": f"{_FUSED} SELECT element_key, name, definition FROM f WHERE element_key IN (SELECT {_KEY.format('upper(p_name)')} FROM part)",
    "search": f"{_FUSED} SELECT element_key, name, sources FROM f WHERE contains(element_key, 'red')",
    "anchor_coverage": f"{_ID} SELECT field, count_if(anchored)::BIGINT AS with_anchor, count_if(NOT anchored)::BIGINT AS without_anchor FROM (SELECT element_key, 'definition' AS field, bool_or(document IS NOT NULL) AS anchored FROM m WHERE definition IS NOT NULL GROUP BY 1 UNION ALL SELECT element_key, 'domain', bool_or(document IS NOT NULL) FROM m WHERE domain IS NOT NULL GROUP BY 1) GROUP BY field",
    "reference_prf1": f"""{_ID}, ref AS (SELECT * FROM a WHERE definition NOT LIKE 'SMALL%'), r0 AS (SELECT *, {_KEY.format('name')} AS name_key FROM ref),
  r1 AS (SELECT *, CASE WHEN eid IS NULL THEN true ELSE row_number() OVER (PARTITION BY eid ORDER BY seq) = 1 END AS touches FROM r0),
  r2 AS (SELECT *, first_value(CASE WHEN touches THEN eid END IGNORE NULLS) OVER (PARTITION BY name_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM r1),
  r3 AS (SELECT *, CASE WHEN eid IS NULL OR eid = base THEN name_key ELSE name_key || '#id:' || eid END AS own FROM r2),
  truth AS (SELECT DISTINCT CASE WHEN eid IS NULL THEN own ELSE first_value(own) OVER (PARTITION BY eid ORDER BY seq) END AS element_key FROM r3 UNION SELECT lower(r_name) FROM region),
  found AS (SELECT DISTINCT element_key FROM m), c AS (SELECT (SELECT count(*) FROM found SEMI JOIN truth USING (element_key)) AS tp, (SELECT count(*) FROM found ANTI JOIN truth USING (element_key)) AS fp, (SELECT count(*) FROM truth ANTI JOIN found USING (element_key)) AS fn)
  SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c""",
    "relationship_prf1": f"WITH {b.TRIPLES}, u AS (SELECT DISTINCT {_KEY.format('s')} AS s, p, {_KEY.format('o')} AS o FROM t), c AS (SELECT count_if(p <> 'in')::BIGINT AS tp, count_if(p = 'in')::BIGINT AS fp, 0::BIGINT AS fn FROM u) SELECT *, tp / (tp + fp) AS precision, 1.0::DOUBLE AS recall, 2 * (tp / (tp + fp)) / (tp / (tp + fp) + 1) AS f1 FROM c",
    "element_card": f"""{_FUSED}, {b.TRIPLES}, e AS (SELECT {_KEY.format('s')} AS element_key, 'out ' || p AS role FROM t UNION ALL SELECT {_KEY.format('o')}, 'in ' || p FROM t),
  l AS (SELECT element_key, array_to_string(list_sort(list(role || '=' || n)), '; ') AS links FROM (SELECT element_key, role, count(*) AS n FROM e GROUP BY ALL) GROUP BY element_key)
  SELECT element_key, concat_ws(' | ', name, definition, 'sources: ' || sources, 'conflicts: ' || conflicts, coalesce(links, 'no links')) AS card FROM f LEFT JOIN l USING (element_key)""",
    "review_summary": f"""{_FUSED}, r AS (SELECT 'contradiction' AS rule, 'warning' AS severity FROM f WHERE conflicts > 0 UNION ALL SELECT 'coverage_gap', CASE WHEN coalesce(trim(definition), '') = '' THEN 'warning' ELSE 'info' END FROM f WHERE coalesce(trim(definition), '') = '' OR coalesce(trim(citation), '') = '')
  SELECT coalesce(rule, 'all') AS rule, coalesce(severity, 'all') AS severity, count(*) AS n FROM r GROUP BY GROUPING SETS ((rule, severity), (rule), ())""",
    "f1_scores": "SELECT p_partkey, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT p_partkey, (p_size % 10) / 10 AS p, (p_size % 7) / 7 AS r FROM part)",
}

QUERIES = {f.__name__: f for f in (fuse_ab_elements, conflict_log, conflict_stats, governance_unmatched, element_counts, confidence_stats, corroboration_distribution, document_corroboration, coverage_gaps, reference_prf1, relationship_prf1, anchor_coverage, lookup, search, element_card, review_summary, f1_scores, plausible_terms)}


def _stop_sql() -> str:
    from metaloom.functions.text import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


ORACLES["plausible_terms"] = f"SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' AND term NOT IN ({_stop_sql()}) GROUP BY term"
