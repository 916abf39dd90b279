"""Queries of routing, text and code extraction, contracts and the event stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from metaloom.functions import code
from metaloom.sources import bindings as b
from metaloom.sources import contracts, router
from metaloom.sources.bindings import table
from metaloom.streaming.attest import windowed_counts

_EXTENSIONS = [".md", ".sql", ".json", ".csv", ".txt", ".png", ".weird", ".py"]


def _files(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select(F.concat(F.lit("corpus/doc"), F.col("doc_id").cast("string"), ext).alias("path"), "text")


def route_files(spark, d):
    return router.route(_files(spark, d)).select("path", F.array_join("sources", "+").alias("sources"), "confidence", "layer")


def router_gate(spark, d):
    fine, logged = router.admitted(router.route(_files(spark, d)))
    return fine.groupBy(F.lit("dispatched").alias("outcome")).agg(F.count("*").alias("n")).union(logged.groupBy(F.lit("logged")).agg(F.count("*")))


def definitions(spark, d):
    """Definitions planted behind each document's text; positions depend on the text before."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n# Terms of "), "source", F.lit("\n**Default "), "lang", F.lit("**: an exposure that is past due by ninety days\n")).alias("text")).filter("text IS NOT NULL")
    return code.over_texts(t, "doc_id", "text", code.definitions, code.DEFINITION_SCHEMA).filter("pattern = 'bold' AND term LIKE 'Default %'").select("doc_id", "term", "section")


def _sources(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.max(F.floor("value")).alias("top"))
    lines = [F.concat(F.lit("LIMIT = "), F.col("top").cast("string")), F.concat(F.lit("def check_"), F.regexp_replace("event_type", "[^a-z]", "_"), F.lit("(e):")), F.lit('    """Checks a value. See section 4.2."""'), F.lit("    if e.value > LIMIT and e.user_id:"), F.lit("        return False"), F.lit("    return True")]
    return e.select("event_type", F.concat_ws("\n", *lines).alias("text"))


def code_rules(spark, d):
    got = code.over_texts(_sources(spark, d), "event_type", "text", code.python_rules, code.RULE_SCHEMA)
    return got.select("event_type", "rule_type", "expression", "line", F.array_join("citations", "|").alias("citations"))


def ddl_fields(spark, d):
    """Table definitions written from the driver's schemas and parsed again."""
    c = b.schema_fields(spark, d)
    column = F.concat_ws(" ", "name", "field_type", F.when(F.col("pos") == 0, "PRIMARY KEY").otherwise(F.when(F.col("pos") == 1, "NOT NULL")))
    texts = c.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", column.alias("t")))), lambda x: x["t"]), ",\n  ").alias("cols"))
    ddl = texts.select("model", F.concat(F.lit("-- generated\nCREATE TABLE IF NOT EXISTS "), "model", F.lit(" (\n  "), "cols", F.lit("\n);")).alias("text")).withColumnRenamed("model", "file")
    return code.over_texts(ddl, "file", "text", code.tables, code.TABLE_SCHEMA).select("model", "name", "field_type", "is_pk", "is_nullable", "pos")


def sql_rules(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("-- see article 7\nCREATE VIEW v"), F.col("n_nationkey").cast("string"), F.lit(" AS SELECT * FROM t WHERE k = "), F.col("n_nationkey").cast("string"), F.lit(";\nALTER TABLE t ADD CONSTRAINT c CHECK (k > 0);")).alias("text"))
    return code.over_texts(t, "n_nationkey", "text", code.sql_rules, code.SQL_RULE_SCHEMA)


def source_b_positions(spark, d):
    """Governance records written as JSON and read with their positions."""
    rows = b.governance(spark, d).select("name", "domain", "seq")
    files = rows.groupBy(F.coalesce("domain", F.lit("none")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(F.col("name").alias("element_name"), F.col("domain").alias("domain_name"))).alias("j")))).alias("r"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("r", lambda x: x["j"]), ",\n"), F.lit("\n]"))
    return contracts.read_governance(files.select("path", text.alias("text"))).select("path", "seq", "element_name", "line", "col")


def governance_payloads(spark, d):
    g = b.governance(spark, d).select("seq", F.to_json(F.struct(F.col("name").alias("element_name"), "definition")).alias("j"))
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("["), "j", F.lit("]"))).when(F.col("seq") % 3 == 1, F.concat(F.lit('{"records": ['), "j", F.lit("]}"))).otherwise(F.col("j"))
    return contracts.governance_payload(spark, g.select("seq", text.alias("text"))).select("seq", "element_name", "definition")


def audit_lines(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", contracts.log_line("fuse", name=F.concat(F.lit("a|b\n "), F.col("s_name")), key=F.col("s_suppkey").cast("string")).alias("line"))


def attestation_stream(spark, d):
    """The stream's windows when all events are in."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="stream-")
    folder = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*events*").option("maxFilesPerTrigger", 1).parquet(d + "/events.parquet*")
    query = windowed_counts(events).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/windows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/windows").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


_P = "WITH f AS (SELECT doc_id, 'corpus/doc' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.sql' WHEN 2 THEN '.json' WHEN 3 THEN '.csv' WHEN 4 THEN '.txt' WHEN 5 THEN '.png' WHEN 6 THEN '.weird' ELSE '.py' END AS path, coalesce(left(text, 8192), '') AS head, text FROM documents WHERE doc_id IS NOT NULL)"
_R = r""", n AS (SELECT *, doc_id % 8 AS k, len(regexp_extract_all(head, '(?m)^```')) // 2 AS fences, len(regexp_extract_all(head, '(?i)\b(?:create\s+table|alter\s+table|primary\s+key|references)\b')) AS ddl,
  len(regexp_extract_all(head, '(?i)\b(?:create\s+(?:or\s+replace\s+)?(?:view|procedure|function)|select|insert\s+into|case\s+when)\b')) AS steps, string_split(lower(string_split(head, chr(10))[1]), ',') AS cells FROM f),
m AS (SELECT *, len(list_filter(['element_name', 'definition', 'steward', 'owner', 'is_critical', 'domain_name', 'data element'], lambda w: len(list_filter(cells, lambda c: contains(c, w))) > 0)) AS g, len(list_filter(['table_name', 'column_name', 'data_type', 'nullable', 'primary_key', 'foreign_key'], lambda w: len(list_filter(cells, lambda c: contains(c, w))) > 0)) AS s FROM n),
r AS (SELECT path, CASE k WHEN 0 THEN CASE WHEN fences >= 3 THEN 'A+D' ELSE 'A' END WHEN 1 THEN CASE WHEN ddl >= steps AND ddl >= 1 THEN 'C' ELSE 'D' END WHEN 2 THEN 'C' WHEN 3 THEN CASE WHEN g < s THEN 'C' ELSE 'B' END WHEN 4 THEN 'A' WHEN 7 THEN 'D' ELSE '' END AS sources,
  CASE k WHEN 0 THEN CASE WHEN fences >= 3 THEN 0.85 ELSE 0.95 END WHEN 1 THEN CASE WHEN ddl >= steps AND ddl >= 1 THEN 0.9 WHEN steps >= 1 THEN 0.85 ELSE 0.6 END WHEN 2 THEN CASE WHEN json_valid(text) THEN 0.5 ELSE 0.6 END WHEN 3 THEN CASE WHEN greatest(g, s) >= 1 THEN 0.9 ELSE 0.6 END WHEN 5 THEN 0.99 ELSE 0.95 END::DOUBLE AS confidence,
  CASE WHEN k IN (0, 1, 2, 3) THEN 'sniff' WHEN k IN (4, 7) THEN 'extension' ELSE 'skip' END AS layer FROM m)"""

ORACLES = {
    "route_files": f"{_P}{_R} SELECT path, sources, confidence, layer FROM r",
    "router_gate": f"{_P}{_R} SELECT CASE WHEN confidence > 0.9 AND sources <> '' THEN 'dispatched' ELSE 'logged' END AS outcome, count(*) AS n FROM r GROUP BY 1",
    "definitions": "SELECT doc_id, 'Default ' || lang AS term, 'Terms of ' || source AS section FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL",
    "code_rules": "WITH e AS (SELECT event_type, max(floor(value)::BIGINT) AS top FROM events GROUP BY 1) SELECT event_type, 'constant' AS rule_type, 'LIMIT = ' || top AS expression, 1 AS line, '' AS citations FROM e UNION ALL SELECT event_type, 'function', 'check_' || regexp_replace(event_type, '[^a-z]', '_', 'g') || '(e)', 2, 'section 4.2.' FROM e UNION ALL SELECT event_type, 'condition', 'e.value > LIMIT and e.user_id', 4, '' FROM e",
    "ddl_fields": f"WITH {b.SCHEMA_FIELDS} SELECT model, name, field_type, pos = 0 AS is_pk, pos > 1 AS is_nullable, pos FROM c",
    "sql_rules": "SELECT n_nationkey, 'citation' AS rule_type, 'article 7' AS name, '-- see article 7' AS expression FROM nation UNION ALL SELECT n_nationkey, 'view', 'v' || n_nationkey, 'SELECT * FROM t WHERE k = ' || n_nationkey FROM nation UNION ALL SELECT n_nationkey, 'where', '', 'k = ' || n_nationkey FROM nation UNION ALL SELECT n_nationkey, 'check', 'c', 'k > 0' FROM nation",
    "source_b_positions": f"WITH {b.GOVERNANCE} SELECT coalesce(domain, 'none') AS path, row_number() OVER w - 1 AS seq, name AS element_name, row_number() OVER w + 1 AS line, 1 AS col FROM b WINDOW w AS (PARTITION BY coalesce(domain, 'none') ORDER BY seq)",
    "governance_payloads": f"WITH {b.GOVERNANCE} SELECT seq, name AS element_name, definition FROM b",
    "audit_lines": "SELECT s_suppkey, 'fuse | name=a/b ' || s_name || ' | key=' || s_suppkey AS line FROM supplier",
    "attestation_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (route_files, router_gate, definitions, code_rules, ddl_fields, sql_rules, source_b_positions, governance_payloads, audit_lines, attestation_stream)}
