"""The driver's business tables as the four metadata sources.

Each binding exists twice: as a DataFrame and as a DuckDB common table
expression of the same rows, so that an oracle can inline it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A: one mention a part; some carry an id."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.lit("A").alias("source"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("id"), (F.col("p_partkey") % 40).cast("string"))).alias("eid"),
        F.concat("p_type", F.lit(" item of "), "p_brand").alias("definition"),
        F.element_at(F.array(F.lit(0.95), F.lit(0.75), F.lit(0.55)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("conf"),
        F.concat(F.lit("doc"), F.col("p_size").cast("string")).alias("document"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("boolean").alias("critical"), F.when(F.col("p_size") > 45, F.concat(F.lit("annex "), F.col("p_size").cast("string"))).alias("citation"),
    )


CONCEPTS = """a AS (
  SELECT p_partkey AS seq, 'A' AS source, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN 'id' || (p_partkey % 40) END AS eid,
    p_type || ' item of ' || p_brand AS definition, CASE p_partkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.75 ELSE 0.55 END::DOUBLE AS conf,
    'doc' || p_size AS document, NULL::VARCHAR AS domain, NULL::BOOLEAN AS critical, CASE WHEN p_size > 45 THEN 'annex ' || p_size END AS citation FROM part
)"""


def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B: the promotion parts under upper-case names, and the nations, which A lacks."""
    part = table(spark, sf_dir, "part").filter("p_type = 'PROMO'").select(
        (F.col("p_partkey") + 10**12).alias("seq"), F.lit("B").alias("source"), F.regexp_replace(F.upper("p_name"), " ", "_").alias("name"),
        F.when(F.col("p_partkey") % 77 == 0, F.concat(F.lit("id"), (F.col("p_partkey") % 40).cast("string"))).alias("eid"),
        F.concat("p_type", F.lit(" item of "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("stock")).alias("definition"),
        F.lit(0.95).alias("conf"), F.lit(None).cast("string").alias("document"), F.col("p_brand").alias("domain"), (F.col("p_size") > 25).alias("critical"), F.lit(None).cast("string").alias("citation"),
    )
    nation = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey").cast("long") + 2 * 10**12).alias("seq"), F.lit("B").alias("source"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("eid"),
        F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("definition"), F.lit(0.95).alias("conf"), F.lit(None).cast("string").alias("document"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("domain"), (F.col("n_nationkey") % 2 == 0).alias("critical"), F.when(F.col("n_regionkey") == 1, "article 1").alias("citation"),
    )
    return part.unionByName(nation)


GOVERNANCE = """b AS (
  SELECT p_partkey + 1000000000000 AS seq, 'B' AS source, replace(upper(p_name), ' ', '_') AS name, CASE WHEN p_partkey % 77 = 0 THEN 'id' || (p_partkey % 40) END AS eid,
    p_type || ' item of ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'stock' END AS definition, 0.95::DOUBLE AS conf, NULL::VARCHAR AS document, p_brand AS domain, p_size > 25 AS critical, NULL::VARCHAR AS citation
  FROM part WHERE p_type = 'PROMO'
  UNION ALL SELECT n_nationkey::BIGINT + 2000000000000, 'B', n_name, NULL, 'nation ' || n_nationkey, 0.95, NULL, 'region ' || n_regionkey, n_nationkey % 2 = 0, CASE WHEN n_regionkey = 1 THEN 'article 1' END FROM nation
)"""

#: P01 in DuckDB's SQL.
NAME_KEY_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[_-]', ' ', 'g'), '\s+', ' ', 'g'))"
LABEL_KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(strip_accents({0}))), '[\s_\-/.]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"

#: Table that a key column's name points to.
KEY_OWNERS = {"region": "region", "nation": "nation", "cust": "customer", "supp": "supplier", "part": "part", "order": "orders"}
SCHEMA_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source C: columns of the tables, read from the files' own schemas."""
    rows = []
    for t in SCHEMA_TABLES:
        for i, f in enumerate(table(spark, sf_dir, t).schema.fields):
            rows.append((t, f.name, f.dataType.simpleString().upper(), i))
    return spark.createDataFrame(rows, "model string, name string, field_type string, pos int")


SCHEMA_FIELDS = "c AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}', '{k}', {i})"
    for t, cols in {
        "region": [("r_regionkey", "INT"), ("r_name", "STRING")],
        "nation": [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")],
        "customer": [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE"), ("c_mktsegment", "STRING")],
        "supplier": [("s_suppkey", "BIGINT"), ("s_name", "STRING"), ("s_nationkey", "INT"), ("s_acctbal", "DOUBLE")],
        "part": [("p_partkey", "BIGINT"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"), ("p_size", "INT"), ("p_retailprice", "DOUBLE")],
        "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "STRING"), ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP_NTZ"), ("o_orderpriority", "STRING")],
        "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"), ("l_linenumber", "INT"), ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"), ("l_returnflag", "STRING"), ("l_linestatus", "STRING"), ("l_shipdate", "TIMESTAMP_NTZ")],
        "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP_NTZ"), ("user_id", "BIGINT"), ("event_type", "STRING"), ("value", "DOUBLE"), ("props", "STRING")],
    }.items()
    for i, (c, k) in enumerate(cols)
) + ") AS v(model, name, field_type, pos))"


def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source D: a threshold rule for each event type and bucket of users."""
    e = table(spark, sf_dir, "events").filter("event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL")
    grouped = e.groupBy("event_type", (F.col("user_id") % 16).alias("bucket")).agg(F.sum(F.floor("value")).alias("total"), F.count("*").alias("n"))
    return grouped.select(
        F.concat_ws("_", F.lit("check"), "event_type", F.col("bucket").cast("string")).alias("rule"), F.lit("validation").alias("kind"), F.col("event_type").alias("entity"), F.lit("value").alias("attribute"),
        F.when(F.col("bucket") % 2 == 0, "less_than").otherwise("greater_than").alias("predicate"), F.lit("int").alias("tag"), F.expr("total div (10 * n) * 10").cast("string").alias("value"),
        F.lit("").alias("condition"), F.when(F.col("bucket") % 3 == 0, 0.9).otherwise(0.7).alias("conf"), (F.col("bucket") + 3 * 10**12).alias("seq"),
    )


CODE_RULES = """d AS (
  SELECT 'check_' || event_type || '_' || bucket AS rule, 'validation' AS kind, event_type AS entity, 'value' AS attribute,
    CASE WHEN bucket % 2 = 0 THEN 'less_than' ELSE 'greater_than' END AS predicate, 'int' AS tag, ((total // (10 * n)) * 10)::BIGINT::VARCHAR AS value, '' AS condition,
    CASE WHEN bucket % 3 = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS conf, bucket + 3000000000000 AS seq
  FROM (SELECT event_type, user_id % 16 AS bucket, sum(floor(value)::BIGINT) AS total, count(*) AS n FROM events
    WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships: nation in region, supplier based in nation, supplier supplies part, customer places order."""
    nation, region, supplier, part, line = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "part", "lineitem"))
    one = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o"), F.lit(0.9).alias("conf"))
    two = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("s"), F.lit("based in").alias("p"), F.col("n_name").alias("o"), F.lit(0.8).alias("conf"))
    # keys are not made distinct first, as nearly all are; all rows of a supplier meet first, so that the names of a task are few
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name").repartition("l_suppkey")
    three = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("s"), F.lit("supplies").alias("p"), F.col("p_name").alias("o"), F.lit(0.7).alias("conf"))
    return one.union(two).union(three.distinct())


TRIPLES = """t AS (
  SELECT n_name AS s, 'in' AS p, r_name AS o, 0.9::DOUBLE AS conf FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'based in', n_name, 0.8 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT s_name, 'supplies', p_name, 0.7 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
)"""
