"""Attributes of elements from schemas (C), code (D) and governance records (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.text import enum_values, name_key, simple_of_xsd, xsd_of_python, xsd_of_sql


def schema_matches(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """Each column ``(model, name, field_type, nullable)`` with the element that it
    enriches by name (type, mandatory flag, at .95); a column without one is a new element."""
    named = elements.select(name_key(F.col("name")).alias("k"), F.col("name").alias("element"))
    rows = fields.withColumn("k", name_key(F.col("name"))).join(named, "k", "left")
    return rows.select(
        "model", "name", "element", simple_of_xsd(xsd_of_sql(F.col("field_type"))).alias("data_type"), F.when(~F.col("nullable"), "M").alias("mandatory"),
        F.lit(0.95).alias("confidence"), F.when(F.col("element").isNull(), "new").otherwise("enriched").alias("outcome"),
    )


def merged(schema: DataFrame, code: DataFrame) -> DataFrame:
    """Attributes by entity and name. Of both, the schema's type, key, nullability and
    raw type win, and the code's description; many values are code's word. Where the
    types differ, the code's is logged as ``rejected``."""
    c = schema.select(name_key(F.col("entity")).alias("entity_key"), name_key(F.col("name")).alias("attribute_key"), xsd_of_sql(F.col("field_type")).alias("cx"), "field_type", "is_id", "nullable")
    d = code.select(name_key(F.col("entity")).alias("entity_key"), name_key(F.col("name")).alias("attribute_key"), xsd_of_python(F.col("python_type")).alias("dx"), "python_type", "description", "many")
    both = c.join(d, ["entity_key", "attribute_key"], "full_outer")
    sources = F.when(F.col("dx").isNull(), "C").when(F.col("cx").isNull(), "D").otherwise("C+D")
    return both.select(
        "entity_key", "attribute_key", F.coalesce("cx", "dx").alias("xsd"), F.coalesce("field_type", "python_type").alias("raw_type"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("is_id", F.lit(False)).alias("is_id"), F.coalesce("nullable", F.lit(True)).alias("nullable"), F.coalesce("many", F.lit(False)).alias("many"), sources.alias("sources"), F.when(F.col("cx") != F.col("dx"), F.col("dx")).alias("rejected"),
    )


def governed(records: DataFrame, taken: DataFrame) -> DataFrame:
    """One attribute, at .7, of each element that no table and no class has: from its
    first record that says anything of a type or of values."""
    rows = records.withColumn("entity_key", name_key(F.col("name"))).join(taken.select(name_key(F.col("entity")).alias("entity_key")).distinct(), "entity_key", "left_anti")
    values, kind = enum_values(F.col("enum_values")), F.nullif(F.trim("data_type"), F.lit(""))
    rows = rows.withColumn("kind", kind).withColumn("values", values).filter("kind IS NOT NULL OR values IS NOT NULL")
    order = ["seq"] if "seq" in records.columns else ["name", "data_type", "enum_values"]
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("entity_key").orderBy(*order))).filter("n = 1")
    xsd = F.coalesce(xsd_of_sql(F.col("kind")), F.lit("xsd:string"))
    return first.select("entity_key", F.col("name").alias("attribute"), xsd.alias("xsd"), F.coalesce("definition", F.lit("")).alias("description"), F.coalesce(F.array_join("values", ";"), F.lit("")).alias("enum_values"), F.lit(0.7).alias("confidence"))
