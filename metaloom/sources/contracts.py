"""Readers and writers of the stages' JSON contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOVERNANCE = T.StructType([T.StructField(c, k) for c, k in (("seq", T.LongType()), ("element_name", T.StringType()), ("domain_name", T.StringType()), ("definition", T.StringType()), ("is_critical", T.BooleanType()), ("citation", T.StringType()), ("extras", T.MapType(T.StringType(), T.StringType())), ("char_offset", T.IntegerType()), ("line", T.IntegerType()), ("col", T.IntegerType()))])
_KNOWN = {"element_name", "domain_name", "definition", "is_critical", "citation"}


def parse_governance(text: str) -> list[tuple]:
    """Records of one object or an array of them, each with where it begins.

    Strict JSON: a trailing comma or anything after the value is an error.
    """
    decoder = json.JSONDecoder()

    def skip(i: int) -> int:
        while i < len(text) and text[i] in " \t\r\n":
            i += 1
        return i

    def record(i: int, seq: int) -> tuple[tuple, int]:
        value, end = decoder.raw_decode(text, i)
        if not isinstance(value, dict) or not str(value.get("element_name") or "").strip():
            raise ValueError(f"record {seq} is no object with an element_name")
        critical = value.get("is_critical")
        if isinstance(critical, str):
            critical = critical.strip().lower() in ("true", "yes", "y", "1")
        extras = {k: v if isinstance(v, str) else json.dumps(v) for k, v in value.items() if k not in _KNOWN and v is not None}
        line_start = text.rfind("\n", 0, i) + 1
        get = lambda k: None if value.get(k) is None else str(value[k])
        return (seq, get("element_name"), get("domain_name"), get("definition"), bool(critical), get("citation"), extras, i, text.count("\n", 0, i) + 1, i - line_start + 1), end

    i, out = skip(0), []
    if i < len(text) and text[i] == "{":
        row, i = record(i, 0)
        out.append(row)
    elif i < len(text) and text[i] == "[":
        i = skip(i + 1)
        if i < len(text) and text[i] == "]":
            i += 1
        else:
            while True:
                row, i = record(i, len(out))
                out.append(row)
                i = skip(i)
                if i >= len(text) or text[i] not in ",]":
                    raise ValueError(f"a comma or a bracket is missing at {i}")
                i += 1
                if text[i - 1] == "]":
                    break
                i = skip(i)
    else:
        raise ValueError("neither an object nor an array")
    if skip(i) != len(text):
        raise ValueError(f"something follows the records at {i}")
    return out


def read_governance(files: DataFrame) -> DataFrame:
    """Records of all files ``(path, text)``, with ``path``."""
    schema = T.StructType([T.StructField("path", T.StringType()), *GOVERNANCE.fields])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf.path, pdf.text) for r in parse_governance(t)]
            yield pd.DataFrame(rows, columns=schema.names)

    return files.select("path", "text").mapInPandas(run, schema)


def governance_payload(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """Records of payloads ``(seq, text)`` that are an object, an array or ``{"records": [...]}``."""
    v = payloads.select("seq", F.parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")
    records = F.when(F.startswith(kind, F.lit("ARRAY")), F.col("v")).when(F.try_variant_get("v", "$.records", "variant").isNotNull(), F.try_variant_get("v", "$.records", "variant"))
    rows = v.withColumn("records", records)
    many = rows.filter("records IS NOT NULL").select("seq", F.explode(F.from_json(F.to_json("records"), "array<string>")).alias("r"))
    one = rows.filter("records IS NULL").select("seq", F.to_json("v").alias("r"))
    got = many.union(one).select("seq", F.parse_json("r").alias("r"))
    field = lambda k: F.try_variant_get("r", f"$.{k}", "string").alias(k)
    return got.select("seq", field("element_name"), field("domain_name"), field("definition"), field("citation")).filter("element_name IS NOT NULL")


SOURCE_A = "concepts array<struct<name:string,definition:string,citation:string,id:string,entity_type:string>>, relationships array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and relationships of extraction results, numbered by file and place."""
    raw = spark.read.schema(SOURCE_A).option("multiLine", True).option("mode", "FAILFAST").json(folder).select("*", F.col("_metadata.file_path").alias("path"))
    concepts = raw.select("path", F.posexplode("concepts").alias("ord", "c")).select("path", "ord", "c.*")
    return concepts, raw.select("path", F.posexplode("relationships").alias("ord", "r")).select("path", "ord", "r.*")


def read_versioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A contract whose major schema version must be 1."""
    raw = spark.read.schema(f"schema_version string, {schema}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.filter(F.when(F.substring_index("schema_version", ".", 1) == "1", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce("schema_version", F.lit("none"))))))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``(s, p, o, o_kind, dtype, lang)`` of N-Triples lines."""
    line = F.col("value")
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    rows = spark.read.text(path).filter(line.rlike(pattern))
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = F.regexp_extract(line, pattern, 3)
    literal = F.startswith(o, F.lit('"'))
    return rows.select(
        strip(F.regexp_extract(line, pattern, 1)).alias("s"), strip(F.regexp_extract(line, pattern, 2)).alias("p"), F.when(literal, F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(strip(o)).alias("o"),
        F.when(literal, "literal").when(F.startswith(o, F.lit("_:")), "blank").otherwise("iri").alias("o_kind"), F.nullif(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1), F.lit("")).alias("dtype"), F.nullif(F.regexp_extract(o, r'"@([A-Za-z-]+)$', 1), F.lit("")).alias("lang"),
    )


def write_ntriples(triples: DataFrame, path: str) -> None:
    """``(s, p, o)`` as lines; what begins with a scheme is an address, all else a text."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    o = F.when(F.col("o").rlike("^[a-z]+:\\S*$"), iri(F.col("o"))).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), o, F.lit("."))).write.mode("overwrite").text(path)


def log_line(operation, **fields):
    """One line of the audit log as a Column; line feeds become spaces, bars slashes."""
    clean = lambda c: F.trim(F.regexp_replace(F.translate(c, "\n|", " /"), r"\s+", " "))
    return F.concat_ws(" | ", F.lit(operation), *[F.concat(F.lit(f"{k}="), clean(v)) for k, v in fields.items()])
