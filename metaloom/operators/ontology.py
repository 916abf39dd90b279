"""Triples of an ontology: projection, diff, merge, renaming, lint, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.text import fragment

BASE = "https://example.org/"
KEPT_ONCE = ["rdfs:label", "rdfs:comment", "rdfs:domain", "rdfs:range"]


def project(fused: DataFrame, relationships: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(s, p, o)``: classes with label, comment and source; an object property
    for each predicate with its domains and ranges; a data property for each attribute."""
    iri = F.concat(F.lit(BASE), fragment(F.col("element_key")))
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    classes = fused.select(F.explode(F.array(
        t(iri, "rdf:type", F.lit("owl:Class")), t(iri, "rdfs:label", F.col("name")), t(iri, "rdfs:comment", F.col("definition")), t(iri, "dc:source", F.col("sources")),
    )).alias("t"))
    prop = F.concat(F.lit(BASE + "rel/"), fragment(F.col("p")))
    rel = relationships.select("p", "s", "o").distinct()
    props = rel.select(F.explode(F.array(
        t(prop, "rdf:type", F.lit("owl:ObjectProperty")), t(prop, "rdfs:label", F.col("p")),
        t(prop, "rdfs:domain", F.concat(F.lit(BASE), fragment(F.col("s")))), t(prop, "rdfs:range", F.concat(F.lit(BASE), fragment(F.col("o")))),
    )).alias("t"))
    data = F.concat(F.lit(BASE), F.col("model"), F.lit("/"), F.col("name"))
    fields = attributes.select(F.explode(F.array(
        t(data, "rdf:type", F.lit("owl:DatatypeProperty")), t(data, "rdfs:label", F.col("name")), t(data, "rdfs:domain", F.concat(F.lit(BASE), F.col("model"))), t(data, "rdfs:range", F.col("xsd")),
    )).alias("t"))
    return classes.union(props).union(fields).select("t.*").filter("o IS NOT NULL").distinct()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Triples of one side only, by one aggregation over both."""
    both = old.select("s", "p", "o", F.lit(True).alias("old")).union(new.select("s", "p", "o", F.lit(False).alias("old")))
    sides = both.groupBy("s", "p", "o").agg(F.min("old").alias("least"), F.max("old").alias("most")).filter("least = most")
    return sides.select("s", "p", "o", F.when(F.col("most"), "removed").otherwise("added").alias("change"))


def merge(base: DataFrame, other: DataFrame, conservative: bool = False) -> DataFrame:
    """Union; conservative keeps the base's label, comment, domain and range
    where it has one, and takes the least object where it has none."""
    if not conservative:
        return base.select("s", "p", "o").union(other.select("s", "p", "o")).distinct()
    once = F.col("p").isin(KEPT_ONCE)
    new = other.filter(once).join(base.select("s", "p").distinct(), ["s", "p"], "left_anti").groupBy("s", "p").agg(F.min("o").alias("o"))
    return base.select("s", "p", "o").union(other.filter(~once).select("s", "p", "o")).union(new.select("s", "p", "o")).distinct()


def rename(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Resources rewritten as subjects and as objects. names: ``(old, new)``, one row an old name."""
    a, b = names.select(F.col("old").alias("s"), F.col("new").alias("ns")), names.select(F.col("old").alias("o"), F.col("new").alias("no"))
    return triples.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("ns", "s").alias("s"), "p", F.coalesce("no", "o").alias("o")).distinct()


def lint(triples: DataFrame) -> DataFrame:
    """Classes without comment, without parent or child; properties without domain
    or range; labels that several classes share."""
    of = lambda p: triples.filter(F.col("p") == p).select("s", "o")
    classes = of("rdf:type").filter("o = 'owl:Class'").select("s")
    props = of("rdf:type").filter("o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')").select("s")
    out = [classes.join(of("rdfs:comment"), "s", "left_anti").select(F.lit("no_comment").alias("rule"), "s")]
    tied = of("rdfs:subClassOf")
    out.append(classes.join(tied.select("s").union(tied.select("o")).withColumnRenamed("s", "k"), F.col("s") == F.col("k"), "left_anti").select(F.lit("lonely_class").alias("rule"), "s"))
    for side in ("domain", "range"):
        out.append(props.join(of(f"rdfs:{side}"), "s", "left_anti").select(F.lit(f"no_{side}").alias("rule"), "s"))
    shared = classes.join(of("rdfs:label"), "s").groupBy(F.lower("o").alias("s")).agg(F.count_distinct("s").alias("n")).filter("n > 1")
    out.append(shared.select(F.lit("shared_label").alias("rule"), "s"))
    res = out[0]
    for x in out[1:]:
        res = res.union(x)
    return res


def domain_range(relationships: DataFrame) -> DataFrame:
    """One row a predicate with its numbers of domains and ranges."""
    return relationships.groupBy("p").agg(F.count_distinct("s").alias("domains"), F.count_distinct("o").alias("ranges"), F.min("s").alias("first_domain"), F.min("o").alias("first_range"))


def class_listing(triples: DataFrame) -> DataFrame:
    """Classes with label, comment, parents and children."""
    wide = triples.groupBy("s").agg(F.max((F.col("p") == "rdf:type") & (F.col("o") == "owl:Class")).alias("is_class"), F.min(F.when(F.col("p") == "rdfs:label", F.col("o"))).alias("label"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("p") == "rdfs:subClassOf", F.col("o")))), ",").alias("parents"))
    children = triples.filter("p = 'rdfs:subClassOf'").groupBy(F.col("o").alias("s")).agg(F.count_distinct("s").alias("children"))
    return wide.filter("is_class").join(children, "s", "left").select("s", "label", "parents", F.coalesce("children", F.lit(0)).alias("children"))


def reasoned(triples: DataFrame) -> DataFrame:
    """Transitive subclasses and subproperties, types by inheritance, domain and range."""
    from metaloom.operators.graph import closure

    t = triples.select("s", "p", "o")
    out = t
    for p in ("rdfs:subClassOf", "rdfs:subPropertyOf"):
        c = closure(t.filter(F.col("p") == p).select(F.col("s").alias("child"), F.col("o").alias("parent")))
        out = out.union(c.select(F.col("child").alias("s"), F.lit(p).alias("p"), F.col("parent").alias("o")))
    up = out.filter("p = 'rdfs:subPropertyOf'").select(F.col("s").alias("p"), F.col("o").alias("wide"))
    out = out.union(t.join(up, "p").select("s", F.col("wide").alias("p"), "o")).distinct()
    dom = t.filter("p = 'rdfs:domain'").select(F.col("s").alias("p"), F.col("o").alias("c"))
    ran = t.filter("p = 'rdfs:range'").select(F.col("s").alias("p"), F.col("o").alias("c"))
    typed = out.join(dom, "p").select("s", F.lit("rdf:type").alias("p"), F.col("c").alias("o")).union(out.join(ran, "p").select(F.col("o").alias("s"), F.lit("rdf:type"), F.col("c")))
    out = out.union(typed).distinct()
    sub = out.filter("p = 'rdfs:subClassOf'").select(F.col("s").alias("o"), F.col("o").alias("wide"))
    return out.union(out.filter("p = 'rdf:type'").join(sub, "o").select("s", "p", F.col("wide").alias("o"))).distinct()
