"""The verbs of the engine as functions that give named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from metaloom.operators import discover, merge, ontology, report, validate


def survey(events: DataFrame, triples: DataFrame) -> dict[str, DataFrame]:
    """Candidate events and relationships to scored candidates, by band."""
    found = discover.candidates(events).join(discover.degrees(triples), "norm", "left")
    scored = discover.relevance(found)
    return {"candidates": scored, "noise": scored.filter("band = 'noise'"), "core": scored.filter("band = 'core_business'")}


def check(entities: DataFrame, triples: DataFrame, types: DataFrame, predicates: DataFrame) -> dict[str, DataFrame]:
    """Findings of validation and lint, their counts, and what filter mode keeps."""
    findings = validate.all_findings([
        validate.unique(entities), validate.typed(entities, types), validate.known_predicates(triples, predicates), validate.domains_and_ranges(triples, entities, predicates, types),
        validate.cardinalities(triples, predicates), validate.orphans(entities, triples), validate.undefined(entities, triples),
    ])
    kept, fine = validate.survivors(entities, triples, types, predicates)
    return {"findings": findings, "summary": validate.by_rule(findings), "entities": kept, "triples": fine}


def draft(mentions: DataFrame, triples: DataFrame, attributes: DataFrame) -> dict[str, DataFrame]:
    """Mentions to fused elements, their report and the projected ontology."""
    fused = merge.fuse(mentions)
    return {"elements": fused, "counts": report.element_counts(fused), "confidence": report.confidence_stats(fused), "corroboration": report.corroboration(fused), "ontology": ontology.project(fused, triples, attributes)}
