"""Profiles: what types, predicates and attributes a domain declares (driver-side, written by a person)."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CARDINALITIES = {"1:1", "1:N", "N:1", "N:N"}
XSD = {"string", "integer", "decimal", "double", "date", "time", "dateTime", "dateTimeStamp", "duration", "boolean", "base64Binary", "anyURI"}


@dataclass
class Profile:
    """Four small tables and an alias map."""

    name: str
    types: DataFrame
    predicates: DataFrame
    required: DataFrame
    attributes: DataFrame
    aliases: DataFrame


def load_profile(spark: SparkSession, folder: str) -> Profile:
    """Reads ``schema.json`` and, if there is one, ``alias_map.json`` (which wins).

    Refuses subtypes that two types share, undeclared types, unknown cardinalities
    and value types, and more than one identifying attribute of a type.
    """
    raw = json.loads(Path(folder, "schema.json").read_text())
    types, required, attributes, owner = [], [], [], {}
    for name, t in raw.get("entity_types", {}).items():
        types.append((name, None))
        for sub in t.get("subtypes", []):
            if sub.lower() in owner or sub.lower() in {n.lower() for n in raw["entity_types"]}:
                raise ValueError(f"subtype {sub} is declared twice")
            owner[sub.lower()] = name
            types.append((sub, name))
        if t.get("required_fields"):
            required.append((name, sorted(t["required_fields"])))
        if sum(bool(a.get("is_id")) for a in t.get("attributes", [])) > 1:
            raise ValueError(f"{name} has several identifying attributes")
        for a in t.get("attributes", []):
            kind = a.get("data_type", "string").removeprefix("xsd:")
            if kind not in XSD:
                raise ValueError(f"{name}.{a['name']} has the unknown type {kind}")
            attributes.append((name, a["name"], f"xsd:{kind}", bool(a.get("required")), bool(a.get("is_id"))))
    known = {n.lower() for n, _ in types}
    predicates = []
    for name, p in raw.get("predicates", {}).items():
        if p.get("cardinality", "N:N") not in CARDINALITIES:
            raise ValueError(f"{name} has an unknown cardinality")
        for t in [*p.get("subject_types", []), *p.get("object_types", [])]:
            if t.lower() not in known:
                raise ValueError(f"{name} names the undeclared type {t}")
        predicates.append((name, p.get("subject_types", []), p.get("object_types", []), p.get("cardinality", "N:N")))
    side = Path(folder, "alias_map.json")
    aliases = raw.get("alias_map", {}) | (json.loads(side.read_text()) if side.exists() else {})
    make = spark.createDataFrame
    return Profile(
        raw.get("profile_name", Path(folder).name), make(types, "type string, parent string"), make(predicates, "predicate string, subjects array<string>, objects array<string>, cardinality string"), make(required, "type string, fields array<string>"),
        make(attributes, "type string, attribute string, xsd string, required boolean, is_id boolean"), make([(k.lower(), v) for k, v in aliases.items()], "alias string, canonical string"),
    )


def write_profile(scored: DataFrame, folder: str, name: str, listed: int = 25) -> None:
    """Core candidates as types, with a report of the best and of the rejected."""
    best = [r.asDict() for r in scored.filter("band = 'core_business'").orderBy("score", "merge_key", ascending=[False, True]).limit(listed).collect()]
    rejected = [r.asDict() for r in scored.filter("band = 'noise'").orderBy("score", "merge_key", ascending=[False, True]).limit(listed).collect()]
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "schema.json").write_text(json.dumps({"profile_name": name, "entity_types": {r["merge_key"]: {} for r in best}, "predicates": {}}, indent=1))
    Path(folder, "alias_map.json").write_text("{}")
    Path(folder, "induction_report.json").write_text(json.dumps({"top": best, "rejected": rejected}, indent=1))


def scoring(path: str, keys: set[str]) -> dict[str, float]:
    """A complete set of numbers, no other keys; booleans are no numbers."""
    raw = json.loads(Path(path).read_text())
    if set(raw) != keys:
        raise ValueError(f"expected exactly {sorted(keys)}")
    if any(isinstance(v, bool) or not isinstance(v, int | float) for v in raw.values()):
        raise ValueError("weights are numbers")
    return {k: float(v) for k, v in raw.items()}
