"""Profiles, prompts and their answers, versions."""

import json

import pytest
from pyspark.sql import functions as F

from metaloom.operators import review
from metaloom.sources import profile

GOOD = {"profile_name": "p", "entity_types": {"Loan": {"subtypes": ["Mortgage"], "required_fields": ["definition"], "attributes": [{"name": "id", "data_type": "xsd:string", "is_id": True}]}, "Person": {}}, "predicates": {"owes": {"subject_types": ["Person"], "object_types": ["Loan"], "cardinality": "1:N"}}, "alias_map": {"Debt": "Loan"}}


def test_profile(spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps(GOOD))
    (tmp_path / "alias_map.json").write_text('{"Debt": "Mortgage"}')
    p = profile.load_profile(spark, str(tmp_path))
    assert {tuple(r) for r in p.types.collect()} == {("Loan", None), ("Mortgage", "Loan"), ("Person", None)}
    assert [tuple(r) for r in p.aliases.collect()] == [("debt", "Mortgage")] and p.attributes.first().is_id
    for path, bad in ((("entity_types", "Person"), {"subtypes": ["Mortgage"]}), (("predicates", "owes"), {"cardinality": "2:3"}), (("predicates", "owes"), {"object_types": ["Car"]})):
        broken = json.loads(json.dumps(GOOD))
        broken[path[0]][path[1]] = bad
        (tmp_path / "schema.json").write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            profile.load_profile(spark, str(tmp_path))


def test_scoring(tmp_path):
    (tmp_path / "w.json").write_text('{"a": 1, "b": true}')
    with pytest.raises(ValueError):
        profile.scoring(str(tmp_path / "w.json"), {"a", "b"})
    (tmp_path / "w.json").write_text('{"a": 1, "b": 0.5}')
    assert profile.scoring(str(tmp_path / "w.json"), {"a", "b"}) == {"a": 1.0, "b": 0.5}


def test_answers(spark):
    answer = "**Concept**: Credit event\n- Loan -> triggers -> Default\n* Default -> is a -> Event\nRationale: both sides meet there"
    r = review.parse_bridges(spark.createDataFrame([("a", "b", answer)], "i string, j string, answer string")).first()
    assert (r.concept, r.links, r.rationale) == ("Credit event", ["Loan -> triggers -> Default", "Default -> is a -> Event"], "both sides meet there")
    got = review.parse_attributes(spark.createDataFrame([("e", "- rate :: decimal :: yearly\nrate :: string\nodd :: shape\nnoise")], "element string, answer string"))
    assert {tuple(x) for x in got.collect()} == {("e", "rate", "xsd:decimal", "yearly"), ("e", "odd", "xsd:string", None)}


def test_cache_and_versions(spark, tmp_path):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "element string, attribute string")
    new = spark.createDataFrame([("b", "z")], "element string, attribute string")
    assert {tuple(r) for r in review.cache_merged(old, new).collect()} == {("a", "x"), ("b", "z")}
    hit, miss = review.cached(spark.createDataFrame([("a",), ("c",)], "element string"), old)
    assert [r.element for r in hit.collect()] == ["a"] and [r.element for r in miss.collect()] == ["c"]
    v = review.Versions(spark, str(tmp_path / "v"))
    v.checkpoint(old), v.checkpoint(new)
    assert v.undo() and not v.undo() and v.current().count() == 2
    assert v.redo() and not v.redo() and v.current().agg(F.max("attribute")).first()[0] == "z"
