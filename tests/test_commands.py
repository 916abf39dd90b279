"""The verbs on the smallest tables."""

import os

import pytest

from metaloom.functions.text import xsd_of_sql
from metaloom.plans import commands, discovery, validation
from metaloom.sources import bindings as b

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_verbs(spark):
    from pyspark.sql import functions as F

    found = commands.survey(discovery.events(spark, SF), b.triples(spark, SF))
    assert found["core"].count() + found["noise"].count() <= found["candidates"].count()
    fields = b.schema_fields(spark, SF).select("model", "name", xsd_of_sql(F.col("field_type")).alias("xsd"))
    made = commands.draft(b.concepts(spark, SF).unionByName(b.governance(spark, SF)), b.triples(spark, SF), fields)
    total = {r.metric: r.value for r in made["counts"].collect()}["total"]
    assert total == made["elements"].count() and made["ontology"].filter("o = 'owl:Class'").count() == total
    said = commands.check(validation.entities(spark, SF), validation.triples(spark, SF), validation.types(spark), validation.predicates(spark))
    assert said["findings"].count() == said["summary"].filter("rule = 'all'").first().n
