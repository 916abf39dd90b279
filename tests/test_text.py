"""Truth tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from metaloom.functions import text as x


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def parts(r):
    return tuple(r) if r is not None else None


lit = F.lit


def cases():
    return [
        (x.name_key(lit("  Loan_Status--Code ")), "loan status code"), (x.name_key(lit("a/b.c")), "a/b.c"), (x.label_key(lit(" Réf / N° 1 ")), "ref_n_1"), (x.label_key(lit("__a--b__")), "a_b"),
        (x.compact(lit("A_b-C d/e.f")), "abcdef"), (x.xsd_of_sql(lit("varchar(20)")), "xsd:string"), (x.xsd_of_sql(lit("numeric(10,2)[]")), "xsd:decimal"), (x.xsd_of_sql(lit("weird")), "xsd:string"),
        (x.xsd_of_python(lit("datetime.date")), "xsd:date"), (x.simple_of_xsd(lit("xsd:double")), "decimal"), (x.matches_glob(lit("Created_AT"), ["*_at"]), True), (x.matches_glob(lit("x"), []), False),
        (x.matches_path(lit("a/tests/x.py"), ["tests/**"]), True), (x.matches_path(lit("a/tests/s/x.py"), ["tests/**"]), False), (x.singular(lit("boxes")), "box"), (x.singular(lit("Parties")), "Party"), (x.singular(lit("status")), "status"),
        (x.citations(lit("see section 3, Section 3 and article 5a")), ["section 3", "article 5a"]), (x.text_field_score(lit("Bad  loan"), lit("a bad loan here")), 0.95), (x.text_field_score(lit(" "), lit("a")), 0.0),
        (x.enum_values(lit("a; b;;c")), ["a", "b", "c"]), (x.enum_values(lit("a,b")), ["a", "b"]), (x.f1(lit(0.0), lit(0.0)), 0.0), (x.f1(lit(1.0), lit(0.5)), 2 / 3), (x.truncated(lit("abcdefghij"), 8), "abcde..."),
        (x.name_similarity(lit("loan"), lit("Loans")), 0.95), (x.name_similarity(lit("loan"), lit("loan_book")), 0.5), (x.match_score(lit("past due"), lit("due date")), 1 / 3), (x.pascal_case(lit("loan status")), "LoanStatus"),
        (x.camel_case(lit("loan status")), "loanStatus"), (x.display_name(lit("loanStatus_code")), "Loan Status Code"), (x.compliant(lit("a  b!!c")), "a_b_c"), (x.is_plausible_term(lit("The loan")), False), (x.is_plausible_term(lit("Loan book")), True),
        (x.snippet(lit("LOAN"), lit("my loan")), "my loan"), (x.section(lit("# One\ntext\n## Two\nmore")), "Two"), (x.mean_score(F.array(lit(0.5), lit(1.0))), 0.75),
    ]


def test_scalars(spark):
    rows = cases()
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(rows)]).first()
    for i, (_, want) in enumerate(rows):
        assert got[i] == (pytest.approx(want) if isinstance(want, float) else want), i


def test_structs(spark):
    assert parts(value(spark, x.id_parts(lit("loan_bad_debt_a1b2c3")))) == ("loan", "bad_debt", "a1b2c3")
    assert parts(value(spark, x.concept_parts(lit("Loan (a sum lent)")))) == ("Loan", None, "a sum lent")
    assert parts(value(spark, x.concept_parts(lit("Loan (NPL)")))) == ("Loan (NPL)", None, "")
    assert parts(value(spark, x.concept_parts(lit("Loan :: T :: a :: b")))) == ("Loan", "T", "a :: b")
    assert parts(value(spark, x.triple_parts(lit("a => b => c")))) == ("a", "b", "c")
    assert parts(value(spark, x.triple_parts(lit("a | b")))) == ("a", "related_to", "b")
    assert value(spark, x.triple_parts(lit("nothing"))) is None
