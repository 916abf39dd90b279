"""Suppression, attributes, ranking, foldings and type resolution on small cases."""

import unicodedata

from pyspark.sql import functions as F

from metaloom.functions import text
from metaloom.operators import attributes, graph, review, suppress, validate


def test_label_keys_fold_as_the_decomposition_does(spark):
    names = ["Ligature ﬁn ﬄe", "Ｆｕｌｌ Ｗｉｄｔｈ ９", "ő š ž Ł Å ŉ ǅ", "naïve Café", "x² ½ ™ №5", "été", "plain_name-1", "ß Ø", "", "漢字 abc"]

    def brute(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip().lower()
        out = ""
        for c in s:
            out += "_" if c in " _-/.\t" else c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else ""
        while "__" in out:
            out = out.replace("__", "_")
        return out.strip("_")

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.label_key(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == {n: brute(n) for n in names}


def test_foldings_of_every_character_without_a_class_of_them_all(spark):
    """A class of hundreds of characters costs a comparison each, for each character of a text."""
    rows = [(f"a{ch}z", "a" + "".join(x for x in unicodedata.normalize("NFKD", ch) if x.isascii()) + "z") for ch in text._FOLD_FROM + "".join(text._FOLD_SEVERAL)]
    df = spark.createDataFrame([*rows, ("plain", "plain"), (None, None)], "n string, want string").select("n", "want", text.ascii_fold(F.col("n")).alias("got"))
    assert df.filter("NOT got <=> want").collect() == []
    assert df._jdf.queryExecution().analyzed().toString().count("RLIKE(") == 1  # for texts that are ASCII


def reasons(spark, names, column):
    return {r.n: r.r for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", column(F.col("n")).alias("r")).collect()}


def test_tables_and_columns_are_left_out_with_a_reason(spark):
    got = reasons(spark, ["orders", "Orders_Audit", "tmp_x", "tmp_kept"], lambda c: suppress.table_reason(c, ["orders"], ["tmp_k*"]))
    assert got == {"orders": "excluded by orders", "Orders_Audit": "noise *_audit", "tmp_x": "noise tmp_*", "tmp_kept": None}
    got = reasons(spark, ["created_at", "birth_at", "expiry_ts", "etag", "sys_a", "name"], lambda c: suppress.column_reason(c, ["expiry*"], ["sys_*"]))
    assert got == {"created_at": "noise created_at", "birth_at": None, "expiry_ts": "excluded by expiry*", "etag": "noise etag", "sys_a": None, "name": None}


def test_files_are_left_out_by_path_and_by_mark(spark):
    rows = [("a/b.py", "x = 1"), ("a/test_b.py", ""), ("pkg\\tests\\c.py", ""), ("gen.py", "\n\n# DO NOT EDIT\nx"), ("late.py", "\n" * 6 + "# DO NOT EDIT"), ("own/x.py", ""), ("none.py", None)]
    got = {r.p: r.r for r in spark.createDataFrame(rows, "p string, t string").select("p", suppress.file_reason(F.col("p"), F.col("t"), ["own/*.py"]).alias("r")).collect()}
    assert got == {"a/b.py": None, "a/test_b.py": "noise **/test_*.py", "pkg\\tests\\c.py": "noise tests/**", "gen.py": "generated # DO NOT EDIT", "late.py": None, "own/x.py": "excluded by own/*.py", "none.py": None}


def test_attributes_of_schema_and_code(spark):
    c = spark.createDataFrame([("Loan", "amount", "DECIMAL(10,2)", False, True), ("Loan", "id", "INT", True, False)], "entity string, name string, field_type string, is_id boolean, nullable boolean")
    d = spark.createDataFrame([("loan", "Amount", "float", "how much", False), ("loan", "tags", "str", "", True)], "entity string, name string, python_type string, description string, many boolean")
    got = {r.attribute_key: r for r in attributes.merged(c, d).collect()}
    assert (got["amount"].xsd, got["amount"].description, got["amount"].rejected, got["amount"].sources) == ("xsd:decimal", "how much", "xsd:double", "C+D")
    assert (got["tags"].sources, got["tags"].many, got["id"].is_id, got["id"].nullable) == ("D", True, True, False)
    records = spark.createDataFrame([("Loan", "int", None, None, 1), ("Rate", None, " ", "x", 1), ("rate", "double", "a;b, c", "y", 2), ("Rate", "int", None, "z", 3)], "name string, data_type string, enum_values string, definition string, seq int")
    got = attributes.governed(records, spark.createDataFrame([("loan",)], "entity string")).collect()
    assert [(r.entity_key, r.xsd, r.enum_values, r.description) for r in got] == [("rate", "xsd:double", "a;b, c", "y")]


def test_the_worst_rows_and_how_many_are_not_shown(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(7)], "a int, b int")
    got = [tuple(r) for r in graph.worst(rows, [F.asc("b"), F.desc("a")], 3).collect()]
    assert got == [(6, 0, None), (3, 0, None), (0, 0, None), (None, None, 4)]
    assert graph.worst(rows, [F.asc("a")], 7).count() == 7 and graph.worst(rows, [F.asc("a")], 0).count() == 0


def test_ranks_are_global(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int").repartition(5)
    assert {r.k: r["rank"] for r in review.ranked(rows, [F.desc("k")]).collect()} == {k: 101 - k for k in range(101)}
    assert review.ranked(rows.limit(0), [F.desc("k")]).collect() == []


def test_types_are_resolved_without_case(spark):
    types = spark.createDataFrame([("Nation", None), ("Region", None), ("Island", "Nation")], "type string, parent string")
    predicates = spark.createDataFrame([("in", ["Nation"], ["Region"], "N:1")], "predicate string, subjects array<string>, objects array<string>, cardinality string")
    entities = spark.createDataFrame([(1, "a", None, "nation"), (2, "b", None, "ISLAND"), (3, "r", None, "region"), (4, "z", None, "Other")], "seq int, name string, eid string, entity_type string")
    triples = spark.createDataFrame([("a", "in", "r"), ("b", "in", "r"), ("r", "in", "a"), ("z", "in", "r")], "s string, p string, o string")
    got = sorted((r.target, r.detail) for r in validate.domains_and_ranges(triples, entities, predicates, types).collect())
    assert got == [("r->in->a", "objects: nation"), ("r->in->a", "subjects: region"), ("z->in->r", "subjects: Other")]
