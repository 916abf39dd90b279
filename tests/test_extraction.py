"""Parsers and contracts."""

import pytest

from metaloom.functions import code
from metaloom.sources import contracts, router


def test_definitions():
    text = "# Head\n**Past due**: an amount that was not paid\nDefault means the failure to pay a debt.\n\"Cure period\" refers to the months after it\nThe thing means nothing much at all here\n"
    found = list(code.definitions(text))
    assert [(t, s) for t, _, s, _, _ in found] == [("Past due", "Head"), ("Default", "Head"), ("Cure period", "Head")]
    assert all(text[at:].lstrip("*\"").startswith(t) for t, _, _, at, _ in found)


def test_python_rules():
    source = 'DAYS = 90  # section 4\ndef late(x):\n    """Is late. See article 2."""\n    if x.days > DAYS:\n        return True\n    return False\n'
    kinds = [(r[0], r[1], r[3], r[5]) for r in code.python_rules(source)]
    assert ("constant", "DAYS", "90", []) in kinds and ("citation", "section 4", None, ["section 4"]) in kinds and ("function", "late", None, ["article 2."]) in kinds
    assert [r[2] for r in code.python_rules(source) if r[0] == "condition"] == ["x.days > DAYS"]
    assert list(code.python_rules("def (")) == []


def test_tables():
    sql = "CREATE TABLE IF NOT EXISTS s.loan (id SERIAL PRIMARY KEY, kind VARCHAR(10) NOT NULL CHECK (kind IN ('a', 'b')), rate NUMERIC(5, 2), owner INT REFERENCES p(id), f INT, FOREIGN KEY (f) REFERENCES q(id));"
    got = {r[1]: r for r in code.tables(sql)}
    assert list(got) == ["id", "kind", "rate", "owner", "f"] and got["id"][3] and not got["id"][4]
    assert got["kind"][5:7] == (["a", "b"], 10) and got["rate"][2] == "NUMERIC(5, 2)" and got["owner"][7] is None and got["f"][7] == "q"
    assert {r[1]: r[7] for r in code.tables(sql, inline_references=True)}["owner"] == "p"


def test_governance_positions():
    text = '[\n  {"element_name": "A", "is_critical": "yes", "x": 1},\n  {"element_name": "B"}\n]'
    rows = contracts.parse_governance(text)
    assert [(r[1], r[4], r[8], r[9]) for r in rows] == [("A", True, 2, 3), ("B", False, 3, 3)] and rows[0][6] == {"x": "1"}
    for bad in ('[{"element_name": "A"},]', '{"element_name": "A"} x', "[{}]", "1", ""):
        with pytest.raises(ValueError):
            contracts.parse_governance(bad)


def test_routes(spark):
    rows = [("a/x.sql", "CREATE TABLE t (id INT PRIMARY KEY)"), ("x.sql", "SELECT 1"), ("x.sql", "-- none"), ("g.csv", "element_name,owner\n"), ("s.csv", "column_name,data_type\n"), ("j.json", '{"element_name": 1}'), ("j.json", "{"), ("m.md", "```\n```\n" * 3), ("m.md", None), ("p.png", ""), ("q.zzz", "")]
    got = [("+".join(r.sources), r.confidence) for r in router.route(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert got == [("C", 0.9), ("D", 0.85), ("D", 0.6), ("B", 0.9), ("C", 0.9), ("B", 0.95), ("C", 0.6), ("A+D", 0.85), ("A", 0.95), ("", 0.99), ("", 0.95)]


def test_json_routes_of_whole_texts(spark):
    """Against DuckDB: a text that only begins as JSON is none."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["4501 Anth it", "45", " -1.5e3\n", "1 2", '"a" b', '{"a": 1} x', '{"a": {"b": [1, {}]}, "a": 2}', "[1,]", "[,]", "[1, 2", "1]", "01", "nan", "[-inf]", "true", "truex", '"\\ud800"', '"\\ud83d\\ude00\\u00e9"', '"a\tb"', "", " ", "1\x85", "inf it", "[" * 1100 + "]" * 1100, "1" * 1500, None]
    got = [r.confidence for r in router.route(spark.createDataFrame([("j.json", t) for t in texts], "path string, text string").coalesce(1)).collect()]
    con = duckdb.connect()
    assert got == [0.5 if con.execute("SELECT json_valid(?)", [t]).fetchall()[0][0] else 0.6 for t in texts]


def test_triples_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("https://x/a", "https://x/p", 'say "hi" \\ there'), ("https://x/a", "https://x/q", "https://x/b")], "s string, p string, o string")
    contracts.write_ntriples(df, str(tmp_path / "t"))
    got = {(r.p, r.o_kind) for r in contracts.read_ntriples(spark, str(tmp_path / "t")).collect()}
    assert got == {("https://x/p", "literal"), ("https://x/q", "iri")}
