"""Text and code extraction: definitions, Python rules, table definitions.

These need positions or a syntax tree, which no built-in function has; each is a
plain parser over one text, run over Arrow batches by ``over_texts``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metaloom.functions.text import CITATION, STOP_WORDS

_CITED = re.compile(CITATION)


def over_texts(texts: DataFrame, key: str, text: str, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``parse`` for each text, each behind its key; null texts have none."""
    fields = T.StructType.fromDDL(schema)
    whole = T.StructType([T.StructField(key, texts.schema[key].dataType), *fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text]) if isinstance(t, str) for r in parse(t)]
            yield pd.DataFrame(rows, columns=whole.names).astype(object)

    return texts.select(key, text).mapInPandas(run, whole)


#: A token of JSON; as DuckDB reads it, so with nan and inf in any case.
_JSON_TOKEN = re.compile(
    r"[ \t\n\r]*+(?:(?P<mark>[\[\]{},:])"
    r'|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u(?:[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4})))*+")'
    r"|(?P<bare>-?(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|(?i:nan|inf(?:inity)?))|true|false|null))"
)


def whole_json(text: str) -> bool:
    """The whole text is one JSON value; commas may trail in lists and objects."""
    open_, want, at = [], "value", 0
    while m := _JSON_TOKEN.match(text, at):
        at, kind, mark = m.end(), m.lastgroup, m["mark"]
        if mark and mark in "]}":
            if not open_ or open_.pop() != mark or want not in ("after", "item" if mark == "]" else "key"):
                return False
            want = "after"
        elif want in ("value", "item") and mark in (None, "[", "{"):
            if mark:
                open_.append("]" if mark == "[" else "}")
            want = {"[": "item", "{": "key"}.get(mark, "after")
        elif want == "key" and kind == "text":
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "after" and mark == "," and open_:
            want = "item" if open_[-1] == "]" else "key"
        else:
            return False
    return want == "after" and not open_ and not text[at:].strip(" \t\n\r")


DEFINITION_SCHEMA = "term string, definition string, section string, char_offset int, pattern string"
_TERM, _BODY = r"(?P<t>[^*`\"\n]{2,100}?)", r"(?P<d>[^\n]{10,500})"
_DEFINITIONS = [
    ("bold", re.compile(rf"\*\*{_TERM}\*\*\s*[:–—-]\s*{_BODY}")),
    ("code", re.compile(rf"`{_TERM}`\s*[:–—-]\s*{_BODY}")),
    ("quoted", re.compile(rf"[\"“]{_TERM}[\"”]\s+(?:means|is|refers to)\s+{_BODY}")),
    ("is defined as", re.compile(rf"(?:^|(?<=[.!?]\s))(?P<t>[A-Z][\w /-]{{1,99}}?)\s+(?:is|are)\s+defined\s+as\s+{_BODY}", re.M)),
    ("means", re.compile(rf"(?:^|(?<=[.!?]\s))(?P<t>[A-Z][\w /-]{{1,99}}?)\s+means\s+{_BODY}", re.M)),
    ("refers to", re.compile(rf"(?:^|(?<=[.!?]\s))(?P<t>[A-Z][\w /-]{{1,99}}?)\s+refers\s+to\s+{_BODY}", re.M)),
    ("numbered", re.compile(rf"^\s*\(?\d+(?:\.\d+)*[.)]\s+(?P<t>[A-Z][\w /-]{{1,99}}?)\s*:\s+{_BODY}", re.M)),
]


def plausible(term: str) -> bool:
    words = term.split()
    return bool(words) and words[0].lower() not in STOP_WORDS and len(words) <= 8 and not term.endswith("-") and "," not in term and ";" not in term


def definitions(text: str) -> Iterator[tuple]:
    """Definitions in document order, each term and beginning once."""
    seen, found = set(), []
    heads = [(m.start(), m.group(1).strip()) for m in re.finditer(r"^#+\s*(.+)$", text, re.M)]
    for name, pattern in _DEFINITIONS:
        for m in pattern.finditer(text):
            term, body = m.group("t").strip(), m.group("d").strip()
            key = term.lower(), body[:50]
            if len(term) < 2 or len(body) < 10 or not plausible(term) or key in seen:
                continue
            seen.add(key)
            section = next((h for at, h in reversed(heads) if at < m.start()), "")
            found.append((term, body, section, m.start(), name))
    yield from sorted(found, key=lambda r: r[3])


RULE_SCHEMA = "rule_type string, name string, expression string, value string, symbols array<string>, citations array<string>, docstring string, line int, end_line int"


def _symbols(node: ast.AST) -> list[str]:
    out = []
    for n in ast.walk(node):
        if isinstance(n, ast.Attribute):
            try:
                out.append(ast.unparse(n))
            except ValueError:
                pass
        elif isinstance(n, ast.Name):
            out.append(n.id)
    return sorted(set(out))


def _cited(text: str) -> list[str]:
    out: dict[str, str] = {}
    for m in _CITED.finditer(text):
        out.setdefault(m.group(0).lower(), m.group(0))
    return list(out.values())


def python_rules(source: str) -> Iterator[tuple]:
    """Upper-case constants, functions, and every condition inside them; texts
    that do not parse have no rules."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    for number, line in enumerate(source.splitlines(), 1):
        if "#" in line:
            for c in _cited(line.partition("#")[2]):
                yield "citation", c, line.strip(), None, [], [c], None, number, number
    for node in tree.body:
        if isinstance(node, ast.Assign | ast.AnnAssign) and node.value is not None:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and target.id.isupper():
                    try:
                        value = repr(ast.literal_eval(node.value))
                    except ValueError:
                        continue
                    yield "constant", target.id, ast.unparse(node), value, [target.id], [], None, node.lineno, node.end_lineno
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            doc = ast.get_docstring(node) or ""
            args = ", ".join(a.arg for a in node.args.args)
            yield "function", node.name, f"{node.name}({args})", None, _symbols(node), _cited(doc), doc.split(".")[0].strip() or None, node.lineno, node.end_lineno
            for test in ast.walk(node):
                if isinstance(test, ast.If):
                    yield "condition", node.name, ast.unparse(test.test), None, _symbols(test.test), [], None, test.lineno, test.end_lineno


TABLE_SCHEMA = "model string, name string, field_type string, is_pk boolean, is_nullable boolean, choices array<string>, max_length int, references string, pos int"


def _parts(body: str) -> Iterator[str]:
    depth, quoted, start = 0, False, 0
    for i, ch in enumerate(body):
        if ch == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "," and depth == 0:
            yield body[start:i].strip()
            start = i + 1
    yield body[start:].strip()


def tables(sql: str, inline_references: bool = False) -> Iterator[tuple]:
    """Columns of CREATE TABLE statements; a table-level foreign key gives
    ``references``, an inline one only if asked for."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", text, re.I):
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        model = m.group(1).strip('"`').split(".")[-1]
        columns, pks, fks, checks = [], set(), {}, {}
        for part in _parts(text[m.end() : end - 1]):
            body = re.sub(r"^constraint\s+\w+\s+", "", part, flags=re.I)
            if p := re.match(r"primary\s+key\s*\(([^)]*)\)", body, re.I):
                pks |= {c.strip().strip('"`') for c in p.group(1).split(",")}
            elif p := re.match(r"foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`]+)", body, re.I):
                for c in p.group(1).split(","):
                    fks[c.strip().strip('"`')] = p.group(2).strip('"`').split(".")[-1]
            elif p := re.match(r"check\s*\(\s*(\w+)\s+in\s*\(([^)]*)\)\s*\)", body, re.I):
                checks[p.group(1)] = [v.strip().strip("'") for v in p.group(2).split(",")]
            elif re.match(r"(check|unique|exclude)\b", body, re.I):
                continue
            elif p := re.match(r"([\w\"`]+)\s+([A-Za-z_]+(?:\s+precision)?(?:\s*\([^)]*\))?(?:\[\])?)(.*)$", body, re.S):
                columns.append((p.group(1).strip('"`'), re.sub(r"\s+", " ", p.group(2)).strip(), p.group(3)))
        for pos, (name, kind, rest) in enumerate(columns):
            pk = name in pks or bool(re.search(r"primary\s+key", rest, re.I))
            listed = re.search(rf"check\s*\(\s*{re.escape(name)}\s+in\s*\(([^)]*)\)", rest, re.I)
            choices = [v.strip().strip("'") for v in listed.group(1).split(",")] if listed else checks.get(name)
            size = re.search(r"char[^(]*\(\s*(\d+)", kind, re.I)
            ref = re.search(r"references\s+([\w.\"`]+)", rest, re.I) if inline_references else None
            yield model, name, kind.upper(), pk, not (pk or bool(re.search(r"not\s+null", rest, re.I))), choices, int(size.group(1)) if size else None, ref.group(1) if ref else fks.get(name), pos


SQL_RULE_SCHEMA = "rule_type string, name string, expression string"


def sql_rules(sql: str) -> Iterator[tuple]:
    """Views, checks of ALTER TABLE and of tables, and the conditions of top-level selections (500 characters at most)."""
    for m in re.finditer(r"--([^\n]*)", sql):
        for c in _cited(m.group(1)):
            yield "citation", c, m.group(0).strip()
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    for statement in (s.strip() for s in text.split(";")):
        flat = re.sub(r"\s+", " ", statement)
        if m := re.match(r"create (?:or replace )?view ([\w.]+) as (.*)$", flat, re.I):
            yield "view", m.group(1), m.group(2)[:500]
        elif m := re.match(r"create table (?:if not exists )?([\w.]+)", flat, re.I):
            yield "table", m.group(1), flat[:500]
        if m := re.match(r"alter table ([\w.]+) add (?:constraint (\w+) )?check ?\((.*)\)$", flat, re.I):
            yield "check", m.group(2) or m.group(1), m.group(3)[:500]
        if (m := re.search(r" where (.*?)(?: group by | order by | having | limit |$)", flat, re.I)) and re.match(r"select|create (?:or replace )?view", flat, re.I):
            yield "where", "", m.group(1)[:500]
