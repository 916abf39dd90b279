"""Scalar functions of the fusion engine as Column expressions.

All are built from Catalyst's own functions, so they stay in generated code.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD_OF_SQL = {
    **dict.fromkeys(["VARCHAR", "CHAR", "TEXT", "UUID", "JSON", "STRING"], "string"),
    **dict.fromkeys(["INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "SERIAL", "BIGSERIAL", "LONG"], "integer"),
    **dict.fromkeys(["DECIMAL", "NUMERIC", "MONEY"], "decimal"),
    **dict.fromkeys(["FLOAT", "REAL", "DOUBLE", "DOUBLE PRECISION"], "double"),
    **dict.fromkeys(["BOOL", "BOOLEAN"], "boolean"),
    **dict.fromkeys(["TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"], "dateTime"),
    **dict.fromkeys(["BLOB", "BYTEA", "BINARY"], "base64Binary"),
    "TIMESTAMPTZ": "dateTimeStamp", "DATE": "date", "TIME": "time", "INTERVAL": "duration",
}
XSD_OF_PYTHON = {"str": "string", "int": "integer", "float": "double", "bool": "boolean", "Decimal": "decimal", "date": "date", "datetime": "dateTime", "time": "time", "timedelta": "duration", "bytes": "base64Binary", "UUID": "string"}
SIMPLE_OF_XSD = {"integer": "integer", "decimal": "decimal", "double": "decimal", "dateTime": "datetime", "dateTimeStamp": "datetime", "date": "date", "boolean": "boolean"}


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII characters in it, with these:
    those that stand for one, and those that stand for several."""
    one, several = {}, {}
    for n in range(0x80, 0x10000):
        ch = chr(n)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if x.isascii())
        if plain:
            (one if len(plain) == 1 else several)[ch] = plain
    return "".join(one), "".join(one.values()), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _foldings()
_COMBINING = "[\\u0300-\\u036f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\ufe20-\\ufe2f]"


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), default)


def name_key(c: Column) -> Column:
    """P01, the join key of fusion: lower case, underscores and hyphens as spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[_-]", " "), r"(?U)\s+", " "))


def ascii_fold(c: Column) -> Column:
    """The ASCII characters of the compatibility decomposition in place of what they come
    from (characters of the basic plane), and no combining marks. A text that is ASCII already costs one match.
    Characters that stand for several are looked for in a table: a class of them all costs a comparison each."""
    single = F.translate(F.regexp_replace(c, _COMBINING, ""), _FOLD_FROM, _FOLD_TO)
    # one character at a time, and only where there is one that stands for several
    table = F.create_map(*[F.lit(x) for pair in _FOLD_SEVERAL.items() for x in pair])
    spread = F.array_join(F.transform(F.split(single, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    return F.when(~c.rlike("[^\\x00-\\x7f]"), c).when(F.translate(single, "".join(_FOLD_SEVERAL), "") != single, spread).otherwise(single)


def label_key(c: Column) -> Column:
    """P02, the key of discovery: letters, digits and single underscores."""
    low = F.lower(F.trim(ascii_fold(c)))
    cleaned = F.regexp_replace(F.regexp_replace(low, r"[\s_\-/.]+", "_"), "[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(cleaned, "_+", "_"), "^_|_$", "")


def stable_id(kind: Column, label: Column, digits: int = 6) -> Column:
    """Type, label and the first hexadecimal digits of their hash; null for empty parts."""
    if digits < 4:
        raise ValueError("an id has four hash digits at least")
    whole = F.concat_ws("_", kind, label, F.left(F.sha2(F.concat(kind, F.lit("|"), label), 256), F.lit(digits)))
    return F.when((F.length(kind) > 0) & (F.length(label) > 0), whole)


def id_parts(c: Column) -> Column:
    """(type, label, hash) of a stable id; null parts where it is none."""
    pattern = r"^([^_]+)_(.*)_([0-9a-fA-F]+)$"
    part = lambda k: F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, k))
    return F.struct(part(1).alias("type"), part(2).alias("label"), part(3).alias("hash"))


def compact(c: Column) -> Column:
    """Lower case without separators."""
    return F.regexp_replace(F.lower(c), r"[\s_/.-]+", "")


def xsd_of_sql(c: Column) -> Column:
    """P06; arrays have the type of their elements, unknown types are strings."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"\(.*\)", ""), r"\[\]$", ""))
    return F.concat(F.lit("xsd:"), lookup(XSD_OF_SQL, base, F.lit("string")))


def xsd_of_python(c: Column) -> Column:
    """By the whole name, then by what follows the last dot."""
    return F.concat(F.lit("xsd:"), lookup(XSD_OF_PYTHON, c, lookup(XSD_OF_PYTHON, F.substring_index(c, ".", -1), F.lit("string"))))


def simple_of_xsd(c: Column) -> Column:
    """P08."""
    return lookup(SIMPLE_OF_XSD, F.regexp_replace(c, "^xsd:", ""), F.lit("string"))


def glob_regex(pattern: str, separators: bool = False) -> str:
    """A glob as a regular expression; with separators a star stays in one segment."""
    star, one = ("[^/]*", "[^/]") if separators else (".*", ".")
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += star
        elif ch == "?":
            out += one
        elif ch == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return out


def matches_glob(c: Column, patterns: list[str]) -> Column:
    """Any of the globs matches the whole name, case aside."""
    if not patterns:
        return F.lit(False)
    return F.lower(c).rlike("^(?:" + "|".join(glob_regex(p.lower()) for p in patterns) + ")$")


def matches_path(c: Column, patterns: list[str]) -> Column:
    """P10: any of the globs matches the path's last segments; ``**`` stands for one segment."""
    if not patterns:
        return F.lit(False)
    return F.lower(c).rlike("^(?:.*/)?(?:" + "|".join(glob_regex(p.lower(), True) for p in patterns) + ")$")


def singular(c: Column) -> Column:
    """-ies, -xes/-ches/-shes/-sses/-zes and -s; never -us, -ss, -is."""
    low = F.lower(c)
    return (
        F.when(low.rlike("(us|ss|is)$"), c)
        .when(low.rlike("[^aeiou]ies$"), F.regexp_replace(c, "(?i)ies$", "y"))
        .when(low.rlike("(x|ch|sh|ss|z)es$"), F.regexp_replace(c, "(?i)es$", ""))
        .when(low.rlike("[a-z]s$"), F.regexp_replace(c, "(?i)s$", ""))
        .otherwise(c)
    )


def canonical_label(c: Column, aliases: Column | None = None) -> Column:
    """An alias if there is one; else without warehouse prefixes, singular."""
    stripped = singular(F.regexp_replace(F.lower(c), "^(tbl_|dim_|fact_)", ""))
    return F.coalesce(aliases, stripped) if aliases is not None else stripped


def rule_key(kind: Column, entity: Column, attribute: Column, predicate: Column, tag: Column, value: Column, condition: Column) -> Column:
    """What makes two rules one; values keep their type's tag."""
    return F.struct(kind.alias("kind"), label_key(entity).alias("entity"), label_key(attribute).alias("attribute"), predicate.alias("predicate"), tag.alias("tag"), F.lower(F.trim(value)).alias("value"), label_key(F.coalesce(condition, F.lit(""))).alias("condition"))


def rule_label(entity: Column, attribute: Column, predicate: Column, value: Column) -> Column:
    """For display only."""
    return F.concat_ws(" ", F.concat_ws(".", entity, attribute), predicate, value)


CITATION = r"(?i)\b(?:section|para(?:graph)?|article|chapter|annex|table|figure|its|rts|directive|regulation)\s+[0-9][0-9A-Za-z./()-]*|§\s*[0-9][0-9A-Za-z./()-]*"


def citations(c: Column) -> Column:
    """References such as "section 3.1", each once (case aside), in order."""
    found = F.regexp_extract_all(c, F.lit(CITATION), F.lit(0))
    # the first of those that are equal in lower case stays
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def text_field_score(value: Column, source: Column) -> Column:
    """Contained .95; else by the share of longer words found: .75, .55, .35; empty 0."""
    words = F.filter(F.split(squeezed(value), " "), lambda w: F.length(w) > 3)
    text = squeezed(source)
    hit = F.size(F.filter(words, lambda w: F.contains(text, w)))
    share = F.when(F.size(words) > 0, hit / F.size(words)).otherwise(0.0)
    low = F.when(share >= 0.7, 0.75).when(share >= 0.4, 0.55).otherwise(0.35)
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", 0.0).when(F.contains(text, squeezed(value)), 0.95).otherwise(low)


def appears_score(value: Column, source: Column) -> Column:
    """.95 where the first 30 characters occur in the source, else .30."""
    return F.when(F.contains(F.lower(source), F.lower(F.left(value, F.lit(30)))), 0.95).otherwise(0.30)


def snippet(term: Column, source: Column, before: int = 50, after: int = 150) -> Column:
    """The text around the first hit, case aside; empty without one."""
    at = F.instr(F.lower(source), F.lower(term))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.trim(F.substr(source, start, at + after - start))).otherwise("")


def section(prefix: Column) -> Column:
    """The nearest heading (#) in what precedes; empty without one."""
    heads = F.filter(F.split(prefix, "\n"), lambda line: F.startswith(F.ltrim(line), F.lit("#")))
    return F.coalesce(F.trim(F.regexp_replace(F.try_element_at(heads, F.lit(-1)), "^[ #]+", "")), F.lit(""))


def concept_parts(line: Column) -> Column:
    """``name :: type :: definition``, ``name :: definition`` or ``name (definition)``;
    a bracketed acronym of five capitals at most is part of the name."""
    parts = F.transform(F.split(line, "::"), lambda s: F.trim(s))
    bracket = r"^(.*?)\s*\(([^()]+)\)\s*$"
    inner = F.regexp_extract(line, bracket, 2)
    has = (inner != "") & ~inner.rlike("^[A-Z]{1,5}$")
    three = F.struct(parts[0].alias("name"), parts[1].alias("type"), F.array_join(F.slice(parts, 3, 1000), " :: ").alias("definition"))
    two = F.struct(parts[0].alias("name"), F.lit(None).cast("string").alias("type"), F.try_element_at(parts, F.lit(2)).alias("definition"))
    one = F.struct(F.trim(F.when(has, F.regexp_extract(line, bracket, 1)).otherwise(line)).alias("name"), F.lit(None).cast("string").alias("type"), F.when(has, F.trim(inner)).otherwise("").alias("definition"))
    return F.when(F.size(parts) >= 3, three).when(F.size(parts) == 2, two).otherwise(one)


def triple_parts(line: Column) -> Column:
    """Subject, predicate, object by the first separator found; two parts are related_to."""

    def build(sep: str) -> Column:
        p = F.transform(F.split(line, re.escape(sep)), lambda s: F.trim(s))
        full = F.struct(p[0].alias("subject"), p[1].alias("predicate"), F.array_join(F.slice(p, 3, 1000), sep).alias("object"))
        pair = F.struct(p[0].alias("subject"), F.lit("related_to").alias("predicate"), F.try_element_at(p, F.lit(2)).alias("object"))
        return F.when(F.size(p) >= 3, full).when(F.size(p) == 2, pair)

    return F.coalesce(*[F.when(F.contains(line, F.lit(sep)), build(sep)) for sep in (" -> ", " --> ", " => ", " -- ", " | ")])


def mean_score(scores: Column) -> Column:
    """Mean of an array of scores, 0 without any."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    """P26."""
    x, y = F.regexp_replace(F.lower(a), "[_-]", ""), F.regexp_replace(F.lower(b), "[_-]", "")
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    plural = (F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x) | (F.concat(x, F.lit("es")) == y) | (F.concat(y, F.lit("es")) == x)
    return F.when(x == y, 1.0).when(plural, 0.95).when((short > 0) & (F.contains(x, y) | F.contains(y, x)), short / long).otherwise(0.0)


def match_score(a: Column, b: Column) -> Column:
    """Equal with or without separators 1; containment as a ratio of lengths; else Jaccard of words."""
    x, y = F.lower(a), F.lower(b)
    cx, cy = compact(a), compact(b)
    short, long = F.least(F.length(cx), F.length(cy)), F.greatest(F.length(cx), F.length(cy))
    wx, wy = (F.array_distinct(F.filter(F.split(w, r"[\s_/.-]+"), lambda t: t != "")) for w in (x, y))
    both, all_ = F.size(F.array_intersect(wx, wy)), F.size(F.array_union(wx, wy))
    return F.when((x == y) | (cx == cy), 1.0).when((short > 0) & (F.contains(cx, cy) | F.contains(cy, cx)), short / long).otherwise(F.when(all_ > 0, both / all_).otherwise(0.0))


def is_compliant(c: Column, longest: int = 26) -> Column:
    """A letter, then letters, digits and underscores."""
    return c.rlike("^[A-Za-z][A-Za-z0-9_]*$") & (F.length(c) <= longest)


def compliant(c: Column, longest: int = 26) -> Column:
    """The name made compliant."""
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", ""), F.lit(longest))


def pascal_case(c: Column) -> Column:
    """P29."""
    words = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def camel_case(c: Column) -> Column:
    """P29."""
    p = pascal_case(c)
    return F.concat(F.lower(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))


def fragment(c: Column) -> Column:
    """The part of an address that stands for a name."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ /]", "_")


def display_name(c: Column) -> Column:
    """Words of a camel-case or underscored name, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "_+", " ")))


def truncated(c: Column, limit: int) -> Column:
    """P30."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def enum_values(c: Column) -> Column:
    """Values of a text list, split at semicolons, else at commas; null without any."""
    parts = F.when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.split(c, ","))
    values = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda x: x != "")
    return F.when(F.size(values) > 0, values)


def f1(p: Column, r: Column) -> Column:
    """P32."""
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, 1.0).otherwise(p + r))


def rule_description(kind: Column, body: Column, refs: Column, file: Column, line: Column) -> Column:
    """``[kind] body (ref: ...) [file:line]``, absent parts left out."""
    ref = F.when(F.size(refs) > 0, F.concat(F.lit("(ref: "), F.array_join(refs, ", "), F.lit(")")))
    place = F.when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit("["), file, F.lit(":"), line.cast("string"), F.lit("]")))
    return F.concat_ws(" ", F.concat(F.lit("["), kind, F.lit("]")), body, ref, place)


def is_present(c: Column) -> Column:
    """P35 for texts: blank is missing."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


STOP_WORDS = ["the", "a", "an", "this", "that", "these", "those", "it", "its", "if", "when", "where", "which", "who", "and", "or", "but", "for", "in", "on", "at", "to", "of", "as", "by", "with", "from", "is", "are", "was", "were", "be", "been", "has", "have", "had", "we", "you", "they", "he", "she", "there", "here", "such", "each", "any", "all", "some", "no", "not", "what", "how", "why", "also", "then", "thus"]


def is_plausible_term(c: Column) -> Column:
    """the first word is no stop word; eight words at most; no trailing hyphen, comma or semicolon."""
    words = F.split(F.trim(c), r"\s+")
    return ~F.array_contains(F.array(*[F.lit(w) for w in STOP_WORDS]), F.lower(words[0])) & (F.size(words) <= 8) & ~F.contains(c, F.lit(",")) & ~F.contains(c, F.lit(";")) & ~F.endswith(c, F.lit("-")) & (F.trim(c) != "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
