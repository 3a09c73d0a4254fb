"""RDF terms in one string column, as canonical N-Triples text, and typed views of them as column expressions.

`<iri>`, `_:label`, `"text"`, `"text"@lang`, `"text"^^<datatype>`. Plain literals leave out xsd:string, language tags are
lower-case, and text is escaped one way, so that equal strings are equal terms. Nothing here raises: a view that a term
doesn't have is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SCHEMA = "http://schema.org/"
RDF_TYPE = f"<{RDF}type>"
INTEGERS = ["integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"]
NUMERIC_RANK = {f"{XSD}{t}": 0 for t in INTEGERS} | {f"{XSD}decimal": 1, f"{XSD}float": 2, f"{XSD}double": 3}
RANK_TYPE = [f"{XSD}integer", f"{XSD}decimal", f"{XSD}float", f"{XSD}double"]
DECIMAL = "decimal(38,12)"

_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def escape(text: str) -> str:
    for a, b in _ESCAPES:
        text = text.replace(a, b)
    return text


def unescape(text: str) -> str:
    """Undo N-Triples escapes, \\u and \\U too."""
    plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), text, flags=re.S)


def iri(value: str) -> str:
    return f"<{value}>"


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    """The canonical term of a literal."""
    body = f'"{escape(text)}"'
    if lang:
        return f"{body}@{lang.lower()}"
    return body if datatype in (None, f"{XSD}string") else f"{body}^^<{datatype}>"


_TERM = re.compile(r'<([^<>"{}|^`\\\x00-\x20]*)>$|_:([\w.-]+)$|"((?:[^"\\\n\r]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?$', re.S)


def canonical(term: str) -> str:
    """A term in any N-Triples spelling, in the canonical one; a ValueError if it is none."""
    m = _TERM.match(term)
    if not m:
        raise ValueError(f"not a term: {term[:80]}")
    return term if m[3] is None else literal(unescape(m[3]), m[5], m[4])


# --- columns -------------------------------------------------------------------------------------------------------


def escaped(text: Column) -> Column:
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in reversed(_ESCAPES[1:]):
        out = F.replace(out, F.lit(b), F.lit(a))
    return F.when(F.contains(text, F.lit("\\")), F.replace(out, F.lit("\x00"), F.lit("\\"))).otherwise(text)


def iri_term(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def string_term(text: Column) -> Column:
    return F.concat(F.lit('"'), escaped(text), F.lit('"'))


def typed_term(text: Column, datatype: str) -> Column:
    """A literal of a datatype whose text needs no escapes (numbers, dates, booleans)."""
    return F.concat(F.lit('"'), text.cast("string"), F.lit(f'"^^<{datatype}>'))


def is_iri(t: Column) -> Column:
    return F.startswith(t, F.lit("<"))


def is_blank(t: Column) -> Column:
    return F.startswith(t, F.lit("_"))


def is_literal(t: Column) -> Column:
    return F.startswith(t, F.lit('"'))


def _closing(t: Column) -> Column:
    return F.length(t) - F.instr(F.reverse(t), '"') + 1


def suffix(t: Column) -> Column:
    """What follows a literal's text: nothing, @lang or ^^<datatype>."""
    return F.when(is_literal(t), F.substring(t, _closing(t) + 1, F.lit(1 << 30)))


def lex(t: Column) -> Column:
    """A literal's text."""
    return F.when(is_literal(t), unescaped(F.substring(t, F.lit(2), _closing(t) - 2)))


def iri_text(t: Column) -> Column:
    return F.when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2))


def text(t: Column) -> Column:
    """STR: a literal's text, an IRI without brackets."""
    return F.coalesce(lex(t), iri_text(t))


def lang(t: Column) -> Column:
    s = suffix(t)
    return F.when(F.startswith(s, F.lit("@")), F.substring(s, F.lit(2), F.length(s))).when(s.isNotNull(), F.lit(""))


def datatype(t: Column) -> Column:
    s = suffix(t)
    return F.when(s == "", F.lit(f"{XSD}string")).when(F.startswith(s, F.lit("@")), F.lit(f"{RDF}langString")).when(s.isNotNull(), F.substring(s, F.lit(4), F.length(s) - 4))


def rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double; null for what is no number."""
    s = suffix(t)
    kind = F.when(s.isin([f"^^<{XSD}{x}>" for x in INTEGERS]), 0)
    for r in (1, 2, 3):
        kind = kind.when(s == f"^^<{RANK_TYPE[r]}>", r)
    return F.when(number(t).isNotNull(), kind)


def number(t: Column) -> Column:
    """The double value of a numeric literal; INF and NaN included."""
    s = suffix(t)
    body = F.trim(lex(t))
    body = F.when(body == "INF", "Infinity").when(body == "-INF", "-Infinity").otherwise(body)
    return F.when(s.isin([f"^^<{x}>" for x in NUMERIC_RANK]), body.try_cast("double"))


def exact(t: Column) -> Column:
    """The decimal value of an integer or decimal literal."""
    s = suffix(t)
    return F.when(s.isin([f"^^<{x}>" for x, r in NUMERIC_RANK.items() if r <= 1]), lex(t).try_cast(DECIMAL))


def boolean(t: Column) -> Column:
    body = lex(t)
    return F.when(suffix(t) == f"^^<{XSD}boolean>", F.when(body.isin("true", "1"), True).when(body.isin("false", "0"), False))


def instant(t: Column) -> Column:
    """The timestamp of an xsd:dateTime or xsd:date."""
    return F.when(suffix(t).isin(f"^^<{XSD}dateTime>", f"^^<{XSD}date>", f"^^<{XSD}dateTimeStamp>"), lex(t).try_cast("timestamp"))


def plain(t: Column) -> Column:
    """The text of a plain string literal."""
    return F.when(suffix(t) == "", lex(t))


def number_text(value: Column) -> Column:
    """A decimal without trailing zeros."""
    body = value.cast("string")
    short = F.regexp_replace(body, r"(\.\d*?)0+$", "$1")
    return F.when(F.contains(body, F.lit(".")), F.regexp_replace(short, r"\.$", "")).otherwise(body)


def number_term(value: Column, exact_value: Column, r: Column) -> Column:
    """A literal of rank r: integers and decimals from their exact value, the others from the double."""
    return (
        F.when(r == 0, typed_term(exact_value.cast("decimal(38,0)"), RANK_TYPE[0]))
        .when(r == 1, typed_term(number_text(exact_value), RANK_TYPE[1]))
        .when(r == 2, typed_term(value.cast("float"), RANK_TYPE[2]))
        .when(r == 3, typed_term(value, RANK_TYPE[3]))
    )


def sort_key(t: Column) -> Column:
    """Ascending: unbound, blank nodes, IRIs, literals; numbers by value before other literals, those by time or text."""
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    n, ts = number(t), instant(t)
    return F.struct(kind.alias("kind"), F.when(n.isNotNull(), 0).when(ts.isNotNull(), 1).otherwise(2).alias("sort"), n.alias("n"), ts.alias("ts"), F.coalesce(text(t), t).alias("text"), t.alias("term"))


def typed(t: Column, kind: str) -> Column:
    """A term as a Spark value: string, iri, long, double, boolean, timestamp, date, decimal or term."""
    views = {"string": text, "iri": iri_text, "term": lambda c: c, "double": number, "boolean": boolean, "timestamp": instant, "decimal": exact}
    if kind in views:
        return views[kind](t)
    if kind == "long":
        return F.coalesce(exact(t).cast("decimal(38,0)").try_cast("bigint"), F.floor(number(t)).try_cast("bigint"))
    if kind == "date":
        return instant(t).cast("date")
    raise ValueError(f"no view {kind}")
