"""SPARQL expressions as columns. An error is null; nothing raises at run time.

An `Ex` knows at compile time what it can: a number of known rank, a plain string, a boolean, an instant, a key of an
IRI with a known prefix, or just a term. Comparisons of known kinds touch native columns only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import algebra as A
from . import terms as T


@dataclass
class Ex:
    """kind: term, num, str, bool, time or key. For num, `exact` is the decimal value and `rank` an int or a column."""

    kind: str
    col: Column
    exact: Column | None = None
    rank: object = None
    prefix: str = ""
    const: str | None = None

    def term(self) -> Column:
        if self.const is not None:
            return F.lit(self.const)
        if self.kind == "num":
            if isinstance(self.rank, int):
                if self.rank >= 2:
                    return T.typed_term(self.col.cast("float") if self.rank == 2 else self.col, T.RANK_TYPE[self.rank])
                value = self.exact if self.exact is not None else self.col
                return T.typed_term(value.cast("decimal(38,0)") if self.rank == 0 else T.number_text(value), T.RANK_TYPE[self.rank])
            return T.number_term(self.col, self.exact, self.rank)
        if self.kind == "str":
            return T.string_term(self.col)
        if self.kind == "bool":
            return T.typed_term(self.col, f"{T.XSD}boolean")
        if self.kind == "time":
            return T.typed_term(time_text(self.col), f"{T.XSD}dateTime")
        if self.kind == "key":
            return F.concat(F.lit(self.prefix), self.col.cast("string"), F.lit(">"))
        return self.col

    def number(self) -> "Ex":
        if self.kind == "num":
            return self
        if self.kind == "term":
            return Ex("num", T.number(self.col), T.exact(self.col), T.rank(self.col))
        null = F.lit(None)
        return Ex("num", null.cast("double"), null.cast(T.DECIMAL), 3)

    def boolean(self) -> Column:
        return self.col if self.kind == "bool" else T.boolean(self.col) if self.kind == "term" else F.lit(None).cast("boolean")

    def time(self) -> Column:
        return self.col if self.kind == "time" else T.instant(self.col) if self.kind == "term" else F.lit(None).cast("timestamp")

    def plain(self) -> Column:
        return self.col if self.kind == "str" else T.plain(self.col) if self.kind == "term" else F.lit(None).cast("string")

    def text(self) -> Column:
        """The text of a string literal, tagged or not."""
        if self.kind == "str":
            return self.col
        s = T.suffix(self.term())
        return F.when((s == "") | F.startswith(s, F.lit("@")), T.lex(self.term()))

    def ebv(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.kind == "str":
            return self.col != ""
        if self.kind in ("time", "key"):
            return F.lit(None).cast("boolean")
        n = T.number(self.col)
        return F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(T.suffix(self.col) == f"^^<{T.XSD}boolean>", F.coalesce(T.boolean(self.col), F.lit(False))).otherwise(self.text() != "")


def time_text(ts: Column) -> Column:
    """xsd:dateTime text in UTC, without trailing zeros of the second."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def constant(term: str) -> Ex:
    """A constant of the most specific kind."""
    if term.startswith('"'):
        body, _, tail = term.rpartition('"')
        text = T.unescape(body[1:])
        if not tail:
            return Ex("str", F.lit(text), const=term)
        if tail.startswith("^^<"):
            dt = tail[3:-1]
            if dt in T.NUMERIC_RANK:
                r = T.NUMERIC_RANK[dt]
                return Ex("num", F.lit(text).try_cast("double"), F.lit(text).try_cast(T.DECIMAL) if r < 2 else None, r, const=term)
            if dt == f"{T.XSD}boolean":
                return Ex("bool", F.lit(text in ("true", "1")), const=term)
            if dt in (f"{T.XSD}dateTime", f"{T.XSD}date"):
                return Ex("time", F.lit(text).try_cast("timestamp"), const=term)
    return Ex("term", F.lit(term), const=term)


def equal(a: Ex, b: Ex) -> Column:
    """Value equality."""
    if b.const is not None and a.const is None:
        a, b = b, a
    if a.const is not None and a.kind == "term":  # an IRI, or a literal compared by term
        if b.kind == "key":
            fits = a.const.startswith(b.prefix)
            return b.col.cast("string") == a.const[len(b.prefix) : -1] if fits else F.when(b.col.isNotNull(), F.lit(False))
        if a.const.startswith("<") or "@" in a.const.rpartition('"')[2]:
            return b.term() == F.lit(a.const)
    if a.kind == b.kind == "key" and a.prefix == b.prefix:
        return a.col == b.col
    if "num" in (a.kind, b.kind):
        x, y = a.number(), b.number()
        if isinstance(x.rank, int) and isinstance(y.rank, int) and x.rank < 2 and y.rank < 2 and x.exact is not None and y.exact is not None:
            return x.exact == y.exact
        return x.col == y.col
    if "str" in (a.kind, b.kind):
        return a.plain() == b.plain()
    if "bool" in (a.kind, b.kind):
        return a.boolean() == b.boolean()
    if "time" in (a.kind, b.kind):
        return a.time() == b.time()
    x, y = a.term(), b.term()
    nx, ny, sx, sy = T.number(x), T.number(y), T.suffix(x), T.suffix(y)
    return (
        F.when(nx.isNotNull() & ny.isNotNull(), nx == ny)
        .when(x == y, F.lit(True))
        .when(~T.is_literal(x) | ~T.is_literal(y), F.lit(False))
        .when(T.instant(x).isNotNull() & T.instant(y).isNotNull(), T.instant(x) == T.instant(y))
        .when(((sx == "") | F.startswith(sx, F.lit("@"))) & ((sy == "") | F.startswith(sy, F.lit("@"))), F.lit(False))
        .when(T.boolean(x).isNotNull() & T.boolean(y).isNotNull(), T.boolean(x) == T.boolean(y))
    )


def less(a: Ex, b: Ex, op: str) -> Column:
    """Value order; null where the two can't be ordered."""
    do = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if "num" in (a.kind, b.kind):
        return do(a.number().col, b.number().col)
    if "str" in (a.kind, b.kind):
        return do(a.plain(), b.plain())
    if "time" in (a.kind, b.kind):
        return do(a.time(), b.time())
    if "bool" in (a.kind, b.kind):
        return do(a.boolean(), b.boolean())
    return F.coalesce(do(a.number().col, b.number().col), do(a.plain(), b.plain()), do(a.time(), b.time()), do(a.boolean(), b.boolean()))


def _arith(op: str, a: Ex, b: Ex) -> Ex:
    x, y = a.number(), b.number()
    fn = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    known = isinstance(x.rank, int) and isinstance(y.rank, int)
    r = max(x.rank, y.rank) if known else F.greatest(F.lit(x.rank) if isinstance(x.rank, int) else x.rank, F.lit(y.rank) if isinstance(y.rank, int) else y.rank)
    if op == "/":
        r = max(r, 1) if known else F.greatest(r, F.lit(1))
    if known and r >= 2:
        return Ex("num", fn(x.col.cast("double"), y.col.cast("double")), None, r)
    ex = lambda v: (v.exact if v.exact is not None else F.lit(None)).cast(T.DECIMAL)
    exact = fn(ex(x), ex(y))
    return Ex("num", fn(x.col.cast("double"), y.col.cast("double")), exact, r)


def _like(source: Ex, text: Column) -> Ex:
    """A string with the tag of its source."""
    if source.kind == "str":
        return Ex("str", text)
    return Ex("term", F.concat(F.lit('"'), T.escaped(text), F.lit('"'), T.suffix(source.term())))


def _regex(pattern: Ex, flags: Ex | None) -> Column:
    f = flags.plain() if flags else F.lit("")
    body = F.when(F.contains(f, F.lit("q")), F.concat(F.lit("\\Q"), pattern.plain(), F.lit("\\E"))).otherwise(pattern.plain())
    head = F.translate(f, "q", "")
    return F.when(head == "", body).otherwise(F.concat(F.lit("(?"), head, F.lit(")"), body))


def call(name: str, args: list[Ex]) -> Ex:
    """Operators and functions whose arguments are evaluated (all but IF, COALESCE, BOUND, EXISTS)."""
    a = args[0] if args else None
    b = args[1] if len(args) > 1 else None
    if name == "OR":
        return Ex("bool", a.ebv() | b.ebv())
    if name == "AND":
        return Ex("bool", a.ebv() & b.ebv())
    if name == "NOT":
        return Ex("bool", ~a.ebv())
    if name == "=":
        return Ex("bool", equal(a, b))
    if name == "!=":
        return Ex("bool", ~equal(a, b))
    if name in ("<", "<=", ">", ">="):
        return Ex("bool", less(a, b, name))
    if name == "IN":
        return Ex("bool", reduce(lambda x, y: x | y, [equal(a, x) for x in args[1:]], F.lit(False)))
    if name in "+-*/":
        return _arith(name, a, b)
    if name == "NEG":
        x = a.number()
        return Ex("num", -x.col, -x.exact if x.exact is not None else None, x.rank)
    if name == "SAMETERM":
        return Ex("bool", a.term() == b.term())
    if name == "ISIRI":
        return Ex("bool", T.is_iri(a.term()))
    if name == "ISBLANK":
        return Ex("bool", T.is_blank(a.term()))
    if name == "ISLITERAL":
        return Ex("bool", T.is_literal(a.term()))
    if name == "ISNUMERIC":
        return Ex("bool", F.when(a.term().isNotNull(), a.number().col.isNotNull()))
    if name == "STR":
        return a if a.kind == "str" else Ex("str", T.text(a.term()))
    if name == "LANG":
        return Ex("str", T.lang(a.term()))
    if name == "DATATYPE":
        return Ex("term", T.iri_term(T.datatype(a.term())))
    if name == "LANGMATCHES":
        tag, wanted = F.lower(a.plain()), F.lower(b.plain())
        return Ex("bool", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))
    if name == "IRI":
        return Ex("term", F.when(T.is_iri(a.term()), a.term()).otherwise(T.iri_term(a.plain())))
    if name == "BNODE":
        return Ex("term", F.concat(F.lit("_:"), F.md5(a.plain())) if a else F.concat(F.lit("_:"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    if name == "STRDT":
        return Ex("term", F.when(b.term() == f"<{T.XSD}string>", T.string_term(a.plain())).otherwise(F.concat(T.string_term(a.plain()), F.lit("^^"), b.term())))
    if name == "STRLANG":
        return Ex("term", F.concat(T.string_term(a.plain()), F.lit("@"), F.lower(b.plain())))
    if name == "UUID":
        return Ex("term", T.iri_term(F.concat(F.lit("urn:uuid:"), F.uuid())))
    if name == "STRUUID":
        return Ex("str", F.uuid())
    if name == "STRLEN":
        n = F.length(a.text())
        return Ex("num", n.cast("double"), n.cast(T.DECIMAL), 0)
    if name == "SUBSTR":
        start = F.round(b.number().col).cast("int")
        text = a.text()
        if len(args) == 2:
            return _like(a, F.substring(text, F.greatest(start, F.lit(1)), F.length(text) + 1))
        stop = start + F.round(args[2].number().col).cast("int")
        first = F.greatest(start, F.lit(1))
        return _like(a, F.substring(text, first, F.greatest(stop - first, F.lit(0))))
    if name in ("UCASE", "LCASE"):
        return _like(a, (F.upper if name == "UCASE" else F.lower)(a.text()))
    if name == "CONCAT":
        if all(x.kind == "str" for x in args):
            return Ex("str", F.concat(*[x.col for x in args]) if args else F.lit(""))
        tags = [T.suffix(x.term()) for x in args]
        same = reduce(lambda x, y: x & y, [t == tags[0] for t in tags])
        return Ex("term", F.concat(F.lit('"'), *[T.escaped(x.text()) for x in args], F.lit('"'), F.when(same, tags[0]).otherwise(F.lit(""))))
    if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
        fn = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name]
        return Ex("bool", fn(a.text(), b.text()))
    if name in ("STRBEFORE", "STRAFTER"):
        x, y = a.text(), b.text()
        place = F.position(y, x)
        part = F.substring(x, F.lit(1), place - 1) if name == "STRBEFORE" else F.substring(x, place + F.length(y), F.length(x) + 1)
        if a.kind == "str":
            return Ex("str", F.when(place > 0, part).when(place == 0, F.lit("")))
        return Ex("term", F.when(place > 0, _like(a, part).term()).when(place == 0, F.lit('""')))
    if name == "ENCODE_FOR_URI":
        out = F.url_encode(a.text())
        for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(x), F.lit(y))
        return Ex("str", out)
    if name == "REGEX":
        return Ex("bool", F.regexp_like(a.text(), _regex(b, args[2] if len(args) > 2 else None)))
    if name == "REPLACE":
        return _like(a, F.regexp_replace(a.text(), _regex(b, args[3] if len(args) > 3 else None), args[2].plain()))
    if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
        x = a.number()
        fns = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + 0.5)}
        return Ex("num", fns[name](x.col).cast("double"), fns[name](x.exact).cast(T.DECIMAL) if x.exact is not None else None, x.rank)
    if name == "RAND":
        return Ex("num", F.rand(), None, 3)
    if name == "NOW":
        return Ex("time", F.current_timestamp())
    if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
        fn = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[name]
        n = fn(a.time())
        return Ex("num", n.cast("double"), n.cast(T.DECIMAL), 0)
    if name == "SECONDS":
        n = F.second(a.time()) + F.concat(F.lit("0"), F.date_format(a.time(), ".SSSSSS")).try_cast("decimal(10,6)")
        return Ex("num", n.cast("double"), n.cast(T.DECIMAL), 1)
    if name in ("TZ", "TIMEZONE"):
        zone = F.regexp_extract(T.text(a.term()), r"(Z|[+-]\d\d:\d\d)$", 1)
        zone = F.when(a.time().isNotNull(), zone)
        if name == "TZ":
            return Ex("str", zone)
        sign = F.when(F.startswith(zone, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        part = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
        return Ex("term", T.typed_term(F.when(zone == "Z", F.lit("PT0S")).when(zone != "", F.when(part.isin("PT", "-PT"), F.lit("PT0S")).otherwise(part)), f"{T.XSD}dayTimeDuration"))
    if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
        t = a.plain()
        return Ex("str", F.md5(t) if name == "MD5" else F.sha1(t) if name == "SHA1" else F.sha2(t, int(name[3:])))
    if name.startswith("<"):
        return cast(name[1:-1], a)
    raise ValueError(f"unknown function {name}")


def cast(to: str, a: Ex) -> Ex:
    """xsd casts."""
    if to == f"{T.XSD}string":
        return Ex("str", T.text(a.term()))
    flag = a.boolean()
    if to in T.NUMERIC_RANK:
        x, r = a.number(), T.NUMERIC_RANK[to]
        from_text = F.trim(a.plain())
        from_flag = F.when(flag, 1).when(~flag, 0)
        value = F.coalesce(x.col.cast("double"), from_flag.cast("double"), from_text.try_cast("double"))
        if r >= 2:
            return Ex("num", value, None, r)
        parsed = F.when(from_text.rlike(r"^[+-]?\d+$" if r == 0 else r"^[+-]?(\d+\.?\d*|\.\d+)$"), from_text.try_cast(T.DECIMAL))
        exact = F.coalesce(x.exact if x.exact is not None else x.col.try_cast(T.DECIMAL), x.col.try_cast(T.DECIMAL), from_flag.cast(T.DECIMAL), parsed)
        if r == 0:
            exact = (F.signum(exact).cast("int") * F.floor(F.abs(exact))).cast(T.DECIMAL)
        return Ex("num", exact.cast("double"), exact, r)
    if to == f"{T.XSD}boolean":
        return Ex("bool", F.coalesce(flag, a.number().col != 0, F.when(a.plain().isin("true", "1"), True).when(a.plain().isin("false", "0"), False)))
    if to == f"{T.XSD}dateTime":
        return Ex("time", F.coalesce(a.time(), a.plain().try_cast("timestamp")))
    if to == f"{T.XSD}date":
        return Ex("term", T.typed_term(F.date_format(F.coalesce(a.time(), a.plain().try_cast("timestamp")), "yyyy-MM-dd"), to))
    raise ValueError(f"unknown cast {to}")


def compile_expr(e: object, lookup) -> Ex:
    """lookup(variable) -> Ex or None for a variable not in scope; EXISTS nodes must have been replaced by variables."""
    if isinstance(e, A.Const):
        return constant(e.term)
    if isinstance(e, A.Var):
        return lookup(e.name) or Ex("term", F.lit(None).cast("string"))
    if isinstance(e, A.Call):
        if e.name == "BOUND":
            x = lookup(e.args[0].name)
            return Ex("bool", x.col.isNotNull() if x else F.lit(False))
        if e.name in ("IF", "COALESCE"):
            args = [compile_expr(a, lookup) for a in e.args]
            if e.name == "IF":
                test, yes, no = args[0].ebv(), args[1], args[2]
                pick = lambda x, y: F.when(test, x).when(~test, y)
            else:
                yes, no = args[0], args[-1]
            kinds = {(x.kind, x.prefix, x.rank if isinstance(x.rank, int) else None) for x in (args[1:] if e.name == "IF" else args)}
            kind, prefix, r = next(iter(kinds))
            if len(kinds) > 1 or kind == "term" or (kind == "num" and r is None):
                cols = [x.term() for x in args]
                return Ex("term", pick(yes.term(), no.term()) if e.name == "IF" else F.coalesce(*cols))
            exact = None
            if kind == "num" and r < 2:
                exact = pick(yes.exact, no.exact) if e.name == "IF" else F.coalesce(*[x.exact for x in args])
            return Ex(kind, pick(yes.col, no.col) if e.name == "IF" else F.coalesce(*[x.col for x in args]), exact, r, prefix)
        return call(e.name, [compile_expr(a, lookup) for a in e.args])
    raise ValueError(f"no expression: {e}")
