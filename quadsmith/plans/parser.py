"""SPARQL 1.1 queries and updates (and LATERAL), by recursive descent, into the algebra."""

from __future__ import annotations

import itertools
import re
from urllib.parse import urljoin

from ..functions.terms import RDF, RDF_TYPE, RDFS, SCHEMA, XSD, literal, unescape
from . import algebra as A

PREFIXES = {"schema": SCHEMA, "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "fts": "urn:quadsmith:fts#"}
MAX_DEPTH = 64


class SparqlError(ValueError):
    """A query that doesn't parse or asks for what is not supported."""


_TOKEN = re.compile(
    r"""(?P<ws>(?:\s+|\#[^\n]*)+)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<var>[?$][A-Za-z_0-9·À-￿]+)
  |(?P<bnode>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
  |(?P<double>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  |(?P<decimal>\d*\.\d+)
  |(?P<integer>\d+)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<pname>(?:[A-Za-zÀ-￿][\w.-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
  |(?P<op>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?$])""",
    re.X | re.S,
)
_BUILTINS = {
    "STR", "LANG", "LANGMATCHES", "DATATYPE", "BOUND", "IRI", "URI", "BNODE", "RAND", "ABS", "CEIL", "FLOOR", "ROUND", "CONCAT", "STRLEN", "UCASE", "LCASE",
    "ENCODE_FOR_URI", "CONTAINS", "STRSTARTS", "STRENDS", "STRBEFORE", "STRAFTER", "YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS", "TIMEZONE", "TZ", "NOW",
    "UUID", "STRUUID", "MD5", "SHA1", "SHA256", "SHA384", "SHA512", "COALESCE", "IF", "STRLANG", "STRDT", "SAMETERM", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL",
    "ISNUMERIC", "REGEX", "SUBSTR", "REPLACE",
}
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Parser:
    def __init__(self, text: str):
        if re.search(r"<<", re.sub(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|<[^<>\s]*>|#[^\n]*', "", text)):
            raise SparqlError("triple terms are not supported")
        self.tokens: list[tuple[str, str]] = []
        at = depth = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind = m.lastgroup
            if kind != "ws":
                depth += (m[0] in "{([") - (m[0] in "})]") if kind == "op" else 0
                if depth > MAX_DEPTH:
                    raise SparqlError(f"nested deeper than {MAX_DEPTH}")
                self.tokens.append((kind, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0
        self.prefixes = dict(PREFIXES)
        self.base = ""
        self.fresh = itertools.count()

    # --- tokens

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at]
        return text.upper() in words if kind == "word" else text in words and kind in ("op", "word")

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            raise SparqlError(f"{' or '.join(words)} expected, not {self.tokens[self.at][1]!r}")
        return got

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    # --- terms

    def iri(self) -> str:
        kind = self.kind()
        if kind == "iri":
            text = unescape(self.next()[1:-1])
            return f"<{urljoin(self.base, text) if self.base and ':' not in text.split('/')[0] else text}>"
        if kind == "pname":
            prefix, _, local = self.next().partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}:")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        raise SparqlError(f"IRI expected, not {self.tokens[self.at][1]!r}")

    def new_blank(self) -> str:
        return f"?_:{next(self.fresh)}"

    def literal(self) -> str | None:
        kind = self.kind()
        if kind == "string":
            raw = self.next()
            n = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
            body = unescape(raw[n:-n])
            if self.kind() == "lang":
                return literal(body, lang=self.next()[1:])
            if self.take("^^"):
                return literal(body, self.iri()[1:-1])
            return literal(body)
        if kind in ("integer", "decimal", "double"):
            return literal(self.next(), XSD + kind)
        if self.peek("+", "-") and self.tokens[self.at + 1][0] in ("integer", "decimal", "double"):
            sign = self.next()
            kind = self.kind()
            return literal(("-" if sign == "-" else "") + self.next(), XSD + kind)
        if self.peek("TRUE", "FALSE"):
            return literal(self.next().lower(), f"{XSD}boolean")
        return None

    def term(self, triples: list[A.Triple]) -> str:
        """A node of a triple pattern; bracketed ones add triples."""
        kind = self.kind()
        if kind == "var":
            return "?" + self.next()[1:]
        if kind == "bnode":
            return "?" + self.next()
        if kind in ("iri", "pname"):
            return self.iri()
        if self.take("["):
            node = self.new_blank()
            if not self.peek("]"):
                self.property_list(node, triples)
            self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.peek(")"):
                items.append(self.term(triples))
            self.need(")")
            nodes = [self.new_blank() for _ in items] + [f"<{RDF}nil>"]
            for i, item in enumerate(items):
                triples.append(A.Triple(nodes[i], f"<{RDF}first>", item))
                triples.append(A.Triple(nodes[i], f"<{RDF}rest>", nodes[i + 1]))
            return nodes[0]
        got = self.literal()
        if got is None:
            raise SparqlError(f"term expected, not {self.tokens[self.at][1]!r}")
        return got

    # --- triples and paths

    def property_list(self, subject: str, triples: list[A.Triple]) -> None:
        while True:
            if self.kind() == "var":
                verb: object = "?" + self.next()[1:]
            else:
                path = self.path()
                verb = path.iri if isinstance(path, A.Link) else path
            while True:
                triples.append(A.Triple(subject, verb, self.term(triples)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek(".", "]", "}") or self.kind() == "end" or self.peek("FILTER", "OPTIONAL", "BIND", "GRAPH", "MINUS", "VALUES", "SERVICE", "LATERAL"):
                return

    def triples_block(self) -> list[A.Triple]:
        """Triples of one subject."""
        triples: list[A.Triple] = []
        bracket = self.peek("[", "(")
        subject = self.term(triples)
        if not (bracket and (self.peek(".", "}") or self.kind() == "end")):
            self.property_list(subject, triples)
        return triples

    def path(self) -> object:
        left = self.path_sequence()
        while self.take("|"):
            left = A.Alt(left, self.path_sequence())
        return left

    def path_sequence(self) -> object:
        left = self.path_step()
        while self.take("/"):
            left = A.Seq(left, self.path_step())
        return left

    def path_step(self) -> object:
        back = self.take("^")
        if self.take("!"):
            p: object = self.negated()
        elif self.take("("):
            p = self.path()
            self.need(")")
        elif self.peek("A") and self.tokens[self.at][1] == "a":
            self.next()
            p = A.Link(RDF_TYPE)
        else:
            p = A.Link(self.iri())
        if mod := self.take("?", "*", "+"):
            p = A.Repeat(p, mod)
        return A.Inverse(p) if back else p

    def negated(self) -> A.Negated:
        forward, backward = [], []

        def one() -> None:
            side = backward if self.take("^") else forward
            if self.peek("A") and self.tokens[self.at][1] == "a":
                self.next()
                side.append(RDF_TYPE)
            else:
                side.append(self.iri())

        if self.take("("):
            if not self.peek(")"):
                one()
                while self.take("|"):
                    one()
            self.need(")")
        else:
            one()
        return A.Negated(tuple(forward), tuple(backward))

    # --- patterns

    def group(self) -> object:
        self.need("{")
        if self.peek("SELECT"):
            out: object = self.select(sub=True).pattern
            self.need("}")
            return out
        left: object = A.UNIT  # filters hold for the whole group, hence come last
        filters: list[object] = []
        triples: list[A.Triple] = []

        def flush() -> None:
            nonlocal left, triples
            if triples:
                left = self.joined(left, A.BGP(tuple(triples)))
                triples = []

        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                flush()
                right = self.group()
                left = A.LeftJoin(left, right.pattern, right.condition) if isinstance(right, A.Filter) else A.LeftJoin(left, right)
            elif self.take("MINUS"):
                flush()
                left = A.Minus(left, self.group())
            elif self.take("LATERAL"):
                flush()
                left = A.Lateral(left, self.group())
            elif self.take("GRAPH"):
                flush()
                name = "?" + self.next()[1:] if self.kind() == "var" else self.iri()
                left = self.joined(left, A.Graph(name, self.group()))
            elif self.take("SERVICE"):
                flush()
                silent = bool(self.take("SILENT"))
                name = "?" + self.next()[1:] if self.kind() == "var" else self.iri()
                left = self.joined(left, A.Service(name, self.group(), silent))
            elif self.take("BIND"):
                flush()
                self.need("(")
                e = self.expression()
                self.need("AS")
                var = self.variable()
                self.need(")")
                if var in A.pattern_vars(left):
                    raise SparqlError(f"BIND to {var}, which is in scope")
                left = A.Extend(left, var, e)
            elif self.take("VALUES"):
                flush()
                left = self.joined(left, self.data_block())
            elif self.peek("{"):
                flush()
                one = self.group()
                while self.take("UNION"):
                    one = A.Union(one, self.group())
                left = self.joined(left, one)
            else:
                triples += self.triples_block()
                if not self.peek("}"):
                    if not self.take(".") and not self.peek("FILTER", "OPTIONAL", "BIND", "GRAPH", "MINUS", "VALUES", "SERVICE", "LATERAL", "{"):
                        raise SparqlError(f". expected, not {self.tokens[self.at][1]!r}")
        flush()
        if filters:
            condition = filters[0]
            for f in filters[1:]:
                condition = A.Call("AND", (condition, f))
            left = A.Filter(condition, left)
        return left

    @staticmethod
    def joined(left: object, right: object) -> object:
        if left == A.UNIT:
            return right
        if isinstance(left, A.BGP) and isinstance(right, A.BGP):
            return A.BGP(left.triples + right.triples)
        return A.Join(left, right)

    def variable(self) -> str:
        if self.kind() != "var":
            raise SparqlError(f"variable expected, not {self.tokens[self.at][1]!r}")
        return "?" + self.next()[1:]

    def data_block(self) -> A.Values:
        if self.kind() == "var":
            names = [self.variable()]
            self.need("{")
            rows = []
            while not self.take("}"):
                rows.append((self.data_value(),))
            return A.Values(tuple(names), tuple(rows))
        self.need("(")
        names = []
        while not self.take(")"):
            names.append(self.variable())
        self.need("{")
        rows = []
        while not self.take("}"):
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(self.data_value())
            if len(row) != len(names):
                raise SparqlError("a VALUES row has another length than its variables")
            rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    def data_value(self) -> str | None:
        if self.take("UNDEF"):
            return None
        return self.literal() or self.iri()

    # --- expressions

    def constraint(self) -> object:
        return self.primary()

    def expression(self) -> object:
        left = self.conjunction()
        while self.take("||"):
            left = A.Call("OR", (left, self.conjunction()))
        return left

    def conjunction(self) -> object:
        left = self.relation()
        while self.take("&&"):
            left = A.Call("AND", (left, self.relation()))
        return left

    def relation(self) -> object:
        left = self.sum()
        if op := self.take("=", "!=", "<=", ">=", "<", ">"):
            return A.Call(op, (left, self.sum()))
        if self.peek("IN") or (self.peek("NOT") and self.tokens[self.at + 1][1].upper() == "IN"):
            negated = self.take("NOT")
            self.need("IN")
            inside = A.Call("IN", (left, *self.arguments()))
            return A.Call("NOT", (inside,)) if negated else inside
        return left

    def sum(self) -> object:
        left = self.product()
        while op := self.take("+", "-"):
            left = A.Call(op, (left, self.product()))
        return left

    def product(self) -> object:
        left = self.unary()
        while op := self.take("*", "/"):
            left = A.Call(op, (left, self.unary()))
        return left

    def unary(self) -> object:
        if self.take("!"):
            return A.Call("NOT", (self.unary(),))
        if self.take("-"):
            return A.Call("NEG", (self.unary(),))
        if self.take("+"):
            return self.unary()
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        return tuple(args)

    def primary(self) -> object:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind() == "var":
            return A.Var(self.variable())
        if self.take("NOT"):
            self.need("EXISTS")
            return A.Exists(self.group(), True)
        if self.take("EXISTS"):
            return A.Exists(self.group())
        if self.kind() == "word":
            name = self.tokens[self.at][1].upper()
            if name in _AGGREGATES:
                self.next()
                self.need("(")
                distinct = bool(self.take("DISTINCT"))
                arg = None if self.take("*") else self.expression()
                sep = " "
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    sep = unescape(self.next()[1:-1])
                self.need(")")
                if arg is None and name != "COUNT":
                    raise SparqlError(f"{name}(*)")
                return A.Aggregate(name, arg, distinct, sep)
            if name in _BUILTINS:
                self.next()
                return A.Call({"URI": "IRI", "ISURI": "ISIRI"}.get(name, name), self.arguments())
        value = self.literal()
        if value is not None:
            return A.Const(value)
        name = self.iri()
        return A.Call(name, self.arguments()) if self.peek("(") else A.Const(name)

    # --- queries

    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                name = self.next()
                if not name.endswith(":"):
                    raise SparqlError(f"prefix expected, not {name!r}")
                self.prefixes[name[:-1]] = self.iri()[1:-1]
            elif self.take("BASE"):
                self.base = self.iri()[1:-1]
            else:
                return

    def query(self) -> A.Query:
        self.prologue()
        if self.peek("SELECT"):
            out = self.select()
        elif self.take("ASK"):
            sets = self.dataset()
            self.take("WHERE")
            out = A.Query("ASK", self.sliced(self.group()), **sets)
        elif self.take("CONSTRUCT"):
            if self.peek("{"):
                template = self.template()
                sets = self.dataset()
                self.take("WHERE")
                pattern = self.group()
            else:
                sets = self.dataset()
                self.need("WHERE")
                start = self.at
                template = self.template()
                self.at = start
                pattern = self.group()
            out = A.Query("CONSTRUCT", self.sliced(pattern), template=tuple(template), **sets)
        elif self.take("DESCRIBE"):
            targets = []
            everything = self.take("*")
            while not everything and self.kind() in ("var", "iri", "pname"):
                targets.append(self.variable() if self.kind() == "var" else self.iri())
            sets = self.dataset()
            pattern = A.UNIT
            if self.take("WHERE") or self.peek("{"):
                pattern = self.group()
            if everything:
                targets = sorted(v for v in A.pattern_vars(pattern) if not v.startswith("?_:"))
            out = A.Query("DESCRIBE", self.sliced(pattern), targets=tuple(targets), **sets)
        else:
            raise SparqlError(f"query expected, not {self.tokens[self.at][1]!r}")
        if self.kind() != "end":
            raise SparqlError(f"unexpected {self.tokens[self.at][1]!r} after the query")
        return out

    def template(self) -> list[A.Triple]:
        self.need("{")
        out: list[A.Triple] = []
        while not self.take("}"):
            if not self.take("."):
                out += self.triples_block()
        if any(not isinstance(t.p, str) for t in out):
            raise SparqlError("a path in a template")
        return out

    def dataset(self) -> dict:
        default, named = [], []
        while self.take("FROM"):
            if self.take("NAMED"):
                named.append(self.iri())
            else:
                default.append(self.iri())
        if len(set(default)) > 1:
            raise SparqlError("more than one FROM graph")
        return {"from_default": tuple(dict.fromkeys(default)), "from_named": tuple(dict.fromkeys(named))}

    def select(self, sub: bool = False) -> A.Query:
        self.need("SELECT")
        mode = self.take("DISTINCT", "REDUCED")
        items: list[tuple[str, object | None]] = []
        if not self.take("*"):
            while self.kind() == "var" or self.peek("("):
                if self.take("("):
                    e = self.expression()
                    self.need("AS")
                    items.append((self.variable(), e))
                    self.need(")")
                else:
                    items.append((self.variable(), None))
            if not items:
                raise SparqlError("SELECT of nothing")
        sets = {} if sub else self.dataset()
        self.take("WHERE")
        pattern = self.group()
        pattern, finish = self.modifiers(pattern, items)
        if not items:
            names = sorted(v for v in A.pattern_vars(pattern) if not v.startswith(("?_:", "?.")))
        else:
            names = [v for v, _ in items]
            if len(set(names)) < len(names):
                raise SparqlError("a variable is selected twice")
        out: object = A.Project(pattern, tuple(names))
        if mode:
            out = (A.Distinct if mode.upper() == "DISTINCT" else A.Reduced)(out)
        out = finish(out)
        if self.take("VALUES"):
            block = self.data_block()
            out = A.Project(A.Join(out, block), tuple(dict.fromkeys([*names, *block.vars]))) if sub else A.Join(out, block)
        return A.Query("SELECT", out, vars=tuple(names), **sets)

    def modifiers(self, pattern: object, items: list[tuple[str, object | None]]):
        """Grouping, HAVING, select expressions, ORDER BY and the slice; the slice is left to the caller's finish."""
        keys: list[str] = []
        grouped = False
        if self.take("GROUP"):
            self.need("BY")
            grouped = True
            while self.kind() == "var" or self.peek("(") or self.kind() in ("iri", "pname") or (self.kind() == "word" and self.tokens[self.at][1].upper() in _BUILTINS):
                if self.kind() == "var":
                    keys.append(self.variable())
                elif self.take("("):
                    e = self.expression()
                    var = self.variable() if self.take("AS") else f"?.key{next(self.fresh)}"
                    self.need(")")
                    pattern = A.Extend(pattern, var, e)
                    keys.append(var)
                else:
                    var = f"?.key{next(self.fresh)}"
                    pattern = A.Extend(pattern, var, self.primary())
                    keys.append(var)
        having: list[object] = []
        if self.take("HAVING"):
            having.append(self.constraint())
            while self.peek("(") or (self.kind() == "word" and self.tokens[self.at][1].upper() in _BUILTINS | _AGGREGATES):
                having.append(self.constraint())
        order: list[tuple[object, bool]] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if way := self.take("ASC", "DESC"):
                    self.need("(")
                    order.append((self.expression(), way.upper() == "ASC"))
                    self.need(")")
                elif self.kind() == "var":
                    order.append((A.Var(self.variable()), True))
                elif self.peek("(") or (self.kind() == "word" and self.tokens[self.at][1].upper() in _BUILTINS | _AGGREGATES):
                    order.append((self.primary(), True))
                else:
                    break
        offset, limit = 0, None
        while word := self.take("LIMIT", "OFFSET"):
            n = int(self.next())
            limit, offset = (n, offset) if word.upper() == "LIMIT" else (limit, n)

        found: dict[A.Aggregate, str] = {}

        def lift(e: object) -> object:
            if isinstance(e, A.Aggregate):
                return A.Var(found.setdefault(e, f"?.agg{len(found)}_{next(self.fresh)}"))
            return A.Call(e.name, tuple(lift(a) for a in e.args)) if isinstance(e, A.Call) else e

        items_ = [(v, lift(e) if e is not None else None) for v, e in items]
        having = [lift(h) for h in having]
        order = [(lift(e), up) for e, up in order]
        if grouped or found:
            for v, e in items:
                if e is None and v not in keys:
                    raise SparqlError(f"{v} is neither grouped nor aggregated")
            pattern = A.Group(pattern, tuple(keys), tuple((v, a) for a, v in found.items()))
        for h in having:
            pattern = A.Filter(h, pattern)
        for v, e in items_:
            if e is not None:
                if v in A.pattern_vars(pattern):
                    raise SparqlError(f"{v} is in scope already")
                pattern = A.Extend(pattern, v, e)
        if order:
            pattern = A.OrderBy(pattern, tuple(order))
        return pattern, (lambda p: A.Slice(p, offset, limit)) if offset or limit is not None else (lambda p: p)

    def sliced(self, pattern: object) -> object:
        pattern, finish = self.modifiers(pattern, [])
        return finish(pattern)

    # --- updates

    def updates(self) -> list[A.Update]:
        out: list[A.Update] = []
        while True:
            self.prologue()
            if self.kind() == "end":
                return out
            out.append(self.update())
            if not self.take(";"):
                if self.kind() != "end":
                    raise SparqlError(f"unexpected {self.tokens[self.at][1]!r} after the update")
                return out

    def quads(self, graph: str | None) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("GRAPH"):
                name = self.variable() if self.kind() == "var" else self.iri()
                out += [(name, t.s, t.p, t.o) for t in self.template()]
            else:
                out += [(graph, t.s, t.p, t.o) for t in self.triples_block()]
        return out

    def update(self) -> A.Update:
        if self.take("CREATE", "CLEAR", "DROP"):
            kind = self.tokens[self.at - 1][1].upper()
            silent = bool(self.take("SILENT"))
            if word := self.take("DEFAULT", "NAMED", "ALL"):
                return A.Update(kind, target=word.upper(), silent=silent)
            self.need("GRAPH")
            return A.Update(kind, target=self.iri(), silent=silent)
        if self.take("LOAD"):
            raise SparqlError("LOAD is not supported")
        graph = self.iri() if self.take("WITH") else None
        if self.take("INSERT"):
            if self.take("DATA"):
                return A.Update("INSERT DATA", insert=tuple(self.quads(None)))
            return self.modify(graph, (), tuple(self.quads(graph)))
        self.need("DELETE")
        if self.take("DATA"):
            return A.Update("DELETE DATA", delete=tuple(self.quads(None)))
        if self.take("WHERE"):
            quads = tuple(self.quads(graph))
            return A.Update("MODIFY", delete=quads, pattern=self.of_quads(quads))
        delete = tuple(self.quads(graph))
        insert = tuple(self.quads(graph)) if self.take("INSERT") else ()
        return self.modify(graph, delete, insert)

    @staticmethod
    def of_quads(quads: tuple) -> object:
        pattern: object = A.UNIT
        for name in dict.fromkeys(q[0] for q in quads):
            bgp = A.BGP(tuple(A.Triple(*q[1:]) for q in quads if q[0] == name))
            pattern = Parser.joined(pattern, A.Graph(name, bgp) if name else bgp)
        return pattern

    def modify(self, graph: str | None, delete: tuple, insert: tuple) -> A.Update:
        using, named = [], []
        while self.take("USING"):
            if self.take("NAMED"):
                named.append(self.iri())
            else:
                using.append(self.iri())
        self.need("WHERE")
        pattern = self.group()
        if graph and not using and not named:
            using = [graph]
        return A.Update("MODIFY", insert=insert, delete=delete, pattern=pattern, using=tuple(using), using_named=tuple(named))


def parse_query(text: str) -> A.Query:
    return Parser(text).query()


def parse_update(text: str) -> list[A.Update]:
    return Parser(text).updates()
