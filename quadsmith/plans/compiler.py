"""Algebra to DataFrames.

A relation is a DataFrame with a string column of terms for each variable, and for some variables a native column
beside it (a number, a key of an IRI, a string, an instant) from which the term can be built. Joins, groups and
comparisons use native columns where both sides have them, so that terms are not even built when nobody asks for them.
A relation also knows which variables are bound in every row: joins on those are plain equi-joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import Ex, compile_expr
from ..session import written
from . import algebra as A
from .algebra import is_var
from .parser import SparqlError

FTS = "<urn:quadsmith:fts>"


def col_of(v: str) -> str:
    """The column of a variable."""
    return v[1:].replace("_:", "__b_").replace(".", "__")


@dataclass
class Rel:
    df: DataFrame
    sure: frozenset  # bound in every row
    maybe: frozenset = frozenset()
    native: dict = field(default_factory=dict)  # var -> (kind, rank or prefix); column {name}__n

    @property
    def vars(self) -> frozenset:
        return self.sure | self.maybe

    def ex(self, v: str) -> Ex | None:
        if v not in self.vars:
            return None
        name = col_of(v)
        if v in self.native:
            kind, extra = self.native[v]
            c = F.col(f"`{name}__n`")
            if kind == "num":
                return Ex("num", c, c.cast(T.DECIMAL) if extra < 2 else None, extra)
            return Ex(kind, c, prefix=extra if kind == "key" else "")
        return Ex("term", F.col(f"`{name}`"))

    def columns(self, vars_: list[str]) -> list[Column]:
        out = []
        for v in vars_:
            out.append(F.col(f"`{col_of(v)}`"))
            if v in self.native:
                out.append(F.col(f"`{col_of(v)}__n`"))
        return out

    def keep(self, vars_) -> "Rel":
        vs = [v for v in sorted(self.vars) if v in set(vars_)]
        return Rel(self.df.select(*self.columns(vs)), self.sure & frozenset(vs), self.maybe & frozenset(vs), {v: k for v, k in self.native.items() if v in vs})

    def plain(self, only: set | None = None) -> "Rel":
        """Without native columns (of some variables)."""
        gone = [v for v in self.native if only is None or v in only]
        return Rel(self.df.drop(*[f"{col_of(v)}__n" for v in gone]), self.sure, self.maybe, {v: k for v, k in self.native.items() if v not in gone})


def bind(ex: Ex, v: str) -> tuple[list[Column], dict]:
    """Columns of a variable bound to an expression, and its native entry."""
    name = col_of(v)
    if ex.kind in ("str", "key", "time") or (ex.kind == "num" and isinstance(ex.rank, int)):
        value = ex.exact if ex.kind == "num" and ex.rank < 2 and ex.exact is not None else ex.col
        if ex.kind == "num" and ex.rank == 0 and ex.col is not None and ex.exact is not None:
            value = ex.exact.cast("decimal(38,0)")
        return [ex.term().alias(name), value.alias(f"{name}__n")], {v: (ex.kind, ex.prefix if ex.kind == "key" else ex.rank)}
    return [ex.term().alias(name)], {}


class Compiler:
    """Compiles patterns over a source. `graphs` (g) lists the named graphs, empty ones too; `search` serves full text."""

    def __init__(self, spark: SparkSession, source, graphs: DataFrame | None = None, search=None, optimize: bool = True, single_graph: str | None = None, max_path_rounds: int = 64):
        self.spark, self.source, self.graphs, self.search = spark, source, graphs, search
        self.optimize, self.single, self.rounds = optimize, single_graph, max_path_rounds
        self.fresh = 0

    # --- scans

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("__unit")), frozenset())

    def pattern(self, t: A.Triple, graph: str | None) -> Rel:
        """One triple pattern. graph: None for the distinct union, an IRI, or a variable."""
        if not isinstance(t.p, str):
            return self.path_pattern(t, graph)
        star = self.star([t], graph) if self.optimize else None
        if star is not None:
            return star
        df = self.source.scan(None if is_var(t.p) else t.p)
        for c, x in (("s", t.s), ("o", t.o)):
            if not is_var(x):
                df = df.where(F.col(c) == x)
        slots = [("s", t.s), ("p", t.p), ("o", t.o)]
        df, slots = self.in_graph(df, slots, graph, self.source.unique)
        return self.named(df, slots)

    def in_graph(self, df: DataFrame, slots: list, graph: str | None, unique: bool) -> tuple[DataFrame, list]:
        if graph is None:
            if self.single is not None:
                return df.where(F.col("g") == self.single), slots
            if not unique:
                df = df.select(*[c for c, _ in slots]).distinct()
            return df, slots
        if is_var(graph):
            return df, [*slots, ("g", graph)]
        return df.where(F.col("g") == graph), slots

    @staticmethod
    def named(df: DataFrame, slots: list) -> Rel:
        """Slots to variables; a variable that stands twice is one value."""
        first: dict[str, str] = {}
        for c, x in slots:
            if is_var(x):
                if x in first:
                    df = df.where(F.col(c) == F.col(first[x]))
                else:
                    first[x] = c
        return Rel(df.select(*[F.col(c).alias(col_of(v)) for v, c in first.items()]) if first else df.select(F.lit(1).alias("__unit")), frozenset(first))

    def star(self, triples: list[A.Triple], graph: str | None) -> Rel | None:
        """Patterns with one subject variable over one table, in one scan."""
        if any(not isinstance(t.p, str) or is_var(t.p) for t in triples) or not is_var(triples[0].s):
            return None
        if self.single is not None or (graph and not is_var(graph)):
            graph_filter = self.single if graph is None else graph
        else:
            graph_filter = None
        names = [t.o for t in triples if is_var(t.o)] + [triples[0].s] + ([graph] if graph and is_var(graph) else [])
        if len(set(names)) < len(names):
            return None
        got = self.source.star([(t.p, t.o) for t in triples])
        if got is None:
            return None
        _, df, g, subject, objects = got
        cols, native = bind(subject, triples[0].s)
        for t, ex in zip(triples, objects):
            if is_var(t.o):
                more, kinds = bind(ex, t.o)
                cols += more
                native |= kinds
        if graph_filter is not None:
            df = df.where(g == graph_filter)
        if graph and is_var(graph):
            cols.append(g.alias(col_of(graph)))
        return Rel(df.select(*cols), frozenset(names), native=native)

    # --- joins

    def keys(self, a: Rel, b: Rel, shared: list[str]) -> tuple[Rel, Rel, dict[str, str]]:
        """Make native columns of shared variables agree or go; returns the join column of each variable."""
        join = {}
        for v in shared:
            if a.native.get(v) is not None and a.native.get(v) == b.native.get(v) and a.native[v][0] in ("key", "str"):
                join[v] = f"{col_of(v)}__n"
            else:
                join[v] = col_of(v)
        return a, b, join

    def join(self, a: Rel, b: Rel, how: str = "inner", condition=None, hint: str | None = None) -> Rel:
        """Compatible mappings. how: inner, left, left_semi or left_anti; condition: an expression over both sides."""
        shared = sorted(a.vars & b.vars)
        if any(v in a.maybe or v in b.maybe for v in shared):
            return self.loose_join(a, b, how, condition)
        if how in ("left_semi", "left_anti") and not shared and condition is None:
            b = Rel(b.df.limit(1).select(F.lit(1).alias("__unit")), frozenset())  # one row tells
        _, _, on = self.keys(a, b, shared)
        ren = lambda c: f"__r_{c}"
        right = b.df.select(*[F.col(f"`{c}`").alias(ren(c)) for c in b.df.columns if c != "__unit"]) if b.vars else b.df.select(F.lit(1).alias("__r_unit"))
        left = a.df
        if hint:
            right = right.hint(hint)
        tests = []
        for v in shared:
            tests.append(F.col(f"`{on[v]}`") == F.col(f"`{ren(on[v])}`"))
        if condition is not None:
            both = replace(b, df=right)

            def lookup(v: str) -> Ex | None:
                return self._renamed(both, v, ren) if v in b.vars and v not in a.vars else a.ex(v)

            tests.append(compile_expr(condition, lookup).ebv())
        on_all = reduce(lambda x, y: x & y, tests) if tests else None
        if on_all is None:
            joined = left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
        else:
            joined = left.join(right, on_all, how)
        if how in ("left_semi", "left_anti"):
            return Rel(joined, a.sure, a.maybe, a.native)
        cols, native = [], {}
        for v in sorted(a.vars | b.vars):
            name = col_of(v)
            if v in a.vars:
                cols += a.columns([v])
                if v in a.native:
                    native[v] = a.native[v]
            else:
                cols.append(F.col(f"`{ren(name)}`").alias(name))
                if v in b.native:
                    cols.append(F.col(f"`{ren(name)}__n`").alias(f"{name}__n"))
                    native[v] = b.native[v]
        sure = a.sure | (b.sure if how == "inner" else frozenset())
        return Rel(joined.select(*cols) if cols else joined.select(F.lit(1).alias("__unit")), sure, (a.vars | b.vars) - sure, native)

    @staticmethod
    def by_bound(rel: Rel, loose: list[str]) -> list[Rel]:
        """The rows of a relation by which of some variables they bind; in each part these are sure, or not there."""
        out = []
        for bound in product((True, False), repeat=len(loose)):
            gone = {v for v, b in zip(loose, bound) if not b}
            df = rel.df
            for v, b in zip(loose, bound):
                c = F.col(f"`{col_of(v)}__n`" if rel.native.get(v, ("", 0))[0] in ("key", "str") else f"`{col_of(v)}`")
                df = df.where(c.isNotNull() if b else c.isNull())
            part = Rel(df, rel.sure | (set(loose) - gone), rel.maybe - set(loose), rel.native)
            if gone:
                rest = part.vars - gone
                part = part.keep(rest) if rest else Rel(df.select(F.lit(1).alias("__unit")), frozenset())
            out.append(part)
        return out

    @staticmethod
    def shaped(rel: Rel, like: dict, native: dict, sure: frozenset) -> Rel:
        """With the columns of `like` (types by name), null where there are none, and these native entries."""
        have = set(rel.df.columns)
        df = rel.df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(t).alias(c) for c, t in like.items()])
        names = frozenset(v for v in rel.vars if col_of(v) in like)
        return Rel(df, sure & names, names - sure, native)

    def loose_join(self, a: Rel, b: Rel, how: str, condition) -> Rel:
        """A join over shared variables that may be unbound: rows that bind the same of them meet by equality.

        Each side falls into parts by what it binds. Only pairs of parts that have no variable in common are a product.
        """
        shared = a.vars & b.vars
        semi = how in ("left_semi", "left_anti")
        native = dict(a.native) if semi else {v: k for v, k in (b.native | a.native).items() if not (v in shared and v in a.maybe) or a.native.get(v) == b.native.get(v)}
        names = a.vars if semi else a.vars | b.vars
        sure = a.sure | (b.sure if how == "inner" else frozenset())
        types = {f.name: f.dataType for r in (b, a) for f in r.df.schema.fields}
        like = {c: types[c] for v in sorted(names) for c in ([col_of(v), f"{col_of(v)}__n"] if v in native else [col_of(v)])}
        rights, done = self.by_bound(b, sorted(shared & b.maybe)), []
        for left in self.by_bound(a, sorted(shared & a.maybe)):
            if how == "left" and len(rights) == 1 and (condition is not None or left.vars & rights[0].vars):
                done.append(self.join(left, rights[0], "left", condition))
                continue
            if not semi:
                done += [self.join(left, r, "inner", condition) if condition is not None or left.vars & r.vars else self.product(left, r) for r in rights]
            if how == "inner":
                continue
            rest = left
            for r in rights:
                if how == "left_semi":
                    done.append(self.join(rest, r, "left_semi", condition))
                rest = self.join(rest, r, "left_anti", condition)
            if how != "left_semi":
                done.append(rest)
        parts = [self.shaped(r, like, native, sure) for r in done]
        return Rel(reduce(DataFrame.unionByName, [p.df for p in parts]), frozenset(v for v in names if v in sure), frozenset(v for v in names if v not in sure), native)

    def product(self, a: Rel, b: Rel) -> Rel:
        """Every row with every row. Both sides are spread evenly first, so that their sizes are known when the join is chosen."""
        return self.join(replace(a, df=a.df.hint("rebalance")), replace(b, df=b.df.hint("rebalance")))

    @staticmethod
    def _renamed(b: Rel, v: str, ren) -> Ex:
        name = col_of(v)
        if v in b.native:
            kind, extra = b.native[v]
            c = F.col(f"`{ren(name)}__n`")
            return Ex("num", c, c.cast(T.DECIMAL) if extra < 2 else None, extra) if kind == "num" else Ex(kind, c, prefix=extra if kind == "key" else "")
        return Ex("term", F.col(f"`{ren(name)}`"))

    def units(self, bgp: A.BGP, graph: str | None) -> list[tuple[int, tuple[A.Triple, ...]]]:
        """The patterns of a BGP, those of one subject over one table together, with a guess of their rows."""
        left, out = list(bgp.triples), []
        while left:
            t = left.pop(0)
            group = [t]
            if self.optimize and isinstance(t.p, str) and not is_var(t.p) and is_var(t.s):
                for other in list(left):
                    if other.s == t.s and self.star([*group, other], graph) is not None:
                        group.append(other)
                        left.remove(other)
            out.append((min(self.guess(x) for x in group), tuple(group)))
        return out

    def guess(self, t: A.Triple) -> int:
        if not isinstance(t.p, str):
            return 1 << 40
        n = self.source.size(None if is_var(t.p) else t.p)
        if not is_var(t.s):
            n = min(n, 10)
        if not is_var(t.o):
            n = n // (2 if t.p == T.RDF_TYPE else 100) + 1 if n else 0
        return n

    def ordered(self, bgp: A.BGP, graph: str | None) -> list[tuple[A.Triple, ...]]:
        """Greedy: the smallest first, then, of those that share a variable, what gives the fewest rows by the guess."""
        units = self.units(bgp, graph)
        if not self.optimize:
            return [u for _, u in units]
        values = {u: self.values_of(u, n) for n, u in units}
        out, bound, rows = [], {}, 1

        def joined(unit: tuple[int, tuple[A.Triple, ...]]) -> int:
            n, u = unit
            made = rows * n
            for v in values[u].keys() & bound.keys():
                made = -(-made // max(values[u][v], bound[v], 1))
            return made

        while units:
            touching = [u for u in units if not bound or bound.keys() & values[u[1]].keys()] or units
            best = min(touching, key=lambda u: (joined(u), u[0]))
            rows = max(joined(best), 1)
            units.remove(best)
            out.append(best[1])
            for v, n in values[best[1]].items():
                bound[v] = min(n, bound.get(v, n))
            bound = {v: min(n, rows) for v, n in bound.items()}
        return out

    def values_of(self, unit: tuple[A.Triple, ...], rows: int) -> dict[str, int]:
        """A guess of how many values each variable of a unit has."""
        out: dict[str, int] = {}
        for t in unit:
            some = {v: math.isqrt(rows) + 1 for v in A.pattern_vars(A.BGP((t,)))}
            if is_var(t.s):
                some[t.s] = rows
            if isinstance(t.p, str) and not is_var(t.p) and is_var(t.o) and t.o != t.s:
                some[t.o] = self.source.targets(t.p) or some[t.o]
            for v, n in some.items():
                out[v] = min(n, rows, out.get(v, n))
        return out

    def one_unit(self, unit: tuple[A.Triple, ...], graph: str | None) -> Rel:
        if len(unit) == 1:
            return self.pattern(unit[0], graph)
        return self.star(list(unit), graph)

    def bgp(self, bgp: A.BGP, graph: str | None) -> Rel:
        if not bgp.triples:
            return self.unit()
        return reduce(self.join, [self.one_unit(u, graph) for u in self.ordered(bgp, graph)])

    # --- paths

    def edges(self, path: object, graph: str | None) -> DataFrame:
        """Pairs (s, o) of a path, with g where the graph is a variable. Sequences and alternatives are bags."""
        keep = ["s", "o"] + (["g"] if graph and is_var(graph) else [])
        if isinstance(path, (A.Link, A.Negated)):
            forward, backward = ([path.iri], []) if isinstance(path, A.Link) else (path.forward, path.backward)

            def part(names, swap: bool) -> DataFrame:
                if isinstance(path, A.Link):
                    df = self.source.scan(path.iri)
                else:
                    df = self.source.scan(None).where(~F.col("p").isin(list(names))) if names else self.source.scan(None)
                df, _ = self.in_graph(df, [("s", ""), ("p", ""), ("o", "")], graph, self.source.unique)
                return df.select(*[F.col(c).alias({"s": "o", "o": "s"}[c]) if swap and c != "g" else F.col(c) for c in keep]).select(*keep)

            if isinstance(path, A.Link) or not backward:
                return part(forward, False)
            return part(backward, True) if not forward else part(forward, False).unionByName(part(backward, True))
        if isinstance(path, A.Inverse):
            df = self.edges(path.path, graph)
            return df.select(F.col("o").alias("s"), F.col("s").alias("o"), *keep[2:])
        if isinstance(path, A.Alt):
            return self.edges(path.left, graph).unionByName(self.edges(path.right, graph))
        if isinstance(path, A.Seq):
            left = self.edges(path.left, graph).withColumnRenamed("o", "m")
            right = self.edges(path.right, graph).withColumnRenamed("s", "m")
            return left.join(right, ["m", *keep[2:]]).select(*keep)
        if path.kind == "?":
            return self.edges(path.path, graph).distinct()
        return closure(self.edges(path.path, graph), keep, self.rounds)

    def nodes(self, graph: str | None) -> DataFrame:
        df, slots = self.in_graph(self.source.scan(None), [("s", ""), ("p", ""), ("o", "")], graph, True)
        g = ["g"] if graph and is_var(graph) else []
        return df.select(F.col("s").alias("n"), *g).unionByName(df.select(F.col("o").alias("n"), *g)).distinct()

    def path_pattern(self, t: A.Triple, graph: str | None) -> Rel:
        path, s, o = t.p, t.s, t.o
        if isinstance(path, A.Inverse):
            return self.pattern(A.Triple(o, path.path.iri if isinstance(path.path, A.Link) else path.path, s), graph)
        if isinstance(path, A.Alt):
            parts = [self.pattern(A.Triple(s, p.iri if isinstance(p, A.Link) else p, o), graph) for p in (path.left, path.right)]
            return self.union(*parts)
        if isinstance(path, A.Seq):
            self.fresh += 1
            mid = f"?_:path{self.fresh}"
            plain = lambda p: p.iri if isinstance(p, A.Link) else p
            both = self.bgp(A.BGP((A.Triple(s, plain(path.left), mid), A.Triple(mid, plain(path.right), o))), graph)
            return both.keep(both.vars - {mid}) if both.vars - {mid} else Rel(both.df.select(F.lit(1).alias("__unit")), frozenset())
        g = ["g"] if graph and is_var(graph) else []
        if isinstance(path, A.Repeat) and path.kind in "*+" and not (is_var(s) and is_var(o)):
            back = is_var(s)  # walk from the constant end
            step = self.edges(path.path, graph)
            if back:
                step = step.select(F.col("o").alias("s"), F.col("s").alias("o"), *g)
            df = reach(step, o if back else s, ["s", "o", *g], self.rounds)
            df = df.select(F.col("o").alias("s"), F.col("s").alias("o"), *g) if back else df
        else:
            df = self.edges(path, graph)
        if isinstance(path, A.Repeat) and path.kind in "?*":
            ends = [x for x in (s, o) if not is_var(x)]
            if ends:
                same = self.spark.createDataFrame([(x, x) for x in set(ends)], "s string, o string")
                if g:
                    same = same.crossJoin(self.graphs.select("g"))  # one row for each graph: the end need not be in it
            else:
                same = self.nodes(graph).select(F.col("n").alias("s"), F.col("n").alias("o"), *g)
            df = df.select("s", "o", *g).unionByName(same).distinct()
        for c, x in (("s", s), ("o", o)):
            if not is_var(x):
                df = df.where(F.col(c) == x)
        return self.named(df, [("s", s), ("o", o)] + ([("g", graph)] if g else []))

    # --- patterns

    def union(self, a: Rel, b: Rel) -> Rel:
        same = {v: k for v, k in a.native.items() if b.native.get(v) == k and v in a.vars & b.vars}
        a, b = a.plain(set(a.native) - set(same)), b.plain(set(b.native) - set(same))
        df = a.df.drop("__unit").unionByName(b.df.drop("__unit"), allowMissingColumns=True) if a.vars or b.vars else a.df.unionByName(b.df)
        if not a.vars and b.vars or a.vars and not b.vars:
            pad = lambda r: r.df if r.vars else r.df.select("__unit")
            df = pad(a).unionByName(pad(b), allowMissingColumns=True)
        sure = a.sure & b.sure
        return Rel(df, sure, (a.vars | b.vars) - sure, same)

    def compile(self, node: object, graph: str | None = None) -> Rel:
        if isinstance(node, A.BGP):
            return self.bgp(node, graph)
        if isinstance(node, A.Values):
            return self.values(node)
        if isinstance(node, A.Join):
            return self.joined(node, graph)
        if isinstance(node, A.Lateral):
            return self.join(self.compile(node.left, graph), self.compile(node.right, graph))
        if isinstance(node, A.LeftJoin):
            return self.optional(node, graph)
        if isinstance(node, A.Union):
            return self.union(self.compile(node.left, graph), self.compile(node.right, graph))
        if isinstance(node, A.Minus):
            return self.minus(self.compile(node.left, graph), self.compile(node.right, graph), graph)
        if isinstance(node, A.Filter):
            return self.filter(node, graph)
        if isinstance(node, A.Extend):
            return self.extend(self.compile(node.pattern, graph), node.var, node.expr, graph)
        if isinstance(node, A.Graph):
            inner = self.compile(node.pattern, node.name)
            if is_var(node.name) and node.name not in inner.sure:
                names = Rel(self.graphs.select(F.col("g").alias(col_of(node.name))), frozenset({node.name}))
                inner = self.join(inner, names) if inner.vars else names
            elif not is_var(node.name) and not inner.vars and node.pattern == A.UNIT:
                here = self.graphs.where(F.col("g") == node.name).limit(1)
                return Rel(here.select(F.lit(1).alias("__unit")), frozenset())
            return inner
        if isinstance(node, A.Service):
            return self.service(node, graph)
        if isinstance(node, A.Group):
            return self.group(node, graph)
        if isinstance(node, A.OrderBy):
            rel = self.compile(node.pattern, graph)
            keys = []
            for e, up in node.keys:
                x, rel = self.expression(e, rel, graph)
                for k in self.sort_columns(x):
                    keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
            return replace(rel, df=rel.df.orderBy(*keys))
        if isinstance(node, A.Project):
            rel = self.compile(node.pattern, graph)
            out = rel.keep(node.vars) if rel.vars & set(node.vars) else replace(rel, sure=frozenset(), maybe=frozenset(), native={}, df=rel.df.select(F.lit(1).alias("__unit")))
            if graph and is_var(graph) and graph in rel.vars and graph not in node.vars:
                out = rel.keep({*node.vars, graph})
            missing = [v for v in node.vars if v not in out.vars]
            if missing:
                out = replace(out, df=out.df.select("*", *[F.lit(None).cast("string").alias(col_of(v)) for v in missing]), maybe=out.maybe | frozenset(missing))
            return out
        if isinstance(node, (A.Distinct, A.Reduced)):
            if isinstance(node, A.Reduced):
                return self.compile(node.pattern, graph)
            inner = node.pattern
            rel = self.distinct(inner, graph)
            return rel
        if isinstance(node, A.Slice):
            rel = self.compile(node.pattern, graph)
            df = rel.df.offset(node.offset) if node.offset else rel.df
            return replace(rel, df=df.limit(node.limit) if node.limit is not None else df)
        raise SparqlError(f"{type(node).__name__} is not supported")

    def distinct(self, node: object, graph: str | None) -> Rel:
        """Under DISTINCT, the parts of a BGP that give no output column only have to exist."""
        if self.optimize and isinstance(node, A.Project):
            found = self.tested(node.pattern)
            if found is not None and (found[1] is None or graph in (None, found[1])):
                bgp, name, tests = found
                name = name or graph
                rel = self.witnessed(self.ordered(bgp, name), name, set(node.vars) | ({name} if name and is_var(name) else set()), tests)
                rel = rel.keep(node.vars)
                if set(node.vars) <= rel.vars:
                    return self.deduped(rel)
        return self.deduped(self.compile(node, graph))

    @staticmethod
    def tested(node: object) -> tuple[A.BGP, str | None, list] | None:
        """A BGP without paths, its graph and the filters on it, if that is all a pattern has."""
        name, tests = None, []
        while isinstance(node, A.Filter) or (isinstance(node, A.Graph) and name is None):
            if isinstance(node, A.Filter):
                tests += conjuncts(node.condition)
            else:
                name = node.name
            node = node.pattern
        if not isinstance(node, A.BGP) or not node.triples or not all(isinstance(t.p, str) for t in node.triples):
            return None
        inside = A.pattern_vars(node) | ({name} if name and is_var(name) else set())
        return None if any(has_exists(t) or not A.expr_vars(t) or not A.expr_vars(t) <= inside for t in tests) else (node, name, tests)

    def asked(self, node: object) -> Rel:
        """A relation that has a row if the pattern has one: of a BGP, its smallest part that the others have to witness."""
        while isinstance(node, (A.Project, A.Distinct, A.Reduced, A.OrderBy)):
            node = node.pattern
        found = self.tested(node) if self.optimize else None
        if found is None:
            return self.compile(node)
        bgp, name, tests = found
        return self.witnessed(self.ordered(bgp, name), name, set(), tests)

    @staticmethod
    def deduped(rel: Rel) -> Rel:
        """Distinct rows; on native columns, from which the terms are built again."""
        by = [f"{col_of(v)}__n" if v in rel.native else col_of(v) for v in sorted(rel.vars)]
        if not by:
            return replace(rel, df=rel.df.distinct())
        df = rel.df.select(*[F.col(f"`{c}`") for c in by]).distinct()
        bare = Rel(df, rel.sure, rel.maybe, rel.native)
        return replace(rel, df=df.select(*[(bare.ex(v).term().alias(col_of(v))) for v in sorted(rel.vars)], *[F.col(f"`{col_of(v)}__n`") for v in sorted(rel.native)]))

    def witnessed(self, units: list[tuple[A.Triple, ...]], graph: str | None, wanted: set[str], tests: list = ()) -> Rel:
        """Join the units of a BGP for distinct values of some variables; parts that are only tests become semi-joins."""
        own = {graph} if graph and is_var(graph) else set()
        vars_of = [A.pattern_vars(A.BGP(u)) | own for u in units]
        core = {i for i, v in enumerate(vars_of) if v & (wanted - own)} or {0}
        for t in tests:  # a filter over several units needs their rows
            if not any(A.expr_vars(t) <= v for v in vars_of):
                core |= {i for i, v in enumerate(vars_of) if A.expr_vars(t) & (v - own)}
        changed = True
        while changed:  # what links core parts belongs to the core
            changed = False
            for i, v in enumerate(vars_of):
                if i not in core and sum(bool(v & vars_of[j] - wanted) for j in core) > 1:
                    core.add(i)
                    changed = True
        rel, used = None, set()
        for i in sorted(core):
            r = self.one_unit(units[i], graph)
            for k, t in enumerate(tests):
                if k not in used and A.expr_vars(t) <= vars_of[i]:
                    r = self.where(r, t, graph)
                    used.add(k)
            rel = r if rel is None else self.join(rel, r)
            for k, t in enumerate(tests):
                if k not in used and A.expr_vars(t) <= rel.vars:
                    rel = self.where(rel, t, graph)
                    used.add(k)
        rest = [i for i in range(len(units)) if i not in core]
        left = [t for k, t in enumerate(tests) if k not in used]
        while rest:  # what hangs together apart from the core is one test
            part, names = [rest.pop(0)], None
            grow = True
            while grow:
                grow = False
                names = set().union(*(vars_of[i] for i in part))
                for i in list(rest):
                    if (vars_of[i] & names) - rel.vars:
                        part.append(i)
                        rest.remove(i)
                        grow = True
            test = self.witnessed([units[i] for i in sorted(part)], graph, names & rel.vars, [t for t in left if A.expr_vars(t) <= names])
            rel = self.join(rel, self.deduped(test.keep(rel.vars)) if test.vars & rel.vars else test, "left_semi")
        return rel

    def joined(self, node: A.Join, graph: str | None) -> Rel:
        """A join; with full-text search, the rest of the join restricts a complete search's postings."""
        return self.join(self.compile(node.left, graph), self.compile(node.right, graph))

    def values(self, node: A.Values) -> Rel:
        if not node.vars:
            return self.unit() if len(node.rows) == 1 else Rel(self.spark.range(len(node.rows)).select(F.lit(1).alias("__unit")), frozenset())
        df = self.spark.createDataFrame([tuple(r) for r in node.rows], ", ".join(f"`{col_of(v)}` string" for v in node.vars))
        sure = frozenset(v for i, v in enumerate(node.vars) if all(r[i] is not None for r in node.rows))
        return Rel(df, sure, frozenset(node.vars) - sure)

    def optional(self, node: A.LeftJoin, graph: str | None) -> Rel:
        left = self.compile(node.left, graph)
        if node.condition is not None and has_exists(node.condition):
            raise SparqlError("EXISTS in the filter of an OPTIONAL is not supported")
        nested = self.in_turn(left, node, graph) if self.optimize else None
        return nested if nested is not None else self.join(left, self.compile(node.right, graph), "left", node.condition)

    def in_turn(self, left: Rel, node: A.LeftJoin, graph: str | None) -> Rel | None:
        """OPTIONAL { B OPTIONAL { C } } as B, then C where B was found: what B and C make for other rows is never made.

        This needs a variable that only B binds, and that C has no variable of the left but those that B binds.
        """
        inner = node.right
        if not isinstance(inner, A.LeftJoin) or (inner.condition is not None and has_exists(inner.condition)):
            return None
        b, c = self.compile(inner.left, graph), self.compile(inner.right, graph)
        marks = sorted(b.sure - left.vars)
        read = A.expr_vars(node.condition) if node.condition is not None else set()
        inside = A.expr_vars(inner.condition) if inner.condition is not None else set()
        if not marks or not c.vars & (left.vars | b.maybe) <= b.sure or not c.vars & b.vars or read & (c.vars - left.vars - b.vars) or inside & (left.vars - b.sure) or inside & b.maybe:
            return None
        if left.maybe & b.vars:
            return None
        first = self.join(left, b, "left", node.condition)
        found = Rel(first.df, first.sure | b.sure, first.maybe - b.sure, first.native)
        test = A.Call("BOUND", (A.Var(marks[0]),))
        both = self.join(found, c, "left", test if inner.condition is None else A.Call("AND", (test, inner.condition)))
        return replace(both, sure=first.sure, maybe=both.vars - first.sure)

    def minus(self, left: Rel, right: Rel, graph: str | None) -> Rel:
        """Rows with a compatible row on the right that binds a common variable go."""
        shared = sorted((left.vars & right.vars) - ({graph} if graph else set()))
        if not shared:
            return left
        if graph and graph in left.vars & right.vars:
            shared.append(graph)
        right = right.keep(shared)
        if all(v in left.sure and v in right.sure for v in shared):
            return self.join(left, right, "left_anti")
        if len(shared) == 1:  # what is unbound equals nothing
            certain = [replace(r, sure=r.vars, maybe=frozenset()) for r in (left, right)]
            return replace(left, df=self.join(*certain, "left_anti").df)
        parts = []
        like = {f.name: f.dataType for f in left.df.schema.fields}
        rights = self.by_bound(right, [v for v in shared if v in right.maybe])
        for part in self.by_bound(left, [v for v in shared if v in left.maybe]):
            for r in rights:
                if (part.vars & r.vars) - {graph}:
                    part = self.join(part, self.deduped(r.keep(part.vars)), "left_anti")
            parts.append(self.shaped(part, like, left.native, left.sure).df)
        return replace(left, df=reduce(DataFrame.unionByName, parts))

    def filter(self, node: A.Filter, graph: str | None) -> Rel:
        parts = conjuncts(node.condition)
        rel = self.compile(node.pattern, graph)
        for p in parts:
            if isinstance(p, A.Call) and p.name == "NOT" and isinstance(p.args[0], A.Exists):
                p = A.Exists(p.args[0].pattern, not p.args[0].negated)
            if isinstance(p, A.Exists):
                rel = self.exists(rel, p, graph)
                continue
            rel = self.where(rel, p, graph)
        return rel

    def where(self, rel: Rel, test: object, graph: str | None) -> Rel:
        x, wide = self.expression(test, rel, graph)
        df = wide.df.where(x.ebv())
        return replace(rel, df=df.select(*[F.col(f"`{c}`") for c in rel.df.columns]))

    def exists(self, rel: Rel, e: A.Exists, graph: str | None) -> Rel:
        inner, condition = e.pattern, None
        if isinstance(inner, A.Filter) and not has_exists(inner.condition) and A.expr_vars(inner.condition) - A.pattern_vars(inner.pattern):
            inner, condition = inner.pattern, inner.condition  # it reads variables from outside
        right = self.compile(inner, graph)
        needed = rel.vars | (A.expr_vars(condition) if condition is not None else set())
        right = right.keep(right.vars & needed) if right.vars & needed else Rel(right.df.limit(1).select(F.lit(1).alias("__unit")), frozenset())
        return self.join(rel, right, "left_anti" if e.negated else "left_semi", condition)

    def expression(self, e: object, rel: Rel, graph: str | None) -> tuple[Ex, Rel]:
        """An expression over a relation; EXISTS inside it become columns of the wider relation that comes back."""
        flags: dict[str, str] = {}

        def lift(x: object) -> object:
            nonlocal rel
            if isinstance(x, A.Exists):
                self.fresh += 1
                name = f"__exists{self.fresh}"
                right = self.compile(x.pattern, graph)
                shared = right.vars & rel.vars
                if not shared <= rel.sure & right.sure:
                    raise SparqlError("EXISTS inside an expression, over variables that may be unbound, is not supported")
                right = right.keep(shared).plain() if shared else Rel(right.df.limit(1).select(F.lit(1).alias("__unit")), frozenset())
                marks = right.df.distinct().withColumn(name, F.lit(True))
                if shared:
                    marks = marks.select(*[F.col(f"`{col_of(v)}`").alias(f"{name}_{i}") for i, v in enumerate(sorted(shared))], name)
                    test = reduce(lambda a, b: a & b, [F.col(f"`{col_of(v)}`") == F.col(f"{name}_{i}") for i, v in enumerate(sorted(shared))])
                    df = rel.df.join(marks, test, "left").drop(*[f"{name}_{i}" for i in range(len(shared))])
                else:
                    df = rel.df.join(marks.select(name), F.lit(True), "left")
                rel = replace(rel, df=df)
                flags[f"?{name}"] = name
                return A.Call("NOT", (A.Var(f"?{name}"),)) if x.negated else A.Var(f"?{name}")
            return A.Call(x.name, tuple(lift(a) for a in x.args)) if isinstance(x, A.Call) else x

        e = lift(e)

        def lookup(v: str) -> Ex | None:
            return Ex("bool", F.coalesce(F.col(flags[v]), F.lit(False))) if v in flags else rel.ex(v)

        return compile_expr(e, lookup), rel

    def extend(self, rel: Rel, var: str, e: object, graph: str | None) -> Rel:
        x, wide = self.expression(e, rel, graph)
        cols, native = bind(x, var)
        sure = rel.sure
        if isinstance(e, A.Const) or (isinstance(e, A.Var) and e.name in rel.sure):
            sure = sure | {var}
        return Rel(wide.df.select(*[F.col(f"`{c}`") for c in rel.df.columns], *cols), sure, (rel.vars | {var}) - sure, rel.native | native)

    @staticmethod
    def sort_columns(x: Ex) -> list[Column]:
        if x.kind in ("num", "str", "time") and not (x.kind == "num" and not isinstance(x.rank, int)):
            return [x.col]
        if x.kind == "bool":
            return [x.col]
        return [T.sort_key(x.term())]

    # --- groups

    def group(self, node: A.Group, graph: str | None) -> Rel:
        if self.optimize and node.aggregates and all(a == A.Aggregate("COUNT", None) for _, a in node.aggregates):
            counted = self.count_join(node, graph)
            if counted is not None:
                return counted
        rel = self.compile(node.pattern, graph)
        g = [graph] if graph and is_var(graph) and graph in rel.vars and graph not in node.keys else []
        keys = [*node.keys, *g]
        by = [F.col(f"`{col_of(k)}__n`") if k in rel.native else F.col(f"`{col_of(k)}`") if k in rel.vars else F.lit(None).cast("string").alias(col_of(k)) for k in keys]
        aggs, after = [], []
        for v, a in node.aggregates:
            cols, finish = self.aggregate(a, rel, col_of(v), graph)
            aggs += cols
            after.append((v, finish))
        df = rel.df.groupBy(*by).agg(*aggs) if aggs else rel.df.select(*by).distinct()
        bare = Rel(df, frozenset(k for k in keys if k in rel.sure), frozenset(keys) - rel.sure, {k: rel.native[k] for k in keys if k in rel.native})
        out, native = [], {}
        for k in keys:
            if k in rel.native:
                out.append(bare.ex(k).term().alias(col_of(k)))
                out.append(F.col(f"`{col_of(k)}__n`"))
                native[k] = rel.native[k]
            else:
                out.append(F.col(f"`{col_of(k)}`"))
        sure = set(bare.sure)
        for v, finish in after:
            cols, kinds = bind(finish, v)
            out += cols
            native |= kinds
        counts = {v for v, a in node.aggregates if a.name == "COUNT"}
        return Rel(df.select(*out), frozenset(sure | counts), (frozenset(keys) | {v for v, _ in node.aggregates}) - sure - counts, native)

    def aggregate(self, a: A.Aggregate, rel: Rel, name: str, graph: str | None) -> tuple[list[Column], Ex]:
        """Columns to aggregate and the expression over them that is the result."""
        c = lambda x: F.col(f"`{x}`")
        if a.name == "COUNT":
            if a.arg is None:
                if a.distinct:
                    vs = [rel.ex(v) for v in sorted(rel.vars)]
                    col = F.count_distinct(F.struct(*[x.term() for x in vs])) if vs else F.least(F.count(F.lit(1)), F.lit(1))
                else:
                    col = F.count(F.lit(1))
            else:
                x = compile_expr(a.arg, rel.ex)
                value = x.term() if x.kind == "bool" or (x.kind == "num" and not isinstance(x.rank, int)) else x.col
                col = F.count_distinct(value) if a.distinct else F.count(value)
            return [col.alias(name)], Ex("num", c(name), c(name).cast(T.DECIMAL), 0)
        x = compile_expr(a.arg, rel.ex)
        if a.name in ("SUM", "AVG"):
            n = x.number()
            known = isinstance(n.rank, int)
            exact_only = known and n.rank < 2
            value = n.exact if exact_only and n.exact is not None else n.col
            total = (F.sum_distinct if a.distinct else F.sum)(value)
            good, every = F.count(n.col), F.count(F.lit(1))
            if known:
                if a.name == "AVG":
                    avg = F.try_avg(value) if not a.distinct else total / F.count_distinct(value)
                    r = max(n.rank, 1)
                    cols = [F.when(good == every, avg.cast(T.DECIMAL) if exact_only else avg).alias(name), every.alias(f"{name}_n")]
                    zero = F.when(c(f"{name}_n") == 0, F.lit(0)).otherwise(c(name))
                    return cols, Ex("num", zero.cast("double"), zero.cast(T.DECIMAL) if r < 2 else None, r)
                cols = [F.when(good == every, F.coalesce(total, F.lit(0).cast("double") if not exact_only else F.lit(0).cast(T.DECIMAL))).alias(name)]
                return cols, Ex("num", c(name).cast("double"), c(name).cast(T.DECIMAL) if exact_only else None, n.rank)
            exact_total = (F.sum_distinct if a.distinct else F.sum)(n.exact)
            count = F.count_distinct(x.term()) if a.distinct else every
            cols = [F.when(good == every, F.coalesce(total, F.lit(0.0))).alias(name), F.when(good == every, F.coalesce(exact_total, F.lit(0).cast(T.DECIMAL))).alias(f"{name}_e"), F.coalesce(F.max(n.rank), F.lit(0)).alias(f"{name}_r"), count.alias(f"{name}_n")]
            value, exact, r = c(name), c(f"{name}_e").cast(T.DECIMAL), c(f"{name}_r")
            if a.name == "AVG":
                value, exact, r = F.coalesce(F.try_divide(value, c(f"{name}_n")), value), F.coalesce(F.try_divide(exact, c(f"{name}_n")).cast(T.DECIMAL), exact), F.greatest(r, F.lit(1))
            return cols, Ex("num", value, exact, r)
        if a.name in ("MIN", "MAX"):
            fn = F.min if a.name == "MIN" else F.max
            if x.kind in ("str", "time") or (x.kind == "num" and isinstance(x.rank, int)):
                value = x.exact if x.kind == "num" and x.rank < 2 and x.exact is not None else x.col
                return [fn(value).alias(name)], Ex(x.kind, c(name), c(name).cast(T.DECIMAL) if x.kind == "num" and x.rank < 2 else None, x.rank)
            t = x.term()
            return [fn(F.when(t.isNotNull(), T.sort_key(t))).alias(name)], Ex("term", c(name)["term"])
        if a.name == "SAMPLE":
            return [F.min(x.term()).alias(name)], Ex("term", c(name))
        texts = T.text(x.term())
        every = F.collect_set(texts) if a.distinct else F.collect_list(texts)
        return [F.array_join(F.array_sort(every), a.separator).alias(name)], Ex("str", c(name))

    def count_join(self, node: A.Group, graph: str | None) -> Rel | None:
        """COUNT(*) of a join, by groups too, without its rows: each part is counted by the variables others need, and counts multiply."""
        parts: list[tuple[tuple, bool]] = []  # units, optional
        inner, name = node.pattern, graph
        if isinstance(inner, A.Graph) and graph is None:
            inner, name = inner.pattern, inner.name
        optional = []
        while isinstance(inner, A.LeftJoin) and isinstance(inner.right, A.BGP) and inner.condition is None:
            optional.insert(0, inner.right)
            inner = inner.left
        if not isinstance(inner, A.BGP) or not inner.triples:
            return None
        parts = [((u,), False) for u in self.ordered(inner, name)] + [(tuple(self.ordered(b, name)), True) for b in optional]
        if len(parts) < 2:
            return None
        g = {name} if name and is_var(name) else set()
        names = [set().union(*(A.pattern_vars(A.BGP(u)) for u in p)) | g for p, _ in parts]
        main = set().union(*(v for v, (_, o) in zip(names, parts) if not o))
        keys = set(node.keys) | ({graph} if graph and is_var(graph) else set())
        if not keys <= main:
            return None
        for i, (_, opt) in enumerate(parts):
            others = set().union(*(v for j, v in enumerate(names) if j != i and parts[j][1]))
            if opt and (names[i] - main) & others:
                return None  # an optional part that feeds another

        def weighted(rel: Rel, needed: set[str], weight: Column) -> Rel:
            rel_vars = sorted(rel.vars & needed)
            by = [F.col(f"`{col_of(v)}__n`") if v in rel.native else F.col(f"`{col_of(v)}`") for v in rel_vars]
            native = {v: rel.native[v] for v in rel_vars if v in rel.native}
            df = rel.df.groupBy(*by).agg(weight.alias("__w"))
            bare = Rel(df, frozenset(rel_vars), native=native)
            return replace(bare, df=df.select(*[bare.ex(v).term().alias(col_of(v)) for v in rel_vars], *[F.col(f"`{col_of(v)}__n`") for v in native], "__w"))

        total: Rel | None = None
        for i, (units, opt) in enumerate(parts):
            rel = reduce(self.join, [self.one_unit(u, name) for u in units])
            later = set().union(keys, *names[i + 1 :])
            before = set().union(set(), *names[:i])
            part = weighted(rel, later | before, F.count(F.lit(1)))
            if total is None:
                total = part
                continue
            shared = sorted(total.vars & part.vars)
            right = part.df.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in part.df.columns])
            _, _, on = self.keys(total, part, shared)
            tests = [F.col(f"`{on[v]}`") == F.col(f"`__r_{on[v]}`") for v in shared]
            how = "left" if opt else "inner"
            joined = total.df.join(right, reduce(lambda a, b: a & b, tests), how) if tests else total.df.join(right, F.lit(True), how) if opt else total.df.crossJoin(right)
            w = F.col("__w") * (F.coalesce(F.col("__r___w"), F.lit(1)) if opt else F.col("__r___w"))
            fresh = [v for v in sorted(part.vars) if v not in total.vars and not opt]
            cols = total.columns(sorted(total.vars)) + [F.col(f"`__r_{c}`").alias(c) for v in fresh for c in ([col_of(v), f"{col_of(v)}__n"] if v in part.native else [col_of(v)])]
            both = Rel(joined.select(*cols, w.alias("__w")), total.sure | frozenset(fresh), native=total.native | {v: part.native[v] for v in fresh if v in part.native})
            total = weighted(both, later, F.sum("__w")) if both.vars - later else both
        if keys:
            total = weighted(total, keys, F.sum("__w"))
        else:
            total = Rel(total.df.agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("__w")), frozenset())
        cols, native = total.columns(sorted(keys)), dict(total.native)
        for out, _ in node.aggregates:
            more, kinds = bind(Ex("num", F.col("__w"), F.col("__w").cast(T.DECIMAL), 0), out)
            cols += more
            native |= kinds
        return Rel(total.df.select(*cols), frozenset(keys) | {v for v, _ in node.aggregates}, native=native)

    def service(self, node: A.Service, graph: str | None) -> Rel:
        if node.name != FTS or self.search is None:
            raise SparqlError(f"SERVICE {node.name} is not supported")
        return self.search.service(self, node, graph)


def conjuncts(e: object) -> list:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, A.Call) and e.name == "AND" else [e]


def has_exists(e: object) -> bool:
    return isinstance(e, A.Exists) or (isinstance(e, A.Call) and any(has_exists(a) for a in e.args))


def closure(edges: DataFrame, keep: list[str], rounds: int) -> DataFrame:
    """All pairs joined by one or more steps. Each round doubles the length of the ways known and writes what is new."""
    g = keep[2:]
    found = written(edges.select(*keep).distinct())
    for _ in range(rounds):
        left = found.select(F.col("s"), F.col("o").alias("m"), *g)
        right = found.select(F.col("s").alias("m"), F.col("o"), *g)
        more = left.join(right, ["m", *g]).select(*keep).distinct()
        new = written(more.join(found, keep, "left_anti"))
        if new.isEmpty():
            return found
        found = written(found.unionByName(new))
    raise SparqlError(f"a path has no end within {rounds} rounds")


def reach(edges: DataFrame, start: str, keep: list[str], rounds: int) -> DataFrame:
    """What one or more steps reach from a node: only the frontier is joined, round after round."""
    g = keep[2:]
    edges = written(edges.select(*keep).distinct())
    found = frontier = written(edges.where(F.col("s") == start).select(*keep))
    for _ in range(1 << 20):
        step = frontier.select(F.col("o").alias("m"), *g).join(edges.select(F.col("s").alias("m"), "o", *g), ["m", *g])
        new = step.select(F.lit(start).alias("s"), "o", *g).distinct().join(found, keep, "left_anti")
        frontier = written(new)
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier))
    raise SparqlError("a path has no end")
