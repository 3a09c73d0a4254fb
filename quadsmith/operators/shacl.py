"""SHACL Core validation: shapes are read on the driver, data stays in DataFrames.

Each constraint of each shape becomes one DataFrame of violations (focus, path, value, shape, component, severity,
message) over all its focus nodes; a report is their union. Value nodes are sets. `sh:class` looks at direct types only.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import Ex, constant, less
from ..plans import algebra as A
from ..plans.compiler import Compiler
from ..sources.quads import QuadTable

SH = "http://www.w3.org/ns/shacl#"
REPORT = "focus string, path string, value string, shape string, component string, severity string, message string"
SEVERITIES = ["Info", "Warning", "Violation"]
_UNSUPPORTED = ["sparql", "rule", "expression", "js", "parameter", "reifierShape", "subsetOf", "reificationRequired"]
_VALUE = ["class", "datatype", "nodeKind", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern", "languageIn", "uniqueLang", "in", "hasValue", "equals", "disjoint", "lessThan", "lessThanOrEquals", "node", "not", "and", "or", "xone", "minCount", "maxCount", "qualifiedValueShape", "closed"]


class ShaclError(ValueError):
    """A shape that is malformed, recursive or of an unsupported kind."""


@dataclass
class Shape:
    name: str
    path: object | None = None
    targets: list[tuple[str, str]] = field(default_factory=list)
    constraints: list[tuple[str, list[str]]] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)
    flags: str | None = None
    ignored: list[str] = field(default_factory=list)
    qualified: tuple[int | None, int | None, bool] = (None, None, False)
    severity: str = "Violation"
    message: str | None = None
    active: bool = True


class Shapes:
    """A compiled shapes graph."""

    def __init__(self, triples: list[tuple[str, str, str]]):
        self.by: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in triples:
            if o not in self.by[s][p]:
                self.by[s][p].append(o)
        sh = lambda n: f"<{SH}{n}>"
        marks = {sh(n) for n in [*_VALUE, "property", "targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "path"]}
        names = [s for s, ps in list(self.by.items()) if marks & set(ps) or {sh("NodeShape"), sh("PropertyShape")} & set(ps.get(T.RDF_TYPE, []))]
        self.shapes: dict[str, Shape] = {}
        for s in names:
            ps = self.by[s]
            for bad in _UNSUPPORTED:
                if sh(bad) in ps:
                    raise ShaclError(f"sh:{bad} is not supported")
            shape = Shape(s)
            if sh("path") in ps:
                shape.path = self.path(ps[sh("path")][0])
            for kind in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf"):
                shape.targets += [(kind, o) for o in ps.get(sh(kind), [])]
            if f"<{T.RDFS}Class>" in ps.get(T.RDF_TYPE, []):
                shape.targets.append(("targetClass", s))
            shape.constraints = [(c, ps[sh(c)]) for c in _VALUE if sh(c) in ps]
            shape.properties = ps.get(sh("property"), [])
            shape.flags = next((T.unescape(o.rpartition('"')[0][1:]) for o in ps.get(sh("flags"), [])), None)
            shape.ignored = [x for o in ps.get(sh("ignoredProperties"), []) for x in self.items(o)]
            number = lambda n: next((int(o.split('"')[1]) for o in ps.get(sh(n), [])), None)
            shape.qualified = (number("qualifiedMinCount"), number("qualifiedMaxCount"), any('"true"' in o for o in ps.get(sh("qualifiedValueShapesDisjoint"), [])))
            shape.severity = next((o.rpartition("#")[2][:-1] for o in ps.get(sh("severity"), [])), "Violation")
            shape.message = next((T.unescape(o.rpartition('"')[0][1:]) for o in sorted(ps.get(sh("message"), []))), None)
            shape.active = not any('"true"' in o for o in ps.get(sh("deactivated"), []))
            self.shapes[s] = shape
        for s in self.shapes:
            self.check(s, ())

    def items(self, node: str) -> list[str]:
        out, seen = [], set()
        while node != f"<{T.RDF}nil>":
            if node in seen or f"<{T.RDF}first>" not in self.by[node]:
                raise ShaclError(f"malformed list at {node}")
            seen.add(node)
            out.append(self.by[node][f"<{T.RDF}first>"][0])
            node = self.by[node][f"<{T.RDF}rest>"][0]
        return out

    def path(self, node: str) -> object:
        if node.startswith("<"):
            return A.Link(node)
        ps = self.by[node]
        if f"<{T.RDF}first>" in ps:
            return reduce(A.Seq, [self.path(x) for x in self.items(node)])
        for name, make in (("inversePath", A.Inverse), ("zeroOrMorePath", lambda p: A.Repeat(p, "*")), ("oneOrMorePath", lambda p: A.Repeat(p, "+")), ("zeroOrOnePath", lambda p: A.Repeat(p, "?"))):
            if f"<{SH}{name}>" in ps:
                return make(self.path(ps[f"<{SH}{name}>"][0]))
        if f"<{SH}alternativePath>" in ps:
            return reduce(A.Alt, [self.path(x) for x in self.items(ps[f"<{SH}alternativePath>"][0])])
        raise ShaclError(f"no path: {node}")

    def parts(self, name: str) -> list[str]:
        shape = self.shapes.get(name)
        if shape is None:
            return []
        out = list(shape.properties)
        for c, values in shape.constraints:
            if c in ("node", "not", "qualifiedValueShape"):
                out += values
            elif c in ("and", "or", "xone"):
                out += [x for v in values for x in self.items(v)]
        return out

    def check(self, name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ShaclError(f"recursive shape {name}")
        for p in self.parts(name):
            self.check(p, (*above, name))


def compile_shapes(quads: DataFrame, graphs: list[str] | None = None, imports: bool = False) -> Shapes:
    """Shapes of some graphs of quads, with those they import among them if that is asked for. A shapes graph fits the driver."""
    rows = quads if graphs is None else quads.where(F.col("g").isin(graphs))
    triples = [(r["s"], r["p"], r["o"]) for r in rows.select("s", "p", "o").distinct().collect()]
    if imports and graphs is not None:
        wanted = {o for _, p, o in triples if p == "<http://www.w3.org/2002/07/owl#imports>"} - set(graphs)
        if wanted:
            return compile_shapes(quads, [*graphs, *sorted(wanted)], True)
    return Shapes(triples)


class Validator:
    """Validates one data graph (all rows of `quads`, hidden ones too) against shapes."""

    def __init__(self, spark: SparkSession, quads: DataFrame, shapes: Shapes):
        self.spark, self.shapes = spark, shapes
        self.triples = quads.select(F.lit("<urn:quadsmith:data>").alias("g"), "s", "p", "o").distinct()
        self.compiler = Compiler(spark, QuadTable(self.triples), single_graph="<urn:quadsmith:data>")

    def objects(self, p: str) -> DataFrame:
        return self.triples.where(F.col("p") == p).select(F.col("s").alias("focus"), F.col("o").alias("other"))

    def targets(self, shape: Shape) -> DataFrame:
        parts = []
        for kind, x in shape.targets:
            if kind == "targetNode":
                parts.append(self.spark.createDataFrame([(x,)], "focus string"))
            elif kind == "targetClass":
                parts.append(self.triples.where((F.col("p") == T.RDF_TYPE) & (F.col("o") == x)).select(F.col("s").alias("focus")))
            else:
                parts.append(self.triples.where(F.col("p") == x).select(F.col("s" if kind == "targetSubjectsOf" else "o").alias("focus")))
        return reduce(DataFrame.unionByName, parts).distinct()

    def values(self, shape: Shape, focus: DataFrame) -> DataFrame:
        """Distinct (focus, value)."""
        if shape.path is None:
            return focus.select("focus", F.col("focus").alias("value"))
        path = shape.path
        edges = self.compiler.edges(path, None).select(F.col("s").alias("focus"), F.col("o").alias("value"))
        out = edges.join(focus, "focus", "left_semi")
        if zero_long(path):
            out = out.unionByName(focus.select("focus", F.col("focus").alias("value")))
        return out.distinct()

    def report(self, focus: DataFrame | None = None, worst: str | None = None) -> DataFrame:
        """All violations; only those of some focus nodes (column focus) if those are given."""
        parts = []
        for shape in self.shapes.shapes.values():
            if shape.targets and shape.active:
                nodes = self.targets(shape)
                parts += self.check(shape, nodes if focus is None else nodes.join(focus, "focus", "left_semi"))
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], REPORT)
        if worst is not None:
            out = out.where(F.col("severity").isin(SEVERITIES[SEVERITIES.index(worst) :]))
        return out.distinct()

    def conforms(self) -> bool:
        return self.report().isEmpty()

    def delta(self, changed: DataFrame, rounds: int = 8) -> DataFrame:
        """Violations of the focus nodes that changed quads (s, o) can affect: what leads to them over any predicate, as far as the deepest shape looks."""
        depth = max([depth_of(self.shapes, s) for s in self.shapes.shapes] or [0])
        found = changed.select(F.col("s").alias("focus")).unionByName(changed.select(F.col("o").alias("focus"))).distinct()
        edges = self.triples.select("s", "o")
        for _ in range(min(depth, rounds)):
            back = edges.join(found.withColumnRenamed("focus", "o"), "o", "left_semi").select(F.col("s").alias("focus"))
            ahead = edges.join(found.withColumnRenamed("focus", "s"), "s", "left_semi").select(F.col("o").alias("focus"))
            found = found.unionByName(back).unionByName(ahead).distinct()
        return self.report() if depth > rounds else self.report(found)

    def failing(self, name: str, nodes: DataFrame) -> DataFrame:
        """Those of the nodes (focus) that don't conform to a shape."""
        shape = self.shapes.shapes.get(name)
        if shape is None or not shape.active:
            return nodes.limit(0)
        parts = self.check(shape, nodes)
        return reduce(DataFrame.unionByName, parts).select("focus").distinct() if parts else nodes.limit(0)

    def check(self, shape: Shape, focus: DataFrame) -> list[DataFrame]:
        """Violations of one shape, and of its property shapes, on some focus nodes."""
        if not shape.active:
            return []
        values = self.values(shape, focus)
        path = shape.path.iri if isinstance(shape.path, A.Link) else None if shape.path is None else str(shape.path)
        out: list[DataFrame] = []

        def add(rows: DataFrame, component: str) -> None:
            value = F.col("value") if "value" in rows.columns else F.lit(None).cast("string")
            out.append(rows.select("focus", F.lit(path).alias("path"), value.alias("value"), F.lit(shape.name).alias("shape"), (F.col("component") if "component" in rows.columns else F.lit(component)).alias("component"), F.lit(shape.severity).alias("severity"), F.lit(shape.message).alias("message")))

        for name, params in shape.constraints:
            for param in params:
                rows = self.constraint(shape, name, param, focus, values)
                if isinstance(rows, Column):
                    rows = values.where(~F.coalesce(rows, F.lit(False)))
                if rows is not None:
                    add(rows, name)
        for p in shape.properties:
            inner = self.shapes.shapes.get(p)
            if inner is None or inner.path is None:
                raise ShaclError(f"{p} is no property shape")
            nodes = focus if shape.path is None else values.select(F.col("value").alias("focus")).distinct()
            out += self.check(inner, nodes)
        return out

    def constraint(self, shape: Shape, name: str, x: str, focus: DataFrame, values: DataFrame) -> DataFrame | Column | None:
        """Violating rows, or the condition that good values meet."""
        v = F.col("value")
        if name in ("minCount", "maxCount"):
            n = int(x.split('"')[1])
            counts = focus.join(values.groupBy("focus").agg(F.count("value").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            return counts.where(F.col("n") < n if name == "minCount" else F.col("n") > n).select("focus")
        if name == "class":
            typed = self.triples.where((F.col("p") == T.RDF_TYPE) & (F.col("o") == x)).select(F.col("s").alias("value")).distinct()
            return values.join(typed, "value", "left_anti").select("focus", "value")
        if name == "datatype":
            dt = x[1:-1]
            good = T.datatype(v) == dt
            if dt in T.NUMERIC_RANK:
                good = good & (T.lex(v).rlike(r"^[+-]?\d+$") if T.NUMERIC_RANK[dt] == 0 else T.number(v).isNotNull())
            elif dt == f"{T.XSD}boolean":
                good = good & T.boolean(v).isNotNull()
            elif dt in (f"{T.XSD}dateTime", f"{T.XSD}date"):
                good = good & T.instant(v).isNotNull()
            return good
        if name == "nodeKind":
            kind = x.rpartition("#")[2][:-1]
            tests = {"IRI": T.is_iri(v), "BlankNode": T.is_blank(v), "Literal": T.is_literal(v)}
            return reduce(lambda a, b: a | b, [t for k, t in tests.items() if k in kind])
        if name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            op = {"minInclusive": ">=", "maxInclusive": "<=", "minExclusive": ">", "maxExclusive": "<"}[name]
            return less(Ex("term", v), constant(x), op)
        if name in ("minLength", "maxLength"):
            size = F.length(T.text(v))
            n = int(x.split('"')[1])
            return size >= n if name == "minLength" else size <= n
        if name == "pattern":
            body = T.unescape(x.rpartition('"')[0][1:])
            return T.text(v).rlike(f"(?{shape.flags}){body}" if shape.flags else body)
        if name == "languageIn":
            tags = [T.unescape(t.rpartition('"')[0][1:]).lower() for t in self.shapes.items(x)]
            tag = T.lang(v)
            return reduce(lambda a, b: a | b, [(tag == t) | F.startswith(tag, F.lit(f"{t}-")) for t in tags], F.lit(False))
        if name == "uniqueLang":
            if '"true"' not in x:
                return None
            tagged = values.select("focus", T.lang(v).alias("tag")).where("tag <> ''")
            return tagged.groupBy("focus", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("focus")
        if name == "in":
            return v.isin(self.shapes.items(x))
        if name == "hasValue":
            return focus.join(values.where(v == x), "focus", "left_anti").select("focus")
        if name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            others = self.objects(x).join(focus, "focus", "left_semi")
            same = others.withColumnRenamed("other", "value")
            if name == "equals":
                return values.join(same, ["focus", "value"], "left_anti").unionByName(same.join(values, ["focus", "value"], "left_anti"))
            if name == "disjoint":
                return values.join(same, ["focus", "value"], "left_semi")
            pairs = values.join(others, "focus")
            good = less(Ex("term", v), Ex("term", F.col("other")), "<" if name == "lessThan" else "<=")
            return pairs.where(~F.coalesce(good, F.lit(False))).select("focus", "value").distinct()
        nodes = values.select(F.col("value").alias("focus")).distinct()
        bad = lambda s: self.failing(s, nodes).withColumnRenamed("focus", "value")
        if name in ("node", "not"):
            return values.join(bad(x), "value", "left_semi" if name == "node" else "left_anti").select("focus", "value")
        if name in ("and", "or", "xone"):
            members = self.shapes.items(x)
            marks = reduce(DataFrame.unionByName, [bad(s) for s in members]).groupBy("value").agg(F.count(F.lit(1)).alias("bad"))
            n = F.coalesce(F.col("bad"), F.lit(0))
            wrong = {"and": n > 0, "or": n == len(members), "xone": n != len(members) - 1}[name]
            return values.join(marks, "value", "left").where(wrong).select("focus", "value")
        if name == "qualifiedValueShape":
            low, high, disjoint = shape.qualified
            good = values.join(bad(x), "value", "left_anti")
            if disjoint:
                for s in self.siblings(shape, x):
                    good = good.join(bad(s), "value", "left_semi")
            counts = focus.join(good.groupBy("focus").agg(F.count("value").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            wrong = F.lit(False)
            if low is not None:
                wrong = wrong | (F.col("n") < low)
            if high is not None:
                wrong = wrong | (F.col("n") > high)
            bound = F.when(F.col("n") < (low if low is not None else 0), "qualifiedMinCount").otherwise("qualifiedMaxCount")
            return counts.where(wrong).select("focus", bound.alias("component"))
        if name == "closed":
            if '"true"' not in x:
                return None
            allowed = [self.shapes.shapes[p].path.iri for p in shape.properties if isinstance(self.shapes.shapes[p].path, A.Link)] + shape.ignored
            rows = self.triples.where(~F.col("p").isin(allowed)) if allowed else self.triples
            return rows.select(F.col("s").alias("focus"), F.col("o").alias("value")).join(focus, "focus", "left_semi")
        raise ShaclError(f"sh:{name} is not supported")

    def siblings(self, shape: Shape, own: str) -> list[str]:
        """Other qualified shapes of the node shapes that hold this property shape."""
        out = []
        for holder in self.shapes.shapes.values():
            if shape.name in holder.properties:
                for p in holder.properties:
                    out += [q for c, qs in self.shapes.shapes[p].constraints if c == "qualifiedValueShape" for q in qs if q != own]
        return out


def zero_long(path: object) -> bool:
    """Whether a path also leads from every node to itself."""
    if isinstance(path, A.Repeat):
        return path.kind in "?*" or zero_long(path.path)
    if isinstance(path, A.Seq):
        return zero_long(path.left) and zero_long(path.right)
    if isinstance(path, A.Alt):
        return zero_long(path.left) or zero_long(path.right)
    return isinstance(path, A.Inverse) and zero_long(path.path)


def depth_of(shapes: Shapes, name: str) -> int:
    """How many steps from a focus node a shape looks; many for repeated paths."""

    def steps(p: object) -> int:
        if p is None:
            return 0
        if isinstance(p, A.Repeat) and p.kind in "*+":
            return 1 << 20
        return steps(p.left) + steps(p.right) if isinstance(p, A.Seq) else max(steps(p.left), steps(p.right)) if isinstance(p, A.Alt) else steps(p.path) if hasattr(p, "path") else 1

    shape = shapes.shapes.get(name)
    return 0 if shape is None else steps(shape.path) + 1 + max([depth_of(shapes, s) for s in shapes.parts(name)] or [0])
