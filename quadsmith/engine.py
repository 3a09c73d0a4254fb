"""The engine: a source of quads with its graphs, who may read them, and the queries over what is visible."""

from __future__ import annotations

import fnmatch
import re
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .plans import algebra as A
from .plans.compiler import Compiler, Rel, col_of
from .plans.parser import SparqlError, parse_query, parse_update
from .sources.quads import MappedTables, QuadTable


class Denied(PermissionError):
    """A graph that may not be read or written."""


class LimitExceeded(RuntimeError):
    """A result, or the work for it, is larger than its limits allow; nothing was cut."""


@dataclass(frozen=True)
class Limits:
    """None: no limit. The defaults are for callers that collect results; DataFrames are unlimited."""

    query_bytes: int | None = 1 << 20
    rows: int | None = 100_000
    seconds: float | None = 30.0
    changes: int | None = 1_000_000


@dataclass(frozen=True)
class Policy:
    """Who may see a graph: everybody, or those with a grant that matches one of its paths."""

    public: bool = False
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Grants:
    """Glob patterns of permission paths, for reading and for writing. A public graph is read by all and written by none."""

    read: tuple[str, ...] = ()
    write: tuple[str, ...] = ()

    def allows(self, policy: Policy, action: str) -> bool:
        if action == "read" and policy.public:
            return True
        globs = [re.compile(fnmatch.translate(g)) for g in (self.write if action == "write" else self.read + self.write)]
        return any(g.match(p) for g in globs for p in policy.paths)


@dataclass(frozen=True)
class Everyone:
    """Allows, or denies, everything."""

    allow: bool = True

    def allows(self, policy: Policy, action: str) -> bool:
        return self.allow


@dataclass
class Prepared:
    """A parsed query; it can run any number of times, over any state."""

    text: str
    query: A.Query
    cache: dict = field(default_factory=dict)


class Result:
    """Solutions as a DataFrame of terms, one column a variable; null is unbound."""

    def __init__(self, rel: Rel, names: list[str]):
        self.rel, self.names = rel, names

    @property
    def df(self) -> DataFrame:
        return self.rel.df.select(*[F.col(f"`{col_of(v)}`").alias(v[1:]) for v in self.names])

    def typed(self, **kinds: str) -> DataFrame:
        """Columns as Spark values; kinds as in functions.terms.typed. Native columns are used where the plan has them."""
        out = []
        for name, kind in kinds.items():
            ex = self.rel.ex(f"?{name}")
            if ex.kind == "num" and kind in ("long", "double", "decimal"):
                col = {"long": lambda: ex.col.cast("long"), "double": lambda: ex.col.cast("double"), "decimal": lambda: ex.exact if ex.exact is not None else ex.col.try_cast(T.DECIMAL)}[kind]()
            elif ex.kind == "str" and kind == "string" or ex.kind == "time" and kind == "timestamp":
                col = ex.col
            elif ex.kind == "key" and kind == "key":
                col = ex.col
            elif kind == "key":
                col = F.regexp_extract(ex.term(), r"/([^/>]*)>$", 1).try_cast("long")
            else:
                col = T.typed(ex.term(), kind)
            out.append(col.alias(name))
        return self.rel.df.select(*out)


class Engine:
    """Queries over one state of a source. Updates return changes, and `applied` the engine with them."""

    def __init__(self, spark: SparkSession, source: QuadTable | MappedTables, graphs: DataFrame | None = None, policies: dict[str, Policy] | None = None, hidden: DataFrame | None = None, search=None, optimize: bool = True):
        self.spark, self.source, self.policies, self.hidden, self.search, self.optimize = spark, source, policies, hidden, search, optimize
        self._graphs = graphs
        self._parsed: dict[str, Prepared] = {}

    # --- graphs and who may see them

    @property
    def graphs(self) -> DataFrame:
        """All named graphs, empty ones too where a registry was given."""
        return self._graphs if self._graphs is not None else self.source.scan(None).select("g").distinct()

    def visible_graphs(self, who=Everyone()) -> DataFrame:
        """Names of the graphs that `who` may read. Policies are a driver-side registry; graphs without one are private."""
        if self.policies is None:
            return self.graphs if who.allows(Policy(True), "read") else self.graphs.limit(0)
        names = [(g,) for g, p in self.policies.items() if who.allows(p, "read")]
        return self.spark.createDataFrame(names, "g string").join(self.graphs, "g", "left_semi")

    def allowed(self, who, graph: str, action: str) -> bool:
        return who.allows((self.policies or {}).get(graph, Policy(self.policies is None)), action)

    def scoped(self, who=Everyone(), graphs: Iterable[str] | None = None) -> tuple[QuadTable | MappedTables, DataFrame, str | None]:
        """The visible source, its graphs and, if it is only one, that graph's name."""
        everything = self.policies is None and graphs is None and who.allows(Policy(True), "read")
        names = self.visible_graphs(who)
        if graphs is not None:
            asked = list(dict.fromkeys(graphs))
            known = {r["g"] for r in names.where(F.col("g").isin(asked)).collect()}  # no more than were asked for
            if bad := [g for g in asked if g not in known]:
                raise Denied(f"graph {bad[0]} is missing or may not be read")
            names = names.where(F.col("g").isin(asked))
        source = self.source
        if isinstance(source, MappedTables):
            if not everything:
                source = QuadTable(source.scan(None))
            elif self.hidden is None:
                return source, names, None
        source = source.visible(None if everything else names, self.hidden)
        return source, names, asked[0] if graphs is not None and len(asked) == 1 else None

    # --- queries

    def prepare(self, text: str, limits: Limits = Limits()) -> Prepared:
        if limits.query_bytes is not None and len(text.encode()) > limits.query_bytes:
            raise LimitExceeded("the query's text is too long")
        if text not in self._parsed:
            self._parsed[text] = Prepared(text, parse_query(text))
        return self._parsed[text]

    def _compile(self, prepared: Prepared, who, graphs) -> tuple[Compiler, A.Query]:
        q = prepared.query
        source, names, single = self.scoped(who, graphs)
        if q.from_default or q.from_named:
            asked = [*q.from_default, *q.from_named]
            visible = {r["g"] for r in names.where(F.col("g").isin(asked)).collect()}
            if q.from_default:
                if q.from_default[0] not in visible:
                    raise Denied(f"graph {q.from_default[0]} is missing or may not be read")
                single = q.from_default[0]
            names = names.where(F.col("g").isin([g for g in q.from_named if g in visible]))
            if isinstance(source, MappedTables):
                source = QuadTable(source.scan(None))
            source = QuadTable(source.quads.where(F.col("g").isin(sorted(visible))), source.counts)
            if q.from_named and not q.from_default:
                single = "<urn:quadsmith:none>"
        return Compiler(self.spark, source, names, self.search, self.optimize, single), q

    def query(self, text: str | Prepared, who=Everyone(), graphs: Iterable[str] | None = None) -> Result | DataFrame:
        """SELECT: a Result. ASK: one row, column `answer`. CONSTRUCT and DESCRIBE: distinct rows s, p, o."""
        prepared = text if isinstance(text, Prepared) else self.prepare(text)
        compiler, q = self._compile(prepared, who, graphs)
        if q.form == "DESCRIBE":
            return self._describe(compiler, q)
        rel = compiler.asked(q.pattern) if q.form == "ASK" else compiler.compile(q.pattern)
        if q.form == "SELECT":
            names = list(q.vars) or sorted(rel.vars)
            return Result(rel, names)
        if q.form == "ASK":
            return rel.df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        return self._construct(rel, q.template)

    def _construct(self, rel: Rel, template: tuple[A.Triple, ...]) -> DataFrame:
        numbered = rel.df.withColumn("__row", F.monotonically_increasing_id()) if any(x.startswith("?_:") for t in template for x in (t.s, t.p, t.o)) else rel.df

        def slot(x: str):
            if x.startswith("?_:"):
                return F.concat(F.lit(f"_:{x[3:]}-"), F.col("__row").cast("string"))
            if A.is_var(x):
                ex = rel.ex(x)
                return ex.term() if ex else F.lit(None).cast("string")
            return F.lit(x)

        parts = [numbered.select(slot(t.s).alias("s"), slot(t.p).alias("p"), slot(t.o).alias("o")) for t in template]
        out = parts[0] if parts else self.spark.createDataFrame([], "s string, p string, o string")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND left(s, 1) <> '\"' AND left(p, 1) = '<'").distinct()

    def _describe(self, compiler: Compiler, q: A.Query) -> DataFrame:
        """The outgoing triples of the resources."""
        fixed = [t for t in q.targets if not A.is_var(t)]
        found = self.spark.createDataFrame([(t,) for t in fixed], "s string")
        names = [t for t in q.targets if A.is_var(t)]
        if names:
            rel = compiler.compile(q.pattern)
            for v in names:
                if rel.ex(v) is not None:
                    found = found.unionByName(rel.df.select(rel.ex(v).term().alias("s")))
        triples = compiler.source.scan(None)
        if compiler.single:
            triples = triples.where(F.col("g") == compiler.single)
        return triples.select("s", "p", "o").join(found.distinct(), "s", "left_semi").distinct()

    def explain(self, text: str | Prepared, who=Everyone(), graphs: Iterable[str] | None = None) -> str:
        """The algebra and Spark's plan. Who can't read everything isn't told about the plan."""
        prepared = text if isinstance(text, Prepared) else self.prepare(text)
        head = f"algebra: {prepared.query.pattern}\n"
        if self.policies is not None and not all(who.allows(p, "read") for p in self.policies.values()):
            return head + "plan: withheld"
        made = self.query(prepared, who, graphs)
        df = made.df if isinstance(made, Result) else made
        return head + df._jdf.queryExecution().toString()

    def collect(self, text: str | Prepared, who=Everyone(), graphs: Iterable[str] | None = None, limits: Limits = Limits()) -> list:
        """Rows on the driver. Beyond the limits it is an error, never fewer rows."""
        if isinstance(text, str):
            text = self.prepare(text, limits)
        made = self.query(text, who, graphs)
        df = made.df if isinstance(made, Result) else made
        if limits.rows is not None:
            df = df.limit(limits.rows + 1)
        rows = with_deadline(self.spark, df.collect, limits.seconds)
        if limits.rows is not None and len(rows) > limits.rows:
            raise LimitExceeded(f"more than {limits.rows} rows")
        return rows

    # --- updates

    def changes(self, text: str, who=Everyone()) -> DataFrame:
        """What an update would do: distinct rows op (insert or delete), g, s, p, o, all of one graph that `who` may write.

        Operations see the state before the update; deletions come before insertions.
        """
        parts: list[DataFrame] = []
        for u in parse_update(text):
            parts.append(self._changes_of(u, who))
        out = parts[0] if parts else self.spark.createDataFrame([], "op string, g string, s string, p string, o string")
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.distinct()
        touched = [r["g"] for r in out.select("g").distinct().limit(2).collect()]
        if len(touched) > 1:
            raise SparqlError("an update may change one graph only")
        if touched and not self.allowed(who, touched[0], "write"):
            raise Denied(f"graph {touched[0]} may not be written")
        return out

    def _changes_of(self, u: A.Update, who) -> DataFrame:
        schema = "op string, g string, s string, p string, o string"
        if u.kind in ("INSERT DATA", "DELETE DATA"):
            quads = u.insert or u.delete
            if any(q[0] is None for q in quads):
                raise SparqlError("a named graph is needed")
            if any(A.is_var(x) and not x.startswith("?_:") for q in quads for x in q):
                raise SparqlError("a variable in data")
            if u.delete and any(A.is_var(x) for q in quads for x in q):
                raise SparqlError("a blank node in DELETE DATA")
            ground = lambda x: x[1:] if A.is_var(x) else x
            return self.spark.createDataFrame([("insert" if u.insert else "delete", *map(ground, q)) for q in quads], schema)
        source, names, _ = self.scoped(who)
        every = source.scan(None).select("g", "s", "p", "o")
        if u.kind in ("CLEAR", "DROP"):
            if u.target == "DEFAULT":
                raise SparqlError("the default graph holds nothing of its own")
            if u.target[:1] == "<":
                known = not names.where(F.col("g") == u.target).isEmpty()
                if not known and not u.silent:
                    raise Denied(f"graph {u.target} is missing or may not be read")
                every = every.where(F.col("g") == u.target)
            return every.select(F.lit("delete").alias("op"), "g", "s", "p", "o")
        if u.kind == "CREATE":
            if names.where(F.col("g") == u.target).isEmpty() and not u.silent:
                raise SparqlError("CREATE of a new graph is not supported")
            return self.spark.createDataFrame([], schema)
        if u.kind != "MODIFY":
            raise SparqlError(f"{u.kind} is not supported")
        single = None
        if len(set(u.using)) > 1:
            raise SparqlError("more than one USING graph")
        if u.using:
            single = u.using[0]
        if u.using_named:
            names = names.where(F.col("g").isin(list(u.using_named)))
        rel = Compiler(self.spark, source, names, self.search, self.optimize, single).compile(u.pattern)
        df = rel.df.withColumn("__row", F.monotonically_increasing_id())

        def slot(x):
            if x is None:
                raise SparqlError("a named graph is needed")
            if x.startswith("?_:"):
                return F.concat(F.lit(f"_:{x[3:]}-"), F.col("__row").cast("string"))
            if A.is_var(x):
                ex = rel.ex(x)
                return ex.term() if ex else F.lit(None).cast("string")
            return F.lit(x)

        parts = [df.select(F.lit(op).alias("op"), *[slot(x).alias(c) for c, x in zip("gspo", q)]) for op, quads in (("delete", u.delete), ("insert", u.insert)) for q in quads]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.where("g IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND left(g, 1) = '<' AND left(s, 1) <> '\"' AND left(p, 1) = '<'")
        return out

    def applied(self, changes: DataFrame) -> "Engine":
        """The engine over the quads with the changes: deletions first, then insertions."""
        base = self.source.scan(None).select("g", "s", "p", "o")
        return Engine(self.spark, QuadTable(overlay(base, changes)), self._graphs, self.policies, self.hidden, None, self.optimize)

    def update(self, text: str, who=Everyone()) -> "Engine":
        return self.applied(self.changes(text, who))


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Quads with changes laid over them."""
    key = ["g", "s", "p", "o"]
    kept = base.join(changes.where("op = 'delete'").select(*key), key, "left_anti")
    return kept.select(*key).unionByName(changes.where("op = 'insert'").select(*key)).distinct()


def with_deadline(spark: SparkSession, action: Callable, seconds: float | None):
    """Run an action; its Spark jobs are cancelled, and it fails, when the time is over."""
    if seconds is None:
        return action()
    tag = f"quadsmith-{time.monotonic_ns()}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.start()
    spark.sparkContext.addJobTag(tag)
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise LimitExceeded(f"more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
