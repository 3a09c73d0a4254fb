"""Sources of quads: a table of quads, and relational tables read as quads without being turned into any.

A source answers `scan(p)` with columns g, s, p, o for one predicate (or all), as canonical terms. Besides, a source may
offer `star`: all patterns of one subject in one pass over its table, with native columns beside the terms, where that
has the same result as joining the patterns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import Ex, constant, equal

BASE = "urn:d:"


class QuadTable:
    """Quads in one DataFrame with columns g, s, p, o. The same triple may stand in several graphs."""

    unique = False

    def __init__(self, quads: DataFrame, counts: dict[str, int] | None = None):
        self.quads = quads.select("g", "s", "p", "o")
        self.counts = counts

    def scan(self, p: str | None) -> DataFrame:
        return self.quads if p is None else self.quads.where(F.col("p") == p)

    def star(self, wanted: list[tuple[str, str]]):
        return None

    def size(self, p: str | None) -> int:
        """Rows of a predicate as far as known."""
        if self.counts is None:
            return 1 << 20
        return sum(self.counts.values()) if p is None else self.counts.get(p, 0)

    def targets(self, p: str) -> int | None:
        """Different objects of a predicate, as far as known."""
        return None

    def counted(self) -> "QuadTable":
        """With the number of rows of each predicate, for the order of joins: one row a predicate comes to the driver."""
        return QuadTable(self.quads, {r["p"]: r["n"] for r in self.quads.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()})

    def visible(self, readable: DataFrame | None = None, hidden: DataFrame | None = None) -> "QuadTable":
        """Only the graphs of `readable` (g), without quads of the entities in `hidden` (g, entity)."""
        out = self.quads
        if readable is not None:
            out = out.join(readable.select("g").distinct(), "g", "left_semi")
        if hidden is not None:
            h = hidden.select("g", "entity").distinct()
            out = out.join(h.withColumnRenamed("entity", "s"), ["g", "s"], "left_anti").join(h.withColumnRenamed("entity", "o"), ["g", "o"], "left_anti")
        return QuadTable(out.select("g", "s", "p", "o"), self.counts)


@dataclass
class Mapped:
    """One column as objects. kind: string, integer, double, dateTime or iri (with the prefix of the IRI)."""

    kind: str
    column: str
    prefix: str = ""

    def ex(self) -> Ex:
        c = F.col(self.column)
        if self.kind == "string":
            return Ex("str", c)
        if self.kind == "integer":
            return Ex("num", c.cast("long"), c.cast(T.DECIMAL), 0)
        if self.kind == "double":
            return Ex("num", c, None, 3)
        if self.kind == "dateTime":
            return Ex("time", c)
        return Ex("key", c, prefix=self.prefix)

    def is_term(self, term: str) -> Column:
        """Whether the object is this very term, as a condition on the native column."""
        if self.kind == "iri":
            key = term[len(self.prefix) : -1] if term.startswith(self.prefix) else None
            return F.lit(False) if key is None else F.col(self.column) == F.lit(key)
        if self.kind == "string":
            c = constant(term)
            return F.col(self.column) == c.col if c.kind == "str" else F.lit(False)
        value = constant(term)
        return equal(value, self.ex()) & (self.ex().term() == F.lit(term))


@dataclass
class TableMap:
    """A table of which each row is a subject: the column of its key, its graph, and its predicates."""

    name: str
    df: DataFrame
    key: str
    predicates: dict[str, Mapped]
    graph: Column | None = None
    rows: int | None = field(default=None)

    @property
    def prefix(self) -> str:
        return f"<{BASE}{self.name}/"

    @property
    def type(self) -> str:
        return f"<{BASE}type/{self.name}>"

    def graph_term(self) -> Column:
        return self.graph if self.graph is not None else F.lit(f"<{BASE}g/{self.name}>")

    def size(self) -> int:
        if self.rows is None:
            self.rows = self.df.count()  # from the files' footers
        return self.rows


class MappedTables:
    """Tables as quads. Keys are unique and every predicate of a row has one value, so a triple is in one graph only."""

    unique = True

    def __init__(self, spark: SparkSession, maps: list[TableMap]):
        self.spark, self.maps = spark, maps

    def _part(self, m: TableMap, p: str) -> DataFrame:
        o = F.lit(m.type) if p == T.RDF_TYPE else m.predicates[p].ex().term()
        key = Ex("key", F.col(m.key), prefix=m.prefix)
        return m.df.select(m.graph_term().alias("g"), key.term().alias("s"), F.lit(p).alias("p"), o.alias("o")).where("o IS NOT NULL")

    def scan(self, p: str | None) -> DataFrame:
        parts = [self._part(m, q) for m in self.maps for q in [T.RDF_TYPE, *m.predicates] if p in (None, q)]
        if not parts:
            return self.spark.createDataFrame([], "g string, s string, p string, o string")
        return reduce(DataFrame.unionByName, parts)

    def size(self, p: str | None) -> int:
        return sum(m.size() * (1 if p else 1 + len(m.predicates)) for m in self.maps if p is None or p == T.RDF_TYPE or p in m.predicates)

    def targets(self, p: str) -> int | None:
        """Different objects of a predicate, as far as known: of a link, no more than the rows it leads to."""
        links = {m.predicates[p].prefix for m in self.maps if p in m.predicates and m.predicates[p].kind == "iri"}
        return sum(m.size() for m in self.maps if m.prefix in links) or None

    def owner(self, p: str) -> TableMap | None:
        """The only table with this predicate."""
        have = [m for m in self.maps if p in m.predicates]
        return have[0] if len(have) == 1 else None

    def star(self, wanted: list[tuple[str, str]]):
        """(map, rows, graph, subject, [object Ex]) for (predicate, object) pairs on one subject; constants are filtered on."""
        first = next((p for p, _ in wanted if p != T.RDF_TYPE), None)
        m = self.owner(first) if first else next((m for m in self.maps if m.type == wanted[0][1]), None)
        if m is None or any(p not in m.predicates and (p, o) != (T.RDF_TYPE, m.type) for p, o in wanted):
            return None
        df, objects = m.df, []
        for p, o in wanted:
            if p == T.RDF_TYPE:
                objects.append(Ex("term", F.lit(m.type)))
                continue
            mapped = m.predicates[p]
            df = df.where(F.col(mapped.column).isNotNull()) if o[:1] == "?" else df.where(mapped.is_term(o))
            objects.append(mapped.ex())
        return m, df, m.graph_term(), Ex("key", F.col(m.key), prefix=m.prefix), objects


def tpch(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> MappedTables:
    """The relational test tables; subjects `urn:d:{table}/{key}`, predicates `urn:d:{table}#{column}`."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def of(name: str, key: str, links: dict[str, str], graph: Column | None = None) -> TableMap:
        df = read(name)
        predicates = {}
        for column, kind in df.dtypes:
            if column in links:
                mapped = Mapped("iri", column, f"<{BASE}{links[column]}/")
            elif kind in ("int", "bigint", "smallint"):
                mapped = Mapped("integer", column)
            elif kind in ("double", "float"):
                mapped = Mapped("double", column)
            elif kind.startswith("timestamp"):
                mapped = Mapped("dateTime", column)
            elif kind == "string":
                mapped = Mapped("string", column)
            else:
                continue
            predicates[f"<{BASE}{name}#{column}>"] = mapped
        return TableMap(name, df, key, predicates, graph)

    made = {
        "region": lambda: of("region", "r_regionkey", {}),
        "nation": lambda: of("nation", "n_nationkey", {"n_regionkey": "region"}),
        "supplier": lambda: of("supplier", "s_suppkey", {"s_nationkey": "nation"}, F.concat(F.lit(f"<{BASE}g/supplier/"), F.col("s_nationkey").cast("string"), F.lit(">"))),
        "customer": lambda: of("customer", "c_custkey", {"c_nationkey": "nation"}, F.concat(F.lit(f"<{BASE}g/customer/"), F.col("c_nationkey").cast("string"), F.lit(">"))),
        "part": lambda: of("part", "p_partkey", {}),
        "orders": lambda: of("orders", "o_orderkey", {"o_custkey": "customer"}),
        "events": lambda: of("events", "event_id", {"user_id": "user"}, F.concat(F.lit(f"<{BASE}g/events/"), (F.col("user_id") % 8).cast("string"), F.lit(">"))),
        "documents": lambda: of("documents", "doc_id", {}, F.concat(F.lit(f"<{BASE}g/documents/"), F.col("source"), F.lit(">"))),
        "lineitem": lambda: lineitem(read("lineitem")),
    }

    def lineitem(df: DataFrame) -> TableMap:
        """Order and line don't identify a line, all columns do: the key is a digest of them."""
        m = of("lineitem", "row_key", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"})
        m.df = df.withColumn("row_key", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])))
        return m

    return MappedTables(spark, [made[t]() for t in (tables or list(made))])


def union_quads(source: MappedTables | QuadTable) -> DataFrame:
    """All quads of a source as terms."""
    return source.scan(None)


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """N-Quads lines as canonical quads; a line that is none raises when it is read, unless blank or a comment."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def fix(terms):
        return terms.map(lambda t: None if t is None else T.canonical(t))

    node = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    line = rf"^\s*{node}\s+(<[^>]*>)\s+{node}\s+(<[^>]*>)\s*\.\s*(?:#.*)?$"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", line, i)
    parsed = lines.select("value", part(4).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    bad = F.raise_error(F.concat(F.lit("not an N-Quads line: "), F.substring("value", 1, 80)))
    return parsed.select(F.when(F.col("g") == "", bad).otherwise(F.col("g")).alias("g"), "s", "p", fix("o").alias("o"))


def write_nquads(quads: DataFrame, path: str) -> None:
    quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit("."))).write.text(path)


