"""Structural rules of metadata packages, one graph each: the graph's IRI is the root dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..session import written

S = T.SCHEMA
DATASET, MEDIA, WORK = f"<{S}Dataset>", f"<{S}MediaObject>", f"<{S}CreativeWork>"
HAS_PART, ABOUT = f"<{S}hasPart>", f"<{S}about>"
REQUIRED = [f"<{S}name>", f"<{S}description>", f"<{S}datePublished>"]
DESCRIPTOR = "ro-crate-metadata.json"


def reachable(quads: DataFrame) -> DataFrame:
    """(g, entity): what each graph's root reaches over hasPart, the root included. Rounds join the frontier only."""
    edges = written(quads.where(F.col("p") == HAS_PART).select("g", "s", "o").distinct())
    found = frontier = written(quads.select("g").distinct().select("g", F.col("g").alias("entity")))
    while True:
        step = frontier.join(edges.withColumnRenamed("s", "entity"), ["g", "entity"]).select("g", F.col("o").alias("entity")).distinct()
        frontier = written(step.join(found, ["g", "entity"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier))


def entities(quads: DataFrame) -> DataFrame:
    """(g, entity): data entities: files and datasets, and both ends of hasPart; never the root."""
    typed = quads.where((F.col("p") == T.RDF_TYPE) & F.col("o").isin(DATASET, MEDIA)).select("g", F.col("s").alias("entity"))
    parts = quads.where(F.col("p") == HAS_PART)
    every = typed.unionByName(parts.select("g", F.col("s").alias("entity"))).unionByName(parts.select("g", F.col("o").alias("entity")))
    return every.where("entity <> g").distinct()


def orphans(quads: DataFrame) -> DataFrame:
    """(g, entity): data entities that the root doesn't reach; queries hide them."""
    return entities(quads).join(reachable(quads), ["g", "entity"], "left_anti")


def valid_date(text: Column) -> Column:
    """A calendar date, a month or a year, or a date and time."""
    shape = text.rlike(r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$")
    full = F.concat(F.substring(text, 1, 10), F.when(F.length(text) == 4, "-01-01").when(F.length(text) == 7, "-01").otherwise(""))
    return F.coalesce(shape & full.try_cast("date").isNotNull(), F.lit(False))


def violations(quads: DataFrame) -> DataFrame:
    """(g, rule, entity): every broken rule of every graph."""
    root = F.col("s") == F.col("g")
    is_type = lambda t: (F.col("p") == T.RDF_TYPE) & (F.col("o") == t)
    descriptor = F.endswith("s", F.lit(f"{DESCRIPTOR}>"))
    date = root & (F.col("p") == REQUIRED[2])
    flags = quads.groupBy("g").agg(
        F.coalesce(F.max(root & is_type(DATASET)), F.lit(False)).alias("root"),
        F.coalesce(F.max(descriptor & is_type(WORK)), F.lit(False)).alias("descriptor"),
        F.coalesce(F.max(descriptor & (F.col("p") == ABOUT) & (F.col("o") == F.col("g"))), F.lit(False)).alias("about"),
        *[F.count_if(root & (F.col("p") == p)).alias(f"n{i}") for i, p in enumerate(REQUIRED)],
        F.coalesce(F.bool_and(F.when(date, valid_date(T.text(F.col("o"))))), F.lit(True)).alias("date"),
    )
    tests = [("root-type", ~F.col("root")), ("descriptor-type", ~F.col("descriptor")), ("descriptor-about", ~F.col("about")), *[(f"required-{p.rpartition('/')[2][:-1]}", F.col(f"n{i}") == 0) for i, p in enumerate(REQUIRED)], ("one-date", F.col("n2") > 1), ("date-form", ~F.col("date"))]
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())
    whole = flags.select("g", F.explode(broken).alias("rule"), F.col("g").alias("entity"))
    untyped = quads.select("g", F.col("s").alias("entity")).distinct().join(quads.where(F.col("p") == T.RDF_TYPE).select("g", F.col("s").alias("entity")), ["g", "entity"], "left_anti")
    lost = orphans(quads)
    return whole.unionByName(untyped.select("g", F.lit("untyped").alias("rule"), "entity")).unionByName(lost.select("g", F.lit("orphan").alias("rule"), "entity"))


def replacement(document: DataFrame, quads: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Changes (op, g, s, p, o) that make a graph equal a document; hidden rows stay unless their subject is written anew."""
    key = ["g", "s", "p", "o"]
    gone = quads.select(*key).join(document.select(*key), key, "left_anti")
    if hidden is not None:
        secret = gone.join(hidden.select("g", F.col("entity").alias("s")), ["g", "s"], "left_semi").join(document.select("g", "s").distinct(), ["g", "s"], "left_anti")
        gone = gone.join(secret, key, "left_anti")
    new = document.select(*key).distinct().join(quads.select(*key), key, "left_anti")
    return gone.select(F.lit("delete").alias("op"), *key).unionByName(new.select(F.lit("insert").alias("op"), *key))


def patch(quads: DataFrame, graph: str, entity: str, values: dict[str, list[str]]) -> DataFrame:
    """Changes that give an entity new values for some predicates and leave the others."""
    spark = quads.sparkSession
    rows = [(graph, entity, p, o) for p, os in values.items() for o in os]
    new = spark.createDataFrame(rows, "g string, s string, p string, o string")
    old = quads.where((F.col("g") == graph) & (F.col("s") == entity) & F.col("p").isin(list(values)))
    return replacement(new, old)


def upsert(quads: DataFrame, graph: str, entity: str, triples: list[tuple[str, str]], parent: str | None = None) -> DataFrame:
    """Changes that replace an entity's triples, and link it from a parent (the root: the graph's name) if one is named."""
    spark = quads.sparkSession
    rows = [(graph, entity, p, o) for p, o in triples]
    changes = replacement(spark.createDataFrame(rows, "g string, s string, p string, o string"), quads.where((F.col("g") == graph) & (F.col("s") == entity)))
    if parent is not None:
        link = spark.createDataFrame([(graph, parent, HAS_PART, entity)], "g string, s string, p string, o string").join(quads, ["g", "s", "p", "o"], "left_anti")
        changes = changes.unionByName(link.select(F.lit("insert").alias("op"), "g", "s", "p", "o"))
    return changes


def remove(quads: DataFrame, graph: str, entity: str) -> DataFrame:
    """Changes that delete an entity's triples and the hasPart links to it."""
    gone = quads.where((F.col("g") == graph) & ((F.col("s") == entity) | ((F.col("p") == HAS_PART) & (F.col("o") == entity))))
    return gone.select(F.lit("delete").alias("op"), "g", "s", "p", "o")


def scaffold(graph: str, name: str, description: str, date: str, version: str = "1.1") -> list[tuple[str, str, str, str]]:
    """The quads of a new package: descriptor and root."""
    d = f"<{graph[1:-1].rstrip('/')}/{DESCRIPTOR}>"
    return [
        (graph, d, T.RDF_TYPE, WORK),
        (graph, d, ABOUT, graph),
        (graph, d, "<http://purl.org/dc/terms/conformsTo>", f"<https://w3id.org/ro/crate/{version}>"),
        (graph, graph, T.RDF_TYPE, DATASET),
        (graph, graph, REQUIRED[0], T.literal(name)),
        (graph, graph, REQUIRED[1], T.literal(description)),
        (graph, graph, REQUIRED[2], T.literal(date)),
    ]
