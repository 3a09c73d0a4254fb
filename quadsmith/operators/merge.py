"""Convergent merging of graphs: observed-remove sets of quads, kept as dots.

An operation is a row (actor, counter, kind, g, s, p, o, witnessed): an `add` makes the dot (actor, counter) for its
quad; a `remove` takes away the quad's dots that its author had seen: those with counter <= witnessed[actor]. A quad
lives while it has a dot. Dots: rows (g, s, p, o, actor, counter); clocks: rows (g, actor, counter).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUAD = ["g", "s", "p", "o"]
DOT = ["actor", "counter"]


def distinct_ops(ops: DataFrame) -> DataFrame:
    """Replayed operations count once."""
    return ops.dropDuplicates(["g", *DOT])


def dots(ops: DataFrame) -> DataFrame:
    """The dots that no remove has witnessed. Removes are first reduced to the highest counter seen for each quad and actor."""
    adds = distinct_ops(ops).where("kind = 'add'").select(*QUAD, *DOT)
    seen = distinct_ops(ops).where("kind = 'remove'").select(*QUAD, F.explode("witnessed").alias("actor", "seen")).groupBy(*QUAD, "actor").agg(F.max("seen").alias("seen"))
    return adds.join(seen, [*QUAD, "actor"], "left").where("seen IS NULL OR counter > seen").select(*QUAD, *DOT)


def live(dots_: DataFrame) -> DataFrame:
    """The visible quads."""
    return dots_.select(*QUAD).distinct()


def clock(ops: DataFrame) -> DataFrame:
    """The highest counter of each actor in each graph."""
    return ops.groupBy("g", "actor").agg(F.max("counter").alias("counter"))


def merge_clocks(a: DataFrame, b: DataFrame) -> DataFrame:
    return clock(a.unionByName(b))


def merge(a: DataFrame, a_clock: DataFrame, b: DataFrame, b_clock: DataFrame) -> DataFrame:
    """Dots of two states: those both have, and those of one that the other's clock hasn't seen."""
    key = [*QUAD, *DOT]
    both = a.join(b, key, "left_semi").select(*key)

    def unseen(x: DataFrame, y: DataFrame, y_clock: DataFrame) -> DataFrame:
        only = x.join(y, key, "left_anti").join(y_clock.withColumnRenamed("counter", "seen"), ["g", "actor"], "left")
        return only.where("seen IS NULL OR counter > seen").select(*key)

    return both.unionByName(unseen(a, b, b_clock)).unionByName(unseen(b, a, a_clock))


def missing(batches: DataFrame, clock_: DataFrame) -> DataFrame:
    """(g, batch, actor, from, to): dots that a batch's base clock names and the state hasn't seen. Such a batch is refused."""
    named = batches.select("g", "batch", F.explode("base").alias("actor", "need"))
    seen = named.join(clock_, ["g", "actor"], "left").withColumn("have", F.coalesce("counter", F.lit(0).cast("long")))
    return seen.where("need > have").select("g", "batch", "actor", (F.col("have") + 1).alias("from"), F.col("need").alias("to"))


def without_deleted(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of graphs that are not deleted: a deletion outlasts all later writes."""
    return rows.join(tombstones.select("g").distinct(), "g", "left_anti")


def register(writes: DataFrame, key: str = "g", value: str = "value", tag: str = "tag") -> DataFrame:
    """The value with the highest tag of each key."""
    return writes.groupBy(key).agg(F.max_by(value, tag).alias(value), F.max(tag).alias(tag))


def fingerprint(quads: DataFrame) -> DataFrame:
    """(g, n, digest): equal for equal live states, in any order. The digest is the exclusive or of the quads' hashes."""
    h = F.xxhash64(*QUAD)
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("digest"))


# --- history: operations with parents


def heads(ops: DataFrame) -> DataFrame:
    """Operations that no other names as its parent. Columns id and parents (array of ids) are needed."""
    return ops.join(ops.select("g", F.explode("parents").alias("id")).distinct(), ["g", "id"], "left_anti")


def log(ops: DataFrame, graph: str, limit: int | None = None) -> DataFrame:
    """Operations of a graph, newest first."""
    out = ops.where(F.col("g") == graph).orderBy(F.desc("at"), F.desc("id"))
    return out.limit(limit) if limit is not None else out


def ancestors(ops: DataFrame, at: DataFrame) -> DataFrame:
    """(g, id) of some operations and all before them."""
    from ..session import written

    edges = written(ops.select("g", "id", F.explode("parents").alias("parent")))
    found = frontier = written(at.select("g", "id").distinct())
    while True:
        step = frontier.join(edges, ["g", "id"]).select("g", F.col("parent").alias("id")).distinct()
        frontier = written(step.join(found, ["g", "id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier))


def project(ops: DataFrame, at: DataFrame) -> DataFrame:
    """The live quads as of some heads."""
    return live(dots(ops.join(ancestors(ops, at), ["g", "id"], "left_semi")))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes (op, g, s, p, o) from one state to another."""
    gone = before.select(*QUAD).join(after, QUAD, "left_anti")
    new = after.select(*QUAD).join(before, QUAD, "left_anti")
    return gone.select(F.lit("delete").alias("op"), *QUAD).unionByName(new.select(F.lit("insert").alias("op"), *QUAD))


def restore(ops: DataFrame, at: DataFrame) -> DataFrame:
    """Changes that bring the present state back to that of some heads, to be written as new operations."""
    return compare(live(dots(ops)), project(ops, at))
