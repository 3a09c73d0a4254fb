"""Full-text search over the texts of resources: BM25, prefixes, complete matches, and the search SERVICE of queries.

A search is one pass over the texts for the statistics of its few words, and one for the scores; neither explodes nor
shuffles the texts. The stable order of equal scores is graph, then subject.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans import algebra as A
from ..plans.compiler import Rel, col_of
from ..plans.parser import SparqlError
from ..session import written

PREDICATES = [f"<{scheme}://schema.org/{name}>" for scheme in ("http", "https") for name in ("name", "description", "keywords", "identifier")]
K1, B = 1.2, 0.75
MAX_TOKEN_BYTES = 40
MIN_PREFIX = 3
DEFAULT_LIMIT, MAX_LIMIT = 20, 10_000
NS = "urn:quadsmith:fts#"
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
_FROM, _TO = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"


def analyzed(text: Column) -> Column:
    """Tokens: lower-cased, folded to ASCII, split at all but letters and digits, without those of over 40 bytes."""
    low = F.translate(F.lower(text), _FROM, _TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def words_of(query: str) -> list[str]:
    """The words of a query, as tokens; operators and AND, OR, NOT go."""
    found = [w for w in re.split(r"[^\w]+", query.replace("_", " ")) if w and w not in ("AND", "OR", "NOT")]
    folded = [w.lower().translate(_FOLD).replace("ß", "ss").replace("æ", "ae").replace("œ", "oe") for w in found]
    return list(dict.fromkeys(w for w in folded if len(w.encode()) <= MAX_TOKEN_BYTES))


class TextSearch:
    """Search over rows (g, s, text)."""

    def __init__(self, spark: SparkSession, texts: DataFrame):
        self.spark, self.texts = spark, texts.select("g", "s", "text")

    @staticmethod
    def of_quads(spark: SparkSession, quads: DataFrame, predicates: list[str] = PREDICATES) -> "TextSearch":
        """One text for each graph and subject: its names, descriptions, keywords and identifiers. Visible quads only, if those are given."""
        rows = quads.where(F.col("p").isin(predicates)).select("g", "s", T.lex(F.col("o")).alias("t")).where("t IS NOT NULL")
        return TextSearch(spark, rows.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("text")))

    def postings(self) -> DataFrame:
        """(term, g, s, tf, dl): the index as a table, to be written partitioned as one likes.

        A text is counted where it is read: its tokens are sorted, and a term is a run of equal ones. Only where a
        resource has several texts are rows put together.
        """
        rows = self.texts.select("g", "s", F.sort_array(analyzed(F.col("text"))).alias("tokens"))
        first = lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1))
        starts = F.when(F.size("tokens") > 0, F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), first))
        rows = rows.select("g", "s", "tokens", F.size("tokens").alias("dl"), starts.alias("starts"))
        run = lambda start, i: F.struct(F.get("tokens", start).alias("term"), (F.coalesce(F.get("starts", i + 1), F.col("dl")) - start).cast("long").alias("tf"))
        out = rows.select("g", "s", "dl", F.explode(F.transform("starts", run)).alias("run")).select("run.term", "g", "s", "dl", "run.tf")
        if self.texts.groupBy("g", "s").count().where("count > 1").isEmpty():
            return out
        return out.groupBy("term", "g", "s", "dl").agg(F.sum("tf").alias("tf"))

    def _counted(self, words: list[str], graphs: DataFrame | None) -> DataFrame:
        rows = self.texts if graphs is None else self.texts.join(graphs.select("g"), "g", "left_semi")
        rows = rows.select("g", "s", analyzed(F.col("text")).alias("tokens"))
        count = lambda w: F.size(F.filter("tokens", lambda t: t == w))
        begins = lambda w: F.exists("tokens", lambda t: F.startswith(t, F.lit(w)))
        tf = [count(w).alias(f"tf{i}") for i, w in enumerate(words)]
        longer = [begins(w) for w in words if len(w) >= MIN_PREFIX]
        prefix = reduce(lambda a, b: a | b, longer) if longer else F.lit(False)
        return rows.select("g", "s", F.size("tokens").alias("dl"), *tf, prefix.alias("prefix"))

    def ranked(self, query: str, limit: int | None = DEFAULT_LIMIT, graphs: DataFrame | None = None, prefixes: bool = True) -> DataFrame:
        """(g, s, score): any word matches; resources that only have longer words come last, with score 0."""
        words = words_of(query)
        if not words or limit == 0:
            return self.spark.createDataFrame([], "g string, s string, score double")
        rows = written(self._counted(words, graphs))  # read twice: for the statistics and for the scores
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
        if not stats["n"]:
            return self.spark.createDataFrame([], "g string, s string, score double")
        parts = []
        for i in range(len(words)):
            idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
            tf = F.col(f"tf{i}")
            parts.append(F.lit(idf) * (tf * (K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(stats["avg"] or 1.0))))
        score = reduce(lambda a, b: a + b, parts)
        exact = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(words))])
        hits = rows.where(exact | F.col("prefix") if prefixes else exact).select("g", "s", score.alias("score"))
        return hits.orderBy(F.desc("score"), "g", "s").limit(limit) if limit is not None else hits

    def complete(self, query: str, graphs: DataFrame | None = None) -> DataFrame:
        """(g, s) of every resource with one of the words, whole; unranked and never cut."""
        words = words_of(query)
        rows = self.texts if graphs is None else self.texts.join(graphs.select("g"), "g", "left_semi")
        if not words:
            return rows.select("g", "s").limit(0)
        return rows.where(F.arrays_overlap(analyzed(F.col("text")), F.array(*[F.lit(w) for w in words]))).select("g", "s")

    def hydrated(self, hits: DataFrame, quads: DataFrame) -> DataFrame:
        """Hits with their visible properties."""
        return hits.join(quads.select("g", "s", "p", "o"), ["g", "s"])

    def service(self, compiler, node: A.Service, graph: str | None) -> Rel:
        """`?s fts:query "words"`, with fts:limit, fts:score, fts:graph or fts:complete; with the last, scores are of all hits."""
        pattern = node.pattern
        if not isinstance(pattern, A.BGP) or len({t.s for t in pattern.triples}) != 1 or not A.is_var(pattern.triples[0].s):
            raise SparqlError("a search has one subject variable and plain patterns")
        given: dict[str, str] = {}
        for t in pattern.triples:
            name = t.p[len(NS) + 1 : -1] if isinstance(t.p, str) and t.p.startswith(f"<{NS}") else None
            if name not in ("query", "limit", "score", "graph", "complete") or name in given:
                raise SparqlError(f"no search predicate: {t.p}")
            given[name] = t.o
        if not given.get("query", "").startswith('"'):
            raise SparqlError("a search needs a literal fts:query")
        query = T.unescape(given["query"].rpartition('"')[0][1:])
        subject = pattern.triples[0].s
        graphs = compiler.graphs
        if "complete" in given:
            if given["complete"] != T.literal("true", f"{T.XSD}boolean") or "limit" in given:
                raise SparqlError("fts:complete is true, without limit")
            hits = self.ranked(query, None, graphs, prefixes=False) if "score" in given else self.complete(query, graphs)
        else:
            asked = int(given["limit"].split('"')[1]) if "limit" in given else DEFAULT_LIMIT
            limit = min(asked, MAX_LIMIT)
            hits = self.ranked(query, limit, graphs)
            if asked > MAX_LIMIT and hits.count() >= MAX_LIMIT:
                raise SparqlError(f"more than {MAX_LIMIT} hits")
        cols, sure, native = [F.col("s").alias(col_of(subject))], {subject}, {}
        if "score" in given:
            cols += [T.typed_term(F.col("score"), f"{T.XSD}double").alias(col_of(given["score"])), F.col("score").alias(f"{col_of(given['score'])}__n")]
            sure.add(given["score"])
            native[given["score"]] = ("num", 3)
        if "graph" in given:
            cols.append(F.col("g").alias(col_of(given["graph"])))
            sure.add(given["graph"])
        if graph and A.is_var(graph) and graph not in sure:
            cols.append(F.col("g").alias(col_of(graph)))
            sure.add(graph)
        rel = Rel(hits.select(*cols), frozenset(sure), native=native)
        return rel if "graph" in given or (graph and A.is_var(graph)) or "score" in given else Rel(rel.df.distinct(), rel.sure)
