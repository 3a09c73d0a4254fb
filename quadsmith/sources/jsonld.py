"""Metadata packages as JSON-LD: documents to quads and quads to documents, paged if need be.

Expansion knows the bundled contexts (the package versions' terms are schema.org's, with a few of their own), inline
context objects and @vocab; it loads nothing. Documents are expanded in Python, batch-wise; export is all DataFrame.
"""

from __future__ import annotations

import base64
import hashlib
import json
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T

MAX_BYTES = 16 << 20
MAX_DEPTH = 64
CONTEXTS = {f"https://w3id.org/ro/crate/{v}/context": v for v in ("1.1", "1.2", "1.3")}
CONFORMS = "http://purl.org/dc/terms/conformsTo"
_TERMS = {"conformsTo": CONFORMS, "File": f"{T.SCHEMA}MediaObject", "Journal": f"{T.SCHEMA}Periodical"}


class JsonLdError(ValueError):
    """A document that can't be expanded."""


def _context(node: object, terms: dict, vocab: str | None) -> tuple[dict, str | None]:
    for part in node if isinstance(node, list) else [node]:
        if part is None:
            terms, vocab = {}, None
        elif isinstance(part, str):
            if part not in CONTEXTS and not part.rstrip("/").endswith("schema.org"):
                raise JsonLdError(f"unknown context {part}")
            terms, vocab = terms | _TERMS, T.SCHEMA
        else:
            for k, v in part.items():
                if k == "@vocab":
                    vocab = v
                elif not k.startswith("@"):
                    terms = terms | {k: v if isinstance(v, dict) else {"@id": v}}
    return terms, vocab


def expand(document: str, graph: str) -> list[tuple[str, str, str]]:
    """Distinct triples of a document; relative names are resolved against the graph's IRI, blank nodes named by it."""
    if len(document.encode()) > MAX_BYTES:
        raise JsonLdError("the document is too large")
    try:
        doc = json.loads(document)
    except ValueError as e:
        raise JsonLdError(str(e)) from None
    base = graph[1:-1]
    base = base if base.endswith("/") else base + "/"
    out: dict[tuple[str, str, str], None] = {}
    fresh = [0]

    def absolute(name: str) -> str:
        if name.startswith("_:"):
            return name
        if name in (".", "./"):
            return graph
        if ":" in name.split("/")[0]:
            return f"<{name}>"
        return f"<{urljoin(base, name) if base.startswith(('http:', 'https:')) else base + name.removeprefix('./')}>"

    def key_iri(key: str, terms: dict, vocab: str | None) -> str | None:
        found = terms.get(key)
        found = found.get("@id") if isinstance(found, dict) else found
        if found:
            return key_iri(found, {}, vocab) if ":" not in found else prefixed(found, terms)
        if ":" in key:
            return prefixed(key, terms)
        return vocab + key if vocab else None

    def prefixed(name: str, terms: dict) -> str:
        head, _, tail = name.partition(":")
        known = terms.get(head)
        known = known.get("@id") if isinstance(known, dict) else known
        return known + tail if known and not tail.startswith("//") else name

    def value(v: object, kind: str | None, terms: dict, vocab: str | None, depth: int) -> list[str]:
        if depth > MAX_DEPTH:
            raise JsonLdError("nested too deeply")
        if v is None:
            return []
        if isinstance(v, list):
            return [x for y in v for x in value(y, kind, terms, vocab, depth + 1)]
        if isinstance(v, bool):
            return [T.literal("true" if v else "false", f"{T.XSD}boolean")]
        if isinstance(v, int):
            return [T.literal(str(v), f"{T.XSD}integer")]
        if isinstance(v, float):
            return [T.literal(str(int(v)), f"{T.XSD}integer") if v.is_integer() and abs(v) < 1e21 else T.literal(repr(v), f"{T.XSD}double")]
        if isinstance(v, str):
            if kind == "@id":
                return [absolute(v)]
            return [T.literal(v, prefixed(kind, terms) if kind and not kind.startswith("@") else None)]
        if "@value" in v:
            if v["@value"] is None:
                return []
            plain = value(v["@value"], None, terms, vocab, depth + 1)[0]
            text = T.unescape(plain[1 : plain.rindex('"')])
            if "@language" in v:
                return [T.literal(text, lang=v["@language"])]
            return [T.literal(text, prefixed(v["@type"], terms)) if "@type" in v else plain]
        if "@list" in v:
            items = [x for y in v["@list"] for x in value(y, kind, terms, vocab, depth + 1)]
            node = f"<{T.RDF}nil>"
            for item in reversed(items):
                fresh[0] += 1
                cell = f"_:l{fresh[0]}"
                out[cell, f"<{T.RDF}first>", item] = out[cell, f"<{T.RDF}rest>", node] = None
                node = cell
            return [node]
        return [entity(v, terms, vocab, depth + 1)]

    def entity(node: dict, terms: dict, vocab: str | None, depth: int = 0) -> str:
        if depth > MAX_DEPTH:
            raise JsonLdError("nested too deeply")
        if "@context" in node:
            terms, vocab = _context(node["@context"], terms, vocab)
        if "@id" in node:
            name = absolute(node["@id"])
        else:
            fresh[0] += 1
            name = f"_:b{fresh[0]}"
        types = node.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            iri = key_iri(t, terms, vocab)
            if iri:
                out[name, T.RDF_TYPE, f"<{iri}>"] = None
        for key, v in node.items():
            if key.startswith("@"):
                continue
            made = terms.get(key)
            kind = made.get("@type") if isinstance(made, dict) else None
            if isinstance(made, dict) and "@reverse" in made:
                for x in value(v, "@id", terms, vocab, depth + 1):
                    out[x, f"<{prefixed(made['@reverse'], terms)}>", name] = None
                continue
            p = key_iri(key, terms, vocab)
            if p:
                for x in value(v, kind, terms, vocab, depth + 1):
                    out[name, f"<{p}>", x] = None
        return name

    terms, vocab = _context(doc.get("@context"), {}, None) if isinstance(doc, dict) else ({}, None)
    nodes = doc.get("@graph", [doc]) if isinstance(doc, dict) else doc
    if not isinstance(nodes, list):
        raise JsonLdError("@graph is no list")
    for node in nodes:
        entity({k: v for k, v in node.items() if k != "@context" or node is not doc}, terms, vocab)
    return list(out)


def version_of(document: str) -> str | None:
    """The package version: its context's and its descriptor's must agree; unknown ones are None."""
    doc = json.loads(document)
    contexts = doc.get("@context")
    named = {CONTEXTS[c] for c in (contexts if isinstance(contexts, list) else [contexts]) if isinstance(c, str) and c in CONTEXTS}
    said = set()
    for node in doc.get("@graph", []):
        if str(node.get("@id", "")).endswith("ro-crate-metadata.json"):
            links = node.get("conformsTo", [])
            said |= {x["@id"].rstrip("/").rpartition("/")[2] for x in (links if isinstance(links, list) else [links]) if isinstance(x, dict) and "ro/crate/" in x.get("@id", "")}
    if named and said and named != said:
        raise JsonLdError(f"the context says {sorted(named)}, the descriptor {sorted(said)}")
    found = (named or said) & set(CONTEXTS.values())
    return found.pop() if len(found) == 1 else None


def read_documents(documents: DataFrame) -> DataFrame:
    """Rows (g, document) to quads."""

    def run(frames):
        for frame in frames:
            rows = [(g, s if not s.startswith("_:") else f"{s}{hashlib.md5(g.encode()).hexdigest()[:8]}", p, o if not o.startswith("_:") else f"{o}{hashlib.md5(g.encode()).hexdigest()[:8]}") for g, d in zip(frame["g"], frame["document"]) for s, p, o in expand(d, g)]
            yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    return documents.select("g", "document").mapInPandas(run, "g string, s string, p string, o string")


def entities_json(quads: DataFrame) -> DataFrame:
    """(g, s, node): each subject as a JSON object of arrays, in expanded form, keys and values in order."""
    o = F.col("o")
    value = (
        F.when(~T.is_literal(o), F.to_json(F.struct(F.coalesce(T.iri_text(o), o).alias("@id"))))
        .when(T.lang(o) != "", F.to_json(F.struct(T.lang(o).alias("@language"), T.lex(o).alias("@value"))))
        .when(T.suffix(o) == "", F.to_json(F.struct(T.lex(o).alias("@value"))))
        .otherwise(F.to_json(F.struct(T.datatype(o).alias("@type"), T.lex(o).alias("@value"))))
    )
    is_type = F.col("p") == T.RDF_TYPE
    name = lambda c: F.to_json(F.array(c))
    key = F.when(is_type, F.lit('"@type"')).otherwise(F.regexp_replace(name(T.iri_text(F.col("p"))), r"^\[|\]$", ""))
    item = F.when(is_type, F.regexp_replace(name(T.iri_text(o)), r"^\[|\]$", "")).otherwise(value)
    members = quads.select("g", "s", key.alias("k"), item.alias("v")).distinct().groupBy("g", "s", "k").agg(F.concat(F.col("k"), F.lit(":["), F.array_join(F.array_sort(F.collect_list("v")), ","), F.lit("]")).alias("m"))
    own = F.regexp_replace(name(F.coalesce(T.iri_text(F.col("s")), F.col("s"))), r"^\[|\]$", "")
    return members.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("body")).select("g", "s", F.concat(F.lit('{"@id":'), own, F.lit(","), F.col("body"), F.lit("}")).alias("node"))


def write_documents(quads: DataFrame) -> DataFrame:
    """(g, document): whole packages as expanded JSON-LD."""
    return entities_json(quads).groupBy("g").agg(F.concat(F.lit('{"@graph":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "node"))), lambda x: x["node"]), ","), F.lit("]}")).alias("document"))


def summary(quads: DataFrame) -> DataFrame:
    """(g, document) with only the root and the descriptor."""
    return write_documents(quads.where((F.col("s") == F.col("g")) | F.endswith("s", F.lit("ro-crate-metadata.json>"))))


def page(quads: DataFrame, graph: str, offset: int, size: int) -> tuple[DataFrame, int, int | None]:
    """Nodes of the root's parts in order of name: a page, how many there are, and the next offset."""
    links = quads.where((F.col("g") == graph) & (F.col("s") == graph) & (F.col("p") == f"<{T.SCHEMA}hasPart>")).select(F.col("o").alias("s")).distinct()
    total = links.count()
    names = links.orderBy("s").offset(offset).limit(size)
    rows = entities_json(quads.where(F.col("g") == graph).join(names, "s", "left_semi"))
    return rows, total, offset + size if offset + size < total else None


def page_after(quads: DataFrame, graph: str, cursor: str | None, size: int, version: str = "") -> tuple[DataFrame, str | None]:
    """A page after a cursor, and the next cursor: bound to the graph and a version of it, and checked."""
    last = ""
    if cursor is not None:
        try:
            g, v, last, check = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError:
            raise JsonLdError("no cursor") from None
        if (g, v) != (graph, version) or check != hashlib.sha256(f"{g}|{v}|{last}".encode()).hexdigest()[:16]:
            raise JsonLdError("the cursor is of another graph, or stale")
    links = quads.where((F.col("g") == graph) & (F.col("s") == graph) & (F.col("p") == f"<{T.SCHEMA}hasPart>") & (F.col("o") > last)).select(F.col("o").alias("s")).distinct()
    names = [r["s"] for r in links.orderBy("s").limit(size + 1).collect()]  # one page
    rows = entities_json(quads.where((F.col("g") == graph) & F.col("s").isin(names[:size])))
    if len(names) <= size:
        return rows, None
    last = names[size - 1]
    return rows, base64.urlsafe_b64encode(json.dumps([graph, version, last, hashlib.sha256(f"{graph}|{version}|{last}".encode()).hexdigest()[:16]]).encode()).decode()
