"""The algebra of graph patterns, queries and updates."""

from __future__ import annotations

from dataclasses import dataclass

# Terms of patterns are strings: canonical terms, or variables with a leading "?". Blank nodes of patterns are
# variables with a leading "?_:" and never projected.


def is_var(x: object) -> bool:
    return isinstance(x, str) and x[:1] == "?"


# --- paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    left: object
    right: object


@dataclass(frozen=True)
class Alt:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    path: object
    kind: str  # ? * +


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


# --- expressions


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    term: str


@dataclass(frozen=True)
class Call:
    """Operators and functions by upper-case name; casts by the IRI."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None  # None: *
    distinct: bool = False
    separator: str = " "


# --- patterns


@dataclass(frozen=True)
class Triple:
    s: str
    p: object  # a term, a variable or a path
    o: str


@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object | None = None


@dataclass(frozen=True)
class Lateral:
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    condition: object
    pattern: object


@dataclass(frozen=True)
class Extend:
    pattern: object
    var: str
    expr: object


@dataclass(frozen=True)
class Graph:
    name: str
    pattern: object


@dataclass(frozen=True)
class Service:
    name: str
    pattern: object
    silent: bool = False


@dataclass(frozen=True)
class Values:
    vars: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Group:
    pattern: object
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class OrderBy:
    pattern: object
    keys: tuple[tuple[object, bool], ...]  # expression, ascending


@dataclass(frozen=True)
class Project:
    pattern: object
    vars: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    pattern: object


@dataclass(frozen=True)
class Reduced:
    pattern: object


@dataclass(frozen=True)
class Slice:
    pattern: object
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Query:
    """form: SELECT, ASK, CONSTRUCT or DESCRIBE."""

    form: str
    pattern: object
    vars: tuple[str, ...] = ()
    template: tuple[Triple, ...] = ()
    targets: tuple[str, ...] = ()
    from_default: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()


@dataclass(frozen=True)
class Update:
    """kind: INSERT DATA, DELETE DATA, MODIFY, CLEAR, DROP, CREATE or LOAD. Quads are (graph, s, p, o)."""

    kind: str
    insert: tuple = ()
    delete: tuple = ()
    pattern: object | None = None
    target: str = ""
    using: tuple[str, ...] = ()
    using_named: tuple[str, ...] = ()
    silent: bool = False


def children(node: object) -> list:
    """Sub-patterns of a pattern."""
    return [getattr(node, k) for k in ("left", "right", "pattern") if hasattr(node, k)]


def expr_vars(e: object) -> set[str]:
    """Variables an expression reads, those of EXISTS patterns included."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*(expr_vars(a) for a in e.args)) if e.args else set()
    if isinstance(e, Aggregate):
        return expr_vars(e.arg) if e.arg is not None else set()
    if isinstance(e, Exists):
        return pattern_vars(e.pattern)
    return set()


def pattern_vars(node: object) -> set[str]:
    """Variables in scope after a pattern."""
    if isinstance(node, BGP):
        return {x for t in node.triples for x in (t.s, t.p, t.o) if is_var(x)}
    if isinstance(node, Triple):
        return {x for x in (node.s, node.p, node.o) if is_var(x)}
    if isinstance(node, Values):
        return set(node.vars)
    if isinstance(node, Project):
        return set(node.vars)
    if isinstance(node, Group):
        return set(node.keys) | {v for v, _ in node.aggregates}
    if isinstance(node, Extend):
        return pattern_vars(node.pattern) | {node.var}
    if isinstance(node, (Graph, Service)):
        return pattern_vars(node.pattern) | ({node.name} if is_var(node.name) else set())
    if isinstance(node, Minus):
        return pattern_vars(node.left)
    return set().union(*(pattern_vars(c) for c in children(node))) if children(node) else set()


def expr_aggregates(e: object) -> list[Aggregate]:
    if isinstance(e, Aggregate):
        return [e]
    return [a for x in e.args for a in expr_aggregates(x)] if isinstance(e, Call) else []


UNIT = Values((), ((),))
