"""Secret scans: assignment-aware lexing of source and configuration text.

Fixed patterns (`assign`, `access`, `hex`) come first. Then statements are read as name-literal pairs: `name = expr`,
`name: expr`, `"name": expr`, `name := expr`, `name => expr`, `<name>text</name>` and `--name value`. An expression
is a chain of string literals, bare words and names joined by `+`, `.` or (literals only) nothing; it goes on across
newlines inside brackets and at an operator, and YAML values may stand on deeper lines below their name. Names bound
earlier in the text are replaced by the literals they stand for (constant propagation), so a key built from parts, or assigned through another
name, is found where its literals stand. A literal is scored by how sensitive its target's name is and how much it
looks like a credential; those of at least `THRESHOLD` give spans of kind `literal`.

Positions are code points, ends exclusive. Null text counts as empty; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, map_batches, release

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the match of [0-9a-f]+ that starts it
THRESHOLD = 0.5

_HEX_MAP = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
_BASE_MARKS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_STRONG = {"password", "passwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "pwd", "privatekey", "accesskey", "secretkey", "authkey", "signingkey", "encryptionkey"}
_WEAK = {"key", "auth", "authorization", "pass", "pin", "signature", "salt", "bearer", "cookie"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|change.?me|example.*|placeholder.*|your[-_ ].*|todo|none|null|nil|true|false|undefined|redacted|test|dummy|<.*>|\$\{?.*\}?|%\(?.*|\{\{.*)$")
_TOKEN = re.compile(
    r"""(?P<tag><(?P<tagname>[A-Za-z_][\w.-]+)>(?P<tagtext>[^<>]+)</(?P=tagname)>)"""
    r"""|(?P<flag>--?(?P<flagname>[A-Za-z][\w-]{2,}+)[= ](?P<flagtext>[^\s"'`,;]{6,}+))"""
    r'|"""(?P<tdq>(?:[^"\\]|\\[\s\S]|"(?!""))*+)"""' r"|'''(?P<tsq>(?:[^'\\]|\\[\s\S]|'(?!''))*+)'''"
    r"""|"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>[^`\n]*+)`"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|[=:+.,;(){}\[\]])|(?P<nl>\n)|(?P<bare>[^\s"'`,;(){}\[\]=:+.]+)""",
    re.ASCII,
)
_APART = "[^A-Za-z0-9]*+"  # name_weight joins up to three parts for strong names; weak ones are a part by themselves
_NAME_MARKS = re.compile("|".join(
    [f"(?i:{_APART.join(w)})" for w in sorted(_STRONG)] + [f"(?:(?<![a-z]){w[0]}|{w[0].upper()}){w[1:]}(?![a-z])|(?<![A-Z]){w.upper()}(?![a-z])" for w in sorted(_WEAK)]
), re.ASCII)
_BINDS = {"=", ":", ":=", "=>"}
_QUOTED = ("dq", "sq", "bq", "tdq", "tsq")
_IDLE = re.compile(r"""(?:(?:[^\n=:<"'-]++|"(?!"")|'(?!''))*+\n)*+""")  # lines in which no pair and no triple quote begins
_MARGIN = re.compile(r"[^\S\n]*+")
_LEADING = re.compile(r"\s*+([+.])(?=\s*+[\"'`A-Za-z_$(])")
_BLOCK = re.compile(r"[|>][+-]?\d?")  # YAML's block scalars
_MAPPING = re.compile(r"[\w.-]+=[^=\s]")
_TRIPLE = re.compile(r'(?<=""")[\s\S]*?(?=""")' r"|(?<=''')[\s\S]*?(?=''')")
_OPEN = re.compile(r"([^\n;, (]*+)(?:[^\S\n]*+(?=[\n;,]|\Z)|(?=\x20++(?:#|//)))")  # without spaces and calls
_VALUE_END = re.compile(r"[\n;,]|\x20#|\x20//")


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the fixed patterns."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(m in low for m in _BASE_MARKS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in raw.translate(_HEX_MAP):
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def name_weight(name: str) -> float:
    """1 for names of credentials, 0.6 for names that only suggest one, else 0."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    joined = ["".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(len(parts), i + 3) + 1)]
    if any(p in _STRONG for p in joined):
        return 1.0
    return 0.6 if any(p in _WEAK for p in parts) else 0.0


def literal_weight(value: str) -> float:
    """0 to 1: length, variety of characters, and not a placeholder or a sentence."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or value.count(" ") > 1:
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9\s]"))
    return min(1.0, 0.25 + 0.15 * entropy + 0.12 * (classes - 1)) if entropy > 1.5 else 0.0


def literal_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Spans of literals that reach a sensitive name, by lexing the text and keeping all constants bound so far."""
    found: set[tuple[int, int]] = set()
    known: dict[str, list[tuple[str, int, int]]] = {}

    def judge(name: str, parts: list[tuple[str, int, int]]) -> None:
        weight = name_weight(name)
        if weight and parts and weight * literal_weight("".join(p[0] for p in parts)) >= THRESHOLD:
            found.update((s, e) for _, s, e in parts if e > s)

    def binds(at: int, stop: int) -> bool:
        t = _TOKEN.search(text, at, stop)
        return t is not None and t["op"] in _BINDS

    def indented(name_at: int, at: int, stop: int) -> list[tuple[str, int, int]]:
        """YAML: the lines from `at` that stand deeper than the name's line, up to the first that is no plain value."""
        margin = lambda x: len(_MARGIN.match(text, x)[0])
        least, parts = margin(text.rfind("\n", 0, name_at) + 1), []
        while at < stop:
            end = text.find("\n", at, stop)
            end = stop if end < 0 else end
            begin = at + margin(at)
            cut = _VALUE_END.search(text, begin, end)
            value = text[begin : cut.start() if cut else end].rstrip()
            if value:
                if begin - at <= least or " " in value or "(" in value or value[0] in "\"'`#[{<&*!" or value.endswith(":") or _MAPPING.match(value):
                    break
                parts.append((value, begin, begin + len(value)))
            at = end + 1
        return parts

    def expression(name_at: int, op: re.Match, stop: int) -> tuple[list[tuple[str, int, int]], int]:
        """The literals of the expression after op, and where to go on: after it, or after its first token."""
        parts: list[tuple[str, int, int]] = []
        at = go_on = op.end()
        depth, need, crossed, first = 0, True, False, True
        while (t := _TOKEN.search(text, at, stop)) is not None:
            kind, at = t.lastgroup, t.end()
            if kind == "nl":
                if depth or need:
                    crossed = True
                    continue
                ahead = _LEADING.match(text, t.start(), stop)  # an operator may open the next line
                if ahead is None:
                    break
                at, crossed = ahead.start(1), True
            elif t["op"] == "(" and need:
                depth += 1
            elif t["op"] == ")" and depth and not need:
                depth, go_on = depth - 1, at
            elif t["op"] in ("+", ".") and not need:
                need = True
            elif t["bare"] == "\\" and text.startswith("\n", at) and not first:
                at, crossed = at + 1, True
            elif kind in _QUOTED:
                if (crossed or not need) and binds(at, stop) or (kind in ("tdq", "tsq") and first and crossed and op["op"] == ":"):
                    break  # the name of the next pair, or a docstring
                parts.append((t[kind], t.start(kind), t.end(kind)))
                need, go_on = False, at
            elif need and t["name"] in known and not (crossed and binds(at, stop)):
                parts += known[t["name"]]
                need, go_on = False, at
            elif first and not depth and kind in ("name", "bare"):
                go_on = at
                if crossed:
                    if op["op"] == ":":
                        parts = indented(name_at, text.rfind("\n", 0, t.start()) + 1, stop)
                    go_on = op.end()
                    break
                begin = t.start()  # an unquoted value runs to the end of its statement
                end = _OPEN.match(text, begin, stop)
                value = end[1].rstrip() if end else ""
                if op["op"] == ":" and _BLOCK.fullmatch(value):
                    line = text.find("\n", begin, stop)
                    parts = indented(name_at, line + 1, stop) if line >= 0 else []
                elif end:
                    parts = [(value, begin, begin + len(value))]
                break
            else:
                break
            if kind != "nl" and t["op"] != "(":
                first = False
        return parts, go_on

    todo = [(0, len(text))]
    while todo:
        at, stop = todo.pop()
        line_starts = True
        while True:
            if line_starts:
                at = _IDLE.match(text, at, stop).end()
            m = _TOKEN.search(text, at, stop)
            if m is None:
                break
            kind, at = m.lastgroup, m.end()
            line_starts = kind == "nl"
            if kind == "tag":
                inner, begin = m["tagtext"], m.start("tagtext")
                if "\n" in inner:  # lines inside may be statements themselves
                    todo.append((begin, m.end("tagtext")))
                    begin, inner = begin + len(inner) - len(inner.lstrip()), inner.strip()
                judge(m["tagname"], [(inner, begin, begin + len(inner))])
            elif kind == "flag":
                judge(m["flagname"], [(m["flagtext"], m.start("flagtext"), m.end("flagtext"))])
            elif kind in ("tdq", "tsq"):
                todo.append(m.span(kind))
            elif kind in ("name", "dq", "sq") and m[kind]:
                nxt = _MARGIN.match(text, at, stop).end()
                if nxt >= stop or text[nxt] not in "=:\"'`":
                    continue
                op = _TOKEN.search(text, nxt, stop)
                if op is None or op["op"] not in _BINDS:
                    continue
                parts, at = expression(m.start(), op, stop)
                for p in _TRIPLE.finditer(text, op.end(), at):
                    todo.append(p.span())
                if parts:
                    known[m[kind]] = parts
                    judge(m[kind].rpartition(".")[2] if kind == "name" else m[kind], parts)
    return [("literal", s, e, s) for s, e in sorted(found)]


def secret_spans(text: str | None) -> tuple[list[tuple[str, int, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    # a name that name_weight scores has a mark, so nothing that judge would take is refused here
    more = literal_spans(text) if (b"=" in raw or b":" in raw or b"</" in raw or b"-" in raw) and _NAME_MARKS.search(text) else []
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def render(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def redact(text: str, spans: list[tuple[str, int, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every secret (not the name it is assigned to) replaced by `mark`; overlapping ones by one mark."""
    out, at = [], 0
    for start, end in merged((s, e) for _, _, e, s in spans):
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def merged(spans) -> list[tuple[int, int]]:
    """Unions of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the fixed patterns, their digest, and all spans as kind:start:end.

    Null and empty texts have no spans; repeated rows give equal rows; null ids stay null; spans that start together come
    in the order of their kinds; an empty table gives no rows; other columns, of whatever names, are not read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = [secret_spans(t) for t in batch.column(1).to_pylist()]
        counts = [Counter(k for k, *_ in base) for base, _ in rows]
        return {
            "doc_id": batch.column(0),
            **{f"n_{k}": [c[k] for c in counts] for k in KINDS[:3]},
            "n_literal": [len(every) - len(base) for base, every in rows],
            "base_sha256": [hashlib.sha256(render(base).encode()).hexdigest() for base, _ in rows],
            "spans": [render(every) for _, every in rows],
        }

    columns = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(columns, run, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with the secrets of the text column replaced; rows without any stay as they are.

    Null texts stay null; repeated rows and null ids keep a row each; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redact(t, spans) if (spans := secret_spans(t)[1]) else t for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, type=batch.column(at).type))

    return bounded(docs).mapInArrow(run, docs.schema)
