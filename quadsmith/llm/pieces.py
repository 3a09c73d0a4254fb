"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units: a run of the meta-symbol for spaces with what follows it, and at each change between ASCII
signs and other characters where no piece of the model goes across one. No piece crosses such a cut, so units are
encoded by themselves. Units that are not frequent (below) are cut once more, between any two characters that stand side by
side in no piece: what is shuffled and folded are these parts, many of which different units share, and a unit's ids are
those of its parts in a row. Every substring of a unit (or part) no longer than the longest piece is exploded and equi-joined to the
piece table (a broadcast bounded by the vocabulary) by a 64-bit hash, and compared; the edges found are grouped by unit, and a Spark higher-order
`aggregate` folds each unit's edges into its pieces:

- unigram models: Viterbi. The state is the best way to every place so far; edges come in order of their ends.
- BPE models: the model's own rule isn't a best path, so a Viterbi fold can't give the model's results. The same lattice
  is folded by merges: edges come in order of their scores, the state is the set of bounds between symbols (a bit each),
  and an edge whose bounds stand with just one between them takes that one away. That is the model's rule wherever the
  merges that make a piece have falling scores, which is tested for every piece; units that hold another piece (runs of
  spaces) are folded by the best pair of each step.

A character in no piece becomes its UTF-8 bytes' pieces. Each different unit of a batch of texts is sent once: frequent
ones (at most `HEAD`, of at most `HEAD_CHARS` characters, from one of `HEAD_SHARE` texts; the choice changes nothing but
the time) are encoded once and kept by all workers, parts of others are shuffled by part, encoded once each where they meet,
and given back to their batches, which keep their texts as numbers of units, and units as numbers of parts. What a task gives back to the batches of one
task travels as one message.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import ragged
from .batches import ROW_BITS, Store
from .common import LISTS_BY_SORT, SHUFFLES_DELETED, TOKENIZERS, bounded, give_back, map_batches, release, settings, shared_dir, tokenizer_file, trim, written

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
HEAD = 450_000
HEAD_SHARE = 4
HEAD_CHARS = 32
COUNTED = 300_000  # different units that a task counts at once
CODE_BYTES = 8 << 20
BUNDLED = 300_000  # units whose ids a task bundles at once
TASK_UNITS = 50_000  # of which each has some tens of edges, which one task sorts in memory
PAIR_BITS = 20  # a table of pairs of characters has so many places
BITS = 61  # characters of a unit whose bounds fit into one long
_SIGNS = r"\x00-@\[-`{-\x7f"
_WHOLE = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
_PARTS = f"{SPACE}*[^{SPACE}{_SIGNS}]+|{SPACE}*[{_SIGNS}]+|{SPACE}+"
_KIND = "pieces"
_U = np.uint64


def unmergeable(rows: list[tuple[str, int, float]]) -> set[str]:
    """Pieces that merging in the order of (cost, place) may miss: of a score that others have too, or made in another order."""
    cost = {p: -s for p, _, s in rows}
    shared = Counter(cost.values())
    out = set()
    for piece in cost:
        if len(piece) == 1:
            continue
        if shared[cost[piece]] > 1:
            out.add(piece)
            continue
        symbols, at, last = list(piece), list(range(len(piece))), (-float("inf"), 0)
        while len(symbols) > 1:
            found = [(cost[x], at[i], i) for i in range(len(symbols) - 1) if (x := symbols[i] + symbols[i + 1]) in cost]
            if not found:
                break
            *best, i = min(found)
            if tuple(best) <= last:
                out.add(piece)
                break
            last = tuple(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del at[i + 1]
    return out


class PieceTable:
    """The pieces of a model file: rows (piece, id, score), the ids of bytes, and the rule its kind asks for."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.rows = [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.rows):
            raise ValueError("pieces that go on past a space are not supported")
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.first_byte = self.bytes[0]
        if any(self.bytes[b] != self.first_byte + b for b in range(256)):
            raise ValueError("bytes' pieces must stand in a row")
        self.rule = "unigram" if proto.trainer_spec.model_type == 1 else "bpe"
        sign = re.compile(f"[{_SIGNS}]")
        mixed = any(SPACE not in (a, b) and bool(sign.match(a)) != bool(sign.match(b)) for p, _, _ in self.rows for a, b in zip(p, p[1:]))
        self.pattern = _WHOLE if mixed else _PARTS
        pairs = sorted({p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)})
        self.pairs = np.array([[ord(a), ord(b)] for a, b in pairs], np.uint32).reshape(-1, 2)
        ids = {p: i for p, i, _ in self.rows}
        self.ascii = [ids.get(chr(b), self.bytes[b]) for b in range(128)]
        self.odd = sorted(unmergeable(self.rows)) if self.rule == "bpe" else []

    def table(self, spark: SparkSession) -> DataFrame:
        """code: rank of the score, then the id, above 12 free bits."""
        rank = {s: k for k, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        return spark.createDataFrame([(p, i, s, rank[s] << 32 | i << 12) for p, i, s in self.rows], "piece string, id int, score double, code long")

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, meta-symbols as spaces, and where each id's begin."""
        text = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.rows} | {i: bytes([b]) for b, i in self.bytes.items()}
        parts = [text.get(i, b"") for i in range(max(text) + 1)]
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def units_of(text: Column, pattern: str) -> Column:
    """The units of a text, in order; none of null or empty text."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _byte_ids(char: Column, first: int) -> Column:
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), lambda i: F.conv(F.substring(code, 2 * i - 1, 2), 16, 10).cast("int") + first)


def _char_ids(char: Column, pieces: PieceTable) -> Column:
    """The ids of a character that no edge of the lattice stands for: an ASCII one, or one in no piece."""
    return F.when(F.octet_length(char) == 1, F.array(F.get(F.array(*map(F.lit, pieces.ascii)), F.ascii(char)))).otherwise(_byte_ids(char, pieces.first_byte))


def _viterbi(edges: Column) -> Column:
    """The best way to every place of a unit: structs (score, start, piece, id); edges are (stop, start, piece, id, score)."""
    way = "array<struct<score:double,start:int,piece:string,id:int>>"
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit("").alias("piece"), F.lit(-1).alias("id"))).cast(way)

    def step(best: Column, e: Column) -> Column:
        new = F.struct((best[e["start"]]["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["piece"].alias("piece"), e["id"].alias("id"))
        return _let(
            new,
            lambda n: F.when(F.size(best) == e["stop"], F.concat(best, F.array(n)))
            .when(n["score"] > F.element_at(best, -1)["score"], F.concat(F.slice(best, 1, e["stop"]), F.array(n)))
            .otherwise(best)
            .cast(way),
        )

    return F.aggregate(F.array_sort(edges), origin, step)


def _walk_back(best: Column) -> Column:
    """The pieces on the way to the last place."""
    path = "struct<at:int,pieces:array<struct<piece:string,id:int>>>"

    def back(state: Column, _: Column) -> Column:
        step = lambda here: F.struct(here["start"].alias("at"), F.concat(F.array(F.struct(here["piece"].alias("piece"), here["id"].alias("id"))), state["pieces"]).alias("pieces")).cast(path)
        return F.when(state["at"] <= 0, state).otherwise(_let(best[state["at"]], step))

    start = F.struct((F.size(best) - 1).alias("at"), F.array().alias("pieces")).cast(path)
    return F.aggregate(F.sequence(F.lit(1), F.size(best)), start, back)["pieces"]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _bounds(chars: Column, keys: Column) -> Column:
    """The bounds left by merging: a bit for each. keys: sorted codes with an edge's start and stop in the lowest 12 bits."""

    def step(bounds: Column, key: Column) -> Column:
        ends, inner = _edge(key)
        return F.when((bounds.bitwiseAND(ends) == ends) & (F.bit_count(bounds.bitwiseAND(inner)) == 1), bounds.bitwiseAND(F.bitwise_not(inner))).otherwise(bounds)

    return F.aggregate(keys, F.call_function("shiftleft", _long(2), chars) - 1, step)


def _edge(key: Column) -> tuple[Column, Column]:
    """The bits of an edge's ends, and those between them."""
    start, stop = F.shiftright(key, 6).bitwiseAND(_long(63)).cast("int"), key.bitwiseAND(_long(63)).cast("int")
    left, right = F.call_function("shiftleft", _long(1), start), F.call_function("shiftleft", _long(1), stop)
    return left.bitwiseOR(right), right - left * 2


def _pieces_between(unit: Column, bounds: Column, keys: Column, pieces: PieceTable) -> Column:
    """The ids of the symbols between the bounds; a character without edge gives its own ids."""

    def whole(key: Column) -> Column:
        ends, inner = _edge(key)
        return (bounds.bitwiseAND(ends) == ends) & (bounds.bitwiseAND(inner) == 0)

    starts_and_ids = lambda key: F.shiftright(key, 6).bitwiseAND(_long(63)) * (1 << 20) + F.shiftright(key, 12).bitwiseAND(_long((1 << 20) - 1))
    found = F.array_sort(F.transform(F.filter(keys, whole), starts_and_ids))
    ids = lambda xs: F.transform(xs, lambda x: x.bitwiseAND(_long((1 << 20) - 1)).cast("int"))

    def mended(have: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.length(unit) - 1), lambda i: F.call_function("shiftright", bounds, i).bitwiseAND(_long(1)) == 1)
        own = lambda i: F.filter(have, lambda x: F.shiftright(x, 20) == i.cast("long"))
        return F.flatten(F.transform(at, lambda i: _let(own(i), lambda x: F.when(F.size(x) > 0, ids(x)).otherwise(_char_ids(F.substr(unit, i + 1, F.lit(1)), pieces)))))

    return _let(found, lambda x: F.when(F.size(x) == F.bit_count(bounds) - 1, ids(x)).otherwise(mended(x)))


def _drop_bound(bounds: Column, e: Column) -> Column:
    """bounds without the one inside edge e, if e's ends stand with just that between them."""
    join = lambda i: F.when((i > 0) & (F.get(bounds, i + 1) == e["stop"]), F.concat(F.slice(bounds, 1, i), F.slice(bounds, i + 2, F.size(bounds)))).otherwise(bounds)
    return _let(F.array_position(bounds, e["start"]).cast("int"), join)


def _long_unit(unit: Column, edges: Column, best_first: Column, pieces: PieceTable) -> Column:
    """The ids of a unit of any length: the state is the array of bounds; edges are sorted (rank, start, stop, id).

    Edges are folded once in their order, or (best_first) by the best that fits, as often as there are characters.
    """
    spans = lambda bounds, e, n: _let(F.array_position(bounds, e["start"]).cast("int"), lambda i: (i > 0) & (F.get(bounds, i + n - 1) == e["stop"]))

    def best(bounds: Column, _: Column) -> Column:
        found = F.array_min(F.filter(edges, lambda e: spans(bounds, e, 2)))
        return _let(found, lambda e: F.when(e.isNull(), bounds).otherwise(_drop_bound(bounds, e)))

    def ids(bounds: Column) -> Column:
        found = F.array_sort(F.transform(F.filter(edges, lambda e: spans(bounds, e, 1)), lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id"))))

        def mended(have: Column) -> Column:
            at = F.slice(bounds, 1, F.size(bounds) - 1)
            mine = lambda i: F.filter(have, lambda x: x["start"] == i)
            return F.flatten(F.transform(at, lambda i: _let(mine(i), lambda x: F.when(F.size(x) > 0, F.transform(x, lambda y: y["id"])).otherwise(_char_ids(F.substr(unit, i + 1, F.lit(1)), pieces)))))

        return _let(found, lambda x: F.when(F.size(x) == F.size(bounds) - 1, F.transform(x, lambda y: y["id"])).otherwise(mended(x)))

    start = F.sequence(F.lit(0), F.length(unit))
    folded = F.when(best_first, F.aggregate(F.sequence(F.lit(1), F.length(unit)), start, best)).otherwise(F.aggregate(edges, start, _drop_bound))
    return _let(folded, ids)


def _lattice(units: DataFrame, pieces: PieceTable, ascii: bool = True) -> DataFrame:
    """All edges of all units: the units' columns, at (from 1), size, and the piece's; single characters in no piece too.

    Without ascii, single ASCII characters but a unit's first are left out: no merge makes them, and _char_ids knows them.
    """
    places = units.select("*", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("at"))
    parts = places.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("unit") - F.col("at") + 1))).alias("size"))
    parts = parts.select("*", F.expr("substring(unit, at, size)").alias("piece"))
    if not ascii:
        parts = parts.where("size > 1 OR at = 1 OR octet_length(piece) > 1")  # the text, made anew for this, is asked last
    parts = parts.withColumn("hash", F.xxhash64("piece"))
    table = pieces.table(units.sparkSession).select(F.xxhash64("piece").alias("key"), F.col("piece").alias("whole"), "id", "score", "code")
    # a join by one long is several times as fast as one by text; the comparison is no equality, which would be joined by
    same = (F.col("hash") == F.col("key")) & F.startswith("whole", F.col("piece")) & (F.length("whole") <= F.col("size"))
    return parts.join(F.broadcast(table), same, "left").where("id IS NOT NULL OR size = 1").drop("hash", "key", "whole")


def encode_units(units: DataFrame, pieces: PieceTable) -> DataFrame:
    """(unit) -> (unit, ids): one row each. The input's partitioning by unit is kept.

    Units are sorted first, so that their far more edges come in the order in which grouping sorts them.
    """
    units = units.sortWithinPartitions("unit")
    if pieces.rule == "unigram":
        unknown = min(s for _, _, s in pieces.rows) - 10
        edge = F.struct((F.col("at") + F.col("size") - 1).alias("stop"), (F.col("at") - 1).alias("start"), "piece", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
        grouped = _lattice(units, pieces).groupBy("unit").agg(F.collect_list(edge).alias("edges"))
        found = grouped.select("unit", _viterbi(F.col("edges")).alias("best")).select("unit", _walk_back(F.col("best")).alias("found"))
        ids = F.transform("found", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(_byte_ids(p["piece"], pieces.first_byte)))
        return found.select("unit", F.flatten(ids).alias("ids"))
    odd = F.col("unit").rlike("|".join(map(re.escape, pieces.odd))) if pieces.odd else F.lit(False)
    flagged = units.select("unit", odd.alias("odd")).withColumn("hard", F.col("odd") | (F.length("unit") > BITS))
    start, stop = F.col("at") - 1, F.col("at") + F.col("size") - 1
    key = F.when(~F.col("hard"), F.col("code") + start * 64 + stop)
    edge = F.when(F.col("hard") & F.col("id").isNotNull(), F.struct(F.shiftright("code", 32).alias("rank"), start.alias("start"), stop.alias("stop"), "id"))
    grouped = _lattice(flagged, pieces, ascii=False).groupBy("unit", "odd", "hard").agg(F.sort_array(F.collect_list(key)).alias("keys"), F.sort_array(F.collect_list(edge)).alias("edges"))
    bounded = grouped.withColumn("bounds", F.when(~F.col("hard"), _bounds(F.length("unit"), F.col("keys"))))
    easy = _pieces_between(F.col("unit"), F.col("bounds"), F.col("keys"), pieces)
    return bounded.select("unit", F.when(F.col("hard"), _long_unit(F.col("unit"), F.col("edges"), F.col("odd"), pieces)).otherwise(easy).alias("ids"))


def _planes(values: np.ndarray) -> bytes:
    """First all lowest bytes, then all second ones, and so on: what is alike stands together."""
    return values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _from_planes(raw: np.ndarray, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype)[:, 0]


def bundle(place: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Places (sorted) and the ids of each, all in a row, as one message."""
    return pa.compress(_planes(np.diff(place, prepend=0).astype(np.uint64)) + _planes(sizes.astype(np.uint32)) + _planes(ids.astype(np.uint32)), codec="zstd", asbytes=True)


def unbundle(message: pa.Scalar, n: int, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(message.as_buffer(), 12 * n + 4 * n_ids, codec="zstd"), np.uint8)
    return np.cumsum(_from_planes(raw[: 8 * n], "<u8")).astype(np.int64), _from_planes(raw[8 * n : 12 * n], "<u4").astype(np.int64), _from_planes(raw[12 * n :], "<u4").astype(np.int32)


def bundles(rows: DataFrame) -> DataFrame:
    """(place, ids) -> part, n, n_ids, data: what a task has for the batches of a part as one message, or a few."""

    def messages(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        place = np.concatenate([np.asarray(b.column(0)) for b in held])
        sizes = np.concatenate([np.asarray(b.column(1).value_lengths(), np.int64) for b in held])
        ids = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
        order = np.argsort(place)
        ids = ids[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])]
        place, sizes = place[order], sizes[order]
        part = place >> (24 + ROW_BITS)
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        at = np.append(0, np.cumsum(sizes))
        data = [bundle(place[a:z], sizes[a:z], ids[at[a] : at[z]]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(np.diff(cut)), pa.array(np.diff(at[cut])), pa.array(data, pa.binary())], names=["part", "n", "n_ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, have = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                have += batch.num_rows
            if have >= BUNDLED:
                yield messages(held)
                held, have = [], 0
        if held:
            yield messages(held)
        del held
        trim()

    return bounded(rows.select("place", "ids")).mapInArrow(run, "part long, n long, n_ids long, data binary")


class Found(Store):
    """The ids of the batches' own units, from rows (place, ids); a place is the batch, then 24 bits."""

    def __init__(self, rows: DataFrame):
        self.folder = shared_dir(rows.sparkSession)
        bundles(rows).repartition("part").sortWithinPartitions("part").write.option("compression", "uncompressed").partitionBy("part").parquet(self.folder)

    def opened(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in order, the first of each one's ids (one more than places), and all ids in a row."""
        place, sizes, ids = (np.concatenate(x) for x in zip(*(unbundle(d, n, m) for d, n, m in zip(rows.column("data"), rows.column("n").to_pylist(), rows.column("n_ids").to_pylist()))))
        order = np.argsort(place)
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        return place[order], np.append(0, np.cumsum(sizes)), ids[ragged(starts, sizes)]

    def of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit of a batch has, and all of them in a row, in the order of the units."""
        have = self.part(number >> ROW_BITS)
        if have is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        place, at, ids = have
        a, z = np.searchsorted(place, [number << 24, (number + 1) << 24])
        return np.diff(at[a : z + 1]), ids[at[a] : at[z]]


def _tasks(spark: SparkSession) -> int:
    """Tasks to encode units in; given as a number, since folding takes far longer than the bytes of units suggest."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Head:
    """Frequent units and their ids, as every worker keeps them; units are known by their keys."""

    def __init__(self, units: list[str], ids: list[list[int]], pattern: str):
        lead = len(lead_of(pattern))
        self.number = {u[lead:]: i for i, u in enumerate(units)}
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.ids = np.array([i for x in ids for i in x], np.int32)


def lead_of(pattern: str) -> str:
    """What all units begin with, which their keys leave out."""
    return SPACE if pattern == _WHOLE else ""


def keys_of(text: str, pattern: str) -> list[str]:
    """The keys of units_of(text). Where units begin at spaces alone and no space follows another, they are the words between."""
    if not text:
        return []
    if pattern == _WHOLE and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
        return text.split(" ")
    lead = len(lead_of(pattern))
    return [u[lead:] for u in re.findall(pattern, SPACE + text.replace(" ", SPACE))]


def counted(texts: DataFrame, pattern: str) -> DataFrame:
    """(text) -> unit, n: how often a task met each unit of at most HEAD_CHARS; a unit may come again after COUNTED others."""
    lead = lead_of(pattern)

    def rows(count: Counter) -> pa.RecordBatch:
        short = [(lead + u, n) for u, n in count.items() if len(lead) + len(u) <= HEAD_CHARS]
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], names=["unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(keys_of(text.as_py() or "", pattern))
                if len(count) >= COUNTED:
                    yield rows(count)
                    count = Counter()
        yield rows(count)
        del count
        trim()

    return bounded(texts).mapInArrow(run, "unit string, n long")


def head_of(docs: DataFrame, pieces: PieceTable) -> Head:
    """The most frequent units of a sample of the texts, encoded."""
    sample = counted(docs.where(F.pmod(F.xxhash64("text"), F.lit(HEAD_SHARE)) == 0).select("text"), pieces.pattern)
    common = written(sample.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "unit").limit(HEAD))
    ids = encode_units(common.select("unit").repartition(_tasks(docs.sparkSession), "unit"), pieces)
    made = ids.join(common, "unit").toArrow().sort_by([("n", "descending"), ("unit", "ascending")])  # at most HEAD rows
    return Head(made.column("unit").to_pylist(), made.column("ids").to_pylist(), pieces.pattern)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place of each pair of characters in a table of pairs; different pairs may share one."""
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)


def beside(pairs: np.ndarray) -> np.ndarray:
    """True for (at least) the pairs of characters that stand side by side in a piece."""
    table = np.zeros(1 << PAIR_BITS, dtype=bool)
    table[_pair(pairs[:, 0], pairs[:, 1])] = True
    return table


def parts_of(units: pa.Array, table: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """How many parts each unit has (none is empty, so 1 at least), and all parts in a row. Without a table a unit is its only part."""
    if table is None or not len(units):
        return np.ones(len(units), np.int64), units
    _, offsets, data = units.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(units) + 1, 4 * units.offset)
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    starts = np.flatnonzero(text & np.uint8(0xC0) != 0x80)  # bytes that begin a character
    chars = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), "<u4")
    cut = np.ones(len(chars) + 1, dtype=bool)
    cut[1:-1] = ~table[_pair(chars[:-1], chars[1:])]
    cut[np.searchsorted(starts, offsets[:-1] - offsets[0])] = True
    begin = np.append(starts, len(text))[cut].astype(np.int32)
    n = np.diff(np.searchsorted(begin, offsets - offsets[0]))
    return n, pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(text))


def coded(docs: DataFrame, pattern: str, head, size: int = CODE_BYTES, pairs: np.ndarray | None = None) -> DataFrame:
    """Write docs (doc_id, text) as batches of numbers of units: those of the head first, then the batch's own.

    A row holds about `size` bytes of text: doc_id, n_units and crc32 of every text, all numbers in a row; of every unit of
    its own how many parts it has, and the numbers of all parts in a row, in `rest`, where each is once, sorted.
    """
    lead = lead_of(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(_KIND)
        number, codes, rest, rows, have = TaskContext.get().partitionId() << ROW_BITS, [], {}, [], 0
        known = head.value.number
        base = len(known)
        table = None if pairs is None else beside(pairs)

        def row() -> pa.RecordBatch:
            nonlocal number, codes, rest, rows, have
            n_parts, parts = parts_of(pa.array([lead + u for u in rest], pa.string()), table)
            parts = parts.dictionary_encode()
            order = pa.compute.sort_indices(parts.dictionary)  # neighbours begin alike, on disk and on their way
            rank = np.empty(len(order), np.uint32)
            rank[order.to_numpy()] = np.arange(len(order))
            mine = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), parts.dictionary.take(order))
            numbers = [np.concatenate(codes), n_parts.astype(np.uint32), rank[parts.indices.to_numpy()]]
            arrays = [pa.array([number]), *(pa.array([[r[k] for r in rows]], pa.list_(pa.int64())) for k in range(3)), *(pa.array([_planes(x)], pa.binary()) for x in numbers), mine]
            number, codes, rest, rows, have = number + 1, [], {}, [], 0
            return pa.RecordBatch.from_arrays(arrays, names=["batch", "doc_id", "n_units", "crc32", "codes", "n_parts", "parts", "rest"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                raw = text.encode()
                if have and have + len(raw) > size or len(rows) >= 1 << ROW_BITS:
                    yield row()
                units = keys_of(text, pattern)
                code = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
                for i in np.flatnonzero(code < 0).tolist():
                    code[i] = rest.setdefault(units[i], base + len(rest))
                codes.append(code.astype("<u4"))
                rows.append((doc_id, len(units), zlib.crc32(raw)))
                have += len(raw)
        if rows:
            yield row()

    path = shared_dir(docs.sparkSession)
    out = bounded(docs).mapInArrow(run, "batch long, doc_id array<long>, n_units array<long>, crc32 array<long>, codes binary, n_parts binary, parts binary, rest array<string>")
    out.write.option("compression", "zstd").option("parquet.block.size", size).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _decoded_crc(ids: np.ndarray, cut: np.ndarray, codes: tuple[np.ndarray, np.ndarray], block: int = 1 << 17) -> list[int]:
    """CRC-32 of each text that its ids decode to (the first space left out), by blocks of ids."""
    data, begin = codes
    crc = [0] * (len(cut) - 1)
    for lo in range(0, len(ids), block):
        part = ids[lo : lo + block]
        size = begin[part + 1] - begin[part]
        raw = data[ragged(begin[part], size)]
        view = memoryview(raw)
        at = np.concatenate([[0], np.cumsum(size)])
        first, last = int(np.searchsorted(cut, lo, side="right")) - 1, int(np.searchsorted(cut, lo + len(part), side="left"))
        for owner in range(first, last):
            a, z = max(int(cut[owner]), lo) - lo, min(int(cut[owner + 1]) - lo, len(part))
            x, y = int(at[a]), int(at[max(a, z)])
            if a + lo == cut[owner] and y > x and raw[x] == 32:
                x += 1
            crc[owner] = zlib.crc32(view[x:y], crc[owner])
    return crc


def encode_digest(docs: DataFrame, tokenizers: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """doc_id, n_units, n_pieces, ids_crc32, round_trip, ids of every row.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit; round_trip: the ids decode to the text (by CRC-32), not
    so for texts with U+2581, which decodes to a space. Null and empty texts have no units and no ids; repeated rows and
    null ids keep a row each; an empty table gives no rows; other columns are not read.
    """
    pieces = PieceTable(tokenizer_file(model, tokenizers))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    with settings(docs.sparkSession, **SHUFFLES_DELETED, **LISTS_BY_SORT):
        head = docs.sparkSession.sparkContext.broadcast(head_of(docs, pieces))
        give_back(docs.sparkSession)
        batches = coded(docs, pieces.pattern, head, pairs=pieces.pairs)
        many = batches.agg(F.coalesce(F.sum(F.size("rest")), F.lit(0))).first()[0]
        rest = batches.select("batch", F.posexplode("rest").alias("k", "unit")).select((F.col("batch") * (1 << 24) + F.col("k")).alias("place"), "unit").repartition(max(_tasks(docs.sparkSession), many // TASK_UNITS), "unit")
        # all columns of rest are read, so that both sides of the join share one exchange
        different = rest.groupBy("unit").agg(F.max("place").alias("p")).where("p >= 0").select("unit")
        found = Found(rest.join(encode_units(different, pieces).hint("shuffle_hash"), "unit").select("place", "ids"))
    give_back(docs.sparkSession)
    codes = pieces.codes()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        own = head.value
        for number, doc_id, n_units, crc, raw, n_parts, parts, rest in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 8))):
            sizes, flat = own.sizes, own.ids
            if len(rest):
                more, ids = found.of(number)
                if len(more) != len(rest):
                    raise RuntimeError(f"batch {number}: {len(more)} encodings for {len(rest)} parts")
                n_parts, parts = (_from_planes(np.frombuffer(x.as_buffer(), np.uint8), "<u4") for x in (n_parts, parts))
                ids = ids[ragged((np.cumsum(more) - more)[parts], more[parts])]  # of the units, part by part
                more = np.add.reduceat(more[parts], np.append(0, np.cumsum(n_parts[:-1], dtype=np.int64)))
                sizes, flat = np.concatenate([sizes, more]), np.concatenate([flat, ids])
            starts = np.cumsum(sizes) - sizes
            used = _from_planes(np.frombuffer(raw.as_buffer(), np.uint8), "<u4")
            parts = [flat[ragged(starts[x], sizes[x])] for a in range(0, len(used), 1 << 18) for x in [used[a : a + (1 << 18)]]]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            count = np.asarray(n_units.values, np.int64)
            cut = np.concatenate([[0], np.cumsum(sizes[used])])[np.concatenate([[0], np.cumsum(count)])]
            view = memoryview(ids.astype("<u4")).cast("B")
            wanted = np.asarray(crc.values, np.int64)
            for a in range(0, len(count), 256):
                z = min(a + 256, len(count))
                own_cut = cut[a : z + 1]
                yield {
                    "doc_id": doc_id.values.slice(a, z - a),
                    "n_units": count[a:z],
                    "n_pieces": np.diff(own_cut),
                    "ids_crc32": [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(own_cut[:-1].tolist(), own_cut[1:].tolist())],
                    "round_trip": np.array(_decoded_crc(ids[own_cut[0] : own_cut[-1]], own_cut - own_cut[0], codes)) == wanted[a:z],
                    "ids": pa.ListArray.from_arrays(pa.array((own_cut - own_cut[0]).astype(np.int32)), pa.array(ids[own_cut[0] : own_cut[-1]].astype(np.int32))),
                }

    return map_batches(batches, run, "doc_id long, n_units long, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>", _KIND)


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """doc_id, ids of every row, as encode_digest has them."""
    return encode_digest(docs, tokenizers, model).select("doc_id", "ids")


def text_of(ids: Column, pieces: PieceTable) -> Column:
    """The text of ids: pieces' texts in a row, bytes' pieces as UTF-8 (U+FFFD where it is broken), meta-symbols as spaces but for the first."""
    code = {i: p.encode().hex() for p, i, _ in pieces.rows} | {i: f"{b:02x}" for b, i in pieces.bytes.items()}
    codes = F.split(F.lit(",".join(code.get(i, "") for i in range(max(code) + 1))), ",")  # folded to one constant
    joined = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(codes, i)), ""))
    text = F.replace(F.make_valid_utf8(joined.cast("string")), F.lit(SPACE), F.lit(" "))
    return F.coalesce(F.regexp_replace(text, "^ ", ""), F.lit(""))


def decode(rows: DataFrame, tokenizers: str = TOKENIZERS, model: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), by text_of."""
    return rows.select(rows[id_col].alias("doc_id"), text_of(F.col("ids"), PieceTable(tokenizer_file(model, tokenizers))).alias("text"))
