"""SimHash near-dedup with an LSH forest.

Every distinct set of five-word shingles gets a 128-bit SimHash. A forest of `TREES` tries, each over its own random
order of the bits, brings similar signatures under one prefix. Two sets of Jaccard similarity 0.8 differ in a bit with
probability acos(0.889) / pi = 0.15, so climbing to prefixes of `depth_for(TARGET)` bits finds such a pair in some tree
with probability `TARGET`. Candidates within `NEAR_BITS` bits and of fitting sizes are verified on the whole shingle sets.

Not all pairs of a family are verified. First each signature is verified against the earliest candidate under its
prefix; where a prefix holds more than `DENSE` signatures, only this first pass descends its trie six bits at a time
until it holds no more, with the first signatures of the (at most 64) children compared too. Then, with the classes that
gives, every candidate pair under a common prefix that still stands in two classes: a prefix of more than `DENSE`
signatures is dealt into blocks, and all pairs of blocks are compared, each by a task's group. So a link between two
texts counts whether or not it was needed, and copies are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Words
from .arrays import mix, ragged, window_hashes
from .batches import ROW_BITS, Store, each, freeze
from .common import bounded, give_back, map_batches, release, trim, written

SHINGLE = 5
SIMILARITY = 0.8
TREES = 40
TARGET = 0.99
NEAR_BITS = 34
DENSE = 3000
STEP = 6
HUB = 256
BUCKET_ROWS = 20_000
_U = np.uint64
_LANES = np.array([sum((b >> (7 - k) & 1) << (8 * k) for k in range(8)) for b in range(256)], _U)  # a byte's bits, a byte each
_ORDERS = [np.random.default_rng(7000 + t).permutation(128) for t in range(256)]


def depth_for(target: float = TARGET, similarity: float = SIMILARITY, trees: int = TREES) -> int:
    """The longest prefix that still finds a pair of this similarity in one of the trees with the target probability."""
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return max(1, int(math.log(1 - (1 - target) ** (1 / trees)) / math.log(same)))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin. A text of 1 to 4 words is one shingle."""
    n = len(words.texts) - 1
    counts = np.diff(words.texts)
    owner = np.repeat(np.arange(n), counts)
    at = words.windows(SHINGLE)
    values, owners = window_hashes(words.hashes, SHINGLE)[at], owner[at]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    extra = [mix(np.bitwise_xor.reduce(mix(words.hashes[words.texts[i] : words.texts[i + 1]] + np.arange(1, counts[i] + 1).astype(_U))) + _U(counts[i]))[()] for i in short.tolist()]
    values = np.concatenate([values, np.array(extra, _U)])
    owners = np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[fresh], owners[fresh]
    return values, np.searchsorted(owners, np.arange(n + 1))


def signatures(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of 128 bits, as two 64-bit columns, and two-word digests of the sets (texts without shingles: zeros)."""
    n = len(begin) - 1
    sums = np.zeros((n, 128), np.int32)
    digest = np.zeros((n, 2), _U)
    full = np.flatnonzero(np.diff(begin))
    a, b = mix(values + _U(0x1234567)), mix(values ^ _U(0x9E3779B97F4A7C15))
    for k, x in enumerate((a, b)):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(x + _U(k + 1)))])
        digest[:, k] = total[begin[1:]] - total[begin[:-1]]
    done = 0
    while done < len(full):
        last = max(done + 1, int(np.searchsorted(begin[full + 1], begin[full[done]] + (1 << 16), side="right")))
        rows = full[done:last]
        lo, hi = int(begin[rows[0]]), int(begin[rows[-1] + 1])
        lanes = _LANES[np.stack([a[lo:hi], b[lo:hi]], axis=1).view(np.uint8).reshape(hi - lo, 16)]
        blocks = -(-np.diff(begin)[rows] // 255)  # a lane counts to 255
        starts = np.repeat(begin[rows] - lo, blocks) + 255 * ragged(np.zeros(len(rows), np.int64), blocks)
        counts = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
        sums[rows] = np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0, dtype=np.int32)
        done = last
    bits = 2 * sums > np.diff(begin)[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(_U).reshape(n, 2), digest


def prefixes(sig: np.ndarray, tree: int) -> np.ndarray:
    """The first 60 bits of each signature in the tree's order of bits."""
    bits = np.unpackbits(sig.astype(">u8").view(np.uint8).reshape(len(sig), 16), axis=1)[:, _ORDERS[tree][:60]]
    return np.packbits(bits, axis=1).astype(_U) @ (_U(1) << (_U(8) * np.arange(7, -1, -1).astype(_U))) >> _U(4)


def _signed(frozen: DataFrame, text_at: int, id_at: int | None) -> DataFrame:
    def run(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        words = Words.of(rows.column(text_at))
        values, begin = shingles(words)
        sig, digest = signatures(values, begin)
        rid = (number << ROW_BITS) + np.arange(rows.num_rows)
        as_long = lambda x: x.astype(_U).view(np.int64)
        yield {"rid": rid, "doc_id": rows.column(id_at) if id_at is not None else rid, "n": np.diff(begin), "d1": as_long(digest[:, 0].copy()), "d2": as_long(digest[:, 1].copy()), "s1": as_long(sig[:, 0].copy()), "s2": as_long(sig[:, 1].copy())}

    return each(frozen, run, "rid long, doc_id long, n long, d1 long, d2 long, s1 long, s2 long")


def _planted(reps: DataFrame, trees: int) -> DataFrame:
    """A row for each tree and signature, with its prefix; extra columns stay."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        names = batch.schema.names
        sig = np.stack([batch.column(names.index(k)).to_numpy().view(_U) for k in ("s1", "s2")], axis=1)
        for t in range(trees):
            yield {name: batch.column(i) for i, name in enumerate(names)} | {"tree": np.full(len(sig), t), "prefix": prefixes(sig, t).astype(np.int64)}

    return map_batches(reps, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema) + ", tree int, prefix long")


def _groups(reps: DataFrame, trees: int, depth: int, dense: int) -> DataFrame:
    """Planted rows with the group each is compared in: `level` bits of its prefix; first ones of dense children twice."""
    rows = _planted(reps, trees)
    out, level = None, depth
    while True:
        key = F.shiftright("prefix", 60 - level)
        at = rows.withColumn("grp", key)
        counts = at.groupBy("tree", "grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > dense)
        full = counts.isEmpty()
        if full:
            part = at.withColumn("level", F.lit(level))
            return part if out is None else out.unionByName(part)
        if level + STEP > 60:  # signatures that agree in all 60 bits: blocks by hash, with their first ones in common
            block = F.pmod(F.xxhash64("rid"), F.lit(1 + rows.count() // dense))
            part = at.withColumn("level", F.lit(level) + 1 + block.cast("int"))
            lead = at.join(at.groupBy("tree", "grp", block.alias("b")).agg(F.min("rid").alias("rid")).select("tree", "grp", "rid"), ["tree", "grp", "rid"]).withColumn("level", F.lit(level))
            part = part.unionByName(lead)
            return part if out is None else out.unionByName(part)
        counts = written(counts.select("tree", "grp"))
        sparse = at.join(counts, ["tree", "grp"], "left_anti").withColumn("level", F.lit(level))
        rows = written(at.join(counts, ["tree", "grp"], "left_semi").drop("grp"))  # else each use plants all again
        child = F.shiftright("prefix", 60 - level - STEP)
        firsts = rows.groupBy("tree", child.alias("child")).agg(F.min("rid").alias("rid")).select("tree", "rid")
        leaders = rows.join(firsts, ["tree", "rid"]).withColumns({"grp": key, "level": F.lit(level)})
        part = sparse.unionByName(leaders)
        out = part if out is None else out.unionByName(part)
        level += STEP


def _blocks(reps: DataFrame, trees: int, depth: int, dense: int) -> tuple[DataFrame, int]:
    """Planted labelled rows with the groups they are compared in: a prefix (level 0) or, where it is dense, every pair of
    its blocks, numbered by level; side 1 is the pair's second block. Dense prefixes of one class are left out. And how many
    rows come of dense prefixes."""
    at = _planted(reps, trees).withColumn("grp", F.shiftright("prefix", 60 - depth))
    counts = at.groupBy("tree", "grp").agg(F.count(F.lit(1)).alias("size"), (F.min("label") < F.max("label")).alias("open")).where(F.col("size") > dense)
    counts = written(counts.select("tree", "grp", "open", "size", F.ceil(F.col("size") / dense).cast("long").alias("k")))
    more = counts.where("open").agg(F.sum(F.col("size") * F.col("k"))).first()[0]
    if counts.isEmpty():
        return at.withColumns({"level": F.lit(0).cast("long"), "side": F.lit(0)}), 0
    counts = counts.drop("size")
    sparse = at.join(counts, ["tree", "grp"], "left_anti").withColumns({"level": F.lit(0).cast("long"), "side": F.lit(0)})
    rows = at.join(counts.where("open"), ["tree", "grp"]).withColumn("block", F.pmod(F.xxhash64("rid"), "k"))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    level = 1 + F.least("block", "other") * F.col("k") + F.greatest("block", "other")
    pairs = pairs.withColumns({"level": level, "side": (F.col("block") > F.col("other")).cast("int")})
    return sparse.unionByName(pairs.drop("k", "open", "block", "other")), more or 0


def near_pairs(sig: np.ndarray, n: np.ndarray, label: np.ndarray | None, similarity: float, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of one group, in order of rid. Without labels: each with its earliest candidate; with: all in two classes.

    With `split`, only those from there on are compared with those before it.
    """
    later, earlier = [], []
    every = np.arange(len(sig))
    jobs = [(every[max(split, 1) :], every[: split or len(sig)])]
    if label is not None and len(sig) > 256:  # the largest class isn't compared with itself
        values, counts = np.unique(label, return_counts=True)
        main = label == values[np.argmax(counts)]
        rest, against = jobs[0]
        jobs = [(rest[main[rest]], against[~main[against]]), (rest[~main[rest]], against)]
    for rest, against in jobs:
        for at in range(0, len(rest), 256):
            rows = rest[at : at + 256]
            cols = against[: np.searchsorted(against, rows[-1])]
            near = np.bitwise_count(sig[rows, None, 0] ^ sig[None, cols, 0]).astype(np.int16)
            near += np.bitwise_count(sig[rows, None, 1] ^ sig[None, cols, 1])
            ok = near <= NEAR_BITS
            x, y = np.nonzero(ok)
            y = cols[y]
            small, large = np.minimum(n[rows[x]], n[y]), np.maximum(n[rows[x]], n[y])
            fits = (y < rows[x]) & (small >= similarity * large - 1e-9)
            if label is not None:
                fits &= label[rows[x]] != label[y]
            x, y = x[fits], y[fits]
            if label is None and len(x):
                first = np.append(True, x[1:] != x[:-1])  # nonzero goes row by row
                x, y = x[first], y[first]
            later.append(rows[x])
            earlier.append(y)
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return join(later), join(earlier)


def _candidates(groups: DataFrame, a_tree: int, similarity: float, labelled: bool) -> DataFrame:
    """Distinct pairs a < b of candidates; a_tree: about how many rows of groups a tree has."""

    def run(rows: pa.Table) -> pa.Table:
        get = lambda k: rows.column(k).to_numpy()
        rid, grp, level = get("rid"), get("grp"), get("level")
        side = get("side") if labelled else np.zeros(len(rid), np.int32)
        order = np.lexsort((rid, side, level, grp))
        rid, grp, level, side = rid[order], grp[order], level[order], side[order]
        sig = np.stack([get("s1")[order].view(_U), get("s2")[order].view(_U)], axis=1)
        n = get("n")[order]
        label = get("label")[order] if labelled else None
        cut = np.append(np.flatnonzero(np.append(True, (grp[1:] != grp[:-1]) | (level[1:] != level[:-1]))), len(rid))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(np.diff(cut) > 1).tolist():
            s = slice(cut[i], cut[i + 1])
            x, y = near_pairs(sig[s], n[s], label[s] if labelled else None, similarity, int(np.count_nonzero(side[s] == 0)) if side[s][-1] else 0)
            if len(x):
                b.append(rid[s][x])
                a.append(rid[s][y])
        pairs = np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1)
        pairs = np.unique(pairs, axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        trim()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    # groups travel together by the first bits of their prefix, a bounded number of signatures each
    slim = groups.select("tree", "level", "grp", "rid", "n", "s1", "s2", *(["label", "side"] if labelled else []), F.expr("pmod(xxhash64(tree, level, grp), 1 << 30)").alias("mixed"))
    bucket = F.pmod("mixed", F.lit(1 + a_tree // BUCKET_ROWS))
    return slim.withColumn("bucket", bucket).drop("mixed").groupBy("tree", "bucket").applyInArrow(lambda rows: run(rows), "a long, b long").distinct()


def _verified(pairs: DataFrame, frozen: DataFrame, text_at: int, similarity: float) -> DataFrame:
    """Those of the pairs whose whole shingle sets are at least that similar. A hub's pairs are dealt to several tasks."""
    pairs = written(pairs)
    degree = pairs.groupBy("a").agg((1 + F.floor(F.count(F.lit(1)) / HUB)).alias("parts"))
    dealt = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "parts"))
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("parts - 1"))).alias("salt"), F.col("a").alias("rid"))
    needs = dealt.select("a", "salt", F.col("b").alias("rid")).unionByName(hubs)
    asked = Store(needs.select(F.shiftright("rid", ROW_BITS).alias("batch"), F.expr(f"rid & {(1 << ROW_BITS) - 1}").alias("row"), "a", "salt"))

    def sets(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        want = asked.of(number)
        if want is None or want.num_rows == 0:
            return
        at, which = np.unique(want.column("row").to_numpy(), return_inverse=True)
        values, begin = shingles(Words.of(rows.column(text_at).take(pa.array(at))))
        packed = [(values[i:j] >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]
        yield {"a": want.column("a").combine_chunks(), "salt": want.column("salt").combine_chunks(), "rid": (number << ROW_BITS) + at[which], "set": [packed[i] for i in which.tolist()]}

    def verify(rows: pa.Table) -> pa.Table:
        hub = rows.column("a")[0].as_py()

        def load(raw: bytes) -> np.ndarray:
            part = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            return np.pad(part, ((0, 0), (0, 3))).view("<u8")[:, 0]

        rid = rows.column("rid").to_pylist()
        raws = rows.column("set").to_pylist()
        mine = load(raws[rid.index(hub)])
        linked = []
        for r, raw in zip(rid, raws):
            if r != hub:
                other = load(raw)
                both = int((np.searchsorted(mine, other, side="right") > np.searchsorted(mine, other, side="left")).sum())
                if both >= similarity * (len(mine) + len(other) - both) - 1e-9:
                    linked.append(r)
        return pa.table({"a": pa.array([hub] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    sent = each(frozen, sets, "a long, salt long, rid long, set binary")
    return written(sent.groupBy("a", "salt").applyInArrow(verify, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(rid, label) of every end of an edge; the label is the least rid of its component. By alternating large and small stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new.select(F.col("u").alias("rid"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("rid"), F.col("v").alias("label")).distinct())
        now = new


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, trees: int = TREES, target: float = TARGET, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Frozen batches of docs, and for each row (rid, doc_id, label): rows with one label are near-duplicates, linked directly or by others."""
    frozen = freeze(docs, text_col)
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    signed = written(_signed(frozen, text_at, id_at))
    reps = written(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("rid").alias("rid"), F.first("s1").alias("s1"), F.first("s2").alias("s2")))
    slim = reps.select("rid", "n", "s1", "s2")
    depth = depth_for(target, similarity, trees)
    count = slim.count()
    first = _verified(_candidates(_groups(slim, trees, depth, dense), count, similarity, False), frozen, text_at, similarity)
    found = written(components(first))
    labelled = written(slim.join(found, "rid", "left").withColumn("label", F.coalesce("label", "rid")))
    give_back(docs.sparkSession)
    blocks, more = _blocks(labelled, trees, depth, dense)
    second = _verified(_candidates(blocks, count + more // trees, similarity, True), frozen, text_at, similarity)
    final = written(components(first.unionByName(second)))
    sets = reps.select("d1", "d2", "n", "rid").join(final, "rid", "left").select("d1", "d2", "n", F.coalesce("label", "rid").alias("label"))
    return frozen, signed.join(sets, ["d1", "d2", "n"], "left").select("rid", "doc_id", F.coalesce("label", "rid").alias("label"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id of every row; class_id is the least doc_id of the class.

    Texts of fewer than five words count as one shingle; null, empty and blank texts are alone; repeated rows share a
    class; with null ids only, a class has a negative number; an empty table gives no rows; other columns are not read.
    """
    _, rows = classes(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), **how)
    least = rows.groupBy("label").agg(F.coalesce(F.min("doc_id"), -1 - F.col("label")).alias("class_id"))
    return rows.join(least, "label").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """docs with all columns, one row of each class: that of least id, the earliest of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from .batches import thaw

    frozen, rows = classes(docs, text_col, id_col, **how)
    stays = rows.groupBy("label").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("rid"))
    kept = Store(stays.select(F.shiftright("rid", ROW_BITS).alias("batch"), F.expr(f"rid & {(1 << ROW_BITS) - 1}").alias("row")))
    out = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                want = kept.of(number)
                if want is not None and want.num_rows:
                    part = thaw(data).take(pa.array(np.sort(want.column("row").to_numpy())))
                    yield pa.RecordBatch.from_arrays([c.cast(out.field(i).type) for i, c in enumerate(part.columns)], schema=out)

    return bounded(frozen.select("batch", "data")).mapInArrow(run, docs.schema)
