"""Best-fit packing by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover copies one parent, injects whole well-filled bins of the other, drops the bins
that then hold a document twice, and puts the documents so displaced back best-fit, longest first; mutation empties a
few of the worst bins and puts their documents back likewise. Documents are dealt by hash into shards of about
`SHARD_ITEMS`; each shard is evolved on `ISLANDS` islands, which after every epoch send their elite to the next island.
A shard whose elite meets a lower bound after a generation stops. Bins of the best solutions that stay poorly
filled are packed again across shards, until one shard holds what is left or a level lowers neither the number of
poorly packed pieces nor that of their bins by a tenth (`GAIN`); what is left then stays as that level laid it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_slices
from .common import TOKENIZERS, give_back, map_batches, tokenizer_file, written
from .tokens import KIND, WORD_BPE, tokenizer

CAPACITY = 2048
SHARD_ITEMS = 20_000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 40  # at most, on an island in an epoch; a solution that meets the lower bound ends them after the first
POPULATION = 6
STALE = 12
SMALL = 2_000  # items, up to which populations are whole from the start
WELL_FILLED = 0.995
POOR = 0.98
GAIN = 0.1


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Put the items of `order`, one by one, into the bin with the least room that takes them; bins and room change."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            free[r].append(b)
            mask |= 1 << r
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        r -= size
        room[b] = r
        bins[item] = b
        if r:
            if not free[r]:
                mask |= 1 << r
            free[r].append(b)


def fill_of(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def put_back(bins: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, spread: float = 0.02) -> np.ndarray:
    """Bins without the loose items, then those best-fit, longest first (ties and near-ties in random order)."""
    out = np.full(len(bins), -1, np.int64)
    kept = np.ones(len(bins), dtype=bool)
    kept[loose] = False
    out[kept] = compact(bins[kept])
    room = (capacity - fill_of(out[kept], lengths[kept])).tolist() if kept.any() else []
    order = loose[np.argsort(-lengths[loose] * (1 + spread * rng.random(len(loose))), kind="stable")]
    best_fit(order, lengths, out, room, capacity)
    return out


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any solution needs: items of over capacity - k each open one, and what those over half leave isn't room for
    all others of at least k; the largest such count over all k (k = 0: the tokens alone)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    many, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * np.arange(len(count)))[::-1])[::-1]  # of items >= k
    many, total = np.append(many, 0), np.append(total, 0)
    half = capacity // 2 + 1
    k = np.arange(half)
    alone = many[capacity - k + 1]  # with these no item of at least k fits
    large, room = many[half] - alone, (many[half] - alone) * capacity - (total[half] - total[capacity - k + 1])
    rest = total[k] - total[half]
    return int((alone + large + np.maximum(0, -(-(rest - room) // capacity))).max())


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: (-bins, sum of squared fills)."""
    fill = fill_of(bins, lengths) / capacity
    return -len(fill), float((fill**2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Parent a with whole well-filled bins of parent b."""
    fill = fill_of(b, lengths)
    well = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if len(well) < len(fill) // 8 + 1:
        well = np.argsort(-fill)[: len(fill) // 4 + 1]
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[well[rng.random(len(well)) < rng.uniform(0.1, 0.6)]] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, dtype=bool)
    broken[a[injected]] = True
    loose = np.flatnonzero(broken[a] & ~injected)
    child = np.where(injected, b + len(broken), a)
    return put_back(child, loose, lengths, capacity, rng)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The worst bins and some others are emptied and their items put back in a random order of near-sizes."""
    fill = fill_of(a, lengths)
    worst = np.argsort(fill)[: 2 + len(fill) // 50]
    others = rng.integers(0, len(fill), 1 + int(len(fill) * rng.uniform(0.01, 0.15)))
    emptied = np.zeros(len(fill), dtype=bool)
    emptied[worst] = emptied[others] = True
    return put_back(a, np.flatnonzero(emptied[a]), lengths, capacity, rng, rng.choice([0.02, 0.1, 0.3]))


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """Some generations on one island, one at least; the first of what returns is its elite.

    A new population is best-fit decreasing and best-fit in random orders. An island that comes with an elite that meets
    the lower bound, or reaches it in its first or a later generation, returns that alone.
    """
    rng = np.random.default_rng(seed)
    bound = lower_bound(lengths, capacity)
    everything = np.arange(len(lengths))
    none = np.zeros(len(lengths), np.int64)
    rank = lambda x: (x[0], -x[1])
    if not population:
        population = [put_back(none, everything, lengths, capacity, rng, spread) for spread in (0.0, 0.02, 0.3, *([0.1] * (POPULATION - 3)))[: POPULATION if len(lengths) < SMALL else 2]]
    else:
        for p in population:
            if -fitness(p, lengths, capacity)[0] <= bound:
                return [p]
    scored = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), reverse=True, key=rank)
    made, stale = len(scored), 0
    if len(scored) > 1:
        for _ in range(GENERATIONS):
            before = scored[0][0]
            for _ in range(POPULATION // 2 if len(lengths) < SMALL else 1):
                i, j = rng.choice(len(scored), 2, replace=False)
                child = crossover(scored[i][2], scored[j][2], lengths, capacity, rng)
                if -scored[0][0][0] > bound:
                    child = mutate(child, lengths, capacity, rng)
                made += 1
                scored.append((fitness(child, lengths, capacity), made, child))
            scored = sorted(scored, reverse=True, key=rank)[:POPULATION]
            stale = 0 if scored[0][0] > before else stale + 1
            if -scored[0][0][0] <= bound or stale >= STALE:
                break
    if -scored[0][0][0] <= bound:
        return [scored[0][2]]
    return [p for _, _, p in scored]


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Evolve every island; columns shard, island, rid, length, population (array of bin numbers an item)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [
                [x.astype(np.int32) for x in evolve(np.asarray(r.length, np.int64), [np.asarray(p, np.int64) for p in r.population], capacity, zlib.crc32(f"{r.shard}/{r.island}/{epoch}".encode()))]
                for r in frame.itertuples()
            ]
            yield frame.assign(population=made)

    return state.mapInPandas(run, state.schema)


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(rid, length) -> (rid, sequence_id, offset): whole items in as few bins as found. rid is unique, 0 < length <= capacity."""
    done: list[DataFrame] = []
    level, before = 0, None
    left = items.select("rid", F.col("length").cast("int").alias("length"))
    while True:
        count = left.count()
        shards = max(1, -(-count // shard_items))
        dealt = left.groupBy(F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "rid")), asc=False).alias("x"))
        state = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.rid").alias("rid"), F.col("x.length").alias("length"), F.expr("CAST(array() AS array<array<int>>)").alias("population"))
        for epoch in range(epochs):
            state = _epoch(state, capacity, epoch)
            if epoch < epochs - 1:
                elites = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("elite"))
                state = state.join(elites, ["shard", "island"]).select("shard", "island", "rid", "length", F.concat("population", F.array("elite")).alias("population"))
        elite = F.col("population")[0]
        best = state.groupBy("shard").agg(F.max_by(F.struct("rid", "length", elite.alias("bins")), F.struct(-F.array_max(elite), F.col("island"))).alias("x"))

        def lay(frames: Iterator[pd.DataFrame], last: bool = shards == 1, level: int = level) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard, x in zip(frame["shard"], frame["x"]):
                    rid, length, bins = (np.asarray(x[k], np.int64) for k in ("rid", "length", "bins"))
                    order = np.argsort(bins, kind="stable")
                    rid, length, bins = rid[order], length[order], bins[order]
                    first = np.concatenate([[True], bins[1:] != bins[:-1]])
                    before = np.cumsum(length) - length
                    offset = before - np.maximum.accumulate(np.where(first, before, 0))
                    poor = (fill_of(bins, length) < POOR * capacity)[bins] & (not last)
                    yield pd.DataFrame({"rid": rid, "length": length, "sequence_id": (level << 56) + (int(shard) << 24) + bins, "offset": offset, "poor": poor})

        laid = written(best.mapInPandas(lay, "rid long, length int, sequence_id long, offset long, poor boolean"))
        poor, bins, poor_bins = laid.agg(F.count_if("poor"), F.countDistinct("sequence_id"), F.countDistinct(F.when(F.col("poor"), F.col("sequence_id")))).first()
        stuck = before is not None and poor > (1 - GAIN) * count and bins > (1 - GAIN) * before
        done.append((laid if stuck else laid.where("NOT poor")).select("rid", "sequence_id", "offset"))
        if shards == 1 or stuck:
            break
        before = poor_bins
        left, level = laid.where("poor").select("rid", "length"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and a closing 0, cut at every `capacity` ids: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer_file(WORD_BPE, tokenizers)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        tok = tokenizer(path)
        for a, b, buf, offs in text_slices(batch.column(1)):
            ids, cut = tok.encode(buf, offs)
            closed = np.insert(ids, cut[1:], 0).astype("<u4")
            begin = cut[:-1] + np.arange(b - a)
            size = np.diff(cut) + 1
            count = -(-size // capacity)
            owner = np.repeat(np.arange(b - a), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[owner] - start)
            view = memoryview(closed).cast("B")
            at = (begin[owner] + start) * 4
            crc = [zlib.crc32(view[x : x + 4 * n]) for x, n in zip(at.tolist(), length.tolist())]
            yield {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(owner)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    columns = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(columns, run, "doc_id long, piece int, start long, length long, ids_crc32 long", KIND)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, **how: int) -> DataFrame:
    """All pieces of all documents with their sequence and their place in it.

    Null and empty texts are the single id 0; repeated rows and null ids are packed like any others; an empty table
    gives no rows; other columns are not read. Pieces of full length are sequences by themselves.
    """
    give_back(docs.sparkSession)
    cut = written(pieces(docs, capacity, tokenizers).withColumn("rid", F.monotonically_increasing_id()))
    placed = pack_items(cut.where(F.col("length") < capacity).select("rid", "length"), capacity, **how)
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.where(F.col("length") < capacity).join(placed, "rid").unionByName(full).drop("rid")
