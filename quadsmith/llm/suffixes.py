"""Suffix-array dedup: byte strings of `WINDOW` bytes that start at more than one place are removed.

A suffix array of a whole corpus can't be built in one place, so texts are first parsed into cells: every window of
400 bytes belongs to the least-hashed 64 bytes in it (its owner), and a cell is a run of windows with one owner. Equal
windows have owners at equal distances, hence

- a cell whose owner is unlike all others holds no repeat and goes no further;
- cells equal in owner and in all their bytes are counted as one string with its number of places (pre-aggregation);
- the rest, where repeats begin and end, is cut into tiles of `TILE` windows. Tiles with equal cores (the bytes that all
  the tile's windows share) form a suffix-array problem: strings of up to 15 bytes, the core as one symbol, and up to 15
  bytes. Their suffix array comes from the linear grouping construction below; neighbours that share `TILE` symbols
  are equal windows of 400 bytes.

Beside that, `n_passage_bytes` counts the bytes in shared passages, which may be shorter than a window: places of 64 bytes
chosen by hash (one of 64) that stand elsewhere too are extended to `PASSAGE` bytes around them, at four offsets, and
those strings are looked for elsewhere. All that is counted stands at two places; a shared passage of 330 bytes has no
such place in it with probability 0.02, longer ones more seldom.

Cores with too many different strings for one task are not put into a suffix array but resolved window by window
through another exchange, with the same results. The exchanges compare 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTES, cells, covered, mix, prefix_totals, ragged, range_hashes, text_slices, window_hashes
from .batches import BUCKET_KEYS, PACKED, Store, each, exchange, freeze, pack_keys
from .common import map_batches, trim

WINDOW = 400
OWNER = 64
TILE = 16
HOT_PLACES = 1000
HOT_LOCAL = 256
CHUNK_SYMBOLS = 100_000
PASSAGE = 256
_U = np.uint64


def grouped_suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a text whose last symbol is its least and only one of its kind.

    First phase: groups of suffixes with one Lyndon prefix, from the highest down. Each member finds its nearest
    predecessor of a lower group through the previous-smaller pointers; the predecessors' Lyndon prefixes grow by the
    group's, so they leave their groups for new ones just above, those with more repeats of it higher. Second phase:
    suffixes are emitted in order; each emits the suffixes before it, along the pointers, into their groups. No
    renaming, no recursion; linear time but for the sorting of symbols and of counts.
    """
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    place, group, size, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, s in enumerate(sa):
        place[s] = i
        if text[s] != text[sa[start]]:
            start = i
        group[s] = start
        size[start] += 1
    end = n
    while end > 1:
        here = group[sa[end - 1]]
        members = sa[here:end]
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > here:
                p = prev[p]
            prev[s] = p
        counts: dict[int, int] = {}
        for s in members:
            p = prev[s]
            if p >= 0 and group[p] == here:
                path = [s]
                while p >= 0 and group[p] == here:
                    path.append(p)
                    p = prev[p]
                for q in path:
                    prev[q] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        for k in sorted(set(counts.values()), reverse=True):
            moved: dict[int, int] = {}
            for p, c in counts.items():
                if c != k:
                    continue
                g = group[p]
                last = g + size[g] - 1
                i, q = place[p], sa[last]
                sa[i], place[q] = q, i
                sa[last], place[p] = p, last
                size[g] -= 1
                moved[g] = moved.get(g, 0) + 1
            for g, c in moved.items():
                new = g + size[g]
                size[new] = c
                for i in range(new, new + c):
                    group[sa[i]] = new
        end = here
    placed = [False] * n
    placed[n - 1] = True
    free = list(range(n))  # by group: its next place
    sa[0] = n - 1
    for i in range(n):
        p = sa[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            sa[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = prev[p]
    return sa


def repeated_windows(keys: np.ndarray, left: list[bytes], right: list[bytes], many: np.ndarray) -> np.ndarray:
    """For tile strings left + core + right (core: one symbol for each key), a mask of repeated windows each.

    Bit j is the window that starts j bytes before the core. `many` marks strings that stand at several places, all of
    whose windows are repeated; strings of one key must come together.
    """
    masks = np.zeros(len(keys), np.uint16)
    change = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)]
    at = 0
    while at < len(change) - 1:
        text: list[int] = []
        owner: list[int] = []
        core_at: list[int] = []
        while at < len(change) - 1 and (not text or len(text) < CHUNK_SYMBOLS):
            for i in range(change[at], change[at + 1]):
                text += [c + 1 for c in left[i]]
                owner.append(i)
                core_at.append(len(text))
                text.append(257 + at)
                text += [c + 1 for c in right[i]]
                text.append(0)
            at += 1
        text.append(-1)
        sa = np.array(grouped_suffix_array(text), np.int64)
        symbols = np.array(text, np.int64)
        before = np.full(len(text), -1, np.int64)  # bytes from a suffix to its string's core
        string = np.zeros(len(text), np.int64)
        for i, c in zip(owner, core_at):
            for j in range(len(left[i]) + 1):
                if j + 1 + len(right[i]) >= TILE:
                    before[c - j] = j
                    string[c - j] = i
        a, b = sa[:-1], sa[1:]
        fits = (before[a] >= 0) & (before[b] >= 0)
        a, b = a[fits], b[fits]
        same = np.ones(len(a), dtype=bool)
        for j in range(TILE):
            same &= symbols[a + j] == symbols[b + j]
        for x in (a[same], b[same]):
            np.bitwise_or.at(masks, string[x], (1 << before[x]).astype(np.uint16))
        for i, c in zip(owner, core_at):
            if many[i]:
                for j in range(len(left[i]) + 1):
                    if j + 1 + len(right[i]) >= TILE:
                        masks[i] |= 1 << j
    return masks


def find_cells(column: pa.Array, window: int, owner: int) -> dict[str, np.ndarray]:
    """Cells of all texts of a batch: owner's place, first and last window start (in the batch's bytes), two hashes."""
    out: dict[str, list] = {"owner": [], "first": [], "last": [], "h": [], "u": [], "a": [], "ah": []}
    base = 0
    for _, _, buf, offs in text_slices(column):
        values = BYTES[buf]
        hashes = window_hashes(values, owner)
        o, f, z = cells(hashes, offs, owner, window)
        total = prefix_totals(values)
        for k, x in (("owner", o + base), ("first", f + base), ("last", z + base)):
            out[k].append(x.astype(np.int32))
        out["h"].append(hashes[o])
        at = np.flatnonzero(hashes >> _U(58) == 0)
        at = at[at + owner <= offs[np.searchsorted(offs, at, side="right")]]
        out["a"].append((at + base).astype(np.int32))
        out["ah"].append(hashes[at] << _U(6))  # buckets are ranges of keys
        out["u"].append(mix(range_hashes(total, f, z + window) ^ mix(hashes[o] + (o - f).astype(_U))))
        base += len(buf)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int32 if k in ("owner", "first", "last", "a") else _U) for k, v in out.items()}


def _pack(columns: dict[str, np.ndarray]) -> dict:
    return {k: [v.tobytes()] for k, v in columns.items()}


def _unpack(rows: pa.Table | None, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    if rows is None or rows.num_rows == 0:
        return {k: np.zeros(0, t) for k, t in kinds.items()}
    return {k: np.frombuffer(rows.column(k)[0].as_py(), t) for k, t in kinds.items()}


_CELL = {"owner": np.int32, "first": np.int32, "last": np.int32, "h": _U, "u": _U}
_ANCHOR = {"a": np.int32, "ah": _U}
_PASSAGE = {"start": np.int32, "key": _U}
_TILE = {"core": _U, "string": _U, "at": np.int32, "left": np.uint8, "right": np.uint8}


class Batch:
    """The bytes of a batch's texts, with their bounds and slices."""

    def __init__(self, column: pa.Array):
        self.slices, bounds, base = [], [np.zeros(1, np.int64)], 0
        for _, _, buf, offs in text_slices(column):
            self.slices.append((base, buf))
            bounds.append(offs[1:] + base)
            base += len(buf)
        self.bounds = np.concatenate(bounds)
        self.size = base

    def bytes(self) -> np.ndarray:
        return np.concatenate([b for _, b in self.slices]) if len(self.slices) != 1 else self.slices[0][1]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges that each lie in one slice."""
        out = np.zeros(len(starts), _U)
        for base, buf in self.slices:
            here = np.flatnonzero((starts >= base) & (starts < base + len(buf)))
            if len(here):
                out[here] = range_hashes(prefix_totals(BYTES[buf]), starts[here] - base, ends[here] - base)
        return out


def cut_tiles(batch: Batch, cell: dict[str, np.ndarray], window: int) -> dict[str, np.ndarray]:
    """The tiles of some cells: hash of the core, hash of the whole string, the core's place, and the bytes beside it."""
    owner, first, last = (cell[k].astype(np.int64) for k in ("owner", "first", "last"))
    low, high = (owner - last) // TILE, (owner - first) // TILE
    which = np.repeat(np.arange(len(owner)), high - low + 1)
    tile = ragged(low, high - low + 1)
    at = owner[which] - tile * TILE
    end = at - (TILE - 1) + window
    text = np.searchsorted(batch.bounds, owner[which], side="right") - 1
    left = np.minimum(TILE - 1, at - batch.bounds[text])
    right = np.minimum(TILE - 1, batch.bounds[text + 1] - end)
    core = mix(batch.hashes(at, end) ^ mix(tile.astype(_U) + _U(0x5851F42D)))
    string = mix(batch.hashes(at - left, end + right) ^ mix(core + (left * TILE + right).astype(_U)))
    return {"core": core, "string": string, "at": at.astype(np.int32), "left": left.astype(np.uint8), "right": right.astype(np.uint8)}


def passages(batch: Batch, anchors: np.ndarray) -> dict[str, np.ndarray]:
    """Strings of `PASSAGE` bytes inside a text around each anchor, at four offsets: their starts and hashes."""
    text = np.searchsorted(batch.bounds, anchors, side="right") - 1
    start = anchors[:, None] - OWNER * np.arange(PASSAGE // OWNER)
    inside = (start >= batch.bounds[text][:, None]) & (start + PASSAGE <= batch.bounds[text + 1][:, None])
    start = np.unique(start[inside])
    return {"start": start.astype(np.int32), "key": batch.hashes(start, start + PASSAGE)}


def _suffix_rows(rows: pa.Table) -> pa.Table:
    """Solve one bucket of tile strings; masks come back batch by batch in the order sent."""
    counts = rows.column("n").to_pylist()
    get = lambda name, kind, width=1: np.concatenate([np.frombuffer(x, kind).reshape(-1, width) for x in rows.column(name).to_pylist()])
    core, string, many = get("core", _U)[:, 0], get("string", _U)[:, 0], get("many", bool)[:, 0]
    sizes, sides = get("sizes", np.uint8, 2), get("sides", np.uint8, 2 * (TILE - 1))
    order = np.lexsort((string, core))
    fresh = np.append(True, (core[order][1:] != core[order][:-1]) | (string[order][1:] != string[order][:-1]))
    group = np.cumsum(fresh) - 1
    one = order[fresh]
    several = (np.bincount(group) > 1) | (np.bincount(group, weights=many[order]) > 0)
    side = TILE - 1
    left = [sides[i, side - sizes[i, 0] : side].tobytes() for i in one]
    right = [sides[i, side : side + sizes[i, 1]].tobytes() for i in one]
    masks = np.zeros(len(core), np.uint16)
    masks[order] = repeated_windows(core[one], left, right, several)[group]
    parts = np.split(masks, np.cumsum(counts)[:-1])
    trim()
    return pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "masks": pa.array([m.tobytes() for m in parts], pa.binary())})


def repeated_bytes(docs: DataFrame, window: int = WINDOW, text_col: str = "text"):
    """Freeze docs; return the frozen batches and a function (number, column) -> (Batch, which bytes are repeated, which are in shared passages)."""
    frozen = freeze(docs, text_col)
    size = frozen.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets, solvers = 1 + size // (50 * BUCKET_KEYS), 1 + size // (8 << 20)
    text_at = docs.columns.index(text_col)
    binary = lambda kinds: "".join(f", {k} binary" for k in kinds)
    found = Store(each(frozen, lambda number, rows: iter([{"batch": [number]} | _pack(find_cells(rows.column(text_at), window, OWNER))]), "batch long" + binary(_CELL | _ANCHOR)))
    numbers = frozen.select("batch")

    def each_batch(fn) -> DataFrame:
        return map_batches(numbers, lambda batch: (part for number in batch.column(0).to_pylist() for part in fn(number)), PACKED)

    def by_key(name: str, kinds: dict[str, type], store: Store):
        def fn(number: int) -> Iterator[dict]:
            distinct, counts = np.unique(_unpack(store.of(number), kinds)[name], return_counts=True)
            yield pack_keys(number, distinct, np.zeros(len(distinct), dtype=bool), counts > 1, buckets, 64)

        return exchange(each_batch(fn))

    owners, whole, anchors = by_key("h", _CELL, found), by_key("u", _CELL, found), by_key("ah", _ANCHOR, found)

    def judged(number: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Cells whose owner stands elsewhere too; which of them are whole repeats; which are the first such here."""
        cell = _unpack(found.of(number), _CELL)
        keys, which = np.unique(cell["h"], return_inverse=True)
        near = owners.of(number, len(keys))[0][which]
        keys, first, which = np.unique(cell["u"], return_index=True, return_inverse=True)
        same = whole.of(number, len(keys))[0][which]
        leads = np.zeros(len(same), dtype=bool)
        leads[first] = True
        return {k: v[near] for k, v in cell.items()}, same[near], leads[near]

    def doubtful(number: int) -> Iterator[dict]:
        cell, same, _ = judged(number)
        keys, which = np.unique(cell["h"], return_inverse=True)
        yield pack_keys(number, keys, np.bincount(which, weights=~same, minlength=len(keys)) > 0, np.zeros(len(keys), dtype=bool), buckets, 64)

    doubts = exchange(each_batch(doubtful))

    def tiles(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        cell, same, leads = judged(number)
        keys, which = np.unique(cell["h"], return_inverse=True)
        fine = ~same | (leads & doubts.of(number, len(keys))[1][which])  # a whole repeat is needed once, as a partner
        batch, anchor = Batch(rows.column(text_at)), _unpack(found.of(number), _ANCHOR)
        keys, which = np.unique(anchor["ah"], return_inverse=True)
        near = anchor["a"][anchors.of(number, len(keys))[0][which]].astype(np.int64)
        yield {"batch": [number]} | _pack(cut_tiles(batch, {k: v[fine] for k, v in cell.items()}, window)) | _pack(passages(batch, near))

    tiled = Store(each(frozen, tiles, "batch long" + binary(_TILE | _PASSAGE)))
    shared_passages = by_key("key", _PASSAGE, tiled)

    def distinct_strings(tile: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First tile of each distinct string, in the order of cores; each tile's string; which stand here twice."""
        order = np.lexsort((tile["string"], tile["core"]))
        core, string = tile["core"][order], tile["string"][order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (core[1:] != core[:-1]) | (string[1:] != string[:-1])
        group = np.cumsum(fresh) - 1
        which = np.empty(len(order), np.int64)
        which[order] = group
        return order[fresh], which, np.bincount(group, minlength=int(fresh.sum())) > 1

    def cores(number: int) -> Iterator[dict]:
        tile = _unpack(tiled.of(number), _TILE)
        one, _, many = distinct_strings(tile)
        keys, which, counts = np.unique(tile["core"][one], return_inverse=True, return_counts=True)
        several = (counts > 1) | (np.bincount(which, weights=many, minlength=len(keys)) > 0)
        yield pack_keys(number, keys, counts > HOT_LOCAL, several, buckets, 64)

    shared = exchange(each_batch(cores), HOT_PLACES)

    def good_tiles(number: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Tiles whose core stands elsewhere too, and which of those are for the exchange of windows."""
        tile = _unpack(tiled.of(number), _TILE)
        keys, which = np.unique(tile["core"], return_inverse=True)
        several, local, many = shared.of(number, len(keys))
        good = several[which]
        return {k: v[good] for k, v in tile.items()}, (local | many)[which][good]

    def strings(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        tile, hot = good_tiles(number)
        tile = {k: v[~hot] for k, v in tile.items()}
        one, _, many = distinct_strings(tile)
        if not len(one):
            return
        data = np.concatenate([np.zeros(TILE, np.uint8), Batch(rows.column(text_at)).bytes(), np.zeros(TILE, np.uint8)])
        at = tile["at"][one].astype(np.int64) + TILE
        side = np.arange(TILE - 1)
        sides = np.concatenate([data[at[:, None] - (TILE - 1) + side], data[np.minimum(at[:, None] + window - (TILE - 1) + side, len(data) - 1)]], axis=1)
        sizes = np.stack([tile["left"][one], tile["right"][one]], axis=1)
        bucket = (tile["core"][one] >> _U(32)) * _U(solvers) >> _U(32)
        cut = np.append(np.searchsorted(bucket, np.arange(solvers, dtype=_U)), len(bucket))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            x = slice(cut[b], cut[b + 1])
            yield {"bucket": [b], "batch": [number], "n": [int(cut[b + 1] - cut[b])], "core": [tile["core"][one][x].tobytes()], "string": [tile["string"][one][x].tobytes()], "many": [many[x].tobytes()], "sizes": [sizes[x].tobytes()], "sides": [sides[x].tobytes()]}

    sent = each(frozen, strings, "bucket int, batch long, n int, core binary, string binary, many binary, sizes binary, sides binary")
    solved = Store(sent.groupBy("bucket").applyInArrow(_suffix_rows, "batch long, bucket int, masks binary"))

    def hot_windows(number: int, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of the tiles that no suffix array takes."""
        tile, hot = good_tiles(number)
        at, left, right = (tile[k][hot].astype(np.int64) for k in ("at", "left", "right"))
        least = np.maximum(0, TILE - 1 - right)
        n = np.maximum(0, left - least + 1)
        start = np.unique(np.repeat(at, n) - ragged(least, n))
        return start, batch.hashes(start, start + window)

    def windows(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        _, keys = hot_windows(number, Batch(rows.column(text_at)))
        distinct, counts = np.unique(keys, return_counts=True)
        yield pack_keys(number, distinct, np.zeros(len(distinct), dtype=bool), counts > 1, buckets, 64)

    single = exchange(each(frozen, windows, PACKED))

    def repeated(number: int, column: pa.Array) -> tuple[Batch, np.ndarray, np.ndarray]:
        batch = Batch(column)
        change = np.zeros(batch.size + 1, np.int32)
        cell, same, _ = judged(number)
        np.add.at(change, cell["first"][same], 1)
        np.add.at(change, cell["last"][same] + window, -1)
        tile, hot = good_tiles(number)
        tile = {k: v[~hot] for k, v in tile.items()}
        one, which, _ = distinct_strings(tile)
        starts = []
        if len(one):
            masks = np.concatenate([np.frombuffer(m, np.uint16) for m in solved.of(number).sort_by("bucket").column("masks").to_pylist()])[which]
            starts += [tile["at"][masks >> j & 1 == 1].astype(np.int64) - j for j in range(TILE)]
        start, keys = hot_windows(number, batch)
        distinct, which = np.unique(keys, return_inverse=True)
        starts.append(start[single.of(number, len(distinct))[0][which]])
        for s in starts:
            np.add.at(change, s, 1)
            np.add.at(change, s + window, -1)
        passage = _unpack(tiled.of(number), _PASSAGE)
        distinct, which = np.unique(passage["key"], return_inverse=True)
        start = passage["start"][shared_passages.of(number, len(distinct))[0][which]].astype(np.int64)
        return batch, np.cumsum(change[:-1]) > 0, covered(batch.size, start, PASSAGE)

    return frozen, repeated


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes of every row of docs.

    Null text is empty; repeated rows are each other's copies and lose all they have from `window` bytes on; shorter
    texts stay whole; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    frozen, repeated = repeated_bytes(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), window)

    def run(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        batch, gone, shared = repeated(number, rows.column(1))
        data, bounds = batch.bytes(), batch.bounds
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[bounds[:-1][bounds[:-1] < batch.size]] |= gone[bounds[:-1][bounds[:-1] < batch.size]]
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
        n_spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[bounds])
        n_passage = np.diff(np.concatenate([[0], np.cumsum(shared)])[bounds])
        digests = []
        for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), n_removed.tolist()):
            digests.append(hashlib.sha256(data[a:b] if not n else data[a:b][~gone[a:b]]).hexdigest())
        yield {"doc_id": rows.column(0), "n_bytes": np.diff(bounds), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digests, "n_passage_bytes": n_passage}

    return each(frozen, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
