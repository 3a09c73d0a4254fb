"""Substring dedup by fixed-block anchors, over words.

The index holds every document's non-overlapping blocks of `BLOCK` words; every rolling window of as many words, in
every document, probes it. A repeat of `WINDOW` words or more holds a whole indexed block of each of its places, so
every repeat has a hit. Hits are then extended: each window of `WINDOW` words that holds a hit is compared by its word
sequence with all such windows, and the union of those found elsewhere is the union of all maximal exact repeats.

Two exchanges of packed keys do this, blocks first and windows second; texts are not shuffled. Blocks are keyed by 44
bits, which only lets too many windows through to the second exchange; windows by 64 bits, so that n windows give about
n * n / 2**65 false repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import covered, span_hashes, text_slices, window_hashes, word_bounds
from .batches import BUCKET_KEYS, PACKED, Verdicts, each, exchange, freeze, pack_keys, thaw
from .common import bounded, release, trim

WINDOW = 35
BLOCK_BITS = 44
_U = np.uint64


def block_words(window: int) -> int:
    """The longest block such that any window holds a whole one, wherever the blocks start."""
    return (window + 1) // 2


@dataclass
class Words:
    """The words of a batch: bounds in each slice of texts, hashes, and the texts' first words."""

    slices: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    hashes: np.ndarray
    texts: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> "Words":
        slices, hashes, texts, total = [], [], [np.zeros(1, np.int64)], 0
        for a, b, buf, offs in text_slices(column):
            starts, ends, first = word_bounds(buf, offs)
            hashes.append(span_hashes(buf, starts, ends))
            texts.append(first[1:] + total)
            total += len(starts)
            slices.append((a, b, buf, starts, ends))
        return Words(slices, np.concatenate(hashes) if hashes else np.zeros(0, _U), np.concatenate(texts))

    def windows(self, k: int) -> np.ndarray:
        """Starts of all windows of k words inside one text."""
        end = np.repeat(self.texts[1:], np.diff(self.texts))
        at = np.arange(len(end))
        return at[at + k <= end]


def block_keys(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all rolling windows, the distinct keys, each start's key, and for each key: is it indexed, does it stand here twice?"""
    at = words.windows(block)
    keys = window_hashes(words.hashes, block)[at] >> _U(64 - BLOCK_BITS)
    distinct, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    inside = at - np.repeat(words.texts[:-1], np.diff(words.texts))[at]
    indexed = np.bincount(which[inside % block == 0], minlength=len(distinct)) > 0
    return at, distinct, which, indexed, counts > 1


def hit_windows(words: Words, number: int, hits: Verdicts, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that hold a hit, their distinct keys, each one's key, and which keys stand here twice."""
    at, distinct, which, _, _ = block_keys(words, block)
    hit = np.zeros(len(words.hashes) + 1, np.int64)
    several, indexed, _ = hits.of(number, len(distinct))
    hit[at[(several & indexed)[which]] + 1] = 1
    total = np.cumsum(hit)
    start = words.windows(window)
    start = start[total[start + window - block + 1] > total[start]]
    keys = window_hashes(words.hashes, window, salt=1)[start]
    distinct, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return start, distinct, which, counts > 1


def repeated_words(docs: DataFrame, window: int = WINDOW, text_col: str = "text"):
    """Freeze docs; return the frozen batches and a function (number, column) -> (words, which of them are repeated)."""
    block = block_words(window)
    frozen = freeze(docs, text_col)
    size = frozen.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = 1 + size // (24 * BUCKET_KEYS)  # about 4 million keys each
    at = docs.columns.index(text_col)

    def blocks(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        _, distinct, _, indexed, twice = block_keys(Words.of(rows.column(at)), block)
        yield pack_keys(number, distinct, indexed, twice, buckets, BLOCK_BITS)

    hits = exchange(each(frozen, blocks, PACKED))

    def windows(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        _, distinct, _, twice = hit_windows(Words.of(rows.column(at)), number, hits, block, window)
        yield pack_keys(number, distinct, np.zeros(len(distinct), dtype=bool), twice, buckets, 64)

    found = exchange(each(frozen, windows, PACKED))

    def repeated(number: int, column: pa.Array) -> tuple[Words, np.ndarray]:
        words = Words.of(column)
        start, distinct, which, _ = hit_windows(words, number, hits, block, window)
        return words, covered(len(words.hashes), start[found.of(number, len(distinct))[0][which]], window)

    return frozen, repeated


def kept_words(words: Words, removed: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, words, words removed, kept words joined by one space) of every text of a batch."""
    base = 0
    for a, b, buf, starts, ends in words.slices:
        raw = buf.tobytes()
        for row in range(a, b):
            first, last = int(words.texts[row]), int(words.texts[row + 1])
            gone = removed[first:last]
            n = int(gone.sum())
            x, y = starts[first - base : last - base], ends[first - base : last - base]
            if n == 0:
                kept = b" ".join(raw[int(x[0]) : int(y[-1])].split()) if last > first else b""
            elif n == last - first:
                kept = b""
            else:
                kept = b" ".join([raw[i:j] for i, j in zip(x[~gone].tolist(), y[~gone].tolist())])
            yield row, last - first, n, kept
        base += len(starts)


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    Null text has no words; repeated rows are each other's copies and lose all their windows; texts shorter than a
    window stay whole; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    frozen, repeated = repeated_words(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), window)

    def run(number: int, rows: pa.RecordBatch) -> Iterator[dict]:
        words, removed = repeated(number, rows.column(1))
        made = [(n, k, hashlib.sha256(kept).hexdigest()) for _, n, k, kept in kept_words(words, removed)]
        yield {"doc_id": rows.column(0), "n_words": [m[0] for m in made], "n_removed": [m[1] for m in made], "kept_sha256": [m[2] for m in made]}

    return each(frozen, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs with all columns; texts that lose words hold what is left, joined by one space; others stay as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    frozen, repeated = repeated_words(docs, window, text_col)
    at, out = docs.columns.index(text_col), to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = thaw(data)
                words, removed = repeated(number, rows.column(at))
                old = rows.column(at)
                new = [kept.decode() if n else old[row].as_py() for row, _, n, kept in kept_words(words, removed)]
                del words, removed
                trim()
                yield pa.RecordBatch.from_arrays([(pa.array(new, out.field(i).type) if i == at else c).cast(out.field(i).type) for i, c in enumerate(rows.columns)], schema=out)

    return bounded(frozen.select("batch", "data")).mapInArrow(run, docs.schema)
