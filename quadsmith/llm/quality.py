"""Quality rules: suffix-array repetition inside each text, beside plain counts.

The suffix array is over words, for all texts of a slice at once: prefix doubling sorts only the suffixes that still
share a prefix. Longest-common-prefix values of neighbours come from the doubling's ranks; where they reach `MIN_WORDS`
they bound the intervals of maximal repeated word sequences. The union of those sequences' spans, as a share of the
words, and the longest of them decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import covered, mix, span_hashes, text_slices, window_hashes, word_bounds
from .common import map_batches

MIN_WORDS = 8
MAX_COVERED = 0.3
MAX_LONGEST = 0.2
_U = np.uint64
_SYMBOL = np.array([chr(i) in "#*$%&|<>" for i in range(256)])


def suffix_ranks(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes (those of one text stand together by prefix) and each doubling's ranks.

    ranks[j][i] == ranks[j][k] holds just if 2**j words from i and from k are equal, inside one text.
    """
    n = len(words)
    end = np.repeat(texts[1:], np.diff(texts))
    sa = np.argsort(words, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = words[sa[1:]] != words[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, h = [rank], 1
    last = np.append(first[1:], True)
    open_at = np.flatnonzero(~(first & last))  # places in sa of suffixes that are not alone
    while len(open_at):
        i = sa[open_at]
        inside = i + h < end[i]
        second = np.where(inside, rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = (rank[i].astype(_U) << _U(32)) | second.astype(_U)
        order = np.argsort(key, kind="stable")
        key = key[order]
        sa[open_at] = i[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        new = rank.copy()
        new[i[order]] = np.maximum.accumulate(np.where(first, open_at, 0))
        rank = new
        ranks.append(rank)
        h *= 2
        last = np.append(first[1:], True)
        open_at = open_at[~(first & last)]
    return sa, ranks


def neighbour_lcp(sa: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[r]: words that suffix sa[r] shares with sa[r-1]; 0 for the first."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1
    a, b = sa[at - 1].copy(), sa[at].copy()
    got = np.zeros(len(at), np.int64)
    for j in reversed(range(len(ranks))):
        fits = (a < n) & (b < n)
        same = np.zeros(len(at), dtype=bool)
        same[fits] = ranks[j][a[fits]] == ranks[j][b[fits]]
        step = same.astype(np.int64) << j
        got += step
        a += step
        b += step
    lcp[at] = got
    return lcp


def repeats(words: np.ndarray, texts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many words lie in repeated sequences of at least `least` words, and the longest one's length."""
    sa, ranks = suffix_ranks(words, texts)
    lcp = neighbour_lcp(sa, ranks)
    longest = np.zeros(len(words), np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))  # an interval's suffixes all start its repeat
    starts = np.flatnonzero(longest >= least)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + longest[starts], -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    per_text = total[texts[1:]] - total[texts[:-1]]
    most = np.zeros(len(texts) - 1, np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(texts) - 1), np.diff(texts))[starts], longest[starts])
    return per_text, most


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of a slice of texts."""

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offs[1:]] - total[offs[:-1]]

    n = len(offs) - 1
    starts, ends, texts = word_bounds(buf, offs)
    owner = np.repeat(np.arange(n), np.diff(texts))
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = np.bincount(owner, weights=points[ends] - points[starts], minlength=n).astype(np.int64)
    salt = mix(owner.astype(_U) + _U(1))
    words = mix(span_hashes(buf, starts, ends) ^ salt)  # words of different texts differ

    # three words in a row, twice or more
    grams = window_hashes(words, 3)
    own = np.flatnonzero(owner[2:] == owner[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    _, inverse, counts = np.unique(grams[own], return_inverse=True, return_counts=True)
    in_repeat = covered(len(words), own[counts[inverse] > 1], 3)
    n_repeat = np.bincount(owner, weights=in_repeat, minlength=n).astype(np.int64)

    # lines that hold a word and equal an earlier line of the text
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    text_of = np.searchsorted(offs, line_start, side="right") - 1
    stop = np.append(breaks, len(buf))
    line_end = np.minimum(stop[np.searchsorted(breaks, line_start, side="left")], offs[text_of + 1])
    with_word = np.searchsorted(starts, line_end, side="left") > np.searchsorted(starts, line_start, side="left")
    line_start, line_end, text_of = line_start[with_word], line_end[with_word], text_of[with_word]
    lines = mix(span_hashes(buf, line_start, line_end) ^ mix(text_of.astype(_U) + _U(1)))
    _, first = np.unique(lines, return_index=True)
    dup = np.ones(len(lines), dtype=bool)
    dup[first] = False

    span_words, longest = repeats(words, texts, MIN_WORDS)
    n_words = np.diff(texts)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    share = span_words / np.maximum(1, n_words)
    repetitive = (share > MAX_COVERED) | (longest > MAX_LONGEST * n_words)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": np.bincount(text_of, weights=dup, minlength=n).astype(np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~(base_failed | repetitive),
        "covered_share": share,
        "longest_repeat": longest,
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, the base verdict, the repetition figures and `kept`.

    Null text has no words and fails the base rule; a null id stays null; repeated rows give equal rows; an empty
    table gives none; other columns are not read.
    """

    def run(batch: pa.RecordBatch):
        for a, b, buf, offs in text_slices(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(a, b - a)} | measure(buf, offs)

    columns = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(columns, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_share double, longest_repeat long")
