"""Language ID by cross-parsing entropy.

For every language a suffix automaton of labelled text is built; a text is parsed greedily into the longest phrases that
occur in that text, each phrase starting where the last one ended. The language that needs the fewest phrases a byte
wins (the Ziv-Merhav estimate of cross entropy, up to a factor all languages share).

Fitting takes a bounded sample: at most `SAMPLE_ROWS` labelled rows a language, chosen by hash among those of at most an
eighth of `SAMPLE_BYTES`, whole texts as long as they hold together no more than `SAMPLE_BYTES`. Parsing covers whole
texts, each in one run: segments of `SEGMENT` bytes are parsed side by side, with one table lookup a byte and language,
each as if a phrase began there; then each is parsed once more from the state that the one before it ended in, until both
parses begin a phrase at one place, from where on they are the same. Letters are lower-cased (ASCII), digits, signs and
white space are one symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ragged, text_slices
from .common import bounded, map_batches, release

SAMPLE_ROWS = 48
SAMPLE_BYTES = 32_000
SEGMENT = 256
UND = "und"
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint8)
_ASCII_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return nexts


class CrossParser:
    """The automata of all languages as one table; a negative entry ~t means: the phrase ends, the next one is in t."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        folded = {k: bytes(_FOLD[np.frombuffer(v, np.uint8)]) for k, v in texts.items()}
        symbols = sorted(set(b"".join(folded.values())))
        self.width = len(symbols) + 1
        self.code = np.zeros(256, np.uint8)  # symbol 0: in no language
        self.code[symbols] = np.arange(1, self.width)
        self.code = self.code[_FOLD]
        tables, self.roots, base = [], [], 0
        for language in self.languages:
            nexts = suffix_automaton(folded[language])
            unknown = base + len(nexts)  # after a symbol in no text, which is a phrase by itself
            root = np.full(self.width, unknown * self.width, np.int64)
            for c, t in nexts[0].items():
                root[int(np.searchsorted(symbols, c)) + 1] = (base + t) * self.width
            table = np.tile(~root, (len(nexts) + 1, 1))
            table[0] = root
            rows = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
            cols = np.searchsorted(symbols, np.array([c for x in nexts for c in x], np.int64)) + 1
            table[rows, cols] = (np.array([t for x in nexts for t in x.values()], np.int64) + base) * self.width
            tables.append(table.ravel().astype(np.int32))
            self.roots.append(base * self.width)
            base += len(nexts) + 1
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """[language, text]: how many phrases each text is parsed into."""
        sizes = np.diff(offs)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = ragged(np.zeros(len(sizes), np.int64), pieces)
        starts = offs[owner] + number * SEGMENT
        lengths = np.minimum(SEGMENT, offs[owner + 1] - starts)
        code = self.code[buf].astype(np.int32)
        count, ends, begins = self._apart(code, starts, lengths)
        self._carried(code, starts, lengths, number, count, ends, begins)
        return np.stack([np.bincount(owner, weights=c, minlength=len(sizes)).astype(np.int64) for c in count]) if self.languages else np.zeros((0, len(sizes)), np.int64)

    def _apart(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parse segments by themselves: phrases that begin in each, states at their ends, and whether a phrase begins at each byte."""
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(at), axis=1)
        begins = np.zeros((len(self.roots), len(code)), np.int8)
        alive = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments longer than each step
        for step in range(int(size[0]) if len(size) else 0):
            n = int(alive[step])
            here = at[:n] + step
            to = self.table[state[:, :n] + code[here]]
            ended = to >> 31
            state[:, :n] = to ^ ended
            begins[:, here] = ended
        begins = -begins
        begins[:, starts] = 1
        ends = np.empty_like(state)
        ends[:, order] = state
        count = np.add.reduceat(begins, starts, axis=1, dtype=np.int32) if len(starts) else np.zeros(state.shape, np.int32)
        return count, ends, begins

    def _carried(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray, number: np.ndarray, count: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> None:
        """Turn count and ends into those of whole texts, a round for all segments whose predecessor's end is new."""
        alone, first, total = count.copy(), ends.copy(), np.concatenate([np.zeros((len(begins), 1), np.int32), np.cumsum(begins, axis=1, dtype=np.int32)], axis=1)
        language, segment = np.nonzero(np.broadcast_to(number > 0, count.shape))
        while len(segment):
            state = ends[language, segment - 1]
            old = ends[language, segment].copy()
            met = np.full(len(segment), -1, np.int64)  # bytes parsed once more, the last of which begins a phrase in both parses
            fresh = np.zeros(len(segment), np.int32)
            open_at = np.arange(len(segment))
            for step in range(SEGMENT):
                open_at = open_at[lengths[segment[open_at]] > step]
                if not len(open_at):
                    break
                here = starts[segment[open_at]] + step
                to = self.table[state[open_at] + code[here]]
                ended = to >> 31
                state[open_at] = to ^ ended
                fresh[open_at] -= ended
                same = (ended < 0) & (begins[language[open_at], here] > 0)
                met[open_at[same]] = step + 1
                open_at = open_at[~same]
            done = met >= 0
            where = starts[segment] + np.maximum(met, 0)
            count[language, segment] = np.where(done, fresh + alone[language, segment] - (total[language, where] - total[language, starts[segment]]), fresh)
            whole = np.where(done, first[language, segment], state)
            ends[language, segment] = whole
            new = (whole != old) & (segment + 1 < len(number))
            language, segment = language[new], segment[new] + 1
            inside = number[segment] > 0
            language, segment = language[inside], segment[inside]


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> CrossParser:
    """From columns doc_id, text, lang: at most `rows` whole documents and `size` bytes of each language, by a hash of doc_id."""
    keyed = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.octet_length("text") <= size // 8)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = keyed.groupBy("lang", "doc_id").agg(F.max(F.octet_length("text")).alias("n")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows)
    picked = ids.withColumn("n", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("n") <= size)
    wanted = [r[0] for r in picked.select("doc_id").collect()]  # at most `rows` for each language
    texts: dict[str, dict[int, str]] = {}
    for r in keyed.where(F.col("doc_id").isin(wanted)).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect() if wanted else []:
        texts.setdefault(r["lang"], {})[r["doc_id"]] = r["text"]
    return CrossParser({language: b"\n".join(own[k].encode() for k in sorted(own)) for language, own in texts.items()})


def has_letter(column: pa.Array, buf: np.ndarray, offs: np.ndarray, first: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(c.isalpha() for c in column[first + int(i)].as_py())
    return out


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (how far the runner-up is behind, 0 to 1) for each row.

    Null, empty or letterless text is `und` with score 0, as is everything where no language was learned. Ties go to the
    language first in alphabetical order. With one learned language every score is 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = predict(shared.value, batch.column(1))
        return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

    columns = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(columns, run, "doc_id long, lang_pred string, score double")


def predict(parser: CrossParser, column: pa.Array) -> tuple[list[str], list[float]]:
    """Languages and scores of a column of texts."""
    names: list[str] = []
    scores: list[float] = []
    for a, b, buf, offs in text_slices(column, 1 << 20):  # as many segments side by side
        if not parser.languages:
            names += [UND] * (b - a)
            scores += [0.0] * (b - a)
            continue
        letters = has_letter(column, buf, offs, a)
        rates = parser.phrases(buf, offs) / np.maximum(1, np.diff(offs))
        best = rates.argmin(axis=0)
        ranked = np.sort(rates, axis=0)
        score = 1 - ranked[0] / np.maximum(ranked[1], 1e-9) if len(ranked) > 1 else np.ones(b - a)
        names += [parser.languages[k] if ok else UND for k, ok in zip(best.tolist(), letters.tolist())]
        scores += np.where(letters, np.clip(score, 0, 1), 0.0).tolist()
    return names, scores


def recognised(docs: DataFrame, parser: CrossParser, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with all columns, without the rows in no language; the language found replaces what `lang_col` said.

    Rows of null, empty or letterless text go; repeated rows stay; null ids stay null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        release()
        for batch in batches:
            names, _ = predict(shared.value, batch.column(text_at))
            found = pa.array(names, pa.string())
            new = batch.set_column(lang_at, batch.schema.field(lang_at), found.cast(batch.column(lang_at).type))
            yield new.filter(pa.compute.not_equal(found, UND))

    return bounded(docs).mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id's digits is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_unheld(docs: DataFrame) -> CrossParser:
    """A parser of the labelled rows that aren't held out."""
    return fit(docs.where(~held_out(docs["doc_id"])).select("doc_id", "text", "lang"))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows that aren't held out.

    Null, empty and letterless texts are `und`; ties go to the language first in the alphabet; repeated rows give equal
    rows; a null id is not held out; an empty table gives no rows; columns but doc_id, text and lang are not read.
    """
    parser = fit_unheld(docs)
    found = identify(docs, parser)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
