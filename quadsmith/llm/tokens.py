"""Token ids of whole texts, and token counts from flat files.

`WordTokenizer` gives exactly what the tokenizer file gives, but asks the library only for words it doesn't remember (and
for words of letters that no step before the model changes, only the library's model): the
word-level BPE never looks across ASCII white space, nor from letters to signs, so a text's ids are its parts' in a row.

Separator scan: flat files hold ids (little-endian, fixed width) of documents, each ended by a separator, and nothing
else: no index and no lengths. Files are read in blocks, each block's separators are found by one vectorised comparison,
and a prefix scan over the blocks (tokens so far, separators so far, place of the last separator so far) stitches the
documents that cross block boundaries.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import ragged, text_slices, word_bounds
from .common import KEPT, TOKENIZERS, bounded, map_batches, release, shared_dir, tokenizer_file, written

WORD_BPE = "word_bpe_49k.json"
END_OF_TEXT = 49407
BLOCK_TOKENS = 1 << 22
KIND = "tokens"
_LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(128)] + [True] * 128)
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_WHOLE = np.array([chr(i) in "0123456789'<" for i in range(256)])  # contractions, digits and special tokens
#: Words that nothing but the model changes: lower case, one word to the pre-tokenizer, composed.
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: The characters that stand for bytes in the model.
_SIGNS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(_SIGNS)))}


def apart(buf: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a space between letters and signs, which the pre-tokenizer separates too, letters in lower case.

    Words of anything but ASCII signs, ASCII letters and Latin-1 letters stay as they are.
    """
    starts, ends, _ = word_bounds(buf, offs)
    lead = np.zeros(len(buf) + 1, dtype=bool)
    lead[:-1] = buf == 0xC3
    second = np.concatenate([[False], lead[:-2]]) & (buf != 0x97) & (buf != 0xB7) if len(buf) else np.zeros(0, dtype=bool)
    whole = _WHOLE[buf] | ((buf >= 128) & ~second & ~(lead[:-1] & np.append(second[1:], False)))
    total = np.concatenate([[0], np.cumsum(whole, dtype=np.int32)])
    plain = total[ends] == total[starts]
    change = np.zeros(len(buf) + 1, np.int8)
    change[starts[plain]] = 1
    change[ends[plain]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    low = buf + np.uint8(32) * (inside & (_UPPER[buf] | (second & (buf <= 0x9E))))
    letter = _LETTER[buf]
    cut = np.flatnonzero((letter[1:] != letter[:-1]) & inside[1:] & inside[:-1]) + 1
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[starts] = True
    cut = cut[~first[cut]]
    return np.insert(low, cut, 32).tobytes(), offs + np.searchsorted(cut, offs)


class WordTokenizer:
    """Ids of texts by a tokenizers file whose pre-tokenizer always splits at white space."""

    def __init__(self, path: str, special: bool = True, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.splitter = Tokenizer.from_file(path)  # here the end-of-text string is a special token, hence a separator
        self.mark = self.splitter.id_to_token(END_OF_TEXT)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, dtype=bool)  # met in a later call than the first
        self.used = 0

    def forget(self) -> None:
        """Keep the words met again since the last time, half the limit at most: most others never come back."""
        own = np.flatnonzero(self.again[: len(self.index)])[: self.limit // 2]
        words = list(self.index)
        kept, lengths = [words[i] for i in own.tolist()], self.lengths[own]
        ids = self.ids[ragged(self.starts[own], lengths)]
        self.clear()
        self._store(kept, lengths, ids)

    def _ask(self, words: list[bytes]) -> None:
        simple, plain, odd = [], [], []
        for w in words:
            (simple if _SIMPLE(w) else odd if b"<|" in w else plain).append(w)
        sizes, parts = [], []
        if simple:
            tokenize = self.model.tokenize
            got = [[t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTE_CHARS))] for w in simple]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter(chain.from_iterable(got), np.int64, int(sizes[0].sum())))
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            got = np.array(self.splitter.encode_batch_fast([self.mark.join(w.decode() for w in part) + self.mark], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(got == END_OF_TEXT)
            sizes.append(np.diff(cut, prepend=-1) - 1)
            parts.append(got[got != END_OF_TEXT])
        for w in odd:
            got = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.int64)
            sizes.append(np.array([len(got)]))
            parts.append(got)
        if sizes:
            self._store(simple + plain + odd, np.concatenate(sizes), np.concatenate(parts))

    def _store(self, words: list[bytes], size: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.index)
        while n + len(size) > len(self.starts):
            self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.starts, self.lengths, self.again))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(size)] = size
        self.starts[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + len(size))))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts buf[offs[i]:offs[i+1]], and each text's first place in them (one more than texts)."""
        if len(self.index) > self.limit:
            self.forget()
        raw, offs = apart(buf, offs)
        words: list[bytes] = []
        counts = np.zeros(len(offs), np.int64)
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            words += raw[a:b].split()
            counts[i + 1] = len(words)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = at < 0
        self.again[at[~new]] = True
        if new.any():
            new = np.flatnonzero(new)
            missed = [words[i] for i in new.tolist()]
            self._ask(sorted(set(missed)))
            at[new] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged(self.starts[at], lengths)], ends[counts]


def tokenizer(path: str, special: bool = True) -> WordTokenizer:
    """The worker's own tokenizer, kept between batches and between tasks of this kind."""
    have = KEPT.get(KIND)
    if have is None or have[0] != (path, special):
        have = KEPT[KIND] = ((path, special), WordTokenizer(path, special))
    return have[1]


def write_flat(docs: DataFrame, folder: str, tokenizers: str = TOKENIZERS, separator: int = END_OF_TEXT) -> DataFrame:
    """Write the ids of all texts as flat 16-bit files, one a task, each text ended by `separator`.

    Returns the manifest (file, ordinal, doc_id), written too: files of attempts that failed are in no row. A special
    token's string in a text is ordinary text, so that no text holds the separator. Null text has no ids.
    """
    path = tokenizer_file(WORD_BPE, tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        release(KIND)
        tok = tokenizer(path, special=False)
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place)
        name = f"{uuid.uuid4().hex}.bin"
        n = 0
        with store.open_output_stream(f"{place}/{name}") as out:
            for batch in batches:
                for a, b, buf, offs in text_slices(batch.column(1)):
                    ids, cut = tok.encode(buf, offs)
                    out.write(np.insert(ids, cut[1:], separator).astype("<u2").tobytes())
                count = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * count, pa.string()), pa.array(np.arange(n, n + count)), batch.column(0).cast(pa.int64())], names=["file", "ordinal", "doc_id"])
                n += count

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return written(bounded(columns).mapInArrow(run, "file string, ordinal long, doc_id long"))


def scan_flat(spark: SparkSession, folder: str, separator: int = END_OF_TEXT, dtype: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the folder's .bin files; a last one without separator counts too.

    A file whose size is no multiple of the width of an id is an error. An empty file has no documents.
    """
    from pyarrow import fs

    width = np.dtype(dtype).itemsize
    store, place = fs.FileSystem.from_uri(folder)
    infos = [i for i in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if i.base_name.endswith(".bin")]
    if bad := [i.base_name for i in infos if i.size % width]:
        raise ValueError(f"cut short: {bad[:5]}")
    files = spark.createDataFrame([(i.base_name, i.size // width) for i in infos], "file string, size long")
    blocks = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {block}"))).alias("block"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        store, place = fs.FileSystem.from_uri(folder)
        for name, size, k in zip(*(c.to_pylist() for c in batch.columns)):
            n = min(block, size - k * block)
            with store.open_input_file(f"{place}/{name}") as f:
                f.seek(k * block * width)
                ids = np.frombuffer(f.read(n * width), dtype)
            at = np.flatnonzero(ids == separator)
            yield {
                "file": [name],
                "block": [k],
                "n": [n],
                "n_sep": [len(at)],
                "first_sep": [k * block + int(at[0]) if len(at) else None],
                "last_sep": [k * block + int(at[-1]) if len(at) else None],
                "inner": [(np.diff(at) - 1).tolist()],
            }

    found = map_batches(blocks.repartition(F.col("file"), F.col("block")).select("file", "size", "block"), run, "file string, block long, n long, n_sep long, first_sep long, last_sep long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    stitched = found.withColumns({"seps": F.coalesce(F.sum("n_sep").over(before), F.lit(0)), "open": F.coalesce(F.max("last_sep").over(before), F.lit(-1))})
    ended = stitched.where("n_sep > 0").select("file", "seps", F.posexplode(F.concat(F.array(F.expr("first_sep - open - 1")), "inner")).alias("k", "n_tokens")).select("file", (F.col("seps") + F.col("k")).alias("ordinal"), "n_tokens")
    whole = found.groupBy("file").agg(F.sum("n_sep").alias("ordinal"), (F.sum("n") - 1 - F.coalesce(F.max("last_sep"), F.lit(-1))).alias("n_tokens"))
    return ended.unionByName(whole.where("n_tokens > 0"))


def token_counts(docs: DataFrame, folder: str | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens: texts are written as flat token files and counted from those files alone.

    Null and empty texts have 0 tokens; repeated rows and null ids keep a row each; an empty table gives no rows; other
    columns, of whatever names, are not read. Both sides of the join grow with the table, hence neither is broadcast.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    manifest = write_flat(docs, folder, tokenizers)
    counts = scan_flat(spark, folder)
    return manifest.join(counts.hint("shuffle_merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
