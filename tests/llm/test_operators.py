"""Each operator over Spark against brute force, on a table with nulls, empty and long texts, copies, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from quadsmith.llm import anchors, language, ogg, packing, pieces, quality, queries, secrets, simhash, suffixes, tokens
from quadsmith.llm.batches import ROW_BITS, Store, freeze
from quadsmith.llm.common import TOKENIZERS, tokenizer_file

random.seed(11)
VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "é")]


def prose(n, rng=random):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(random.randint(20, 300)) for _ in range(25)]
    shared, long_shared = prose(60), prose(120)
    texts = [None, "", "   \n\t", "a", "...", "日本語", base[0], base[0], base[1] + " tail", base[1], base[2].replace("ban", "BAN", 1), base[2]]
    texts += [f"{base[i]} {shared} {base[i + 1]}" for i in range(3, 8)] + [f"{long_shared}\n{base[9]}", f"{base[10]} {long_shared}", long_shared]
    texts += [prose(4000), "x" * 2000, "same " * 500, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" ' + base[11], f"password: {base[12][:3]}Xy12345 {base[12]}"] + base[13:]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t) if t is not None else None, -i, "no") for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base[20], "en", None, 3, 0, "x"), (None, None, None, None, None, None, None)]


ROWS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept_sha256 string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("e") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def windows_elsewhere(units, k):
    """For each row, which units lie in a window of k that starts anywhere else too."""
    seen = Counter(tuple(u[i : i + k]) if not isinstance(u, bytes) else u[i : i + k] for u in units for i in range(len(u) - k + 1))
    out = []
    for u in units:
        flags = [False] * len(u)
        for i in range(len(u) - k + 1):
            if seen[tuple(u[i : i + k]) if not isinstance(u, bytes) else u[i : i + k]] > 1:
                flags[i : i + k] = [True] * k
        out.append(flags)
    return out


def test_op9_is_brute_force(docs):
    words = [(r[1] or "").encode().split() for r in ROWS]
    want = Counter()
    for r, w, gone in zip(ROWS, words, windows_elsewhere(words, 35)):
        want[(r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    assert rows_of(anchors.dedup_digest(docs)) == want


@pytest.mark.parametrize("hot", [False, True])
def test_op3_is_brute_force(docs, monkeypatch, hot):
    if hot:  # every core goes to the exchange of windows
        monkeypatch.setattr(suffixes, "HOT_PLACES", 1)
    data = [(r[1] or "").encode() for r in ROWS]
    want = Counter()
    for r, b, gone in zip(ROWS, data, windows_elsewhere(data, 400)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(r[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    made = suffixes.dedup_digest(docs)
    assert rows_of(made.drop("n_passage_bytes")) == want
    for r, b, gone in zip(ROWS, data, windows_elsewhere(data, 256)):
        found = [x["n_passage_bytes"] for x in made.where(made["doc_id"] == r[0]).collect()] if r[0] is not None and not hot else []
        assert all(x <= sum(gone) for x in found) and (sum(gone) < 600 or len(set(b)) < 9 or all(found))


def test_op2_counts_no_lines_of_one_hash():
    import numpy as np

    line = "a"
    while len(line) < 1024:
        line += line.translate({97: 98, 98: 97})
    text = f"{line}\n{line.translate({97: 98, 98: 97})}\n{line}".encode()
    got = quality.measure(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert got["n_dup_lines"].tolist() == [1] and got["n_words"].tolist() == [3]


def brute_classes():
    sets = []
    for r in ROWS:
        w = (r[1] or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(ROWS)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ROWS)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(ROWS))]


@pytest.mark.parametrize("dense", [3000, 3])
def test_op7_is_brute_force(docs, dense):
    classes = brute_classes()
    got = [(r["doc_id"], r["class_id"]) for r in simhash.near_duplicates(docs, dense=dense).collect()]
    assert Counter(g[0] for g in got) == Counter(r[0] for r in ROWS)
    least = {}
    for r, c in zip(ROWS, classes):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], least.get(c)) for r, c in zip(ROWS, classes) if c in least and r[0] is not None)
    assert Counter(g for g in got if g[0] is not None) == want


def test_op7_compares_all_of_a_dense_prefix(spark, tmp_path):
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        words = prose(60, rng).split()
        texts += [" ".join(words), " ".join(words[:30] + ["changed"] + words[31:])]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    family = spark.read.parquet(path)
    sparse, dense = (rows_of(simhash.near_duplicates(family, trees=1, dense=n)) for n in (1000, 4))
    assert dense == sparse and len({c for _, c in sparse}) < 90


def test_one_of_each_class_stays(docs):
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(brute_classes())) and set(kept[0].asDict()) == set(docs.columns)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(205, 203), (203, 209)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(21)} == {0} and {got[100 + i] for i in range(9)} == {100} and {got[i] for i in (203, 205, 209)} == {203}


def test_op1_packs_everything_once(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(tokens.WORD_BPE, TOKENIZERS))
    want = Counter()
    total = 0
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(r[0], k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    got = packing.pack(docs, shard_items=20).collect()
    assert Counter(tuple(r)[:5] for r in [(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got]) == want
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_op1_ends_on_pieces_that_fill_no_bin(spark):
    import threading

    items = spark.createDataFrame([(i, 1500) for i in range(100)], "rid long, length int")
    got = []
    run = threading.Thread(target=lambda: got.extend(packing.pack_items(items, 2048, shard_items=20).collect()), daemon=True)
    run.start()
    run.join(120)
    assert sorted(r["rid"] for r in got) == list(range(100)) and len({r["sequence_id"] for r in got}) == 100


def test_op5_counts_tokens(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(tokens.WORD_BPE, TOKENIZERS))
    library.encode_special_tokens = True
    want = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert rows_of(tokens.token_counts(docs)) == want
    import numpy as np

    np.array([5, 6, 9, 9, 7, 9, 8, 8], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").touch()
    for block in (1, 2, 3, 100):
        got = rows_of(tokens.scan_flat(spark, f"file://{tmp_path}", 9, block=block))
        assert got == Counter([("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 1), ("a.bin", 3, 2), ("b.bin", 0, 0)])


def test_op8_is_the_library_and_decodes(docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL, TOKENIZERS))
    encoded = pieces.encode(docs)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert got == Counter((r[0], tuple(library.encode(r[1] or ""))) for r in ROWS)
    texts = Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect())
    assert texts == Counter((r[0], r[1] or "") for r in ROWS)
    assert all(r["round_trip"] for r in pieces.encode_digest(docs).collect())


def test_op8_long_units_and_runs_of_spaces(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(5)
    library = SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL, TOKENIZERS))
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (61, 62, 63, 64, 300, 1500)] + ["語学" * 200, "é🧿" * 90, "=" * 700, "a" + " " * 90 + "b", " " * 40, "ininging" * 30, "x\n\n  y\t1234567,5"]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: r for r in pieces.encode_digest(spark.read.parquet(path)).collect()}
    assert [list(got[i]["ids"]) for i in range(len(texts))] == [library.encode(t) for t in texts]
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in got.values())


def test_op8_every_piece_merges_in_order_or_is_odd():
    table = pieces.PieceTable(tokenizer_file(pieces.MODEL, TOKENIZERS))
    assert table.odd and all(set(p) == {pieces.SPACE} for p in table.odd)
    rows = [("a", 0, -9.0), ("b", 1, -9.5), ("c", 2, -9.7), ("bc", 3, -3.0), ("abc", 4, -1.0), ("ab", 5, -8.0)]
    assert pieces.unmergeable(rows) == {"abc"}


def test_op8_round_trip_decodes_the_ids(spark, tmp_path, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL, TOKENIZERS))
    texts = ["a▁b", "plain \u0001 日本語 \U0001f9ff", "  two  spaces ", "", None, "Hello, world"]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in pieces.encode_digest(docs).collect()}
    assert [got[i]["round_trip"] for i in range(6)] == [False, True, True, True, True, True]
    assert [list(got[i]["ids"]) for i in range(6)] == [library.encode(t or "") for t in texts]
    right = pieces._byte_ids
    monkeypatch.setattr(pieces, "_byte_ids", lambda char, first: right(char, first + 1))
    wrong = {r["doc_id"]: r["round_trip"] for r in pieces.encode_digest(docs).collect()}
    assert not wrong[1] and wrong[5]


def test_op8_viterbi_is_the_library_on_a_unigram_model(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_file(pieces.MODEL, TOKENIZERS), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -(2 + (i * 2654435761 % 1000) / 128 + 12 / len(p.piece))
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    library = SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    path = str(tmp_path / "d")
    texts = [prose(30) for _ in range(20)] + ["Hello world, théâtre 日本語!", "", "a  b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(spark.read.parquet(path), str(tmp_path), "unigram.model").collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t) for t in texts]


def test_op8_leaves_no_shuffle_files_and_sends_messages(spark, docs):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    shuffled = lambda: set(env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = shuffled()
    pieces.encode_digest(docs)
    assert not [f for f in shuffled() - before if f.endswith(".data")]
    rows = spark.range(4000).repartition(2).selectExpr(f"(id % 3 * (1L << {ROW_BITS}) + id % 2 << 24) + id AS place", "sequence(1, int(id % 6 + 1)) AS ids")
    assert pieces.bundles(rows).groupBy("part").count().collect() and pieces.bundles(rows).count() == 6
    found = pieces.Found(rows)
    for part in range(3):
        for batch in range(2):
            mine = [i for i in range(4000) if i % 3 == part and i % 2 == batch]
            sizes, ids = found.of((part << ROW_BITS) + batch)
            assert sizes.tolist() == [i % 6 + 1 for i in mine] and ids.tolist() == [x for i in mine for x in range(1, i % 6 + 2)]
    assert len(found.of(2)[0]) == len(found.of(5 << ROW_BITS)[0]) == 0


def test_op8_groups_edges_by_sort(spark, docs, monkeypatch):
    plans = []
    monkeypatch.setattr(pieces, "Found", lambda rows, real=pieces.Found: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real(rows))
    pieces.encode_digest(docs)
    assert "SortAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0]
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"


def test_op8_keys_are_the_units():
    table = pieces.PieceTable(tokenizer_file(pieces.MODEL, TOKENIZERS))
    texts = ["", " ", "a", " a", "a ", "a b\nc\u00e9", "a  b", "a\u2581b c", "\u2581", "\u2581 a", "\t", "  "]
    for pattern in (pieces._WHOLE, pieces._PARTS):
        for t in texts:
            units = re.findall(pattern, pieces.SPACE + t.replace(" ", pieces.SPACE)) if t else []
            assert [pieces.lead_of(pattern) + k for k in pieces.keys_of(t, pattern)] == units
    assert table.pattern == pieces._WHOLE


def test_op8_counts_units_and_sorts_those_of_a_batch(spark, docs, monkeypatch):
    for most in (1 << 20, 3):
        monkeypatch.setattr(pieces, "COUNTED", most)
        got = {r["unit"]: r["n"] for r in pieces.counted(docs.select("text"), pieces._WHOLE).groupBy("unit").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        want = Counter(u for r in ROWS if r[1] for u in re.findall(pieces._WHOLE, pieces.SPACE + r[1].replace(" ", pieces.SPACE)) if len(u) <= pieces.HEAD_CHARS)
        assert got == want
    head = spark.sparkContext.broadcast(pieces.Head([], [], pieces._WHOLE))
    for row in pieces.coded(docs.select("doc_id", "text"), pieces._WHOLE, head).collect():
        assert row["rest"] == sorted(row["rest"])


def test_op8_lattice_leaves_out_ascii_characters_that_no_merge_needs(spark):
    table = pieces.PieceTable(tokenizer_file(pieces.MODEL, TOKENIZERS))
    units = spark.createDataFrame([("\u2581q\u00e9z",)], "unit string")
    single = {(r["at"], r["piece"]) for r in pieces._lattice(units, table, ascii=False).where("size = 1").collect()}
    assert single == {(1, "\u2581"), (3, "\u00e9")}


def test_op8_shuffles_parts_that_units_share(spark, tmp_path, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL, TOKENIZERS))
    heads, tails = [prose(1) + "in" * k for k in range(15)], ["語" * (k + 1) + ".\n" + "x" * k for k in range(15)]
    words = [h + t for h in heads for t in tails] + ["🧿é", "▁▁a語", "a  語b", "語", "z" * 70 + "語" * 70]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, " ".join(words[i::4])) for i in range(4)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    sent = []
    monkeypatch.setattr(pieces, "Found", lambda rows, real=pieces.Found: sent.append(rows.count()) or real(rows))
    for small in (False, True):
        if small:  # where pairs share places there are fewer cuts, and the same ids
            monkeypatch.setattr(pieces, "PAIR_BITS", 6)
        got = {r["doc_id"]: r for r in pieces.encode_digest(docs).collect()}
        assert [list(got[i]["ids"]) for i in range(4)] == [library.encode(" ".join(words[i::4])) for i in range(4)]
        assert [got[i]["n_units"] for i in range(4)] == [len(pieces.keys_of(" ".join(words[i::4]), pieces._WHOLE)) for i in range(4)]
        assert small or sent[0] < len(words) / 1.5  # whole units are a row for every word


def test_op8_parts_are_cut_between_pairs_in_no_piece():
    import pyarrow as pa

    table = pieces.PieceTable(tokenizer_file(pieces.MODEL, TOKENIZERS))
    pairs = {p[i : i + 2] for p, _, _ in table.rows for i in range(len(p) - 1)}
    rng = random.Random(8)
    units = ["▁" + "".join(rng.choice("aein.\n$é語🧿▁Q7") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for skip in (0, 7):
        n, parts = pieces.parts_of(pa.array(units).slice(skip), pieces.beside(table.pairs))
        want = []
        for u in units[skip:]:
            at = [0, *(i for i in range(1, len(u)) if u[i - 1 : i + 1] not in pairs), len(u)]
            want.append([u[a:z] for a, z in zip(at, at[1:])])
        assert parts.to_pylist() == [p for w in want for p in w] and n.tolist() == [len(w) for w in want]
    assert pieces.parts_of(pa.array([], pa.string()), pieces.beside(table.pairs))[0].tolist() == []
    assert pieces.parts_of(pa.array(units), None)[1].to_pylist() == units


def test_op8_joins_by_one_long_and_compares(spark, monkeypatch):
    table = pieces.PieceTable(tokenizer_file(pieces.MODEL, TOKENIZERS))
    units = spark.createDataFrame([("\u2581hello",), ("\u2581\U0001f9ff",)], "unit string")
    plan = pieces.encode_units(units, table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [hash#" in plan
    right = {tuple(r) for r in pieces._lattice(units, table).select("unit", "at", "size", "piece", "id").collect()}
    ids = {p: i for p, i, _ in table.rows}
    want = {(u, a + 1, z - a, u[a:z], ids.get(u[a:z])) for u in ("\u2581hello", "\u2581\U0001f9ff") for a in range(len(u)) for z in range(a + 1, len(u) + 1) if u[a:z] in ids or z == a + 1}
    assert right == want
    hashed = pieces.F.xxhash64
    monkeypatch.setattr(pieces.F, "xxhash64", lambda *x: pieces.F.pmod(hashed(*x), pieces.F.lit(1000)))  # many texts of one hash
    assert {tuple(r) for r in pieces._lattice(units, table).where("id IS NOT NULL").select("unit", "at", "size", "piece", "id").collect()} == {w for w in want if w[4] is not None}


def test_op4_learns_and_holds_out(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "water", "bring", "house", "thing"], "fr": ["le", "château", "eau", "fenêtre", "oublier", "que"], "de": ["und", "Straße", "wasser", "über", "nicht", "haus"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i in range(300) for k in [rng.choice(sorted(words))]]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "12 34 !!", "de"), (None, "water house", None)]
    got = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[None]["held_out"] is False
    for i, _, k in rows[:300]:
        assert by[i]["lang_pred"] == k and 0 <= by[i]["score"] <= 1 and by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_op2_op6_op10_shapes(docs):
    assert quality.quality(docs).count() == ogg.media_column(docs).count() == secrets.secret_scan(docs).count() == len(ROWS)
    for r in ogg.media_column(docs, with_media=True).collect():
        payload = ogg.join(ogg.read(bytes(r["media"])))[0]
        assert len(payload) == r["payload_bytes"] and payload[: r["n_bytes"]].decode().encode() == payload[: r["n_bytes"]]
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"]


@pytest.mark.parametrize("run", [anchors.dedup_digest, suffixes.dedup_digest, simhash.near_duplicates, packing.pack, tokens.token_counts, pieces.encode_digest, language.language_id, quality.quality, ogg.media_column, secrets.secret_scan])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_pipeline_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_redaction", "packing"]
    one = stages["language_id"](spark, docs, "")
    assert one.columns == docs.columns
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(r[0] for r in ROWS if r[1] and any(c.isalpha() for c in r[1]))
    clean = stages["secret_redaction"](spark, docs, "")
    for r in clean.collect():
        assert "f33e61083db5dbdf" not in (r["text"] or "") and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    cut = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, docs, "").collect()}
    words = [(r[1] or "").encode().split() for r in ROWS]
    for r, w, gone in zip(ROWS, words, windows_elsewhere(words, 35)):
        if r[0] is not None:
            assert cut[r[0]] == (b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else r[1])


def test_queries_cover_the_ten():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_heaps_are_given_back_between_stages(spark, docs):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Copy" not in b.getName() and "Concurrent" not in b.getName())
    before = full()
    freeze(docs)
    assert full() > before


def test_a_task_reads_the_rows_about_its_batches_once(spark, monkeypatch):
    import pyarrow.parquet as pq

    kept = Store(spark.range(6).selectExpr("id AS batch", "10 * id AS x").repartition(3))
    reads = []
    monkeypatch.setattr(pq, "read_table", lambda *a, read=pq.read_table, **k: reads.append(a) or read(*a, **k))
    assert [kept.of(i).column("x").to_pylist() for i in range(6)] == [[10 * i] for i in range(6)]
    assert kept.of(1 << ROW_BITS) is None
    assert len(reads) == 1


def test_op7_plants_a_dense_prefix_once(spark):
    reps = spark.range(300).selectExpr("id AS rid", "9L AS n", "5L AS s1", "6L AS s2")
    groups = simhash._groups(reps, 2, 13, 100)
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert groups.select("rid").distinct().count() == 300
