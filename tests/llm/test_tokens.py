"""Encoding, token files, the transducer and packing against the tokenizers library and brute force."""

import hashlib
import json
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchloom.llm import cutting_stock, lexicon, packing, token_files
from patchloom.llm.tokens import Memo, PieceEncoder, byte_symbols, public_path

DOCS = "doc_id long, text string, part int, ids string, start long, file string"
TEXTS = [
    None, "", " ", "Hello World's it'll DON'T", "a  b   c \n\n d\t e ", "x<|endoftext|>y <|startoftext|>", "<|endoftext|>", "ΑΣΣ ς İstanbul ﬁ ½ á", "日本語 テスト １２３ ", "a\x1cb\x85c d e", "12ab34!!??--", "😀 hi 🇩🇪",
    "é è ü ß Ñ ǅ ŉ", "\x00\x01 \x7f", "word " * 3000, "tab\tnew\nline\r\n", "'s 's' 'S", "ab" * 4000,
]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def _rows():
    return [(7 * i % 101, t, 0, "", 0, "") for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("name", FILES)
def test_piece_encoder(name):
    own, theirs = PieceEncoder(public_path(name)), Tokenizer.from_file(public_path(name))
    for t in TEXTS:
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == theirs.encode(t or "", add_special_tokens=False).ids


def test_byte_symbols_and_memo():
    assert len(set(byte_symbols())) == 256 and byte_symbols()[ord("a")] == "a" and byte_symbols()[32] == "Ġ"
    calls = []
    memo = Memo(lambda k: calls.append(k) or k * 2, most=3)
    assert [memo[k] for k in (1, 2, 3, 1, 4, 1, 5, 1)] == [2, 4, 6, 2, 8, 2, 10, 2]
    assert calls.count(1) == 1 and len(memo) <= 3


def _transducer(words):
    return lexicon.Transducer(lexicon.compile_words(words))


def test_transducer_is_exact_and_minimal():
    words = {w.encode(): (k, k + 1) for k, w in enumerate(["tap", "taps", "top", "tops", "a", "é", "stop", "stops", "at"])}
    t = _transducer(words)
    asked = [*words, b"", b"t", b"tapss", b"zz", "è".encode()]
    ranks = t.ranks(asked)
    assert (ranks[len(words) :] == -1).all()
    assert {w: t.ids_of(r) for w, r in zip(asked, ranks.tolist(), strict=True) if r >= 0} == words
    assert sorted(ranks[: len(words)].tolist()) == list(range(len(words)))
    # Equal endings share states: minimal means that no two states accept the same endings.
    states = {}
    for s in range(len(t.ptr) - 1):
        key = (t.final[s], tuple(zip(t.label[t.ptr[s] : t.ptr[s + 1]].tolist(), t.target[t.ptr[s] : t.ptr[s + 1]].tolist(), strict=True)))
        assert states.setdefault(key, s) == s
    assert _transducer({}).ranks([b"x", b""]).tolist() == [-1, -1]


def test_transducer_from_a_mapped_file(tmp_path):
    words = {f"w{k}".encode(): (k,) for k in range(500)}
    (tmp_path / "x.bin").write_bytes(lexicon.compile_words(words))
    t = lexicon.Transducer.mapped(str(tmp_path / "x.bin"))
    assert [t.ids_of(r) for r in t.ranks(list(words)).tolist()] == list(words.values())


@pytest.mark.parametrize("known", [0, 3, 100])
def test_lexicon_encodes_and_decodes(spark, known):
    theirs = Tokenizer.from_file(public_path(FILES[1]))
    frame = spark.createDataFrame([*_rows(), (None, "null id", 0, "", 0, ""), _rows()[3]], DOCS).repartition(3)
    got = lexicon.encode_documents(frame, words=known).collect()
    assert len(got) == len(TEXTS) + 2
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in _rows():
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        r = by_id[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_lexicon_uses_the_automaton_for_frequent_words(spark):
    frame = spark.createDataFrame([(1, "one two one two one"), (2, "two three three four")], "doc_id long, text string")
    path = public_path(FILES[1])
    assert set(lexicon.frequent(lexicon.word_counts(frame, path), 10)) == {"one", "two", "three"}
    assert len(lexicon.frequent(lexicon.word_counts(frame, path), 2)) <= 2
    e = lexicon.LexiconEncoder(path, lexicon.Transducer(lexicon.build(frame, path)))
    e.encode_decode(["one two five"])
    assert (e.looked_up, e.merged) == (2, 1)


def test_token_files(spark, tmp_path):
    theirs = Tokenizer.from_file(public_path(FILES[0]))
    rows = [*_rows(), _rows()[4], (None, "no id", 0, "", 0, "")]
    out = str(tmp_path / "tokens")
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    docs = token_files.by_range(frame, per_file=4)
    token_files.encoded(docs, public_path(FILES[0])).write.options(**token_files.FORMAT).parquet(out)
    files = token_files.read(spark, out).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("k"), "doc_id", "n_tokens", "ids").collect()
    assert len({r.f for r in files}) > 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t, *_ in order:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r) for r in token_files.digests(spark, out).collect()), key=key) == want
    part = next(p for p in (tmp_path / "tokens").iterdir() if p.suffix == ".parquet" and pq.read_metadata(p).num_rows)
    meta = pq.read_metadata(part).row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    ids = next(v for k, v in columns.items() if k.startswith("ids"))
    assert "DELTA_BINARY_PACKED" in ids.encodings and columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    assert token_files.read(spark, out).where("doc_id = 7").select("n_tokens").count() == 1


def test_token_files_of_an_empty_table(spark, tmp_path):
    out = str(tmp_path / "none")
    token_files.write(spark.createDataFrame([], DOCS), out)
    assert token_files.digests(spark, out).count() == 0


def test_knapsack_and_cutting_stock():
    value, counts = cutting_stock.knapsack(np.array([3.0, 5.0, 8.0]), np.array([2, 3, 5]), 10)
    assert value == 16 and counts @ np.array([2, 3, 5]) <= 10
    rng = np.random.default_rng(0)
    for _ in range(8):
        demand = {int(c): int(n) for c, n in zip(rng.choice(np.arange(1, 24), 20, replace=False), rng.integers(1, 400, 20), strict=True)}
        basis = cutting_stock.solve(demand, 64)
        patterns = cutting_stock.round_patterns(basis, demand, 64)
        made = Counter()
        for p, n in patterns:
            assert sum(c * a for c, a in p.items()) <= 64 and n > 0
            for c, a in p.items():
                made[c] += a * n
        assert made == Counter(demand)
        least = -(-sum(c * n for c, n in demand.items()) // 64)
        assert sum(n for _, n in patterns) <= 1.03 * least + 8
    assert cutting_stock.round_patterns(cutting_stock.solve({}, 64), {}, 64) == []


def _packed(spark, rows, schema=DOCS):
    theirs = Tokenizer.from_file(public_path(FILES[1]))
    got = packing.pack(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want = Counter()
    for r in rows:
        ids = [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    sequences, texts = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault(r.doc_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return got, texts, padding, theirs


def test_packing(spark):
    rng = np.random.default_rng(4)
    rows = _rows() + [(1000 + k, " ".join(f"w{rng.integers(99)}" for _ in range(int(rng.integers(1, 2500)))), 0, "", 0, "") for k in range(150)]
    got, texts, padding, theirs = _packed(spark, rows)
    assert padding == 0
    for i, t, *_ in rows:
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for p in sorted(texts[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_repeated_null_and_no_rows(spark):
    rows = [(1, "same text", 0, "", 0, "")] * 5 + [(None, "null id", 0, "", 0, "")]
    got, *_ = _packed(spark, rows)
    assert sum(r.length for r in got if r.doc_id == 1) == 5 * got[0].doc_tokens
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_running_total(spark):
    rows = [(k, (k * 7919) % 13) for k in range(3000)]
    got = {r.at: r.before for r in packing.running_total(spark.createDataFrame(rows, "at long, v long"), "at", "v", 3000).collect()}
    total = 0
    for k, v in rows:
        assert got[k] == total
        total += v


def test_vocabulary_files_are_outside_the_repository():
    assert json.load(open(public_path(FILES[0]), encoding="utf-8"))["model"]["type"] == "BPE"
    assert "/patchloom/" not in public_path(FILES[0])


BEYOND = ["he said “hello world” — twice", "Привет, мир! Привет всем", "你好，世界 你好", "naïve café étude", "emoji 🙂🙂 ok", "mixed “Quote” and <|endoftext|> and мир", "ﬁne ligature İstanbul ſ", "　wide blank line", "àb́c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_all_texts(name):
    """Texts with any character go by the same pieces, and their ids are the library's."""
    enc = PieceEncoder(public_path(name))
    rng = random.Random(6)
    texts = BEYOND + ["".join(rng.choice(["a", "мир ", " ", "“", "é", "é", "中", "9", "\n", "<|endoftext|>", "'s", "🙂", "‍"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), dtype="<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_words_of_all_texts_are_counted_and_looked_up(spark):
    path = public_path("word_bpe_49k.json")
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(BEYOND * 2)], "doc_id long, text string")
    counted = {r["word"]: r["count"] for r in lexicon.word_counts(frame, path).collect()}
    assert counted["привет"] == 4 and counted["你好"] == 4 and counted["hello"] == 2 and counted["“"] == 4
    enc = lexicon.LexiconEncoder(path, lexicon.Transducer(lexicon.build(frame, path)))
    found = enc.encode_decode(BEYOND)
    assert enc.looked_up > 30 and not enc.merged
    for t, (ids, text) in zip(BEYOND, found, strict=True):
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert text == enc.tokenizer.decode(want, skip_special_tokens=False)


def test_ties_do_not_empty_the_lexicon(spark):
    rows = [(f"w{k}", 2) for k in range(50)] + [("often", 9)]
    counts = spark.createDataFrame(rows, "word string, count long")
    found = lexicon.frequent(counts, 20)
    assert len(found) == len(set(found)) == 20 and "often" in found
    assert found == lexicon.frequent(counts.orderBy("word", ascending=False), 20)


def test_merges_of_long_words_are_exact_and_fast():
    merges, enc = lexicon.Merges(public_path("byte_bpe_50k.json")), PieceEncoder(public_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for n in (49, 60, 200, 3000):
        for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert list(merges.encode(word)) == enc.tokenizer.encode(word, add_special_tokens=False).ids
    began = time.perf_counter()
    merges.encode("".join(rng.choice("etaoinshr") for _ in range(300_000)))
    assert time.perf_counter() - began < 15


def test_empty_table_of_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert lexicon.encode_documents(frame).count() == 0


def test_encoding_the_same_documents_twice(spark):
    frame = spark.createDataFrame([(1, "some words, some more words"), (2, "some words")], "doc_id long, text string")
    assert sorted(lexicon.encode_documents(frame).collect()) == sorted(lexicon.encode_documents(frame).collect())
