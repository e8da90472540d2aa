import json
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarn.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "\n", "a", " a", "a ", "Hello, world!", "don't we'll I'M", "x  y", "x\ny", "x \ny", "x\n y", "x\n\ny", "x\n\n\ny\n", "a\tb", "é ü x 　y", "<|endoftext|> a<|endoftext|>", "\0 a \0b", "\0", "日本語 テキスト 🙂 🙂🙂", "a\x1cb c", "12345 678,9", "_" * 5000, "word " * 4000 + "end"]


def mixed(n=150):
    r = random.Random(1)
    out = list(TEXTS)
    for _ in range(n):
        out.append("".join(r.choice(["the", "Zürich", "x1", "...", "don't", "é", " ", "##"]) + r.choice([" ", " ", " ", "\n", "  "]) for _ in range(r.randrange(40))).strip(" \n"))
    return out


def test_pieces_give_the_ids_of_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(PATH), T.Encoder(PATH)
    texts = mixed()
    for _ in range(2):
        for t, data in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(data, np.uint16).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("cache", [T.CACHE, 10])
def test_columns_are_encoded_by_their_distinct_pieces(monkeypatch, cache):
    monkeypatch.setattr(T, "CACHE", cache)
    tokenizer, coder, learnt = Tokenizer.from_file(PATH), T.Encoder(PATH), []
    texts = [*mixed(), "a<|endoftext|>b c", "\0\0 a", "x \0", "\n\0a", " \0"]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    kept = coder.learn
    monkeypatch.setattr(coder, "learn", lambda pieces: learnt.append(len(pieces)) or kept(pieces))
    for step in (len(texts), 7):
        for at in range(0, len(texts), step):
            ids, counts = coder.columns(pa.array(texts[at : at + step]), 0)
            assert ids.tolist() == sum(want[at : at + step], []) and counts.tolist() == [len(x) for x in want[at : at + step]]
    assert sum(learnt[1:]) == 0 or cache == 10  # known pieces aren't encoded again


def test_no_python_call_is_made_for_each_piece():
    coder, calls = T.Encoder(PATH), []
    text = "".join(f"{' ' if k % 3 else chr(10)}word{k}" for k in range(20_000))
    coder.columns(pa.array(["warm up"]), 0)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        ids, _ = coder.columns(pa.array([text]), 0)
    finally:
        sys.setprofile(None)
    assert ids.tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]
    assert len(calls) < 2_000


def test_irregular_pieces_match_brute_force():
    coder = T.Encoder(PATH)
    pieces = ["", "\n", "\0", "\0\0", "\0a", "\na", "\n\0", "\n\0a", "a\0", "a\0b\0", "a\tb", "é", "x\u3000", "<|endoftext|>", "a<|endoftext|>b", "", "z"]
    irregular = lambda p: p in ("", "\n", "\0") or "\0" in p[1:] or any(c in p for c in ("\t", "\u3000", "<|endoftext|>"))
    for part in (pieces, pieces[::-1], pieces[:1], pieces[5:6], pieces[-1:], []):
        assert coder.irregular(part).tolist() == [irregular(p) for p in part]


@pytest.mark.parametrize("n", [3, T.BLOCK + 300])
def test_one_id_alone_round_trips(n):
    ids = np.full(n, 50256)
    assert np.array_equal(T.unpack(memoryview(T.pack([1], np.array([n]), ids)), 0)[2], ids)


@pytest.mark.parametrize("n", [1, 255, 256, 257, T.BLOCK - 1, T.BLOCK, 9 * T.BLOCK + 17])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 50256)
    ids[0] = 50256
    data = T.pack([None, 7], np.array([1, n - 1]), ids)
    got_ids, counts, tokens, end = T.unpack(memoryview(data), 0)
    assert got_ids == [None, 7] and counts.tolist() == [1, n - 1] and end == len(data) and np.array_equal(tokens, ids)
    if n > 2 * T.BLOCK:
        p = np.bincount(ids) / n
        assert len(data) * 8 / n < 1.15 * -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.5


def test_ranges_are_decoded_from_their_blocks_alone(spark, tmp_path):
    r = np.random.default_rng(7)
    ids = r.integers(0, 5000, 5 * T.BLOCK + 100)
    data = bytearray(T.pack([1, 2, None], np.array([10, len(ids) - 30, 20]), ids))
    segment = T.index_of(memoryview(bytes(data)), 0)
    data[segment.first + segment.lengths[0] + 5000] ^= 1  # damages the second block
    data = memoryview(bytes(data))
    for a, b in ((0, 10), (5, 5), (0, T.BLOCK), (3 * T.BLOCK - 7, 3 * T.BLOCK + 9), (2 * T.BLOCK, len(ids))):
        assert np.array_equal(T.read_range(data, segment, a, b), ids[a:b])
    with pytest.raises(ValueError):
        T.read_range(data, segment, T.BLOCK - 1, T.BLOCK + 1)
    texts = mixed(80)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string").repartition(3)
    T.write_tokens(docs, str(tmp_path / "tokens"), PATH)
    tokenizer = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["ids"] for r in T.read_documents(spark, str(tmp_path / "tokens"), 20, 33).collect()}
    assert got == {i: [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0] for i in range(20, 34)}


def test_rows_of_one_id_have_one_order(spark):
    rows = [(1, f"text number {k % 40}") for k in range(200)] + [(0, "a"), (2, "b"), (2, None)]
    runs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + seed)
        runs.append(sorted(map(tuple, T.token_index(docs, PATH).collect())))
    assert runs[0] == runs[1] and [r[1] for r in runs[0]] == sorted(r[1] for r in runs[0])


def test_damage_is_noticed():
    ids = np.random.default_rng(1).integers(0, 1000, 100_000)
    data = bytearray(T.pack([1], np.array([len(ids)]), ids))
    data[-5000] ^= 1
    with pytest.raises(ValueError):
        T.unpack(memoryview(bytes(data)), 0)


def _in_small_files(docs):
    """Through segments of about 100 tokens and one segment a file."""
    kept = T._write, T.SEGMENTS
    try:
        T._write, T.SEGMENTS = _write_small, 1
        return T.token_index(docs, PATH)
    finally:
        T._write, T.SEGMENTS = kept


def _write_small(batches, path, end_id):
    from tarn.llm import token_files

    kept, token_files.SEGMENT_TOKENS = token_files.SEGMENT_TOKENS, 100
    try:
        yield from token_files._write(batches, path, end_id)
    finally:
        token_files.SEGMENT_TOKENS = kept


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, small):
    tokenizer = Tokenizer.from_file(PATH)
    texts = mixed()
    random.Random(2).shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(5)
    got = {r["doc_id"]: r for r in (_in_small_files(docs) if small else T.token_index(docs, PATH)).collect()}
    start = 0
    assert len(got) == len(rows)
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert T.token_index(twice, PATH).count() == 3
    assert T.token_index(twice.limit(0), PATH).count() == 0


def test_ids_over_65535(spark, tmp_path):
    path = str(tmp_path / "large.json")
    large = json.loads(Path(PATH).read_text())
    vocabulary = large["model"]["vocab"]
    added = {t["id"] for t in large["added_tokens"]}
    large["model"]["vocab"] = {piece: i if i in added or i % 2 else i + 70_000 for piece, i in vocabulary.items()}
    Path(path).write_text(json.dumps(large))
    tokenizer, texts = Tokenizer.from_file(path), ["Hello world of ids", "one\ttwo", "", None]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(want[0]) > 65_535
    coder = T.Encoder(path)
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(texts)] == want
    got = {r["doc_id"]: r for r in T.token_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 70_000).collect()}
    for i, ids in enumerate(want):
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids) + 1, zlib.crc32(np.array([*ids, 70_000], "<u4").tobytes()))
