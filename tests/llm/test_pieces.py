import random
import struct

import numpy as np
import pytest
import sentencepiece

from tarn.llm import pieces as P

PATH = P.default_path()
TEXTS = [None, "", " ", "  ", "a", " a", "Hello  world\n foo ", "tab\there", "x" * 700, "ab" * 2000, "日本語 🙂🙂 ñandú", "  lead", "trail   ", "a▁b", "\x00\x01", "été\r\n\r\n", "                     deep", "====================", "don't", "é"]


def texts(n=300):
    r = random.Random(9)
    words = ["thntblere", "The", "Größe", "niño", "été", "MERCHANTABILITY", "x1", "...", "addEventListener", "q" * 40, "straightforward", "12345", "###"]
    return TEXTS + ["".join(r.choice(words) + r.choice([" ", " ", "\n", ", ", "  "]) for _ in range(r.randrange(30))) for _ in range(n)]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def unigram_file(pieces):
    """A model file, put together by hand."""
    out = b""
    for text, score, kind in pieces:
        out += field(1, field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))
    return out + field(2, field(3, P.UNIGRAM) + field(35, 0)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0))


def flat(model, given, method="viterbi"):
    ids, counts = model.encode(given, method)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_merges_of_a_bpe_file_equal_the_library():
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PATH), P.load(PATH)
    given = texts()
    got = flat(mine, given, "merges")
    for t, ids in zip(given, got, strict=True):
        assert ids == library.encode(t or ""), t
    for method in ("merges", "viterbi"):
        for t, back in zip(given, mine.decode(*mine.encode(given, method)), strict=True):
            assert back.decode() == library.decode(library.encode(t or "")), t


def test_viterbi_equals_the_library_on_a_unigram_file():
    r = random.Random(2)
    letters = "abcdef"
    pieces = {"▁": -3.0} | {c: -4.0 - i / 8 for i, c in enumerate(letters)}
    while len(pieces) < 400:
        body = "".join(r.choice(letters) for _ in range(r.randrange(1, 6)))
        pieces["▁" * (r.random() < 0.3) + body] = -r.randrange(20, 90) / 8 - len(body)
    data = unigram_file([("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), *((p, s, P.NORMAL) for p, s in pieces.items())])
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=data), P.Pieces(data)
    given = ["", "a", *(" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 25))) for _ in range(r.randrange(1, 12))) for _ in range(400))]
    for t, ids in zip(given, flat(mine, given), strict=True):
        assert ids == library.encode(t), t


def best_sum(pieces, text):
    best = {0: 0.0}
    for j in range(1, len(text) + 1):
        best[j] = max(best[i] + pieces.get(text[i:j], -np.inf) for i in range(max(0, j - 40), j))
    return best[len(text)]


def test_ids_have_the_greatest_sum_of_scores(monkeypatch):
    mine = P.load(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    of = dict(zip(mine.ids.tolist(), mine.scores.tolist(), strict=True))
    pieces = {library.id_to_piece(i): s for i, s in of.items()}
    given = ["thntblere Größe", "abcdefgh straight", "MERCHANTABILITY" * 30, "ab" * 300, "e" * 700, "=" * 1000]
    want = [best_sum(pieces, "▁" + t.replace(" ", "▁")) for t in given]
    for window in (P.WINDOW, 50):
        monkeypatch.setattr(P, "WINDOW", window)
        mine.forget()
        for t, ids, w in zip(given, flat(mine, given), want, strict=True):
            assert abs(sum(of[i] for i in ids) - w) < 1e-6 and library.decode(ids) == t


@pytest.mark.parametrize("method", ["viterbi", "merges"])
def test_long_and_short_units_are_cut_alike(monkeypatch, method):
    given = ["abandonmentabcab" * 3, "================" * 3, "日本語日本語" + "é" * 30]
    mine = P.load(PATH)
    want = flat(mine, given, method)
    monkeypatch.setattr(P, "LONG", 5)
    monkeypatch.setattr(P, "WINDOW", 7)
    mine.forget()
    assert flat(mine, given, method) == want


def test_a_text_of_megabytes_without_spaces(spark):
    text = "".join(random.Random(4).choice("abcdefghij") for _ in range(1_500_000)) + "é" * 10
    row = P.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert row["round_trip"]


def test_units_with_one_hash_are_told_apart(monkeypatch):
    mine = P.load(PATH)
    given = ["alpha beta", "gamma delta epsilon", "beta alpha", "a", None]
    want = flat(mine, given)
    mine.forget()
    monkeypatch.setattr(P.W, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert flat(mine, given) == want and flat(mine, given[::-1]) == want[::-1]


def test_alternating_texts_are_told_apart():
    """Texts for which a polynomial modulo 2**64 has one value."""
    mine = P.load(PATH)
    for n in (1024, 8192):
        given = ["".join(two[bin(i).count("1") & 1] for i in range(n)) for two in ("ab", "ba")]
        ids, counts = mine.encode(given)
        assert [b.decode() for b in mine.decode(ids, counts)] == given


def test_operators(spark):
    given = texts(40)
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(given)] + [(None, "a", "x", 1, 2, "y")], "doc_id long, text string, ids string, _ids int, row int, made string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = P.encode(docs, PATH, out="pieces", method="merges")
    assert rows.columns == [*docs.columns, "pieces"]
    assert all(r["pieces"] == library.encode(r["text"] or "") and r["_ids"] == 1 and r["made"] == "y" for r in rows.collect())
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in P.decode(rows, PATH, "pieces").collect())
    assert P.encode(docs, PATH).columns == ["doc_id", "text", "_ids", "row", "made", "ids"]
    checked = P.round_trip(docs, PATH)
    assert checked.count() == len(given) + 1 and checked.where("NOT round_trip").count() == 0
    assert P.round_trip(docs.limit(0), PATH).count() == 0 and P.encode(docs.limit(0), PATH).count() == 0


def test_other_normalisers_are_refused():
    with pytest.raises(ValueError):
        P.Pieces(unigram_file([("<unk>", 0.0, P.UNKNOWN), ("a", -1.0, P.NORMAL)]) + field(3, field(1, b"nmt_nfkc")))


def test_only_texts_go_to_python(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z")] * 400, "doc_id long, text string, other string").repartition(2)
    out = P.encode(docs, P.default_path()).select("doc_id", "ids")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1 and "other" not in plan.split("Scan")[0].split("ArrowEvalPython")[0]
    assert {(r["doc_id"], len(r["ids"]) > 0) for r in out.collect()} == {(1, True), (2, False), (3, False)} and out.count() == 1200
