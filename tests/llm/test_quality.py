import random

import numpy as np
import pytest

from tarn.llm import quality as Q


def brute(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def fixture():
    r = random.Random(3)
    vocab = ["a", "bé", "cc#", "|", "ññ", "x y", "D\x1cE"]
    texts = [None, "", " ", "\n\n", "a", "a\nb\na\n \n ", "a b c d e f g h a b c d e f g h", "x " * 9, "é" * 5000]
    texts += ["".join(r.choice(vocab) + r.choice([" ", "\n", "\t", "  ", "\r\n"]) for _ in range(r.randrange(60))) for _ in range(60)]
    texts += ["w " * 3 + "\n" + " ".join(f"t{i % 40}" for i in range(3000))]
    return texts


def test_measures_match_brute_force(spark):
    texts = fixture()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept long")
    got = {r["doc_id"]: r for r in Q.quality(docs).collect()}
    for i, t in enumerate(texts):
        want, r = brute(t), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_small_slices_give_the_same(monkeypatch):
    import pyarrow as pa

    from tarn.llm import words as W

    column = pa.array(fixture())
    whole = [Q.measure_slice(s) for s in W.slices(column)]
    parts = [Q.measure_slice(s) for s in W.slices(column, 50)]
    for k in Q.MEASURES:
        assert np.array_equal(np.concatenate([x[k] for x in whole]), np.concatenate([x[k] for x in parts]))


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.8
    good, bad = np.array([0.97, 0.9, 0.95, 0.85]), np.array([0.8, 0.6, 0.7, 0.75])
    votes = np.where(r.random((20000, 4)) < np.where(y[:, None], good, bad), y[:, None], ~y[:, None]).astype(int)
    votes[r.random((20000, 4)) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = Q.label_model(patterns, counts.astype(float), rounds=500)
    assert np.abs(found.good - good).max() < 0.04 and np.abs(found.bad - bad).max() < 0.08 and abs(found.balance - 0.8) < 0.04


def em(votes, rounds=200):
    """The same a document at a time: posteriors."""
    rules = range(len(votes[0]))
    likely = [(v.count(1) + 1) / (v.count(1) + 3 * v.count(0) + 2) for v in votes]
    for _ in range(rounds):
        good = [(8 + sum(p for v, p in zip(votes, likely, strict=True) if v[k] == 1)) / (10 + sum(p for v, p in zip(votes, likely, strict=True) if v[k] is not None)) for k in rules]
        bad = [(3 + sum(1 - p for v, p in zip(votes, likely, strict=True) if v[k] == 0)) / (10 + sum(1 - p for v, p in zip(votes, likely, strict=True) if v[k] is not None)) for k in rules]
        balance, now = (sum(likely) + 8) / (len(votes) + 10), []
        for v in votes:
            x, y = balance, 1 - balance
            for k in rules:
                if v[k] is not None:
                    x, y = x * (good[k] if v[k] else 1 - good[k]), y * (1 - bad[k] if v[k] else bad[k])
            now.append(x / (x + y))
        likely = now
    return likely, good, bad


def test_posteriors_and_verdicts_match_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(3, 8)))
    texts = []
    for k in range(150):
        line = lambda: " ".join(word() for _ in range(r.randrange(5, 25)))
        text = "\n".join(line() for _ in range(r.randrange(1, 8)))
        texts.append([text, text, text.upper() + "!!", " ".join(w + r.choice(["#$", "%%"]) for w in text.split(" ")), "\n".join([line()] * 4), text + "\n" + text][k % 6])
    data = [(i, t) for i, t in enumerate([*texts, None, "", *fixture()[:20]])] + [(None, texts[0]), (3, texts[3]), (3, texts[3])]
    rows = Q.quality(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(data) and sum(x["doc_id"] is None for x in rows) == 1 and sum(x["doc_id"] == 3 for x in rows) == 3
    votes = [[x[f"vote_{k}"] for k in Q.default_rules()] for x in rows]
    likely, good, bad = em(votes)
    for x, p in zip(rows, likely, strict=True):
        assert abs(x["posterior"] - p) < 1e-6 and x["kept"] == (not x["base_failed"] and x["posterior"] >= 0.5)
    assert all(0.01 < x < 0.9999 for x in [*good, *bad])
    assert len({tuple(x)[1:] for x in rows if x["doc_id"] == 3}) == 2


def test_lines_for_which_a_polynomial_has_one_value_are_two_lines(spark):
    lines = ["".join(two[bin(i).count("1") & 1] for i in range(8192)) for two in ("ab", "ba")]
    rows = Q.quality(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([lines[0]] * 2))], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["n_dup_lines"] for x in rows} == {1: 0, 2: 1}


def test_empty_table(spark):
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_verdicts_against_labels(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    rows = Q.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.04 * len(bad)
    votes = [c for c in rows[0].asDict() if c.startswith("vote_")]
    outvoted = [r for r in rows if r["kept"] and any(r[c] == 0 for c in votes)]
    assert outvoted and sum(r["quality"] for r in outvoted) >= 0.5 * len(outvoted)
