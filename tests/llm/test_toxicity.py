import random
import zlib

import numpy as np
import pyarrow as pa

from tarn.llm import toxicity as T
from tarn.llm import words as W


def corpus(n=1200, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeghilnorstu") for _ in range(r.randrange(2, 7)))
    out = []
    for i in range(n):
        toxic = r.random() < 0.15
        text = [word() for _ in range(r.randrange(20, 80))]
        for _ in range(3 * toxic):
            text[r.randrange(len(text))] = r.choice(["Zzvile", "zzvileness", "qqscum!", "(qqscums)"])
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_features_match_brute_force():
    texts = ["Hello, hello (World)!", "", None, "ab\n...\tcéd -x- é", "a" * 30]
    got = [set() for _ in texts]
    for s in W.slices(pa.array(texts)):
        for b, r in zip(*T.features(s), strict=True):
            got[r + s.first].add(int(b))
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".encode()
    for text, mine in zip(texts, got, strict=True):
        want = set()
        for w in (text or "").encode().lower().split():
            w = w.strip(strip)
            for n in (0, *T.PREFIXES):
                if w and (not n or len(w) > n):
                    part = np.frombuffer(w[:n] if n else w, np.uint8)
                    h = W.span_hashes(part, np.array([0]), np.array([len(part)]))
                    want.add(int(W.mix(h + np.uint64(n))[0] >> np.uint64(64 - T.BITS)))
        assert mine == want


def test_held_out_accuracy_and_folds(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 2], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    right = []
    for i, _, t in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"]:
            right.append(r["predicted"] == t)
    assert np.mean(right) > 0.97
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def small_texts(r, n, size, share):
    columns, rows = [], []
    for k in range(n):
        own = np.flatnonzero(r.random(size) < share)
        columns += own.tolist()
        rows += [k] * len(own)
    return T.Texts(np.array(columns, int), np.array(rows, int), r.integers(1, 5, n).astype(float))


def test_risk_and_gradient_match_brute_force():
    r = np.random.default_rng(1)
    texts, x = small_texts(r, 40, 6, 0.3), r.normal(0, 1, 7)
    held = [[c for c, k in zip(texts.columns, texts.rows, strict=True) if k == i] for i in range(40)]
    loss = lambda w: sum(n * np.log1p(np.exp(sum(w[c] for c in own) + w[-1])) for own, n in zip(held, texts.counts, strict=True))
    got = texts.risk(x)
    assert abs(got[0] - loss(x)) < 1e-9 and got[-1] == texts.counts.sum()
    for k in range(7):
        e = np.eye(7)[k] * 1e-5
        assert abs((loss(x + e) - loss(x - e)) / 2e-5 - got[1 + k]) < 1e-4


def test_risk_of_parts_adds_up_to_that_of_the_whole(spark):
    r = np.random.default_rng(2)
    texts, x = small_texts(r, 200, 5, 0.4), r.normal(0, 1, 6)
    rows = [([int(c) for c in texts.columns[texts.rows == k]], int(n)) for k, n in enumerate(texts.counts)]
    df = spark.createDataFrame(rows, "columns array<int>, count long").repartition(5)
    assert np.allclose(T._summed(df, T._risks, x, 8), texts.risk(x))
    assert np.allclose(T._summed(df, T._graded, x, T.GRADES), T._grades(texts, x))


def test_descent_finds_the_least_non_negative_risk():
    r = np.random.default_rng(3)
    positives, unlabelled, prior = small_texts(r, 60, 3, 0.7), small_texts(r, 400, 3, 0.25), 0.1

    def risk(x):
        p, u = positives.risk(x), unlabelled.risk(x)
        n = positives.counts.sum()
        plus = (p[0] - positives.present(3)[:-1] @ x[:-1] - n * x[-1]) / n
        return prior * plus + max(0.0, u[0] / u[-1] - prior * p[0] / n)

    x = T.descend(positives, unlabelled.risk, 3, prior, steps=300, decay=0)
    assert all(risk(x) <= risk(x + r.normal(0, 0.3, 4)) + 2e-3 for _ in range(300))


def test_class_prior():
    r = np.random.default_rng(4)
    grades = lambda p, n: np.bincount(np.clip(np.concatenate([r.normal(70, 8, int(p * n)), r.normal(20, 10, n - int(p * n))]), 0, 99).astype(int), minlength=100)
    for p in (0.05, 0.12, 0.4):
        assert abs(T.class_prior(grades(1, 4000), grades(p, 50_000)) - p) < 0.02


def test_other_columns_do_not_matter(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t, _ in rows], "doc_id long, text string, _score int, score int, row int")
    kept = T.without_toxic(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").coalesce(1)
    models = []
    for flip in (False, True):
        labels = [(i, 1 - t if flip and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in rows]
        models.append(T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "b " * 50_000), (2, "b")], "doc_id long, text string")
    assert T.toxicity(docs, labels).count() == 5
    assert T.toxicity(docs.limit(0), labels).count() == 0
    none = T.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 5 and all(r["score"] < 1e-9 for r in none)


def test_sums_travel_as_few_rows(spark):
    r = np.random.default_rng(6)
    texts, x = small_texts(r, 50, 5000, 0.002), r.normal(0, 1, 5001)
    rows = [([int(c) for c in texts.columns[texts.rows == k]], int(n)) for k, n in enumerate(texts.counts)]
    df = spark.createDataFrame(rows, "columns array<int>, count long").repartition(5)
    shared = spark.sparkContext.broadcast(x)
    assert sum(b.num_rows for b in T._risks(iter(df.toArrow().combine_chunks().to_batches()), shared)) == -(-5003 // T.PART)
    assert np.allclose(T._summed(df, T._risks, x, 5003), texts.risk(x))


def test_only_texts_go_to_python(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, t, "x" * 9) for i, t, _ in rows], "doc_id long, text string, other string")
    kept = T.without_toxic(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1 and "score(text" in plan
