import random

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import mixing as M


def corpus(n=900, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeghilnorstu") for _ in range(r.randrange(3, 8)))
    docs, labels = [], []
    for i in range(n):
        kind = r.choices(["clean", "junk", "odd"], [8, 3, 2])[0]
        words = [word() for _ in range(r.randrange(20, 60))]
        if kind == "junk":
            words = [w + "###" for w in words]
        if kind == "odd":
            words = [r.choice(["zqxjk", "(Zqxjky", "vvkkq"]) if r.random() < 0.3 else w for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, kind))
    return docs, labels


def test_rates_meet_targets_and_match_numpy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, rate string").repartition(4)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, domain string")
    want = {"clean": 0.7, "junk": 0.1, "odd": 0.2}
    rows = M.rated(df, known, want).collect()
    p = np.array([[r[f"p_{d}"] for d in want] for r in rows])
    t, rate = np.array([r["n_tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    assert [len(dict((i, x) for i, x, _ in docs)[r["doc_id"]].split()) for r in rows] == t.tolist()
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    kinds = dict(labels)
    held = [max(want, key=lambda d: r[f"p_{d}"]) == kinds[r["doc_id"]] for r in rows if r["doc_id"] % 2 == 0]
    assert np.mean(held) > 0.95
    totals = (p * (t * rate)[:, None]).sum(0) / t.sum()
    assert np.allclose(totals, list(want.values()), atol=1e-4)
    # plain projected gradient descent, a document at a time
    mine, target = np.ones(len(t)), np.array(list(want.values())) * t.sum()
    h = (p * t[:, None]).T @ p
    for _ in range(4000):
        mine = np.maximum(0, mine - p @ ((p * (t * mine)[:, None]).sum(0) - target) / (np.trace(h)))
    assert np.allclose(mine, rate, atol=0.02)


def test_copies_realise_rates(spark):
    rates = (1.32, 0.97, 0.04, 0.0, 2.0)
    row = spark.range(200_000).select(*(M.copies(F.lit(r), "id").alias(f"c{k}") for k, r in enumerate(rates))).agg(*(F.avg(f"c{k}") for k in range(len(rates)))).first()
    assert all(abs(x - r) < 0.005 for x, r in zip(row, rates, strict=True))
    nulls = spark.createDataFrame([(None, str(k)) for k in range(1000)], "id long, text string")
    assert 300 < nulls.where(M.copies(F.lit(0.4), "id", "text") > 0).count() < 500


def test_infeasible_targets_and_rest(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([3, 1, 0.3], 400)
    t = r.integers(1, 50, 400).astype(float)
    cells = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "t double, p_0 double, p_1 double, p_2 double").coalesce(1)
    ps = [F.col(f"p_{i}") for i in range(3)]
    off = lambda x, target: (p * (t * x)[:, None]).sum(0) - target
    for share, reached in (([0.8, 0.15, 0.05], True), ([1.0, 0.0, 0.0], False)):
        target = np.array(share) * t.sum()
        fit = M.solve(cells, 3, target.tolist())
        assert fit.at_rest
        got = np.array([x[0] for x in cells.select(fit.rate(ps)).collect()])
        assert (got >= 0).all() and np.allclose(off(got, target), fit.off, atol=1e-6 * t.sum())
        assert (np.abs(fit.off).max() < 1e-4 * t.sum()) == reached
        assert (np.array(fit.off) ** 2).sum() < 0.1 * (off(np.ones(len(t)), target) ** 2).sum()
    assert not M.solve(cells, 3, (np.array([0.8, 0.15, 0.05]) * t.sum()).tolist(), rounds=0).at_rest


def test_posteriors_match_brute_force(spark):
    """Naive Bayes over the buckets, counted again by hand."""
    docs, labels = corpus(300, 3)
    df, known = spark.createDataFrame(docs, "doc_id long, text string, x string"), dict(x for x in labels if x[0] % 2)
    domains = ["clean", "junk", "odd"]
    labelled = spark.createDataFrame(list(known.items()), "id long, domain string")
    chosen = df.select(F.col("doc_id").alias("id"), "text").join(labelled, "id")
    telling = M.lexicon(df.select(F.col("doc_id").alias("id"), "text").join(labelled, "id"), domains)
    total = sum(known.get(i) is not None for i, *_ in docs)
    held = {d: [{w[:4] for w in t.lower().replace("(", "").split()} for i, t, _ in docs if known.get(i) == d] for d in domains}
    for d in domains:
        every, want = [s for v in held.values() for s in v], []
        for w in set().union(*every):
            own, n, whole = sum(w in s for s in held[d]), len(held[d]), sum(w in s for s in every)
            share = (whole + 1) / (total + 2)
            if own >= 3 and (own / n - (whole - own) / (total - n)) / np.sqrt(share * (1 - share) * (1 / n + 1 / (total - n))) > 5:
                want.append(w)
        assert sorted(want) == telling[d]
    made, buckets = M.features(df, telling, ["doc_id"])
    rows = [r.asDict() for r in made.collect()]
    of = {d: [r for r in rows if known.get(r["doc_id"]) == d] for d in domains}
    got = {r["doc_id"]: r for r in M.rated(df, labelled.withColumnRenamed("id", "doc_id"), dict.fromkeys(domains, 1 / 3)).collect()}
    for r in rows[:60]:
        logs = []
        for d in domains:
            log = np.log((len(of[d]) + 1) / (total + 3))
            for k, size in buckets.items():
                log += np.log((sum(x[k] == r[k] for x in of[d]) + 0.5) / (len(of[d]) + 0.5 * size))
            logs.append(log)
        p = np.exp(np.array(logs) - max(logs))
        assert np.allclose(p / p.sum(), [got[r["doc_id"]][f"p_{d}"] for d in domains], atol=1e-9)


def test_other_columns_do_not_matter(spark):
    docs, labels = corpus(200, 4)
    names = ["n_tokens", "rate", "row", "key", "body", "_id", "_text", "f_words", "drawn", "p_clean"]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t, _ in docs], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = M.mixed(df, spark.createDataFrame(labels, "doc_id long, domain string"), {"clean": 0.95, "junk": 0.05}, "clean")
    assert out.columns == df.columns and 0 < out.count() < len(docs) and out.join(df, df.columns, "left_semi").count() == out.count()


def test_plan_has_no_python(spark):
    docs, labels = corpus(60)
    out = M.rated(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, domain string"), {"clean": 0.9, "junk": 0.1})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, "clean"), (None, "junk"), (2, None), (3, "else")], "doc_id long, domain string")
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "b " * 50_000), (2, "b")], "doc_id long, text string")
    weights = {"clean": 0.5, "junk": 0.5}
    got = M.rated(docs, labels, weights).collect()
    assert len(got) == 5 and all(r["rate"] >= 0 for r in got)
    assert M.rated(docs.limit(0), labels, weights).count() == 0
    assert all(abs(r["p_clean"] - 0.5) < 1e-9 and abs(r["rate"] - 1) < 1e-6 for r in M.rated(docs, labels.limit(0), weights).collect())
    assert M.mixed(docs, labels, weights, "clean").columns == docs.columns


def test_realised_token_totals_meet_targets_at_small_rates(spark, tmp_path):
    r = random.Random(3)
    marks, docs, labels = {"clean": "", "junk": "###", "toxic": "zqx"}, [], []
    for i in range(8000):
        kind = r.choices(list(marks), [35, 40, 25])[0]
        docs.append((i, " ".join(marks[kind] + "".join(r.choice("abdeghilnorstu") for _ in range(6)) for _ in range(20))))
        labels.append((i, int(kind != "junk"), int(kind == "toxic"), kind))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, kind string")
    truth.where("doc_id % 2 = 0").write.parquet(str(tmp_path / "labels.parquet"))
    rows = M.op10_mixing(spark, str(tmp_path)).join(truth.select("doc_id", "kind"), "doc_id").collect()
    share = lambda kind: sum(x["copies"] * x["n_tokens"] for x in rows if x["kind"] == kind) / sum(x["n_tokens"] for x in rows)
    rates = [x["rate"] for x in rows if x["kind"] == "toxic"]
    assert 0.03 < np.mean(rates) < 0.05
    assert abs(share("clean") - 0.96) < 0.01 and abs(share("junk") - 0.03) < 0.005 and abs(share("toxic") - 0.01) < 0.003
    known = M.labels_as_domains(truth.where("doc_id % 2 = 0"), toxic=False)
    kept = {x["doc_id"] for x in M.mixed(spark.read.parquet(str(tmp_path / "documents.parquet")), known, {"clean": 0.97, "junk": 0.03}, "clean").collect()}
    of = lambda junk: [i in kept for i, *_, kind in labels if (kind == "junk") == junk]
    assert np.mean(of(False)) > 0.99 and abs(np.mean(of(True)) - 0.03 / 0.97 * len(of(False)) / len(of(True))) < 0.012
