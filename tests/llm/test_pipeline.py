import os

import corpus_pipeline as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tarn.llm import mixing, pieces

SF = "/root/testdata/sf0.001"


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def last_of_equal(texts):
    """Ids that stay: of equal texts, A-Z in lower case, the largest."""
    stays = {}
    for i, t in sorted(texts.items()):
        stays[t.translate(LOW)] = i
    return sorted(stays.values())


def least_of_near(texts, least=0.8):
    """Ids that stay: the least of each group of texts linked by a Jaccard similarity of runs of five words."""
    runs = {}
    for i, t in texts.items():
        w = t.translate(LOW).encode().split()
        runs[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in runs.items():
        for j, b in runs.items():
            if i < j and a and b and 1 / least >= len(a) / len(b) >= least and len(a & b) >= least * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return sorted(i for i in texts if root(i) == i)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_each_stage_takes_effect_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        if k < len(P.STAGES) - 1:
            assert out.columns == columns and out.join(docs, columns, "left_semi").count() == out.count()
        if name == "toxicity":
            known = {r["doc_id"]: r["toxic"] for r in labels.join(docs, "doc_id").collect()}
            gone = set(texts) - set(ids(out))
            assert sum(i in gone for i, t in known.items() if t) >= 0.5 * sum(known.values())
            assert sum(i in gone for i, t in known.items() if not t) <= 0.05 * len(known)
        elif name == "exact_dedup":
            assert ids(out) == last_of_equal(texts)
        elif name == "near_dedup":
            assert ids(out) == least_of_near(texts)
        elif name == "mixing":
            domains = {"clean": 0.97, "junk": 0.03}
            rows = mixing.rated(docs, mixing.labels_as_domains(labels, toxic=False), domains, "clean", ["doc_id", "text"])
            shares = mixing.realised(rows, list(domains), F.col("rate"))
            assert abs(shares["junk"] - 0.03) < 1e-3
            # expected and drawn: within three standard deviations of tokens
            r = [(x["n_tokens"] * x["p_junk"], min(1.0, x["rate"]), x["doc_id"]) for x in rows.collect()]
            kept = set(ids(out))
            spread = sum(t * t * q * (1 - q) for t, q, _ in r) ** 0.5
            assert abs(sum(t for t, _, i in r if i in kept) - sum(t * q for t, q, _ in r)) <= 3 * spread + 1
            good = labels.join(docs, "doc_id").where("quality = 1")
            assert good.join(out, "doc_id", "left_semi").count() >= 0.97 * good.count()
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
            assert ids(out) == sorted(texts)
            assert all(library.decode(list(r["ids"])) == texts[r["doc_id"]].replace("▁", " ") for r in out.collect())
        docs = out
    assert ids(P.run(spark, SF)) == ids(docs)


def test_pipeline_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_dedup_stage_links_from_a_similarity_of_80_percent(spark):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    texts = {}
    for f, common in enumerate((80, 88, 89, 90, 91, 92, 95)):  # 100 runs of five words each, so many of them in common
        base = words(f"w{f}_", 104)
        texts[10 * f], texts[10 * f + 1] = base, [*base[: common + 4], *words(f"v{f}_", 100 - common)]
    runs = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    alike = lambda i, j: len(runs[i] & runs[j]) / len(runs[i] | runs[j])
    want = sorted(i for i in texts if i % 10 == 0 or alike(i, i - 1) < 0.8)
    assert {round(alike(i, i - 1), 2) for i in texts if i % 10 and i not in want} >= {0.8, 0.82, 0.83, 0.85} and len(want) > len(texts) // 2
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.near_dedup_stage(spark, docs, SF).collect()) == want
