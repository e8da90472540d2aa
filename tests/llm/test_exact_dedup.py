import hashlib
import inspect
import random

import numpy as np

from tarn.llm import exact_dedup as E

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    r = random.Random(5)
    long = "".join(r.choice("abcdé \n") for _ in range(90_000))
    texts = [None, "", "A", "a", "É", "é", "a ", long, long.upper().translate(LOW), long + "x", "x" + long, "z" * 200_000, "Z" * 200_000, "z" * 199_999]
    out = [(i, t, "n") for i, t in enumerate(texts)]
    return out + [(3, "a", "n"), (3, "other", "n"), (None, "a", "n"), (None, "lone", "n"), (50, long, "n")]


def test_matches_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in E.exact_dedup(docs).collect()), key=str)
    norm = [(i, (t or "").translate(LOW)) for i, t, _ in data]
    want = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        known = [j for j in same if j is not None]
        want.append((i, max(known) if known else None, len(same), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    stays = E.exact_dedup(docs).where("kept").collect()
    assert len(stays) == len({t for _, t in norm}) and all(r["doc_id"] == r["keep_id"] for r in stays)
    left = E.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted((t or "").translate(LOW) for _, t, _ in left.collect()) == sorted({t for _, t in norm})


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    source = inspect.getsource(E._recipes).replace("W.span_hashes(data, starts, ends)", "np.zeros(len(starts), np.uint64)")
    scope = dict(vars(E))
    exec(source, scope)
    monkeypatch.setattr(E, "_recipes", scope["_recipes"])
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "ab" * 2000), (5, "ba" * 2000)], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in E.exact_dedup(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_shared_passages_share_chunks():
    r = random.Random(1)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(40_000))
    docs = [bytes(r.choice(b"xyz ") for _ in range(n)) + passage for n in (10, 3333)]
    chunks = []
    for d in docs:
        data, at = np.frombuffer(d, np.uint8), 0
        mine = set()
        for e in E.cut(data, np.array([0, len(d)]))[0]:
            mine.add(d[at:e])
            at = e
        assert at == len(d)
        chunks.append(mine)
    assert sum(map(len, chunks[0] & chunks[1])) > 0.7 * len(passage)


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "A", 5, 6, 7), (2, "A", 5, 6, 7), (None, "b", 5, 6, 7)], "doc_id long, text string, _stays int, key int, row int")
    left = E.without_copies(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "None"]


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
