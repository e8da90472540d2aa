import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tarn.llm import lm as L


def corpus(n=500, seed=0):
    r = random.Random(seed)
    speech = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    out = []
    for i in range(n):
        words = speech[i % 2]
        out.append((i, " ".join(r.choice(words[:5]) if r.random() < 0.7 else r.choice(words).upper() if r.random() < 0.9 else f"new{r.random()}" for _ in range(r.randrange(5, 60)))))
    return out + [(1000, None), (1001, ""), (1002, " \n"), (None, "a1 b1"), (3, "a1"), (1003, "é É a1 b")]


def brute(data):
    tok = lambda t: [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in data if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in data]


@pytest.mark.parametrize("block", [L.BLOCK_TOKENS, 300])
def test_counts_and_base_match_brute_force(spark, block):
    data = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, score double").repartition(3)
    rows = L.lm_scores(docs, block_tokens=block, head=12).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, rows), key=key), sorted(brute(data), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > 0.9 * sum(g[5] for g in held)  # both below zero: the model finds held-out text likelier


def small_model(seed=3, leaves=40):
    r = np.random.default_rng(seed)
    mass = np.zeros(L.LEAVES)
    mass[r.integers(0, L.START, leaves)] = r.integers(2, 50, leaves)
    mass[L.UNSEEN] = 1
    model = L.untrained(mass, seed=seed)
    for x in (*model.q, model.r):
        x[:] = r.normal(0, 0.5, x.shape)
    model.c[:] = [[0.7] * L.SIZE, [1.2] * L.SIZE]
    return model, np.flatnonzero(mass)


def test_probabilities_match_brute_force_and_sum_to_one():
    model, leaves = small_model()
    u, v = leaves[3], leaves[7]
    got = model.log_probabilities(np.full(len(leaves), u), np.full(len(leaves), v), leaves)
    assert abs(np.exp(got).sum() - 1) < 1e-5
    context = model.c[0] * model.r[u] + model.c[1] * model.r[v]
    for leaf, mine in zip(leaves.tolist(), got.tolist(), strict=True):
        want, node = 0.0, 0
        for level, bits in enumerate((L.FIRST, L.SECOND, L.THIRD)):
            rest = (L.FIRST + L.SECOND + L.THIRD) - sum((L.FIRST, L.SECOND, L.THIRD)[: level + 1])
            child = (leaf >> rest) & ((1 << bits) - 1)
            s = [float(context @ q + b) for q, b in zip(model.q[level][node], model.b[level][node], strict=True)]
            want += s[child] - math.log(sum(map(math.exp, s)))
            node = (node << bits) + child
        assert abs(mine - want) < 1e-3


def test_gradient_matches_differences():
    model, leaves = small_model(5, 12)
    trainer = L.Trainer(model, noise=3)
    r = np.random.default_rng(1)
    leaf = np.sort(r.choice(leaves[:-1], 30))
    u, v = r.choice(leaves, 30), r.choice(leaves, 30)
    noise = [{n: trainer.drawn[k][n, r.integers(0, 256, 3)] for n, _, _ in L.groups(node)} for k, (node, _) in enumerate(L.paths(leaf))]

    def objective():
        total, context = 0.0, model.context(u, v).astype(float)
        for k, (node, child) in enumerate(L.paths(leaf)):
            for x, n, c in zip(context, node, child, strict=True):
                h = lambda d: 1 / (1 + math.exp(math.log(3 * trainer.share[k][n, d]) - float(x @ model.q[k][n, d]) - float(model.b[k][n, d])))  # noqa: B023, E731
                total += math.log(h(c)) + sum(math.log(1 - h(d)) for d in noise[k][n])
        return total

    by_context, by_q, by_b = trainer.gradient(u, v, leaf, noise)
    node, child = L.paths(leaf)[1]
    for table, place, want in ((model.q[2], (*(x[4] for x in L.paths(leaf)[2]), 2), None), (model.q[0], (0, int(leaf[9] >> 11), 1), None), (model.b[1], (node[3], child[3]), None), (model.r, (v[0], 5), sum(by_context[i, 5] * ((u[i] == v[0]) * 0.7 + (v[i] == v[0]) * 1.2) for i in range(30)))):
        kept = table[place]
        values = []
        for step in (0.01, -0.01):
            table[place] = kept + step
            values.append(objective())
        table[place] = kept
        mine = want if want is not None else (by_q[2] if table is model.q[2] else by_q[0] if table is model.q[0] else by_b[1])[place]
        assert abs((values[0] - values[1]) / 0.02 - mine) < 0.02 * max(1, abs(mine))


def test_scores_of_the_next_token_sum_to_one(spark):
    words = [f"w{i}" for i in range(9)]
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(words) for _ in range(12))) for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2]
    fresh = [10_000 + k for k in range(2000) if zlib.crc32(str(10_000 + k).encode()) % 7 == 2][: 2 * len(words) + 4]
    # held-out texts "w", "unseen" and "": P(w, end) = P(w) P(end | w); and with one more word between
    tests = list(zip(fresh, [*words, "unseen", *(f"{w} w3" for w in words), "unseen w3", ""], strict=False))
    got = {x["doc_id"]: x["score"] for x in L.lm_scores(spark.createDataFrame(docs + tests, "doc_id long, text string"), head=5).collect()}
    assert all(x < 0 for x in got.values())
    assert sum(10 ** got[i] for i, _ in tests) < 1


def test_scores_match_brute_force(spark, monkeypatch):
    """Every score again, token by token, from the model that was fitted."""
    kept = {}
    monkeypatch.setattr(L, "fit", lambda *a, f=L.fit: kept.setdefault("model", kept.update(leaves=a[1]) or f(*a)))
    data = corpus(200)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in L.lm_scores(spark.createDataFrame(data, "doc_id long, text string"), head=30).collect()}
    model, leaves = kept["model"], kept["leaves"]
    tok = lambda t: [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()), None]
    counts = Counter(w for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in tok(t))
    code = lambda w: np.array([L.END if w is None else L.W.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]])
    leaf = lambda w: int(leaves.of(code(w))[0]) if counts[w] else L.UNSEEN
    mass = Counter({L.UNSEEN: 1})
    for w, c in counts.items():
        mass[leaf(w)] += c + 1
    assert {k: v for k, v in enumerate(model.mass) if v} == mass
    for i, t in data[:25] + data[-6:]:
        want, u, v = 0.0, L.START, L.START
        for w in tok(t):
            one = lambda x: np.array([x])
            want += float(model.log_probabilities(one(u), one(v), one(leaf(w)))[0]) + math.log((counts[w] + 1) / mass[leaf(w)])
            u, v = v, leaf(w)
        assert abs(got[i, len(tok(t))] - want / math.log(10)) < 1e-3 * len(tok(t))


def test_commonest_tokens_have_leaves_of_their_own():
    head = L.W.mix(np.arange(L.HEAD, dtype=np.uint64))
    leaves = L.Leaves(head)
    own, others = leaves.of(head), leaves.of(L.W.mix(np.arange(10**6, 2 * 10**6, dtype=np.uint64)))
    assert len(set(own.tolist())) == L.HEAD and not set(own.tolist()) & set(others.tolist())
    assert others.max() < L.START and len(set(others.tolist())) == L.NODES * ((1 << L.THIRD) - L.OWN) - 2


def test_a_text_longer_than_a_block(spark):
    data = [(1, "a b " * 20_000), (4, "a"), (5, "x" * 300_000)]
    rows = L.lm_scores(spark.createDataFrame(data, "doc_id long, text string"), block_tokens=1000).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == [(1, 40_001), (4, 2), (5, 2)]


def test_empty_and_untrained(spark):
    assert L.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = L.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(row)[:5] == (held, True, 3, 0, 0) and abs(row["score"]) < 1e-9 and abs(row["base_score"]) < 1e-9
