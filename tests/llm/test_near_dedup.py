import random

import numpy as np
import pyarrow as pa

from tarn.llm import near_dedup as N
from tarn.llm import words as W
from tarn.llm.components import components, union_find


def sequential(elements, places):
    """SuperMinHash an element at a time, over the same draws."""
    out = [2**64 - 1] * places
    for e in elements:
        perm = list(range(places))
        for k in range(places):
            drawn = np.array([e], np.uint64) + N._steps(2 * k + 1)
            at = k + int(((W.mix(drawn) >> np.uint64(32)) * np.uint64(places - k) >> np.uint64(32))[0])
            perm[k], perm[at] = perm[at], perm[k]
            value = (k << 56) | int((W.mix(drawn + N._steps(1)) >> np.uint64(8))[0])
            out[perm[k]] = min(out[perm[k]], value)
    return out


def test_signature_matches_the_sequential_algorithm():
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 0, 7, 60, 300)]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    got = N.superminhash(np.concatenate(sets), rows, len(sets), 31)
    for s, g in zip(sets, got, strict=True):
        assert g.tolist() == sequential(s.tolist(), 31)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    error = []
    for share in (0.3, 0.85):
        for _ in range(30):
            common = r.random(400) < 2 * share / (1 + share)
            a, b = base, np.concatenate([base[common], r.integers(0, 2**63, int((~common).sum())).astype(np.uint64)])
            true = common.sum() / (800 - common.sum())
            got = N.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
            error.append((got[0] == got[1]).mean() - true)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


def brute(data, least=85):
    sets = []
    for i, t in data:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = {i: i for i, _ in data if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x, (i, _) in enumerate(data):
        for y, (j, _) in enumerate(data[:x]):
            if sets[x] and sets[y] and None not in (i, j):
                k = len(sets[x] & sets[y])
                if 100 * k >= least * (len(sets[x]) + len(sets[y]) - k):
                    a, b = sorted((root(i), root(j)))
                    comp[b] = a
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(data, sets, strict=True)), key=str)


def corpus(families=12, size=25):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five", "é É", "Ⅷ é"]
    for f in range(families):
        base = [word() for _ in range(r.choice([6, 30, 120, 500]))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(0, 2 + len(t) // 25)):
                t[r.randrange(len(t))] = word()
            if f % 3 == 0:
                t += shared
            texts.append(r.choice([" ", "\n"]).join(t))
    texts += texts[20:60]
    r.shuffle(texts)
    return [(i * 3 % (4 * len(texts)) + 7, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    data = [*corpus(), (None, "one two"), (None, None), (9001, "one two"), (9001, "unlike all the other ones here"), (9002, "unlike all the other ones here")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, id long, key string")
    got = N.near_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(data)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(3000), r.randrange(3000)) for _ in range(1600)] + [(5000 + i, 5001 + i) for i in range(300)] + [(0, i) for i in range(6000, 7000)] + [(1, 1), (None, 3)]
    got = {x["u"]: x["v"] for x in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    clean = [x for x in links if None not in x]
    nodes, roots = union_find(np.array([a for a, _ in clean]), np.array([b for _, b in clean]))
    assert got == {u: v for u, v in zip(nodes.tolist(), roots.tolist(), strict=True) if u != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert N.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([t for _, t in corpus(3, 4)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    whole = pa.Table.from_batches(N._sketches([batch], 5)).to_pylist()
    monkeypatch.setattr(N.W, "slices", lambda c, f=W.slices: f(c, 300))
    assert pa.Table.from_batches(N._sketches([batch], 5)).to_pylist() == whole


def test_an_id_with_two_texts_keeps_the_links_of_each(spark):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    first, other = words("a", 104), words("u", 504)
    changed = [*first[:-1], "changed"]
    data = [(i, " ".join(t)) for i, t in ((5, first), (5, other), (7, changed), (9, words("z", 50)))]
    got = N.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(5, 100, 5), (5, 500, 5), (7, 100, 5), (9, 46, 9)]


def test_signatures_are_drawn_in_parts(monkeypatch):
    r = np.random.default_rng(6)
    sizes = [3, 400, 0, 50, 1, 900]
    elements, rows = r.integers(0, 2**63, sum(sizes)).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    whole = N.superminhash(elements, rows, len(sizes))
    monkeypatch.setattr(N, "DRAWN", 70)
    assert np.array_equal(N.superminhash(elements, rows, len(sizes)), whole)


def test_map_of_ids_loses_none(spark, monkeypatch):
    df, ids = spark.range(20_000).withColumnRenamed("id", "i"), spark.range(0, 20_000, 97)
    got = [x["i"] for x in N._among(df, "i", ids).collect()]
    assert set(range(0, 20_000, 97)) <= set(got) and len(got) < 230
    monkeypatch.setattr(N, "MAP_BITS", 8)
    assert set(range(0, 20_000, 97)) <= {x["i"] for x in N._among(df, "i", ids).collect()}
    assert N._among(df, "i", ids.limit(0)).count() == 0


def test_words_for_which_a_polynomial_has_one_value_are_two_words(spark):
    words = ["".join(two[bin(i).count("1") & 1] for i in range(4096)) for two in ("ab", "ba")]
    got = N.near_dedup(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(0, 0), (1, 1)]


def test_a_long_text_and_its_near_copy(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-500], "x"])), (3, " ".join(words[:150_000]))]
    got = N.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(1, 1), (2, 1), (3, 3)]


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "A b", 5, 6, 7), (None, "a b", 5, 6, 7)], "doc_id long, text string, _gone int, gone int, comp int")
    kept = N.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "None"]
