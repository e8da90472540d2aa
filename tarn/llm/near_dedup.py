"""Near-duplicate detection with SuperMinHash.

A document's set is that of its distinct runs of five words, A-Z in lower case. Each element of a
set takes a random permutation of the signature's places, and its k-th place gets a value between
k and k + 1; each place of the signature keeps the least value it is given, so an element's ranks
are correlated and signatures vary less than with independent hash functions. A set stops drawing
once every place has a value that later draws can't undercut. Signatures are cut into bands;
sets that share a band are candidates; candidates whose sketches (four bits of each place), sizes or elements of
their own rule out the threshold go; the rest are compared on their full sets, and links are
grouped by union-find.

Groups of thousands that share a band are not expanded into pairs. First each set is
compared with one pivot of its bands only and linked sets merge into components; bands whose sets are all
one component are done with. Then the sets outside a band's largest component are compared with
every set of another component in that band, so no candidate pair of different components is left
out, and none is compared twice; the first bands come first, since most of the links that are left are found
there, and what they merge needn't be compared in the others. Sets that are equal (by 128 bits of digest and size) are one from the start.

Texts are read once for their sketches and, where a band of theirs is shared, once more for their
sets: a bitmap of fixed size tells which these are, so texts themselves are never shuffled.

The chance of missing a link of a similarity of 0.85: (1 - 0.85 ** 5) ** 25 = 4e-7 for all bands,
and 2e-8 for the sketch. At 0.80: (1 - 0.8 ** 5) ** 25 = 5e-5 for all bands, and 3e-5 for the sketch.

Defined cases: null or wordless text has an empty set and is linked with nothing; with under five
words, the whole sequence is the one element; rows that share an id are one document; a row
without id is linked with nothing and has no component; a very long text draws its signature in parts
of bounded size; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import words as W
from tarn.llm.common import dropped, saved, table
from tarn.llm.components import components

BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Bits of each place that a sketch keeps, and the most of the PLACES that may differ: places of unequal values do with a chance of 15 in 16.
SKETCH_BITS, SKETCH_MOST = 4, 42
#: Bands, from and to, in which sets of different components are compared, one range after the other.
RANGES = ((0, 3), (3, BANDS))
SKETCH = [f"s{k}" for k in range(2 * SKETCH_BITS)]
#: Elements that draw their values together.
DRAWN = 1 << 17
#: Bits of the map of wanted ids, as a power of two: 8 MB, whatever the corpus. The more ids, the more others pass it.
MAP_BITS = 26
#: What is known of a set wherever it is compared.
_ABOUT = ("id", "n", "own", *SKETCH, "comp")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _steps(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, rows: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n, places) of n sets. elements: distinct 64-bit hashes of each set; rows: the set of each, sorted.

    All sets draw their k-th values together, DRAWN elements at a time; values are k in the top byte, then 56 random bits.
    """
    signature = np.full(n * places, _FULL, np.uint64)
    for at in range(0, len(elements), DRAWN):
        part = rows[at : at + DRAWN]
        first, last = int(part[0]), int(part[-1]) + 1
        _draw(elements[at : at + DRAWN], part - first, last - first, places, signature[first * places : last * places])
    return signature.reshape(n, places)


def _draw(elements: np.ndarray, rows: np.ndarray, n: int, places: int, signature: np.ndarray) -> None:
    """Lower the values of n signatures, end to end, to those that the elements give them."""
    active, taken, perm = np.arange(len(elements)), None, None
    for k in range(places):
        drawn = elements[active] + _steps(2 * k + 1)
        at = np.int64(k) + (((W.mix(drawn) >> np.uint64(32)) * np.uint64(places - k)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(k) << np.uint64(56)) | (W.mix(drawn + _steps(1)) >> np.uint64(8))
        if k == 0:
            place = taken = at
        elif k == 1:  # the permutation so far: its first value and that of place `taken` have changed places
            place = np.where(at == taken, 0, at)
        else:
            line = np.arange(len(active))
            place = perm[line, at].astype(np.int64)
            perm[line, at] = perm[:, k]
        np.minimum.at(signature, rows[active] * places + place, value)
        if k == 1:
            first, second = taken, at
        full = signature.reshape(n, places).max(axis=1) < (np.uint64(k + 1) << np.uint64(56))
        going = ~full[rows[active]]
        active, taken = active[going], taken[going]
        if not len(active):
            break
        if k == 1:
            first, second, line = first[going], second[going], np.arange(len(active))
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(active), 1))
            for step, swap in ((0, first), (1, second)):
                held = perm[line, swap].copy()
                perm[line, swap] = perm[:, step]
                perm[:, step] = held
        elif k > 1:
            perm = perm[going]


def shingles(s: W.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, and their rows, sorted by row."""
    data = W.LOWER[s.data]
    starts, ends, rows = s.words()
    grams = W.ngrams(W.span_hashes(data, starts, ends), size)
    counts = np.bincount(rows, minlength=s.rows)
    last = np.cumsum(counts)[rows] if len(rows) else np.zeros(0, np.int64)
    whole = np.arange(len(rows)) + size <= last
    found, of = grams[whole], rows[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.cumsum(counts) - counts
        hashes = W.span_hashes(data, starts, ends)
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            own[has] = W.mix(own[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[begin[short[has]] + k])
        found, of = np.concatenate([found, W.mix(own + counts[short].astype(np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in W.slices(batch.column(1)):
            found, of = shingles(s, size)
            signature = superminhash(found, of, s.rows)
            edges = np.searchsorted(of, np.arange(s.rows + 1))
            digests = []
            for salt in (1, 2):  # of the whole set
                sums = np.zeros(len(found) + 1, np.uint64)
                np.cumsum(W.mix(found + _steps(salt)), out=sums[1:])
                digests.append((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
            mixed, half = W.mix(signature), PLACES // 2 + 1
            bits = [(mixed >> np.uint64(k)) & np.uint64(1) for k in range(SKETCH_BITS)]
            sketch = [(b << np.arange(b.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64) for plane in bits for b in (plane[:, :half], plane[:, half:])]
            keys = np.tile(np.array([_steps(k + 1) for k in range(BANDS)]), (s.rows, 1))
            for k in range(ROWS):
                keys = W.mix(keys + signature[:, k::ROWS])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(s.rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(np.diff(edges)), *map(pa.array, digests), *map(pa.array, sketch), bands], ["doc_id", "n_shingles", "d1", "d2", *SKETCH, "bands"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in W.slices(batch.column(1)):
            found, of = shingles(s, size)
            edges = np.searchsorted(of, np.arange(s.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.ListArray.from_arrays(pa.array(edges), pa.array(found.view(np.int64)))], ["id", "elements"])


def _may_link(least: int, a: str = "a_", b: str = "b_") -> Column:
    """By sizes, elements of their own and sketches, the similarity can be least percent.

    An element that no other set holds (own counts them) can't be common, so two sets have at most
    the lesser of n - own in common.
    """
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    most = F.least(n - F.col(f"{a}own"), m - F.col(f"{b}own"))
    return (100 * most >= least * (n + m - most)) & (_differ(a, b) <= SKETCH_MOST)


def _differ(a: str = "a_", b: str = "b_") -> Column:
    """In how many places two sketches differ."""
    by = [F.col(a + c).bitwiseXOR(F.col(b + c)) for c in SKETCH]
    return sum((F.bit_count(reduce(Column.bitwiseOR, by[half::2])) for half in (0, 1)), F.lit(0))


def _among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose column is one of ids (column id), and few others: those whose hash has its bit set in a map.

    The map is broadcast, 2 ** (MAP_BITS - 6) words at most, so df isn't shuffled.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    words = ids.select(bit("id").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    words = saved(words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")), "map")
    found = df.withColumn("bit", bit(column)).join(F.broadcast(words), F.shiftright("bit", 6) == F.col("word"))
    return found.where(F.expr("(shiftrightunsigned(bits, CAST(bit & 63 AS INT)) & 1L) = 1L")).select(*df.columns)


def _links(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have a similarity of least percent or more."""
    used = _among(sets, "id", pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    x, y = (used.select(F.col("id").alias(c), F.col("elements").alias(name)) for c, name in (("a", "x"), ("b", "y")))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= least * (F.size("x") + F.size("y") - common)).select("a", "b", "ca", "cb")


def _merges(links: DataFrame) -> DataFrame:
    """Which components (u) become part of which (v), when links connect components ca and cb."""
    return components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def _relabelled(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows with their column comp after the merges."""
    found = rows.join(merges.hint("merge"), rows["comp"] == merges["u"], "left")
    return found.select(*(F.coalesce("v", "comp").alias("comp") if c == "comp" else F.col(c) for c in rows.columns))


def _prefixed(df: DataFrame, prefix: str, *but: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in but else prefix + c) for c in df.columns))


def near_dedup(docs: DataFrame, least: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links) and kept, one row for each of docs.

    least: percent of the union that two linked sets have in common; the bands and the sketch are
    laid out for 80 and above.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = saved(texts.mapInArrow(partial(_sketches, size=size), "doc_id long, n_shingles long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in SKETCH) + ", bands array<long>"), "sketches")
    full = known.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = saved(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in (*SKETCH, "bands"))), "sets")
    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    # what keys of bands are joined with is written first, so that both sides are dealt anew and Spark can split a band that very many sets share
    shared = saved(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = saved(banded.join(shared.hint("merge"), "key").select("key", "band", "id", "size"), "members")
    # how many other sets a set meets in its bands: those that many meet are the likeliest to be what others were made from
    met = saved(members.groupBy("id").agg(F.sum("size").alias("meets")), "met")
    sets = saved(_among(texts.where("doc_id IS NOT NULL"), "doc_id", met).mapInArrow(partial(_sets, size=size), "id long, elements array<long>").distinct(), "elements")
    # elements that no other of these sets has
    single = sets.select("id", F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("count"), F.min("id").alias("id")).where("count = 1")
    # an id with several texts has elements of all of them here, so nothing is known of a single one
    several = sets.groupBy("id").agg(F.count("*").alias("count")).where("count > 1").select("id")
    own = single.groupBy("id").agg(F.count("*").alias("own")).join(several, "id", "left_anti")
    about = reps.select("id", "n", *SKETCH).join(met.hint("merge"), "id").join(own.hint("merge"), "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    rows = saved(members.select("key", "band", "id").join(about.hint("merge"), "id").withColumn("comp", F.col("id")), "rows")
    dropped(members, shared)
    # a pivot is any of the sets with the fewest elements of their own, which others are most likely to be near
    rank = (-F.floor(20 * F.col("own") / F.col("n"))).alias("rank")
    pivots = rows.groupBy("key").agg(F.max(F.struct(rank, "meets", *_ABOUT)).alias("p"))
    pivots = saved(pivots.select("key", *(F.col(f"p.{c}").alias(f"b_{c}") for c in _ABOUT)), "pivots")
    near = _prefixed(rows, "a_", "key").join(pivots.hint("merge"), "key").where((F.col("a_comp") != F.col("b_comp")) & _may_link(least))
    best = near.groupBy("a_id").agg(F.min(F.struct(_differ().alias("differ"), "b_id", "a_comp", "b_comp")).alias("m"))
    checked = saved(best.select(F.col("a_id").alias("a"), F.col("m.b_id").alias("b"), F.col("m.a_comp").alias("ca"), F.col("m.b_comp").alias("cb")), "pairs")
    links = saved(_links(checked, sets, least), "found")
    merges = [_merges(links)]
    dropped(pivots, links)
    for first, last in RANGES:
        # what is one component by now
        rows, old = saved(_relabelled(rows, merges[-1]), "rows"), rows
        dropped(old)
        links = _across(rows.where(F.col("band").between(first, last - 1)), reps, sets, least, checked)
        merges.append(_merges(links))
        dropped(links)
    labels = met.select("id", F.col("id").alias("comp"))
    for made in merges:
        labels = _relabelled(labels, made)
    labels = saved(labels, "labels")
    dropped(rows, sets, checked)
    labels = _same_ids(full, reps, labels)
    groups = reps.select("d1", "d2", "id").join(labels.hint("merge"), "id", "left").select("d1", "d2", F.coalesce("comp", "id").alias("component_id"))
    linked = full.select("doc_id", "n_shingles", "d1", "d2").join(groups.hint("merge"), ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = known.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_ids(full: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, with sets merged that rows of one id have."""
    twice = full.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("doc_id")
    of = saved(full.join(twice, "doc_id", "left_semi").join(reps.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id").distinct(), "twice")
    labels = saved(labels.union(of.select("id", F.col("id").alias("comp")).join(labels, "id", "left_anti").distinct()), "labels")
    named = of.join(labels, "id")
    return _relabelled(labels, _merges(named.join(named.groupBy("doc_id").agg(F.min("comp").alias("ca")), "doc_id").select("ca", F.col("comp").alias("cb"))))


def _across(rows: DataFrame, reps: DataFrame, sets: DataFrame, least: int, checked: DataFrame) -> DataFrame:
    """Links between sets of different components that share one of the bands of rows and none before it."""
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("count"))
    split = by_comp.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    split = saved(split.select("key", F.col("m.comp").alias("major")), "split")
    before = F.expr("slice(bands, 1, band)")
    left = rows.drop("meets").join(split.hint("merge"), "key")
    open_ = saved(left.join(reps.select("id", "bands").hint("merge"), "id").withColumn("before", before).drop("bands"), "open")
    a, b = _prefixed(open_.where("comp <> major"), "a_", "key"), _prefixed(open_, "b_", "key")
    once = ((F.col("b_comp") == F.col("b_major")) | (F.col("a_id") < F.col("b_id"))) & ~F.arrays_overlap("a_before", "b_before")  # in the first band that they share
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("a_comp") != F.col("b_comp")) & once & _may_link(least))
    pairs = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_comp").alias("ca"), F.col("b_comp").alias("cb")).distinct()
    done = reduce(DataFrame.union, (checked.select(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))))
    found = saved(_links(saved(pairs.join(done.hint("merge"), ["a", "b"], "left_anti"), "pairs"), sets, least), "found")
    dropped(split, open_)
    return found


def without_near_copies(docs: DataFrame, least: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; rows without id are."""
    gone = near_dedup(docs, least, size, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    found = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`").cast("long") == F.col("g.gone"), "left_anti")
    return found.select(*(F.col(f"d.`{c}`") for c in docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
