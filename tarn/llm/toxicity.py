"""Toxicity by non-negative positive-unlabelled learning.

Texts confirmed to be toxic are the positives; all texts of the training folds are the unlabelled ones,
whatever their label says. A numpy classifier over hashed words minimises the risk estimator

    prior * E_P[loss(+)]  +  max(0, E_U[loss(-)] - prior * E_P[loss(-)])

whose second part, the risk on negatives, is corrected for the toxic texts among the unlabelled and
kept from falling below zero. No negative label is ever looked at: the class prior comes from the scores of
the unlabelled, as the least ratio of the share of them over a threshold to that of positives over it.

Only the number of positives is bounded (max_positives, in the order of a hash of their ids); the risk on the
unlabelled is summed over every text of the training folds, by tasks, for each step. Texts are read once for training:
of each, the buckets that several positives have are kept, and then those that positives have more often
than the unlabelled. Scoring covers every whole text of the table.

Defined cases: null text counts as empty; a text without words gets the score of the bias alone; a
null id is in fold crc32('') mod 4, and such rows are unlabelled texts too; repeated rows each get their own row; rows
of the labels with a null id or label are not used; a score equal to the threshold is predicted toxic; an empty
table gives an empty result; without any positive label all scores are 0; other columns of the input, whatever
their names, are ignored (toxicity) or carried along (without_toxic).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import words as W
from tarn.llm.common import dropped, fold_of, saved, table

BITS = 20
PREFIXES = (3, 4, 5, 6, 8)
MAX_POSITIVES = 4_000
#: A bucket is looked at if so many positives have it.
LEAST = 3
STEPS, RATE, DECAY = 30, 0.3, 1e-5
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(s: W.Slice, bits: int = BITS, of_use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words of each row and of their first PREFIXES bytes, and their rows, sorted.

    A-Z is put in lower case and punctuation cut off at both ends. of_use: flags of the only buckets wanted.
    """
    data = W.LOWER[s.data]
    starts, ends, rows = s.words()
    if not len(starts):
        return np.zeros(0, np.int64), rows
    letter = ~_PUNCTUATION[data]
    after = np.where(letter, np.arange(len(data)), len(data))
    after = np.minimum.accumulate(after[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, np.arange(len(data)), -1))
    first, last = after[starts], before[ends - 1] + 1
    full = (first < ends) & (last > starts)
    first, last, rows = first[full], last[full], rows[full]
    tagged = []
    for n in (0, *PREFIXES):
        has = slice(None) if not n else last - first > n
        hashes = W.span_hashes(data, first[has], first[has] + n if n else last)
        buckets = (W.mix(hashes + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
        of = rows[has]
        if of_use is not None:
            wanted = of_use[buckets]
            buckets, of = buckets[wanted], of[wanted]
        tagged.append((of << bits) | buckets)
    found = np.unique(np.concatenate(tagged))
    return found & ((1 << bits) - 1), found >> bits


def telling(p: np.ndarray, u: np.ndarray, n: int, m: int, sigmas: float = 5.0) -> np.ndarray:
    """Flags of the buckets that more of n positive texts hold (p by bucket) than of m unlabelled (u), beyond chance."""
    share = (p + u + 1) / (n + m + 2)
    return (p >= LEAST) & (p / max(n, 1) - u / max(m, 1) > sigmas * np.sqrt(share * (1 - share) * (1 / max(n, 1) + 1 / max(m, 1))))


def margins(model: Model, buckets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=model.weights[buckets], minlength=n) + model.bias


@dataclass(frozen=True)
class Texts:
    """Columns (numbers from 0 on) that texts have, a run of texts for each number of times that they occur."""

    columns: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(self.rows, weights=x[self.columns], minlength=len(self.counts)) + x[-1], -30, 30)

    def risk(self, x: np.ndarray) -> np.ndarray:
        """Sums over the texts: of loss(-), its gradient by x, and the number of texts.

        The loss is logistic: loss(-) = log(1 + exp(margin)), loss(+) = loss(-) - margin.
        """
        margin = self.margins(x)
        score = self.counts / (1 + np.exp(-margin))
        gradient = np.bincount(self.columns, weights=score[self.rows], minlength=len(x) - 1)
        return np.concatenate([[self.counts @ np.log1p(np.exp(margin))], gradient, [score.sum(), self.counts.sum()]])

    def present(self, size: int) -> np.ndarray:
        """How many texts have each column, and how many texts there are: what loss(+) adds is linear in x."""
        return np.concatenate([np.bincount(self.columns, weights=self.counts[self.rows], minlength=size), [self.counts.sum()]])


def descend(positives: Texts, unlabelled, size: int, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights of `size` columns and the bias, by Adam on the non-negative risk.

    unlabelled: a function of x that gives the sums of Texts.risk over all unlabelled texts.
    """
    x, m, v = np.append(np.zeros(size), -2.0), np.zeros(size + 1), np.zeros(size + 1)
    n, held = positives.counts.sum(), positives.present(size) / positives.counts.sum()
    for step in range(1, steps + 1):
        on_p, on_u = positives.risk(x), unlabelled(x)
        minus_p, minus_u = on_p[1:-1] / n, on_u[1:-1] / on_u[-1]
        gradient = prior * (minus_p - held)
        if on_u[0] / on_u[-1] >= prior * on_p[0] / n:
            gradient += minus_u - prior * minus_p
        gradient[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x - rate / (1 + step / 20) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x


def class_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from counts by rising score of either.

    Over any threshold the unlabelled can't hold fewer positives than the share times what positives have there, so the
    least ratio is the share; thresholds that under half of the positives pass are too uncertain, and a standard
    deviation of each count is allowed for.
    """
    p, u = (np.cumsum(x[::-1])[::-1] for x in (positives, unlabelled))
    n, m = max(p[0], 1), max(u[0], 1)
    use = p >= n / 2
    return float(np.min((u[use] + np.sqrt(u[use])) / m / np.maximum((p[use] - np.sqrt(p[use])) / n, 1e-9))) if use.any() else 0.0


def _buckets(batches: Iterator[pa.RecordBatch], bits: int, of_use) -> Iterator[pa.RecordBatch]:
    """The first column and the buckets of use of each text."""
    flags = None if of_use is None else np.unpackbits(of_use.value).astype(bool)
    for batch in batches:
        for s in W.slices(batch.column(1)):
            found, rows = features(s, bits, flags)
            edges = np.searchsorted(rows, np.arange(s.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.ListArray.from_arrays(pa.array(edges), pa.array(found.astype(np.int32)))], ["toxic", "buckets"])


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts hold each bucket."""
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])


def _held_by(rows: DataFrame, size: int) -> np.ndarray:
    """How many of the rows hold each bucket; the driver sees `size` rows at most."""
    few = rows.select("buckets").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    found = few.mapInArrow(partial(_held, size=size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _columns(batches: Iterator[pa.RecordBatch], place) -> Iterator[pa.RecordBatch]:
    """The columns, in order, of lists of buckets."""
    for batch in batches:
        lists = batch.column(0)
        found = place.value[lists.flatten().to_numpy(zero_copy_only=False)]
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))[found >= 0]
        edges = np.searchsorted(rows, np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), pa.array(found[found >= 0]))], ["columns"])


def _texts(batch: pa.RecordBatch) -> Texts:
    """From a batch of columns (a list) and counts."""
    lists = batch.column(0)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Texts(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), sizes), batch.column(1).to_numpy().astype(float))


#: So many sums travel as one row.
PART = 1024


def _in_parts(total: np.ndarray) -> pa.RecordBatch:
    """Sums by place, PART of them a row; the last row is filled up with zeros."""
    n = -(-len(total) // PART)
    filled = np.zeros(n * PART)
    filled[: len(total)] = total
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PART), pa.array(filled))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), lists], ["part", "sums"])


def _risks(batches: Iterator[pa.RecordBatch], x) -> Iterator[pa.RecordBatch]:
    """A task's sums of Texts.risk."""
    yield _in_parts(sum((_texts(b).risk(x.value) for b in batches), np.zeros(len(x.value) + 2)))


GRADES = 2000


def _grades(texts: Texts, x: np.ndarray) -> np.ndarray:
    """Counts of texts by grade of their margin, from -30 to 30."""
    return np.bincount(np.minimum((texts.margins(x) + 30) / 60 * GRADES, GRADES - 1).astype(np.int64), weights=texts.counts, minlength=GRADES)


def _graded(batches: Iterator[pa.RecordBatch], x) -> Iterator[pa.RecordBatch]:
    yield _in_parts(sum((_grades(_texts(b), x.value) for b in batches), np.zeros(GRADES)))


def _summed(texts: DataFrame, work, x: np.ndarray, size: int) -> np.ndarray:
    """What `work` adds up in each task over the texts, added up over all tasks, part by part."""
    context = texts.sparkSession.sparkContext
    out, shared = np.zeros(-(-size // PART) * PART), context.broadcast(x)
    few = texts.coalesce(max(1, context.defaultParallelism))  # each task gives a row for each part, however few its texts
    both = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    added = F.reduce(F.collect_list("sums"), F.array_repeat(F.lit(0.0), PART), both).alias("sums")
    for r in few.mapInArrow(partial(work, x=shared), "part int, sums array<double>").groupBy("part").agg(added).collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] = r["sums"]
    shared.destroy()
    return out[:size]


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, folds: int = 4, held_out: int = 2, bits: int = BITS) -> Model:
    """A model of the rows outside the held-out fold.

    Positives are at most max_positives texts, those least by the hash of their id; unlabelled are all texts.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic = 1")
    ids = known.where(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fold_of(F.col("doc_id"), folds) != held_out)
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives).withColumn("toxic", F.lit(1))  # rows of 12 bytes
    schema = "toxic int, buckets array<int>"
    confirmed = saved(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(partial(_buckets, bits=bits, of_use=None), schema), "positives")
    size = 1 << bits
    p = _held_by(confirmed, size)
    p[p < LEAST] = 0
    n = confirmed.count()
    if not n:
        return Model(np.zeros(size), -500.0)
    of_use = spark.sparkContext.broadcast(np.packbits(p > 0))
    rows = saved(texts.select(F.lit(0).alias("toxic"), "text").mapInArrow(partial(_buckets, bits=bits, of_use=of_use), schema), "unlabelled")
    u, m = _held_by(rows, size), rows.count()
    columns = np.flatnonzero(telling(p, u, n, m)).astype(np.int32)
    if not len(columns):
        return Model(np.zeros(size), -500.0)
    # texts by the columns that they have: most have none, so few rows are left
    place = np.full(size, -1, np.int32)
    place[columns] = np.arange(len(columns))
    shared = spark.sparkContext.broadcast(place)  # 4 << bits bytes
    patterns = lambda df: saved(df.select("buckets").mapInArrow(partial(_columns, place=shared), "columns array<int>").groupBy("columns").agg(F.count("*").alias("count")), "patterns")
    few, all_ = patterns(confirmed), patterns(rows)
    dropped(confirmed, rows)
    positives = _texts(few.toArrow().combine_chunks().to_batches()[0])  # max_positives rows of the telling columns
    look = lambda x: _summed(all_, _risks, x, len(x) + 2)
    first = descend(positives, look, len(columns), 0.1)
    grades = _summed(all_, _graded, first, GRADES)
    prior = min(max(class_prior(_grades(positives, first), grades), 1e-6), 1 - 1e-6)
    x = descend(positives, look, len(columns), prior)
    grades, middle = _summed(all_, _graded, x, GRADES), (np.arange(GRADES) + 0.5) / GRADES * 60 - 30
    # the bias is moved until the scores of the unlabelled have the prior as their mean
    low, high = -30.0, 30.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grades @ (1 / (1 + np.exp(-(middle + mid)))) / grades.sum() < prior else (low, mid)
    out = np.zeros(size)
    out[columns] = x[:-1]
    return Model(out, float(x[-1] + low))


def score_of(spark: SparkSession, text: Column, model: Model, bits: int = BITS) -> Column:
    """The scores of texts. Texts alone go to Python, and only numbers come back: no other column leaves the JVM."""
    shared = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias))  # 4 << bits bytes

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_use = shared.value.weights != 0
        for column in texts:
            scores = [np.zeros(0)]
            for s in W.slices(column):
                found, rows = features(s, bits, of_use)
                scores.append(1 / (1 + np.exp(-np.clip(margins(shared.value, found, rows, s.rows), -500, 500))))
            yield pa.array(np.concatenate(scores))

    return F.arrow_udf(score, "double")(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each of docs."""
    model, doc_id = train(docs, labels), F.col("doc_id").cast("long")
    out = docs.select(doc_id.alias("doc_id"), score_of(docs.sparkSession, F.col("text"), model).alias("score"))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs under the threshold, with all their columns."""
    return docs.where(score_of(docs.sparkSession, F.col("text"), train(docs, labels)) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
