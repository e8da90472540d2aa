"""Quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains (null) on a document. Expectation-maximisation
over the counts of vote patterns (at most 3 to the number of rules, whatever the corpus)
estimates the share of good documents and, for each rule, how often its vote is right on good and
on bad documents; a document's verdict is the posterior probability that it is good given all votes,
in place of an all-must-pass filter: one bad vote of a rule that errs is outvoted.

Defined cases: null text counts as empty; an empty text has no words and fails the base rules;
a null id is carried through; repeated rows each get their own row; a document on which all rules
abstain has the share of good documents as its posterior; a posterior equal to the threshold is
kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import words as W
from tarn.llm.common import saved, table

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")


def _duplicates(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more in its row; by row, the number of keys less that of distinct ones."""
    tagged = W.mix(keys ^ W.mix(rows.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, counts = np.unique(tagged, return_index=True, return_inverse=True, return_counts=True)
    return counts[inverse] > 1, np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def measure_slice(s: W.Slice) -> dict[str, np.ndarray]:
    n, data = s.rows, s.data
    starts, ends, rows = s.words()
    counts = np.bincount(rows, minlength=n)
    inside = ~W._SPACE[data]
    # words in windows of WINDOW words that the row holds twice or more
    repeat = np.zeros(n, np.int64)
    last = np.searchsorted(rows, rows, "right")
    at = np.flatnonzero(np.arange(len(rows)) + WINDOW <= last)
    if len(at):
        grams = W.ngrams(W.span_hashes(data, starts, ends), WINDOW)[at]
        found = at[_duplicates(grams, rows[at], n)[0]]
        cover = np.zeros(len(rows) + 1, np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + WINDOW, -1)
        repeat = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    # lines: cut at \n and at the ends of rows
    cuts = np.unique(np.concatenate([s.offsets, np.flatnonzero(data == 10) + 1]))
    first, end = cuts[:-1], cuts[1:].copy()
    end[data[end - 1] == 10] -= 1
    with_word = np.searchsorted(starts, end, "left") > np.searchsorted(starts, first, "left")
    first, end = first[with_word], end[with_word]
    line_rows = np.searchsorted(s.offsets, first, "right") - 1
    return {
        "n_words": counts,
        "word_chars": s.per_row(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": s.per_row(_SYMBOL[data]),
        "n_dup_lines": _duplicates(W.span_hashes(data, first, end), line_rows, n)[1] if len(first) else np.zeros(n, np.int64),
        "n_repeat_words": repeat,
        "n_lines": np.bincount(line_rows, minlength=n),
        "n_upper": s.per_row((data >= 65) & (data <= 90)),
        "n_letters": s.per_row(((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 0xC0)),  # all that isn't ASCII counts as a letter
        "n_bangs": s.per_row(data == 33),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in W.slices(batch.column(1)):
            found = measure_slice(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], ["doc_id", *MEASURES])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules look at, one row a document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def default_rules() -> dict[str, Column]:
    """Name of each rule and its vote, over the columns of measures().

    Each votes both ways and abstains in between: where a flaw is slight, and where a text is too short to show it.
    """
    n, chars, letters = F.col("n_words"), F.col("word_chars"), F.col("n_letters")
    lines, long = F.col("n_lines"), F.col("n_words") >= 20
    return {
        "length": _vote(n < 20, n >= 60),
        "letters": _vote(10 * letters < 9 * chars, (n > 0) & (100 * letters >= 94 * chars)),
        "symbols": _vote(10 * F.col("n_symbols") > n, long & (50 * F.col("n_symbols") <= n)),
        "lines": _vote(10 * F.col("n_dup_lines") > 3 * lines, (lines >= 4) & (10 * F.col("n_dup_lines") <= lines)),
        "repeats": _vote(5 * F.col("n_repeat_words") > n, long & (20 * F.col("n_repeat_words") <= n)),
        "capitals": _vote(10 * F.col("n_upper") > 3 * letters, (n > 0) & (100 * F.col("n_upper") <= 6 * letters)),
        "bangs": _vote(5 * F.col("n_bangs") > n, long & (50 * F.col("n_bangs") <= n)),
        "word_length": _vote((10 * chars < 41 * n) | (chars > 7 * n), (n > 0) & (10 * chars >= 45 * n) & (10 * chars <= 58 * n)),
    }


@dataclass(frozen=True)
class LabelModel:
    """good, bad: by rule, the chance that its vote is right on good and on bad documents; balance: the share of good ones."""

    good: np.ndarray
    bad: np.ndarray
    balance: float

    @property
    def start(self) -> float:
        """The log odds of a document before any vote."""
        return float(np.log(self.balance / (1 - self.balance)))

    @property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a good and a bad vote of each rule add to the log odds."""
        return np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        by_good, by_bad = self.weights
        return 1 / (1 + np.exp(-(self.start + (patterns == 1) @ by_good + (patterns == 0) @ by_bad)))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns.

    patterns: (p, rules) of 1 (good), 0 (bad) and -1 (abstains); counts: documents with each. It starts from the
    share of good votes, a bad one counting as three. Each estimate has 10 votes of a prior in it (8 of 10 votes on good
    documents right, 3 of 10 on bad ones, since most flaws are of other kinds than a rule looks for, 8 of 10
    documents good), so none is ever 0 or 1 and a rule that never votes adds nothing.
    """
    good, bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    likely = (good.sum(axis=1) + 1) / (good.sum(axis=1) + 3 * bad.sum(axis=1) + 2)
    model = LabelModel(np.full(patterns.shape[1], 0.8), np.full(patterns.shape[1], 0.3), 0.8)
    for _ in range(rounds if len(patterns) else 0):
        for_good, for_bad = counts * likely, counts * (1 - likely)
        voted = good + bad
        model = LabelModel((for_good @ good + 8) / (for_good @ voted + 10), (for_bad @ bad + 3) / (for_bad @ voted + 10), float((for_good.sum() + 8) / (counts.sum() + 10)))
        likely = model.posterior(patterns)
    return model


def weak_supervision(measured: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds vote_<rule> for each rule and posterior, the probability that a document is good."""
    voted = measured.withColumns({f"vote_{k}": v.cast("int") for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    found = voted.groupBy(*names).agg(F.count("*").alias("count")).collect()  # 3 ** len(rules) rows at most
    patterns = np.array([[-1 if r[k] is None else r[k] for k in names] for r in found], int).reshape(-1, len(names))
    model = label_model(patterns, np.array([r["count"] for r in found], float))
    total = F.lit(model.start)
    for k, by_good, by_bad in zip(names, *(w.tolist() for w in model.weights), strict=True):
        total += F.when(F.col(k) == 1, F.lit(by_good)).when(F.col(k) == 0, F.lit(by_bad)).otherwise(F.lit(0.0))
    return voted.withColumn("posterior", 1 / (1 + F.exp(-total)))


def quality(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, votes, posterior, base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not
    base_failed, and a posterior of at least `least`.
    """
    scored = weak_supervision(saved(measures(docs, id_col, text_col), "quality"), default_rules())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= least))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, "posterior", *(c for c in out.columns if c.startswith("vote_")))
