"""Mixing documents to target weights of domains, with soft membership.

A naive Bayes classifier fitted on a labelled table gives each document posteriors over domains:
its features are shares of symbols, capitals, repeated lines and distinct words, its length, and how many
telling beginnings of words of each domain it has. A document's rate is how often it is to be used; the
rates' expected token totals by domain are to match the targets. Least squares on these totals is
minimised by projected gradient steps from a rate of 1, never below 0; steps are taken by token, so documents with equal posteriors have equal rates, and iterations run over the cells of equal
features, not over documents.

DataFrame functions only: no Python runs on the executors. The driver sees one row for each
bucket of a feature and domain, the telling beginnings (learned from LABELLED labelled rows at most), and the totals of
an iteration.

Defined cases: null text counts as empty and has no tokens; rows with a null id or null domain among
the labels are not used; without labels posteriors are even; repeated rows have equal rates and copies; rows without
id are told apart by their texts when copies are drawn; an empty table gives an empty result; a domain that no
document leans to gets as near to its target as the rates of others allow; rates that haven't come to rest are an
error; other columns of the input, whatever their names, are ignored (rated) or carried along (mixed).
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import saved, table

#: The most labelled rows that telling beginnings of words are learned from, and their length: shorter words count whole.
LABELLED, BEGINNING = 5000, 4
SHAPES = {"f_symbols": 11, "f_capitals": 11, "f_lines": 11, "f_words": 11, "f_length": 16}
HITS = 6
#: A word, less opening punctuation; its beginning is the group.
_BEGINNING = "[\"'(\\[]*([^\\x20\\x09-\\x0D]{1,%d})[^\\x20\\x09-\\x0D]*" % BEGINNING


def _beginnings(text: Column) -> Column:
    """The first BEGINNING characters of each word in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(_BEGINNING), F.lit(1))


def _tenths(part: Column, whole: Column) -> Column:
    return F.least(F.floor(10 * part / F.greatest(whole, F.lit(1))), F.lit(10)).cast("int")


def lexicon(labelled: DataFrame, domains: list[str], rows: int = LABELLED, least: int = 3, sigmas: float = 5.0) -> dict[str, list[str]]:
    """For each domain the beginnings of words that more of its labelled texts hold than of the others', beyond chance.

    labelled: id, text, domain. At most `rows` of them are looked at: those least by the hash of their id.
    """
    chosen = labelled.orderBy(F.xxhash64("id"), "id").limit(rows)
    seen = saved(chosen.select("domain", F.explode(F.array_distinct(_beginnings(F.col("text")))).alias("word")).where("word <> ''"), "words")
    sizes = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    out = {}
    counts = seen.groupBy("word").agg(F.count("*").alias("all"), *(F.count_if(F.col("domain") == d).alias(f"in_{i}") for i, d in enumerate(domains)))
    for i, d in enumerate(domains):
        n = sizes.get(d, 0)
        if not n or n == total:
            out[d] = []
            continue
        own, share = F.col(f"in_{i}"), (F.col("all") + 1) / (total + 2)
        margin = own / n - (F.col("all") - own) / (total - n)
        z = margin / F.sqrt(share * (1 - share) * (1 / n + 1 / (total - n)))
        out[d] = [r["word"] for r in counts.where(own >= least).where(z > sigmas).select("word").orderBy("word").collect()]
    return out


def features(docs: DataFrame, telling: Mapping[str, list[str]], carry: list[str], text_col: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """carry, n_tokens and a bucket for each feature; and the number of buckets of each. telling: beginnings by domain."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*carry, text.alias("_text")).withColumns({"_begin": _beginnings(F.col("_text")), "_lines": F.split("_text", "\n")})
    n = F.size("_begin")
    columns = {
        "f_symbols": _tenths(F.regexp_count("_text", F.lit("[#*$%&|<>]")), n),
        "f_capitals": _tenths(F.regexp_count("_text", F.lit("[A-Z]")), F.length("_text")),
        "f_lines": _tenths(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")),
        "f_words": _tenths(F.size(F.array_distinct("_begin")), n),
        "f_length": F.least(F.floor(F.log2(n + F.lit(1))), F.lit(15)).cast("int"),
    }
    buckets = dict(SHAPES)
    known = {d: w for d, w in telling.items() if w}
    # Spark makes a hash set of the second list for each row, so that is the shorter one
    base = base.withColumn("_in", F.array_intersect(F.lit(sorted(set().union(*known.values()))), "_begin")) if known else base
    for i, w in enumerate(known.values()):
        columns[f"f_hits_{i}"] = F.least(F.size(F.array_intersect(F.lit(w), "_in")), F.lit(HITS - 1)).cast("int")
        buckets[f"f_hits_{i}"] = HITS
    return base.select(*carry, n.cast("long").alias("n_tokens"), *(v.alias(k) for k, v in columns.items())), buckets


def posteriors(cells: DataFrame, labelled: DataFrame, domains: list[str], buckets: Mapping[str, int]) -> list[Column]:
    """The posterior of each domain as an expression over the features, from the labelled rows (features and domain)."""
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("bucket")) for k in buckets))).alias("f")
    counts = {(r["domain"], r["feature"], r["bucket"]): r["n"] for r in labelled.select("domain", stacked).groupBy("domain", "f.feature", "f.bucket").agg(F.count("*").alias("n")).collect()}
    any_feature = next(iter(buckets))
    sizes = {d: sum(n for (e, f, _), n in counts.items() if e == d and f == any_feature) for d in domains}
    total = sum(sizes.values())
    logs = []
    for d in domains:
        log = F.lit(math.log((sizes[d] + 1) / (total + len(domains))))
        for k, size in buckets.items():
            log += F.element_at(F.array(*(F.lit(math.log((counts.get((d, k, b), 0) + 0.5) / (sizes[d] + 0.5 * size))) for b in range(size))), F.col(k) + 1)
        logs.append(log)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]


@dataclass
class Fit:
    """steps: what each takes from a rate for each unit of posterior; off: by domain, expected tokens beyond the target."""

    steps: list[list[float]] = field(default_factory=list)
    off: list[float] = field(default_factory=list)
    at_rest: bool = False

    def rate(self, ps: list[Column]) -> Column:
        """The rate of a document with these posteriors after the steps."""
        out = F.lit(1.0)
        for step in self.steps:
            out = F.greatest(F.lit(0.0), out - _dot(ps, step))
        return out


def _dot(ps: list[Column], by: list[float]) -> Column:
    return sum((p * F.lit(float(g)) for p, g in zip(ps[1:], by[1:], strict=True)), ps[0] * F.lit(float(by[0])))


def solve(cells: DataFrame, domains: int, targets: list[float], rounds: int = 30, tolerance: float = 1e-5) -> Fit:
    """Projected gradient descent on the squared differences of expected token totals from targets.

    cells: tokens t and posteriors p_0, p_1, ... A step is the gradient in the metric of the curvature over the documents
    whose rate isn't 0, so a few suffice; where that doesn't lower the squares, a plain step is taken, which
    does. It is at rest once a plain step would move rates by less than `tolerance` of all tokens, or (with targets out of
    reach) a step brings totals nearer by less than a hundredth.
    """
    ps = [F.col(f"p_{i}") for i in range(domains)]
    pairs = [(i, j) for i in range(domains) for j in range(i, domains)]
    whole = cells.agg(F.sum("t")).first()[0] or 0.0
    fit = Fit(off=[-x for x in targets], at_rest=True)
    if not whole:
        return fit

    def looked(by: Fit) -> tuple[np.ndarray, np.ndarray]:
        """How far totals are off, and the curvature over rates that aren't 0."""
        now = by.rate(ps)
        free = F.when(now > 0, F.col("t")).otherwise(F.lit(0.0))
        found = cells.agg(*(F.sum(F.col("t") * now * p).alias(f"e_{i}") for i, p in enumerate(ps)), *(F.sum(free * ps[i] * ps[j]).alias(f"h_{i}_{j}") for i, j in pairs)).first()
        curve = np.array([[found[f"h_{min(i, j)}_{max(i, j)}"] for j in range(domains)] for i in range(domains)])
        return np.array([found[f"e_{i}"] - targets[i] for i in range(domains)]), curve

    off, curve = looked(fit)
    steepest = max(np.trace(curve), 1e-9 * whole)  # no curvature is greater
    for _ in range(rounds):
        plain = (off / steepest).tolist()
        now = fit.rate(ps)
        moved = cells.agg(F.sum(F.col("t") * F.abs(now - F.greatest(F.lit(0.0), now - _dot(ps, plain))))).first()[0]
        if moved <= tolerance * whole or np.abs(off).max() <= tolerance * whole:
            return Fit(fit.steps, off.tolist(), True)
        ahead = np.linalg.solve(curve + 1e-6 * whole * np.eye(domains), off).tolist()
        for step in (ahead, [x / 4 for x in ahead], plain):
            trial = Fit([*fit.steps, step])
            far, bent = looked(trial)
            if far @ far < off @ off * (1 - 1e-9):
                break
        slow = math.sqrt(far @ far) > 0.99 * math.sqrt(off @ off)
        fit, off, curve = trial, far, bent
        if slow:
            return Fit(fit.steps, off.tolist(), True)
    return Fit(fit.steps, off.tolist(), False)


def rated(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], anchor: str | None = None, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """carry, n_tokens, p_<domain> for each domain and rate, one row for each of docs.

    labelled: doc_id and domain. weights: the shares of all tokens that the domains are to have. The total is that
    of docs, or with an anchor, that for which the anchor's share is what docs have of it now.
    """
    carry, domains = carry or [id_col], list(weights)
    known = labelled.select(F.col("doc_id").cast("long").alias("id"), F.col("domain").cast("string").alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(domains))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = known.orderBy(F.xxhash64("id"), "id").limit(LABELLED)  # rows of an id and a domain
    chosen = saved(texts.join(F.broadcast(ids), "id"), "labelled")
    telling = lexicon(chosen, domains)
    made, buckets = features(docs.withColumn("_id", F.col(id_col).cast("long")), telling, ["_id", *carry], text_col)
    made = saved(made, "features")
    cells = saved(made.groupBy(*buckets).agg(F.sum("n_tokens").cast("double").alias("t")), "cells")
    ps = posteriors(cells, made.join(known, made["_id"] == known["id"]).select("domain", *buckets), domains, buckets)
    cells = saved(cells.select("t", *(p.alias(f"p_{i}") for i, p in enumerate(ps))), "cells")
    now = cells.agg(*(F.sum(F.col("t") * F.col(f"p_{i}")).alias(f"e_{i}") for i in range(len(domains)))).first()
    now = [v or 0.0 for v in now]
    share = [weights[d] / sum(weights.values()) for d in domains]
    total = sum(now) if anchor is None else now[domains.index(anchor)] / share[domains.index(anchor)]
    fit = solve(cells, len(domains), [total * s for s in share])
    if not fit.at_rest:
        raise ArithmeticError(f"rates did not come to rest; token totals are off by {dict(zip(domains, fit.off, strict=True))}")
    named = made.select(*carry, "n_tokens", *(p.alias(f"p_{d}") for d, p in zip(domains, ps, strict=True)))
    return named.withColumn("rate", fit.rate([F.col(f"p_{d}") for d in domains]))


def copies(rates: Column, *keys: Column | str) -> Column:
    """How many copies realise a rate: its whole part, and one more with its rest as the chance.

    The draw is a hash of the keys, so it is the same in each run; expected token totals are those of the rates.
    """
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rates + draw + 1e-9).cast("int")


def realised(rows: DataFrame, domains: list[str], used: Column) -> dict[str, float]:
    """The domains' shares of the expected tokens when each row (n_tokens, p_<domain>) is used so many times."""
    found = rows.agg(*(F.sum(F.col("n_tokens") * used * F.col(f"p_{d}")).alias(d) for d in domains)).first()
    total = sum(found[d] or 0.0 for d in domains)
    return {d: (found[d] or 0.0) / total if total else 0.0 for d in domains}


def labels_as_domains(labels: DataFrame, toxic: bool = True) -> DataFrame:
    """doc_id and domain of the labels: junk of low quality, toxic (if asked for), else clean."""
    domain = F.when(F.col("quality") == 0, F.lit("junk"))
    domain = domain.when(F.col("toxic") == 1, F.lit("toxic")) if toxic else domain
    return labels.select("doc_id", domain.otherwise(F.lit("clean")).alias("domain")).where("quality IS NOT NULL")


def mixed(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], anchor: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, once each: a rate over 1 counts as 1, so the shares realised are close to the weights, not equal."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("row"), F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("body"))
    out = rated(rows, labelled, weights, anchor, ["row", "key", "body"], "key", "body")
    return out.where(copies(F.least("rate", F.lit(1.0)), "key", "body") > 0).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = labels_as_domains(table(spark, sf_dir, "labels"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("drawn", F.xxhash64("doc_id", "text"))
    out = rated(docs, labelled, {"clean": 0.96, "junk": 0.03, "toxic": 0.01}, carry=["doc_id", "drawn"])
    return out.withColumn("copies", copies(F.col("rate"), "drawn")).drop("drawn")
