"""Exact dedup by content-defined chunk recipes.

A rolling hash cuts each normalised text (A-Z in lower case, nothing else changed) where its own
content says so, so equal passages give equal chunks wherever they stand. Chunks are deduplicated
to identifiers: a 64-bit key, verified by length and SHA-256; chunks that share a key but differ
are told apart by their whole digest. A document's recipe is the ordered list of its chunks'
identifiers, and equal texts are those with equal recipes. Only digests are shuffled: a text is
read once, in the task that scans it.

Defined cases: null text counts as empty, and all empty texts are equal; of rows that repeat both
id and text one stays; a null id is the smallest of its group; an empty table gives an empty
result; other columns of the input, whatever their names, are
ignored (exact_dedup) or carried along (without_copies).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import words as W
from tarn.llm.common import lower_az, saved, table

#: Chunk sizes in bytes: least, mean beyond that, largest.
LEAST, MEAN_BITS, LARGEST = 256, 11, 1 << 16
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
_SCHEMA = "doc_id long, text_sha256 string, chunks array<struct<key:long,bytes:int,d1:long,d2:long,d3:long,d4:long>>"


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the 32 bytes that end there."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row, the ends of its chunks within data; an empty row has one empty chunk."""
    found = (np.flatnonzero(_rolling(data) >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist() if len(data) else []
    out = []
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while end - at > LEAST:
            k = bisect_left(found, at + LEAST)
            at = min(end, at + LARGEST, found[k] if k < len(found) else end)
            ends.append(at)
        if at < end or not ends:
            ends.append(end)
        out.append(ends)
    return out


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("key", pa.int64()), ("bytes", pa.int32()), *((f"d{i}", pa.int64()) for i in range(1, 5))]))
    for batch in batches:
        for s in W.slices(batch.column(1)):
            data = W.LOWER[s.data]
            by_row = cut(data, s.offsets)
            counts = [len(x) for x in by_row]
            ends = np.array([e for x in by_row for e in x], np.int64)
            first = np.cumsum([0, *counts])
            starts = np.concatenate([[0], ends[:-1]])
            starts[first[:-1]] = s.offsets[:-1]
            view = memoryview(np.ascontiguousarray(data))
            digests = b"".join(hashlib.sha256(view[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
            parts = np.frombuffer(digests, np.int64).reshape(-1, 4)
            chunks = pa.StructArray.from_arrays([pa.array(W.span_hashes(data, starts, ends).view(np.int64)), pa.array((ends - starts).astype(np.int32)), *(pa.array(parts[:, i]) for i in range(4))], fields=list(kind.value_type))
            whole = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(whole), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), chunks)], ["doc_id", "text_sha256", "chunks"])


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: row (a number of its own), doc_id, text_sha256 and recipe."""
    cut_up = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_recipes, _SCHEMA)
    numbered = saved(cut_up.withColumn("row", F.monotonically_increasing_id()), "chunks")
    parts = ["bytes", "d1", "d2", "d3", "d4"]
    entries = numbered.select("row", "doc_id", "text_sha256", F.posexplode("chunks").alias("at", "chunk")).select("row", "doc_id", "text_sha256", "at", "chunk.*")
    # keys whose chunks are not all one: hardly any, but they can be as many as there are chunks, so Spark sees their size before it joins
    ranges = entries.groupBy("key").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in parts for f in (F.min, F.max)))
    shared = saved(ranges.where(F.expr(" OR ".join(f"min_{c} <> max_{c}" for c in parts))).select("key", F.lit(True).alias("shared")), "shared-keys")
    name = F.when(F.col("shared"), F.array("key", *(F.col(c).cast("long") for c in parts))).otherwise(F.array("key"))
    named = entries.join(shared, "key", "left").select("row", "doc_id", "text_sha256", "at", name.alias("name"))
    listed = named.groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("names"))
    return listed.select("row", "doc_id", "text_sha256", F.flatten("names.name").alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each of docs.

    Of equal texts the row with the largest id stays.
    """
    known = saved(recipes(docs, id_col, text_col), "recipes")
    # written first, so that both sides of the join are dealt anew and Spark can split a recipe that very many rows have
    groups = saved(known.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size")), "groups")
    out = known.join(groups, "recipe")
    return out.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text, one."""
    key = lambda doc_id, digest: F.concat_ws(":", digest, doc_id)
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    tagged = docs.select(row, key(F.col(f"`{id_col}`").cast("long"), F.sha2(lower_az(F.col(f"`{text_col}`")).cast("binary"), 256)).alias("key"))
    return tagged.join(stay, "key", "left_semi").dropDuplicates(["key"]).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
