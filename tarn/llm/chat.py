"""Formatting conversations for training as a packed prefix tree.

A turn's node is its conversation up to and including it, so conversations that share initial turns share
nodes. Nodes are laid out depth first in one stream of tokens, each once; a node has its place in the stream, the
position id of its first token (tokens before it in its conversation, not in the stream), the span of its tokens
that are trained on, and the intervals of the stream that its ancestors take up, which with its own tokens so far
are all that it attends to. Neighbouring intervals are merged.

Tokens are the bytes of UTF-8 and one id for each control string. The template marks turns by role:

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>, the text alone being trained on
    others     <role> role <text> text </role>

(without the spaces). Inside texts and role names a backslash, < and [ are written \\\\ \\l \\b, so no control string
can occur there, and unescaping gives the text back.

Depth-first order is that of paths, the digests of a node's ancestors and itself one after the other: sorting
by range puts it over all executors, and no tree has to fit one task.

Defined cases: null text and null role count as empty; turns are put in order by turn, role and text; rows without
conversation id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import new_dir, saved, table

#: Control strings; their token ids are 256 and on.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<role>", "<text>", "</role>")
IDS = {c: 256 + i for i, c in enumerate(CONTROLS)}
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
TRAINED = "assistant"
STEP = 16


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return "\\".join(part.replace("\\l", "<").replace("\\b", "[") for part in text.split("\\\\"))


def render(role: str, text: str) -> tuple[np.ndarray, int, int]:
    """Tokens of a turn, and from where to where they are trained on."""
    plain = lambda t: np.frombuffer(escape(t).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16)
    mark = lambda c: np.array([IDS[c]], np.uint16)
    body = plain(text)
    if role in MARKS:
        start, end = MARKS[role]
        return np.concatenate([mark(start), body, mark(end)]), 1 if role == TRAINED else 0, 1 + len(body) if role == TRAINED else 0
    return np.concatenate([mark("<role>"), plain(role), mark("<text>"), body, mark("</role>")]), 0, 0


def parse(tokens: np.ndarray) -> list[tuple[str, str, int]]:
    """Role, text and formatted characters of each turn of a stream of whole turns."""
    cuts = np.flatnonzero(tokens >= 256)
    out, by_start = [], {IDS[a]: (role, IDS[b]) for role, (a, b) in MARKS.items()}
    text = lambda a, b: tokens[a + 1 : b].astype(np.uint8).tobytes().decode("utf-8", "surrogatepass")
    k = 0
    while k < len(cuts):
        first = int(tokens[cuts[k]])
        if first in by_start:
            role, end = by_start[first]
            if tokens[cuts[k + 1]] != end:
                raise ValueError("a turn doesn't end as it begins")
            raw = text(cuts[k], cuts[k + 1])
            out.append((role, unescape(raw), len(raw) + len(CONTROLS[first - 256]) + len(CONTROLS[end - 256])))
            k += 2
        else:
            name, raw = text(cuts[k], cuts[k + 1]), text(cuts[k + 1], cuts[k + 2])
            out.append((unescape(name), unescape(raw), len(name) + len(raw) + sum(len(c) for c in CONTROLS[6:])))
            k += 3
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, with the path of each turn's node and its first position."""
    last, path, position, new = None, b"", 0, True
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            paths, positions = [], []
            for conv, role, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if new or conv != last:
                    last, path, position, new = conv, b"", 0, False
                r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                path += hashlib.blake2b(path[-STEP:] + struct.pack("<QQ", len(r), len(t)) + r + t, digest_size=STEP).digest()
                paths.append(path)
                positions.append(position)
                position += len(render(role, text)[0])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(paths, pa.binary()), pa.array(positions, pa.int64())], ["conv_id", "role", "text", "path", "position"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in depth-first order, laid out from 0 on in each task.

    attends has the ancestors that this task has laid out; `above` counts those before, which are ancestors of the
    task's first node too.
    """
    from pyspark import TaskContext

    part, start = TaskContext.get().partitionId(), 0
    line: list[tuple[bytes, list[dict[str, int]]]] = []  # the node before and its ancestors here: path, and intervals up to and with it
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows, out = batch.slice(at, 1000), []
            for path, position, role, text in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, loss_from, loss_to = render(role, text)
                while line and not (len(line[-1][0]) < len(path) and path.startswith(line[-1][0])):
                    line.pop()
                attends = line[-1][1] if line else []
                end = start + len(tokens)
                joins = bool(attends) and attends[-1]["to"] == start
                line.append((path, [*attends[:-1], {"from": attends[-1]["from"], "to": end}] if joins else [*attends, {"from": start, "to": end}]))
                out.append((path, position, part, start, len(tokens), loss_from, loss_to, tokens.astype("<u2").tobytes(), len(path) // STEP - len(line), attends))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), _LAID_KINDS, strict=True)], _LAID_NAMES)


_SPAN = pa.struct([("from", pa.int64()), ("to", pa.int64())])
_LAID_NAMES = ["path", "position", "part", "start", "size", "loss_from", "loss_to", "tokens", "above", "attends"]
_LAID_KINDS = [pa.binary(), *[pa.int64()] * 6, pa.binary(), pa.int32(), pa.list_(_SPAN)]
_LAID = "path binary, position long, part long, start long, size long, loss_from long, loss_to long, tokens binary, above int, attends array<struct<from:long,to:long>>"


def pack(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packed stream, a row for each node, and conv_id and path of each conversation's last node.

    Nodes: path, start (of the stream), size, position, loss_from, loss_to (within the node), tokens (u16) and
    attends (intervals of the stream from, to).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), text("role"), text("text"), F.col("turn").cast("long").alias("turn"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    found = saved(turns.mapInArrow(_nodes, "conv_id long, role string, text string, path binary, position long"), "turns")
    nodes = found.groupBy("path").agg(*(F.first(c).alias(c) for c in ("position", "role", "text")))
    laid = saved(nodes.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_tokens, _LAID), "nodes")
    # a row for each task: where its part of the stream begins, and the path of its first node
    parts = sorted(tuple(r) for r in laid.groupBy("part").agg(F.sum("size"), F.min("path")).collect())
    before, offsets, carried = 0, [], []
    for part, size, path in parts:
        offsets.append((part, before))
        carried += [(part, k, path[: k * STEP]) for k in range(1, len(path) // STEP)]
        before += size
    spark = conversations.sparkSession
    offsets = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    # intervals of the ancestors of first nodes: as many rows as tasks times the depth of a conversation
    outer = spark.createDataFrame(carried, "of long, depth int, path binary")
    outer = laid.join(F.broadcast(outer), "path").join(offsets, "part").select("of", "depth", (F.col("start") + F.col("before")).alias("from"), (F.col("start") + F.col("before") + F.col("size")).alias("to"))
    outer = outer.groupBy(F.col("of").alias("part")).agg(F.array_sort(F.collect_list(F.struct("depth", F.struct("from", "to").alias("span")))).alias("outer"))
    moved = F.expr("transform(attends, s -> named_struct('from', s.from + before, 'to', s.to + before))")
    spans = F.concat(F.expr("coalesce(transform(slice(outer, 1, above), o -> o.span), CAST(array() AS ARRAY<STRUCT<from: BIGINT, to: BIGINT>>))"), moved)
    merged = F.expr("""aggregate(spans, CAST(array() AS ARRAY<STRUCT<from: BIGINT, to: BIGINT>>), (a, s) ->
        CASE WHEN size(a) > 0 AND element_at(a, -1).to = s.from
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('from', element_at(a, -1).from, 'to', s.to))) ELSE concat(a, array(s)) END)""")
    placed = laid.join(offsets, "part").join(F.broadcast(outer), "part", "left").withColumn("spans", spans)
    packed = placed.select("path", (F.col("start") + F.col("before")).alias("start"), "size", "position", "loss_from", "loss_to", "tokens", F.when(F.col("above") > 0, merged).otherwise(F.col("spans")).alias("attends"))
    leaves = found.groupBy("conv_id").agg(F.max_by("path", F.octet_length("path")).alias("path"))
    return packed, leaves


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        out = []
        for conv, nodes in zip(frame["conv_id"], frame["nodes"], strict=True):
            tokens = [np.frombuffer(n["tokens"], "<u2") for n in nodes]
            trained, whole, position = "", [], 0
            for n, t in zip(nodes, tokens, strict=True):
                if n["position"] != position or n["seen"] != position:
                    raise ValueError("a node's position ids don't follow those that it attends to")
                position += len(t)
                whole += parse(t)
                if n["loss_to"] > n["loss_from"]:
                    trained += unescape(t[n["loss_from"] : n["loss_to"]].astype(np.uint8).tobytes().decode("utf-8", "surrogatepass"))
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text, _ in whole).encode("utf-8", "surrogatepass")).hexdigest()
            out.append((None if pd.isna(conv) else int(conv), len(whole), digest, len(trained), hashlib.sha256(trained.encode("utf-8", "surrogatepass")).hexdigest(), sum(n for _, _, n in whole)))
        found = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield found.assign(conv_id=found["conv_id"].astype("Int64"))


def read_back(packed: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from the packed stream."""
    at = F.expr(f"transform(sequence(1, octet_length(path) DIV {STEP}), i -> substring(path, 1, CAST(i AS INT) * {STEP}))")
    steps = leaves.select("conv_id", F.explode(at).alias("path"))
    seen = F.expr("aggregate(attends, 0L, (n, s) -> n + s.to - s.from)")
    nodes = packed.select("path", "position", "loss_from", "loss_to", "tokens", seen.alias("seen"))
    rows = steps.join(nodes, "path").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "seen", "loss_from", "loss_to", "tokens"))).alias("nodes"))
    return rows.mapInPandas(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_chats(conversations: DataFrame, to: str) -> None:
    """The packed stream and the conversations' last nodes, as two Parquet tables in a folder."""
    packed, leaves = pack(conversations)
    packed.write.parquet(f"{to}/stream")
    leaves.write.parquet(f"{to}/conversations")


def formatted(conversations: DataFrame) -> DataFrame:
    """Write conversations as a packed stream and read them back."""
    spark = conversations.sparkSession
    to = new_dir(spark, "chats")
    write_chats(conversations, to)
    return read_back(spark.read.parquet(f"{to}/stream"), spark.read.parquet(f"{to}/conversations"))


def with_control_case(conversations: DataFrame) -> DataFrame:
    """conversations and one more, -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(*more.columns).union(more)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(with_control_case(table(spark, sf_dir, "conversations")))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
  ELSE 19 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) END AS chars FROM t),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
