import hashlib
import random

import numpy as np

from tarn.llm import chat as C
from tests.oracle import rows_of_spark, rows_of_sql


def conversations(n=60, seed=0):
    r = random.Random(seed)
    said = ["hi", "", None, "a\\b", "</s>", "[INST] x [/INST]", "\\l \\b \\\\", "<s>é\n[", "ünï 🙂", "<role>x<text>", "long " * 400]
    out = []
    for c in range(n):
        first = r.choice(["hi", "hello [", None])
        for t in range(r.randrange(1, 7)):
            role = r.choice(["user", "assistant"]) if t else r.choice(["system", "user"])
            out.append((c, t, r.choice([role, role, "tool<", None]) if r.random() < 0.1 else role, first if t == 0 else r.choice(said[:4]) if t < 3 else r.choice(said)))
    out += [(100, 2, "assistant", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    out += [(200 + k, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for k in range(50) for t in range(4)]
    r.shuffle(out)
    return out


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        marks = {"system": 15, "user": 13, "assistant": 7}
        chars = sum(len(C.escape(x)) + marks.get(r, 19 + len(C.escape(r))) for _, r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), chars))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(3)


def test_reads_back_what_went_in(spark):
    rows = conversations()
    assert sorted(map(tuple, C.formatted(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_stream_holds_each_prefix_once_and_attention_sees_the_whole_conversation(spark):
    rows = conversations(40, 3) + [(900 + k, t, "user", f"deep {t} {k if t > 30 else 0}") for k in range(6) for t in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that trees are spread over tasks
    try:
        packed, leaves = C.pack(frame(spark, rows))
        nodes = {bytes(r["path"]): r for r in packed.collect()}
        assert sorted(map(tuple, C.read_back(packed, leaves).collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    prefixes = set()
    for conv in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, r, x in sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)]
        prefixes |= {tuple(turns[: k + 1]) for k in range(len(turns))}
    assert len(nodes) == len(prefixes)
    stream = np.concatenate([np.frombuffer(r["tokens"], "<u2") for r in sorted(nodes.values(), key=lambda r: r["start"])])
    assert len(stream) == sum(r["size"] for r in nodes.values()) == max(r["start"] + r["size"] for r in nodes.values())
    order = [p for p, _ in sorted(nodes.items(), key=lambda x: x[1]["start"])]
    assert order == sorted(order)  # depth first
    for leaf in leaves.collect():
        r = nodes[bytes(leaf["path"])]
        seen = np.concatenate([np.zeros(0, np.uint16), *(stream[s["from"] : s["to"]] for s in r["attends"]), stream[r["start"] : r["start"] + r["size"]]])
        assert len(seen) == r["position"] + r["size"]
        turns = sorted((t, x or "", y or "") for c, t, x, y in rows if c == leaf["conv_id"])
        assert [(a, b) for a, b, _ in C.parse(seen)] == [(a, b) for _, a, b in turns]
        assert all(a["to"] < b["from"] for a, b in zip(r["attends"], r["attends"][1:]))


def test_escape_is_reversible_and_hides_controls():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["\\", "<", "[", "l", "b", "s>", "INST]", "é"]) for _ in range(r.randrange(9)))
        e = C.escape(t)
        assert C.unescape(e) == t and not any(c in e for c in C.CONTROLS)


def test_empty_table(spark):
    assert C.formatted(frame(spark, conversations()).limit(0)).count() == 0


def test_rows_equal_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of_spark(C.op5_chat_format(spark, sf)) == rows_of_sql(C.OP5_SQL, sf)
