"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are words, A-Z in lower case, and an end after each text; all counts are taken over every
training text. Every token of the training texts belongs to one of 65,536 leaves: the commonest ones to a
leaf of their own, all others to leaves that they share by their hash. A leaf is reached by three
choices (32, 32 and 64 ways), each of which is a log-bilinear model of its own: after tokens u, v

    s(child) = (c_1 * r_u + c_2 * r_v) . q_child + b_child

with a vector r for each leaf as context, q for each child of each node, position weights c and biases b. A
token's probability is the product of its three choices, each normalised over the children by a matrix
product, times its share in its leaf, (count + 1) / sum over the leaf of (count + 1). One more token, of count
0, stands for all that were never trained on, so probabilities of all tokens sum to 1.

Training is noise-contrastive, in mini-batches over every training text: a child is told from noise
children drawn by their shares. Tasks train side by side on their own blocks of texts from the same start, and
the vectors are averaged, each weighted by how often a task has met it.

Work runs in blocks of documents. A block's distinct tokens are dealt by their hash to parts of bounded size,
counted there over all blocks, and their counts are sent back to the blocks; tokens are told apart by 64-bit hashes.
The driver sees the commonest tokens, the totals of leaves and the model, all of bounded size.

Defined cases: null text counts as empty and has the end alone; a null id is in fold crc32('') mod 7; repeated
rows each get their own row; an empty table gives an empty result; without training texts every token has
probability 1; a text longer than a block is a block of its own; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import words as W
from tarn.llm.common import fold_of, saved, table

#: Bits of the three choices; of the children of a last node, this many are for tokens with a leaf of their own.
FIRST, SECOND, THIRD, OWN = 5, 5, 6, 48
NODES = 1 << FIRST + SECOND
LEAVES = NODES << THIRD
#: The most tokens with a leaf of their own; the leaf of tokens that were never trained on, and that of what precedes a text.
HEAD, UNSEEN, START = NODES * OWN, LEAVES - 1, LEAVES - 2
SIZE = 16
BLOCK_TOKENS = 1_000_000
#: Distinct tokens, over all blocks, that one part is to count.
PART_TOKENS = 1_000_000
BATCH, NOISE, LEAST_BATCHES, RATE = 1 << 16, 8, 48, 0.1
#: The fewest tokens for which a training task is worth while.
TASK_TOKENS = 16 * BATCH
#: Leaves whose vectors are averaged together.
SHARD = 256
END = np.uint64(0x0123456789ABCDEF)
_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, vocabulary array<long>, counts array<int>"


def _pack(x: np.ndarray) -> bytes:
    """u32 numbers, by planes of bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def tokens_of(s: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each row, end included, and how many each has."""
    data = W.LOWER[s.data]
    starts, ends, rows = s.words()
    counts = np.bincount(rows, minlength=s.rows)
    out = np.full(len(rows) + s.rows, END)
    out[np.arange(len(rows)) + rows] = W.span_hashes(data, starts, ends)
    return out, counts + 1


def _one_row(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], k) for v, k in columns.values()], list(columns))


def _list_of(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    ids, held, hashes, lengths, total, made = [], [], [], [], 0, 0
    first = TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        sizes = np.concatenate(lengths)
        out = pa.concat_arrays(held).to_numpy(zero_copy_only=False)
        vocabulary, inverse, everywhere = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-everywhere, kind="stable")  # frequent ones get small numbers
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = place[inverse]
        trained = np.bincount(tokens[np.repeat(~out, sizes)], minlength=len(order))
        return _one_row(
            block=(first + made, pa.int64()),
            doc_ids=(pa.concat_arrays(ids).to_pylist(), pa.list_(pa.int64())),
            held=(out.tolist(), pa.list_(pa.bool_())),
            lengths=(sizes.tolist(), pa.list_(pa.int32())),
            tokens=(_pack(tokens), pa.binary()),
            vocabulary=(_list_of(vocabulary[order].view(np.int64)), None),
            counts=(_list_of(trained.astype(np.int32)), None),
        )

    for batch in batches:
        for s in W.slices(batch.column(2)):
            found, sizes = tokens_of(s)
            ids.append(batch.column(0).slice(s.first, s.rows))
            held.append(batch.column(1).slice(s.first, s.rows))
            hashes.append(found)
            lengths.append(sizes)
            total += len(found)
            if total >= size:
                yield block()
                ids, held, hashes, lengths, total, made = [], [], [], [], 0, made + 1
    if ids:
        yield block()


# counting


def _part_of(vocabulary: np.ndarray, parts: int) -> np.ndarray:
    return ((vocabulary >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each block and part: the tokens of that part in the block's order, and their counts in its training texts."""
    for batch in batches:
        for r in range(batch.num_rows):
            block = batch.column(0)[r].as_py()
            vocabulary = batch.column(1)[r].values.to_numpy().view(np.uint64)
            counts = batch.column(2)[r].values.to_numpy()
            part = _part_of(vocabulary, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            there = np.flatnonzero(np.diff(edges)).tolist()
            cut = [order[edges[p] : edges[p + 1]] for p in there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(there, pa.int32()), pa.array([block] * len(there), pa.int64()), pa.array([vocabulary[c].tobytes() for c in cut], pa.binary()), pa.array([counts[c].astype("<i4").tobytes() for c in cut], pa.binary())],
                ["part", "block", "tokens", "counts"],
            )


def _count(rows: pa.Table) -> pa.Table:
    """A part's tokens over all blocks (block null) with the counts of those trained on; for each block, the counts of its own in order."""
    sizes = [len(x) >> 3 for x in rows.column("tokens").to_pylist()]
    tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<i4")
    known, inverse = np.unique(tokens, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)
    trained = total > 0
    own = [x.astype("<i8").tobytes() for x in np.split(total[inverse], np.cumsum(sizes)[:-1])]
    part = rows.column("part")[0].as_py()
    return pa.table({
        "part": pa.array([part] * (len(sizes) + 1), pa.int32()),
        "block": pa.array([None, *rows.column("block").to_pylist()], pa.int64()),
        "tokens": pa.array([known[trained].tobytes(), *[None] * len(sizes)], pa.binary()),
        "counts": pa.array([zlib.compress(x, 1) for x in (total[trained].astype("<i8").tobytes(), *own)], pa.binary()),
    })


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens have counts of about the same size, and their sum."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            counts = _counts(data)
            of = np.floor(16 * np.log2(counts)).astype(np.int64)
            bins, at, types = np.unique(of, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=counts, minlength=len(bins)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(types), pa.array(total)], ["bin", "types", "total"])


def _commonest(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens, counts = np.frombuffer(data, np.int64), _counts(counted)
            wanted = np.floor(16 * np.log2(counts)).astype(np.int64) >= least
            yield pa.RecordBatch.from_arrays([pa.array(tokens[wanted]), pa.array(counts[wanted])], ["token", "c"])


class Leaves:
    """head: hashes of the tokens with a leaf of their own, the commonest first."""

    def __init__(self, head: np.ndarray) -> None:
        order = np.argsort(head)
        self.sorted = head[order]
        # in turn over all last nodes, so that all have common and rare tokens
        self.own = ((order % NODES) << THIRD) + order // NODES

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The leaf of each token that was trained on."""
        spread = W.mix(tokens)
        shared = ((spread & np.uint64(NODES - 1)).astype(np.int64) << THIRD) + OWN + ((spread >> np.uint64(32)) % np.uint64((1 << THIRD) - OWN)).astype(np.int64)
        shared = np.where(shared >= START, shared - 2, shared)
        if not len(self.sorted):
            return shared
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return np.where(self.sorted[at] == tokens, self.own[at], shared)


def _masses(batches: Iterator[pa.RecordBatch], leaves) -> Iterator[pa.RecordBatch]:
    """By leaf, the sum of count + 1 over its tokens."""
    for batch in batches:
        for data, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mass = np.bincount(leaves.value.of(np.frombuffer(data, np.uint64)), weights=_counts(counted) + 1, minlength=LEAVES)
            there = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(mass[there].astype(np.int64))], ["leaf", "mass"])


# the model


@dataclass
class Model:
    """mass: by leaf, the sum of count + 1. r, c: vectors of leaves as context and weights of the two positions; q, b: by level."""

    mass: np.ndarray
    r: np.ndarray
    c: np.ndarray
    q: list[np.ndarray]
    b: list[np.ndarray]

    def context(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[u] + self.c[1] * self.r[v]

    def log_probabilities(self, u: np.ndarray, v: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each leaf after the leaves u, v."""
        order = np.argsort(leaf.astype(np.uint16), kind="stable")
        context, total = self.context(u[order], v[order]), np.zeros(len(leaf))
        for level, (node, child) in enumerate(paths(leaf[order])):
            q, bias = self.q[level], self.b[level]
            total += np.einsum("ij,ij->i", context, q[node, child]) + bias[node, child]
            for n, a, b in groups(node):
                weights, own = np.ascontiguousarray(q[n].T), bias[n]
                for at in range(a, b, 4096):
                    s = context[at : min(b, at + 4096)] @ weights
                    s += own
                    np.clip(s, -80, 80, out=s)  # no share is as small as exp(-80)
                    np.exp(s, out=s)
                    total[at : at + len(s)] -= np.log(s.sum(axis=1))
        out = np.empty(len(leaf))
        out[order] = total
        return out


def paths(leaf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level: the node, and the child taken."""
    first, second = leaf >> SECOND + THIRD, leaf >> THIRD
    return [(np.zeros(len(leaf), np.int64), first), (first, second & (1 << SECOND) - 1), (second, leaf & (1 << THIRD) - 1)]


def groups(node: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values of a sorted array."""
    edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(node[a]), a, b


def shares(mass: np.ndarray) -> list[np.ndarray]:
    """For each level and node, the share of each child: what noise is drawn from, and where biases start."""
    by = [mass.reshape(1 << FIRST, -1).sum(axis=1)[None], mass.reshape(NODES, -1).sum(axis=1).reshape(1 << FIRST, -1), mass.reshape(NODES, -1)]
    return [x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in by]


def untrained(mass: np.ndarray, size: int = SIZE, seed: int = 0) -> Model:
    """A model that gives each leaf its share, whatever precedes it."""
    random = np.random.default_rng(seed)
    by = shares(mass)
    r = random.normal(0, 0.3, (LEAVES, size)).astype(np.float32)
    b = [np.log(np.maximum(x, 1e-30)).astype(np.float32) for x in by]
    for x, share in zip(b, by, strict=True):
        x[share == 0] = -100  # no token is there
    return Model(mass, r, np.ones((2, size), np.float32), [np.zeros((*x.shape, size), np.float32) for x in by], b)


class Trainer:
    """Noise-contrastive training in mini-batches of tokens and the two leaves before each."""

    def __init__(self, model: Model, seed: int = 0, noise: int = NOISE, rate: float = RATE) -> None:
        self.model, self.noise, self.rate = model, noise, rate
        self.random = np.random.default_rng(seed)
        self.share = [x.astype(np.float32) for x in shares(model.mass)]
        whole = max(1.0, model.mass.sum())
        self.node_share = [(model.mass.reshape(len(x), -1).sum(axis=1, keepdims=True) / whole).astype(np.float32) for x in self.share]
        self.least = [np.log(noise * np.maximum(x, 1e-30)).astype(np.float32) for x in self.share]
        # for each node, children in the proportion of their shares, at 256 places from which noise is drawn
        places = (np.arange(256) + 0.5) / 256
        self.drawn = [np.stack([np.searchsorted(np.cumsum(x), places * x.sum(), "right").clip(0, len(x) - 1) if x.sum() else np.zeros(256, np.int64) for x in by]) for by in self.share]
        self.seen_r, self.seen_q = np.zeros(LEAVES), np.zeros(LEAVES)
        self.square_r = np.full(LEAVES, 1e-3, np.float32)
        self.square = [np.full(x.shape[:2], 1e-3, np.float32) for x in model.q]

    def gradient(self, u: np.ndarray, v: np.ndarray, leaf: np.ndarray, noise: list[dict[int, np.ndarray]] | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """By the context of each token, and by q and b of each level, of the sum over tokens of

        log h(child) + sum over noise of log(1 - h(noise)),   h = 1 / (1 + exp(log(k * share) - s)).

        Tokens have to be sorted by leaf. noise: the children drawn for each node of each level, the same for all
        tokens of the batch; drawn here if not given.
        """
        m, k = self.model, self.noise
        context = m.context(u, v)
        by_context = np.zeros_like(context)
        by_q, by_b = [np.zeros_like(x) for x in m.q], [np.zeros_like(x) for x in m.b]
        for level, (node, child) in enumerate(paths(leaf)):
            q, bias = m.q[level], m.b[level] - self.least[level]
            runs = [(n, a, b, noise[level][n] if noise else self.drawn[level][n, self.random.integers(0, 256, k)]) for n, a, b in groups(node)]
            # the children taken: tokens of one child stand together
            own = q[node, child]
            true = 1 - _logistic(np.einsum("ij,ij->i", context, own) + bias[node, child])
            by_context += true[:, None] * own
            at = node * q.shape[1] + child
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            by_q[level].reshape(-1, q.shape[2])[at[first]] = np.add.reduceat(true[:, None] * context, first, axis=0)
            by_b[level].reshape(-1)[at[first]] = np.add.reduceat(true, first)
            # noise
            false = np.empty((len(leaf), k), np.float32)
            for n, a, b, drawn in runs:
                np.matmul(context[a:b], q[n, drawn].T, out=false[a:b])
                false[a:b] += bias[n, drawn]
            false = -_logistic(false)
            for n, a, b, drawn in runs:
                by_context[a:b] += false[a:b] @ q[n, drawn]
                np.add.at(by_q[level][n], drawn, false[a:b].T @ context[a:b])
                np.add.at(by_b[level][n], drawn, false[a:b].sum(axis=0))
        return by_context, by_q, by_b

    def step(self, u: np.ndarray, v: np.ndarray, leaf: np.ndarray) -> None:
        order = np.argsort(leaf.astype(np.uint16), kind="stable")
        u, v, leaf, m = u[order], v[order], leaf[order], self.model
        by_context, by_q, by_b = self.gradient(u, v, leaf)
        by_c = [(by_context * m.r[x]).mean(axis=0) for x in (u, v)]
        for c, x in zip(m.c, (u, v), strict=True):
            at, g, n = summed(x, by_context * c)
            g /= n[:, None] + 5  # a vector hardly met moves little
            self.seen_r[at] += n
            self.square_r[at] += (g * g).mean(axis=1)
            m.r[at] += self.rate * g / np.sqrt(self.square_r[at])[:, None]
        m.c += 0.1 * self.rate * np.stack(by_c)
        self.seen_q += np.bincount(leaf, minlength=LEAVES)
        for level, (g, h) in enumerate(zip(by_q, by_b, strict=True)):
            met = len(leaf) * self.node_share[level] * self.share[level] + 5  # about how many tokens each vector has to tell from noise
            g /= met[..., None]
            self.square[level] += (g * g).mean(axis=2)
            m.q[level] += self.rate * g / np.sqrt(self.square[level])[..., None]
            m.b[level] += self.rate * 0.1 * h / met


def _logistic(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, the sum of the rows of values at each, and how many there are."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[first], np.add.reduceat(values[order], first, axis=0), np.diff(np.append(first, len(at))).astype(np.float32)


def before(leaf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the two leaves before it in its text, the nearer one second."""
    one, two = np.full(len(leaf), START), np.full(len(leaf), START)
    one[1:], two[2:] = leaf[:-1], leaf[:-2]
    first = np.cumsum(lengths) - lengths
    one[first], two[first] = START, START
    two[first[lengths > 1] + 1] = START
    return two, one


def _train(batches: Iterator[pa.RecordBatch], shared, seed: int) -> Iterator[pa.RecordBatch]:
    """Train on all blocks of the task, again and again while batches are few; the vectors by shard."""
    leaves, mass = shared.value
    events, tokens = [], 0
    trainer, made, passes = Trainer(untrained(mass, seed=seed), seed), 0, 0

    def learn(block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        nonlocal made
        order = trainer.random.permutation(len(block[2])) if len(block[2]) > BATCH else np.arange(len(block[2]))
        for at in range(0, len(order), BATCH):
            trainer.step(*(x[order[at : at + BATCH]] for x in block))
            made += 1

    for batch in batches:
        for r in range(batch.num_rows):
            held, lengths, packed, vocabulary = (batch.column(i)[r] for i in range(4))
            lengths, held = lengths.values.to_numpy().astype(np.int64), held.values.to_numpy(zero_copy_only=False)
            leaf = leaves.of(vocabulary.values.to_numpy().view(np.uint64))[_unpack(packed.as_py())]
            used = np.repeat(~held, lengths)
            block = tuple(x[used] for x in (*before(leaf, lengths), leaf))
            tokens += len(block[2])
            if len(block[2]):
                learn(block)
                if tokens <= LEAST_BATCHES * BATCH:  # else there are batches enough
                    events.append(block)
    while events and made < LEAST_BATCHES:
        for block in events:
            learn(block)
    m = trainer.model
    if made:
        width = m.r.shape[1]
        last = np.concatenate([trainer.seen_r[:, None], m.r, trainer.seen_q[:, None], m.q[2].reshape(-1, width), m.b[2].reshape(-1, 1)], axis=1).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEAVES // SHARD, dtype=np.int32)), pa.array([np.full(1, tokens, "<f4").tobytes() + x.tobytes() for x in last.reshape(LEAVES // SHARD, -1)], pa.binary())], ["shard", "vectors"])
        rest = np.concatenate([[tokens], m.c.ravel(), *(x.ravel() for x in (*m.q[:2], *m.b[:2]))]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rest.tobytes()], pa.binary())], ["shard", "vectors"])


def _average(rows: pa.Table) -> pa.Table:
    """A shard over all tasks: each vector weighted by how often a task has met it, all else by tokens."""
    shard, total, seen_r, seen_q, tokens = rows.column("shard")[0].as_py(), 0.0, 0.0, 0.0, 0.0
    for data in rows.column("vectors").to_pylist():
        x = np.frombuffer(data, "<f4").astype(np.float64)
        n, x = x[0], x[1:]
        tokens += n
        if shard < 0:
            total = total + n * x
            continue
        x = x.reshape(SHARD, -1)
        width = (x.shape[1] - 3) // 2
        weight = np.full(x.shape, n)
        weight[:, : 1 + width], weight[:, 1 + width : -1] = x[:, :1] + 1e-9 * n, x[:, 1 + width : 2 + width] + 1e-9 * n
        total, seen_r = total + weight * x, seen_r + weight
    out = total / (seen_r if shard >= 0 else tokens)
    return pa.table({"shard": pa.array([shard], pa.int32()), "vectors": pa.array([out.astype("<f4").tobytes()], pa.binary())})


def fit(blocks: DataFrame, leaves: Leaves, mass: np.ndarray, seed: int = 0) -> Model:
    """Train on the blocks' training texts, in as many tasks as the cluster runs at once, if there are TASK_TOKENS for each."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((leaves, mass))  # 1.5 MB at most
    texts = blocks.select("held", "lengths", "tokens", "vocabulary").coalesce(max(1, min(spark.sparkContext.defaultParallelism, int(mass.sum()) // TASK_TOKENS)))
    found = texts.mapInArrow(partial(_train, shared=shared, seed=seed), "shard int, vectors binary")
    model = untrained(mass, seed=seed)
    for row in found.groupBy("shard").applyInArrow(_average, "shard int, vectors binary").collect():  # 9 MB
        x = np.frombuffer(row["vectors"], "<f4")
        width = model.r.shape[1]
        if row["shard"] >= 0:
            x, at = x.reshape(SHARD, -1), slice(row["shard"] * SHARD, (row["shard"] + 1) * SHARD)
            model.r[at] = x[:, 1 : 1 + width]
            model.q[2].reshape(-1, width)[at], model.b[2].reshape(-1)[at] = x[:, 2 + width : -1], x[:, -1]
            continue
        places = [model.c, *model.q[:2], *model.b[:2]]
        for to, part in zip(places, np.split(x, np.cumsum([y.size for y in places[:-1]])), strict=True):
            to[:] = part.reshape(to.shape)
    return model


# scores


def _scores(batches: Iterator[pa.RecordBatch], shared, parts: int) -> Iterator[pa.RecordBatch]:
    leaves, model, n, v = shared.value
    for batch in batches:
        for r in range(batch.num_rows):
            ids, held, lengths, tokens, vocabulary, looked = (batch.column(i)[r] for i in range(6))
            lengths, tokens = lengths.values.to_numpy().astype(np.int64), _unpack(tokens.as_py())
            vocabulary = vocabulary.values.to_numpy().view(np.uint64)
            known = np.zeros(len(vocabulary), np.int64)
            dealt = sorted(zip(looked.values.field(0).to_pylist(), looked.values.field(1).to_pylist(), strict=True))
            known[np.argsort(_part_of(vocabulary, parts), kind="stable")] = np.concatenate([_counts(x) for _, x in dealt])
            leaf = np.where(known > 0, leaves.of(vocabulary), UNSEEN)
            base = np.log10((known + 1) / (n + v + 1))
            within = np.log((known + 1) / model.mass[leaf])
            sequence = leaf[tokens]
            u, w = before(sequence, lengths)
            each = within[tokens]
            for at in range(0, len(each), 1 << 18):
                part = slice(at, at + (1 << 18))
                each[part] += model.log_probabilities(u[part], w[part], sequence[part])
            of = np.repeat(np.arange(len(lengths)), lengths)
            total = lambda x: np.bincount(of, weights=x, minlength=len(lengths))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [ids.values, held.values, pa.array(lengths), pa.array(total((known > 0)[tokens]).astype(np.int64)), pa.array(np.full(len(lengths), n)), pa.array(total(base[tokens])), pa.array(total(each) / np.log(10))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, head: int = HEAD, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the model's), in log10, one row for each of docs.

    head: the most tokens with a leaf of their own, HEAD at most.
    """
    spark = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), (fold_of(doc_id, folds) == held_out).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = saved(texts.mapInArrow(partial(_blocks, size=block_tokens), _BLOCKS), "blocks")
    entries = blocks.agg(F.sum(F.size("vocabulary"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // PART_TOKENS))
    dealt = blocks.select("block", "vocabulary", "counts").mapInArrow(partial(_deal, parts=parts), "part int, block long, tokens binary, counts binary")
    counted = saved(dealt.groupBy("part").applyInArrow(_count, "part int, block long, tokens binary, counts binary"), "counts")
    types = counted.where("block IS NULL").select("tokens", "counts")
    bins = types.select("counts").mapInArrow(_bins, "bin long, types long, total long").groupBy("bin").agg(F.sum("types").alias("types"), F.sum("total").alias("total")).orderBy(F.desc("bin")).collect()  # 1024 rows at most
    n, v = sum(r["total"] for r in bins), sum(r["types"] for r in bins)
    own, least = 0, 1 << 20
    for r in bins:
        own += r["types"]
        if own > head:
            break
        least = r["bin"]
    common = types.mapInArrow(partial(_commonest, least=least), "token long, c long").toArrow()  # `head` rows at most
    order = np.lexsort((common.column("token").to_numpy(), -common.column("c").to_numpy()))
    leaves = Leaves(common.column("token").to_numpy()[order].view(np.uint64))
    at = spark.sparkContext.broadcast(leaves)
    mass = np.zeros(LEAVES)
    for r in types.mapInArrow(partial(_masses, leaves=at), "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).collect():  # LEAVES rows at most
        mass[r["leaf"]] = r["mass"]
    mass[UNSEEN] += 1
    shared = spark.sparkContext.broadcast((leaves, fit(blocks, leaves, mass), n, v))  # 10 MB
    looked = counted.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("looked"))
    ready = blocks.drop("counts").join(looked.hint("merge"), "block").select("doc_ids", "held", "lengths", "tokens", "vocabulary", "looked")
    return ready.mapInArrow(partial(_scores, shared=shared, parts=parts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
