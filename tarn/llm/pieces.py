"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A model file's pieces and scores are kept as sorted 64-bit keys. Texts are cut into units where no
piece reaches across (before runs of the space mark, and around characters that no piece has);
distinct units of equal length advance together: the key of every substring grows from that of the
one before by a character, ends where no piece begins so, and is looked up among the pieces; at each
position the best sum of scores of all pieces that end there is kept with a backpointer. A unit of
over LONG characters is walked by itself, a window at a time.

The ids are those with the greatest sum of scores, for any file. On a unigram file they equal the
sentencepiece library's. A BPE file's own segmentation is the order of its merges, which no sum of
scores gives; method="merges" gives it (equal to the library), by merges over the same substrings.
Either decodes to the same text. Characters outside the vocabulary become byte pieces where the
file has them, else the unknown piece. Files with another normaliser than identity are refused.

The file is read on the driver and its bytes are broadcast.

Defined cases: null and empty text have no ids; a text's own space marks (U+2581) decode as
spaces, as in the library; repeated rows and null ids are kept; an empty table gives an empty
result; other columns of the input, whatever their names, are carried along (encode, decode) or
ignored (round_trip), and a column named as the new one is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import words as W
from tarn.llm.common import table

MARK = 0x2581
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
LONG = 256
CACHE = 150_000
SLICE = 1 << 19
WINDOW = 1 << 16


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: numbers, and bytes for all else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file, ready to encode and decode."""

    def __init__(self, model: bytes) -> None:
        text, score, kind = [], [], []
        self.type, self.dummy = UNIGRAM, True
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                text.append(own.get(1, b"").decode())
                score.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kind.append(own.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                self.dummy = bool(own.get(3, 1))
                if own.get(2) or own.get(1, b"identity") != b"identity" or own.get(4, 1):
                    raise ValueError("only files without normalisation are supported")
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE files are supported")
        self.kind = np.array(kind)
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        self.bytes = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kind == BYTE):
            self.bytes[int(text[i][3:5], 16)] = i
        normal = [i for i in range(len(text)) if kind[i] in (NORMAL, USER)]
        points = [np.array([ord(c) for c in text[i]], np.uint32) for i in normal]
        self.longest = max(map(len, points))
        self.inside = np.zeros(0x110001, bool)  # by character, whether any piece has it
        self.inside[np.concatenate(points)] = True
        if any(MARK in p[(p != MARK).argmax() :].tolist() for p in points if (p != MARK).any()):
            raise ValueError("only files whose pieces have space marks at their start alone are supported")
        lengths, keys = np.array([len(p) for p in points]), np.zeros(len(points), np.uint64)
        padded = np.zeros((len(points), self.longest), np.uint32)
        for row, p in zip(padded, points, strict=True):
            row[: len(p)] = p
        self.begins = np.zeros(1 << 22, bool)  # by the top bits of a key: some piece begins so
        for k in range(self.longest):
            on = lengths > k
            keys[on] = _grown(keys[on], padded[on, k])
            self.begins[(keys[on] >> np.uint64(42)).astype(np.int64)] = True
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal)[order]
        self.scores = np.array(score)[self.ids]
        self.may = np.zeros(1 << 22, bool)
        self.may[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        # what each id decodes to
        shown = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace("▁", " ").encode() for t, k in zip(text, kind, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_ends = np.cumsum([len(b) for b in shown])
        self.shown_sizes = np.array([len(b) for b in shown])
        self.forget()

    # tables of substrings

    def matches(self, points: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size: where pieces of that size begin in points, and their indices among the sorted keys.

        left: how many characters there are from each place on.
        """
        at, keys = np.flatnonzero(left > 0), np.zeros(0, np.uint64)
        keys = np.zeros(len(at), np.uint64)
        for size in range(1, self.longest + 1):
            keys = _grown(keys, points[at + size - 1])
            top = (keys >> np.uint64(42)).astype(np.int64)
            going = self.begins[top]
            at, keys, top = at[going], keys[going], top[going]
            may = np.flatnonzero(self.may[top])
            place = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
            same = self.keys[place] == keys[may]
            yield size, at[may[same]], place[same]
            more = left[at] > size
            at, keys = at[more], keys[more]
            if not len(at):
                return

    def substrings(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For units of one length (rows): the index among the sorted keys of the piece at [i, i + n), or -1, as [n - 1, row, i]; and scores."""
        rows, n = points.shape
        found = np.full((min(n, self.longest), rows * n), -1, np.int32)
        for size, at, index in self.matches(points.reshape(-1), np.tile(np.arange(n, 0, -1), rows)):
            found[size - 1, at] = index
        found = found.reshape(-1, rows, n)
        return found, np.where(found >= 0, self.scores[found], -np.inf)

    @property
    def alone(self) -> float:
        """The score of an unknown character."""
        return float(self.scores.min()) - 10

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Lengths of the pieces of the best segmentation at their starts, 0 elsewhere; of equal ones, that with the longest last piece.

        scores: as substrings gives them.
        """
        _, rows, n = scores.shape
        scores[0] = np.where(np.isneginf(scores[0]), self.alone, scores[0])
        best, back = np.full((n + 1, rows), -np.inf), np.zeros((n + 1, rows), np.int64)
        best[0] = 0
        for end in range(1, n + 1):
            sizes = np.arange(min(end, len(scores)), 0, -1)
            each = best[end - sizes] + scores[sizes - 1, :, end - sizes]
            pick = each.argmax(axis=0)  # the first of equal ones: the longest
            best[end], back[end] = each[pick, np.arange(rows)], sizes[pick]
        out = np.zeros((rows, n), np.int64)
        end = np.full(rows, n)
        row = np.arange(rows)
        while len(row):
            size = back[end, row]
            end = end - size
            out[row, end] = size
            row, end = row[end > 0], end[end > 0]
        return out

    def viterbi_long(self, points: np.ndarray) -> np.ndarray:
        """The same for one long unit, a window of its starts at a time; a byte is kept for each character."""
        n, most = len(points), self.longest
        back = np.ones(n + 1, np.uint16)
        best = np.full(most + 1, -np.inf)  # at the window's first place and those after it
        best[0] = 0
        for begin in range(0, n, WINDOW):
            size = min(WINDOW, n - begin)
            part = points[begin : begin + size + most - 1]
            left = np.minimum(np.arange(len(part), 0, -1), most)
            left[size:] = 0
            found = [(s, at, self.scores[index]) for s, at, index in self.matches(part, left)]
            starts = np.concatenate([at for _, at, _ in found] or [np.zeros(0, int)])
            order = np.argsort(starts, kind="stable")
            edges = np.searchsorted(starts[order], np.arange(size + 1)).tolist()
            sizes = np.concatenate([np.full(len(at), s) for s, at, _ in found] or [np.zeros(0, int)])[order].tolist()
            scores = np.concatenate([x for *_, x in found] or [np.zeros(0)])[order].tolist()
            reach, came = [*best.tolist(), *[-np.inf] * size], back[begin : begin + size + most + 1].tolist()
            came += [1] * (size + most + 1 - len(came))
            for i in range(size):
                here, a, b = reach[i], edges[i], edges[i + 1]
                if (a == b or sizes[a] > 1) and here + self.alone > reach[i + 1]:
                    reach[i + 1], came[i + 1] = here + self.alone, 1
                for k in range(a, b):
                    if here + scores[k] > reach[i + sizes[k]]:
                        reach[i + sizes[k]], came[i + sizes[k]] = here + scores[k], sizes[k]
            last = min(len(back) - begin, size + most + 1)
            back[begin : begin + last] = came[:last]
            best = np.array(reach[size : size + most + 1])
        out, end = np.zeros(n, np.int64), n
        while end > 0:
            size = int(back[end])
            end -= size
            out[end] = size
        return out

    def merges(self, scores: np.ndarray) -> np.ndarray:
        """As viterbi, by merges: while a pair of neighbours makes a piece, that with the best score, the leftmost first, becomes one."""
        _, rows, n = scores.shape
        sizes, out, row = np.ones((rows, n), np.int64), np.ones((rows, n), np.int64), np.arange(rows)
        place = np.arange(n)
        while len(row):
            nxt = place + sizes
            follows = np.where((nxt < n) & (sizes > 0), np.take_along_axis(sizes, np.minimum(nxt, n - 1), axis=1), 0)
            whole = np.where((follows > 0) & (sizes + follows <= len(scores)), sizes + follows, 0)
            each = np.where(whole > 0, scores[np.maximum(whole, 1) - 1, row[:, None], place], -np.inf)
            pick = each.argmax(axis=1)
            line = np.arange(len(row))
            going = ~np.isneginf(each[line, pick])
            out[row[~going]] = sizes[~going]
            line, pick = line[going], pick[going]
            after = pick + sizes[line, pick]
            sizes[line, pick] = whole[line, pick]
            sizes[line, after] = 0
            row, sizes = row[going], sizes[going]
        return out

    def merges_long(self, points: np.ndarray) -> np.ndarray:
        """The same for one long unit, with a heap of pairs; its table of substrings is held whole."""
        n = len(points)
        _, scores = self.substrings(points[None])
        sizes, before = np.ones(n + 1, np.int64).tolist(), list(range(-1, n))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = i + sizes[i]
            if i >= 0 and j < n and (size := sizes[i] + sizes[j]) <= len(scores) and not np.isneginf(scores[size - 1, 0, i]):
                heapq.heappush(heap, (-scores[size - 1, 0, i], i, size))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = i + sizes[i]
            if not sizes[i] or j >= n or sizes[i] + sizes[j] != size:
                continue
            sizes[i], sizes[j] = size, 0
            if i + size < n:
                before[i + size] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array(sizes[:n])

    def _ids(self, points: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin at `at` and have an index among the keys, or -1: characters that are no piece; and how many each has."""
        ids, sizes = np.where(index >= 0, self.ids[index], -1), np.ones(len(index), np.int64)
        if not (index < 0).any():
            return ids, sizes
        parts = [[i] if i >= 0 else self._fallback(int(p)) for i, p in zip(ids.tolist(), points[at].tolist(), strict=True)]
        return np.array([i for part in parts for i in part], np.int64), np.array([len(part) for part in parts])

    def _fallback(self, point: int) -> list[int]:
        data = chr(point).encode("utf-8", "surrogatepass")
        return [self.unknown] if (self.bytes[list(data)] < 0).any() else self.bytes[list(data)].tolist()

    # whole texts

    def forget(self) -> None:
        """Start with no unit known."""
        self.slots: dict[str, dict[int, int]] = {"viterbi": {}, "merges": {}}  # by method and hash of a unit
        self.held = [[np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]]  # characters and ids of known units
        self.spans = np.zeros((0, 4), np.int64)  # of each: where its characters begin, how many, where its ids begin, how many

    def encode(self, texts: list[str | None], method: str = "viterbi") -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the number of each text's."""
        shown = [("▁" * self.dummy + t).replace(" ", "▁") if t else "" for t in texts]
        points = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0, *map(len, shown)])
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        mark = points == MARK
        outside = ~self.inside[points]
        cut = np.zeros(len(points), bool)
        cut[1:] = (mark[1:] & ~mark[:-1]) | outside[1:] | outside[:-1]
        cut[0] = True
        cut[edges[:-1][edges[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        hashes, first, inverse = np.unique(W.span_hashes(points.view(np.uint8), 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        if sum(map(len, self.slots.values())) > CACHE:
            self.forget()
        slots, listed = self.slots[method], hashes.tolist()
        new = np.array([k for k, h in enumerate(listed) if h not in slots], np.int64)
        known = len(self.spans)
        self._learn(points, starts[first[new]], ends[first[new]], method)
        slots.update(zip(hashes[new].tolist(), range(known, known + len(new)), strict=True))
        slot = np.fromiter(map(slots.__getitem__, listed), np.int64, len(listed))[inverse]
        characters, ids = (x[0] if len(x) == 1 else np.concatenate(x) for x in self.held)
        self.held = [[characters], [ids]]
        at, size, to, count = self.spans[slot].T
        # a hash may stand for another unit than that known by it
        wrong = size != ends - starts
        lengths = np.where(wrong, 0, size)
        differ = characters[_places(at, lengths)] != points[_places(starts, lengths)]
        if differ.any() or wrong.any():
            wrong[np.repeat(np.arange(len(slot)), lengths)[differ]] = True
            other, begin = np.flatnonzero(wrong), len(self.spans)
            self._learn(points, starts[other], ends[other], method)
            slot[other] = begin + np.arange(len(other))
            characters, ids = (np.concatenate(x) for x in self.held)
            at, size, to, count = self.spans[slot].T
        text = np.searchsorted(edges, starts, "right") - 1
        return ids[_places(to, count)].astype(np.int64), np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)

    def _learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, method: str) -> None:
        """Segment units and append them to those that are known, in the order given."""
        lengths = ends - starts
        ids, counts, to = [np.zeros(0, np.int32)], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        held = sum(map(len, self.held[1]))

        def append(units: np.ndarray, own: np.ndarray, each: np.ndarray) -> None:
            nonlocal held
            counts[units], to[units] = each, held + np.cumsum(each) - each
            ids.append(own.astype(np.int32))
            held += len(own)

        for n in np.unique(lengths).tolist():
            group = np.flatnonzero(lengths == n)
            if n > LONG:
                for k in group.tolist():
                    own = self._long_ids(points[starts[k] : ends[k]], method)
                    append(np.array([k]), own, np.array([len(own)]))
                continue
            step = max(1, 2_000_000 // (n * min(n, self.longest)))
            for begin in range(0, len(group), step):
                part = group[begin : begin + step]
                grid = points[starts[part][:, None] + np.arange(n)]
                found, scores = self.substrings(grid)
                sizes = self.viterbi(scores) if method == "viterbi" else self.merges(scores)
                row, at = np.nonzero(sizes)
                own, each = self._ids(grid.reshape(-1), row * n + at, found[sizes[row, at] - 1, row, at])
                append(part, own, np.bincount(row, weights=each, minlength=len(part)).astype(np.int64))
        begin = sum(map(len, self.held[0]))
        self.spans = np.concatenate([self.spans, np.stack([begin + np.cumsum(lengths) - lengths, lengths, to, counts], axis=1)])
        self.held[0].append(points[_places(starts, lengths)])
        self.held[1].append(np.concatenate(ids))

    def _long_ids(self, points: np.ndarray, method: str) -> np.ndarray:
        sizes = self.viterbi_long(points) if method == "viterbi" else self.merges_long(points)
        at = np.flatnonzero(sizes)
        keys = np.zeros(len(at), np.uint64)
        for k in range(int(sizes.max())):
            on = np.flatnonzero(sizes[at] > k)
            keys[on] = _grown(keys[on], points[at[on] + k])
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self._ids(points, at, np.where(self.keys[place] == keys, place, -1))[0].astype(np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of ids end to end; counts has the number of each text's."""
        sizes = self.shown_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.shown_ends[ids] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.shown[at].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        return [data[a + (self.dummy and data[a : a + 1] == b" " and b > a) : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _grown(keys: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Keys of substrings that are a character longer."""
    return W.mix(keys * np.uint64(0xD6E8FEB86659FD93) + points.astype(np.uint64) + np.uint64(1))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def _shipped(spark: SparkSession, path: str):
    """The file's bytes (some 500 kB) for all tasks."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _loaded(data) -> Pieces:
    """One for each Python worker, which keeps known units from task to task."""
    key = hashlib.sha256(data.value).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(data.value)
    return _LOADED[key]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Parts of a column of about SLICE bytes, and where they begin."""
    for s in W.slices(column, SLICE):
        yield s.first, column.slice(s.first, s.rows).to_pylist()


def _mapped(df: DataFrame, value: Column, out: str, made: T.DataType, work) -> DataFrame:
    """df with `out`, made by work from `value`, which alone goes to Python; the other columns stay in the JVM."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != out), F.arrow_udf(work, made)(value).alias(out))


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", method: str = "viterbi") -> DataFrame:
    """docs with the ids of each text in a column of their own. method: viterbi, or merges (a BPE file's own segmentation)."""
    data = _shipped(docs.sparkSession, path)

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _loaded(data)
        for column in columns:
            for _, texts in _texts(column):
                ids, counts = pieces.encode(texts, method)
                yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _mapped(docs, F.col(text_col).cast("string"), out, T.ArrayType(T.IntegerType()), work)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids in a column of its own."""
    data = _shipped(rows.sparkSession, path)

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _loaded(data)
        for lists in columns:
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            yield pa.array([b.decode("utf-8", "replace") for b in pieces.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)], pa.string())

    return _mapped(rows, F.col(ids_col).cast("array<int>"), out, T.StringType(), work)


def _round_trip(batches: Iterator[pa.RecordBatch], data, method: str) -> Iterator[pa.RecordBatch]:
    pieces = _loaded(data)
    for batch in batches:
        for at, texts in _texts(batch.column(1)):
            ids, counts = pieces.encode(texts, method)
            back = pieces.decode(ids, counts)
            raw, ends = ids.astype("<u4"), np.cumsum(counts)
            sums = [zlib.crc32(raw[b - k : b]) for b, k in zip(ends.tolist(), counts.tolist(), strict=True)]
            same = [b == (t or "").replace("▁", " ").encode("utf-8", "surrogatepass") for b, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), pa.array(counts), pa.array(sums, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array(same)],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", method: str = "viterbi") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and round_trip: every text encoded and decoded again."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    work = partial(_round_trip, data=_shipped(docs.sparkSession, path), method=method)
    return texts.mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())
