"""Token-id files in a binary format, coded with a static range asymmetric numeral system.

A file is one or more segments; each holds consecutive documents in ascending order of their id:

    header    magic "TRNS", then u32 each: bytes of the index, of the table and of the blocks; u64: tokens
    index     zlib: per document its id (i64, with a null flag) and number of tokens (u32); per block, as
              checkpoints: its bytes, number of tokens, where its words and states begin, crc32 of its ids
    table     zlib: frequencies (u32 by id) shared by all blocks of the segment, with a sum of 2**SCALE
    blocks    each: final states of its lanes (u64), then words (u32) in the order in which decoding reads them
    newline

A block's ids are dealt to LANES interleaved coders (id i to lane i mod LANES), so numpy codes a step of
all lanes, of many blocks, at once. Blocks are independent: each can be decoded from its checkpoint, and is
held against its checksum. Spark writes the segments through its text writer, the bytes of a segment being
a line, and reads them with its binary reader; a segment's own lengths, never the newline, delimit it.

Ids are those of a byte-level BPE tokenizer file of the tokenizers library. Texts are cut before each
single space or line break, where this kind of tokenizer always cuts too, and pieces already seen are
looked up; any text with other white space is encoded whole.

A reader can decode any range of a segment's tokens, or the documents of a range of ids, from the blocks that
hold them alone.

Defined cases: null text counts as empty and has the end id alone; repeated ids keep all their rows, in the order
of their texts, and may be split over tasks; a null id comes first; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import words as W
from tarn.llm.common import new_dir, saved, table

MAGIC = b"TRNS"
SCALE, LANES, BLOCK = 18, 256, 1 << 16
LOW = np.uint64(1 << 31)
#: A segment is closed at so many tokens, a file at so many segments.
SEGMENT_TOKENS, SEGMENTS = 1 << 22, 32
CACHE = 600_000
#: Texts are encoded some bytes at a time.
SLICE = 1 << 22
HEADER = struct.Struct("<4sIIIQ")
_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Ids of whole texts, as u16 or u32, with pieces kept from one text to the next.

    kind: u32 where the largest id of the vocabulary is over 65,535, else u16, unless given.
    """

    def __init__(self, path: str, kind: type | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = kind or (np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: one character each in a byte-level vocabulary
        for piece, i in vocabulary.items():
            self.lengths[i] = len(piece)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.spaced = [t for t in special if re.search(r"[ \n\0]", t)]  # no piece holds one of these as a whole
        self.numbers: dict[str, int] = {}  # of known pieces
        self.held = np.zeros(0, self.kind)  # their ids end to end
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def irregular(self, pieces: list[str]) -> np.ndarray:
        """Flags of the pieces that texts have whose white space isn't all single spaces or line breaks between other characters."""
        if not pieces:
            return np.zeros(0, bool)
        joined = " " + " ".join(pieces)
        data = np.frombuffer(joined.encode() + b" ", np.uint8)
        at = np.flatnonzero(data == 32)
        sizes, first = np.diff(at) - 1, data[at[:-1] + 1]
        odd = (sizes == 0) | (sizes == 1) & ((first == 0) | (first == 10))
        nul = np.flatnonzero(data == 0)
        of = np.searchsorted(at, nul) - 1
        odd[of[nul > at[of] + 1]] = True
        for found in (_OTHER_SPACE, self.special):
            if found.search(joined):
                odd |= np.fromiter((found.search(p) is not None for p in pieces), bool, len(pieces))
        return odd

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Encode unseen pieces together: each begins with its white space, so nothing is merged across two of them. Their numbers.

        A piece is kept without its leading space; one that starts a text is told by a leading NUL and is put after
        a line break, whose own id is then cut off.
        """
        first = len(self.starts)
        found, starts, sizes, held = [self.held], [self.starts], [self.sizes], len(self.held)
        for at in range(0, len(pieces), 20_000):
            part = (" " + " ".join(pieces[at : at + 20_000])).encode()
            data = np.frombuffer(part, np.uint8)
            spaces = np.flatnonzero(data == 32)
            lead = data[spaces + 1]
            text = part.replace(b" \0", b"\n").replace(b" \n", b"\n").decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(np.diff(spaces, append=len(data)) - ((lead == 0) | (lead == 10)))
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1
            begins = np.concatenate([[0], cuts[:-1]]) + (lead == 0)
            found.append(ids.astype(self.kind))
            starts.append(held + begins)
            sizes.append(cuts - begins)
            held += len(ids)
        self.held, self.starts, self.sizes = np.concatenate(found), np.concatenate(starts), np.concatenate(sizes)
        return np.arange(first, len(self.starts))

    def columns(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, each text's followed by `end` if that is given, and the number of each text's.

        Texts are cut and their pieces numbered by Arrow; each distinct piece is looked up once.
        """
        n = len(texts)
        if not n:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        listed, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        pieces_of = cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(n), pieces_of)
        number = np.fromiter(map(self.numbers.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(number < 0)
        odd = self.irregular([listed[k] for k in new])
        new = new[~odd]
        kept, place = len(self.held), len(self.starts)
        fresh = [listed[k] for k in new]
        number[new] = self.learn(fresh)
        # texts with an irregular piece, with a NUL of their own or with a special token over several pieces are encoded whole
        whole = np.zeros(n, bool)
        whole[rows[number[codes] < 0]] = True
        begun = pc.starts_with(coded.dictionary, "\0").to_numpy(zero_copy_only=False)[codes]
        begun[np.cumsum(pieces_of) - pieces_of] = False
        whole[rows[begun]] = True
        for token in self.spaced:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        apart = {k: self.whole(texts[k].as_py()) for k in np.flatnonzero(whole).tolist()}
        used = number[codes[~whole[rows]]]
        sizes = self.sizes[used]
        counts = np.bincount(rows[~whole[rows]], weights=sizes, minlength=n).astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.held[np.repeat(self.starts[used] - ends + sizes, sizes) + np.arange(total)]
        if apart or end is not None:
            for k, own in apart.items():
                counts[k] = len(own)
            counts += end is not None
            last = np.cumsum(counts)
            out, free = np.zeros(last[-1], self.kind), np.ones(last[-1], bool)
            for k, own in apart.items():
                at = slice(last[k] - counts[k], last[k] - counts[k] + len(own))
                out[at], free[at] = own, False
            if end is not None:
                out[last - 1], free[last - 1] = end, False
            out[free] = ids
            ids = out
        if len(self.numbers) + len(new) > CACHE:  # the pieces met first, and so the frequent ones, stay
            self.held, self.starts, self.sizes = self.held[:kept].copy(), self.starts[:place].copy(), self.sizes[:place].copy()
        else:
            self.numbers.update(zip(fresh, range(place, len(self.starts)), strict=True))
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, counts = self.columns(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its pieces from task to task."""
    return Encoder(path)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 for each id that occurs."""
    counts = np.bincount(ids)
    there = counts > 0
    scaled = np.maximum((counts * ((1 << SCALE) - there.sum())) // max(1, counts.sum()), 0) + there
    scaled[np.argmax(scaled)] += (1 << SCALE) - scaled.sum()
    return scaled.astype(np.uint32)


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """A block of bytes for every BLOCK ids."""
    n = -(-len(ids) // BLOCK)
    steps = BLOCK // LANES
    padded = np.full(n * BLOCK, len(freq), np.int64)  # an id of all the frequency there is: it leaves a state as it was
    padded[: len(ids)] = ids
    grid = padded.reshape(n, steps, LANES)
    f_all, c_all = np.append(freq, 1 << SCALE).astype(np.uint64), np.append(_starts(freq), np.uint64(0))
    full = np.uint64(1 << SCALE)
    x = np.full((n, LANES), LOW)
    words, given = np.zeros((n, steps, LANES), np.uint32), np.zeros((n, steps, LANES), bool)
    for t in range(steps - 1, -1, -1):
        f, c = f_all[grid[:, t]], c_all[grid[:, t]]
        out = x >= (f << np.uint64(63 - SCALE))
        words[:, t], given[:, t] = x, out
        x >>= out * np.uint64(32)
        x += x // f * (full - f) + c
    return [x[b].astype("<u8").tobytes() + words[b][given[b]].astype("<u4").tobytes() for b in range(n)]


def decode_blocks(blocks: list[bytes], sizes: list[int], freq: np.ndarray) -> np.ndarray:
    """The ids of blocks that hold `sizes` ids each."""
    n, steps = len(blocks), BLOCK // LANES
    if not n:
        return np.zeros(0, np.int64)
    by_slot = np.repeat(np.arange(len(freq), dtype=np.uint64), freq)
    # by slot: an id, its frequency (SCALE + 1 bits) and the slot's place in it (SCALE bits)
    place = np.arange(len(by_slot), dtype=np.uint64) - _starts(freq)[by_slot]
    entries = (by_slot << np.uint64(2 * SCALE + 1)) | (freq.astype(np.uint64)[by_slot] << np.uint64(SCALE)) | place
    x = np.stack([np.frombuffer(b, "<u8", LANES) for b in blocks]).astype(np.uint64)
    streams = [np.frombuffer(b, "<u4", offset=8 * LANES) for b in blocks]
    first = np.cumsum([0, *(len(s) + 1 for s in streams)])[:-1][:, None]  # a spare word after each, never used
    words = np.concatenate([np.append(s, np.uint32(0)) for s in streams]).astype(np.uint64)
    at = first - 1  # of the word read last
    out = np.zeros((n, steps, LANES), np.uint64)
    mask, wide = np.uint64((1 << SCALE) - 1), np.uint64((1 << (SCALE + 1)) - 1)
    # lanes past a block's last id read on: what they read stands behind all its ids and is cut off
    for t in range(-(-max(sizes) // LANES)):
        entry = entries[(x & mask).view(np.int64)]
        out[:, t] = entry
        x >>= np.uint64(SCALE)
        x *= (entry >> np.uint64(SCALE)) & wide
        x += entry & mask
        need = x < LOW
        order = np.cumsum(need, axis=1)
        order += at
        at = order[:, -1:].copy()
        x[need] = (x[need] << np.uint64(32)) | words[np.minimum(order[need], len(words) - 1)]
    flat = (out >> np.uint64(2 * SCALE + 1)).astype(np.int64).reshape(n, BLOCK)
    return np.concatenate([flat[b, :k] for b, k in enumerate(sizes)])


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of the file."""
    freq = frequencies(ids)
    blocks = []
    for at in range(0, len(ids), BLOCK * 8):
        blocks += encode_blocks(ids[at : at + BLOCK * 8], freq)
    sizes = [min(BLOCK, len(ids) - at) for at in range(0, len(ids), BLOCK)]
    sums = [zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes()) for at in range(0, len(ids), BLOCK)]
    null = np.array([i is None for i in doc_ids], np.uint8)
    index = struct.pack("<II", len(doc_ids), len(blocks)) + null.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + counts.astype("<u4").tobytes()
    index += np.array([[len(b) for b in blocks], sizes, sums], "<u4").tobytes()
    index, coded = zlib.compress(index), zlib.compress(freq.astype("<u4").tobytes())
    data = b"".join(blocks)
    return HEADER.pack(MAGIC, len(index), len(coded), len(data), len(ids)) + index + coded + data


@dataclass(frozen=True)
class Segment:
    """What a segment's index and table say: where its blocks are, without any of them."""

    doc_ids: list[int | None]
    counts: np.ndarray
    freq: np.ndarray
    lengths: list[int]
    sizes: list[int]
    sums: list[int]
    first: int
    end: int

    @property
    def starts(self) -> np.ndarray:
        """Where each document's tokens begin in the segment, and where the last one's end."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def index_of(data: memoryview, at: int) -> Segment:
    """The segment that begins at `at`."""
    magic, n_index, n_table, n_blocks, n = HEADER.unpack_from(data, at)
    if magic != MAGIC:
        raise ValueError("not a segment of a token file")
    at += HEADER.size
    index = zlib.decompress(data[at : at + n_index])
    freq = np.frombuffer(zlib.decompress(data[at + n_index : at + n_index + n_table]), "<u4")
    at += n_index + n_table
    docs, blocks = struct.unpack_from("<II", index)
    null = np.frombuffer(index, np.uint8, docs, 8).tolist()
    ids = np.frombuffer(index, "<i8", docs, 8 + docs).tolist()
    counts = np.frombuffer(index, "<u4", docs, 8 + 9 * docs).astype(np.int64)
    lengths, sizes, sums = np.frombuffer(index, "<u4", 3 * blocks, 8 + 13 * docs).reshape(3, blocks).tolist()
    if counts.sum() != n or sum(sizes) != n:
        raise ValueError("a segment of a token file is damaged")
    return Segment([None if z else i for z, i in zip(null, ids, strict=True)], counts, freq, lengths, sizes, sums, at, at + n_blocks)


def read_range(data: memoryview, segment: Segment, start: int, stop: int) -> np.ndarray:
    """Tokens start to stop of a segment: only the blocks that hold them are decoded, each held against its checksum."""
    edges, places = np.cumsum([0, *segment.sizes]), np.cumsum([segment.first, *segment.lengths]).tolist()
    if stop <= start:
        return np.zeros(0, np.int64)
    low, high = int(np.searchsorted(edges, start, "right")) - 1, int(np.searchsorted(edges, stop, "left"))
    found = []
    for k in range(low, high, 8):
        part = range(k, min(k + 8, high))
        got, cut = decode_blocks([bytes(data[places[b] : places[b + 1]]) for b in part], segment.sizes[k : part.stop], segment.freq), 0
        for b in part:
            if zlib.crc32(got[cut : cut + segment.sizes[b]].astype("<u4").tobytes()) != segment.sums[b]:
                raise ValueError("a block of a token file is damaged")
            cut += segment.sizes[b]
        found.append(got)
    return np.concatenate(found)[start - edges[low] : stop - edges[low]]


def unpack(data: memoryview, at: int) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Ids of documents, their numbers of tokens, all tokens, and where the segment at `at` ends."""
    segment = index_of(data, at)
    return segment.doc_ids, segment.counts, read_range(data, segment, 0, sum(segment.sizes)), segment.end


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    shipped = SparkFiles.get(os.path.basename(path))
    coder = encoder(shipped if os.path.exists(shipped) else path)
    ids, parts, counts, held = [], [], [], 0

    def segment() -> pa.RecordBatch:
        packed = pack(ids, np.concatenate(counts), np.concatenate(parts).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["value"])

    for batch in batches:
        for s in W.slices(batch.column(1), SLICE):
            tokens, each = coder.columns(batch.column(1).slice(s.first, s.rows), end_id)
            doc_ids, last = batch.column(0).slice(s.first, s.rows).to_pylist(), np.cumsum(each)
            row, begin = 0, 0
            while row < s.rows:  # a segment is closed by the document that fills it
                to = min(s.rows, int(np.searchsorted(last, begin + SEGMENT_TOKENS - held, "left")) + 1)
                ids += doc_ids[row:to]
                counts.append(each[row:to])
                parts.append(tokens[begin : last[to - 1]])
                held += int(last[to - 1]) - begin
                row, begin = to, int(last[to - 1])
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    ids, parts, counts, held = [], [], [], 0
    if ids:
        yield segment()


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by end_id, to token files in the folder `to`, in ascending order of id."""
    docs.sparkSession.sparkContext.addFile(tokenizer)  # executors need not have it at this path
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # by text as well: rows of one id are in the same order in each run, and one id with very many rows doesn't meet in one task
    ordered = texts.withColumn("digest", F.xxhash64("text")).repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").drop("digest")
    ordered.mapInArrow(partial(_write, path=tokenizer, end_id=end_id), "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", SEGMENTS).text(to)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            data, at, start = memoryview(content), 0, 0
            while at < len(data):
                ids, counts, tokens, at = unpack(data, at)
                at += 1  # the writer's newline
                raw, ends = tokens.astype("<u4"), np.cumsum(counts)
                sums = [zlib.crc32(raw[b - k : b]) for b, k in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pd.DataFrame({"path": path, "doc_id": pd.array(ids, "Int64"), "start": start + ends - counts, "n_tokens": counts, "ids_crc32": np.array(sums, np.int64)})
                start += int(ends[-1])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, start (tokens before it in its file), n_tokens and ids_crc32 of each document of the token files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(_read, "path string, doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(frames: Iterator[pd.DataFrame], first: int, last: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame["content"]:
            data, at = memoryview(content), 0
            while at < len(data):
                segment = index_of(data, at)
                at = segment.end + 1
                wanted = [k for k, i in enumerate(segment.doc_ids) if i is not None and first <= i <= last]
                if wanted:  # documents are in the order of their ids, so these stand together
                    starts = segment.starts[wanted[0] : wanted[-1] + 2]
                    tokens = read_range(data, segment, int(starts[0]), int(starts[-1]))
                    yield pd.DataFrame({"doc_id": [segment.doc_ids[k] for k in wanted], "ids": np.split(tokens, starts[1:-1] - starts[0])})


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id and ids of the documents with ids from first to last, from the blocks that hold them alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(partial(_documents, first=first, last=last), "doc_id long, ids array<long>")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    to = new_dir(spark, "tokens")
    write_tokens(docs, to, tokenizer, end_id)
    rows = saved(read_tokens(spark, to), "token-index")
    # files follow each other by the task that wrote them and their number in it; the driver sees a row for each file
    totals = [(r["path"], r["n"]) for r in rows.groupBy("path").agg(F.sum("n_tokens").alias("n")).collect()]
    totals.sort(key=lambda x: [int(k) for k in re.search(r"part-(\d+)-.*-c(\d+)", x[0]).groups()])
    before, offsets = 0, []
    for path, n in totals:
        offsets.append((path, before))
        before += n
    offsets = spark.createDataFrame(offsets, "path string, before long")
    return rows.join(F.broadcast(offsets), "path").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
