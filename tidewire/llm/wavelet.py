"""Token files: a wavelet matrix for each shard of token ids, in one compressed file.

Texts are encoded with the tokenizers library, an end id is appended to each, and a shard's ids, in ascending order of
doc_id, become one bit-plane for each bit of the vocabulary, highest bit first; at each plane, ids with bit 0 go before
those with bit 1, in order. Ids are numbered by falling frequency in the shard first, so that high planes are nearly
all zeros and compress well; the file holds the numbering. A plane is stored in blocks of 2^18 bits, each compressed on its own, with the number of ones
before each block. So a file gives, without being unpacked whole: ``access`` (the id at a place), ``rank`` and
``count`` (occurrences of an id in a range), ``select`` (place of an id's n-th occurrence), ``document`` and ``decode``.

The byte-level pattern starts a new word at every space that follows no white space, at a comma or full stop after an
ASCII letter, and around a single line break, so that texts are cut there (on bytes, in numpy); each different cut is
encoded once by the library, many to a call, and kept in a bounded table of a worker. Texts with
special strings, or with a space at an end or after white space, are encoded by the library whole.

Shards are ranges of doc_id: a range partition is written as one or more files of about ``shard_tokens`` ids. Every
attempt of a task writes files of names of its own, and a small table (one row for each file), which only has what the
attempts that counted gave, says where they are; files of lost attempts are read by nobody. Files go to the shared folder.

Defined results: null texts count as empty and hold the end id only; rows with a null doc_id are left out; repeated
doc_ids are documents of their own; empty tables give no file and no rows. Extra columns are kept out.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import CutTable, Learned, split_at, threads
from .shared import cut, lean, new_path, store_of, table, text_chunks

BLOCK_BITS = 1 << 18
MAGIC = b"TWWM0001"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[33:127] = True
AFTER_BREAK = VISIBLE.copy()
AFTER_BREAK[0xC3:0xE0] = True  # two-byte characters that are no white space


class Encoder:
    """Ids of texts. One for each tokenizer lives in a worker."""

    def __init__(self, data: str) -> None:
        threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        about = json.loads(data)
        pre = about.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about.get("normalizer")
        self.starts = np.zeros(self.size, bool)  # ids whose bytes begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token[:1] == "Ġ"
        self.table = CutTable(self._learn, self.kind, most=1_500_000)

    def _learn(self, cuts: list[bytes]) -> tuple[Learned, list[bool]]:
        flat, held = [np.zeros(0, self.kind)], 0
        first, length = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        # a cut that begins with a space has no other: it begins at the one id that begins with a space
        spaced = [k for k, c in enumerate(cuts) if c[0] == 32]
        groups = [spaced[a : a + 2048] for a in range(0, len(spaced), 2048)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b"".join([cuts[k] for k in g]).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            at = split_at(ids, self.starts, len(group))
            first[group], length[group] = held + at, np.diff(at, append=len(ids))
            flat.append(ids)
            held += len(ids)
        bare = [k for k, c in enumerate(cuts) if c[0] != 32]
        each = [e.ids for e in self.tokenizer.encode_batch_fast([cuts[k].decode() for k in bare], add_special_tokens=False)]
        if bare:
            size = np.array([len(ids) for ids in each], np.int64)
            first[bare], length[bare] = held + np.cumsum(size) - size, size
            flat.append(np.array([i for ids in each for i in ids], self.kind))
        return Learned(np.concatenate(flat), first, length), [False] * len(cuts)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        for a, b, data, offsets in text_chunks(column):
            out += self._chunk(data, offsets) if self.plain else self._whole(data, offsets, range(b - a))
        return out

    def _whole(self, data: np.ndarray, offsets: np.ndarray, rows) -> list[np.ndarray]:
        texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in rows]
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n, size = len(offsets) - 1, len(data)
        empty = offsets[1:] == offsets[:-1]
        if not size:
            return [np.zeros(0, self.kind)] * n
        begins = data == 32
        spaces = np.flatnonzero(begins)
        # texts that are encoded whole
        odd = ~empty & ((data[np.minimum(offsets[:-1], size - 1)] == 32) | (data[offsets[1:] - 1] == 32))
        one, two, three = (data[np.maximum(spaces - k, 0)] for k in (1, 2, 3))
        white = (one < 33) | (one == 127) | ((two == 0xC2) & ((one == 0xA0) | (one == 0x85)))
        white |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81)) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF) | (one == 0x9F))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80)) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
        odd[np.searchsorted(offsets, spaces[white], side="right") - 1] = True
        raw = data.tobytes() if self.special else b""
        for s in self.special:
            place = raw.find(s)
            while place >= 0:
                odd[np.searchsorted(offsets, place, side="right") - 1] = True
                place = raw.find(s, place + 1)
        # cuts
        begins[offsets[:-1][~empty]] = True
        stops = np.flatnonzero((data[1:] == 44) | (data[1:] == 46)) + 1
        begins[stops[LETTER[data[stops - 1]]]] = True
        breaks = np.flatnonzero(data[1:-1] == 10) + 1
        breaks = breaks[VISIBLE[data[breaks - 1]] & AFTER_BREAK[data[breaks + 1]]]
        begins[breaks] = True
        begins[breaks + 1] = True
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], size)
        piece = np.searchsorted(at, offsets)  # the first cut of each text
        if odd.any():
            keep = ~np.repeat(odd, np.diff(piece))
            at, ends = at[keep], ends[keep]
            piece = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(piece)))])
        ids, close, _ = self.table.encode(data, at, ends)
        cut = np.concatenate([[0], close])[piece]
        out = [ids[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
        rows = np.flatnonzero(odd)
        for k, own in zip(rows, self._whole(data, offsets, rows), strict=True):
            out[k] = own
        return out


_encoders: dict[str, Encoder] = {}


def worker_encoder(data: str) -> Encoder:
    if data not in _encoders:
        _encoders.clear()
        _encoders[data] = Encoder(data)
    return _encoders[data]


# --- the file format -----------------------------------------------------------------------------------------------
# MAGIC, then the length of the head and the head: ids, documents, different ids (unsigned 64-bit each), the different
# ids by falling frequency; for each plane the number of zeros, and for each of its blocks the ones before it and the place of its bytes; documents' ids and first
# places. Then the blocks, each a zstandard frame.


def build(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A file's bytes. ``starts``: the first place of each document."""
    press = zstandard.ZstdCompressor(level=1)
    counts = np.bincount(ids)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    number = np.zeros(len(counts), ids.dtype)
    number[alphabet] = np.arange(len(alphabet))
    now, bodies, heads, at = number[ids], [], [], 0
    for plane in range(planes_of(len(alphabet)) - 1, -1, -1):
        bit = (now & now.dtype.type(1 << plane)) != 0
        packed = np.packbits(bit, bitorder="little")
        step = BLOCK_BITS // 8
        blocks = [packed[a : a + step] for a in range(0, len(packed), step)]
        ones = np.array([0, *(int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks)], np.int64)
        places = []
        for b in blocks:
            body = press.compress(b.tobytes())
            places.append(at)
            at += len(body)
            bodies.append(body)
        high = now[np.flatnonzero(bit)]  # faster than a mask, whose branches can't be foretold
        now = np.concatenate([now[np.flatnonzero(~bit)], high])
        heads.append(struct.pack("<Q", len(ids) - len(high)) + np.cumsum(ones)[: len(blocks)].astype("<u8").tobytes() + np.array([*places, at], "<u8").tobytes())
    head = struct.pack("<QQQ", len(ids), len(doc_ids), len(alphabet)) + alphabet.astype("<u4").tobytes() + b"".join(heads) + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes()
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(bodies)


def planes_of(different: int) -> int:
    return max(1, (different - 1).bit_length())


class WaveletFile:
    """Reads one file. ``data`` may be a memory map; blocks are unpacked when asked for, the last few are kept."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack_from("<Q", self.data, 8)[0]
        self.body = 16 + size
        self.n, docs, different = struct.unpack_from("<QQQ", self.data, 16)
        self.planes = planes_of(different)
        self.alphabet = np.frombuffer(self.data, "<u4", different, 40)
        self.number = {int(t): k for k, t in enumerate(self.alphabet)}
        at, blocks = 40 + 4 * different, -(-self.n // BLOCK_BITS)
        self.zeros, self.before, self.places = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", self.data, at)[0])
            self.before.append(np.frombuffer(self.data, "<u8", blocks, at + 8).astype(np.int64))
            self.places.append(np.frombuffer(self.data, "<u8", blocks + 1, at + 8 + 8 * blocks).astype(np.int64))
            at += 8 + 8 * blocks + 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        self.starts = np.frombuffer(self.data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor()
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a block, and the ones before each of its bytes."""
        if (plane, block) not in self.kept:
            if len(self.kept) >= 64:
                self.kept.pop(next(iter(self.kept)))
            a, b = self.places[plane][block], self.places[plane][block + 1]
            raw = np.frombuffer(self.unpack.decompress(bytes(self.data[self.body + a : self.body + b])), np.uint8)
            self.kept[plane, block] = raw, np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)])
        return self.kept[plane, block]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i <= 0 or self.n == 0:
            return 0
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(i, BLOCK_BITS)
        raw, ones = self._block(plane, block)
        byte, bit = divmod(rest, 8)
        return int(self.before[plane][block] + ones[byte] + (int(raw[byte]) & (1 << bit) - 1).bit_count())

    def _find(self, plane: int, want: int, bit: int) -> int:
        """Place of the want-th (from 0) bit of that value in a plane."""
        low, high = 0, self.n
        while high - low > 1:
            middle = (low + high) // 2
            ones = self._ones(plane, middle)
            low, high = (low, middle) if (ones if bit else middle - ones) > want else (middle, high)
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            ones = self._ones(p, i)
            bit = self._ones(p, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _range(self, number: int, a: int, b: int) -> tuple[int, int]:
        for p in range(self.planes):
            x, y = self._ones(p, a), self._ones(p, b)
            a, b = (self.zeros[p] + x, self.zeros[p] + y) if number >> (self.planes - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id at places a to b - 1."""
        if token not in self.number:
            return 0
        x, y = self._range(self.number[token], max(0, a), self.n if b is None else min(b, self.n))
        return max(0, y - x)

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, n: int) -> int:
        """Place of the n-th occurrence, from 0."""
        if not 0 <= n < self.count(token):
            raise IndexError(n)
        number = self.number[token]
        at = self._range(number, 0, self.n)[0] + n
        for p in range(self.planes - 1, -1, -1):
            bit = number >> (self.planes - 1 - p) & 1
            at = self._find(p, at - self.zeros[p] if bit else at, bit)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(self.unpack.decompress(bytes(self.data[self.body + a : self.body + b])) for a, b in zip(self.places[p][:-1], self.places[p][1:], strict=True))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bit)] = values[: self.zeros[p]]
            above[np.flatnonzero(bit)] = values[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            values = above
        return self.alphabet[values]

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.n
        return np.array([self.access(i) for i in range(self.starts[k], end)], np.uint32)


# --- Spark ---------------------------------------------------------------------------------------------------------


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Writes the files; gives (part, number, path, first_doc, n_tokens, n_docs), one row for each file."""
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(data)
        part, number, held = TaskContext.get().partitionId(), 0, 0
        kind = encoder.kind if end_id < 1 << 16 else np.uint32
        end = np.array([end_id], kind)
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            body = build(np.concatenate(ids).astype(kind, copy=False), np.array(doc_ids, np.int64), starts)
            path = f"{folder}/part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.wm"
            store, at = store_of(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as out:
                out.write(body)
            row = {"part": [part], "number": [number], "path": [path], "first_doc": [doc_ids[0]], "n_tokens": [sum(lengths)], "n_docs": [len(doc_ids)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                for doc, got in zip(batch.column(0).slice(a, 1024).to_pylist(), encoder.encode(batch.column(1).slice(a, 1024)), strict=True):
                    ids += [got, end]
                    doc_ids.append(doc), lengths.append(len(got) + 1)
                    held += len(got) + 1
                    if held >= shard_tokens:
                        yield flush()
                        number, held = number + 1, 0
                        ids.clear(), doc_ids.clear(), lengths.clear()
        if doc_ids:
            yield flush()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(spark, files.mapInArrow(lean(run), "part int, number int, path string, first_doc long, n_tokens long, n_docs long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts.select("part", "first"), "part").select("path", (F.col("first") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = store_of(path)
                with store.open_input_stream(at) as f:
                    file = WaveletFile(f.read())
                ids = file.decode().astype("<u4")
                ends = np.append(file.starts[1:], file.n)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(file.starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids.astype(np.int64)), pa.array(file.starts + base), pa.array(ends - file.starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "path").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark, table(spark, sf_dir, "documents"), new_path(spark, "tokens")))
