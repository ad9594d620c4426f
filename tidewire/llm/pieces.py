"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here, and its normaliser, metaspace marker, scores and byte fallback are rebuilt: a
unigram model keeps its pieces' scores; a BPE model's merges are all splits of a piece into two pieces, in order of the
piece's score. New words go to the library many batches at a time, which its threads share.

Where no piece has the marker after another character, nothing is ever merged across the start of a word; texts are
then cut at their spaces, and each different word is encoded once and kept in a bounded table of a worker. Texts with
runs of spaces, spaces at an end or markers are encoded whole. Every word that enters the table, and every whole text,
is encoded by the sentencepiece library too (``verify``): ``parity`` says whether all of a text agreed. The ids are the
rebuilt tokenizer's in any case. ``round_trip`` says whether decoding the ids gave the text again; byte fallback makes
that hold for models that don't normalise, but for markers, which decode to spaces.

Defined results: null and empty texts have no ids; specials in a text are ordinary text; repeated rows are encoded
each; a null doc_id is kept. Extra columns are kept out. The model file is read on the driver and sent along with the
task (well under a few MB; its size is checked).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import CutTable, Learned, ragged, split_at, threads
from .shared import lean, plain_texts, table, text_chunks

MARK = "▁"
#: Kinds of pieces in the model file, and kinds of models: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MOST_MODEL_BYTES = 32 << 20
#: Words that are joined into one text for the library; a batch has many such texts.
GROUP = 512


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- the model file ------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; 4- and 8-byte values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a SentencePiece model")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> ModelFile:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                out.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                out.kind, out.byte_fallback, out.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
            elif number == 3:
                f = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.squeeze, out.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if out.kind not in (UNIGRAM, BPE) or out.suffix:
            raise ValueError("only unigram and BPE models with a marker in front are rebuilt")
        return out

    def id_of(self, kind: int) -> int | None:
        return next((i for i, p in enumerate(self.pieces) if p[2] == kind), None)

    def words_stand_alone(self) -> bool:
        """Whether no piece has the marker after another character."""
        return self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def merges(model: ModelFile) -> list[tuple[str, str]]:
    """All splits of a piece into two pieces, the best-scored piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: ModelFile, whole: bool = True):
    """A Tokenizer; ``whole``: for texts, else for chunks that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.id_of(UNKNOWN)
    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=merges(model), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        low = min((s for _, s, _ in model.pieces), default=0.0) - 1e4  # never chosen for ordinary text
        core = models.Unigram([(p, s if kind in (NORMAL, USER_DEFINED) else low) for p, s, kind in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    if whole:
        steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)] * model.escape
        out.normalizer = normalizers.Sequence(steps)
        if model.words_stand_alone():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * model.dummy_prefix])
    return out


class Codec:
    """Encodes and decodes batches. Made once in each worker."""

    def __init__(self, data: bytes, verify: bool = True) -> None:
        threads()
        self.model = ModelFile.parse(data)
        self.whole, self.chunk = rebuild(self.model), rebuild(self.model, whole=False)
        self.plain = self.model.words_stand_alone() and not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        self.starts = np.array([p[:1] == MARK for p, _, _ in self.model.pieces])
        self.table = CutTable(self._learn, np.uint32)
        self.judge = None
        if verify:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        texts = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.first, self.flat = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(texts), np.uint8)

    def _learn(self, words: list[bytes]) -> tuple[Learned, list[bool]]:
        """Ids of words without their marker, and where the judge's differ."""
        flat, first, held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        odd: list[bool] = []
        groups = [[w.decode() for w in words[a : a + GROUP]] for a in range(0, len(words), GROUP)]
        for group, e in zip(groups, self.chunk.encode_batch_fast([MARK + MARK.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = split_at(ids, self.starts, len(group))  # each word begins at the one id that begins with the marker
            flat.append(ids), first.append(held + at)
            held += len(ids)
            if self.judge is None or self.judge.encode(" ".join(group)) == e.ids:
                odd += [False] * len(group)
            else:
                odd += [self.judge.encode(w) != ids[s:t].tolist() for w, s, t in zip(group, at, [*at[1:], len(ids)], strict=True)]
        begins = np.concatenate(first)
        return Learned(np.concatenate(flat), begins, np.diff(begins, append=held)), odd

    def _whole(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        if self.judge is None:
            return ids, [False] * len(ids)
        return ids, [a.tolist() != b for a, b in zip(ids, self.judge.encode(texts, num_threads=1), strict=True)]

    def encode(self, column: pa.Array) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether both libraries agree on them."""
        out: list[np.ndarray] = []
        agree: list[bool] = []
        for a, b, data, offsets in text_chunks(column):
            n, size = b - a, len(data)
            empty = offsets[1:] == offsets[:-1]
            spaces = np.flatnonzero(data == 32)
            odd = np.full(n, not self.plain) & ~empty
            if self.plain and size:
                odd = ~empty & ((data[np.minimum(offsets[:-1], size - 1)] == 32) | (data[offsets[1:] - 1] == 32))
                odd[np.searchsorted(offsets, spaces[data[np.maximum(spaces - 1, 0)] == 32], side="right") - 1] = True
                raw = data.tobytes()
                place = raw.find(mark := MARK.encode())
                while place >= 0:
                    odd[np.searchsorted(offsets, place, side="right") - 1] = True
                    place = raw.find(mark, place + 1)
            first = np.zeros(size + 1, bool)
            first[offsets[:-1][~empty]] = True
            begins = first.copy()
            begins[spaces + 1] = True
            at = np.flatnonzero(begins[:size])
            # a word ends before the space that leads to the next one, a text's last word where the next text begins
            ends = np.append(np.where(first[at[1:]], at[1:], at[1:] - 1), size)[: len(at)]
            piece = np.searchsorted(at, offsets)
            keep = ~np.repeat(odd, np.diff(piece))
            piece = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(piece)))])
            ids, close, differ = self.table.encode(data, at[keep], ends[keep])
            cut = np.concatenate([[0], close])[piece]
            here = [ids[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
            wrong = np.concatenate([[0], np.cumsum(differ)])[piece]
            fine = (wrong[1:] == wrong[:-1]).tolist()
            rows = np.flatnonzero(odd)
            for k, got, bad in zip(rows, *self._whole([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in rows]), strict=True):
                here[k], fine[k] = got, not bad
            out += here
            agree += fine
        return out, agree

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts' bytes."""
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        position, close = ragged(self.first[flat], self.length[flat])
        raw = self.flat[position].tobytes()
        ends = np.concatenate([[0], close])[np.cumsum([0, *(len(i) for i in ids)])].tolist()
        lead = self.model.dummy_prefix
        return [raw[s + 1 : e] if lead and raw[s : s + 1] == b" " and e > s else raw[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


_codecs: dict[tuple[bytes, bool], Codec] = {}


def worker_codec(data: bytes, verify: bool) -> Codec:
    if (data, verify) not in _codecs:
        _codecs.clear()
        _codecs[data, verify] = Codec(data, verify)
    return _codecs[data, verify]


def encode(docs: DataFrame, model_path: str | None = None, verify: bool = True, digest: bool = False) -> DataFrame:
    """(doc_id, ids or, with ``digest``, ids_crc32, n_tokens, parity, round_trip)."""
    path = model_path or default_model()
    if os.path.getsize(path) > MOST_MODEL_BYTES:
        raise ValueError(f"the model has over {MOST_MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data, verify)
        for batch in batches:
            texts = plain_texts(batch.column(1))
            for a in range(0, len(texts), 512):
                some = texts.slice(a, 512)
                ids, parity = codec.encode(some)
                back = [d == t.as_buffer().to_pybytes() for d, t in zip(codec.decode(ids), some, strict=True)]
                if digest:
                    what = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
                else:
                    what = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), what, pa.array([len(i) for i in ids], pa.int64()), pa.array(parity), pa.array(back)], names=["doc_id", "ids_crc32" if digest else "ids", "n_tokens", "parity", "round_trip"])

    what = "ids_crc32 long" if digest else "ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, {what}, n_tokens long, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""
    with open(model_path or default_model(), "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, verify=False)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            back = codec.decode([np.array(ids or [], np.int64) for ids in rows])
            texts = [None if ids is None else t.decode("utf-8", "replace") for ids, t in zip(rows, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id long, text string")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, ids, n_tokens, parity, round_trip."""
    return encode(docs)
