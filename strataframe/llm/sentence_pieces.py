"""SentencePiece models rebuilt in the tokenizers library, for encoding and decoding."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataframe.llm.common import WordRows, columns, leanly, ragged, runs_of_texts

MARK = "▁"
#: Words that a worker remembers with their ids.
MEMO = 300_000
# Field numbers of the model file's messages, and the kinds of pieces and models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_ID = 3, 35, 40
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as numbers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind} at byte {at}")


class Spec(NamedTuple):
    """What a model file says: pieces as (text, score, kind), and the settings that encoding needs."""

    pieces: list[tuple[str, float, int]]
    model_type: int
    unknown: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool


def read_model(path: str) -> Spec:
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == PIECES:
            got = dict(fields(value))
            pieces.append((got.get(PIECE, b"").decode(), struct.unpack("<f", got[SCORE])[0] if SCORE in got else 0.0, got.get(KIND, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    return Spec(pieces, trainer.get(MODEL_TYPE, UNIGRAM), trainer.get(UNKNOWN_ID, 0), bool(trainer.get(BYTE_FALLBACK, 0)), normalizer.get(CHARSMAP, b""), bool(normalizer.get(DUMMY_PREFIX, 1)), bool(normalizer.get(REMOVE_EXTRA, 1)))


def build(spec: Spec):
    """The model as a Tokenizer: its normaliser, space marker, piece scores and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    unknown = spec.pieces[spec.unknown][0]
    if spec.model_type == UNIGRAM:
        low = min((s for _, s, k in spec.pieces if k == NORMAL), default=0.0)
        model = models.Unigram([(p, s if k in (NORMAL, USER) else low - 100) for p, s, k in spec.pieces], spec.unknown, spec.byte_fallback)
    elif spec.model_type == BPE:
        # A piece's merges are its splits into two pieces; better scores merge first.
        usable = {p for p, _, k in spec.pieces if k in (NORMAL, USER)}
        merges = []
        for p, s, k in spec.pieces:
            if k in (NORMAL, USER):
                halves = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
                merges += [(-s, vocab[p], vocab[a], vocab[b], a, b) for a, b in halves]
        model = models.BPE(vocab, [m[4:] for m in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} isn't supported")
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not crossing(spec):
        # No piece goes on past a mark, so none reaches from one word into the next.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    decode = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if spec.byte_fallback else []), decoders.Fuse()]
    out.decoder = decoders.Sequence([*decode, *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return out


def crossing(spec: Spec) -> bool:
    return any(MARK in p.lstrip(MARK) for p, _, k in spec.pieces if k in (NORMAL, USER))


class Codec:
    def __init__(self, path: str):
        self.spec = read_model(path)
        self.library = build(self.spec)
        # Words can be remembered where spaces only part them: nothing maps or strips characters.
        self.by_word = not (self.spec.charsmap or self.spec.remove_extra or crossing(self.spec)) and self.spec.dummy_prefix
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])
        self.words = WordRows(self._learn, MEMO)
        # What each piece stands for, as bytes, and the pieces that stand for none.
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.spec.pieces]
        self.odd = np.array([k in (UNKNOWN, CONTROL, UNUSED) for _, _, k in self.spec.pieces])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words parted by single spaces, in several threads; each begins with the only piece of it that has a mark."""
        texts = [x.decode() for x in words]
        made = self.library.encode_batch([" ".join(texts[lo : lo + 2000]) for lo in range(0, len(texts), 2000)], add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, np.int64) for x in made])
        at = np.flatnonzero(self.begins[flat])
        if len(at) != len(words):
            raise ValueError("the model doesn't mark the beginnings of words")
        return flat, np.diff(np.r_[at, len(flat)])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; the library works on a batch in several threads."""
        if not self.by_word:
            return self.whole(texts)
        plain = [bool(t) and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t for t in texts]
        flat, n = self.words.ids([t.encode().split(b" ") for t, ok in zip(texts, plain, strict=True) if ok])
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        own = iter([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        odd = iter(self.whole([t for t, ok in zip(texts, plain, strict=True) if not ok]))
        return [next(own) if ok else next(odd) for ok in plain]

    def decodes(self, ids: list[bytes], texts: list[str]) -> list[bool]:
        """Whether each text's ids decode to it: by the pieces' bytes, and by the library where these don't give the text."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        got = self.raw[ragged(self.raw_start[flat], self.raw_size[flat])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.raw_size[flat])])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        lead = b" " * self.spec.dummy_prefix
        out = [got[a:b] == (lead + t.encode() if t else b"") for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
        if self.odd[flat].any() or not all(out):
            check = [i for i, (x, ok) in enumerate(zip(ids, out, strict=True)) if not ok or self.odd[np.frombuffer(x, "<u4")].any()]
            for i, back in zip(check, self.decode([ids[i] for i in check]), strict=True):
                out[i] = back == texts[i]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


_held: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _held:
        _held[path] = Codec(path)
    return _held[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): little-endian 32-bit ids of each whole text; null and empty texts have none."""

    @leanly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            made = [x for lo, hi in runs_of_texts(rows) for x in codec(model).encode(rows[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.binary())], ["doc_id", "ids"])

    return columns(docs, id_col, text=text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codec(model).decode([x or b"" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_tokens, ids_crc32, parity and round_trip.

    ``parity`` compares the ids of every whole text with the sentencepiece library's, and
    ``round_trip`` the text that all its ids decode to with the input. Null and empty texts have no
    tokens and pass both. Rows are independent, so repeated rows have equal results; an empty table
    gives an empty result. A very long text is encoded alone and held whole.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    @leanly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        reference = sentencepiece.SentencePieceProcessor(model_file=model)
        held = codec(model)
        for batch in batches:
            ids, rows, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for lo, hi in runs_of_texts(rows):
                some = rows[lo:hi]
                made = held.encode(some)
                back = held.decodes(made, some)
                want = reference.encode(some, num_threads=1)
                flat = np.fromiter(itertools.chain.from_iterable(want), "<u4", sum(map(len, want))).tobytes()
                ends = np.cumsum([0, *(4 * len(w) for w in want)]).tolist()
                out += [(i, len(x) // 4, zlib.crc32(x), flat[a:b] == x, ok) for i, x, a, b, ok in zip(ids[lo:hi], made, ends[:-1], ends[1:], back, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    return columns(docs, id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
