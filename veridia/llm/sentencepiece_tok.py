"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; the normaliser, the metaspace marker, the
unigram scores (or BPE merges, rebuilt from the piece scores) and the byte
fallback are rebuilt as a ``tokenizers.Tokenizer``, which encodes batches with
several threads. Parity with the original library is verified on a battery of
hard texts whenever a backend is built, on the first texts of each task, and on
all of them on request.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, send, slices, small_batches, trim

MARK = "▁"
# --- fixed values: piece kinds of the model format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of the fields of a protobuf message; varints as int, others as bytes."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape: bool = True
    suffix: bool = False


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.strip_spaces = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def merges_of(vocab: dict[str, tuple[int, float]]) -> list[tuple[str, str]]:
    """BPE merges by falling score of what they make; every split into two known pieces counts."""
    found = []
    for piece, (i, score) in vocab.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in vocab and b in vocab:
                found.append((-score, i, vocab[a][0], vocab[b][0], a, b))
    found.sort()
    return [(a, b) for *_, a, b in found]


#: hard texts on which every new backend is compared with the original library
BATTERY = (
    "", " ", "  two  spaces ", "a", "Hello, world!", "tabs\tand\nlines\r\n", "naïve Ærøskøbing Straße ñandú", "日本語のテキスト", "🙂🙂 emoji ​ zero", "x" * 300,
    MARK + "mark " + MARK * 3, "<s> </s> <unk> <0x41>", " nbsp　wide", "é combining ﬁ ligature", "1234567890 3.14 -7", "a\x00b\x7f", "trailing   ", "\U0010ffff",
)


#: words whose pieces a backend remembers
CACHE = 10_000


class Backend:
    """encode and decode as the model's own library does."""

    def __init__(self, data: bytes, verify: bool = True, ready: str | None = None):
        """``ready``: the tokenizer of another backend of this model, as text; building one takes much memory for a moment."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.data, m = data, parse_model(data)
        self.model = m
        if m.suffix:
            raise ValueError("models with the marker as suffix are not supported")
        # control, unknown and unused pieces can never be made from text
        usable = {p: (i, s) for i, (p, s, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        unk = m.pieces[m.unk_id][0]
        if ready is not None:
            inner = None
        elif m.kind == 2:
            vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
            inner = models.BPE(vocab=vocab, merges=merges_of(usable), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=CACHE)
        elif m.kind == 1:
            inner = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model kind {m.kind} is not supported")
        tok = Tokenizer(inner) if ready is None else Tokenizer.from_str(ready)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.strip_spaces:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
        # words are cut before a marker that follows other text, unless a piece crosses such a place
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        self.tok = tok
        if not self.crossing:
            tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        steps = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if m.byte_fallback else []), decoders.Fuse()]
        tok.decoder = decoders.Sequence(steps)
        self.user = sorted((p for p, _, k in m.pieces if k == USER), key=len, reverse=True)
        if self.user:
            raise ValueError("models with user-defined pieces are not supported")
        table = {i: p.replace(MARK, " ").encode() for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, UNUSED)}
        table |= {i: bytes([int(p[1:-1], 16)]) for i, (p, _, k) in enumerate(m.pieces) if k == BYTE}
        table |= {i: b"" for i, (_, _, k) in enumerate(m.pieces) if k == CONTROL}
        self.bytes_of = table.__getitem__
        if verify:
            self.verify(list(BATTERY))

    def surface(self, text: str) -> str:
        """The text with the marker for spaces and in front, as pieces are cut from it."""
        if self.model.charsmap or self.model.strip_spaces:
            text = self.tok.normalizer.normalize_str(text)
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def plain(self, surface: str) -> str:
        """What decoding gives back for a text with this surface, where no piece is unknown."""
        out = surface.replace(MARK, " ")
        return out[1:] if self.model.dummy_prefix else out

    def encode(self, texts: list[str], ready: list[str] | None = None) -> list[list[int]]:
        """Ids of texts; ``ready`` may hold their surfaces."""
        ready = [self.surface(t) for t in texts] if ready is None else ready
        normal, self.tok.normalizer = self.tok.normalizer, None
        try:
            out = [e.ids for e in self.tok.encode_batch_fast(ready, add_special_tokens=False)]
        finally:
            if normal is not None:
                self.tok.normalizer = normal
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        out = []
        for row in ids:
            try:
                out.append(b"".join(map(self.bytes_of, row)).decode())
            except (UnicodeDecodeError, KeyError):  # bytes that are no UTF-8, or ids that are none
                out.append(self.tok.decode(row, skip_special_tokens=True))
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in out]

    def verify(self, texts: list[str]) -> None:
        """Raise unless ids and decoded texts equal those of the original library."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        theirs = own.encode(texts)
        for text, a, b in zip(texts, self.encode(texts), theirs):
            if a != b:
                raise AssertionError(f"ids differ on {text[:80]!r}: {a[:20]} and {b[:20]}")
        for text, a, b in zip(texts, self.decode(theirs), own.decode(theirs)):
            if a != b:
                raise AssertionError(f"decoding differs on {text[:80]!r}: {a[:80]!r} and {b[:80]!r}")


#: texts, and bytes of them, encoded at once; bounds the encodings held in memory
SLICE, SLICE_BYTES = 96, 1 << 18


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, verify_all: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_ok for every row of ``docs`` (doc_id, text).

    Null and empty texts give an empty list; repeated rows and null ids are
    encoded like any other row, very long texts whole; further columns are left
    out; an empty table gives an empty one. ``decoded_ok`` says that decoding the
    ids gives the normalised text back. The first texts of every task, with
    ``verify_all`` all texts, are also compared with the original library; a
    difference fails the job. The model file, of fixed size, is read on the driver and broadcast.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read()
    raw = send(docs.sparkSession, {"data": data, "ready": Backend(data).tok.to_str()})
    trim()

    def run(batches):
        import os

        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        own, checked = raw.value, False
        if "backend" not in own:  # one for a worker's life: every tokenizer made leaves some memory behind
            own["backend"] = Backend(own["data"], False, own["ready"])
        backend = own["backend"]
        for batch in batches:
            for some in slices(batch, batch.column(1), SLICE, SLICE_BYTES):
                texts = [t or "" for t in some.column(1).to_pylist()]
                if verify_all or not checked:
                    backend.verify(texts)
                    checked = True
                ready = [backend.surface(t) for t in texts]
                ids = backend.encode(texts, ready)
                ok = [d == backend.plain(r) for d, r in zip(backend.decode(ids), ready)]
                sizes = [len(i) for i in ids]
                flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes))
                column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), column, pa.array(ok, pa.bool_())], names=["doc_id", "n_tokens", "ids", "decoded_ok"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids array<int>, decoded_ok boolean")
