"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is parsed here (a protobuf reader of the few fields that matter), and the tokenizer rebuilt from it: the normaliser
(precompiled character map, removal of extra spaces, dummy prefix, the metaspace marker), the pieces with their scores (a unigram
model, or the merges that a BPE model's scores imply) and byte fallback.  It takes raw texts.  Parity is verified on whole texts: every text's ids
are held against those of the sentencepiece library itself.

Speed: no piece of such a vocabulary has a marker behind another character (checked when the model is built), so no merge crosses
the start of a run of markers, and a text's ids are those of its words one after another.  Words are remembered within a bound of bytes and encoded in
batches by the library's own threads.  A model whose pieces do cross words is encoded text by text, in batches too.

Defined results: null is the empty text, which has no ids; ids decode to the normalised text, with control pieces left out
and bytes that are no UTF-8 as replacement characters.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm import common
from freshet.llm.encode import Memory, grouped, split

#: Fixed values of the model format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

MARK = "▁"
#: Words encoded in one text.
RUN = 64


class Unsupported(ValueError):
    """The model needs something that is not rebuilt here."""


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marks: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 1:
            yield number, data[at : at + 8]
            at += 8
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire == 5:
            yield number, data[at : at + 4]
            at += 4
        else:
            raise Unsupported(f"protobuf wire type {wire}")


def parse(data: bytes) -> Model:
    """A model file; the field numbers are those of the public model format."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:  # a piece: text, score, type
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:  # how it was trained
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.suffix_marks = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:  # how texts are normalised
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    if m.kind not in (UNIGRAM, BPE) or m.suffix_marks or not m.escape:
        raise Unsupported("only unigram and BPE models with leading markers are rebuilt")
    return m


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges in the order a BPE model's scores imply: a piece may form from any two pieces that make it up, best piece first."""
    known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    made = []
    for piece in known:
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in known and right in known:
                made.append((-pieces[known[piece]][1], known[left], known[right], left, right))
    made.sort()
    return [(x[3], x[4]) for x in made]


def rebuild(m: Model, raw: bool = True):
    """The tokenizers-library tokenizer of a model; it takes raw texts, or, without ``raw``, texts that are normalised and marked."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab=vocab, merges=merges(m.pieces), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    if raw:
        chain = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            chain += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if m.dummy_prefix:
            chain.append(normalizers.Prepend(MARK))
        t.normalizer = normalizers.Sequence([*chain, normalizers.Replace(" ", MARK)])
    special = [AddedToken(p, normalized=False, special=kind == CONTROL) for p, _, kind in m.pieces if kind in (CONTROL, USER_DEFINED)]
    if special:
        t.add_tokens([x for x in special if not x.special])
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(steps)
    return t


@contextmanager
def threads() -> Iterator[None]:
    """The library's own threads are on inside, whatever other operators in this worker have set."""
    before = os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ.setdefault("RAYON_NUM_THREADS", str(max(2, int(os.environ.get("OMP_NUM_THREADS") or 2))))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    try:
        yield
    finally:
        if before is None:
            del os.environ["TOKENIZERS_PARALLELISM"]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = before


class Pieces(Memory):
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.lib, self.marked = rebuild(self.model), rebuild(self.model, raw=False)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        user_defined = any(kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.by_word = self.model.kind == BPE and not user_defined and not any(crossing.search(p) for p, _, _ in self.model.pieces)
        self.control = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        spelled = [b"" if kind == CONTROL else bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        sizes = np.array([len(x) for x in spelled], np.int64)
        #: Bytes of all pieces, one behind another, where each begins, and their sizes.
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

    def normalise(self, text: str) -> str:
        """The text as the model sees it: mapped characters, spaces squeezed, marked."""
        return self.lib.normalizer.normalize_str(text) if text else ""

    def _ids(self, lib, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _learn(self, units: list[bytes]) -> list[bytes]:
        """Ids of single words.  Words of one leading marker are encoded many in a text; each has one piece that begins with a marker, its first."""
        words = [u.decode().replace(" ", MARK) for u in units]
        plain = [w for w in words if simple(w)]
        texts = [plain[i : i + RUN] for i in range(0, len(plain), RUN)]
        found: dict[str, bytes] = {}
        for i in range(0, len(texts), 256):
            group = texts[i : i + 256]
            for run, e in zip(group, self.marked.encode_batch_fast(["".join(r) for r in group], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                starts = np.flatnonzero(self.begins[ids])
                if len(starts) == len(run):
                    raw, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
                    at = 0
                    for word, end in zip(run, ends, strict=True):
                        found[word] = raw[at:end]
                        at = end
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._ids(self.marked, rest), strict=True))
        return [found[w] for w in words]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        with threads():
            if not self.by_word:
                return self._ids(self.lib, [t or "" for t in texts])
            # normalised texts, the marker as a blank
            if self.model.charsmap or self.model.squeeze:
                column = pa.array([self.normalise(t or "") for t in texts], pa.string())
            else:
                column = pc.fill_null(pa.array(texts, pa.string()), "")
                if self.model.dummy_prefix:
                    column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
            column = pc.replace_substring(column, MARK, " ")
            out: list[bytes] = []
            for data, begins in grouped(column, CHARS):
                space = data == 32
                start = space.copy()
                start[1:] &= ~space[:-1]
                start[begins[begins < len(data)]] = True
                at = np.flatnonzero(start)
                out += split(*self.spell(data, at, np.searchsorted(at, begins)))
            return out

    def verified(self, texts: list[str | None], ids: list[bytes], sp) -> tuple[list[bool], list[bool]]:
        """Of each whole text: whether the sentencepiece library gives the same ids, and whether they decode to the normalised text."""
        theirs = sp.encode([t or "" for t in texts], num_threads=1)
        parity = [np.array(a, "<u4").tobytes() == b for a, b in zip(theirs, ids, strict=True)]
        whole = [back.replace(MARK, " ") == self.plain(t or "") for back, t in zip(self.decode(ids), texts, strict=True)]
        return parity, whole

    def plain(self, text: str) -> str:
        """The normalised text with blanks for markers, without the dummy prefix."""
        if self.model.charsmap or self.model.squeeze:
            text = self.normalise(text)[len(MARK) if self.model.dummy_prefix else 0 :]
        return text.replace(MARK, " ")

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids: the bytes of their pieces; where these are no UTF-8, what the library makes of them."""
        lists = [np.frombuffer(x, "<u4") for x in ids]
        flat = np.concatenate([*lists, np.empty(0, "<u4")])
        table, begin, size = self.spelled
        n = size[flat]
        until = np.cumsum(n)
        raw = table[np.repeat(begin[flat] - (until - n), n) + np.arange(until[-1] if len(until) else 0)].tobytes()
        ends = np.append(0, until)[np.cumsum([0, *map(len, lists)])].tolist()
        out, strip = [], self.model.dummy_prefix
        for x, a, b in zip(lists, ends[:-1], ends[1:], strict=True):
            try:
                text = raw[a:b].decode("utf-8")
                out.append(text[1:] if strip and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.lib.decode([i for i in x.tolist() if i not in self.control], skip_special_tokens=False))
        return out


def simple(word: str) -> bool:
    """One marker, then something that is neither a marker nor a space (which the normaliser would change)."""
    return len(word) > 1 and word[0] == MARK and MARK not in word[1:] and " " not in word


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def parity(path: str, texts: list[str | None]) -> list[int]:
    """Places of the texts that the sentencepiece library encodes or decodes otherwise."""
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces(path)
    mine = own.encode(texts)
    theirs = sp.encode([t or "" for t in texts], num_threads=1)
    back = own.decode(mine)
    return [i for i, (a, b, c) in enumerate(zip(mine, theirs, back, strict=True)) if np.frombuffer(a, "<u4").tolist() != b or sp.decode(b) != c]


# --- Spark ----------------------------------------------------------------------------------------------------------

#: Characters worked off at a time.
CHARS = 1 << 21


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    held, size, at = [], 0, 0
    for i in range(len(texts)):
        t = texts[i].as_py()
        held.append(t)
        size += len(t or "")
        if size >= CHARS:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _plus(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for at, held in _groups(column):
                data = [np.frombuffer(x, "<u4").astype(np.int32) for x in pieces(path).encode(held)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*data, np.empty(0, np.int32)])))
                part = batch.slice(at, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, into])

    return docs.mapInArrow(run, _plus(docs, into, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in the array column ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for at in range(0, batch.num_rows, 256):
                part = [np.array(x or [], "<u4").tobytes() for x in column.slice(at, 256).to_pylist()]
                rows = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pieces(path).decode(part), pa.string())], names=[*rows.schema.names, into])

    return docs.mapInArrow(run, _plus(docs, into, T.StringType()))


def op6_sentencepiece(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of every document, whether its ids decode to its normalised text, and whether the sentencepiece library gives the same ids.

    Every whole text is encoded by the library too, and compared.
    """
    import zlib

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for at, held in _groups(batch.column(1)):
                own = pieces(path)
                ids = own.encode(held)
                same, whole = own.verified(held, ids, sp)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(whole), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"],
                )
        pieces(path).rest()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(documents, "text").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
