"""Bounded-space online packing of token sequences.

Each partition holds at most :data:`OPEN` open windows of ``size`` tokens.  A document is cut into full windows and a
rest; the rest goes best-fit, into the open window it leaves least room in.  When it fits none, the fullest is emitted:
with ``fill`` (cutting is free) the rest's head first fills it up, so it goes out without padding.  When the stream ends,
the open windows are left over; they carry their ids, are gathered into ever fewer partitions and packed again, until
one partition with few windows remains, which is emitted: full windows first, and its last tokens in sequences whose
lengths are powers of two (which need no padding).

Defined results: a null or empty text is its end id alone.  Repeated rows and ids are packed as documents of their own.
An empty table gives no piece.  Only pieces are cut, never ids lost: each id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.encode import encode_all, forget

SIZE, OPEN = 1024, 16
#: Left-over windows that one partition packs in a merge round.
MERGE = 1024

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in PIECE.split(", ")])

#: doc_id, start, doc_tokens, ids (4 bytes an id)
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Open windows of one stream; ``emit(window)`` gets every window that is closed."""

    def __init__(self, size: int, most: int, emit: Callable[[list[Piece]], None], fill: bool = True):
        self.size, self.most, self.emit, self.fill = size, most, emit, fill
        self.windows: list[list[Piece]] = []
        self.room: list[int] = []

    def add(self, piece: Piece) -> None:
        doc, start, total, ids = piece
        n = len(ids) // 4
        at = 0
        while n - at >= self.size:
            self.emit([(doc, start + at, total, ids[4 * at : 4 * (at + self.size)])])
            at += self.size
        while at < n:
            left = n - at
            best = min((i for i, r in enumerate(self.room) if r >= left), key=self.room.__getitem__, default=None)
            if best is None and len(self.windows) < self.most:
                self.windows.append([])
                self.room.append(self.size)
                best = len(self.windows) - 1
            take = left
            if best is None:
                best = min(range(len(self.room)), key=self.room.__getitem__)
                take = min(left, self.room[best]) if self.fill else 0
            if take:
                self.windows[best].append((doc, start + at, total, ids[4 * at : 4 * (at + take)]))
                self.room[best] -= take
                at += take
            if self.room[best] == 0 or not take:
                self.emit(self.windows.pop(best))
                self.room.pop(best)

    def rest(self) -> list[list[Piece]]:
        return [w for w in self.windows if w]


def _rows(window: list[Piece], sequence: int | None) -> list[tuple]:
    out, at = [], 0
    for doc, start, total, ids in window:
        n = len(ids) // 4
        out.append((doc, start, n, zlib.crc32(ids), total, sequence, at, None if sequence is not None else ids))
        at += n
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def powers(window: list[Piece], size: int) -> Iterator[list[Piece]]:
    """The window's tokens in windows whose lengths are powers of two, the largest first."""
    queue = list(window)
    left = sum(len(p[3]) // 4 for p in queue)
    while left:
        want = 1 << (min(left, size).bit_length() - 1)
        left -= want
        out: list[Piece] = []
        while want:
            doc, start, total, ids = queue.pop(0)
            n = min(want, len(ids) // 4)
            out.append((doc, start, total, ids[: 4 * n]))
            want -= n
            if 4 * n < len(ids):
                queue.insert(0, (doc, start + n, total, ids[4 * n :]))
        yield out


def _numbers(turn: int) -> Iterator[int]:
    """Sequence ids that no other partition or merge round gives."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return count((turn << 56) | (part << 28))


def _stream(pieces: Iterator[Piece], turn: int, size: int, most: int, last: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    number = _numbers(turn)
    packer = Packer(size, most, lambda w: rows.extend(_rows(w, next(number))))
    for piece in pieces:
        packer.add(piece)
        if len(rows) >= 5000:
            yield _batch(rows)
            rows.clear()
    if last:
        # all that is open becomes one run of tokens: full windows, then powers of two
        for w in powers([p for w in packer.rest() for p in w], size):
            rows.extend(_rows(w, next(number)))
    else:
        for w in packer.rest():
            rows.extend(_rows(w, None))
    yield _batch(rows)


def pack(
    spark: SparkSession, docs: DataFrame, path: str, end: int = 0, size: int = SIZE, most: int = OPEN, root: str | None = None
) -> DataFrame:
    """Pieces of all documents (doc_id, text), packed; see the module's text."""
    root = root or common.scratch(spark, "packing")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        def pieces() -> Iterator[Piece]:
            for batch in batches:
                step = 2048
                for i in range(0, batch.num_rows, step):
                    ids, texts = (batch.column(c).slice(i, step) for c in (0, 1))
                    for doc, data in zip(ids.to_pylist(), encode_all(texts, path, end), strict=True):
                        yield doc, 0, len(data) // 4, data

        yield from _stream(pieces(), 0, size, most, last=False)
        forget(path)

    def again(turn: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[Piece]:
                for b in batches:
                    cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
                    yield from zip(*cols, strict=True)

            yield from _stream(pieces(), turn, size, most, last)

        return run

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs, "text").alias("text"))
    done, turn = [], 0
    left = common.stage(spark, docs.mapInArrow(first, PIECE), f"{root}/round-0")
    while True:
        done.append(left.where("sequence_id is not null"))
        rest = left.where("sequence_id is null")
        # left-over windows begin at offset 0, so their number is a count of rows
        windows = rest.where("offset = 0").count()
        if not windows:
            break
        turn += 1
        parts = max(1, windows // max(MERGE, 4 * most))  # each round leaves a quarter at most
        gathered = rest.coalesce(1) if parts == 1 else rest.repartition(parts)
        left = common.stage(spark, gathered.mapInArrow(again(turn, parts == 1), PIECE), f"{root}/round-{turn}")
        if parts == 1:
            done.append(left)
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("ids")


def op5_packing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(spark, documents, public_tokenizers.path("byte_bpe_50k.json"))
