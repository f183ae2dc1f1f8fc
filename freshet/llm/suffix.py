"""Suffix-array deduplication: bytes of passages of ``length`` bytes that also start earlier are removed.

A suffix array of the whole corpus would hold a row a byte.  Only suffixes in the same q-gram bucket can share
``length`` bytes, so the work is cut down bucket by bucket:

1. *Sampled q-gram buckets.*  Of the q-grams in a window of ``length`` bytes the one with the least hash stands for the window
   (a minimiser: equal windows have equal ones at equal offsets).  A run of windows with the same minimiser is a *stretch*; its bucket is
   the minimiser's hash.
2. *Refinement of buckets to whole stretches.*  Every later offset of a stretch (a step of 8 bytes) has the identifier of its own bucket, at first its 8
   bytes; a round joins the identifiers of neighbouring offsets, so the next one reuses them at twice the depth, until one identifier names
   the stretch.  Identifiers are 64-bit names, not ranks, since they have to agree over tasks.  Sorting a block's stretches on
   (bucket, identifier) puts equal ones next to each other; their bytes are compared, all but the first being repeats, so a passage
   that a third of all documents share costs one row a block.
3. *Buckets over all blocks.*  Short rows (bucket, identifier, place) are dealt by bucket and sorted in the same way; equal ones of two
   blocks are told by bucket and identifier, 128 bits.  Buckets with one stretch end there; the distinct stretches of the others may still share some windows.
4. *Refinement of buckets to windows.*  The bytes of these are read back from the block files and dealt by bucket.  The suffixes that start
   their windows are sorted to depth ``length``: first by q-grams of 8 bytes; then every bucket with more than one suffix is refined by the bucket
   identifiers of the suffixes at later offsets (8, 16, 32 ... and last so that the depths add up to ``length``), each round
   reusing the identifiers the round before updated.  Suffixes left in one bucket share ``length`` bytes; all but the earliest are
   repeats.  A bucket of more than :data:`HOT` distinct stretches is parted first: windows that hold the minimiser at nearby offsets share more
   bytes than it, and the identifier of these is the bucket of their part, for which steps 3 and 4 are done again, with ever
   longer shared bytes while a bucket is too large.
5. Repeats are applied block by block to the documents read back.

Defined results: null texts are empty.  Matches never cross documents.  The order is (doc_id with null first, then the text's hash, then
the row): rows with equal ids and texts are copies of one another, one of which is the earliest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common

LENGTH, GRAM = 100, 24
#: Distinct stretches of one bucket that one task sorts; larger buckets are parted, each time into so many parts.
HOT, PARTS = 4096, 4
#: Bytes handed to one refinement.
SORT_BYTES = 1 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of each ``gram`` bytes (a multiple of 8) of ``data``."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = data.tobytes() + bytes(8)
    words = np.ndarray((len(data) - 7,), "<u8", raw, 0, (1,))
    h = np.zeros(n, np.uint64)
    for i in range(0, gram, 8):
        h = (h ^ words[i : i + n]) * _ODD[i // 8 % 4]
        h ^= h >> np.uint64(32)
    return h


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


#: Window starts worked off at a time.
_PART = 1 << 17


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, last) of each run of window starts that have the same minimiser; ``ends``: where the texts in ``data`` end.

    Windows do not cross a text's end.
    """
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.empty(0, np.uint64), *2 * (np.empty(0, np.int64),))
    width = length - gram + 1
    valid = np.ones(windows, bool)
    for end in ends.tolist():  # a text's last length - 1 starts have no whole window
        valid[max(0, end - length + 1) : end] = False
    out_b, out_f, out_l = [], [], []
    for at in range(0, windows, _PART):
        stop = min(windows, at + _PART)
        at_valid = np.flatnonzero(valid[at:stop])
        if not len(at_valid):
            continue
        piece = gram_hashes(data[at : stop + length - 1], gram)
        # the leftmost of equal minima: 40 bits of hash, then the place
        key = (piece & ~np.uint64(0xFFFFFF)) | np.arange(len(piece), dtype=np.uint64)
        place = (slide_min(key, width) & np.uint64(0xFFFFFF)).astype(np.int64)[at_valid]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (at_valid[1:] != at_valid[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        out_b.append(piece[place[first]])
        out_f.append(at_valid[first] + at)
        out_l.append(at_valid[last] + at)
    if not out_b:
        return (np.empty(0, np.uint64), *2 * (np.empty(0, np.int64),))
    return np.concatenate(out_b), np.concatenate(out_f), np.concatenate(out_l)


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers of the suffixes at ``starts`` after sorting to depth ``length``: equal where ``length`` bytes are.

    Bucket-pointer refinement: every position has a pointer to its bucket, at first that of its 8-gram.  A round takes the
    buckets with more than one suffix, sorts each by (own pointer, pointer at a later offset), and writes the new pointers
    back for the next round to use.  Positions too close to the end for the depth count as ending in their own way.
    """
    n = len(data)
    raw = data.tobytes() + bytes(16)
    grams = np.ndarray((n,), ">u8", raw, 0, (1,)).astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.empty(0, bool)
    # a bucket's identifier is the rank of its first suffix, so refined buckets keep their order among the others
    ranks = np.flatnonzero(new)
    pointer = np.empty(n + length + 1, np.int64)
    pointer[order] = ranks[np.cumsum(new) - 1]
    pointer[n:] = -1 - np.arange(length + 1)
    depth = 8
    live = order
    while depth < length:
        step = min(depth, length - depth)
        own = pointer[live]
        # only buckets of more than one suffix are refined; the others stay as they are
        size = np.bincount(own, minlength=n)
        live = live[size[own] > 1]
        if not len(live):
            break
        own, later = pointer[live], pointer[live + step]
        by = np.lexsort((later, own))
        live, own, later = live[by], own[by], later[by]
        head = np.concatenate([[True], own[1:] != own[:-1]])
        split = head | np.concatenate([[True], later[1:] != later[:-1]])
        place = np.arange(len(live))
        base = own - place[head][np.cumsum(head) - 1]  # identifier of the old bucket, less the place of its first suffix
        fresh = (base + place)[split][np.cumsum(split) - 1]
        pointer[live] = fresh
        depth += step
    return pointer[starts]


def _words(raw: bytes, first: np.ndarray, size: np.ndarray, columns: int) -> np.ndarray:
    """The 8 bytes at each step of 8 from ``first``; the last 8 bytes again and again beyond a stretch's end."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    at = first[:, None] + np.minimum(8 * np.arange(columns)[None, :], (size - 8)[:, None])
    return words[at]


def identify(raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit identifiers of the stretches of ``size`` bytes at ``first``: those of later offsets joined to twice the depth, round after round."""
    out = np.empty(len(first), np.uint64)
    for i in range(0, len(first), 16_384):
        part = slice(i, i + 16_384)
        columns = 1 << max(0, int(-(-size[part].max() // 8) - 1).bit_length())
        x = _words(raw, first[part], size[part], columns)
        x[:, 0] ^= size[part].astype(np.uint64) * _ODD[2]
        while x.shape[1] > 1:
            x = x[:, 0::2] * _ODD[0] + (x[:, 1::2] ^ (x[:, 1::2] >> np.uint64(31))) * _ODD[1]
            x ^= x >> np.uint64(29)
            x *= _ODD[3]
            x ^= x >> np.uint64(32)
        out[part] = x[:, 0]
    return out


def equal_bytes(raw: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``size`` bytes at ``a`` and at ``b`` are equal."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 16_384):
        part = slice(i, i + 16_384)
        columns = int(-(-size[part].max() // 8))
        out[part] = (_words(raw, a[part], size[part], columns) == _words(raw, b[part], size[part], columns)).all(axis=1)
    return out


# --- first pass -----------------------------------------------------------------------------------------------------

#: kind 0: a stretch that may repeat; 1: a span known to repeat; 2: the block's marker; 3: a stretch to compare.
ROW = "kind int, bucket long, content long, doc_id long, tie int, block long, row int, first int, last int"
_ROW = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in ROW.split(", ")])
#: The order of suffixes: what is earlier counts as the original.
PLACE = ("doc_id", "tie", "block", "row", "first")
_NO_ID = -(1 << 63)


def _batches(kind: int, cols: dict[str, np.ndarray], step: int = 50_000) -> Iterator[pa.RecordBatch]:
    n = len(cols["row"])
    cols = {"kind": np.full(n, kind, np.int32)} | cols
    for i in range(0, n, step):
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[f.name][i : i + step].astype(f.type.to_pandas_dtype(), copy=False)) if f.name in cols else pa.nulls(min(step, n - i), f.type) for f in _ROW], schema=_ROW
        )


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    texts = [b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()]
    ids = table.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy()
    return texts, ids


def _first_pass(length: int, gram: int) -> Callable[[int, pa.Table], Iterator[pa.RecordBatch]]:
    def run(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, ids = _texts(table)
        yield from _batches(2, {"block": np.array([block]), "row": np.zeros(1)})
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        bucket, first, last = stretches(np.frombuffer(joined, np.uint8), ends, length, gram)
        if not len(bucket):
            return
        begins, size = first, last - first + length
        content = identify(joined, first, size).view(np.int64)
        bucket = bucket.view(np.int64)
        row = np.searchsorted(ends, first, "right")
        begin = np.concatenate([[0], ends[:-1]])[row]
        first, last = first - begin, last - begin
        doc, tie = ids[row], np.array([xxhash.xxh32_intdigest(t) >> 1 for t in texts], np.int64)[row]
        order = np.lexsort((first, row, tie, doc, content, bucket))
        b, c = bucket[order], content[order]
        again = np.concatenate([[False], (b[1:] == b[:-1]) & (c[1:] == c[:-1])])
        # sorted next to an equal identifier; the bytes decide, and one that differs gets another identifier
        mate = order[np.flatnonzero(again) - 1]
        same = (size[order[again]] == size[mate]) & equal_bytes(joined, begins[order[again]], begins[mate], np.minimum(size[order[again]], size[mate]))
        for k in order[again][~same].tolist():
            content[k] ^= np.int64(xxhash.xxh3_64_intdigest(joined[begins[k] : begins[k] + size[k]]) >> 1)
        again[np.flatnonzero(again)[~same]] = False
        at = np.sort(order[~again])
        yield from _batches(0, {"bucket": bucket[at], "content": content[at], "doc_id": doc[at], "tie": tie[at], "block": np.full(len(at), block), "row": row[at], "first": first[at], "last": last[at]})
        if again.any():
            at = np.sort(order[again])
            spans = _merged({"row": row[at], "first": first[at], "last": last[at]})
            yield from _batches(1, spans | {"block": np.full(len(spans["row"]), block)})

    return run


def _merged(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring spans of window starts, sorted by row and first, joined to runs."""
    row, first, last = cols["row"], cols["first"], cols["last"]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)])
    end = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(row) - 1]])
    return {"row": row[new], "first": first[new], "last": last[end]}


# --- buckets over all blocks ----------------------------------------------------------------------------------------


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``key`` to tables of whole groups, of about ``limit`` rows (or one larger group)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n -= cut
    if held:
        yield pa.Table.from_batches(held)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by bucket, content and place: (kind 1) those equal to an earlier one; (kind 3) the first of each content, where a bucket has several.

    Holds one row between batches: the first of the last content, with whether its bucket had another before.
    """
    carry: pa.Table | None = None
    before = False

    def of(kind: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            yield from table.set_column(0, _ROW.field(0), pa.array(np.full(table.num_rows, kind, np.int32))).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        b, c = table.column("bucket").to_numpy(), table.column("content").to_numpy()
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        yield from of(1, table.filter(pa.array(~new)))
        heads = np.flatnonzero(new)
        same = np.concatenate([[before], b[heads[1:]] == b[heads[:-1]]])
        several = same.copy()
        several[:-1] |= same[1:]
        yield from of(3, table.take(pa.array(heads[:-1][several[:-1]])))
        carry, before = table.slice(int(heads[-1]), 1), bool(same[-1])
    if carry is not None and before:
        yield from of(3, carry)


# --- windows of the distinct stretches ------------------------------------------------------------------------------

STRETCH = "bucket long, doc_id long, tie int, block long, row int, first int, bytes binary"


def _contents(length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        texts, _ = _texts(docs)
        cut = [texts[r][f : last + length] for r, f, last in zip(*(asked.column(c).to_pylist() for c in ("row", "first", "last")), strict=True)]
        names = [x.split()[0] for x in STRETCH.split(", ")]
        return pa.table([pa.array(cut, pa.binary()) if c == "bytes" else asked.column(c) for c in names], names=names)

    return run


SPAN = "block long, row int, first int, last int"
_SPAN = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def _repeats(table: pa.Table, length: int) -> pa.Table:
    """Spans of window starts in the stretches of whole buckets that repeat an earlier window of their bucket."""
    pieces = table.column("bytes").to_pylist()
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n_windows = sizes - length + 1
    of = np.repeat(np.arange(len(pieces)), n_windows)
    inside = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows)
    ids = refine(data, begin[of] + inside, length)
    doc, tie, block, row, first, bucket = (table.column(c).to_numpy() for c in (*PLACE, "bucket"))
    rank = np.empty(len(pieces), np.int64)
    rank[np.lexsort((first, row, block, tie, doc))] = np.arange(len(pieces))
    order = np.lexsort((inside, rank[of], ids, bucket[of]))
    b, i = bucket[of][order], ids[order]
    again = np.concatenate([[False], (b[1:] == b[:-1]) & (i[1:] == i[:-1])]) if len(order) else np.empty(0, bool)
    at = np.sort(order[again])
    spans = _merged({"row": of[at], "first": inside[at], "last": inside[at]}) if len(at) else {"row": at, "first": at, "last": at}
    s = spans["row"]
    return pa.table(
        [pa.array(block[s]), pa.array(row[s]), pa.array((first[s] + spans["first"]).astype(np.int32)), pa.array((first[s] + spans["last"]).astype(np.int32))], schema=_SPAN
    )


def _refined(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "bucket", SORT_BYTES // (2 * length)):
            yield from _repeats(table, length).to_batches()

    return run


def _parted(length: int, gram: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The asked stretches cut by where their windows hold the minimiser, each part with the bucket of the bytes that all its windows share."""
    width = length - gram + 1  # places of the minimiser in a window
    borders = [-(-width * i // parts) for i in range(parts + 1)]

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        texts, _ = _texts(docs)
        rows = []
        for doc, tie, block, row, first, last in zip(*(asked.column(c).to_pylist() for c in (*PLACE, "last")), strict=True):
            text = texts[row]
            hashes = gram_hashes(np.frombuffer(text[last : last + length], np.uint8), gram)
            pivot = last + int(((hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)).argmin())
            for i in range(parts):
                near, far = max(borders[i], pivot - last), min(borders[i + 1] - 1, pivot - first)
                if near <= far:
                    shared = text[pivot - borders[i] : pivot - borders[i + 1] + 1 + length]
                    bucket, content = xxhash.xxh3_64_intdigest(shared, i), xxhash.xxh3_64_intdigest(text[pivot - far : pivot - near + length])
                    rows.append((0, bucket - (1 << 63), content - (1 << 63), doc, tie, block, row, pivot - far, pivot - near))
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)), _ROW, strict=True)], schema=_ROW)

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, root: str, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, int]:
    """(block, row, first, last): window starts of the block files below ``root`` that repeat an earlier window; rows with a null ``row`` mark blocks.  And the number of blocks."""
    files = f"{root}/blocks"
    rows = common.stage(spark, common.block_pass(docs, files, _first_pass(length, gram), ROW), f"{root}/rows")
    marks = rows.where("kind > 0").select("block", F.when(F.col("kind") == 1, F.col("row")).alias("row"), "first", "last")
    spans = common.stage(spark, marks, f"{root}/known")
    blocks = spans.where("row is null").count()
    level, parts = 0, 1
    while True:
        dealt = rows.where("kind = 0").repartition("bucket").sortWithinPartitions("bucket", "content", *PLACE)
        settled = common.stage(spark, dealt.mapInArrow(_buckets, ROW), f"{root}/settled-{level}")
        common.delete(spark, f"{root}/rows" if not level else f"{root}/rows-{level}")
        spans = spans.unionByName(settled.where("kind = 1").select("block", "row", "first", "last"))
        asked = settled.where("kind = 3")
        crowded = common.stage(spark, asked.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket"), f"{root}/crowded-{level}")
        some = not crowded.isEmpty()
        small = asked.join(crowded, "bucket", "left_anti") if some else asked
        read = common.apply_blocks(small.select("bucket", *PLACE, "last"), files, _contents(length), STRETCH, blocks)
        spans = spans.unionByName(read.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refined(length), SPAN))
        if not some:
            return spans, blocks
        level, parts = level + 1, parts * PARTS
        hot = asked.join(crowded, "bucket", "left_semi").select(*PLACE, "last")
        rows = common.stage(spark, common.apply_blocks(hot, files, _parted(length, gram, min(parts, length - gram + 1)), ROW, blocks), f"{root}/rows-{level}")


def removed(spans: pa.Table, sizes: list[int], length: int) -> list[np.ndarray]:
    """For each row of a block, a mask of the bytes that its spans of repeated windows cover."""
    spans = spans.filter(pc.is_valid(spans.column("row")))
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    mask = np.zeros(base[-1], bool)
    row, first, last = (spans.column(c).to_numpy() for c in ("row", "first", "last"))
    for a, b in zip((base[row] + first).tolist(), (base[row] + last + length).tolist(), strict=True):
        mask[a:b] = True
    return [mask[base[i] : base[i + 1]] for i in range(len(sizes))]


def op8_suffix_array(spark: SparkSession, documents: DataFrame) -> DataFrame:
    root = common.scratch(spark, "suffix")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(documents, "text").alias("text"))
    spans, blocks = repeated_spans(spark, docs, root)

    def apply(block: pa.Table, mine: pa.Table) -> pa.Table:
        texts, _ = _texts(block)
        rows = []
        for text, gone in zip(texts, removed(mine, [len(t) for t in texts], LENGTH), strict=True):
            n = int(gone.sum())
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
            rows.append((len(text), n, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True))
        return pa.table([block.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return common.apply_blocks(spans, f"{root}/blocks", apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", blocks)


def drop_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, ``n_chars`` kept true; rows of which nothing but white space stays go.

    Cut-off halves of characters are dropped.  Rows that had nothing to cut stay as they are, empty ones too.
    """
    root = common.scratch(spark, "suffix")
    schema = docs.schema
    spans, blocks = repeated_spans(spark, docs, root, length)
    counts = "n_chars" in docs.columns

    def apply(block: pa.Table, mine: pa.Table) -> pa.Table:
        texts, _ = _texts(block)
        keep, new = [], []
        for i, (text, gone) in enumerate(zip(texts, removed(mine, [len(t) for t in texts], length), strict=True)):
            if gone.any():
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                if not text.strip():
                    continue
                new.append(text.decode("utf-8", "ignore"))
            else:
                new.append(block.column("text")[i].as_py())
            keep.append(i)
        out = block.take(pa.array(keep, pa.int64()))
        at = out.schema.get_field_index("text")
        out = out.set_column(at, out.schema.field(at), pa.array(new, pa.string()))
        if counts:
            at = out.schema.get_field_index("n_chars")
            kept = out.column("n_chars").to_pylist()
            sizes = [old if a.as_py() == b else len(b) for old, a, b in zip(kept, block.column("text").take(pa.array(keep, pa.int64())), new, strict=True)]
            out = out.set_column(at, out.schema.field(at), pa.array(sizes, out.schema.field(at).type))
        return out

    return common.apply_blocks(spans, f"{root}/blocks", apply, schema, blocks)
