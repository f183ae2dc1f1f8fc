"""Content-addressed store of token-id streams.

Format, all integers little-endian.  A document's ids are cut where a rolling hash of the last :data:`SPAN` ids meets a mask
(so equal passages give equal chunks wherever they stand), with chunks of :data:`LEAST` to :data:`MOST` ids.  A chunk is named by
the SHA-256 of its stored bytes (a byte that says how many bytes an id takes, 2 or 4, then the ids) and kept once, in a pack:

* pack:    ``CASPACK1``, count (u32), then for each chunk digest (32 bytes), length in bytes (u32), stored bytes; compressed as a Zstandard frame
* recipe file: ``CASRECP1``, count (u32), then for each document, in ascending doc_id order: flags (u8, 1: null doc_id), doc_id (i64), ids (u64), chunks (u32),
  Merkle root (32 bytes), then for each chunk its digest (32 bytes) and id count (u32)
* both end with the SHA-256 of all bytes before it; a recipe file's order among the others is its ``part`` in the manifest.

A document's manifest is the Merkle tree over its chunk digests; its root is in the recipe.  Reading back checks every
pack and recipe file's own digest, every chunk against its name, every recipe against its root, and that every chunk a
recipe names was found with the length it states.

Scale: a chunk's bytes are shuffled once (equal chunks merge in the map-side combine) and read back once; recipes refer to
them by digest, and a document's CRC-32 is composed from its chunks' CRCs, so no text or id stream is gathered.

Defined results: a null text is an empty text: the end id alone.  Repeated rows and ids are documents of their own (order
among equal ids is that of their Merkle roots).  Null doc_ids come first.  An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.encode import encode_all, forget

LEAST, MEAN, MOST, SPAN = 64, 256, 1024, 16
PACK, RECIPE = b"CASPACK1", b"CASRECP1"
PACK_BYTES = 16 << 20
#: Documents encoded at a time, and bytes of ids cut into chunks at a time (or one longer document).
ROWS, GROUP = 2048, 8 << 20
#: Chunk digests a task remembers in order to hand on a chunk's bytes once.
SEEN = 500_000


class Corrupt(ValueError):
    """A stored file, chunk or recipe does not match its digest."""


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end: where the rolling hash of the last :data:`SPAN` ids meets the mask.

    Streams may stand one behind another, since no chunk ends within :data:`LEAST` ids of a stream's start.
    """
    h = ids.astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    # rolling sum over SPAN positions, each rotated by its distance: doubling the span log2(SPAN) times
    roll, width = h, 1
    while width < SPAN:
        shifted = (roll << np.uint64(width)) | (roll >> np.uint64(64 - width))
        roll = roll.copy()
        roll[width:] += shifted[:-width]
        width *= 2
    return np.flatnonzero(((roll * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(MEAN - LEAST) == 0) + 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return chunk_ends(len(ids), marks(ids).tolist() if len(ids) > LEAST else [])


def chunk_ends(n: int, found: list[int]) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids with these marks."""
    if n <= LEAST:
        return [n] if n else []
    out, at, k = [], 0, 0
    while n - at > LEAST:
        while k < len(found) and found[k] < at + LEAST:
            k += 1
        end = min(found[k] if k < len(found) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of the tree over ``digests``; leaves and nodes are hashed with different prefixes, an odd node moves up."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(up) * 2 :]
    return level[0]


# --- CRC-32 of a concatenation from the CRCs of its parts -----------------------------------------------------------


def _advance(crc: int, n_bytes: int) -> int:
    """The CRC register after ``n_bytes`` zero bytes, without the pre- and post-conditioning."""
    return zlib.crc32(bytes(n_bytes), crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


@lru_cache(maxsize=4096)
def _tables(n_bytes: int) -> tuple[list[int], ...]:
    bits = [_advance(1 << b, n_bytes) for b in range(32)]
    tables = []
    for byte in range(4):
        t = [0] * 256
        for v in range(1, 256):
            low = v & -v
            t[v] = t[v ^ low] ^ bits[8 * byte + low.bit_length() - 1]
        tables.append(t)
    return tuple(tables)


def crc_join(left: int, right: int, right_bytes: int) -> int:
    a, b, c, d = _tables(right_bytes)
    return a[left & 255] ^ b[left >> 8 & 255] ^ c[left >> 16 & 255] ^ d[left >> 24] ^ right


# --- files ----------------------------------------------------------------------------------------------------------


def narrow(ids: np.ndarray) -> bytes:
    """A chunk's stored bytes."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def wide(chunk: bytes) -> bytes:
    """The ids of stored bytes, 4 bytes each."""
    return np.frombuffer(chunk, "<u2", offset=1).astype("<u4").tobytes() if chunk[0] == 2 else chunk[1:]


def pack_file(chunks: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join([PACK, struct.pack("<I", len(chunks)), *(x for d, data in chunks for x in (d, struct.pack("<I", len(data)), data))])
    return struct.pack("<Q", len(body) + 32) + pa.compress(body + hashlib.sha256(body).digest(), "zstd", asbytes=True)


def open_pack(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Digest and ids of each chunk of a pack file."""
    try:
        plain = pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], "zstd", asbytes=True)
    except (OSError, struct.error) as e:
        raise Corrupt(f"pack: {e}") from None
    return read_pack(plain)


def _body(data: bytes, magic: bytes) -> memoryview:
    if data[:8] != magic or hashlib.sha256(data[:-32]).digest() != data[-32:]:
        raise Corrupt("file digest differs")
    return memoryview(data)[8:-32]


def read_pack(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    body = _body(data, PACK)
    (n,), at = struct.unpack_from("<I", body), 4
    for _ in range(n):
        digest, (size,) = bytes(body[at : at + 32]), struct.unpack_from("<I", body, at + 32)
        chunk = bytes(body[at + 36 : at + 36 + size])
        if hashlib.sha256(chunk).digest() != digest:
            raise Corrupt("chunk digest differs")
        yield digest, wide(chunk)
        at += 36 + size


def recipe_file(docs: list[tuple[int | None, bytes, list[bytes], list[int]]]) -> bytes:
    parts = [RECIPE, struct.pack("<I", len(docs))]
    for doc, root, digests, sizes in docs:
        parts.append(struct.pack("<BqQI", doc is None, doc or 0, sum(sizes), len(sizes)) + root)
        parts += [d + struct.pack("<I", n) for d, n in zip(digests, sizes, strict=True)]
    body = b"".join(parts)
    return body + hashlib.sha256(body).digest()


def read_recipes(data: bytes) -> Iterator[tuple[int | None, int, list[bytes], list[int]]]:
    """(doc_id, ids, chunk digests, their id counts) of each document; the Merkle root is checked."""
    body = _body(data, RECIPE)
    (n,), at = struct.unpack_from("<I", body), 4
    for _ in range(n):
        null, doc, total, k = struct.unpack_from("<BqQI", body, at)
        root = bytes(body[at + 21 : at + 53])
        at += 53
        digests = [bytes(body[at + 36 * i : at + 36 * i + 32]) for i in range(k)]
        sizes = [struct.unpack_from("<I", body, at + 36 * i + 32)[0] for i in range(k)]
        at += 36 * k
        if merkle(digests) != root or sum(sizes) != total:
            raise Corrupt("recipe does not match its Merkle root")
        yield None if null else doc, total, digests, sizes


# --- Spark ----------------------------------------------------------------------------------------------------------

STAGED = "doc_id long, n_tokens long, root binary, digests binary, sizes binary, fresh array<struct<digest:binary, ids:binary>>"


def chunked(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Each document's recipe, and the bytes of those chunks its task had not met before."""
    names = ["doc_id", "n_tokens", "root", "digests", "sizes", "fresh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                docs, texts = (batch.column(c).slice(i, ROWS) for c in (0, 1))
                yield from chunks(docs, encode_all(texts, path, end), seen)
        forget(path)

    def chunks(docs: pa.Array, data: list[bytes], seen: set[bytes]) -> Iterator[pa.RecordBatch]:
        """Recipes of encoded documents, some at a time."""
        at = 0
        while at < len(data):
            stop, size = at, 0
            while stop < len(data) and size < GROUP:
                size += len(data[stop])
                stop += 1
            yield recipes(docs.slice(at, stop - at), data[at:stop], seen)
            at = stop

    def recipes(docs: pa.Array, data: list[bytes], seen: set[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(data), "<u4")
        ends = np.cumsum([len(x) // 4 for x in data])
        short = ids.max(initial=0) < 1 << 16
        raw, width, head = (ids.astype("<u2").tobytes(), 2, b"\2") if short else (b"", 0, b"")
        found = marks(ids)
        of = np.searchsorted(found, ends, "right").tolist()
        hashed = hashlib.sha256
        roots, all_digests, all_sizes, fresh_digests, fresh_ids, fresh_ends = [], [], [], [], [], [0]
        begin = low = 0
        for end_, high in zip(ends.tolist(), of, strict=True):
            digests, sizes, a = [], [], 0
            for b in chunk_ends(end_ - begin, (found[low:high] - begin).tolist()):
                chunk = head + raw[width * (begin + a) : width * (begin + b)] if short else narrow(ids[begin + a : begin + b])
                digest = hashed(chunk).digest()
                digests.append(digest)
                sizes.append(b - a)
                if digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    fresh_digests.append(digest)
                    fresh_ids.append(chunk)
                a = b
            roots.append(merkle(digests))
            all_digests.append(b"".join(digests))
            all_sizes.append(struct.pack(f"<{len(sizes)}I", *sizes))
            fresh_ends.append(len(fresh_ids))
            begin, low = end_, high
        fresh = pa.StructArray.from_arrays([pa.array(fresh_digests, pa.binary()), pa.array(fresh_ids, pa.binary())], ["digest", "ids"])
        totals = pa.array(np.diff(ends, prepend=0), pa.int64())
        cols = [docs, totals, pa.array(roots, pa.binary()), pa.array(all_digests, pa.binary()), pa.array(all_sizes, pa.binary()), pa.ListArray.from_arrays(pa.array(fresh_ends, pa.int32()), fresh)]
        return pa.RecordBatch.from_arrays(cols, names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs, "text").alias("text"))
    return docs.mapInArrow(run, STAGED)


def write_packs(staged: DataFrame, root: str) -> DataFrame:
    """Every distinct chunk in exactly one pack file; one row a pack: file, chunks."""
    chunks = staged.select(F.explode("fresh").alias("c")).select("c.digest", "c.ids").groupBy("digest").agg(F.first("ids").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            common.put(uri := f"{root}/{common.unique_name('.pack')}", pack_file(held))
            return pa.record_batch({"file": [uri], "chunks": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for digest, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((digest, chunk))
                size += len(chunk)
                if size >= PACK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return chunks.mapInArrow(run, "file string, chunks long")


def write_recipes(staged: DataFrame, root: str) -> DataFrame:
    """Recipe files in ascending doc_id order; one row a file: part, serial (order within the part), file, docs, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        serial = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                cols = [batch.column(batch.schema.get_field_index(c)).slice(i, 4096).to_pylist() for c in ("doc_id", "root", "digests", "sizes")]
                docs = [(d, r, [g[k : k + 32] for k in range(0, len(g), 32)], np.frombuffer(s, "<u4").tolist()) for d, r, g, s in zip(*cols, strict=True)]
                common.put(uri := f"{root}/{common.unique_name('.recipe')}", recipe_file(docs))
                yield pa.record_batch(
                    {"part": pa.array([part], pa.int64()), "serial": pa.array([serial], pa.int64()), "file": [uri], "docs": pa.array([len(docs)], pa.int64()), "tokens": pa.array([sum(sum(x[3]) for x in docs)], pa.int64())}
                )
                serial += 1

    ordered = staged.select("doc_id", "root", "digests", "sizes").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    return ordered.mapInArrow(run, "part long, serial long, file string, docs long, tokens long")


def write_store(spark: SparkSession, docs: DataFrame, path: str, end: int, root: str) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` (doc_id, text) into a store below ``root``; its pack and recipe manifests (Parquet tables there)."""
    staged = common.stage(spark, chunked(docs, path, end), f"{root}/staged")
    packs = common.stage(spark, write_packs(staged, f"{root}/packs"), f"{root}/pack-list")
    recipes = common.stage(spark, write_recipes(staged, f"{root}/recipes"), f"{root}/recipe-list")
    common.delete(spark, f"{root}/staged")
    return packs, recipes


def starts(recipes: DataFrame) -> DataFrame:
    """The recipe manifest with ``start``, the ids in all files before: sums over parts, then within a part (files are few, a row each)."""
    parts = recipes.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("serial")) - F.col("tokens")
    return recipes.join(before, "part").withColumn("start", F.col("base") + inside)


def read_store(packs: DataFrame, recipes: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a mismatch with a digest fails the read."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = [(d, len(ids) // 4, zlib.crc32(ids)) for d, ids in open_pack(common.get(uri))]
                d, n, c = zip(*rows, strict=True)
                yield pa.record_batch({"digest": pa.array(d, pa.binary()), "size": pa.array(n, pa.int32()), "crc": pa.array(c, pa.int64())})

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc, total, digests, sizes in read_recipes(common.get(uri)):
                    rows += [(doc, at, total, len(sizes), i, d, n) for i, (d, n) in enumerate(zip(digests, sizes, strict=True))]
                    at += total
                names = ("doc_id", "start", "n_tokens", "of", "nr", "digest", "stated")
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 20_000], strict=True), kinds, strict=True)], names)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3)
            ends = np.asarray(parts.offsets)
            flat = parts.values.slice(ends[0], ends[-1] - ends[0])
            nr, crc, size = (np.asarray(flat.field(n), dtype=np.int64) for n in ("nr", "crc", "size"))
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            order = np.lexsort((nr, of))
            crcs = [0] * batch.num_rows
            for doc, c, n in zip(of[order].tolist(), crc[order].tolist(), (4 * size[order]).tolist(), strict=True):
                crcs[doc] = crc_join(crcs[doc], c, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = lambda df: df.repartition(max(1, min(4096, df.count())))
    have = spread(packs.select("file")).mapInArrow(chunks, "digest binary, size int, crc long")
    refs = spread(starts(recipes).select("file", "start")).mapInArrow(references, "doc_id long, start long, n_tokens long, of int, nr int, digest binary, stated int")
    # sizes are unknown to the planner here (a pass over a short file list), so it is told not to broadcast
    joined = refs.join(have.hint("merge"), "digest", "left")
    # (a document is told from others by where it starts: every one has an end id, so starts differ)
    docs = joined.groupBy("start", "doc_id", "n_tokens", "of").agg(F.collect_list(F.struct("nr", "crc", "size", "stated")).alias("parts"))
    whole = (F.size("parts") == F.col("of")) & F.forall("parts", lambda p: p["size"].eqNullSafe(p["stated"]))
    checked = docs.withColumn("parts", F.when(whole, F.col("parts")).otherwise(F.raise_error(F.lit("a chunk that a recipe names is not in the store"))))
    return checked.select("doc_id", "start", "n_tokens", "parts").mapInArrow(compose, "doc_id long, start long, n_tokens long, ids_crc32 long")


def restore(packs: DataFrame, recipes: DataFrame) -> DataFrame:
    """doc_id, start and the ids of every document: the full reconstruction (its bytes are shuffled to their documents)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                d, ids = zip(*open_pack(common.get(uri)), strict=True)
                yield pa.record_batch({"digest": pa.array(d, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc, total, digests, _ in read_recipes(common.get(uri)):
                    rows += [(doc, at, i, d) for i, d in enumerate(digests)]
                    at += total
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "start", "nr", "digest"])

    have = packs.select("file").mapInArrow(chunks, "digest binary, ids binary")
    refs = starts(recipes).select("file", "start").mapInArrow(references, "doc_id long, start long, nr int, digest binary")
    parts = refs.join(have.hint("merge"), "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("nr", "ids"))).alias("parts"))
    return parts.select("doc_id", "start", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op3_token_store(spark: SparkSession, documents: DataFrame) -> DataFrame:
    import public_tokenizers

    root = common.scratch(spark, "castore")
    return read_store(*write_store(spark, documents, public_tokenizers.path("word_bpe_49k.json"), 2, root))
