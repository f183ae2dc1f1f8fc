"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: each word shingle votes with the bits of its hash; a bit is set if more than half of the votes are.
Distinct fingerprints are ordered by the population counts of the four quarters of their first word and cut into
tiles.  A pair of tiles whose population counts differ beyond the radius (in total, or summed over the quarters) is
skipped; every other pair is compared in full with numpy: exclusive-or and bit count.  What a tile pair finds is
reduced to a forest before it leaves the task, so groups of copies never become all their pairs.

Scale: equal fingerprints are merged first (partial aggregation), so copies cost one row a task.  Tiles are files in
the shared folder; the work list is one short row a tile pair.  The number of comparisons is quadratic in *distinct*
fingerprints, cut by the skipped share, which grows as tiles cover narrower population ranges.

Defined results: null or blank text has no shingles and fingerprint zero, linked like any other; fewer words than a
shingle needs give one shingle of all words; repeated rows are rows of their own; rows with null doc_id take part but
never name a component unless all its ids are null.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm import common
from freshet.llm.components import components

#: Fingerprints in a tile.
TILE = 4096
WHITE = " \t\n\x0b\x0c\r"
_ROWS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the text's words, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)


def _words(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` 64-bit words of votes for each hash; the first is the hash itself, the others are mixed from it."""
    out = np.empty((len(h), n), np.uint64)
    out[:, 0] = h
    for i in range(1, n):
        z = h + _MIX * np.uint64(i)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> bytes:
    """The fingerprint of one text, ``8 * words`` bytes, most significant bit first."""
    return votes(shingle_hashes(text or "", shingle), words)


def votes(h: np.ndarray, words: int) -> bytes:
    """The fingerprint of shingle hashes: a bit is 1 if more than half of them have it."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 4080):
        bits = np.unpackbits(_words(h[i : i + 4080], words).astype(">u8").view(np.uint8).reshape(-1, 8 * words), axis=1)
        for j in range(0, len(bits), 255):  # sums of 255 bits fit in the bytes they are added up in
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fp``, the fingerprint of column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            fps = pa.array([fingerprint(t.as_py(), shingle, words) for t in text], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), fps], [*keep, "fp"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("fp", T.BinaryType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


# --- tiles --------------------------------------------------------------------------------------------------------


def _load(fps: bytes, words: int) -> np.ndarray:
    return np.frombuffer(fps, ">u8").astype(np.uint64).reshape(-1, words)


def _quarters(first: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((first >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int64)


TILE_SCHEMA = "tile string, n long, least long, most long, " + ", ".join(f"lo{i} int, hi{i} int" for i in range(5))


def write_tiles(spark: SparkSession, distinct: DataFrame, words: int, root: str, sized: bool = False) -> DataFrame:
    """Tile files of the distinct fingerprints and one row a tile: file, number and its ranges of population counts (0: total, 1-4: quarters).

    With ``sized``, fingerprints (columns ``least`` and ``most`` are the sizes of their sets) are ordered by the sizes first, and a tile has their range.
    """

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0)
            q = _quarters(_load(b"".join(fp.to_pylist()), words)[:, 0])
            key = ((q[:, 0] * 32 + q[:, 1]) * 32 + q[:, 2]) * 32 + q[:, 3]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *batch.columns], ["key", "fp", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []

        def flush(part: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
            fps = b"".join(x[0] for x in part)
            first = _load(fps, words)[:, 0]
            q = np.concatenate([np.bitwise_count(first).astype(np.int64)[:, None], _quarters(first)], axis=1)
            common.put(uri := f"{root}/{common.unique_name('.tile')}", fps)
            row: dict = {"tile": [uri], "n": pa.array([len(part)], pa.int64())}
            row |= {"least": pa.array([min(x[1] for x in part)], pa.int64()), "most": pa.array([max(x[2] for x in part)], pa.int64())}
            for i in range(5):
                row |= {f"lo{i}": pa.array([q[:, i].min()], pa.int32()), f"hi{i}": pa.array([q[:, i].max()], pa.int32())}
            return pa.record_batch(row)

        for batch in batches:
            held += zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("fp", "least", "most")), strict=True)
            while len(held) >= TILE:
                yield flush(held[:TILE])
                held = held[TILE:]
        if held:
            yield flush(held)

    sizes = ("least", "most") if sized else (F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("most"))
    keyed = distinct.select("fp", *sizes).mapInArrow(order, "key long, fp binary, least long, most long")
    by = ("least", "most", "key", "fp") if sized else ("key", "fp")
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, TILE_SCHEMA)


def tile_pairs(tiles: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles that can hold a pair within ``radius``: an equi-join on buckets of the first quarter's count, then the exact skip test.

    With ``similarity``, sets of that Jaccard similarity differ in size by no more than that factor: buckets are steps of it, and pairs of tiles beyond it are skipped.
    """
    other = [F.col(c).alias(f"o_{c}") for c in tiles.columns]
    gap = lambda i: F.greatest(F.lit(0), F.col(f"o_lo{i}") - F.col(f"hi{i}"), F.col(f"lo{i}") - F.col(f"o_hi{i}"))
    near = (gap(0) <= radius) & (gap(1) + gap(2) + gap(3) + gap(4) <= radius)
    if similarity is None:
        width = max(1, radius)
        bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
        mine, theirs = bucket(F.col("lo1"), F.col("hi1")), bucket(F.col("lo1") - radius, F.col("hi1") + radius)
    else:
        step = lambda c: F.floor(F.ln(F.greatest(F.col(c), F.lit(1)).cast("double")) / -math.log(similarity)).cast("long")
        mine, theirs = F.explode(F.sequence(step("least"), step("most"))), F.explode(F.sequence(step("least") - 2, step("most") + 2))
        near = near & (F.col("o_most") >= similarity * F.col("least") - 1e-6) & (F.col("most") >= similarity * F.col("o_least") - 1e-6)
    a, b = tiles.select("*", mine.alias("bucket")), tiles.select(*other, theirs.alias("bucket"))
    return a.join(b, "bucket").where((F.col("tile") <= F.col("o_tile")) & near).select(F.col("tile").alias("a"), F.col("o_tile").alias("b")).distinct()


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges that join what the edges (i, j) over 0..n-1 join."""
    label = np.arange(n)
    while True:
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def near_rows(a: np.ndarray, b: np.ndarray | None, first_radius: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of ``a`` (and ``b`` behind them) whose fingerprints are within ``radius`` bits, some rows of ``a`` at a time.

    Fingerprints of several words are compared in full only where their first words differ in at most ``first_radius`` bits.
    """
    other = a if b is None else b
    shift = 0 if b is None else len(a)
    for r in range(0, len(a), _ROWS):
        start = r if b is None else 0
        near = np.bitwise_count(a[r : r + _ROWS, :1] ^ other[None, start:, 0]) <= first_radius
        at = np.flatnonzero(near)  # faster than nonzero in two dimensions
        i, j = at // near.shape[1] + r, at % near.shape[1] + start
        if b is None:
            up = i < j
            i, j = i[up], j[up]
        if a.shape[1] > 1 and len(i):
            full = np.concatenate([np.bitwise_count(a[i[s : s + 8192]] ^ other[j[s : s + 8192]]).sum(axis=1, dtype=np.int64) for s in range(0, len(i), 8192)]) <= radius
            i, j = i[full], j[full]
        if len(i):
            yield i, j + shift


def compare(a: np.ndarray, b: np.ndarray | None, first_radius: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges over the rows of ``a`` (and ``b`` behind them) that link fingerprints within ``radius`` bits (see :func:`near_rows`)."""
    n = len(a) + (0 if b is None else len(b))
    keep_i, keep_j, size = [], [], 0
    for i, j in near_rows(a, b, first_radius, radius):
        keep_i.append(i)
        keep_j.append(j)
        size += len(i)
        if size > 1_000_000:
            x, y = forest(n, np.concatenate(keep_i), np.concatenate(keep_j))
            keep_i, keep_j, size = [x], [y], len(x)
    if not keep_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(n, np.concatenate(keep_i), np.concatenate(keep_j))


def links(pairs: DataFrame, words: int, first_radius: int, radius: int) -> DataFrame:
    """Edges (a, b) between fingerprints, a forest for each tile pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}

        def tile(uri: str) -> np.ndarray:
            if uri not in cache:
                if len(cache) >= 32:
                    cache.pop(next(iter(cache)))
                cache[uri] = _load(common.get(uri), words)
            return cache[uri]

        for batch in batches:
            for x, y in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a = tile(x)
                b = None if x == y else tile(y)
                i, j = compare(a, b, first_radius, radius)
                if len(i):
                    rows = (a if b is None else np.concatenate([a, b])).astype(">u8")
                    yield pa.RecordBatch.from_arrays([pa.array([rows[k].tobytes() for k in at.tolist()], pa.binary()) for at in (i, j)], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def near_duplicates(
    spark: SparkSession,
    prints: DataFrame,
    root: str,
    words: int = 1,
    radius: int = 2,
    first_radius: int | None = None,
    check: Callable[[DataFrame], DataFrame] | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """(fp, n, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp): component_id is the smallest doc_id reachable over links.

    With ``check``, what the links join are candidates only: it is given (component, fp, first) of them and returns the edges (a, b) that count.  With ``similarity``, ``prints`` has the sizes
    of the sets (column ``size``), and tiles whose sizes rule that Jaccard similarity out are not compared.
    """
    sizes = [F.min("size").alias("least"), F.max("size").alias("most")] if similarity is not None else []
    distinct = common.stage(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *sizes), f"{root}/distinct")
    tiles = common.stage(spark, write_tiles(spark, distinct, words, f"{root}/tiles", similarity is not None), f"{root}/tile-list")
    skip = radius if words == 1 else first_radius if first_radius is not None else 64
    pairs = common.stage(spark, tile_pairs(tiles, skip, similarity), f"{root}/pairs")
    n_pairs = pairs.count()
    work = pairs.repartition(max(1, min(n_pairs, 8 * spark.sparkContext.defaultParallelism)), "a", "b") if n_pairs else pairs
    found = components(spark, links(work, words, skip, radius), f"{root}/components")
    if check:
        asked = found.join(distinct.select(F.col("fp").alias("node"), "first"), "node").select("component", F.col("node").alias("fp"), "first")
        found = components(spark, check(asked), f"{root}/checked")
    grouped = found.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
    ids = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    member = found.join(ids, "component").select(F.col("node").alias("fp"), "component_id")
    groups = distinct.join(member, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    # staged, so that a join on it reads two plain shuffles and a fingerprint of very many documents is split over tasks
    return common.stage(spark, groups, f"{root}/groups")


def op7_simhash(spark: SparkSession, documents: DataFrame) -> DataFrame:
    root = common.scratch(spark, "simhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(documents, "text").alias("text"))
    prints = common.stage(spark, fingerprints(docs, 3, 1, ["doc_id"]), f"{root}/prints")
    groups = near_duplicates(spark, prints, root)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# --- near duplicates held against their texts -----------------------------------------------------------------------

#: Five-word shingles, and votes of 1024 bits, which tell similarities apart to a few hundredths.
DEDUP_SHINGLE, DEDUP_WORDS = 5, 16
#: Bytes of shingle sets in a tile (one set may exceed it alone).
SET_BYTES = 16 << 20


def _angle(similarity: float) -> float:
    """Share of bits that differ between two large shingle sets of that Jaccard similarity: their angle over pi."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def _wide(bits: int, p: float) -> int:
    return int(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def similarity_radius(similarity: float, bits: int) -> int:
    """Differing bits expected of two shingle sets of that Jaccard similarity, plus four standard deviations.

    Small sets differ more than large ones, as ties vote no: the worst are an even number of shingles and the same with one more.
    """
    p = _angle(similarity)
    if similarity < 1:
        k = 2 * math.ceil(round(similarity / (1 - similarity) / 2, 9))
        p = max(p, math.comb(k, k // 2) / 2 ** (k + 1))
    return _wide(bits, p)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """The Jaccard similarity of two sets (sorted, distinct) is at least ``similarity``."""
    small, large = sorted((len(x), len(y)))
    if small < similarity * large:
        return False
    both = np.sort(np.concatenate([x, y]))
    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
    return common_ / (small + large - common_) >= similarity


def check_rows(pairs: Iterator[tuple[np.ndarray, np.ndarray]], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Forest of the pairs whose sets are similar; a pair that similar pairs have joined already is not asked for."""
    label = np.arange(len(sets))
    out = []
    for i, j in pairs:
        apart = label[i] != label[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if label[x] != label[y] and similar(sets[x], sets[y], similarity):
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _set_tiles(asked: DataFrame, root: str) -> DataFrame:
    """Tile files of (fp, set) in the order of their components; one row (component, tile) for each component in a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            common.put(uri := f"{root}/{common.unique_name('.sets')}", sink.getvalue())
            comps = list(dict.fromkeys(c for b in held for c in b.column(0).to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array(comps, pa.binary()), pa.array([uri] * len(comps))], ["component", "tile"])

        for batch in batches:
            for k, n in enumerate(pa.compute.binary_length(batch.column(2)).to_pylist()):
                if held and (size + n > SET_BYTES or len(held) >= TILE):
                    yield flush()
                    held, size = [], 0
                held.append(batch.slice(k, 1))
                size += n
        if held:
            yield flush()

    ordered = asked.select("component", "fp", "set").repartitionByRange("component", "fp").sortWithinPartitions("component", "fp")
    return ordered.mapInArrow(run, "component binary, tile string")


def checked_links(spark: SparkSession, asked: DataFrame, blocks_root: str, root: str, words: int, first_radius: int, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) between candidates ``asked`` (component, fp, first) within ``radius`` whose texts' shingle sets are similar indeed.

    The sets are read from the block files, for candidates only, and put into tiles by component; tiles that share a component are
    compared pair by pair, so a component of any size is checked in full without being gathered.
    """

    def sets(block: pa.Table, mine: pa.Table) -> pa.Table:
        text = block.column("text")
        made = [np.unique(shingle_hashes(text[r].as_py(), DEDUP_SHINGLE)).tobytes() for r in mine.column("row").to_pylist()]
        return pa.table({"component": mine.column("component"), "fp": mine.column("fp"), "set": pa.array(made, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(uri: str) -> tuple[list[bytes], list[np.ndarray]]:
            with pa.ipc.open_stream(common.get(uri)) as r:
                t = r.read_all()
            return t.column("fp").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]

        for batch in batches:
            last: tuple = ("", None)
            for x, y in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last[0] != x:
                    last = (x, tile(x))
                fps, held = last[1]
                other = None
                if x != y:
                    more, others = tile(y)
                    other = _load(b"".join(more), words)
                    fps, held = fps + more, held + others
                mine = _load(b"".join(last[1][0]), words)
                got = check_rows(near_rows(mine, other, first_radius, radius), held, similarity)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([fps[e[k]] for e in got], pa.binary()) for k in (0, 1)], ["a", "b"])

    where = asked.select(F.col("first.block").alias("block"), F.col("first.row").alias("row"), "component", "fp")
    where = common.stage(spark, where, f"{root}/asked")
    blocks = where.select("block").distinct().count()
    found = common.apply_blocks(where, blocks_root, sets, "component binary, fp binary, set binary", blocks)
    found = common.stage(spark, found, f"{root}/sets")
    tiles = common.stage(spark, _set_tiles(found, f"{root}/set-tiles"), f"{root}/set-tile-list")
    pairs = tiles.select("component", F.col("tile").alias("a")).join(tiles.select("component", F.col("tile").alias("b")), "component")
    pairs = common.stage(spark, pairs.where("a <= b").select("a", "b").distinct(), f"{root}/set-pairs")
    n = pairs.count()
    work = pairs.repartition(max(1, min(n, 8 * spark.sparkContext.defaultParallelism)), "a", "b") if n else pairs
    return work.mapInArrow(run, "a binary, b binary")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (null first; then by fingerprint and place).

    Near duplicates are texts whose sets of word five-grams have a Jaccard similarity of 0.8 or more.  Candidates are found by 1024-bit SimHash
    of the distinct shingles: tiles are ordered by the sizes of the sets, and tiles whose sizes rule the similarity out are skipped; in the others first words are compared, whole fingerprints where these are near, both with a radius of four standard
    deviations beyond what that similarity makes expected.  Each link is then checked on the shingle sets of the two texts, and only links that hold form
    groups.  Texts with equal fingerprints are taken for equal.  Documents without a word are no duplicates of one another.
    """
    root = common.scratch(spark, "near")
    first, radius = _wide(64, _angle(similarity)), similarity_radius(similarity, 64 * DEDUP_WORDS)

    def prints(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = table.column("text").to_pylist()
        n = len(texts)
        fps, sizes = [None] * n, np.zeros(n, np.int64)
        for i, t in enumerate(texts):
            if t and t.strip(WHITE):
                h = np.unique(shingle_hashes(t, DEDUP_SHINGLE))
                fps[i], sizes[i] = votes(h, DEDUP_WORDS), len(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), table.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(fps, pa.binary()), pa.array(sizes)],
            ["block", "row", "doc_id", "fp", "size"],
        )

    rows = common.stage(spark, common.block_pass(docs, f"{root}/blocks", prints, "block long, row int, doc_id long, fp binary, size long"), f"{root}/prints")
    shown = rows.where("fp is not null").withColumn("doc_id", F.struct("doc_id", "block", "row"))
    check = lambda asked: checked_links(spark, asked, f"{root}/blocks", root, DEDUP_WORDS, first, radius, similarity)
    groups = near_duplicates(spark, shown, root, DEDUP_WORDS, radius, first, check, similarity)
    keep = groups.select(F.col("component_id.block").alias("block"), F.col("component_id.row").alias("row")).distinct()
    keep = keep.unionByName(rows.where("fp is null").select("block", "row")).unionByName(rows.select("block", F.lit(None).cast("int").alias("row")).distinct())

    def apply(block: pa.Table, mine: pa.Table) -> pa.Table:
        return block.take(pa.array(sorted(r for r in mine.column("row").to_pylist() if r is not None), pa.int64()))

    return common.apply_blocks(keep, f"{root}/blocks", apply, docs.schema, rows.select("block").distinct().count())
