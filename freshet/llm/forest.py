"""MinHash near-duplicates by an LSH forest.

Each text's set of distinct word shingles gives 256 minima (MinHash).  A tree of the forest orders the sets by a label, a sequence of minima; 16 trees begin at different minima.
Sets that share a prefix of a label are a region.  The least depth is that at which 16 trees miss hardly a pair (:func:`least_depth`); a region of more than :data:`CROWD` sets is
also looked at one level deeper, and so on (:data:`LEVELS`), so what is drawn follows how crowded a region is.  Candidates:

1. every set with one of its region, the least by digest, on every level: of these, a likely one for each set is checked first and what holds is joined up;
2. then the others drawn that are not joined yet;
3. then, in regions of the least depth that hold sets of several components, all pairs of a set outside the largest component with a set of another.  Small regions are joined with
   themselves; crowded ones are dealt to tiles of bounded size, and every pair of tiles is compared in full.  No region is capped or left out.

Unlikely pairs are told by two bits of each minimum, four and a half standard deviations below what the wanted similarity makes expected.  Every link is confirmed on the full sets.

Scale: equal sets are merged first, so copies cost one row a task.  What is shuffled is short rows (a label, an identifier, a sketch); the sets of candidates are made again from block
files.  A group of near copies costs a row a tree and level and about one check a member, as its members join by what is drawn.  What no drawn one joins in a crowded region is compared
pair by pair, which is quadratic in the region's sets outside its largest component: sketches first, full sets for rows that may have a link, each pair in the first tree that brings it
together, and a pair of tiles returns no more links than it has sets.  Nothing is gathered.

Defined results: null and blank texts have the empty set, are linked with nothing and name themselves.  Fewer words than a shingle has are one shingle.  Repeated rows are rows of
their own.  Rows with a null doc_id take part but name a component only if all its ids are null; they are kept if so.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.components import components
from freshet.llm.simhash import shingle_hashes

#: Minima of a set, trees, the minima at which trees begin apart, minima of a label.
MINIMA, TREES, APART, DEEPEST = 256, 16, 8, 16
LEVELS = (6, 8, 12, DEEPEST)
#: Sets of a region beyond which sets are drawn one level deeper too, and which is compared by tiles.
CROWD = 64
#: Sets of a tile, and shingles of its sets, at most; what names a pair of tiles.
TILE, TILE_SHINGLES = 1024, 1 << 19
TILED = ("tree", "key", "lband", "ltile", "rband", "rside", "rtile")
_ROWS = 64
#: Share of pairs just similar enough that no tree brings together at the least depth.
MISSED = 2e-5
_STEP = 2048
#: Bits of each minimum in a sketch, a plane each; its columns, 64 bits each, plane by plane.
PLANES = 2
WORDS = MINIMA // 64
SKETCH = tuple(f"s{i}" for i in range(WORDS * PLANES))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_TIMES = _spread(np.arange(1, MINIMA + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
_PLUS = _spread(np.arange(MINIMA + 1, 2 * MINIMA + 1, dtype=np.uint64) * _MIX)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set of hashes."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP]
        np.minimum(low, (_TIMES[:, None] * part[None, :] + _PLUS[:, None]).min(axis=1), out=low)
    return low


def least_depth(similarity: float) -> int:
    """The greatest depth at which the trees miss no more than :data:`MISSED` of the pairs of that similarity."""
    depth = 1
    while depth < LEVELS[0] - 1 and (1 - similarity ** (depth + 1)) ** TREES <= MISSED:
        depth += 1
    return depth


def _alike(similarity: float) -> float:
    """Share of the minima whose bits agree."""
    return (1 + (2**PLANES - 1) * similarity) / 2**PLANES


def least_agreement(similarity: float) -> int:
    """Minima whose bits agree in sets of that similarity, less four and a half standard deviations."""
    p = _alike(similarity)
    return math.floor(MINIMA * p - 4.5 * math.sqrt(MINIMA * p * (1 - p)))


PRINTS = "block long, row int, doc_id long, n long, digest binary, signature binary, " + ", ".join(f"{c} long" for c in SKETCH)


def _prints(docs: DataFrame, blocks: str, shingle: int) -> DataFrame:
    """Blocks of texts, and of each row its set's size, digest, label values (two bytes each) and sketch."""

    def run(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        k = table.num_rows
        sizes, digests, signatures, sketch = np.zeros(k, np.int64), [None] * k, [None] * k, np.zeros((k, len(SKETCH)), np.int64)
        for i, text in enumerate(table.column("text")):
            h = np.unique(shingle_hashes(text.as_py() or "", shingle))
            if not len(h):
                continue
            sizes[i] = len(h)
            digests[i] = xxhash.xxh3_128_digest(h)
            low = _spread(minima(h))
            signatures[i] = (low[: TREES * APART] >> np.uint64(48)).astype(">u2").tobytes()
            sketch[i] = np.packbits(np.concatenate([(low >> np.uint64(b)) & np.uint64(1) for b in range(20, 20 + PLANES)]).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, block)), pa.array(np.arange(k, dtype=np.int32)), table.column("doc_id").combine_chunks(), pa.array(sizes),
             pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), *map(pa.array, sketch.T)],
            ["block", "row", "doc_id", "n", "digest", "signature", *SKETCH],
        )

    return common.block_pass(docs, blocks, run, PRINTS)


def _trees(distinct: DataFrame) -> DataFrame:
    """A row for each set and tree: tree, label (two bytes a minimum), and what tells unlikely pairs."""
    around = F.concat("signature", F.expr(f"substring(signature, 1, {2 * DEEPEST})"))
    labels = [F.struct(F.lit(t).alias("tree"), F.substring(around, 2 * APART * t + 1, 2 * DEEPEST).alias("label")) for t in range(TREES)]
    return distinct.select("uid", "n", *SKETCH, F.explode(F.array(*labels)).alias("t")).select("uid", "n", *SKETCH, "t.tree", "t.label")


def _agreement(x: str, y: str) -> Column:
    differ = lambda s: F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))
    parts = [F.bit_count(reduce(Column.bitwiseOR, [differ(s) for s in SKETCH[w::WORDS]])) for w in range(WORDS)]
    return F.lit(MINIMA) - reduce(Column.__add__, parts)


def _likely(x: str, y: str, percent: int) -> Column:
    """Sizes and sketches of two sets allow for the similarity."""
    sizes = F.lit(100) * F.least(f"{x}n", f"{y}n") >= F.lit(percent) * F.greatest(f"{x}n", f"{y}n")
    return sizes & (_agreement(x, y) >= least_agreement(percent / 100))


class Forest:
    """Regions of a forest, staged level by level below ``root``."""

    def __init__(self, spark: SparkSession, distinct: DataFrame, root: str, percent: int, crowd: int = CROWD):
        self.spark, self.root, self.percent = spark, root, percent
        self.well = math.ceil(MINIMA * _alike((0.75 * percent + 25) / 100))
        first = least_depth(percent / 100)
        self.met: list[tuple[int, DataFrame]] = []
        self.crowd = crowd
        drawn = []
        rows = _trees(distinct)
        for depth in (first, *LEVELS):
            keyed = rows.withColumn("key", F.expr(f"substring(label, 1, {2 * depth})"))
            regions = keyed.groupBy("tree", "key").agg(F.count("*").alias("size"), F.min(F.struct("uid", "n", *SKETCH)).alias("drawn")).where("size > 1")
            regions = common.stage(spark, regions, f"{root}/regions-{depth}")
            met = common.stage(spark, keyed.join(regions, ["tree", "key"]), f"{root}/met-{depth}")
            pairs = met.select("uid", "n", *SKETCH, *[F.col(f"drawn.{c}").alias(f"o_{c}") for c in ("uid", "n", *SKETCH)])
            pairs = pairs.where((F.col("uid") != F.col("o_uid")) & _likely("", "o_", percent))
            drawn.append(pairs.select(F.col("uid").alias("a"), F.col("o_uid").alias("b"), _agreement("", "o_").alias("agree")))
            self.met.append((depth, met))
            rows = met.where(F.col("size") > crowd).select("uid", "n", *SKETCH, "tree", "label")
            if rows.isEmpty():
                break
        every = drawn[0]
        for d in drawn[1:]:
            every = every.unionByName(d)
        #: (a, b, agree): sets and those drawn for them.
        self.drawn = common.stage(spark, every.distinct(), f"{root}/drawn")

    def likeliest(self) -> DataFrame:
        """(a, b): for each set the least of those drawn for it that agree well; if none does, the one that agrees most.  So groups of near copies gather around one member."""
        rank = F.when(F.col("agree") >= self.well, F.lit(0)).otherwise(F.lit(MINIMA + 1) - F.col("agree"))
        best = self.drawn.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        return common.stage(self.spark, best, f"{self.root}/likeliest")

    def drawn_apart(self, joined: DataFrame, checked: DataFrame) -> DataFrame:
        """(a, b): sets and those drawn for them that ``joined`` (node, component) does not join, but for those ``checked``."""
        rest = self.drawn.join(checked, ["a", "b"], "left_anti")
        return common.stage(self.spark, _pairs(_component(_component(rest, joined, "a", "ca"), joined, "b", "cb").where("ca != cb")), f"{self.root}/drawn-apart")

    def regions_apart(self, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is left to compare of regions of the least depth that hold sets of several components of ``joined``: see the module's third kind of candidates.

        Of regions of at most ``crowd`` sets, pairs (a, b) that were not drawn for one another; of larger ones the rows, by pairs of tiles (:data:`TILED`).
        """
        depth, met = self.met[0]
        rows = _component(met.where("size > 2").select("tree", "key", "uid", "n", *SKETCH), joined, "uid", "comp")
        rows = common.stage(self.spark, rows, f"{self.root}/rows")
        held = rows.groupBy("tree", "key", "comp").agg(F.count("*").alias("k"))
        mixed = held.groupBy("tree", "key").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
        mixed = common.stage(self.spark, mixed.select("tree", "key", F.col("main.comp").alias("main"), "size"), f"{self.root}/mixed")
        here = common.stage(self.spark, rows.join(mixed, ["tree", "key"]), f"{self.root}/here")
        few = here.where(F.col("size") <= self.crowd)
        other = few.select("tree", "key", *[F.col(c).alias(f"o_{c}") for c in ("uid", "n", *SKETCH, "comp")])
        once = (F.col("o_comp") == F.col("main")) | (F.col("uid") < F.col("o_uid"))
        near = few.where("comp != main").join(other, ["tree", "key"]).where((F.col("comp") != F.col("o_comp")) & once & _likely("", "o_", self.percent))
        pairs = _pairs(near.select(F.col("uid").alias("a"), F.col("o_uid").alias("b"))).join(_pairs(self.drawn), ["a", "b"], "left_anti")
        return common.stage(self.spark, pairs, f"{self.root}/regions-apart"), self._tiled(here.where(F.col("size") > self.crowd))

    def _tiled(self, rows: DataFrame) -> DataFrame:
        """Rows of crowded regions, once for each pair of tiles they take part in.

        Sets outside a region's largest component meet each other and those in it.  Sizes fall in bands so wide that sets of the wanted similarity are of one band or of two next to each other.
        """
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / (self.percent - 1))).cast("int") if self.percent > 1 else F.lit(0)
        rows = rows.select("tree", "key", "uid", "n", *SKETCH, "comp", band.alias("band"), (F.col("comp") == F.col("main")).cast("int").alias("side"))
        cells = rows.groupBy("tree", "key", "band", "side").agg(F.count("*").alias("k"), F.max("n").alias("most"))
        tiles = F.ceil(F.col("k") / F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_SHINGLES) / F.col("most"))))).cast("int")
        cells = common.stage(self.spark, cells.select("tree", "key", "band", "side", tiles.alias("tiles")), f"{self.root}/cells")
        left = cells.where("side = 0").select("tree", "key", F.col("band").alias("lband"), F.col("tiles").alias("ltiles"))
        right = cells.select("tree", "key", F.col("band").alias("rband"), F.col("side").alias("rside"), F.col("tiles").alias("rtiles"))
        beside = (F.abs(F.col("lband") - F.col("rband")) <= 1) & ((F.col("rside") == 1) | (F.col("lband") <= F.col("rband")))
        work = left.join(right, ["tree", "key"]).where(beside).withColumn("ltile", F.explode(F.sequence(F.lit(0), F.col("ltiles") - 1)))
        work = work.withColumn("rtile", F.explode(F.sequence(F.lit(0), F.col("rtiles") - 1)))
        own = (F.col("rside") == 0) & (F.col("lband") == F.col("rband"))
        work = common.stage(self.spark, work.where(~own | (F.col("ltile") <= F.col("rtile"))).select(*TILED), f"{self.root}/work")
        dealt = rows.join(cells, ["tree", "key", "band", "side"]).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")).drop("tiles")
        dealt = common.stage(self.spark, dealt, f"{self.root}/dealt")
        ends = []
        for at, side, place in (("l", F.lit(0), 0), ("r", F.col("rside"), 1)):
            asked = work if place == 0 else work.where(~(own & (F.col("ltile") == F.col("rtile"))))
            asked = asked.withColumns({"band": F.col(f"{at}band"), "side": side, "tile": F.col(f"{at}tile")})
            ends.append(asked.join(dealt, ["tree", "key", "band", "side", "tile"]).select(*TILED, F.lit(place).alias("place"), "uid", "n", *SKETCH, "comp"))
        return ends[0].unionByName(ends[1])


def _told_apart(table: pa.Table, percent: int, depth: int) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
    """Rows on the left and the right of a pair of tiles, and for each on the left which on the right may be a link of two components and share no earlier tree's region."""
    place, n, tree = np.asarray(table.column("place")), np.asarray(table.column("n")), table.column("tree")[0].as_py()
    left = np.flatnonzero(place == 0)
    right = np.flatnonzero(place == 1)
    alone = not len(right)
    right = left if alone else right
    sketch = np.stack([np.asarray(table.column(c)) for c in SKETCH]).view(np.uint64)
    comp = np.asarray(table.column("comp").combine_chunks().dictionary_encode().indices)
    labels = np.frombuffer(b"".join(table.column("signature").to_pylist()), ">u2").reshape(-1, TREES, APART)[:, :tree, :depth].astype(np.uint64)
    # (four values of two bytes each at most make a number)
    parts = [reduce(lambda x, y: (x << np.uint64(16)) | y, [labels[:, :, k] for k in range(i, min(i + 4, depth))]).T.copy() for i in range(0, depth, 4)]
    least = least_agreement(percent / 100)
    s, m, c, r = sketch[:, right], n[right], comp[right], [p[:, right] for p in parts]

    def partners(i: int) -> np.ndarray:
        x = left[i]
        fits = (100 * np.minimum(n[x], m) >= percent * np.maximum(n[x], m)) & (comp[x] != c)
        if alone:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        differ = sketch[:, x, None] ^ s[:, at]
        apart = sum(np.bitwise_count(np.bitwise_or.reduce(differ[w::WORDS])).astype(np.int64) for w in range(WORDS))
        at = at[MINIMA - apart >= least]
        if tree and len(at):
            at = at[~np.logical_and.reduce([p[:, x, None] == q[:, at] for p, q in zip(parts, r, strict=True)]).any(axis=0)]
        return right[at]

    return left, right, partners


def _hopeful(percent: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    """Of a pair of tiles, the rows that may have a link."""

    def run(table: pa.Table) -> pa.Table:
        left, _, partners = _told_apart(table, percent, depth)
        keep = np.zeros(table.num_rows, bool)
        for i, x in enumerate(left):
            if len(of := partners(i)):
                keep[of] = keep[x] = True
        return table.filter(pa.array(keep))

    return run


def _forest_of_links(percent: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    """Of a pair of tiles with their full sets, links (a, b): as many as it takes to join what the tiles' links join."""

    def run(table: pa.Table) -> pa.Table:
        left, _, partners = _told_apart(table, percent, depth)
        uid, n = table.column("uid").to_pylist(), np.asarray(table.column("n"))
        sets = table.column("set").combine_chunks()
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        ends = np.asarray(sets.offsets) - sets.offsets[0].as_py()
        _, of, often = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
        # what only one set holds is in no intersection
        place = np.cumsum(often > 1) - 1
        held = often[of] > 1
        bits = np.zeros((len(n), (int((often > 1).sum()) + 63) // 64), np.uint64)
        row, col = np.repeat(np.arange(len(n)), np.diff(ends))[held], place[of[held]]
        np.bitwise_or.at(bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
        comp = np.asarray(table.column("comp").combine_chunks().dictionary_encode().indices).copy()
        a, b = [], []
        for i, x in enumerate(left):
            near = partners(i)
            while len(near := near[comp[near] != comp[x]]):
                part, near = near[:_ROWS], near[_ROWS:]
                shared = np.bitwise_count(bits[x] & bits[part]).sum(axis=1, dtype=np.int64)
                for y in part[100 * shared >= percent * (n[x] + n[part] - shared)].tolist():
                    if comp[y] != comp[x]:
                        comp[comp == comp[y]] = comp[x]
                        a.append(min(uid[x], uid[y]))
                        b.append(max(uid[x], uid[y]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _component(df: DataFrame, joined: DataFrame, uid: str, into: str) -> DataFrame:
    """``df`` with the component of ``uid``, which is itself where ``joined`` (node, component) has none."""
    named = joined.select(F.col("node").alias(uid), F.col("component").alias(f"{into}_"))
    return df.join(named, uid, "left").withColumn(into, F.coalesce(f"{into}_", uid)).drop(f"{into}_")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _full_sets(spark: SparkSession, uids: DataFrame, distinct: DataFrame, blocks: str, root: str, shingle: int) -> DataFrame:
    """(uid, set) of these sets only, made again from the block files; staged."""

    def sets(block: pa.Table, mine: pa.Table) -> pa.Table:
        text = block.column("text")
        made = [np.unique(shingle_hashes(text[r].as_py() or "", shingle)).view(np.int64) for r in mine.column("row").to_pylist()]
        return pa.table({"uid": mine.column("uid"), "set": pa.array(made, pa.list_(pa.int64()))})

    asked = common.stage(spark, uids.distinct().join(distinct, "uid").select("uid", "first.block", "first.row"), f"{root}/asked")
    found = common.apply_blocks(asked, blocks, sets, "uid binary, set array<long>", asked.select("block").distinct().count())
    return common.stage(spark, found, f"{root}/sets")


def compared(spark: SparkSession, pairs: DataFrame, distinct: DataFrame, blocks: str, root: str, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b) by their full sets."""
    found = _full_sets(spark, pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), distinct, blocks, root, shingle)
    both = pairs.join(found.select(F.col("uid").alias("a"), F.col("set").alias("x")), "a").join(found.select(F.col("uid").alias("b"), F.col("set").alias("y")), "b")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("shared"))
    linked = F.lit(100).cast("long") * F.col("shared") >= F.lit(percent).cast("long") * (F.col("sizes") - F.col("shared"))
    out = common.stage(spark, shared.select("a", "b", linked.alias("linked")), f"{root}/compared")
    common.delete(spark, f"{root}/sets")
    return out


def tiles_compared(spark: SparkSession, tiled: DataFrame, depth: int, distinct: DataFrame, blocks: str, root: str, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked) of links that join what the links of pairs of tiles join; full sets are made for rows that may have one."""
    tiled = tiled.join(distinct.select("uid", "signature"), "uid")
    tiled = common.stage(spark, tiled.groupBy(*TILED).applyInArrow(_hopeful(percent, depth), tiled.schema), f"{root}/hopeful")
    if tiled.isEmpty():
        return spark.createDataFrame([], "a binary, b binary, linked boolean")
    whole = tiled.join(_full_sets(spark, tiled.select("uid"), distinct, blocks, root, shingle), "uid")
    links = whole.groupBy(*TILED).applyInArrow(_forest_of_links(percent, depth), "a binary, b binary")
    links = common.stage(spark, links.distinct().withColumn("linked", F.lit(True)), f"{root}/links")
    common.delete(spark, f"{root}/sets")
    return links


def minhash_groups(spark: SparkSession, documents: DataFrame, shingle: int = 5, percent: int = 80, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: rows are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id reachable."""
    root = common.scratch(spark, "forest")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(documents, "text").alias("text"))
    rows = common.stage(spark, _prints(docs, f"{root}/blocks", shingle), f"{root}/prints")
    same = rows.where("n > 0").groupBy(F.col("digest").alias("uid"))
    distinct = same.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row")).alias("first"), *[F.max(c).alias(c) for c in ("n", "signature", *SKETCH)])
    distinct = common.stage(spark, distinct, f"{root}/distinct")
    forest = Forest(spark, distinct, f"{root}/trees", percent, crowd)
    likeliest = forest.likeliest()
    seen = compared(spark, likeliest, distinct, f"{root}/blocks", f"{root}/first", shingle, percent)
    joined = lambda turn: common.stage(spark, components(spark, seen.where("linked").select("a", "b"), f"{root}/{turn}/components"), f"{root}/joined-{turn}")
    found = joined("first")
    apart = forest.drawn_apart(found, likeliest)
    if not apart.isEmpty():
        seen = seen.unionByName(compared(spark, apart, distinct, f"{root}/blocks", f"{root}/second", shingle, percent))
        found = joined("second")
    apart, tiled = forest.regions_apart(found)
    more = tiles_compared(spark, tiled, forest.met[0][0], distinct, f"{root}/blocks", f"{root}/tiles", shingle, percent)
    if not apart.isEmpty():
        more = more.unionByName(compared(spark, apart, distinct, f"{root}/blocks", f"{root}/third", shingle, percent))
    if not more.where("linked").isEmpty():
        seen = seen.unionByName(more)
        found = joined("third")
    ids = found.join(distinct.select(F.col("uid").alias("node"), F.col("first.doc_id").alias("doc_id")), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(ids, "component").select(F.col("node").alias("uid"), "component_id")
    groups = distinct.select("uid", "first.doc_id").join(named, "uid", "left").select(F.col("uid").alias("digest"), F.coalesce("component_id", "doc_id").alias("component_id"))
    # staged, so that the join reads two plain shuffles and a set of very many copies is split over tasks
    groups = common.stage(spark, groups, f"{root}/groups")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(groups, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op12_lsh_forest(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return minhash_groups(spark, documents, 3, 85).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
