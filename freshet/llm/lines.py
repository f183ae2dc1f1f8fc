"""Line deduplication with a log-template tree of fixed depth.

A line's tokens are its words; a token with a digit is a variable field.  The tree's first level is the token count, the
next :data:`DEPTH` levels are the leading tokens (variable fields as ``<*>``); a leaf holds templates.  In a leaf, lines
are taken in order (most documents first, then by text): a line joins the template that has most constant tokens in common with it,
place by place behind the leading ones, if those are more than :data:`ALIKE` of the places there, and places where they differ become
``<*>``; else it founds a template.  So most places behind the leading tokens are constant in every template of several lines.
A template found in at least ``min_docs`` documents recurs: its lines are dropped from every document but the first (the smallest
doc_id) it stands in, so no content is lost altogether.

Scale: a task sends one row for each distinct line of its blocks, and only lines of leaves with ``min_docs`` documents
go on.  A leaf's lines stream through one task in their order; it holds the templates, not the lines.  Beyond :data:`LEAF` templates
a line is compared only with those that share one of its rarest tokens in place, which loses none that it could join: a leaf's result does
not depend on its size.  Of a leaf with more than :data:`CROWD` distinct lines, only those go to its task that share enough tokens in place with other
lines to join one (which is found by counting, without the task); the others are templates of their own, as they would be there.  Documents are read back block by block; no text is shuffled but the
distinct lines of the leaves that enough documents reach.

Defined results: null text has no lines; lines without a token stay.  Lines of fewer than :data:`MIN_TOKENS` tokens, or mostly of variable
fields, are too unspecific to generalise: each is a template of its own exact words, digits included (:func:`line_dedup` leaves them out
unless asked with ``exact``; the query and the pipeline take them in).  Lines that repeat within one document are one occurrence
for counting, and all of them stay or go.  Rows with null doc_id count before all others; rows with equal ids are ordered by
their text's hash, then by their place.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common

DEPTH = 3
ALIKE = 0.5
#: Distinct lines of a leaf from which on those that can join none of the others are sorted out before a task takes the leaf.
CROWD = 20_000
#: Templates of a leaf that are compared with each line without looking its tokens up.
LEAF = 2048
MIN_DOCS = 5
#: Lines with fewer tokens, or with more variable fields than constant tokens, are too unspecific to generalise.
MIN_TOKENS = 4
WILD = b"<*>"
_NO_ID = -(1 << 63)
_DIGIT = re.compile(rb"\d")

SPELT = "leaf long, line long, docs long, masked binary"
LINE = "block long, doc_id long, tie int, row int, line long, leaf long"
_LINE = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64()}[x.split()[1]]) for x in LINE.split(", ")])


def mask(line: bytes) -> list[bytes]:
    """Tokens of a line, those with a digit as ``<*>``."""
    tokens = line.split()
    return [WILD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def specific(tokens: list[bytes]) -> bool:
    return len(tokens) >= MIN_TOKENS and 2 * tokens.count(WILD) <= len(tokens)


def _h(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def leaf_key(tokens: list[bytes]) -> int:
    return _h(b" ".join([str(len(tokens)).encode(), *tokens[:DEPTH]]))


def line_key(line: bytes, exact: bool) -> tuple[int, int] | tuple[()]:
    """Hashes of the masked line and of its leaf; with ``exact``, of an unspecific line's own words twice; else none."""
    tokens = mask(line)
    if specific(tokens):
        return _h(b" ".join(tokens)), leaf_key(tokens)
    if exact and tokens:
        h = _h(b"\n" + b" ".join(line.split()))  # no masked line has a line end
        return h, h
    return ()


def _lines(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def _features(block: int, table: pa.Table, exact: bool) -> Iterator[pa.RecordBatch]:
    """A marker row, and one row for each distinct masked (or exact) line of each document."""
    texts = table.column("text").cast(pa.binary()).to_pylist()
    ids = table.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_pylist()
    known: dict[bytes, tuple] = {}
    rows: list[tuple] = [(block, *5 * (None,))]
    for row, (doc, text) in enumerate(zip(ids, texts, strict=True)):
        tie = xxhash.xxh32_intdigest(text or b"") >> 1
        seen = set()
        for line in dict.fromkeys(_lines(text)):
            if line not in known:
                known[line] = line_key(line, exact)
            got = known[line]
            if got and got[0] not in seen:
                seen.add(got[0])
                rows.append((block, doc, tie, row, *got))
        if len(rows) >= 20_000:
            yield _batch(rows)
            rows = []
            known.clear()
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINE, strict=True)], schema=_LINE)


class Leaf:
    """The templates of one leaf (lines of equal token counts)."""

    def __init__(self, width: int):
        self.words: dict[bytes, int] = {WILD: 0}
        self.found = np.empty((16, width), np.int32)
        self.n = 0
        self.least = int(ALIKE * (width - DEPTH)) + 1  # constant tokens in common that make a line join
        self.places: dict[tuple[int, int], array] | None = None  # (place, token) -> templates founded or left with it

    def _index(self, template: int) -> None:
        for at, word in enumerate(self.found[template, DEPTH:].tolist()):
            if word:
                self.places.setdefault((at, word), array("q")).append(template)

    def _rivals(self, line: list[int]) -> np.ndarray | None:
        """Templates, in order, among which are all that the line could join; None: all there are."""
        if self.n <= LEAF:
            return None
        if self.places is None:
            self.places = {}
            for t in range(self.n):
                self._index(t)
        # who has ``least`` of the places in common has one of any len - least + 1 of them
        lists = sorted((self.places.get((at, word), ()) for at, word in enumerate(line[DEPTH:]) if word), key=len)
        lists = [np.array(x, np.int64) for x in lists[: max(0, len(lists) - self.least + 1)]]
        return np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)

    def place(self, masked: bytes) -> int:
        """The template that the line joins or founds."""
        coded = [self.words.setdefault(t, len(self.words)) for t in masked.split(b" ")]
        line = np.array(coded, np.int32)
        rivals = self._rivals(coded)
        held = self.found[: self.n] if rivals is None else self.found[rivals]
        if len(held):
            asked = np.where(line[DEPTH:] == 0, -1, line[DEPTH:])  # variable fields agree with nothing
            same = (held[:, DEPTH:] == asked).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.least:
                best = best if rivals is None else int(rivals[best])
                self.found[best][self.found[best] != line] = 0
                return best
        if self.n == len(self.found):
            self.found = np.concatenate([self.found, np.empty_like(self.found)])
        self.found[self.n] = line
        self.n += 1
        if self.places is not None:
            self._index(self.n - 1)
        return self.n - 1


def templates(lines: list[tuple[bytes, int]]) -> list[int]:
    """Number of the template of each masked line of one leaf (equal token counts), given with its documents; in the order taken."""
    order = sorted(range(len(lines)), key=lambda i: (-lines[i][1], lines[i][0]))
    leaf = Leaf(lines[0][0].count(b" ") + 1)
    out = [0] * len(lines)
    for i in order:
        out[i] = leaf.place(lines[i][0])
    return out


def _spell(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """The asked lines of a block (row, and hash of the masked line) with their masked text."""
    texts = docs.column("text").cast(pa.binary())
    wanted: dict[int, set[int]] = {}
    for row, line in zip(asked.column("row").to_pylist(), asked.column("line").to_pylist(), strict=True):
        wanted.setdefault(row, set()).add(line)
    found: dict[int, bytes] = {}
    for row, lines in wanted.items():
        for line in _lines(texts[row].as_py()):
            masked = b" ".join(mask(line))
            if (h := _h(masked)) in lines:
                found[h] = masked
    masked = pa.array([found[h] for h in asked.column("line").to_pylist()], pa.binary())
    return pa.table({"leaf": asked.column("leaf"), "line": asked.column("line"), "docs": asked.column("docs"), "masked": masked})


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, template) of distinct lines, leaf after leaf, each in its order."""
    key, leaf = None, None
    for batch in batches:
        out = []
        for k, masked in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                key, leaf = k, Leaf(masked.count(b" ") + 1)
            out.append(_h(b"%d %d" % (k, leaf.place(masked))))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64())], ["line", "template"])


def _parted(spark: SparkSession, spelt: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Lines of crowded leaves: those that may join a template with another line, and (line, template) of those that cannot.

    A line joins a template by constant tokens in place that the template's first line has too.  So a line of which fewer tokens in place
    than that takes are found in other lines of its leaf neither joins nor is joined, whatever the order: it is a template of its own.
    """
    lines = common.stage(spark, spelt, f"{root}/crowded-lines")
    tokens = F.split(F.col("masked").cast("string"), " ")
    least = F.floor(ALIKE * (F.size(tokens) - DEPTH)).cast("int") + 1
    places = lines.select("leaf", "line", least.alias("least"), F.posexplode(F.slice(tokens, DEPTH + 1, F.size(tokens))).alias("at", "token"))
    places = places.where(F.col("token") != WILD.decode()).select("leaf", "line", "least", "at", F.xxhash64("token").alias("word"))
    # staged, so that the join reads two plain shuffles and a frequent word of a crowded leaf is split over tasks
    shared = common.stage(spark, places.groupBy("leaf", "at", "word").agg(F.count("*").alias("n")).where("n > 1").drop("n"), f"{root}/shared")
    met = places.join(shared, ["leaf", "at", "word"]).groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    met = common.stage(spark, met.where("n >= least").select("leaf", "line"), f"{root}/joining")
    single = lines.join(met, ["leaf", "line"], "left_anti").select("line", F.col("line").alias("template"))
    return lines.join(met, ["leaf", "line"], "left_semi").select(spelt.columns), single


def recurring(spark: SparkSession, docs: DataFrame, root: str, min_docs: int = MIN_DOCS, exact: bool = True) -> tuple[DataFrame, int]:
    """(block, row, line): the lines to drop, by their keys; rows with a null ``row`` mark blocks.  And the number of blocks."""
    features = lambda block, table: _features(block, table, exact)
    rows = common.stage(spark, common.block_pass(docs, f"{root}/blocks", features, LINE), f"{root}/lines")
    found = rows.where("row is not null")
    blocks = rows.where("row is null").count()
    # leaves that enough documents reach; a document reaches a leaf once for each of its lines, so this is a superset
    reached = found.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    at = F.min(F.struct("block", "row")).alias("at")
    distinct = found.groupBy("line", "leaf").agg(F.count("*").alias("docs"), at)
    distinct = common.stage(spark, distinct.join(reached, "leaf", "left_semi"), f"{root}/distinct")
    alone = distinct.where("leaf = line").select("line", F.col("line").alias("template"))
    asked = distinct.where("leaf <> line").select("at.block", "at.row", "line", "leaf", "docs")
    spell = lambda df: common.apply_blocks(df, f"{root}/blocks", _spell, SPELT, blocks)
    crowded = common.stage(spark, asked.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("leaf"), f"{root}/crowded")
    if crowded.isEmpty():
        lines = spell(asked)
    else:
        joining, single = _parted(spark, spell(asked.join(crowded, "leaf", "left_semi").select(asked.columns)), root)
        lines = spell(asked.join(crowded, "leaf", "left_anti").select(asked.columns)).unionByName(joining)
        alone = alone.unionByName(single)
    ordered = lines.select("leaf", "line", "masked", "docs").repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), "masked")
    named = ordered.mapInArrow(_cluster, "line long, template long").unionByName(alone)
    named = common.stage(spark, named, f"{root}/templates")
    place = F.struct("doc_id", "tie", "block", "row")
    stood = found.select("line", "block", "doc_id", "tie", "row").join(named, "line")
    stood = common.stage(spark, stood, f"{root}/stood")
    # a document counts once for a template, however many of its lines it has
    once = stood.groupBy("template", "block", "row").agg(F.min("doc_id").alias("doc_id"), F.min("tie").alias("tie"))
    again = once.groupBy("template").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") >= min_docs).select("template", "first")
    # staged, so that the join reads two plain shuffles and a template in a third of all documents is split over tasks
    again = common.stage(spark, again, f"{root}/recurring")
    dropped = stood.join(again, "template").where((F.col("block") != F.col("first.block")) | (F.col("row") != F.col("first.row")))
    return rows.where("row is null").select("block", "row", "line").unionByName(dropped.select("block", "row", "line")), blocks


def _kept(texts: list[bytes | None], mine: pa.Table, exact: bool = True) -> Iterator[tuple[list[bytes], int]]:
    """For each document of a block, the lines that stay and how many go."""
    gone: dict[int, set[int]] = {}
    for row, line in zip(mine.column("row").to_pylist(), mine.column("line").to_pylist(), strict=True):
        if row is not None:
            gone.setdefault(row, set()).add(line)
    for row, text in enumerate(texts):
        lines = _lines(text)
        if row not in gone:
            yield lines, 0
            continue
        stay = [x for x in lines if not (key := line_key(x, exact)) or key[0] not in gone[row]]
        yield stay, len(lines) - len(stay)


def line_dedup(spark: SparkSession, documents: DataFrame, min_docs: int = MIN_DOCS, exact: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay, joined by line ends, of every document.

    ``exact``: lines too unspecific to generalise recur too, by their exact words.
    """
    root = common.scratch(spark, "lines")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def apply(block: pa.Table, mine: pa.Table) -> pa.Table:
        texts = block.column("text").cast(pa.binary()).to_pylist()
        rows = [(len(stay) + n, n, hashlib.sha256(b"\n".join(stay)).hexdigest()) for stay, n in _kept(texts, mine, exact)]
        cols = list(zip(*rows, strict=True))
        return pa.table([block.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    lines, blocks = recurring(spark, docs, root, min_docs, exact)
    return common.apply_blocks(lines, f"{root}/blocks", apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", blocks)


def drop_recurring(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without recurring lines, ``n_chars`` kept true; a document all of whose lines with a word are dropped goes."""
    root = common.scratch(spark, "lines")
    counts = "n_chars" in docs.columns

    def apply(block: pa.Table, mine: pa.Table) -> pa.Table:
        texts = block.column("text").cast(pa.binary()).to_pylist()
        keep, new = [], []
        changed = []
        for i, (stay, n) in enumerate(_kept(texts, mine)):
            if n and not any(x.strip() for x in stay):
                continue
            keep.append(i)
            changed.append(n > 0)
            new.append(b"\n".join(stay).decode("utf-8") if n else None if texts[i] is None else texts[i].decode("utf-8"))
        out = block.take(pa.array(keep, pa.int64()))
        at = out.schema.get_field_index("text")
        out = out.set_column(at, out.schema.field(at), pa.array(new, pa.string()))
        if counts:
            at = out.schema.get_field_index("n_chars")
            sizes = [len(t) if c else old for t, c, old in zip(new, changed, out.column("n_chars").to_pylist(), strict=True)]
            out = out.set_column(at, out.schema.field(at), pa.array(sizes, out.schema.field(at).type))
        return out

    lines, blocks = recurring(spark, docs, root, min_docs)
    return common.apply_blocks(lines, f"{root}/blocks", apply, docs.schema, blocks)


def op4_line_dedup(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return line_dedup(spark, documents, exact=True)
