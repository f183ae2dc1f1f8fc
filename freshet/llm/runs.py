"""Periodic runs of words by Main-Lorentz divide and conquer.

A run is a stretch of consecutive words whose smallest period q fits at least twice, that no neighbouring word extends keeping that period.  Words
are interned to ids; a stretch is halved again and again, and at each midpoint four Z-functions (of the right half against itself and against the
left, and both mirrored) tell for every period how far words q apart agree on either side of the midpoint.  Where the two reach over a whole period, a repetition crosses the
midpoint; it is extended over the borders of its stretch, and of equal intervals the one with the smallest period stays.

A run of length n >= max(least, 2 q) repeats grams of least / 2 words, as many in a row as its period asks for (see :func:`alive`).  So a stretch of words in
which no such gram comes twice has no run and is not halved any further: documents without repetition cost one look at their grams.

Scale: one pass, no shuffle; a task holds four bytes a word of one document besides its batch, and its distinct words.  A text's words are never all held as strings.

Defined results: null or blank text has no words and no run.  Repeated rows are rows of their own, and so are rows with null ids.  Other columns are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from freshet.llm import common

#: Least length of a run, in words.
LEAST = 12
#: Bytes of a text that are split to words at a time, and words that are joined at a time.
PIECE, JOINED = 1 << 20, 1 << 16
_WHITE = b" \t\n\x0b\x0c\r"


def intern_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ids of the words of a UTF-8 text, numbered as they come, and the distinct words."""
    known: dict[bytes, int] = {}
    ids = array("i")
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        ids.extend([known.setdefault(w, len(known)) for w in text[at:end].split()])
        at = end
    return np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32), list(known)


def earlier(ids: np.ndarray, size: int) -> np.ndarray:
    """For each gram of ``size`` words the start of the last equal one before it, -1 if there is none (grams whose hashes agree count as equal)."""
    n = len(ids) - size + 1
    if n < 2:
        return np.full(max(n, 0), -1, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    alike = h[order[1:]] == h[order[:-1]]
    out = np.full(n, -1, np.int64)
    out[order[1:][alike]] = order[:-1][alike]
    return out


def alive(before: np.ndarray, size: int) -> np.ndarray:
    """``before``, but -1 for the grams that no run repeats.

    A run of period q repeats at least q - size + 1 grams in a row, each of which has an equal one at most q before it.  So a gram whose last equal one is
    further away than the grams in a row that come again, and size - 1, is in none.
    """
    again = before >= 0
    edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
    row = np.zeros(len(before), np.int64)
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        row[start:end] = end - start
    return np.where(again & (np.arange(len(before)) - before <= row + size - 1), before, -1)


def agree(ids: np.ndarray, i: int, j: int, stop: int) -> int:
    """How many words from i and from j on are the same, j + that many being at most ``stop`` (i < j)."""
    n, step = 0, 16
    while j + n < stop:
        m = min(step, stop - j - n)
        differ = ids[i + n : i + n + m] != ids[j + n : j + n + m]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n += m
        step *= 2
    return n


def z_function(s: np.ndarray, own: int) -> np.ndarray:
    """z[i]: length of the longest common prefix of s and s[i:], for prefixes of at most ``own`` words; z[0] is ``own``.

    Prefixes of up to three words are found for all places at once; only places where four words agree are visited.
    """
    n = len(s)
    z = np.zeros(n, np.int64)
    if not own:
        return z
    at = np.flatnonzero(s[1:] == s[0]) + 1
    z[at] = 1
    for k in (1, 2, 3):
        if k >= own:
            at = at[:0]
            break
        at = at[at + k < n]
        at = at[s[at + k] == s[k]]
        z[at] = k + 1
    z[0] = own
    left = right = 0
    for i in at.tolist():
        k = 4
        if i < right:
            k = min(right - i, int(z[i - left]))
            if k < right - i:
                z[i] = k
                continue
        if k < own and i + k < n and s[k] == s[i + k]:
            k += agree(s, k, i + k, min(n, i + own))
        z[i] = k
        if i + k > right:
            left, right = i, i + k
            if right == n:
                break
    if right == n and left:  # no more to look at: s[left:] is a prefix, and what it begins with is known
        done = left + 1
        while done < n:
            to = min(n, left + done)
            z[done:to] = np.minimum(z[done - left : to - left], np.arange(n - done, n - to, -1))
            done = to
    return z


def crossing(ids: np.ndarray, lo: int, mid: int, hi: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions in ids[lo:hi] that cross ``mid``, bounded by lo and hi; one period, the smallest, an interval."""
    left, right = ids[lo:mid], ids[mid:hi]
    nl, nr = len(left), len(right)
    # words from mid on against those from mid + q on, and against those from mid - q on; the same mirrored, ending before mid
    ahead = z_function(right, nr)
    behind = z_function(left[::-1], nl)
    over = z_function(np.concatenate([right, [-1], left, right]), nr)[nr + 1 :]
    under = z_function(np.concatenate([left[::-1], [-1], right[::-1], left[::-1]]), nl)[nl + 1 :]
    found = []
    q = np.arange(1, nr)
    a, b = ahead[1:nr], under[nr - 1 : 0 : -1]
    found.append((mid - b, mid + q + a, q))
    q = np.arange(1, nl + 1)
    a = over[nl - 1 :: -1][:nl]
    b = np.append(behind[1:nl], 0)
    found.append((mid - q - b, mid + a, q))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    good = np.flatnonzero((end - start >= np.maximum(least, 2 * period)) & (start < mid) & (end > mid))
    best: dict[tuple[int, int], int] = {}
    for s, e, p in zip(start[good].tolist(), end[good].tolist(), period[good].tolist(), strict=True):
        if best.get((s, e), p + 1) > p:
            best[s, e] = p
    return [(s, e, p) for (s, e), p in best.items()]


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, ordered."""
    size = max(1, (least + 1) // 2)
    before = earlier(ids, size)
    if before.max(initial=-1) < 0:
        return []
    before = alive(before, size)
    mirrored = ids[::-1]
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(2, least) or before[lo : hi - size + 1].max(initial=-1) < lo:
            continue
        mid, done = (lo + hi) // 2, []
        for s, e, p in crossing(ids, lo, mid, hi, least):
            if e == hi:
                e += agree(ids, e - p, e, n)
            if s == lo:
                s -= agree(mirrored, n - s - p, n - s, n)
            if found.get((s, e), p + 1) > p:
                found[s, e] = p
            if 2 * p <= least:  # what lies in a run of so small a period is part of it
                done += [(s, e)]
        todo += [x for x in ((lo, mid), (mid, hi)) if not any(s <= x[0] and x[1] <= e for s, e in done)]
    return sorted((s, e - s, p) for (s, e), p in found.items())


def beyond_first(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) > 0


def joined(ids: np.ndarray, words: list[bytes]) -> Iterator[bytes]:
    """The words joined by single spaces, some at a time."""
    for i in range(0, len(ids), JOINED):
        yield (b" " if i else b"") + b" ".join([words[k] for k in ids[i : i + JOINED].tolist()])


Rewrite = Callable[[int | None, np.ndarray], np.ndarray]
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def _each(docs: DataFrame, row: Callable[[np.ndarray, list[bytes]], list], schema: str, rewrite: Rewrite | None) -> DataFrame:
    """One pass: doc_id and ``row`` of the (rewritten) words of each text."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.make_room()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids, words = intern_words(text.as_py() or b"")
                    if rewrite is not None:
                        ids = rewrite(doc_id, ids)
                    rows.append([doc_id, *row(ids, words)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        common.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period; by start, then period) and ``text``: the words joined by spaces, of each run only the first period."""

    def row(ids: np.ndarray, words: list[bytes]) -> list:
        runs = find_runs(ids, least)
        kept = ids[~beyond_first(len(ids), runs)] if runs else ids
        return [len(ids), [{"start": s, "length": n, "period": q} for s, n, q in runs], b"".join(joined(kept, words)).decode()]

    return _each(docs, row, RUNS, None)


def planted(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The words of one document of ten made periodic behind a place, as the query's contract says; a row without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(ids)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


OP11 = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op11_periodic_runs(documents: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest (ties: smallest start, then period), and digests of all runs and of the text without their repetitions."""

    def row(ids: np.ndarray, words: list[bytes]) -> list:
        runs = find_runs(ids)
        listed = hashlib.sha256()
        for s, n, q in runs:
            listed.update(f"{s},{n},{q}\n".encode())
        text = hashlib.sha256()
        for piece in joined(ids[~beyond_first(len(ids), runs)] if runs else ids, words):
            text.update(piece)
        top = min(((-n, s, q) for s, n, q in runs), default=None)
        longest = [None] * 4 if top is None else [top[1], -top[0], top[2], 1000 * -top[0] // top[2]]
        return [len(runs), *longest, listed.hexdigest(), text.hexdigest()]

    return _each(documents, row, OP11, planted)
