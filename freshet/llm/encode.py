"""Encoding of whole texts with the tokenizers library, with a bounded cache of the units texts are made of.

Both public vocabularies split a text into pre-tokens before they merge, and a pre-token never spans the start of a run of
white space, nor an ASCII letter and an ASCII sign behind it.  A text's ids are therefore the ids of its units (a run of blanks,
tabs and line ends with the word behind it; the signs behind a word) one after another.  Units are cut and told apart in Arrow and NumPy, a group
of texts at a time; the distinct ones are encoded by the library, and remembered within a bound of bytes.  Texts for
which that is not certain (other white space, strings of special tokens) are encoded whole.

Defined results: a null text is the empty text.  Texts may be of any length; empty and repeated ones are texts like others.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from freshet.llm.common import FORGET, trim

#: White space that is no unit border, or that only some definitions call white space; and what every special token begins with.
_WHOLE = "[\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|<\\|"

#: Bytes (estimated) of remembered units in a worker, the largest unit remembered, and units in one call of the library.
CACHE_BYTES = 96 << 20
UNITS = CACHE_BYTES // 192
LARGEST = 64
BATCH = 512
#: Bytes of text worked off at a time.
GROUP = 8 << 20

_SPACE, _LETTER, _SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \n\r\t")] = _SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _SIGN  # no apostrophe: contractions are pre-tokens


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)  # one encoder a worker: what it remembers is bounded, so the worker is
def units(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def _clear() -> None:
    if units.cache_info().currsize or tokenizer.cache_info().currsize:
        units.cache_clear()
        tokenizer.cache_clear()
        trim()


FORGET.append(_clear)


def cut(data: np.ndarray, begins: np.ndarray, blank: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the units of the texts in ``data`` that begin at ``begins``, where each unit begins in them, and the first unit of each text.

    ``blank``: white space is left out.
    """
    kind = _KIND[data]
    space = kind == _SPACE
    start = np.empty(len(data), bool)
    start[1:] = (kind[1:] == _SIGN) & (kind[:-1] == _LETTER)
    start[1:] |= (space[:-1] & ~space[1:]) if blank else (space[1:] & ~space[:-1])
    start[:1] = True
    start[begins[begins < len(data)]] = True
    if blank:
        start &= ~space
        at = np.flatnonzero(start)
        word = ~space
        return data[word], (np.cumsum(word) - 1)[at] if len(at) else at, np.searchsorted(at, begins)
    at = np.flatnonzero(start)
    return data, at, np.searchsorted(at, begins)


def grouped(texts: pa.Array, group: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of some texts at a time (of about ``group`` bytes, or one longer text), and where each begins in them."""
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    ends = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + group, "right")) - 1)
        yield data[ends[i] : ends[j]], ends[i:j] - ends[i]
        i = j


def split(ids: np.ndarray, begins: np.ndarray) -> Iterator[bytes]:
    """The ids of each text, as bytes."""
    raw, at = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
    return (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


class Memory:
    """Ids of units, remembered within :data:`CACHE_BYTES`; ``_learn`` asks the library for those of a list."""

    def __init__(self):
        #: Units met in two groups of texts or more, and those met in one only; the latter go first.
        self.cache: dict[bytes, bytes] = {}
        self.young: dict[bytes, bytes] = {}
        self.held = self.held_young = 0

    def known(self, asked: list[bytes]) -> list[bytes]:
        """Ids of units, from memory or from the library."""
        found = list(map(self.cache.get, asked))
        new = dict.fromkeys(u for u, ids in zip(asked, found, strict=True) if ids is None)
        if not new:
            return found
        again = {u: self.young.pop(u) for u in new if u in self.young}
        new = [u for u in new if u not in again]
        learnt = dict(zip(new, self._learn(new), strict=True))
        here = again | learnt
        self.held = self._keep(self.cache, again, self.held, 5)
        self.held_young = self._keep(self.young, learnt, self.held_young, 3)
        return [here[u] if ids is None else ids for u, ids in zip(asked, found, strict=True)]

    def _keep(self, into: dict[bytes, bytes], fresh: dict[bytes, bytes], held: int, share: int) -> int:
        """Remember units within ``share`` eighths of the bound; their bytes."""
        room, most = share * CACHE_BYTES // 8, share * UNITS // 8
        fresh = {u: ids for u, ids in islice(fresh.items(), most) if len(u) <= LARGEST}
        size = sum(map(len, fresh)) + sum(map(len, fresh.values())) + 176 * len(fresh)
        if held + size > room or len(into) + len(fresh) > most:
            gone = (len(into) + 1) // 2 if into is self.cache else len(into)  # the older half goes, or all that came but once
            for u in list(islice(into, gone)):
                del into[u]
            held = held // 2 if into is self.cache else 0
        if held + size <= room and len(into) + len(fresh) <= most:
            into |= fresh
            held += size
        return held

    def rest(self) -> None:
        """At the end of a task: what was met but once goes, and free memory with it."""
        self.young.clear()
        self.held_young = 0
        trim()

    def spell(self, data: np.ndarray, at: np.ndarray, first: np.ndarray, key: Callable[[list[bytes]], list[bytes]] = lambda x: x) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that begin in ``data`` at ``at``, one behind another, and where the ids of the texts begin whose first units are ``first``.

        Units are told apart in Arrow and looked up once a group, by ``key``.
        """
        if not len(at):
            return np.empty(0, "<u4"), np.zeros(len(first), np.int64)
        ends = np.append(at, len(data)).astype(np.int32)
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = whole.dictionary_encode()
        known = self.known(key(coded.dictionary.to_pylist()))
        table = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        of = np.asarray(coded.indices)
        n = sizes[of]
        until = np.cumsum(n)
        # the i-th id of a unit stands i places behind the unit's first in the table
        ids = table[np.repeat((np.cumsum(sizes) - sizes)[of] - (until - n), n) + np.arange(until[-1])]
        return ids, np.append(0, until)[first]


class UnitEncoder(Memory):
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.lib = tokenizer(path)
        added = self.lib.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        if not all("<|" in t for t in self.special):
            raise ValueError("special tokens are expected to begin with <|")
        # a special token's string parts the text around it before anything else is done: the units between are encoded as if alone
        self.border, self.mark = next((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        #: White space is dropped and words end with tokens of their own; else it belongs to the word behind it.
        self.blank = self._ids(" ") == b"" and self._ids(" a") == self._ids("a")
        self.fold = self._ids("ABCXYZ") == self._ids("abcxyz")
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.borders = np.zeros(self.lib.get_vocab_size() + 1, bool)
        for token, i in vocabulary.items():
            self.borders[i] = token.endswith("</w>") if self.blank else token.startswith("Ġ")

    def _ids(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _plain(self, units: list[bytes]) -> list[bool]:
        """Which units can stand next to one another in one text without a mark, each with one border token."""
        if self.blank:  # a pre-token ends with a token that says so
            return list(map(str.isalpha, map(bytes.decode, units)))
        return [u[:1] == b" " and u[1:2] > b" " for u in units]  # a unit begins with its blank

    def _learn(self, units: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        plain = self._plain(units)
        easy, marked = [i for i, x in enumerate(plain) if x], [i for i, x in enumerate(plain) if not x]
        for i in range(0, len(easy), BATCH):
            part = easy[i : i + BATCH]
            text = (b" " if self.blank else b"").join([units[k] for k in part]).decode()
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            borders = np.flatnonzero(self.borders[ids])
            # no unit has fewer borders than one, so their number is right only if every one has one
            if len(borders) != len(part):
                marked += part
                continue
            raw, at = ids.tobytes(), 0
            for k, end in zip(part, (4 * (borders + 1 if self.blank else np.append(borders[1:], len(ids)))).tolist(), strict=True):
                out[k] = raw[at:end]
                at = end
        for i in range(0, len(marked), BATCH):
            part = marked[i : i + BATCH]
            ids = np.array(self.lib.encode_batch_fast([self.mark.join([units[k].decode() for k in part])], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 0
            for k, end in zip(part, [*(4 * np.flatnonzero(ids == self.border)).tolist(), len(raw)], strict=True):
                out[k] = raw[at:end]
                at = end + 4
        return out

    def _fold(self, asked: list[bytes]) -> list[bytes]:
        # (other letters may compose otherwise when lower-cased first)
        return [u.lower() if u.isascii() else u for u in asked] if self.fold else asked

    def _group(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``begins``, one text behind another, and where each text's ids begin."""
        return self.spell(*cut(data, begins, self.blank), self._fold)

    def encode(self, texts: list[str | None] | pa.Array, group: int = GROUP) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        whole = np.asarray(pc.match_substring_regex(texts, _WHOLE))
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._ids(texts[i].as_py())
        rest = np.flatnonzero(~whole)
        for i, data in zip(rest.tolist(), self._encode(texts.take(pa.array(rest)) if whole.any() else texts, group), strict=True):
            out[i] = data
        return out

    def _encode(self, texts: pa.Array, group: int) -> Iterator[bytes]:
        """Texts without anything that has to be encoded whole."""
        for data, begins in grouped(texts, group):
            if len(data) > group:
                yield b"".join(self._pieces(data, group))
            else:
                yield from split(*self._group(data, begins))

    def _pieces(self, text: np.ndarray, group: int) -> Iterator[bytes]:
        """One long text, cut where runs of white space begin."""
        at = 0
        while at < len(text):
            stop = at + group
            while stop < len(text):
                low = max(at, stop - group // 2)
                space = _KIND[text[low:stop]] == _SPACE
                borders = np.flatnonzero(space[1:] & ~space[:-1])
                if len(borders):
                    stop = low + 1 + int(borders[-1])
                    break
                stop += group // 2  # no border yet: a longer piece
            yield self._group(text[at:stop], np.zeros(1, np.int64))[0].tobytes()
            at = stop


def forget(path: str) -> None:
    """At the end of a task."""
    units(path).rest()


def encode_all(texts: list[str | None] | pa.Array, path: str, end: int, chars: int = GROUP) -> list[bytes]:
    """Ids of each text (null: empty) with the id ``end`` behind them, worked off in groups of about ``chars`` bytes."""
    tail = np.array([end], "<u4").tobytes()
    return [x + tail for x in units(path).encode(texts, chars)]
