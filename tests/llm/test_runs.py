"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from freshet.llm import queries
from freshet.llm.runs import collapse_runs, find_runs, intern_words, op11_periodic_runs, z_function

SF = "/root/testdata/sf0.001"


def brute(ids, least=12):
    """All runs by looking at every period: stretches where words that far apart agree."""
    ids, n, out = np.asarray(ids), len(ids), {}
    for q in range(1, n // 2 + 1):
        edge = np.flatnonzero(np.diff(ids[:-q] == ids[q:], prepend=False, append=False))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e + q - s >= max(least, 2 * q):
                out.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    known = {}
    runs = brute([known.setdefault(w, len(known)) for w in words])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    longest = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    return doc_id, len(runs), *longest, digest("".join(f"{s},{x},{q}\n" for s, x, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        n, k = rnd.randrange(120), rnd.choice((1, 2, 3, 5, 20))
        ids = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(3)):  # make a part periodic
            a = rnd.randrange(n + 1)
            p, e = rnd.randrange(1, 12), rnd.randrange(a, n + 1)
            ids[a:e] = [ids[a + (i - a) % p] for i in range(a, e)]
        least = rnd.choice((12, 12, 1, 2, 3, 5, 7))
        assert find_runs(np.array(ids, np.int32), least) == brute(ids, least)


def test_z_function():
    rnd = random.Random(1)
    for _ in range(500):
        s = [rnd.randrange(rnd.choice((1, 2, 3))) for _ in range(rnd.randrange(1, 60))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert z_function(np.array(s, np.int32), len(s)).tolist() == want


def test_words():
    assert [w.decode() for w in intern_words("a\x0bb c a\x1cd\n".encode())[1]] == ["a", "b c", "a\x1cd"]
    ids, words = intern_words(b"one two " * 400_000)  # longer than a piece
    assert len(ids) == 800_000 and words == [b"one", b"two"] and ids[:4].tolist() == [0, 1, 0, 1]
    assert len(intern_words(b" \n")[0]) == len(intern_words(b"")[0]) == 0


def test_query_matches_brute_force(spark):
    got = queries.queries()["op11_periodic_runs"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect())) == sorted(brute_row(*r) for r in docs)
    assert got.where("n_runs > 0").count() > 10


def test_odd_rows(spark, documents):
    block = "the tide turned and the boats came home "
    texts = [None, "", "  ", "x", "ho " * 50_000, block * 5 + "then night fell", block * 5 + "then night fell", "a b " * 5, "a b " * 6]
    df = documents(texts, [1, 2, 3, 4, None, 6, 6, 8, 9], extra=True)
    got = sorted(map(tuple, op11_periodic_runs(df).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t in zip([1, 2, 3, 4, None, 6, 6, 8, 9], texts, strict=True)), key=repr)
    assert op11_periodic_runs(documents([])).collect() == []
    rows = {r["doc_id"]: r for r in collapse_runs(df).collect()}
    assert rows[None]["text"] == "ho" and rows[6]["text"] == block + "then night fell" and rows[2]["text"] == ""
    assert [tuple(x) for x in rows[9]["runs"]] == [(0, 12, 2)] and rows[8]["runs"] == [] and rows[6]["n_words"] == 43


def test_very_long_text():
    """A million words: long periods, and one word over and over."""
    rnd = np.random.default_rng(3)
    page = rnd.integers(0, 5000, 70_000).astype(np.int32)
    ids = np.concatenate([rnd.integers(0, 5000, 300_000).astype(np.int32), np.tile(page, 5), np.full(350_000, 7, np.int32)])
    runs = find_runs(ids)
    assert any(q == 70_000 and length >= 350_000 for _, length, q in runs) and any(q == 1 and length >= 350_000 for _, length, q in runs)
