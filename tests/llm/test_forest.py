"""MinHash near-duplicates by an LSH forest, against an exact search over all pairs."""

import random
import re

import numpy as np
import pytest

from freshet.llm import forest, queries
from freshet.llm.forest import least_agreement, least_depth, minhash_groups, minima, op12_lsh_forest

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < size else zip(*(words[i:] for i in range(size)), strict=False))


def brute(rows, size=3, percent=85):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) by looking at all pairs of different sets."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, s in enumerate(sets):
        if s in seen and s:
            parent[top(i)] = top(seen[s])
        seen.setdefault(s, i)
    different = [(s, i) for s, i in seen.items() if s]
    for k, (s, i) in enumerate(different):
        for t, j in different[:k]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("sf", [SF, SF_MORE])
def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_lsh_forest"](spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = got.collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and any(not r.kept for r in got)


def near_copies(rnd, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = rnd.choice("abcdefghijklmnop") * 3
        yield " ".join(words)


def test_crowded_regions(spark, documents, monkeypatch):
    """Groups of near copies at the edge of the similarity, and many texts with one passage: regions are far larger than the crowd, down to the last level."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 8)))
    base = " ".join(word() for _ in range(120))
    passage = " ".join(word() for _ in range(60))
    texts = [*near_copies(rnd, base, 150, 6), *(f"{passage} {' '.join(word() for _ in range(20))}" for _ in range(80)), *[base] * 40]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 5 < len({c for _, _, c in want if c is not None}) < len(rows)
    seen = []
    made = forest.Forest.__init__
    monkeypatch.setattr(forest.Forest, "__init__", lambda self, *a: (made(self, *a), seen.append(len(self.met)))[0])
    # regions far too crowded: deeper levels may miss a link at the edge, but make none up
    got = plain(minhash_groups(spark, documents(texts), 3, 85, crowd=8))
    groups = {}
    for (i, _, c), (j, _, w) in zip(got, want, strict=True):
        assert i == j and groups.setdefault(c, w) == w
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert plain(minhash_groups(spark, documents(texts), 3, 85)) == want
    assert seen[0] == 5 and seen[1] >= 2


@pytest.mark.parametrize(("crowd", "tile"), [(8, 1024), (8, 16)])
def test_no_crowded_region_is_left_out(spark, documents, monkeypatch, crowd, tile):
    """Regions with many sets that nothing drawn joins: their links at the edge of the similarity are found, whatever the crowd and the tiles."""
    monkeypatch.setattr(forest, "TILE", tile)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(100):  # a set, and one just similar enough to it; sets of different k hardly ever are
        one = list(base)
        for i in rnd.sample(range(0, 108, 4), 3):
            one[i] = f"x{k}-{i}"
        texts += [" ".join(one), " ".join([*one[:-9], *(f"y{k}-{i}" for i in range(9))])]
    rnd.shuffle(texts)
    want = brute(list(enumerate(texts)))
    assert len({c for _, _, c in want}) > 80
    assert plain(minhash_groups(spark, documents(texts), 3, 85, crowd=crowd)) == want


def test_other_shingles_and_similarity(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(minhash_groups(spark, spark.read.parquet(f"{SF_MORE}/documents.parquet"))) == brute(rows, 5, 80)


def test_odd_rows(spark, documents):
    long = " ".join(f"w{i % 50_021}" for i in range(600_000))
    texts = [None, "", " \n", "one", "ONE", "one two", "one two", "x y z", "x y z", long, long.replace("w7 ", "v7 "), "a b c d", "a b c d"]
    ids = [0, 1, 2, 3, 4, 5, 5, None, None, 9, 10, None, 12]
    df = documents(texts, ids, extra=True)
    got = op12_lsh_forest(spark, df)
    assert plain(got) == brute(list(zip(ids, texts, strict=True)))
    rows = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert rows[10, 50_021].component_id == 9 and rows[None, 1].component_id is None and rows[None, 1].kept and rows[None, 2].component_id == 12
    assert op12_lsh_forest(spark, documents([])).collect() == []


def test_minima_estimate_similarity():
    rnd = np.random.default_rng(2)
    h = rnd.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = h[:2000], h[500:2500]  # 1500 of 2500
    assert abs((minima(a) == minima(b)).mean() - 0.6) < 0.15
    assert (minima(h) == np.minimum(minima(h[:1500]), minima(h[1500:]))).all()


def test_depths():
    assert least_depth(0.85) == 4 and least_depth(0.99) == 5 and least_depth(0.5) == 1
    assert 203 <= least_agreement(0.85) <= 206 and least_agreement(1.0) == 256
