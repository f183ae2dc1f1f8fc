import random

import numpy as np
import xxhash

from freshet.llm import simhash
from freshet.llm.simhash import compare, fingerprint, op7_simhash

WS = " \t\n\x0b\x0c\r"


def brute_print(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WS:
            if word:
                words.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(prints)), key=repr)


def test_matches_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = random.Random(1)
    texts = [None, "", " \n\t", "One", "one two", "ONE two three", "É é A b c d e"]
    for _ in range(20):
        words = ["".join(r.choices("abcdeFGHé", k=4)) for _ in range(r.randint(1, 300))]
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            copy[r.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
        texts.append(" ".join(words))
    ids = list(range(len(texts)))
    ids[5], ids[20] = None, 3
    got = sorted((tuple(x) for x in op7_simhash(spark, documents(texts, ids, extra=True)).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == brute(list(zip(ids, texts, strict=True)))


def test_empty_table(spark, documents):
    assert op7_simhash(spark, documents(["a"]).limit(0)).collect() == []


def test_compare_finds_every_component():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, (150, 1)).astype(np.uint64)
    a[50:100] = a[:50] ^ np.uint64(5)
    b = a[:70] ^ np.uint64(8)
    for x, y in ((a, None), (a, b)):
        both = x if y is None else np.concatenate([x, y])
        i, j = compare(x, y, 2, 2)
        assert all((bin(int(both[p, 0] ^ both[q, 0])).count("1")) <= 6 for p, q in zip(i, j, strict=True))
        linked = {int(p) for p in i} | {int(q) for q in j}
        want = set()
        for p in range(len(x)):
            for q in range(len(both)):
                if q != p and (y is None or q >= len(x)) and bin(int(both[p, 0] ^ both[q, 0])).count("1") <= 2:
                    want |= {p, q}
        assert linked == want


def test_long_text_counts_do_not_overflow():
    text = " ".join(str(i % 997) for i in range(30_000))
    assert int.from_bytes(fingerprint(text), "big") == brute_print(text)
