import hashlib
import random

import numpy as np
import pytest
import xxhash

from freshet.llm import common, suffix
from freshet.llm.suffix import drop_repeats, op8_suffix_array, refine, stretches

N = 100


def brute_masks(rows):
    """Mask of removed bytes of each row, by a table of all windows."""
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, xxhash.xxh32_intdigest(data[k]) >> 1, k))
    seen, masks = set(), {}
    for k in order:
        mask = np.zeros(len(data[k]), bool)
        for i in range(len(data[k]) - N + 1):
            w = data[k][i : i + N]
            if w in seen:
                mask[i : i + N] = True
            seen.add(w)
        masks[k] = mask
    return data, masks


def brute(rows):
    data, masks = brute_masks(rows)
    out = []
    for k, (i, _) in enumerate(rows):
        m = masks[k]
        runs = sum(1 for p in range(len(m)) if m[p] and (p == 0 or not m[p - 1]))
        kept = bytes(b for b, gone in zip(data[k], m, strict=True) if not gone)
        out.append((i, len(data[k]), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(n=60):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 6)))
    passages = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(5)]
    texts = [None, "", "short", "a" * 99, "a" * 100, "b" * 350, "ab" * 300, "ab" * 301]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))), r.choice(passages), " ".join(word() for _ in range(r.randint(0, 30)))]
        if r.random() < 0.3:
            parts.append(r.choice(passages)[r.randint(0, 40) :])
        texts.append(" ".join(parts))
    copies = [r.choice(texts[8:]) for _ in range(10)]
    near = []
    for t in (r.choice(texts[8:]) for _ in range(15)):
        k = r.randrange(len(t))
        near.append(t[:k] + "#" + t[k + 1 :])
    texts += copies + near
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_matches_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(common, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(common.sliced, "__defaults__", (6000,))
    monkeypatch.setattr(suffix, "_PART", 500)
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    ids[3], ids[9] = None, ids[10]
    rows = list(zip(ids, texts, strict=True))
    got = [tuple(x) for x in op8_suffix_array(spark, documents(texts, ids, extra=True)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_repeated_rows_and_empty_table(spark, documents):
    t = " ".join(f"word{i}" for i in range(60))
    got = sorted(x.n_removed for x in op8_suffix_array(spark, documents([t] * 4, [7] * 4)).collect())
    assert got == [0, len(t), len(t), len(t)]
    assert op8_suffix_array(spark, documents(["a"]).limit(0)).collect() == []


def test_drop_repeats_keeps_the_other_text(spark, documents):
    r = random.Random(0)
    p = " ".join("".join(r.choices("abcdef", k=5)) for _ in range(50))
    texts = ["first " + p + " end", "other é" + p + "é tail", p, None, "plain", ""]
    got = {x.doc_id: x for x in drop_repeats(spark, documents(texts, extra=True)).collect()}
    assert set(got) == {0, 1, 3, 4, 5} and len(got[1]) == 21
    assert got[0].text == texts[0] and got[1].text == "other éé tail" and got[1].n_chars == len(got[1].text)
    assert got[3].text is None and got[5].text == ""


def test_refinement_gives_equal_depths():
    r = np.random.default_rng(2)
    data = np.concatenate([r.integers(97, 99, 300), np.full(120, 97), r.integers(97, 99, 300)]).astype(np.uint8)
    data = np.concatenate([data, data[100:500], data[:50]])
    starts = np.arange(len(data) - N + 1)
    for depth in (8, 9, 30, 64, N):
        ids = refine(data, starts, depth)
        by = {}
        for i in starts.tolist():
            by.setdefault(data[i : i + depth].tobytes(), set()).add(int(ids[i]))
        assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)


def test_stretches_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix, "_PART", 130)
    r = np.random.default_rng(1)
    data = r.integers(97, 101, 1000).astype(np.uint8)
    ends = np.array([0, 40, 400, 499, 600, 700, 1000])
    _, first, last = stretches(data, ends)
    got = sorted(s for f, x in zip(first.tolist(), last.tolist()) for s in range(f, x + 1))
    want = [s for a, b in zip([0, *ends], ends) for s in range(a, b - N + 1)]
    assert got == want
