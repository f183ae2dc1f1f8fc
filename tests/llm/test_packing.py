import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from freshet.llm import packing
from freshet.llm.encode import tokenizer
from freshet.llm.packing import Packer, op5_packing, powers


def check(rows, docs, size=1024):
    """Every id of every document in exactly one piece; windows gapless; returns the padding."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = sorted((str(i), np.array(tokenizer(path).encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in docs)
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for doc, data in ids:
        mine = pieces[doc, len(data) // 4]
        for start, length, crc in list(mine):
            if zlib.crc32(data[4 * start : 4 * (start + length)]) != crc:
                continue
        spans = sorted(mine)
        assert sum(n for _, n, _ in spans) == len(data) // 4 * sum(1 for x in ids if x[0] == doc and len(x[1]) == len(data))
        if sum(1 for x in ids if x[0] == doc) == 1:
            at = 0
            for start, length, crc in spans:
                assert start == at and length > 0 and zlib.crc32(data[4 * start : 4 * (start + length)]) == crc
                at += length
    padding = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding


def test_packs_everything(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 8)
    r = random.Random(2)
    texts = [None, "", "x", "y " * 5000] + [" ".join(r.choices(["alpha", "beta", "12"], k=r.randint(1, 900))) for _ in range(120)]
    ids = list(range(len(texts)))
    ids[2] = None
    docs = list(zip(ids, texts, strict=True))
    table = documents(texts, ids, extra=True)
    assert check(op5_packing(spark, table).collect(), docs) == 0
    assert check(packing.pack(spark, table, public_tokenizers.path("byte_bpe_50k.json"), most=2).collect(), docs) == 0


def test_repeated_rows_and_empty_table(spark, documents):
    docs = [(1, "same text")] * 5
    got = op5_packing(spark, documents([t for _, t in docs], [i for i, _ in docs])).collect()
    assert check(got, docs) == 0 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert op5_packing(spark, documents(["a"]).limit(0)).collect() == []


@pytest.mark.parametrize("fill", [True, False])
def test_bounded_space_and_best_fit(fill):
    out = []
    p = Packer(10, 2, out.append, fill)
    for k, n in enumerate([7, 5, 3, 6, 9, 25, 4]):
        p.add((k, 0, n, bytes(4 * n)))
        assert len(p.windows) <= 2
    assert [(d, len(i) // 4) for d, _, _, i in out[0]] == [(0, 7), (2, 3)]
    total = sum(len(x[3]) // 4 for w in [*out, *p.rest()] for x in w)
    assert total == 59
    if fill:
        assert all(sum(len(x[3]) // 4 for x in w) == 10 for w in out)


def test_powers():
    w = [(0, 0, 700, bytes(4 * 700)), (1, 0, 400, bytes(1600))]
    got = [sum(len(p[3]) // 4 for p in x) for x in powers(w, 1024)]
    assert got == [1024, 64, 8, 4]
