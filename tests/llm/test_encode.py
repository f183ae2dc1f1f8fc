import random

import numpy as np
import public_tokenizers
import pytest

from freshet.llm.encode import encode_all, tokenizer

ALPHABET = list("aAbÀéßĄ'’1٣!,.$ \n\t") + ["'s", "́", " ́", " ", " ", "\x1c", "\x0b", "\r\n", "​", "᠎", "　", "中", "🙂", "<|endoftext|>", "İ", "Σ", " ", "﻿", "é", "‍"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    r = random.Random(7)
    texts = [None, "", " ", "\n", "a", " a ", "The cat  sat\n\n on the mat.  "]
    texts += ["".join(r.choices(ALPHABET, k=r.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(r.choices(list("aéb's1!. \n\t"), k=r.randint(1, 200))) for _ in range(2000)]
    want = [tokenizer(path).encode(t or "", add_special_tokens=False).ids + [9] for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode_all(texts, path, 9, chars=500)]
    for t, w, g in zip(texts, want, got, strict=True):
        assert w == g, repr(t)


def test_cache_stays_within_its_bound(monkeypatch):
    from freshet.llm import encode

    monkeypatch.setattr(encode, "UNITS", 300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = encode.UnitEncoder(path)
    r = random.Random(1)
    for _ in range(40):
        texts = [" ".join("".join(r.choices("abcdef", k=r.randint(1, 12))) for _ in range(30)) for _ in range(4)]
        want = [tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        assert len(own.cache) < 600
