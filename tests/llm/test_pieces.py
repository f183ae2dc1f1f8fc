import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from freshet.llm import encode as encode_module
from freshet.llm.pieces import BPE, UNIGRAM, Pieces, Unsupported, decode, encode, merges, op6_sentencepiece, parity, parse, pieces, rebuild, threads

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
CHARS = list("aábcdeghinorst .,\n\t0123") + ["▁", " the", " and", "ing", "é", "  ", "   ", "🙂", "中", "́", " ", "<s>", "</s>", "<unk>", "\0", "\x01", "<0x41>", "​"]


def texts(n=3000):
    r = random.Random(9)
    return [None, "", " ", "   ", "a", " a ", "Hello world", "▁", "\n"] + ["".join(r.choices(CHARS, k=r.randint(1, 80))) for _ in range(n)]


def test_parity_with_the_library():
    found = texts()
    assert [found[i] for i in parity(PATH, found)] == []


def test_the_rebuilt_tokenizer_takes_raw_texts():
    lib, found = rebuild(parse(open(PATH, "rb").read())), [t for t in texts(800) if t is not None]
    assert [e.ids for e in lib.encode_batch(found, add_special_tokens=False)] == SP.encode(found)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(encode_module, "UNITS", 50)
    own = Pieces(PATH)
    found = texts(300)
    for i in range(0, len(found), 20):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(found[i : i + 20])] == SP.encode([t or "" for t in found[i : i + 20]])
        assert len(own.cache) + len(own.young) <= 50


def test_a_wrong_text_is_found():
    own = Pieces(PATH)
    good = ["good bad", "a bad", "the same words", None]
    ids = own.encode(good)
    assert own.verified(good, ids, SP) == ([True] * 4, [True] * 4)
    # right words in a wrong order, another cut of the same text, a word too many
    other = np.array([SP.piece_to_id(p) for p in ["▁", "a", "▁", "bad"]], "<u4").tobytes()
    wrong = [own.encode(["bad good"])[0], other, ids[2] + ids[1], ids[0]]
    assert own.verified(good, wrong, SP) == ([False] * 4, [False, True, False, False])


def test_decoding_is_the_libraries():
    own, r = Pieces(PATH), random.Random(4)
    lists = [[r.randrange(SP.get_piece_size()) for _ in range(r.randint(0, 12))] for _ in range(500)] + [[r.randrange(3, 259) for _ in range(6)] for _ in range(300)]
    got = own.decode([np.array(x, "<u4").tobytes() for x in lists])
    assert got == [own.lib.decode([i for i in x if i not in own.control], skip_special_tokens=False) for x in lists]


def test_threads_are_on_inside_whatever_was_set(monkeypatch):
    for value in ("false", None):
        monkeypatch.setenv("TOKENIZERS_PARALLELISM", value) if value else monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
        with threads():
            assert os.environ["TOKENIZERS_PARALLELISM"] == "true"
        assert os.environ.get("TOKENIZERS_PARALLELISM") == value


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def block(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def small_model(kind, fallback=True, squeeze=True):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    rows += [(p, -((i + 2) ** 0.5), 1) for i, p in enumerate(["▁a", "ab", "▁ab", "▁", "a", "b", "c", "bc", "▁abc", "cab", "é"])]
    data = b"".join(block(1, block(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in rows)
    trainer = b"\x18" + varint(kind) + varint(35 << 3) + varint(int(fallback))
    norm = block(1, b"identity") + b"\x18\x01" + b"\x20" + varint(int(squeeze)) + b"\x28\x01"
    return data + block(2, trainer) + block(3, norm)


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
@pytest.mark.parametrize("squeeze", [True, False])
def test_small_models(tmp_path, kind, squeeze):
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(small_model(kind, squeeze=squeeze))
    r = random.Random(2)
    found = ["", "abc", "  a  b ", "dé"] + ["".join(r.choices("abc é🙂", k=r.randint(1, 20))) for _ in range(400)]
    assert [found[i] for i in parity(path, found)] == []
    ids = Pieces(path).encode(found)
    own = rebuild(parse(open(path, "rb").read()))
    assert [e.ids for e in own.encode_batch(found, add_special_tokens=False)] == [np.frombuffer(x, "<u4").tolist() for x in ids]
    assert all(map(all, Pieces(path).verified(found, ids, sentencepiece.SentencePieceProcessor(model_file=path))))


def test_parse():
    m = parse(open(PATH, "rb").read())
    assert len(m.pieces) == SP.get_piece_size() and m.kind == BPE and m.byte_fallback and m.unk == SP.unk_id()
    assert [p for p, _, _ in m.pieces] == [SP.id_to_piece(i) for i in range(len(m.pieces))]
    assert merges([("ab", -1.0, 1), ("a", -2.0, 1), ("b", -3.0, 1), ("abb", -0.5, 1)]) == [("ab", "b"), ("a", "b")]
    with pytest.raises(Unsupported):
        parse(small_model(3))


def test_operators(spark, documents):
    found = texts(200) + ["word " * 20_000]
    got = {x.doc_id: x for x in op6_sentencepiece(documents(found, extra=True)).collect()}
    for i, t in enumerate(found):
        ids = SP.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].parity and got[i].round_trip
    back = decode(encode(documents(found, extra=True), PATH, into="token_ids"), PATH, "token_ids", "back").collect()
    assert {x.doc_id: x.back for x in back} == {i: SP.decode(SP.encode(t or "")) for i, t in enumerate(found)}
    assert op6_sentencepiece(documents(["a"]).limit(0)).collect() == []
    assert pieces(PATH).decode([b""]) == [""]
