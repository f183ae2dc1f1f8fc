import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from freshet.llm import castore, common
from freshet.llm.castore import Corrupt, crc_join, cuts, merkle, narrow, op3_token_store, open_pack, pack_file, read_recipes, read_store, recipe_file, restore, wide, write_store
from freshet.llm.encode import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    out, start = [], 0
    enc = [(i, np.array(tokenizer(PATH).encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows]
    for i, data in sorted(enc, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((i, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    return out


def texts(n=60):
    r = random.Random(4)
    shared = " ".join(f"word{r.randrange(500)}" for _ in range(900))
    made = [" ".join(f"w{r.randrange(900)}" for _ in range(r.randint(0, 1500))) for _ in range(n)]
    return [None, "", "a"] + made + [made[3] + " " + shared, shared, made[3], made[3], shared + " tail"]


def test_matches_brute_force(spark, documents):
    rows = list(enumerate(texts()))
    r = random.Random(1)
    r.shuffle(rows)
    rows[7] = (None, rows[7][1])
    got = [tuple(x) for x in op3_token_store(spark, documents([t for _, t in rows], [i for i, _ in rows], extra=True)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda x: x[1]) == brute(rows)


def test_store_shares_chunks_and_restores(spark, documents, tmp_path):
    rows = list(enumerate(texts(20)))
    packs, recipes = write_store(spark, documents([t for _, t in rows]), PATH, 2, f"file://{tmp_path}/s")
    stored = [c for f in packs.collect() for c in open_pack(common.get(f.file))]
    assert len({d for d, _ in stored}) == len(stored)
    want = {i: tokenizer(PATH).encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert sum(len(x) for _, x in stored) < 4 * sum(map(len, want.values())) * 0.9
    assert {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in restore(packs, recipes).collect()} == want

    fs, path = common.fs_path(packs.collect()[0].file)
    data = bytearray(common.get(packs.collect()[0].file))
    data[len(data) // 2] ^= 1
    with fs.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="digest differs|pack:"):
        read_store(packs, recipes).collect()


def test_repeated_rows_and_empty_table(spark, documents):
    got = sorted(tuple(x) for x in op3_token_store(spark, documents(["same"] * 4, [5] * 4)).collect())
    assert got == brute([(5, "same")] * 4)
    assert op3_token_store(spark, documents(["a"]).limit(0)).collect() == []


def test_chunks_follow_content():
    r = np.random.default_rng(0)
    base = r.integers(0, 49408, 20_000).astype("<u4")
    assert cuts(base[:0]) == [] and cuts(base[:3]) == [3]
    ends = cuts(base)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(base) and sizes[:-1].min() >= castore.LEAST and sizes.max() <= castore.MOST and 150 < sizes.mean() < 450
    name = lambda ids: {ids[a:b].tobytes() for a, b in zip([0, *cuts(ids)], cuts(ids))}
    moved = np.concatenate([base[:7000], base[:5], base[7000:]])
    assert len(name(base) & name(moved)) > 0.9 * len(name(base))
    assert cuts(np.zeros(5000, "<u4"))[-1] == 5000


def test_crc_of_parts():
    a, b = b"hello", b"world!!!" * 9
    assert crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert crc_join(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_formats_detect_damage():
    assert wide(narrow(np.array([1, 70_000], "<u4"))) == np.array([1, 70_000], "<u4").tobytes()
    chunk = narrow(np.array([1, 65_535], "<u4"))
    d = hashlib.sha256(chunk).digest()
    assert len(chunk) == 5 and list(open_pack(pack_file([(d, chunk)]))) == [(d, np.array([1, 65_535], "<u4").tobytes())]
    data = recipe_file([(None, merkle([d]), [d], [1]), (7, merkle([d, d]), [d, d], [1, 1])])
    assert list(read_recipes(data)) == [(None, 1, [d], [1]), (7, 2, [d, d], [1, 1])]
    wrong = recipe_file([(7, merkle([d]), [d, d], [1, 1])])
    for bad in (data[:-1], data.replace(d[:4], b"zzzz"), wrong):
        with pytest.raises(Corrupt):
            list(read_recipes(bad))
