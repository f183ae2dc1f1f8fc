import random

import pytest

import corpus_pipeline
from freshet.llm import simhash
from freshet.llm.simhash import drop_near_duplicates, similarity_radius


def jaccard(a, b):
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_duplicates_by_similarity(spark, documents):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts, gone = [], set()
    for _ in range(30):
        base = [word() for _ in range(400)]
        texts.append(" ".join(base))
        for edits, copy in ((3, True), (8, True), (60, False)):
            new = list(base)
            for k in r.sample(range(400), edits):
                new[k] = word()
            similar = jaccard(base, new)
            assert similar > 0.8 if copy else similar < 0.6
            if copy:
                gone.add(len(texts))
            texts.append(" ".join(new))
    texts += [None, "", " ", texts[0]]
    gone.add(len(texts) - 1)
    got = {x.doc_id for x in drop_near_duplicates(spark, documents(texts, extra=True)).collect()}
    assert got == set(range(len(texts))) - gone


def test_links_are_checked_on_the_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "SET_BYTES", 5000, raising=False)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts, gone = [], set()
    for n in (8, 9, 40, 200, 400, 400, 400, 400, 1000, 1000):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        lead = len(texts) - 1
        for low, high in ((0.8, 0.83), (0.8, 0.83), (0.76, 0.8), (0.72, 0.76)):
            # words after the text or before it: as many as bring the similarity into the band
            sizes = [k for k in range(1, n) if low <= (n - 4) / (n - 4 + k) < high]
            if sizes:
                k = r.choice(sizes)
                more = [word() for _ in range(k)]
                new = base + more if r.random() < 0.5 else more + base
                assert low <= jaccard(base, new) < high
                if low >= 0.8:
                    gone.add(len(texts))
                texts.append(" ".join(new))
        assert lead not in gone
    # a phrase said again and again counts once
    base, phrase = [word() for _ in range(300)], [word() for _ in range(6)]
    texts += [" ".join(base + phrase), " ".join(base + phrase * 60)]
    assert jaccard(base + phrase, base + phrase * 60) > 0.9
    gone.add(len(texts) - 1)
    got = {x.doc_id for x in drop_near_duplicates(spark, documents(texts, extra=True)).collect()}
    assert got == set(range(len(texts))) - gone


def test_null_and_repeated_ids(spark, documents):
    t = " ".join(f"word{i}" for i in range(50))
    got = drop_near_duplicates(spark, documents([t, t, t, None, None], [4, 4, None, 1, 1])).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "None"]
    assert drop_near_duplicates(spark, documents(["a"]).limit(0)).collect() == []


def test_radius_grows_with_distance():
    assert similarity_radius(1.0, 1024) == 0 and similarity_radius(0.8, 1024) < similarity_radius(0.7, 1024)


def test_long_texts_stay(spark, documents):
    long = " ".join(f"the w{i % 999_983}" for i in range(500_001))
    got = corpus_pipeline.quality_rules(spark, documents([long, "### " * 40]), "").collect()
    assert [x.doc_id for x in got] == [0]


def test_stop_words_are_asked_of_their_languages_only(spark):
    polish = "Wczoraj wieczorem dzieci bawiły się nad rzeką, gdy nagle zaczął padać deszcz; wszyscy szybko wrócili więc przed zmrokiem razem domu, gdzie czekała ciepła kolacja."
    langs = ["pl", "en", "en-GB", None, "DE_at", " "]
    rows = [(i, polish, lang, "s", len(polish)) for i, lang in enumerate(langs)] + [(9, "### $$$ %%%" * 30, "pl", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.columns == docs.columns and [x.doc_id for x in got.collect()] == [0]


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(3)
    fill = "the of and to in is that it was for".split()
    prose = lambda n: " ".join(r.choice(fill) if r.random() < 0.4 else "".join(r.choices("abcdefghijk", k=6)) for _ in range(n))
    passage = prose(60)
    texts = [prose(120) for _ in range(30)]
    texts += [texts[0], texts[1] + " extra", prose(90) + " " + passage, prose(90) + " " + passage, "### $$$ %%%" * 30, "", None]
    texts += [prose(80) + "\nPlease accept all of our cookies now" for _ in range(7)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}", texts, passage


def test_stages_keep_columns_and_take_effect(spark, corpus):
    path, texts, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, path).collect()
        assert stage(spark, docs, path).columns == docs.columns, name
        kept.append({x.doc_id: x.text for x in rows})
        docs = spark.createDataFrame(rows, docs.schema)
    quality, line, near, suffix = kept
    assert set(quality) == set(range(len(texts))) - {34, 35, 36}
    assert set(line) == set(quality) and sum("cookies" in t for t in line.values()) == 1
    assert set(near) == set(line) - {30, 31}
    assert set(suffix) == set(near) and sum(passage[:101] in t for t in suffix.values()) == 1 and suffix[5] == texts[5]


def test_run_packs_what_is_left(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert {x.doc_id for x in rows} == set(range(30)) | {32, 33} | set(range(37, 44))
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append((x.start, x.length, x.doc_tokens))
    for pieces in by.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_run_with_clashing_names_nulls_and_repeats(spark, tmp_path):
    r = random.Random(12)
    fill = "the of and to in is that it was for".split()
    prose = lambda n: " ".join(r.choice(fill) if r.random() < 0.4 else "".join(r.choices("abcdefghijk", k=6)) for _ in range(n))
    texts = [prose(60) for _ in range(6)]
    rows = [(0, texts[0], "en", "s", 1), (None, texts[1], None, None, None), (1, None, "en", "s", 0), (2, texts[2], "en", "s", 1), (2, texts[2], "en", "s", 1), (3, texts[3], "en", "s", 1), (3, texts[4], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("quality", "words", "block", "row", "fp", "line", "ids", "start", "offset", "kind", "bucket", "component", "first", "n"):
        df = df.withColumn(c, df["source"])
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {x.n for x in out.collect()} <= {"s", None}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted({(x.doc_id, x.doc_tokens) for x in got}, key=str) and sorted(str(x.doc_id) for x in got if x.start == 0) == ["0", "2", "3", "3", "None"]


def test_near_duplicates_of_documents_match_brute_force(spark):
    """Every pair of similarity 0.8 or more on the given documents, by an index of the rarest shingles that such a pair must share."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    often = {}
    for s in sets:
        for h in s:
            often[h] = often.get(h, 0) + 1
    parent, index, pairs = list(range(len(rows))), {}, 0

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda h: (often[h], h))[: len(s) - -(-4 * len(s) // 5) + 1]
        near = {j for h in rare for j in index.get(h, ())}
        for h in rare:
            index.setdefault(h, []).append(i)
        for j in near:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                pairs += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    assert pairs > 50 and {r.doc_id for r in drop_near_duplicates(spark, docs).collect()} == want
