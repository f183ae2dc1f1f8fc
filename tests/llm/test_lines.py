import hashlib
import random

import pytest

from freshet.llm import common, lines
from freshet.llm.lines import drop_recurring, line_dedup, op4_line_dedup, templates


def brute(rows, min_docs):
    """The same definition, over plain lists: (id, lines, dropped, hash of the rest)."""
    docs = [[x for x in (t or "").split("\n")] if t else [] for _, t in rows]

    def mask(line):
        return ["<*>" if any(c.isdigit() and c.isascii() for c in w) else w for w in line.split()]

    def ok(m):
        return len(m) >= lines.MIN_TOKENS and 2 * m.count("<*>") <= len(m)

    count, where = {}, {}
    for k, d in enumerate(docs):
        for m in {" ".join(mask(x)) for x in d if ok(mask(x))}:
            count[m] = count.get(m, 0) + 1
            where.setdefault(m, set()).add(k)
    per_leaf = {}
    for m in count:
        w = m.split(" ")
        per_leaf.setdefault((len(w), *w[: lines.DEPTH]), []).append(m)
    drop = {}
    for leaf in per_leaf.values():
        found = []
        for m in sorted(leaf, key=lambda m: (-count[m], m.encode())):
            w = m.split(" ")
            scores = [sum(a == b != "<*>" for a, b in zip(w[lines.DEPTH :], t[lines.DEPTH :])) for t, _ in found]
            if scores and max(scores) > lines.ALIKE * (len(w) - lines.DEPTH):
                t, members = found[scores.index(max(scores))]
                for i, x in enumerate(w):
                    if t[i] != x:
                        t[i] = "<*>"
                members.append(m)
            else:
                found.append((list(w), [m]))
        for _, members in found:
            at = set().union(*(where[m] for m in members))
            if len(at) >= min_docs:
                first = min(at, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
                for k in at - {first}:
                    drop.setdefault(k, set()).update(members)
    out = []
    for k, (i, _) in enumerate(rows):
        stay = [x for x in docs[k] if " ".join(mask(x)) not in drop.get(k, ())]
        out.append((i, len(docs[k]), len(docs[k]) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(n=80):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcde", k=3))
    made = [None, "", "\n \n", "One two.", "12 13 14 15"]
    for i in range(n):
        body = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 5))]
        if r.random() < 0.5:
            body.append(f"user u{i} logged in from {word()} at 12:{i}")
        if r.random() < 0.3:
            body += ["All rights reserved by éditions nobody"] * 2
        if r.random() < 0.2:
            body.append("12 13 14 15")
        if r.random() < 0.2:
            body.append("See the terms of use")
        r.shuffle(body)
        made.append("\n".join(body))
    return made


@pytest.mark.parametrize(("min_docs", "crowd"), [(2, 20_000), (5, 20_000), (2, 0), (5, 6)])
def test_matches_brute_force(spark, documents, monkeypatch, min_docs, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(common.sliced, "__defaults__", (3000,))
    texts = corpus()
    r = random.Random(8)  # leaves of many lines, some alike
    texts += ["\n".join("a b c " + " ".join(r.choice("uvwxyz") for _ in range(r.choice([3, 5]))) for _ in range(4)) for _ in range(40)]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids[6] = None
    got = [tuple(x) for x in line_dedup(spark, documents(texts, ids, extra=True), min_docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    want = brute(list(zip(ids, texts, strict=True)), min_docs)
    assert sorted(got, key=repr) == want and sum(x[2] for x in want) > 30


def test_crowded_leaves_are_parted(spark, documents, monkeypatch):
    monkeypatch.setattr(lines, "LEAF", 4)
    shared = "a b c d e f the same line everywhere now"
    texts = [f"a b c d e f {chr(97 + i)} {chr(98 + i)} x y z w u\n{shared}\na b c {chr(97 + i)} q r s t" for i in range(20)]
    got = {x.doc_id: x.n_dropped for x in line_dedup(spark, documents(texts)).collect()}
    assert got[0] == 0 and all(got[i] >= 1 for i in range(1, 20))


def test_repeated_rows_and_empty_table(spark, documents):
    t = "this very line is here\nand this one too ok"
    got = sorted(x.n_dropped for x in line_dedup(spark, documents([t] * 6, [3] * 6)).collect())
    assert got == [0, 2, 2, 2, 2, 2]
    assert line_dedup(spark, documents(["a"]).limit(0)).collect() == []


def test_drop_recurring_keeps_first_and_other_lines(spark, documents):
    texts = [f"{chr(97 + i) * 4} stands {chr(98 + i) * 3} in {chr(99 + i) * 5}\nPlease accept all our cookies" for i in range(8)] + ["Please accept all our cookies", None, ""]
    got = {x.doc_id: x for x in drop_recurring(spark, documents(texts, extra=True)).collect()}
    assert set(got) == {*range(8), 9, 10}
    assert got[0].text == texts[0] and got[3].text == texts[3].split("\n")[0] and got[3].n_chars == len(got[3].text) and got[9].text is None


def test_templates_generalise():
    got = templates([(b"get file alpha now ok", 3), (b"get file beta now ok", 2), (b"get file gamma now ok", 1), (b"get file x y z", 9)])
    assert got[0] == got[1] == got[2] != got[3]


def test_leading_tokens_are_no_agreement(spark, documents):
    clean = ["very good idea", "red garden house", "matter for experts", "long way home", "question nobody asked", "town by night"]
    short = ["Ansh.", "Onenly.", "Ster.", "Anea.", "Tion.", "Edst."]
    texts = [f"This is a {x}\nWas erlytion that. {y}\nPosted in news by {y} and friends" for x, y in zip(clean, short, strict=True)]
    got = sorted((x.doc_id, x.n_dropped) for x in line_dedup(spark, documents(texts)).collect())
    assert got == [(0, 0)] + [(i, 1) for i in range(1, 6)]
    assert len(set(templates([(b"a b c x <*> <*>", 2), (b"a b c y <*> <*>", 1)]))) == 2


def test_result_is_independent_of_leaf_size(spark, documents, monkeypatch):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = [f"Posted in news by {name(i)} and friends\nThe end of {name(7 * i)} {name(11 * i)} {name(13 * i)} {name(17 * i)}" for i in range(1, 2200)]
    got = sorted((x.doc_id, x.n_dropped) for x in line_dedup(spark, documents(texts)).collect())
    assert got == [(i, min(i, 1)) for i in range(len(texts))]
    r = random.Random(2)
    made = {b"a b c " + b" ".join(r.choice([b"x", b"y", b"z", b"u", b"v", b"w", b"<*>"]) for _ in range(7)) for _ in range(1500)}
    given = [(x, r.randint(1, 4)) for x in sorted(made)]
    whole = templates(given)
    for size in (0, 3, 40):
        monkeypatch.setattr(lines, "LEAF", size)
        assert templates(given) == whole
    assert 10 < len(set(whole)) < len(given)


def test_short_and_numeric_lines_recur_by_their_words(spark, documents):
    again = ["All rights reserved.", "Tel. 0123 456 789", "12 13 14 15", "\u7248\u6743\u6240\u6709\u4e0d\u5f97\u8f6c\u8f7d"]
    own = lambda i: [f"Tel. 0123 456 7{i}", f"Only {chr(97 + i) * 5}.", "", " "]
    texts = ["\n".join(own(i) + again) for i in range(6)] + ["Read more\nAll  rights reserved."] + ["Read more"] * 3
    got = sorted((x.doc_id, x.n_lines, x.n_dropped) for x in op4_line_dedup(spark, documents(texts)).collect())
    assert got == [(0, 8, 0)] + [(i, 8, 4) for i in range(1, 6)] + [(6, 2, 1)] + [(i, 1, 0) for i in range(7, 10)]
    kept = {x.doc_id: x.text for x in drop_recurring(spark, documents(texts)).collect()}
    assert kept[0] == texts[0] and kept[3] == "\n".join(own(3)) and kept[6] == "Read more"
