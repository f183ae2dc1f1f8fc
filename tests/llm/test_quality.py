import random
from collections import Counter

import pytest

from freshet.llm import quality
from freshet.llm.quality import judge, op10_quality_rules

WS = " \t\n\x0b\x0c\r"


def words(text):
    out, w = [], ""
    for c in text + " ":
        if c in WS:
            if w:
                out.append(w)
            w = ""
        else:
            w += c
    return out


def brute(text):
    t = text or ""
    ws = words(t)
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(grams)
    repeated = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    chars = sum(map(len, ws))
    symbols = sum(c in "#*$%&|<>" for c in t)
    base = len(ws) < 20 or 100 * len(repeated) > 30 * len(ws)
    k = max(1, len(ws))
    stops = sum(w.strip(quality.PUNCTUATION).lower() in quality.STOP_WORDS for w in ws)
    kept = not base and 2 <= chars / k <= 12 and symbols / k <= 0.1 and t.count("!") / k <= 0.2 and stops / k >= 0.08 and dup / max(1, len(lines)) <= 0.6
    return (len(ws), chars, symbols, dup, len(repeated), base, kept)


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t\x0b", "one", "a b c d e f g", "a b c d e f g h", "x " * 500, "the " * 40, "\n".join(["same line here of it"] * 30), "é" * 5000, " word", "a b  c"]
    for _ in range(150):
        vocabulary = ["the", "of", "And,", "in.", "alpha", "beta", "###", "a|b", "no!!", "Übung", "\n", "\n\n", " ", "\t", "<b>", "it's"]
        out.append(" ".join(r.choices(vocabulary, k=r.randint(1, 120))))
    base = " ".join(f"the w{i} of" for i in range(60))
    out += [base, base + " " + base, base + " " + " ".join(base.split()[10:19]), " ".join(base.split()[:8]) + " " + " ".join(base.split()[:9]), "word " * 60_000]
    return out


def test_matches_brute_force(documents):
    found = texts()
    got = {r.doc_id: r for r in op10_quality_rules(documents(found, extra=True)).collect()}
    for i, t in enumerate(found):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(t), repr((t or "")[:100])


def test_rows_and_columns_stay(documents):
    docs = documents(["a b", "a b", None], [1, 1, None], extra=True)
    got = judge(docs, into="verdict")
    assert got.columns == [*docs.columns, "verdict"] and got.count() == 3
    assert op10_quality_rules(docs.limit(0)).collect() == []


def test_runs_without_user_functions(documents):
    plan = op10_quality_rules(documents(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange hash", "Pandas"))


@pytest.mark.parametrize(("rules", "kept"), [([("few", "n_words", None, 3)], False), ([("many", "n_words", 30, None)], True)])
def test_table_compiles(documents, rules, kept):
    t = " ".join(f"w{i}" for i in range(40))
    assert judge(documents([t]), rules=rules).first().quality.kept is kept


def test_very_long_text_is_judged_by_its_ratios(documents):
    """Over a million words, no window of which comes twice."""
    long = " ".join(f"the w{i} of" for i in range(350_000))
    r = op10_quality_rules(documents([long])).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (1_050_000, 0, False, True)
