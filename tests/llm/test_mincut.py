import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from freshet.llm.mincut import MARKS, PRIOR, blocks, connect, cut, examples, extract, fit, fit_to, label, op9_html_mincut, scores

FILL = "the of and to in is that it was for on with as by at from".split()


def prose(r, n=30):
    return " ".join(r.choice(FILL) if r.random() < 0.4 else "".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(n)).capitalize() + "."


def energy(scores, edges, labels):
    e = sum((0 if keep else s) if s > 0 else (-s if keep else 0) for s, keep in zip(scores, labels))
    return e + sum(w for i, x in enumerate(edges) for j, w in x.items() if i < j and labels[i] != labels[j])


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 8)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if r.random() < 0.6:
                edges[i][j] = edges[j][i] = r.uniform(0, 2)
        best = min(energy(scores, edges, x) for x in itertools.product([True, False], repeat=n))
        assert energy(scores, edges, cut(scores, edges)) == pytest.approx(best)


def page(r):
    paras = [prose(r, r.randint(3, 60)) for _ in range(r.randint(2, 8))]
    body = "".join(f"<p>{p.replace('and', '<b>and</b>')}</p>" if r.random() < 0.7 else f"<p>{p}<br>" for p in paras)
    side = f"<aside><h3>Related</h3><ul><li><a href=/a>{prose(r, 5)}</a></li></ul></aside>"
    junk = [
        f"<nav><ul><li><a href='/x'>{prose(r, 2)}</a><li><a href='/y'>Home</a></ul></nav>",
        f"<header class='site-header'><a href=/>{prose(r, 3)}</a><p>{prose(r, 6)}</p></header>",
        f"<div class=\"ad-banner\">{prose(r, 12)}</div>",
        f"<div id=cookieNotice><p>{prose(r, 14)}</p><button>OK</button></div>",
        f"<form><label>{prose(r, 3)}</label><input name=q><select><option>{prose(r, 2)}</option></select></form>",
        side,
    ]
    after = [f"<section id='comments'><h2>2 comments</h2><article class='comment'><p>{prose(r, 25)}</p></article></section>", f"<footer>&copy; {prose(r, 6)}</footer>", f"<div class='newsletter-signup'><p>{prose(r, 9)}</p></div>"]
    r.shuffle(junk)
    title = prose(r, 4)
    main = r.choice(["<article><h1>%s</h1>%s</article>", "<main><h1>%s</h1><div class=entry-content>%s</div></main>", "<div class='post-body'><h1>%s</h1>%s</div>"]) % (title, body)
    start = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body>"
    return start + "".join(junk[: r.randint(0, 6)]) + "<!-- <p>no</p> -->" + main + "".join(r.sample(after, r.randint(0, 3))) + r.choice(["</body></html>", ""]), [title, *paras]


def test_pages_give_their_article():
    r = random.Random(4)
    for _ in range(200):
        html, want = page(r)
        assert extract(html) == "\n\n".join(want)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("  ", ""),
        ("<html><body></body></html>", ""),
        ("<article><p>Fish &amp; chips&nbsp;are &#233;t&eacute; &lt;b&gt;  here\n\tnow.</p></article>", "Fish & chips are été <b> here now."),
        ("<article><p>One is here.<p>Two is 3 < 4 there.</article>", "One is here.\n\nTwo is 3 < 4 there."),
        ("<article><p><b>First part.<br><p>Second part.</b></p>Third part is loose.</article>", "First part.\n\nSecond part.\n\nThird part is loose."),
        ("<article><ul><li>One thing is this.<li>Another thing is that.</ul></article>", "One thing is this.\n\nAnother thing is that."),
        ("<article><p>Text stays.</p><script>if (a < b) { x('<p>no</p>') }", "Text stays."),
        ("<article><p>Wörd­text 日本 stays.</p></article><nav>Menu", "Wörd­text 日本 stays."),
    ],
)
def test_markup(html, want):
    assert extract(html) == want


def test_deep_and_long_pages():
    assert extract("<div>" * 5000 + "<article><p>Deep text is found here.</p></article>") == "Deep text is found here."
    text = "A long paragraph of words. " * 20_000
    assert extract(f"<article><p>{text}</p></article>") == text.strip()
    assert len(blocks("<p>x" * 3000)) == 3000 and isinstance(extract("<p>x y z" * 3000), str)


def test_operator(spark):
    rows = [(1, "u", "<article><p>Some text is here.</p></article>"), (1, "u", "<article><p>Some text is here.</p></article>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", op9_html_mincut.__globals__["F"].lit(1))
    got = sorted((tuple(x) for x in op9_html_mincut(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "Some text is here.", 18)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert op9_html_mincut(pages.limit(0)).collect() == []


@pytest.mark.parametrize("tag", ["math", "object", "noscript"])
def test_formulas_and_fallback_text_stay(tag):
    assert extract(f"<article><p>We know that <{tag}><i>x equals y</i></{tag}> holds here.</p></article>") == "We know that x equals y holds here."


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        ("<body><article><div class='widget-post'><p>This is the prose of the post, long enough to be read by all.</p></div></article>", "prose of the post", "~"),
        ("<article><p>First prose of the page is here for all.</p><p class='related'>This one is related to the story and goes on for long enough.</p></article>", "related to the story", "~"),
        ("<body><div class='content-ad-free'><h1>Title</h1><p>This is the prose of the page, and it is long enough.</p><p>Short.</p></div>", "Short.", "~"),
        ("<body><div class='story search-results-study'><h1>Title</h1><p>This is the prose of the study, and it is long enough.</p></div>", "Title", "~"),
        ("<body><div><p>We use cookies to make the page better, as you know.</p></div><article><h1>Title</h1><p>This is the prose, and it is long enough to be the main text of this page.</p></article>", "Title", "cookies"),
        ("<body><article><p>This is the prose of the page, long enough to be read by all.</p></article><section class='post-comments'><article><p>I think that this is the best page that I have ever read in my life.</p></article></section>", "prose", "think"),
    ],
)
def test_names_are_weighed(html, kept, gone):
    assert kept in extract(html) and gone not in extract(html)


def test_cut_changes_what_the_classifier_says():
    page = (
        "<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Head line</h1><p>This is the prose of the page and it is long enough to be the main text.</p>"
        "<p>No</p><p>And some more prose that goes on with the text of the page, as it should.</p><p><a href=x>a link</a></p>"
        "<p>And yet more prose that ends the text of the page, as it should.</p></div><div><a href=3>Privacy</a></div>"
    )
    found, costs, labels = label(page)
    assert [b.text for b, c, keep in zip(found, costs, labels) if keep and c < 0] == ["Head line", "No", "a link"]
    assert [b.text for b, keep in zip(found, labels) if not keep] == ["Home News", "Privacy"]


def test_query_has_the_least_energy(spark):
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choices("abcdef", k=4)) for _ in range(n))
    pages, kinds = [], ["<p>{}.</p>", "<p>{}</p>", "<div><a href=x>{}</a></div>", "<li>{}", "<h2>{}</h2>", "<div class='related'>{}</div>", "<article><p>{}.</p></article>", "<footer>{}</footer>", "<div class=post>{}</div>"]
    for _ in range(60):
        pages.append("<body>" + "".join(r.choice(kinds).format(words(r.choice([1, 1, 2, 4, 12]))) for _ in range(r.randint(1, 9))))
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").coalesce(1)
    got = {x.page_id: x.text for x in op9_html_mincut(table).collect()}
    weights = fit([x for p in pages for x in examples(p)])
    assert weights != PRIOR
    changed = 0
    for i, p in enumerate(pages):
        found = blocks(p)
        connect(found)
        costs, edges = scores(found, weights), [b.edges for b in found]
        best = min(itertools.product([True, False], repeat=len(found)), key=lambda x: round(energy(costs, edges, x), 9))
        mine = [b.text in got[i].split("\n\n") for b in found]
        assert energy(costs, edges, mine) == pytest.approx(energy(costs, edges, best))
        changed += any((c >= 0) != keep for c, keep in zip(costs, mine))
    assert changed > 5


@pytest.mark.parametrize(
    "html",
    ["<a " * 20000, '<p class="x' + "<a " * 20000, '<a ">" ' * 10000, "<option>" * 8000, "<b>" * 10000 + "</i>" * 10000, "<i>" + "<div>" * 6000 + "</i>" * 7500, "<b>" * 5000 + "x<hr>" * 9000, "<p>x y z" * 8000, "<p>a b c d e f g h i.<p>x" * 5000],
)
def test_broken_markup_takes_time_in_proportion(html):
    began = time.process_time()
    extract(html)
    assert time.process_time() - began < 1.5


P1 = "The river rose in the night and the gauge at the old bridge showed more than it had in the ten years before, so the keepers went down to look at it."
P2 = "Nobody had slept much when the water came over the road by the mill, and those who lived close to it carried what they could up to the church."


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        (f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{P1}</div><div>{P2}</div>", [P1, P2], ["Home"]),
        (f"<body><article><h1>Flood</h1><p>{P2}</p><p class='reply-letter'>{P1}</p></article>", ["Flood", P1, P2], []),
        (f"<body><article class='cookie-recipe'><h1>Oat biscuits</h1><p>{P1}</p><p>{P2}</p></article>", ["Oat biscuits", P1, P2], []),
        (f"<body><div id='comments-on-dante'><p>{P1}</p><p>{P2}</p></div>", [P1, P2], []),
        (
            f"<body><article><p>{P1}</p><table><tr><th>Gauge<th>Level<tr><td>North<td>3.2</table><p>{P2}</p><ul><li>rain<li>snow and ice</ul><p>{P1}</p></article>",
            ["Gauge", "Level", "North", "3.2", "rain", "snow and ice", P2], [],
        ),
        (f"<body><div>We use cookies to make this page better. By going on you accept that.</div><div><h1>Flood</h1><p>{P1}</p><p>{P2}</p></div>", ["Flood", P1, P2], ["cookies"]),
        (f"<body><p>Please accept our cookies and the privacy terms.</p><p>{P1}</p><p>{P2}</p>", [P1, P2], ["cookies"]),
        (f"<body><article><p>{P1}</p><div class='comment-list'><p>{P2}</p></div></article>", [P1], [P2]),
    ],
)
def test_texts_outweigh_doubtful_marks(html, kept, gone):
    found = extract(html).split("\n\n")
    assert all(x in found for x in kept) and not any(y in x for x in found for y in gone)


def stripped(html, links):
    """A page without what marks its article: all elements but the roots and formatting become plain divs, attributes go; links stay or become divs, too."""
    html = re.sub(r"<(script|style|title)\b.*?</\1>", "", html, flags=re.S | re.I)
    stay = ("html", "head", "body", "meta", "b", "i", "br", *(["a"] if links else []))
    return re.sub(r"<(/?)(\w+)\b[^>]*>", lambda m: f"<{m[1]}{m[2] if m[2].lower() in stay else 'div'}>", html)


@pytest.mark.parametrize("links", [True, False])
def test_pages_without_marks_keep_their_articles(spark, links):
    """Ablation on the given pages: with no mark left, classifier and cut tell the article's blocks by their texts and neighbours."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()]
    weights = fit_to(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    kept = total = more = changed = 0
    for _, html in pages:
        article = extract(html, weights).split("\n\n")
        found, costs, labels = label(stripped(html, links), weights)
        texts = [b.text for b, keep in zip(found, labels, strict=True) if keep]
        total += len(article)
        kept += sum(x in texts for x in article)
        more += len(set(texts) - set(article))
        changed += sum((c >= 0) != keep for c, keep in zip(costs, labels, strict=True))
    assert kept >= 0.97 * total and more <= 1.2 * len(pages) and changed > 20


def test_classifier_decides(spark):
    """Without weights the labels of marked pages are others; the weights of texts decide those of pages without marks."""
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").limit(40).collect()]
    share = lambda a, b, made: sum(x != y for p in pages for x, y in zip(label(made(p), a)[2], label(made(p), b)[2], strict=True)) / sum(len(blocks(made(p))) for p in pages)
    assert share(PRIOR, (0.0,) * len(PRIOR), lambda p: p) > 0.2
    no_text = (*(0.0,) * MARKS, *PRIOR[MARKS:])
    assert share(PRIOR, no_text, lambda p: stripped(p, True)) > 0.2


def test_order_of_pages_does_not_change_the_fit(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert fit_to(pages) == fit_to(pages.orderBy(F.desc("page_id")).repartition(7)) != PRIOR
