"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text: no user function, no shuffle, one scan.  A rule is a
row of :data:`RULES`: a name, a measure, a lower and an upper limit.  :func:`compile_rules` turns the table into one
boolean column; a document that misses a limit fails.

Defined results: null or blank text has no words, all counts 0, ``base_failed`` true and ``kept`` false.  Repeated rows
are judged one by one; other columns pass through untouched, and measures never clash with them because the caller
selects what it wants from the struct :func:`measures` makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\u000b\u000c\r"
WINDOW = 8
PUNCTUATION = ".,;:!?\"'()"

#: The most frequent function words of the four languages in the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "como con del el es esta las los no para por se su y "
    "auf das dem den der die ein eine für ich im ist mit nicht sich sie und von zu"
).split()

#: (rule, measure, least, most); None: no limit.  Ratios are per word, or per line with a word.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("enough words", "n_words", 20, None),
    ("few repeated words", "repeat_ratio", None, 0.30),
    ("plausible word length", "mean_word_chars", 2.0, 12.0),
    ("few symbols", "symbol_ratio", None, 0.10),
    ("few exclamations", "exclamation_ratio", None, 0.20),
    ("some stop words", "stop_ratio", 0.08, None),
    ("few repeated lines", "dup_line_ratio", None, 0.60),
]
BASE_RULES = 2


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda over a one-element array binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum_gaps(starts: Column) -> Column:
    """Words covered by windows of :data:`WINDOW` words that begin at the ascending, distinct positions ``starts``."""
    steps = F.transform(
        starts,
        lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found at least twice, the first included."""
    n = F.size(words)

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def covered(w: Column) -> Column:
        def starts(s: Column) -> Column:
            alike = lambda j, k: F.get(s, k)["h"] == F.get(s, j)["h"]
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: F.coalesce(F.when(j > 0, alike(j, j - 1)), F.lit(False))
                | F.coalesce(alike(j, j + 1), F.lit(False)),
            )
            return _bound(F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"])), _sum_gaps)

        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_bound(ordered, starts))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(_bound(hashes, lambda h: _bound(windows(h), covered)))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_measures(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with one struct column of counts and ratios."""
    words, trimmed = spare(docs, "words"), spare(docs, "text")
    docs = docs.withColumn(trimmed, F.coalesce(F.col(text).cast("string"), F.lit("")))
    body = F.btrim(F.col(trimmed), F.lit(WHITE))
    docs = docs.withColumn(
        words, F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{WHITE}]+"))
    )
    t, w = F.col(trimmed), F.col(words)
    n = F.size(w).cast("long")
    lines = _bound(
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
    )
    counts = F.struct(
        n.alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(PUNCTUATION))).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        lines.alias("lines"),
        repeated_words(w).alias("n_repeat_words"),
    )
    docs = docs.withColumn(into, counts)
    q = F.col(into)
    per = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return docs.withColumn(
        into,
        F.struct(
            *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")],
            q["lines"]["dup"].alias("n_dup_lines"),
            per(q["n_repeat_words"], q["n_words"]).alias("repeat_ratio"),
            per(q["word_chars"], q["n_words"]).alias("mean_word_chars"),
            per(q["n_symbols"], q["n_words"]).alias("symbol_ratio"),
            per(q["n_exclamations"], q["n_words"]).alias("exclamation_ratio"),
            per(q["n_stop"], q["n_words"]).alias("stop_ratio"),
            per(q["lines"]["dup"], q["lines"]["n"]).alias("dup_line_ratio"),
            (100 * q["n_repeat_words"] > 30 * q["n_words"]).alias("repeats"),
        ),
    ).drop(words, trimmed)


def compile_rules(rules=tuple(RULES), measures: str = "quality") -> Column:
    """One boolean expression: every limit of the table holds."""
    verdict = F.lit(True)
    for _, name, least, most in rules:
        value = F.col(measures)[name]
        if least is not None:
            verdict = verdict & (value >= least)
        if most is not None:
            verdict = verdict & (value <= most)
    return verdict


def judge(docs: DataFrame, text: str = "text", into: str = "quality", rules=tuple(RULES)) -> DataFrame:
    """``docs`` plus the struct ``into`` with all measures, ``base_failed`` and ``kept``."""
    docs = with_measures(docs, text, into)
    q = F.col(into)
    base = (q["n_words"] < 20) | q["repeats"]
    return docs.withColumn(
        into,
        q.withField("base_failed", base).withField("kept", ~base & compile_rules(rules, into)),
    )


def rows_where(judged: DataFrame, keep: Column, columns: list[str]) -> DataFrame:
    """``columns`` of the rows where ``keep``, an expression over measures, is true.

    Rows are dropped by a generator: a filter would be pushed below the projections, and the measures computed again for each mention of one.
    """
    cols = [F.col(f"`{c}`") for c in columns]
    return judged.select(*cols, F.explode(F.when(keep, F.array(F.lit(True)))).alias(spare(judged, "keep"))).select(*cols)


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs.select("doc_id", "text")).select("doc_id", *[q[c].alias(c) for c in names])


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PUNCT = PUNCTUATION.replace("'", "''")
_LIMITS = " AND ".join(
    f"{name} {op} {limit}" for _, name, least, most in RULES for op, limit in ((">=", least), ("<=", most)) if limit is not None
)

ORACLE_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(trim(x, '{_PUNCT}')) IN ({_STOPS}))) AS n_stop
      FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeat_ratio, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word_chars,
             coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbol_ratio, coalesce(n_exclamations / nullif(n_words, 0)::DOUBLE, 0) AS exclamation_ratio,
             coalesce(n_stop / nullif(n_words, 0)::DOUBLE, 0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_ratio,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_LIMITS} AS kept FROM r
"""
