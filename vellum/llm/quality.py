"""Quality rules as weak supervision, in DataFrame expressions alone.

Each rule looks at counts of a text and votes that the document is good (1), bad (-1), or abstains (0). The votes of
all documents are counted by pattern (at most 3 to the number of rules). Expectation-maximisation over these
patterns estimates how often each rule is right about good and about bad documents, and the share of good documents without labels; a document is kept if its
posterior probability to be good reaches a threshold. One suspicious sign is thus outweighed by the others, where
all-must-pass filtering would drop the document.

The estimate is one SQL expression over the one row that holds the counted patterns, so nothing runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import let, staged, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
#: Function words of the languages that are common in crawled text; other languages are not voted on by them alone.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on as are with be by this at from or an "
    "le la les de des et un une en que qui dans pour du est par sur au avec pas "
    "der die das und ein eine den von zu mit ist im nicht dem auf für als auch es an "
    "el los las y del se por con una para al lo su o como más pero "
    "il di che non per sono della i gli da e do não os uma com het een van niet dat"
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(w: Column) -> Column:
    """Words that lie in three-word windows found twice or more.

    Windows are numbered by a 64-bit hash and sorted with their places; those equal to a neighbour are repeated.
    Sorted by place, a repeated window covers what the one before it leaves of its three words.
    """
    hashed = F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    known = F.coalesce(let(let(F.sort_array(hashed), places), covered), F.lit(0).cast("long"))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(known)


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts that the rules look at, each named m_*."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    w, rest = F.col("m_words"), F.col("m_rest")
    # most characters are blanks or a to z; the classes of the others are counted in what is left
    out = docs.withColumns({"m_words": words(F.col("text")), "m_lines": lines, "m_solid": F.translate(text, BLANKS, "")})
    out = out.withColumn("m_rest", F.translate("m_solid", LOWER, ""))
    out = out.withColumns(
        {
            "m_n_words": F.size(w).cast("long"),
            "m_word_chars": F.length("m_solid").cast("long"),
            "m_n_symbols": chars_of(rest, SYMBOLS),
            "m_n_lines": F.size("m_lines").cast("long"),
            "m_n_dup_lines": (F.size("m_lines") - F.size(F.array_distinct("m_lines"))).cast("long"),
            "m_n_repeat_words": repeat_words(w),
            "m_n_distinct": F.size(F.array_distinct(w)).cast("long"),
            "m_n_function": F.size(F.array_intersect(w, F.lit(sorted(set(FUNCTION_WORDS.split()))))).cast("long"),
            "m_n_marks": chars_of(rest, MARKS),
            "m_n_stops": chars_of(rest, ".!?"),
            "m_n_shouts": chars_of(rest, "!?"),
            "m_n_upper": chars_of(rest, UPPER),
            "m_n_lower": (F.length("m_solid") - F.length(rest)).cast("long"),
            "m_n_digits": chars_of(rest, "0123456789"),
        }
    )
    return out.drop("m_words", "m_lines", "m_solid", "m_rest")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Rule name to vote. Each has a band in which it is silent."""
    n, c = F.col("m_n_words"), F.col
    few = n < 20
    mean = c("m_word_chars") / F.greatest(n, F.lit(1))
    upper = c("m_n_upper") / F.greatest(c("m_n_upper") + c("m_n_lower"), F.lit(1))
    return {
        "symbols": vote(100 * c("m_n_symbols") <= n, 10 * c("m_n_symbols") >= n),
        "marks": vote(10 * c("m_n_marks") <= c("m_word_chars"), 20 * c("m_n_marks") >= 3 * c("m_word_chars")),
        "function_words": vote(c("m_n_function") >= 3, ~few & (c("m_n_function") == 0)),
        "repeats": vote(20 * c("m_n_repeat_words") <= n, 10 * c("m_n_repeat_words") >= 3 * n),
        "lines": vote(20 * c("m_n_dup_lines") <= c("m_n_lines"), (c("m_n_dup_lines") >= 3) & (10 * c("m_n_dup_lines") >= 3 * c("m_n_lines"))),
        "word_length": vote((mean >= 4) & (mean <= 7), (mean < 3) | (mean > 10)),
        "variety": vote(~few & (10 * c("m_n_distinct") >= 4 * n), ~few & (5 * c("m_n_distinct") <= n)),
        "sentences": vote((50 * c("m_n_stops") >= n) & (4 * c("m_n_stops") <= n), ~few & (200 * c("m_n_stops") < n)),
        "shouting": vote((upper <= 0.2) & (20 * c("m_n_shouts") <= n), (upper >= 0.5) | (3 * c("m_n_shouts") >= n)),
        "digits": vote(20 * c("m_n_digits") <= c("m_word_chars"), 4 * c("m_n_digits") >= c("m_word_chars")),
    }


def estimated(patterns: DataFrame, names: list[str], rounds: int, prior: float, good: float, bad: float, strength: float) -> DataFrame:
    """One row: prior, and in the order of names how often a rule that votes is right about good and about bad documents.

    patterns: a vote column per name and n, the documents with these votes. The estimates begin at ``good`` and
    ``bad``, which also count as so many documents as ``strength``.
    """
    held = patterns.agg(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n"))).alias("p"))
    every = f"sequence(0, {len(names) - 1})"
    # the posterior of every pattern, then the share of good documents and what each rule got right by it
    votes = f"aggregate({every}, ln(s.prior / (1D - s.prior)), (a, j) -> a + CASE x.v[j] WHEN 1 THEN ln(s.good[j] / (1D - s.bad[j])) WHEN -1 THEN ln((1D - s.good[j]) / s.bad[j]) ELSE 0D END)"
    judged = f"transform(p, x -> struct(x.v AS v, x.n AS n, x.n / (1D + exp(-({votes}))) AS y))"
    total = lambda what: f"aggregate(r, 0D, (a, x) -> a + {what})"
    held_in = lambda x: f"least(0.999D, greatest(0.001D, {x}))"
    smooth = lambda part, whole, start: held_in(f"({part} + {start * strength}D) / ({whole} + {strength}D)")
    on_good = smooth(total("IF(x.v[j] = 1, x.y, 0D)"), total("abs(x.v[j]) * x.y"), good)
    on_bad = smooth(total("IF(x.v[j] = -1, x.n - x.y, 0D)"), total("abs(x.v[j]) * (x.n - x.y)"), bad)
    share = smooth(total("x.y"), total("x.n"), prior)
    step = f"transform(array({judged}), r -> struct({share} AS prior, transform({every}, j -> {on_good}) AS good, transform({every}, j -> {on_bad}) AS bad))[0]"
    start = f"struct({prior}D AS prior, array_repeat({good}D, {len(names)}) AS good, array_repeat({bad}D, {len(names)}) AS bad)"
    return held.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, t) -> {step})").alias("model")).select("model.*")


def posterior(names: list[str]) -> Column:
    """P(good | votes), by the model's columns prior, good and bad."""
    odds = F.log(F.col("prior") / (1 - F.col("prior")))
    for j, name in enumerate(names):
        good, bad = F.col("good")[j], F.col("bad")[j]
        odds += F.when(F.col(name) == 1, F.log(good / (1 - bad))).when(F.col(name) == -1, F.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def decided(seen: DataFrame, threshold: float = 0.5, rounds: int = 25, prior: float = 0.8, good: float = 0.95, bad: float = 0.4, strength: float = 20) -> DataFrame:
    """measured() documents with base_failed, quality (the posterior) and kept. seen is written once, as it is read twice."""
    votes = {f"v_{k}": v for k, v in rules().items()}
    names = list(votes)
    seen = staged(seen, "measured").withColumns(votes)
    model = estimated(seen.groupBy(*names).agg(F.count("*").alias("n")), names, rounds, prior, good, bad, strength)
    # one row of so many numbers as there are rules
    seen = seen.crossJoin(F.broadcast(model)).withColumn("quality", posterior(names)).drop("prior", "good", "bad")
    failed = (F.col("m_n_words") < 50) | (100 * F.col("m_n_repeat_words") > 50 * F.col("m_n_words"))
    return seen.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judge(docs: DataFrame, **parameters: float) -> DataFrame:
    """docs with m_* counts, v_* votes, base_failed, quality (the posterior) and kept.

    docs: text, and any other columns but those of these names. A null text has no words; texts of under 50 words,
    or with more than half of the words in repeated windows, fail at once. Empty tables give no rows; repeated rows
    are judged alike. parameters: those of decided().
    """
    return decided(measured(docs), **parameters)


def report(docs: DataFrame) -> DataFrame:
    found = decided(measured(docs.select("doc_id", "text")).drop("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *[F.col(f"m_{x}").alias(x) for x in names], "base_failed", "kept", F.round("quality", 6).alias("quality"))


def oracle_sql(rounds: int = 25, prior: float = 0.8, good: float = 0.95, bad: float = 0.4, strength: float = 20) -> str:
    """DuckDB SQL of report(): the counts over exploded words and lines, and the same estimate as a fold."""
    quoted = lambda chars: "'" + chars.replace("'", "''") + "'"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    of = lambda chars: f"length(rest) - length(translate(rest, {quoted(chars)}, ''))"
    vote = lambda good, bad: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    n, chars = "n_words", "word_chars"
    votes = [
        vote(f"100 * n_symbols <= {n}", f"10 * n_symbols >= {n}"),
        vote(f"10 * marks <= {chars}", f"20 * marks >= 3 * {chars}"),
        vote("fn >= 3", f"{n} >= 20 AND fn = 0"),
        vote(f"20 * n_repeat_words <= {n}", f"10 * n_repeat_words >= 3 * {n}"),
        vote("20 * n_dup_lines <= n_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines >= 3 * n_lines"),
        vote("mean BETWEEN 4 AND 7", "mean < 3 OR mean > 10"),
        vote(f"{n} >= 20 AND 10 * n_distinct >= 4 * {n}", f"{n} >= 20 AND 5 * n_distinct <= {n}"),
        vote(f"50 * stops >= {n} AND 4 * stops <= {n}", f"{n} >= 20 AND 200 * stops < {n}"),
        vote(f"share <= 0.2 AND 20 * shouts <= {n}", f"share >= 0.5 OR 3 * shouts >= {n}"),
        vote(f"20 * digits <= {chars}", f"4 * digits >= {chars}"),
    ]
    m = len(votes)
    odds = "ln({s}.prior / (1 - {s}.prior)) + list_sum(list_transform(range(1, {m} + 1), lambda j: CASE {v}[j] WHEN 1 THEN ln({s}.good[j] / (1 - {s}.bad[j])) WHEN -1 THEN ln((1 - {s}.good[j]) / {s}.bad[j]) ELSE 0 END))"
    total = lambda what: f"list_sum(list_transform(r, lambda x: {what}))"
    smooth = lambda part, whole, start: f"least(0.999, greatest(0.001, ({part} + {start * strength}::DOUBLE) / ({whole} + {strength}::DOUBLE)))"
    on_good = smooth(total("CASE WHEN x.v[k] = 1 THEN x.y ELSE 0 END"), total("abs(x.v[k]) * x.y"), good)
    on_bad = smooth(total("CASE WHEN x.v[k] = -1 THEN x.n - x.y ELSE 0 END"), total("abs(x.v[k]) * (x.n - x.y)"), bad)
    each = f"range(1, {m} + 1)"
    step = f"""list_transform([list_transform(p, lambda x: struct_pack(v := x.v, n := x.n, y := x.n / (1 + exp(-({odds.format(s='s', m=m, v='x.v')})))))],
      lambda r: struct_pack(prior := {smooth(total('x.y'), total('x.n'), prior)}, good := list_transform({each}, lambda k: {on_good}), bad := list_transform({each}, lambda k: {on_bad})))[1]"""
    start = f"struct_pack(prior := {prior}::DOUBLE, good := list_transform({each}, lambda k: {good}::DOUBLE), bad := list_transform({each}, lambda k: {bad}::DOUBLE))"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {blanks}, '')) > 0) AS ls, translate(coalesce(text, ''), {blanks}, '') AS solid FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM (
    SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3))
), rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE k > 1) GROUP BY doc_id
), c AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, len(list_distinct(w)) AS n_distinct,
    len(list_filter(list_distinct(w), lambda x: list_contains(string_split({quoted(FUNCTION_WORDS)}, ' '), x))) AS fn, solid, translate(solid, {quoted(LOWER)}, '') AS rest
  FROM t LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, CAST({of(SYMBOLS)} AS BIGINT) AS n_symbols, {of(MARKS)} AS marks, {of('.!?')} AS stops, {of('!?')} AS shouts, {of('0123456789')} AS digits,
    word_chars / greatest(n_words, 1) AS mean, ({of(UPPER)}) / greatest(({of(UPPER)}) + length(solid) - length(rest), 1) AS share FROM c
), v AS (SELECT *, [{', '.join(votes)}] AS v FROM f
), p AS (SELECT list(struct_pack(v := v, n := n)) AS p FROM (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY v)
), m AS (SELECT list_reduce(range(1, {rounds + 1}), lambda s, i: {step}, {start}) AS m FROM p
), q AS (SELECT v.*, 1 / (1 + exp(-({odds.format(s='m', m=m, v='v')}))) AS q, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS quality FROM q
"""
