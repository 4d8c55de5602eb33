"""Text normalisers and metrics as Column builders: everything here stays inside Catalyst.

Token arrays never hold empty strings, so an empty text has no tokens. Folds over token arrays are meant for answers
(hundreds of tokens), not for documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation. Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: CJK punctuation that the Chinese normaliser drops. Fixed values.
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
#: Quote characters that the agent normaliser also drops. Fixed values.
QUOTES = "‘’´`"
SPACES = r"(?U)\s+"
ARTICLES = r"(?U)\b(a|an|the)\b"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return squeeze(F.regexp_replace(plain, ARTICLES, " "))


def normalize_agent_answer(text: Column) -> Column:
    """As normalize_answer, but underscores and punctuation (and some quotes) become spaces."""
    marks = PUNCTUATION + QUOTES
    plain = F.translate(F.lower(text), marks, " " * len(marks))
    return squeeze(F.regexp_replace(plain, ARTICLES, " "))


def normalize_zh_answer(text: Column) -> Column:
    """Lower case without white space and ASCII or CJK punctuation."""
    return F.translate(F.regexp_replace(F.lower(text), SPACES, ""), "".join(dict.fromkeys(PUNCTUATION + CJK_PUNCTUATION)), "")


def alnum(text: Column) -> Column:
    """Lower-case ASCII letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens that two arrays share, as often as both have them."""
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, t: n + F.least(times(a, t), times(b, t)))


def f1_of(overlap: Column, n_pred: Column, n_gold: Column) -> Column:
    """2pr / (p + r) from counts; no overlap gives 0."""
    return F.when(overlap == 0, F.lit(0.0)).otherwise(2.0 * overlap / (n_pred + n_gold))


def token_f1(pred: Column, gold: Column) -> Column:
    """Multiset F1 of two token arrays."""
    return let(multiset_overlap(pred, gold), lambda n: f1_of(n, F.size(pred), F.size(gold)))


def agent_f1(pred: Column, gold: Column) -> Column:
    """struct(f1, precision, recall) of agent-normalised texts; a yes, no or noanswer must match as a whole."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("f1", "precision", "recall")])

    def scored(p: Column, g: Column) -> Column:
        pt, gt = tokens(p), tokens(g)
        n = multiset_overlap(pt, gt)
        shut = (p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")) & (p != g)
        full = F.struct(f1_of(n, F.size(pt), F.size(gt)).alias("f1"), (n / F.size(pt)).alias("precision"), (n / F.size(gt)).alias("recall"))
        return F.when(shut | (n == 0), zero).otherwise(full)

    return let(normalize_agent_answer(pred), lambda p: let(normalize_agent_answer(gold), lambda g: scored(p, g)))


def token_set_overlap(pred: Column, gold: Column) -> Column:
    """Shared distinct tokens over the gold's distinct tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(pred, gold)), F.size(F.array_distinct(gold))), F.lit(0.0))


def edit_distance(a: Column, b: Column) -> Column:
    """Token edit distance, one row of the table a token of a."""
    zero_to_n = F.when(F.size(b) == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(b)))

    def row(previous: Column, x: Column) -> Column:
        first = F.array(F.element_at(previous, 1) + 1)

        def cell(done: Column, j: Column) -> Column:
            swap = F.get(previous, j) + F.when(F.get(b, j) == x, 0).otherwise(1)
            return F.concat(done, F.array(F.least(swap, F.get(previous, j + 1) + 1, F.element_at(done, -1) + 1)))

        return F.when(F.size(b) == 0, first).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), first, cell))

    return F.element_at(F.aggregate(a, zero_to_n, row), -1)


def word_error_rate(pred: Column, gold: Column) -> Column:
    """Edit distance over the gold's length; infinite for an empty gold."""
    return F.when(F.size(gold) == 0, F.lit(float("inf"))).otherwise(edit_distance(pred, gold) / F.size(gold))


def wer_hit(pred: Column, gold: Column) -> Column:
    """1 if the gold is a substring, else 1 - WER where that is positive; case doesn't count."""
    p, g = F.lower(pred), F.lower(gold)
    return F.greatest(p.contains(g).cast("double"), F.lit(1.0) - word_error_rate(tokens(p), tokens(g)))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of token arrays."""

    def row(previous: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            own = F.when(F.get(b, j) == x, F.get(previous, j) + 1).otherwise(F.greatest(F.get(previous, j + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(own))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), cell)

    fold = F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(fold)


def rouge_l_lcs(pred: Column, gold: Column) -> Column:
    """F of the longest common subsequence: a plain formula, not the score of a ROUGE library."""
    return let(longest_common(pred, gold), lambda n: f1_of(n, F.size(pred), F.size(gold)))


def substring_hits(pred: Column, golds: Column) -> Column:
    """Whether the prediction contains each gold, whatever the case. Its lower case is taken once a row."""
    return let(F.lower(pred), lambda p: F.transform(golds, lambda g: F.contains(p, F.lower(g))))


def substring_recall(pred: Column, golds: Column) -> Column:
    """Share of golds that the prediction contains, whatever the case; null without golds."""
    return let(substring_hits(pred, golds), lambda hits: F.try_divide(F.size(F.filter(hits, lambda h: h)), F.size(golds)))


def substring_any(pred: Column, golds: Column) -> Column:
    return let(substring_hits(pred, golds), lambda hits: F.exists(hits, lambda h: h)).cast("double")


def best_of(pred: Column, golds: Column, metric) -> Column:
    """The best metric(pred, gold), 0 without golds."""
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(golds, lambda g: metric(pred, g))), F.lit(0.0)))


def classification_credit(pred: Column, gold: Column, classes: Column) -> Column:
    """1/k if the gold is among the k classes found in the prediction; classes inside the gold don't count."""
    met = F.filter(classes, lambda c: F.contains(pred, c) & ~(F.contains(gold, c) & (c != gold)))
    return let(met, lambda m: F.when(F.array_contains(m, gold), F.lit(1.0) / F.size(m)).otherwise(F.lit(0.0)))


def number_hit_rate(pred: Column, target: Column) -> Column:
    """Share of the prediction's numbers that are the target; 0 without numbers."""
    found = F.regexp_extract_all(pred, F.lit(r"(?U)\d+"), F.lit(0))
    return let(found, lambda xs: F.coalesce(F.try_divide(F.size(F.filter(xs, lambda x: x == target)), F.size(xs)), F.lit(0.0)))


def retrieval_hit_rate(pred: Column, gold: Column, marker: str = "Paragraph ") -> Column:
    """number_hit_rate against the first number after the marker in the gold."""
    target = F.regexp_extract(gold, rf"(?U){marker}(\d+)", 1)
    return F.when(target == "", F.lit(0.0)).otherwise(number_hit_rate(pred, target))


def first_line(text: Column) -> Column:
    return F.get(F.split(F.regexp_replace(text, r"^\n+", ""), "\n"), F.lit(0))


def scrubbed(text: Column) -> Column:
    """Control characters as line feeds, then no white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]", "\n"), r"(?U)^\s+|\s+$", "")


def last_paragraph(text: Column) -> Column:
    return F.element_at(F.split(text, "\n\n"), -1)


def without_document_blocks(text: Column) -> Column:
    """text without what stands between a document's heading (Document, its number and a colon) and the next empty line;
    a document that no empty line ends stays."""
    headed = lambda p: F.split(p, "Document [0-9]+:", 2)

    def kept(p: Column, n: Column, i: Column) -> Column:
        return F.when(i == n - 1, p).when(F.size(headed(p)) > 1, headed(p)[0]).otherwise(F.concat(p, F.lit("\n\n")))

    return let(F.split(text, "\n\n"), lambda ps: F.array_join(F.transform(ps, lambda p, i: kept(p, F.size(ps), i)), ""))


def last_of(found: Column) -> Column:
    """The last element that isn't null."""
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))


def boxes(text: Column) -> Column:
    """What each box holds that has no braces inside."""
    held = lambda p: F.substring_index(p, "}", 1)
    opened = lambda ps: F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0)))
    return let(F.split(text, r"\\boxed\{"), lambda ps: F.transform(opened(ps), lambda p: F.when(p.contains("}") & ~held(p).contains("{"), held(p))))


def stated_letters(text: Column) -> Column:
    """The letter after each word answer, a colon between them, and blanks and up to two marks of emphasis on either side of it."""
    def of(after: Column) -> Column:
        colon = F.ltrim(F.regexp_replace(after, r"\A[*_]{1,2}", ""), F.lit(" \t\n\r\f\u000b"))
        said = F.ltrim(F.regexp_replace(F.substring(colon, F.lit(2), F.length(colon)), r"\A[\s*_]{1,2}", ""), F.lit(" \t\n\r\f\u000b"))
        alone = ~F.substring(said, 2, 1).rlike("[a-zA-Z0-9]")
        return F.when(colon.startswith(":") & F.substring(said, 1, 1).rlike("[a-zA-Z]") & alone, F.substring(said, 1, 1))

    return let(F.split(text, "(?i)answer"), lambda ps: F.transform(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), of))


def choice_letter(text: Column) -> Column:
    """The letter of a multiple-choice answer: from the last box, else the last stated letter, else the last capital that stands alone."""
    lone = lambda x: F.try_element_at(F.filter(F.split(x, r"(?U)\W+"), lambda w: w.rlike("^[A-Z]$")), F.lit(-1))
    pick = lambda x: F.when(F.length(x) == 1, F.upper(x)).otherwise(lone(x))
    return F.coalesce(pick(F.trim(last_of(boxes(text)))), F.upper(last_of(stated_letters(text))), lone(text))


def common_length(a: Column, b: Column, end: Column) -> Column:
    """How many characters two texts have in common at their beginning, or (end) at their end, by halving."""
    most = F.least(F.length(a), F.length(b))
    part = lambda t, n: F.when(end, F.right(t, n)).otherwise(F.substring(t, F.lit(1), n))
    longer = lambda n, i: n + F.call_function("shiftleft", F.lit(1), i)
    step = lambda n, i: F.when(longer(n, i) > most, n).when(part(a, longer(n, i)) == part(b, longer(n, i)), longer(n, i)).otherwise(n)
    return F.aggregate(F.sequence(F.greatest(F.length(F.bin(most.cast("long"))) - 1, F.lit(0)), F.lit(0), F.lit(-1)), F.lit(0), step)


def char_edits(a: Column, b: Column) -> Column:
    """Character edit distance of two texts: what they have in common at both ends is left out, and the rest compared
    within 64 and 1024 edits before it is compared as a whole, so that like texts cost little more than their length."""
    both = F.struct(a.alias("a"), b.alias("b"))
    cut = lambda t, first, n: F.substring(t, first, n)
    behind = lambda p: let(common_length(p["a"], p["b"], F.lit(False)), lambda n: F.struct(*[cut(p[c], n + 1, F.length(p[c])).alias(c) for c in ("a", "b")]))
    before = lambda p: let(common_length(p["a"], p["b"], F.lit(True)), lambda n: F.struct(*[cut(p[c], F.lit(1), F.length(p[c]) - n).alias(c) for c in ("a", "b")]))
    edits = lambda p: F.coalesce(*[F.nullif(F.levenshtein(p["a"], p["b"], most), F.lit(-1)) for most in (64, 1024)], F.levenshtein(p["a"], p["b"]))
    return let(let(let(both, behind), before), edits)


def char_error_rate(pred: Column, gold: Column) -> Column:
    """Character edit distance of squeezed texts over the gold's length, 1 at least."""
    return let(squeeze(gold), lambda g: char_edits(squeeze(pred), g) / F.greatest(F.length(g), F.lit(1)))


def after_thinking(text: Column) -> Column:
    return F.trim(F.substring_index(text, "</think>", -1))


def reasoning_and_answer(text: Column) -> Column:
    """struct(reasoning, answer), parted after the first end of thinking; the answer is kept to the byte."""
    at = F.instr(text, "</think>")
    cut = F.when(at > 0, at + 7).otherwise(F.lit(0))
    return F.struct(F.substring(text, F.lit(1), cut).alias("reasoning"), F.substring(text, cut + 1, F.length(text)).alias("answer"))


def human_count(n: Column) -> Column:
    """Counts with two decimals, halves rounded up, and K, M, B or T."""
    steps = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    out = n.cast("string")
    for size, unit in reversed(steps):
        out = F.when(n >= size, F.format_string(f"%.2f{unit}", n / size)).otherwise(out)
    return out


def format_reward(text: Column) -> Column:
    """1 if one answer block, not empty, ends the text and the thinking before it is closed once; else 0.

    The prompt has opened the thinking already, so the text holds one closing tag and no opening one.
    """
    answer = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>\s*$", 1)
    closed = (F.regexp_count(text, F.lit("</think>")) - F.regexp_count(text, F.lit("<think>"))) == 1
    return (closed & (F.trim(answer) != "")).cast("double")


def contains_cjk(text: Column) -> Column:
    return text.rlike(r"[\u3000-\u9fff\uf900-\ufaff\uff00-\uffef]")


def layout_text(text: Column) -> Column:
    """Soft hyphens and zero-width spaces go; markup is escaped; further spaces of a run don't break; lines and tabs become markup."""
    steps = [("[\u00ad\u200b]", ""), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("(?<= ) ", "&nbsp;"), ("\t", "&nbsp;&nbsp;&nbsp;&nbsp;"), ("\n", "<br/>")]
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def line_blocks(text: Column, size: int = 32) -> Column:
    """The text's lines in blocks of so many."""
    return let(F.split(text, "\n"), lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls), F.lit(size)), lambda i: F.array_join(F.slice(ls, i, F.lit(size)), "\n")))
