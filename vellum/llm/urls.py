"""URL filters: host and path rules first, then naive Bayes over segmented names.

Names in hosts are run together (``freebets``). Each is cut into words by a unigram Viterbi search, whose word counts
come from all documents; only the substrings of names that occur are counted, so the lexicon is as large as the
hosts need and nothing is capped or collected. Multinomial naive Bayes, trained from labelled urls, then scores the
words of host and path.
"""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_bounded, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path. Fixed by the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of sites to block and of sites to allow, by topic, and of their paths. Labelled urls are made of these by rule.
BLOCK_TOPICS = (
    "casino poker slots roulette blackjack jackpot lottery bingo betting bets wager odds", "pills meds pharmacy viagra cialis steroids prescription dosage",
    "adult porn sex xxx escort cams nude singles", "payday loans cash lender debt credit", "ads banner popup click tracker pixel affiliate adserver",
    "crack keygen warez torrent serial nulled",
)
ALLOW_TOPICS = (
    "library archive museum book history gallery catalog reading", "school university science math physics lecture course college",
    "city council park river garden weather transport health", "news daily paper review journal radio magazine report",
    "docs code forum open data manual developer source", "cooking recipes travel music film bird photo craft",
)
BLOCK_PATHS = "buy bonus free win cheap online play live offer deal claim prize".split()
ALLOW_PATHS = "about guide index contact events article help page visit minutes lesson photos".split()
#: Letters of the longest word that is looked up in the texts: as many as a label of a host may have. Unknown words have no such bound.
LONGEST = 63


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def names_of(host: Column) -> Column:
    """Letter runs of a host but its last label."""
    kept = F.regexp_replace(host, r"\.?[^.]*$", "")
    return F.array_distinct(F.filter(F.split(kept, "[^a-z]+"), lambda x: x != ""))


def path_words(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, UPPER, LOWER), "[^a-z]+"), lambda x: x != "")


def substrings(name: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(name))
    ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(name) - i + 1))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda n: F.substring(name, i, n)))))


def viterbi(name: str, logs: dict[str, float], total: float) -> list[str]:
    """The likeliest words that a name is made of; an unknown word, of any length, is ten times less likely a letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    # where the likeliest unknown word would begin: its likelihood falls alike with each letter, wherever it began
    before: tuple[float, int] = (-math.inf, 0)
    for end in range(1, len(name) + 1):
        before = max(before, (best[end - 1][0] + (end - 1) * math.log(10), end - 1))
        options = [(before[0] + math.log(10 / total) - end * math.log(10), before[1])]
        for start in range(max(0, end - LONGEST), end):
            if (own := logs.get(name[start:end])) is not None:
                options.append((best[start][0] + own, start))
        best.append(max(options))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segmented(names: DataFrame, docs: DataFrame, added: DataFrame) -> DataFrame:
    """name and its words, for a table of distinct names. added: words (word) that count as one in a million."""
    parts = staged(names.select("name", F.explode(substrings(F.col("name"))).alias("word")), "substrings")
    # written first, so that its size is known when the join with all words of the corpus is planned
    wanted = staged(parts.select("word").distinct(), "wanted")
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    used = docs.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where("word <> ''")
    counts = staged(used.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")), "counts")
    total = float(max(docs.select(F.sum(F.size(F.split(text, "[^a-z]+")))).first()[0] or 0, 1000))
    more = added.select("word", F.lit(int(total / 1e6) + 1).cast("long").alias("n"))
    counts = counts.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))
    # a name has at most its length times LONGEST substrings
    found = parts.join(counts, "word", "left").select("name", "word", F.log(F.col("n") / total).alias("log"))

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        known = group.dropna()
        name = group["name"].iloc[0]
        return pd.DataFrame({"name": [name], "words": [viterbi(name, dict(zip(known["word"], known["log"], strict=True)), total)]})

    return found.groupBy("name").applyInPandas(cut, "name string, words array<string>")


def default_labelled(spark) -> DataFrame:
    """Urls of every two different words of one topic, run together or hyphenated in turn, with the path words in turn."""
    rows = []
    for verdict, topics, paths in (("block", BLOCK_TOPICS, BLOCK_PATHS), ("allow", ALLOW_TOPICS, ALLOW_PATHS)):
        pairs = [pair for words in topics for pair in itertools.permutations(words.split(), 2)]
        rows += [(f"http://{'-'.join(pair) if k % 2 else ''.join(pair)}.com/{paths[k % len(paths)]}", verdict) for k, pair in enumerate(pairs)]
    return spark.createDataFrame(rows, "url string, verdict string")


def tokens_of(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (host) with host_words: the words of all names of the host, for each distinct host."""
    hosts = rows.select("host").distinct().select("host", F.explode(names_of(F.col("host"))).alias("name"))
    return hosts.join(cuts, "name").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("host_words"))


def weights(labelled: DataFrame, cuts: DataFrame) -> DataFrame:
    """token and odds: its log-odds for block against allow, with one added to each count."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("verdict", host.alias("host"), path.alias("path"))
    both = rows.join(tokens_of(rows, cuts), "host", "left")
    tokens = F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_words(F.col("path")))
    seen = both.select("verdict", F.explode(tokens).alias("token")).groupBy("token").pivot("verdict", ["block", "allow"]).count().na.fill(0)
    seen = staged(seen, "seen")
    block, allow, n = seen.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("block") + 1) / (block + n + 1)) - F.log((F.col("allow") + 1) / (allow + n + 1))
    return staged(seen.select("token", odds.alias("odds")), "weights")


def scored(rows: DataFrame, key: str, words: Column, known: DataFrame, name: str) -> DataFrame:
    """key and the sum of its words' odds, for distinct keys that have a known word."""
    tokens = rows.select(key, F.explode(words).alias("token"))
    return join_bounded(tokens, known, ["token"]).groupBy(key).agg(F.sum("odds").alias(name))


def judge(pages: DataFrame, docs: DataFrame, labelled: DataFrame | None = None, rules=RULES, blocked_share: float = 0.2, most: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-odds of block) and host_words.

    pages: page_id and url. docs: text, for word counts. labelled: url and verdict (block or allow; by default made of
    topic words); of more than ``most`` rows about so many are sampled. A null url, or one without ``://``, has an
    empty host and path, fits no rule, has no words and is allowed by the classes' odds alone, and so is any tie at 0.
    Userinfo and port are part of the host, as the contract cuts it; names are runs of a to z, so others' letters part
    words. Texts and urls may be of any length. Repeated rows are judged alike; no pages, no rows.
    """
    spark = pages.sparkSession
    labelled = default_labelled(spark) if labelled is None else labelled
    n = labelled.count()
    labelled = labelled if n <= most else staged(labelled.sample(most / n, 5), "labelled")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    taught = labelled.select(host.alias("host"), path.alias("path"))
    # words as the labels have them, hyphenated or in paths
    spoken = taught.select(F.explode(F.concat(names_of(F.col("host")), path_words(F.col("path")))).alias("word"))
    spoken = spoken.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word")
    names = rows.select("host").distinct().unionByName(taught.select("host").distinct())
    names = names.select(F.explode(names_of(F.col("host"))).alias("name")).distinct()
    cuts = staged(segmented(names, docs, spoken), "cuts")
    known, prior = weights(labelled, cuts), math.log(blocked_share / (1 - blocked_share))
    hosts = tokens_of(rows, cuts)
    hosts = staged(hosts.join(scored(hosts, "host", F.col("host_words"), known, "host_score"), "host", "left"), "hosts")
    paths = staged(scored(rows.select("path").distinct(), "path", path_words(F.col("path")), known, "path_score"), "paths")
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = join_bounded(join_bounded(rows, hosts, ["host"], "left"), paths, ["path"], "left")
    out = out.withColumn("score", F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)))
    verdict = F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "score", "host_words")


def report(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return judge(pages, docs).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
