"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame expressions alone.

A candidate is a run of at least 16 characters of keys (letters, digits, + / _ -) with a digit and a letter, inside a
white-space-separated word. The forest sees its length, its characters and how often their kind changes, how much of
it the dictionary covers, the path (what stands before it in its word, and the document's source), and the words
around it. The dictionary is what the corpus itself uses often; its words, by how often they stand there, also teach
how likely one character follows another, and a candidate's mean log-likelihood by that is one more feature.

The forest is trained here, from labelled findings; the default ones are made by rule from hashes of a range.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, staged

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Words whose presence before a candidate speaks for, or against, a secret.
KEY_WORDS = "pass|pwd|secret|token|key|auth|credential|bearer|private|login|aws|akia|ghp_|xox|sk_live"
ID_WORDS = "commit|sha1|sha256|md5|checksum|hash|digest|uuid|guid|etag|integrity|revision|build|version|http|www|example|sample|test|placeholder|image|img"
#: English words of identifiers, in the made labelled findings.
PLAIN_WORDS = (
    "user account update request handler service factory default manager resource element window storage network "
    "session cookie header footer button report number sample figure chapter section volume edition standard"
).split()
#: Names of keys in the made findings. ``token`` isn't one of them, to see that others are found too.
KEY_NAMES = ("password", "passwd", "client_secret", "api_key", "auth", "private_key", "access_key", "credential")
#: Symbols of the transitions: a to z, digits, all others.
SYMBOLS = 28
FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_distinct", "f_changes", "f_transition", "f_hex", "f_coverage", "f_assigned", "f_slash", "f_path_test", "f_key_before", "f_id_before", "f_key_after"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_index, found, prefix (of its word), before (two words), after (one word), path."""
    w = F.split(F.coalesce("text", F.lit("")), SPACE)
    likely = F.filter(
        F.transform(F.col("w"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: (F.length(s["x"]) >= 16) & s["x"].rlike(CANDIDATE),
    )
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), w.alias("w"))
    # only words that may hold a candidate leave the array
    rows = rows.withColumn("likely", likely).where(F.size("likely") > 0)
    rows = rows.select("doc_id", "path", "w", F.explode("likely").alias("s"))
    beside = lambda k: F.coalesce(F.get("w", F.col("s.i") + k), F.lit(""))
    rows = rows.select(
        "doc_id", "path", F.col("s.i").cast("long").alias("word_index"), F.col("s.x").alias("word"),
        F.concat_ws(" ", beside(-2), beside(-1)).alias("before"), beside(1).alias("after"),
        F.explode(F.array_distinct(F.regexp_extract_all("s.x", F.lit(CANDIDATE), F.lit(0)))).alias("found"),
    )
    rows = rows.where(F.col("found").rlike("[0-9]") & F.col("found").rlike("[A-Za-z]"))
    prefix = F.expr("substring(word, 1, locate(found, word) - 1)")
    return rows.withColumn("prefix", prefix).drop("word")


def letter_runs(found: Column) -> Column:
    """Lower-cased runs of three letters and more, taken apart at capitals as in camelCase."""
    return F.transform(F.regexp_extract_all(found, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: how often all documents together use it."""
    runs = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word")
    return docs.select(runs).where(F.length("word").between(3, 40)).groupBy("word").agg(F.count("*").alias("n"))


def symbol(x: Column) -> Column:
    """0 to 25 for a letter, 26 for a digit, 27 for any other character."""
    return F.when(x.between("a", "z"), F.ascii(x) - 97).when(x.between("0", "9"), F.lit(26)).otherwise(F.lit(27))


def symbols(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: symbol(F.substring(F.lower(text), i, F.lit(1))))


def transitions(words: DataFrame) -> DataFrame:
    """One row, logs: of each two symbols a and b, at a * SYMBOLS + b, the log-probability that b follows a in words (word, n)."""
    codes = words.select("n", symbols(F.col("word")).alias("s"))
    pairs = codes.select("n", F.explode(F.expr(f"transform(sequence(1, size(s) - 1), i -> s[i - 1] * {SYMBOLS} + s[i])")).alias("code"))
    seen = pairs.groupBy("code").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"))
    count = F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS**2 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    rows = f"transform(sequence(0, {SYMBOLS - 1}), a -> aggregate(slice(c, a * {SYMBOLS} + 1, {SYMBOLS}), 0L, (x, y) -> x + y))"
    return seen.select(count.alias("c")).selectExpr("c", f"{rows} AS r").selectExpr(f"transform(c, (x, i) -> ln((x + 1D) / (r[int(i / {SYMBOLS})] + {SYMBOLS}D))) AS logs")


def covered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (of distinct found) with the share of their characters that lie in known words."""
    runs = rows.select("found", F.explode(letter_runs(F.col("found"))).alias("word"))
    hits = runs.where(F.length("word") >= 3).join(known, "word").groupBy("found").agg(F.sum(F.length("word")).alias("in_words"))
    return rows.join(hits, "found", "left").withColumn("f_coverage", F.coalesce(F.col("in_words") / F.length("found"), F.lit(0.0))).drop("in_words")


def features(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """rows with the FEATURES. logs: the one row of transitions()."""
    rows = rows.crossJoin(F.broadcast(logs)).withColumn("s", symbols(F.col("found")))
    follows = f"aggregate(sequence(1, size(s) - 1), 0D, (x, i) -> x + logs[s[i - 1] * {SYMBOLS} + s[i]]) / (size(s) - 1)"
    rows = rows.withColumn("f_transition", F.expr(follows)).drop("logs", "s")
    found, n = F.col("found"), F.length("found")
    share = lambda p: F.regexp_count(found, F.lit(p)) / n
    flag = lambda c: c.cast("double")
    changes = "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    near = F.lower(F.concat_ws(" ", "before", "prefix"))
    return rows.withColumns(
        {
            "f_length": n.cast("double"),
            "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_other": share("[^A-Za-z0-9]"),
            "f_distinct": F.size(F.array_distinct(F.split("found", ""))) / n,
            "f_changes": share(changes),
            "f_hex": flag(found.rlike("^[0-9a-f]+$")),
            "f_assigned": flag(near.rlike("[=:][\"']?$|= [\"']?$")),
            "f_slash": flag(F.col("prefix").contains("/") | found.contains("/")),
            "f_path_test": flag(F.lower("path").rlike("test|example|fixture|sample")),
            "f_key_before": flag(near.rlike(KEY_WORDS) | F.lower("found").rlike("^(akia|ghp_|xox|sk_live)")),
            "f_id_before": flag(near.rlike(ID_WORDS)),
            "f_key_after": flag(F.lower("after").rlike(KEY_WORDS)),
        }
    )


def default_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n labelled findings made by rule from hashes of 0 .. n-1, of twelve kinds (kind), six of secrets and six that look
    like them, with names, quotes, neighbouring words and paths in turn. Names of keys are those of KEY_NAMES."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    mixed = F.translate(F.base64(F.unhex(h)), "+/=", "xY")
    turn = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    of = lambda k, some: F.element_at(F.lit(list(some)), (turn(k, len(some)) + 1).cast("int"))
    plain = lambda k: of(k, PLAIN_WORDS)
    cut = lambda c, lo, hi: F.substring(c, F.lit(1), (turn(0, hi - lo + 1) + lo).cast("int"))
    empty, inside = F.lit(""), turn(20, 2) == 0
    # name=found in one word, or name = "found" in several
    mark = of(21, ["=", ":", ":=", "=>"])
    key, quote = of(22, KEY_NAMES), of(23, ["", '"', "'"])
    keyed = (F.when(inside, F.concat(key, mark, quote)).otherwise(quote), F.when(inside, of(24, ["with", "the", "export"])).otherwise(F.concat_ws(" ", key, mark)))
    hexes = cut(h, 16, 64)
    uuid = F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    sep = of(33, ["-", "_"])
    own = lambda start, size: F.concat(F.lit(start), F.substring(mixed, F.lit(1), F.lit(size)))
    kinds = [
        ("hex key", hexes, *keyed, 1), ("mixed key", cut(mixed, 20, 43), *keyed, 1),
        ("access id", F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), quote, of(25, ["id", "use", "the"]), 1),
        ("host token", own("ghp_", 36), quote, of(25, ["with", "use", "the"]), 1), ("live key", own("sk_live_", 24), quote, of(25, ["charge", "use", "the"]), 1),
        ("bearer", cut(mixed, 24, 43), empty, of(26, ["authorization: bearer", "header bearer"]), 1),
        ("revision", F.substring(h, 1, 40), empty, of(27, ["commit", "at revision", "see commit", "build"]), 0),
        ("digest", F.when(inside, h).otherwise(F.substring(h, 1, 32)), of(28, ["sha256:", "md5:", "etag=", 'integrity="']), of(29, ["file", "checksum", "the"]), 0),
        ("address", uuid, of(30, ["https://host/", "http://img.example/", "urn:uuid:"]), of(29, ["see", "at", "from"]), 0),
        ("identifier", F.concat(plain(1), F.initcap(plain(2)), F.initcap(plain(3)), turn(31, 90).cast("string")), of(32, ["", "self.", "("]), of(29, ["the", "call", "in"]), 0),
        ("slug", F.concat_ws("-", plain(4), plain(5), F.lit("2024"), plain(6)), of(30, ["/", "https://host/", ""]), of(29, ["see", "at", "page"]), 0),
        # what stands for a key in a manual
        ("placeholder", F.concat(of(34, ["your", "my", "change", "dummy"]), sep, plain(4), sep, plain(7), sep, turn(31, 90).cast("string")), *keyed, 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    pick = lambda k: F.coalesce(*[F.when(kind == i, as_column(x[k])) for i, x in enumerate(kinds)])
    # tests and examples hold more of what only looks like a secret
    tried = turn(35, 10) < F.when(pick(4) == 1, 2).otherwise(5)
    path = F.when(tried, of(36, ["tests/fixtures.json", "docs/example.md", "samples/a.txt"])).otherwise(of(37, ["src/settings.py", "deploy/values.yaml", "web", "mail", ""]))
    return spark.range(n).select(
        pick(0).alias("kind"), pick(1).alias("found"), pick(2).alias("prefix"), pick(3).alias("before"),
        of(38, ["", "and", "of", "in", "user", "#", "password", "for"]).alias("after"), path.alias("path"), pick(4).cast("double").alias("label"),
    )


def train(labelled: DataFrame, known: DataFrame, logs: DataFrame, most: int = 100_000, seed: int = 7) -> PipelineModel:
    """A forest from findings with label 1 (secret) or 0; of more than ``most`` it takes a sample of about that size."""
    n = labelled.count()
    some = labelled if n <= most else labelled.sample(most / n, seed)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=40, maxDepth=7, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(features(covered(some, known), logs))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, dictionary_least: int = 3) -> DataFrame:
    """A row per candidate: doc_id, word_index, found, score (the forest's), is_secret.

    docs: doc_id, text, source; other columns are ignored. labelled: found, prefix, before, after, path, label; of
    both classes, else every score is that of the one class. Null texts and sources are empty; an empty text has no
    candidates, an empty table gives no rows, and repeated rows are found repeatedly. A candidate that stands twice in
    a word counts once. Texts and candidates may be of any length. A score that ties with the threshold is a secret.
    """
    spark = docs.sparkSession
    labelled = default_findings(spark) if labelled is None else labelled
    rows = staged(candidates(docs), "candidates")
    both = rows.select("found").unionByName(labelled.select("found"))
    wanted = both.select(F.explode(letter_runs(F.col("found"))).alias("word")).where(F.length("word") >= 3).distinct()
    words = staged(vocabulary(docs), "vocabulary")
    plain = spark.range(1).select(F.explode(F.lit(PLAIN_WORDS)).alias("word"), F.lit(dictionary_least).cast("long").alias("n"))
    words = words.unionByName(plain).groupBy("word").agg(F.sum("n").alias("n"))
    logs = staged(transitions(words), "transitions")
    known = staged(words.where(F.col("n") >= dictionary_least).join(staged(wanted, "wanted"), "word", "left_semi").select("word"), "dictionary")
    model = train(labelled, known, logs)
    scored = model.transform(features(covered(rows, known), logs)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_index", "found", "score", (F.col("score") >= threshold).alias("is_secret"))


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select("doc_id", "word_index", F.sha2("found", 256).alias("found_sha256"), F.length("found").cast("long").alias("length"), F.round("score", 6).alias("score"), "is_secret")
