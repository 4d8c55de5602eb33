"""Documents whose order differs at each evaluation, lines of one word, passages on many documents, names of any length."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import decontaminate, lines, substrings, urls
from vellum.llm.common import text_key


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_blocks_over_rows_in_any_order(spark):
    items = [(i, words_of(i, 30)) for i in range(12)]
    texts = [(i // 2 if i % 5 else None, f"{words_of(100 + i, 20)} {items[i % 12][1]} {words_of(300 + i, 10)}") for i in range(100)]
    texts += [texts[3]] * 4

    def mixed(batches):
        for some in batches:
            yield some.sample(frac=1, random_state=np.random.default_rng().integers(1 << 30))

    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1).mapInPandas(mixed, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((r.doc_id or -1, r.text_key, r.n_words, str(r.spans), list(r["items"])) for r in df.collect())
    one = rows(decontaminate.find(docs, bench))
    assert rows(decontaminate.find(docs, bench, block_chars=500)) == one
    assert len(one) == len(texts) and all(len(r[4]) == 1 for r in one)


def test_every_line_counts(spark):
    docs = spark.createDataFrame([(i, f"Home\nown words of {i} here\nHome\nBack now", f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.report(docs).collect()}
    assert got[0] == (4, 1, "Home\nown words of 0 here\nBack now")
    assert all(got[i] == (4, 3, f"own words of {i} here") for i in range(1, 20))


PASSAGE = "a passage of sixty bytes that stands on a part of all texts."


def texts_with(n, each):
    return [f"{words_of(i, 60)} {PASSAGE if i % each == 0 else ''} {words_of(10_000 + i, 60)}" for i in range(n)]


def brute(texts, least):
    seen, gone = set(), []
    for t in texts:
        raw = t.encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - least + 1):
            s = raw[k : k + least]
            if s in seen:
                hit[k : k + least] = True
            seen.add(s)
        gone.append((int(hit.sum()), hashlib.sha256(bytes(b for b, h in zip(raw, hit, strict=True) if not h)).hexdigest()))
    return gone


@pytest.mark.parametrize("shard", [200, 3000, 500_000])
def test_shards_of_any_size_find_the_same(spark, shard):
    texts = texts_with(60, 2)
    texts += [texts[3] + texts[4], texts[5][40:400], texts[8], PASSAGE * 4, ("ab" * 90) + texts[2], texts[10][:150] + texts[12][:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = substrings.removed(docs, 50, shard)
    got = {r.doc_id: (len(r.bytes) - len(r.kept), hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 50)


@pytest.mark.parametrize("each", [2, 50])
def test_no_shard_grows_with_the_documents(spark, each):
    """A passage on a half, or on a fiftieth, of all documents: the bytes of an anchor that go into one suffix array."""
    def largest(n, shard=4000):
        docs = spark.createDataFrame(list(enumerate(texts_with(n, each))), "doc long, text_ string").withColumn("text", text_key(F.col("text_")))
        packed = substrings.packed_runs(docs, 100, 4).repartition("part").sortWithinPartitions("part")
        rows = substrings.settled(packed, 100, shard).where("kind = 1").groupBy("key").agg(F.sum(F.col("after") - F.col("first")).alias("n"))
        return rows.agg(F.max("n")).first()[0] or 0

    assert largest(1000) <= 4000 and largest(6000) <= 4000


def test_names_of_any_length():
    name = "q" * 79
    assert urls.viterbi(name, {}, 1e6) == [name]
    logs = {"free": math.log(1e-4), "bets": math.log(1e-4)}
    assert urls.viterbi("z" * 100 + "freebets", logs, 1e6) == ["z" * 100, "free", "bets"]
    assert urls.viterbi("", {}, 1e6) == []
