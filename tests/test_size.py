"""Plans and results that must not depend on how large tables are or on how they lie in files."""

import hashlib
import random
import re
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vellum.functions import grading, text
from vellum.operators import batches, resample, sequences, streams
from vellum.plans import records
from vellum.sources import manifests, sinks


def test_streams_are_not_broadcast(spark):
    """A row per character is far larger than the table it comes from, which Spark takes for its size."""
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit(0).alias("page"), F.lit(0).alias("i"), F.concat(F.lit("some text "), F.col("id")).alias("t"))
    source, target = (streams.letters(df, "k", "page", "i", "t") for df in (rows, rows.where("k <> 3")))
    found = streams.differences(source, target, "k", block=4)
    pairs = streams.paired(source, target, "k", found)
    for df in (found, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.n_source, r.n_target, r.identical, r.first_difference) for r in found.collect()}
    assert got == {k: (9 + (k > 9), 0, False, 0) if k == 3 else (9 + (k > 9), 9 + (k > 9), True, None) for k in range(20)}
    assert pairs.count() == sum(9 + (k > 9) for k in range(20) if k != 3)


def test_ranks_over_parts_that_are_put_together(spark):
    """Enough rows that Spark puts small parts together, but not in the same way in each use of them."""
    n = 300_000
    rows = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("id"), F.expr("repeat(uuid(), 20)").alias("wide"), (F.col("id") % 50).alias("x"))
    for conf in ("200000", "64000000"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", conf)
        at = sequences.ranked(rows, ["id"], "rank")
        assert at.where("rank <> id OR total_ <> 300000 OR x < 0").count() == 0
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_shuffled_epochs_of_places_with_gaps(spark):
    """Rows of some places alone: every epoch's ranks begin at 0."""
    rows = spark.range(0, 40).where("id % 3 > 0")
    got = batches.minibatches(rows, "id", 4, 3, 40, seed=1).select("epoch", (F.col("step") * 4 + F.col("slot")).alias("at")).collect()
    assert sorted((r.epoch, r["at"]) for r in got) == [(e, i) for e in range(3) for i in range(26)]


def test_rows_are_numbered_over_all_files(spark, tmp_path):
    """Row numbers go on from file to file, in the order of their paths."""
    for k, n in (("b", 3), ("a", 5), ("c", 0), ("d", 2)):
        spark.range(n).select(F.lit(k).alias("k"), "id").coalesce(1).write.parquet(str(tmp_path / f"t/part={k}"))
    got = manifests.numbered_over(spark, str(tmp_path / "t"), ["k", "id"]).orderBy("source_row").collect()
    assert [(r.k, r.id, r.source_row) for r in got] == [("a", i, i) for i in range(5)] + [("b", i, 5 + i) for i in range(3)] + [("d", i, 8 + i) for i in range(2)]


def test_digest_of_all_texts(spark):
    """Texts in order, over many parts; and none."""
    rows = spark.range(0, 2400, 1, 16).select("id", F.expr("repeat(cast(id % 10 AS string), 1000)").alias("t"), F.lit(2).alias("n"))
    want = hashlib.md5()
    for i in range(2400):
        want.update((("," if i else "") + str(i % 10) * 1000).encode())
    assert sinks.digest_of_all(rows, "t", "id", "n").collect() == [(4800, want.hexdigest())]
    assert sinks.digest_of_all(rows.limit(0), "t", "id", "n").collect() == [(0, None)]


def test_edits_of_like_and_unlike_texts(spark):
    """As the plain distance, whatever the texts have in common; long texts that are alike in little time."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abé😀 ") for _ in range(n))
    pairs = [(some(rng.randint(0, 12)), some(rng.randint(0, 12))) for _ in range(150)]
    pairs += [(a + b + c, a + d + c) for a, b, c, d in ([some(rng.randint(0, 9)) for _ in range(4)] for _ in range(150))]
    pairs += [(x := some(200), x), ("", ""), ("", "ab"), (some(150), some(90)), ("ab" * 40, "ba" * 41), (None, "a"), ("a", None)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert rows.select(text.char_edits(F.col("a"), F.col("b")).alias("got"), F.levenshtein("a", "b").alias("want")).where("NOT (got <=> want)").count() == 0
    began = time.monotonic()
    long = spark.range(8).select(F.concat(F.expr("repeat('lorem ipsum ', 12000)"), F.col("id")).alias("a"))
    assert {r[0] for r in long.select(text.char_error_rate(F.col("a"), F.substr("a", F.lit(11)))).collect()} == {10 / 143_991} and time.monotonic() - began < 60


def test_majorities_draw_places_in_rows(spark):
    """As drawn one by one in Python, nulls and ties included; no row a place is made."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(g, rng.choice(["a", "b", "c", None]), float(rng.randint(0, 3))) for g in (1, 2, None) for _ in range(9)], "g int, vote string, v double")
    found = resample.majorities(rows, ["g"], "vote", "v", draws=60, seed=3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    places = spark.range(1, 61).select(F.col("id").cast("int").alias("draw")).crossJoin(rows.select(F.struct("g").alias("key")).distinct()).crossJoin(spark.createDataFrame([(2,), (4,), (8,), (9,)], "k long"))
    places = places.select("key", "k", "draw", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("p")).withColumn("at", F.pmod(F.xxhash64("key", "k", "draw", "p", F.lit(3)), F.lit(9)))
    own = {}
    for r in rows.collect():
        own.setdefault(r.g, []).append((r.vote, r.v))
    drawn = {}
    for r in places.orderBy("p").collect():
        ordered = sorted(own[r.key.g], key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        drawn.setdefault((r.key.g, r.k), {}).setdefault(r.draw, []).append(ordered[r["at"]])
    for r in found.collect():
        won = []
        for seen in drawn[r.g, r.sample_size].values():
            votes = [x for x, _ in seen]
            won.append(max(seen, key=lambda x: (votes.count(x[0]), -votes.index(x[0])))[1])
        assert len(won) == 60 and abs(r["mean"] - sum(won) / 60) < 1e-9
    assert found.count() == 12


def test_nearest_of_many_queries(spark):
    """Blocks of queries and of rows give what all at once would."""
    rows = spark.range(900).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.xxhash64("id", i) % 1000).cast("float")).alias("v")).repartition(3)
    want = resample.nearest(rows, "id", "v", F.col("id") % 3 == 0, 4).collect()
    got = resample.nearest(rows, "id", "v", F.col("id") % 3 == 0, 4, block=7).collect()
    assert len(got) == 1200 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_draws_of_many_keys_are_dealt(spark, monkeypatch):
    """Rows that lie in one part are drawn in as many tasks as they need, large keys too, with the weights of poisson_weights."""
    monkeypatch.setattr(resample, "DRAWN", 4000)
    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 3 > 0, F.col("id") % 400).alias("k"), "id", (F.col("id") % 7).cast("double").alias("v"))
    found = resample.drawn(rows, ["k"], "id", {"total": lambda w: F.sum(w * F.col("v")), "n": F.count}, 20, 5)
    assert re.search(r"rangepartitioning\(.*, 16\)", found._jdf.queryExecution().executedPlan().toString())
    each = rows.select("k", "v", F.posexplode(resample.poisson_weights(F.col("id"), 20, 5)).alias("draw", "w")).where("w > 0").collect()
    want = {}
    for r in each:
        total, n = want.get((r.k, r.draw), (0, 0))
        want[r.k, r.draw] = total + r.w * r.v, n + 1
    assert {(r.k, r.draw): (r.total, r.n) for r in found.collect()} == want
    ends = resample.bootstrap(rows, ["k"], "v", 20, 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\d+L, 16\), REPARTITION", ends)


def test_parts_of_rewards_are_found_in_little_time(spark, sf_dir):
    """Marks and calls as patterns find them, long white space too; one box or evidence as the Hungarian algorithm has it; parts of few bytes stay apart."""
    rng = random.Random(6)
    end, call = re.compile(r"(?:\s*<\|(?:im_end|endoftext)\|>)+\s*$"), re.compile(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>")
    pieces = ["<|im_end|>", "<|endoftext|>", " ", "\n", "\u2003", "x", "<|", "<tool_call>", "</tool_call>", '{"a": 1}', '{"a": 1} 2', "[1]", "NaN", "{"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert grading.without_end(t) == end.sub("", t), t
        found = [c for b in call.findall(t) if b == '{"a": 1}' and (c := {"a": 1})]
        assert grading.tool_calls(t) == (found, t.count("<tool_call>") - len(found)), t
    began = time.monotonic()
    assert grading.final_answer("<answer>a</answer>" + " " * 200_000 + "<|im_end|>") == "a" and grading.final_answer("a" + " " * 200_000 + "b") == "" and time.monotonic() - began < 5
    for w in ([[0.25], [0.5], [0.5]], [[0.0, 0.125, 0.0]], [[0.0]]):
        padded = [[*row, 0.0] for row in w] + [[0.0] * (len(w[0]) + 1)]
        assert grading.assigned(w) == grading.assigned(padded)
    assert "REPARTITION_BY_NUM" in records.document_reward_parts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_ratio_of_long_texts(monkeypatch):
    """The blocks that difflib finds, in short texts by ranks too; a long text in little time."""
    rng = random.Random(3)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for short in (0, grading.SHORT):
        monkeypatch.setattr(grading, "SHORT", short)
        for _ in range(200):
            letters = rng.choice(["ab", "abcdefgh ", "".join(map(chr, range(200, 900))), "aé😀xyz \n"])
            a = some(letters, rng.choice([0, 1, 5, 30, 199, 230, 600]))
            b = rng.choice([a[10:], some(letters, rng.choice([0, 3, 50, 220])), "".join(c for c in a if rng.random() > 0.05) + a[:40]])
            assert grading.Matcher(a, b).get_matching_blocks() == SequenceMatcher(None, a, b).get_matching_blocks()
    long = "".join(rng.choices("etaoinsr " * 10 + "".join(map(chr, range(200, 230))), k=200_000))
    began = time.monotonic()
    assert grading.prefixed_ratio("k " + long, "k " + long[10:], "k ") > 0.9999 and time.monotonic() - began < 4
