"""Operators against independent models, and what must hold whatever the input."""

import json
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import advantage, rewards, rollup, sequences, tables
from vellum.sources import manifests, sinks
from vellum.streaming import replay


def test_group_advantages(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", 5.0)], "uid string, score double")
    got = {(r.uid, r.score): r.advantage for r in advantage.grpo(rows, "uid", "score").collect()}
    assert sum(v for (u, _), v in got.items() if u == "a") == pytest.approx(0) and got["b", 5.0] == pytest.approx(5 / (1 + 1e-6))
    assert [r.advantage for r in advantage.grpo(rows.where("uid = 'b'"), "uid", "score", singleton="zero").collect()] == [0.0]
    loo = {(r.uid, r.score): r.advantage for r in advantage.rloo(rows, "uid", "score").collect()}
    assert loo["a", 1.0] == pytest.approx(1 - 5.5) and loo["b", 5.0] == 5.0


def test_returns_and_penalties(spark):
    col = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = spark.range(1).select(
        advantage.discounted_returns(col(1, 2, 4), col(1, 0, 1), 0.5).alias("d"), advantage.remax(col(1, 2, 4), col(1, 0, 1), F.lit(1.0)).alias("r"),
        advantage.gae(col(0, 0, 1), col(0.5, 0.5, 0.5), col(1, 1, 1), 1.0, 1.0).alias("g"), advantage.adaptive_coefficient(F.lit(1.0), col(2, 0), 1.0, 10.0, 5).alias("k"),
        advantage.overlong_penalty(F.lit(95), F.lit(100), F.lit(20), 1.0).alias("o"), advantage.entropy_of(col(0, 0)).alias("e"),
    ).first()
    assert row.d == [4.0, 6.0, 4.0] and row.r == [4.0, 4.0, 3.0] and row.k == pytest.approx(1.1 * 0.9)
    assert [x.advantage for x in row.g] == pytest.approx([0.5, 0.5, 0.5]) and row.o == pytest.approx(-0.75) and row.e == pytest.approx(0.6931471805)


def test_shards_and_ranks(spark):
    for n, k in ((10, 3), (3, 7), (1, 1), (64, 8)):
        rows = spark.range(n).withColumnRenamed("id", "x")
        want = rows.selectExpr("x", f"ntile({k}) over (order by x) as shard").collect()
        assert sorted(sequences.contiguous_shards(rows, "x", k).collect()) == sorted(want)
    padded = sequences.padded_to(spark.range(3).withColumnRenamed("id", "x"), ["x"], 8).collect()
    assert len(padded) == 8 and sorted(r.x for r in padded if r.is_pad) == [0, 0, 1, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=40), st.integers(1, 6))
def test_karmarkar_karp_covers_all(lengths, parts):
    dealt = sequences.karmarkar_karp(lengths, parts, False)
    assert sorted(i for p in dealt for i in p) == list(range(len(lengths))) and len(dealt) == parts
    sums = [sum(lengths[i] for i in p) for p in dealt]
    assert max(sums) - min(sums) <= max(lengths)


def test_karmarkar_karp_equal_sizes():
    dealt = sequences.karmarkar_karp([9, 1, 8, 2, 7, 3], 2, True)
    assert [len(p) for p in dealt] == [3, 3]
    with pytest.raises(ValueError):
        sequences.karmarkar_karp([1, 2, 3], 2, True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packers_keep_all_and_fit(lengths):
    for bins in (sequences.bestfit_bins(lengths, 100, 8), sequences.length_grouped_bins(lengths, 100, 10, 500, False), sequences.length_grouped_bins(lengths, 100, 10, 500, True)):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)


def test_nextfit(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 6, 4, 11, 3])], "k string, i long, n long")
    got = {r.i: (r.pack, r.offset) for r in sequences.nextfit(rows, ["k"], "i", "n", 10, 10).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 6), 4: (2, 0)}


def test_compaction_and_resume(spark):
    rows = spark.createDataFrame([("a", 1, "bad"), ("a", 2, None), ("b", 1, "bad")], "id string, attempt int, error string")
    assert [tuple(r) for r in sinks.compacted(rows, ["id"], ["id"]).collect()] == [("a", 2, None), ("b", 1, "bad")]
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(r.id for r in sinks.still_to_do(wanted, rows, ["id"]).collect()) == ["b", "c"]


def test_union_asserts_equal_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, s string"), spark.createDataFrame([(1, "x", 2)], "id long, s string, n long")
    assert [tuple(r) for r in tables.union_columns(a, b, "id").collect()] == [(1, "x", 2)]
    with pytest.raises(Exception, match="disagree"):
        tables.union_columns(a, b.withColumn("s", F.lit("y")), "id").collect()


def test_majority_breaks_ties_by_first(spark):
    rows = spark.createDataFrame([("p", "y", 2), ("p", "x", 1), ("p", "z", 3), ("p", "x", 4), ("p", "y", 5)], "p string, v string, i long")
    assert [tuple(r) for r in rollup.majority(rows, ["p"], "v", "i").collect()] == [("p", "x", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "text_path": "t"}\n\n{"id": "b"}\nnot json\n')
    good, bad = manifests.parted(manifests.read_lines(spark, str(tmp_path / "m.jsonl"), manifests.MANIFEST).persist())
    assert sorted(r.id for r in good.collect()) == ["a", "b"] and bad.count() == 1
    (tmp_path / "d.jsonl").write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(ValueError):
        manifests.manifest(spark, str(tmp_path / "d.jsonl"))
    (tmp_path / "c.csv").write_text("id,v\n1,x\n")
    mixed = manifests.mixed(spark, [{"path": str(tmp_path / "c.csv"), "data_type": "csv", "data_folder": "f"}, {"path": str(tmp_path / "none"), "data_type": "parquet"}])
    assert [r.asDict() for r in mixed.collect()] == [{"v": "x", "data_folder": "f"}]
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest")
    assert tuple(manifests.image_sizes(spark, str(tmp_path)).select("width", "height").first()) == (640, 480)
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}}')
    (tmp_path / "own.json").write_text('{"_base_": "base.json", "a": {"y": "$HOME"}}')
    assert manifests.config(str(tmp_path / "own.json"))["a"]["x"] == 1


def test_arrow_source(spark, tmp_path):
    import pyarrow as pa

    data = pa.table({"x": [1, 2], "s": ["a", None]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_stream(f, data.schema) as w:
        w.write_table(data)
    assert [tuple(r) for r in manifests.load(spark, str(tmp_path), "arrow").collect()] == [(1, "a"), (2, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 72, None), ("b", 96, None)], "id string, dpi int, error string")
    assert sinks.fan_out(rows, str(tmp_path / "o")) == 0 and (tmp_path / "o/all/dpi=72").exists()
    assert sinks.fan_out(rows.withColumn("error", F.lit("x")), str(tmp_path / "f")) == 2 and not (tmp_path / "f/all").exists()
    with pytest.raises(ValueError):
        sinks.training_parquet(rows.limit(0), str(tmp_path / "t"))
    sinks.check_resume(spark, str(tmp_path / "r"), {"a": 1})
    sinks.check_resume(spark, str(tmp_path / "r"), {"a": 1})
    with pytest.raises(ValueError):
        sinks.check_resume(spark, str(tmp_path / "r"), {"a": 2})
    assert "| a | 72 |" in sinks.markdown(rows.select("id", "dpi"))


def test_document_reward(spark):
    call = json.dumps({"name": "zoom_region", "arguments": {"page": 1, "bbox_2d": [100, 100, 200, 200]}})
    said = f"<think>x <tool_call>{call}</tool_call></think><answer>Paris</answer>"
    rows = [(said, ["Paris"], [(1, [100.0, 100.0, 200.0, 200.0])], 3, 72.0), ("no answer", ["Paris"], [], None, None)]
    df = spark.createDataFrame(rows, "solution string, golds array<string>, evidence array<struct<page:int,box:array<double>>>, num_pages int, dpi double")
    a, b = rewards.document_reward(df).orderBy(F.desc("score")).collect()
    assert a.score == pytest.approx(1.0 + 0.2 * (10000 / 14400)) and b.score == 0.0


def test_replay_limits():
    step = replay.limits(9, 2, 100, True)
    state, seen = (0, 0, 0, False), []
    for call, n in ((True, 10), (True, 10), (False, 10), (True, 1)):
        state, status = step(state, call, n)
        seen.append(status)
    assert seen == ["running", "running", "answered", "ignored"]
    assert replay.limits(9, 2, 15, True)((1, 1, 10, False), True, 10)[1] == "token_budget" and replay.limits(2, 9, 99, True)((1, 1, 1, False), True, 1)[1] == "turn_limit"


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = replay.event_stream(spark, sf_dir, schema)
    q = replay.tumbling(stream, "40 days", "1 day").writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.table("days").agg(F.sum("n")).first()[0] == want
    write = stream.writeStream.foreachBatch(replay.rebatch_each(str(tmp_path / "b"), F.col("event_type") != "error", 64)).option("checkpointLocation", str(tmp_path / "c")).start()
    write.processAllAvailable()
    write.stop()
    kept = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'error'").count()
    assert spark.read.parquet(str(tmp_path / "b/batches")).count() == kept - kept % 64


def test_stateful_replay(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, True, 5), ("s", 1, False, 5), ("t", 0, False, 1)], "sample string, turn long, is_call boolean, tokens long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = replay.replay(stream).writeStream.format("memory").queryName("replayed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.sample, r.turn, r.status) for r in spark.table("replayed").collect()) == [("s", 0, "running"), ("s", 1, "answered"), ("t", 0, "answered")]


def test_hash_shuffle_is_stable(spark):
    a = [r.id for r in sequences.hash_shuffled(spark.range(50), "id", 3).collect()]
    b = [r.id for r in sequences.hash_shuffled(spark.range(50).repartition(7), "id", 3).collect()]
    assert a == b and sorted(a) == list(range(50)) and a != sorted(a)
    random.Random(0)


PYTHON = {"page_references", "citation_rewriting", "karmarkar_karp", "micro_batches", "best_fit_pack", "length_grouped_pack", "vec_pairs_topk", "dataset_scan", "document_reward_parts", "scores_by_source", "mrcr_ratio", "boxed_math", "remap_conversation", "document_reward", "dispatched_scores"}


def test_native_queries_have_no_python_in_their_plans(spark, sf_dir):
    from vellum.plans import catalogue

    for name, f in catalogue.queries().items():
        if name not in PYTHON:
            plan = f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert not re.search("Python|Pandas|Arrow", plan), name


def test_many_parts_take_no_more_work(spark):
    """Half as many parts as lengths: as balanced as the plain form with all parts in every partial solution, and fast."""

    def plain(lengths, parts):
        heap = [(-n, i, [n] + [0] * (parts - 1)) for i, n in enumerate(sorted(lengths))]
        serial = len(heap)
        while len(heap) > 1:
            heap.sort(key=lambda x: x[:2])
            a, b = heap.pop(0)[2], heap.pop(0)[2]
            met = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
            heap.append((met[-1] - met[0], serial := serial + 1, met))
        return heap[0][2]

    rng = random.Random(3)
    for n, parts in ((40, 20), (60, 7), (30, 30), (25, 2), (1, 3)):
        lengths = [rng.choice((rng.randint(0, 5), rng.randint(1, 900))) for _ in range(n)]
        dealt = sequences.karmarkar_karp(lengths, parts, False)
        assert [sum(lengths[i] for i in own) for own in dealt] == plain(lengths, parts) and sorted(i for own in dealt for i in own) == list(range(n))
    began = time.monotonic()
    rows = spark.range(20_000).selectExpr("'s' AS s", "id", "10000 + xxhash64(id) % 5000 AS n")
    assert sequences.micro_batches(rows, ["s"], "id", "n", 20_000).agg({"part": "max"}).first()[0] > 5000 and time.monotonic() - began < 60
