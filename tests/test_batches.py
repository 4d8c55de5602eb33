"""Batches, prompts, step measures and scorers of users."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import messages, prompts
from vellum.operators import batches, measures, rewards


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_columns(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "i int, x string, y_dpi72 double")
    assert batches.selected(rows, ["x", "none"], strict=False).columns == ["x"]
    with pytest.raises(ValueError):
        batches.selected(rows, ["none"])
    rest, out = batches.popped(rows, ["x"], ["i"])
    assert rest.columns == ["i", "y_dpi72"] and out.columns == ["i", "x"]
    assert batches.renamed(rows, "x", "z").columns == ["i", "z", "y_dpi72"] and batches.pruned(rows, r"_dpi\d+").columns == ["i", "x"]
    for bad in (("x", ["a", "b"]), ("none", "a")):
        with pytest.raises(ValueError):
            batches.renamed(rows, *bad)


def test_folds(spark):
    rows = spark.range(12).select((11 - F.col("id")).alias("i"), F.col("id").alias("v"))
    folds = batches.folded(rows, "i", 3, 12)
    assert [[x.v for x in r["items"]] for r in folds.orderBy("fold").collect()] == [[11, 10, 9, 8], [7, 6, 5, 4], [3, 2, 1, 0]]
    assert sorted(map(tuple, batches.unfolded(folds).collect())) == sorted((11 - v, v) for v in range(12))
    with pytest.raises(ValueError):
        batches.folded(rows, "i", 5, 12)
    items = F.array(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")), F.struct(F.lit(2).alias("a"), F.lit("y").alias("b")))
    assert one(spark, batches.columns_of(items, ["a", "b"])).asDict() == {"a": [1, 2], "b": ["x", "y"]}
    assert [tuple(x) for x in one(spark, batches.items_of(batches.columns_of(items, ["a", "b"]), ["a", "b"]))] == [(1, "x"), (2, "y")]


def test_rows(spark):
    rows = spark.createDataFrame([(i, "t" if i % 2 else "u", 4096 if i < 6 else None) for i in range(10)], "place int, task string, ruler_length int")
    assert [r.place for r in batches.chosen(rows, "place", ["t"], 4096, 1, 1).collect()] == [3]
    assert [r.place for r in batches.chosen(rows, "place", skip=8).collect()] == [8, 9]
    assert sorted(map(tuple, batches.sliced(rows.select("place", F.col("place").alias("was")), "place", -7, None, 3, 10).collect())) == [(0, 3), (1, 6), (2, 9)]
    order = spark.createDataFrame([(3, 0), (3, 1), (0, 2)], "place int, new_place int")
    assert sorted((r.place, r.task) for r in batches.reordered(rows, order, "place").collect()) == [(0, "t"), (1, "t"), (2, "u")]
    cer = spark.createDataFrame([(None, 1.7), (True, 0.2), (False, 0.1), (True, None)], "ok boolean, cer double")
    assert sorted(r.cer for r in batches.calibrated(cer).collect()) == [0.2, 1.0]
    assert [r.place for r in batches.by_bin(rows, ["u", "t"], "task", "place").collect()] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    mixed = batches.minibatches(rows.select("place"), "place", 5, 2, 10, seed=3).collect()
    assert all(sorted(r.place for r in mixed if r.epoch == e) == list(range(10)) and {(r.step, r.slot) for r in mixed if r.epoch == e} == {(s, t) for s in (0, 1) for t in range(5)} for e in (0, 1))
    assert [r.place for r in batches.sample_of_generations(rows, ["place"], 3).collect()] == [r.place for r in batches.sample_of_generations(rows.repartition(4), ["place"], 3).collect()]


def test_prompts(spark):
    split = one(spark, prompts.split_template(F.lit("Read {context} now: {input}"), F.lit("why?")))
    assert tuple(split) == ("Read ", " now: why?")
    with pytest.raises(Exception, match="no slot"):
        one(spark, prompts.split_template(F.lit("x"), F.lit("y")))
    for task, (head, _) in prompts.RETRIEVAL.items():
        end = {"mk_niah_basic": "\nWhat is the special magic number for x?", "qa_easy": "\n\nQuestion: x", "mv_niah_hard": "\n\nPlease copy the 3rd (1 indexed) Question 7 from the context."}.get(task)
        if end:
            got = one(spark, prompts.split_retrieval(F.lit(task), F.lit(head + "hay\nstack" + end)))
            assert tuple(got) == (head, "hay\nstack", end, None)
            assert one(spark, prompts.split_retrieval(F.lit(task), F.lit(head + end))).problem == "nothing_between"
    assert one(spark, prompts.without_number_stem(F.lit("Q?  The special magic numbers for a-b mentioned in the provided text are "))) == "Q?"
    assert [tuple(x) for x in one(spark, prompts.paged_prompt(F.array(F.lit("1.png")), F.lit(""), F.lit("end")))] == [("text", "Page 1\n"), ("image", "1.png"), ("text", "end")]
    assert [one(spark, prompts.rooted(F.lit(p), "/root", "/old/")) for p in ("a/b", "/old/c", "/older/d")] == ["/root/a/b", "/root/c", "/older/d"]
    assert one(spark, prompts.run_label(F.lit("x/results_m-1/"), "p")) == "m-1" and one(spark, prompts.run_label(F.lit("x/results"), "p")) == "p"
    assert one(spark, prompts.frames(F.lit(300), F.lit(30.0), 2.0, 4, 768, 2)) == 20
    tools = lambda own, on: one(spark, prompts.tools_of(own, F.lit(on).cast("boolean"), F.array(F.lit("d"))))
    assert tools(F.array(F.lit("o")), None) == ["o"] and tools(F.array().cast("array<string>"), True) == ["d"] and tools(F.array(F.lit("o")), False) is None


def test_masks_and_measures(spark):
    ones = F.array(*[F.lit(1)] * 6)
    assert one(spark, messages.supervised_mask(ones, F.lit(3), F.lit(2))) == [0, 0, 1, 1, 0, 1] and one(spark, messages.supervised_mask(ones, F.lit(1), F.lit(9))) == [1, 1, 1, 1, 1, 0]
    assert one(spark, messages.unpadded(F.array(F.lit(7), F.lit(8)), F.array(F.lit(0), F.lit(1)))) == [8] and one(spark, messages.multiple(F.lit(9), 4)) == 12
    assert one(spark, messages.response_mask(F.lit(None).cast("array<int>"), ones, F.lit(2))) == [1, 1]
    rows = spark.createDataFrame([(10, 4), (20, 6)], "prompt_length int, response_length int")
    got = measures.timing(rows, {"gen": 2.0, "ref": 4.0, "step": 8.0}, 2).first().asDict()
    assert got["timing_per_token_ms/gen"] == 200.0 and got["timing_per_token_ms/ref"] == 100.0 and got["perf/throughput"] == 2.5 and "timing_per_token_ms/step" not in got
    assert measures.mean_by_metric(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "metric string, value double")).first().value == 2.0
    bad = spark.createDataFrame([(1, [1, 2], [1])], "tool_cnt int, agent_prompt_lengths array<bigint>, agent_response_lengths array<bigint>")
    with pytest.raises(Exception, match="differ in number"):
        measures.agent_turns(bad).collect()


def test_scorers_of_users(spark, tmp_path):
    (tmp_path / "s.py").write_text("plain = True\ndef near(p, g, by=0):\n    return {'score': float(abs(len(p) - len(g)) <= by)}\n")
    (tmp_path / "c.py").write_text("def same(p, g):\n    return (p == g).cast('double')\n")
    rows = spark.createDataFrame([("ab", "c"), ("abc", "d"), ("d", "d")], "p string, g string")
    near, same = rewards.load_scorer(str(tmp_path / "s.py"), "near", by=1), rewards.load_scorer(str(tmp_path / "c.py"), "same")
    assert [tuple(r) for r in rows.select(near(F.col("p"), F.col("g")), same(F.col("p"), F.col("g"))).collect()] == [(1.0, 0.0), (0.0, 0.0), (1.0, 1.0)]
    with pytest.raises(FileNotFoundError):
        rewards.load_scorer(str(tmp_path / "none.py"), "x")
    with pytest.raises(AttributeError):
        rewards.load_scorer(str(tmp_path / "c.py"), "none")
