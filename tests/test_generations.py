"""Training-set readers, majority votes and the rest of the score layer that no SQL covers."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.operators import scoring
from vellum.sources import training


def write(spark, tmp_path, name, rows, schema):
    path = (tmp_path / name).as_uri()
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


def test_readers(spark, tmp_path):
    a = write(spark, tmp_path, "a", [("p1", "r1", 5), ("p2", "r2", 50)], "prompt string, response string, n int")
    b = write(spark, tmp_path, "b", [("p3", "r3")], "prompt string, response string")
    assert [r.prompt for r in training.rollouts(spark, [a, b], "n", 10).orderBy("prompt").collect()] == ["p1", "p3"]
    assert training.files(spark, a).count() == 2
    deep = write(spark, tmp_path, "deep", [({"q": "x"}, [{"a": "y"}])], "extra struct<q:string>, reply array<struct<a:string>>")
    row = training.supervised(spark, deep, "extra", "reply", ["q"], []).first()
    assert row.prompt == "x" and row.response[0].a == "y"
    chats = write(spark, tmp_path, "chats", [([("user", "q"), ("assistant", "a")],)], "messages array<struct<role:string,content:string>>")
    assert [tuple(m) for m in training.conversations(spark, chats).first().messages] == [("user", "q"), ("assistant", "a")]
    none = write(spark, tmp_path, "none", [([],)], "messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="no turns"):
        training.conversations(spark, none).collect()
    pairs = training.preferences(spark, write(spark, tmp_path, "pairs", [("q", "good", "bad")], "prompt string, chosen string, rejected string"))
    assert sorted(map(tuple, training.stacked(pairs).collect())) == [("q", "bad", False), ("q", "good", True)]
    judged = write(spark, tmp_path, "judged", [(["r0", "r1"], "s", ("rule", ["g"]))], "responses array<string>, data_source string, reward_model struct<style:string,ground_truth:array<string>>")
    assert [(r.place, r.response, r.ground_truth) for r in training.evaluations(spark, judged).orderBy("place").collect()] == [(0, "r0", ["g"]), (1, "r1", ["g"])]


def test_rollout_rows_take_the_first_page_columns(spark):
    turns = "array<struct<from:string,value:string,role:string,content:string>>"
    rows = spark.createDataFrame(
        [(1, "a", [("human", "q", None, None), ("gpt", "x", None, None)], [" g ", ""], [], ["l1"], "h1"), (2, "b", [(None, None, "system", "s"), ("human", "q", None, None)], ["g"], ["t1"], ["l1"], "")],
        f"index int, id string, conversations {turns}, gold array<string>, images_72dpi array<string>, images array<string>, image_dpi144 string",
    )
    a, b = training.rollout_rows(rows, "s", "e", "SYS", "!").orderBy("extra_info.index").collect()
    assert [tuple(m) for m in a.prompt] == [("system", "SYS"), ("user", "q!")] and a.images == ["l1"] and a.high_res_images == ["h1"] and a.reason is None
    assert (a.extra_info.dpi, a.extra_info.high_res_dpi, a.extra_info.gold, a.reward_model.ground_truth) == (None, 144.0, ["g"], ["g"])
    assert [tuple(m) for m in b.prompt] == [("system", "SYS\n\ns"), ("user", "q!")] and b.reason == "no page pairs" and b.extra_info.dpi == 72.0


def test_majority_against_its_expectation(spark):
    votes = [("g", v, s) for v, s, n in (("a", 1.0, 6), ("b", 0.0, 3), ("c", 0.5, 1)) for _ in range(n)] + [("one", "z", 0.25)]
    rows = spark.createDataFrame(votes, "k string, vote string, score double")
    got = {r.k: r for r in scoring.majority_at(rows, ["k"], "vote", "score", 3, draws=4000).collect()}
    assert got["one"].maj_at_3_mean == 0.25 and got["one"].maj_at_3_std == 0.0
    # all sequences of three votes by their probability; of three different ones the first counts
    chance, value = {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 1.0, "b": 0.0, "c": 0.5}
    mean = square = 0.0
    for x in chance:
        for y in chance:
            for z in chance:
                winner = y if y == z else x
                p = chance[x] * chance[y] * chance[z]
                mean += p * value[winner]
                square += p * value[winner] ** 2
    assert got["g"].maj_at_3_mean == pytest.approx(mean, abs=0.03) and got["g"].maj_at_3_std == pytest.approx(math.sqrt(square - mean**2), abs=0.03)


def test_reasoning_and_finite_means(spark):
    rows = spark.createDataFrame([("said", None, "1.5"), ("", "<THINK> in raw </think> x", "NaN"), (None, None, "x"), (None, "none", "Infinity")], "native string, raw string, v string")
    assert [r[0] for r in rows.select(scoring.reasoning_of(F.col("native"), F.col("raw"))).collect()] == ["said", "in raw", "", ""]
    assert rows.agg(scoring.finite_mean(F.expr("try_cast(v AS double)"))).first()[0] == 1.5
