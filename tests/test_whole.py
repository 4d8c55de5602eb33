"""Operators on inputs that reach past any prefix: every response, every character, every word counts."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import resample
from vellum.plans import answers, scores


def expected(x):
    """Metrics of one prompt, from the order of its values."""
    n, order = len(x), np.sort(x)
    out = {f"mean@{n}": np.mean(x), f"std@{n}": np.std(x)}
    i = np.arange(n)
    for k in [k for k in (2, 4, 8, 16, 32, 64, 128, 256) if k < n] + [n]:
        for end, w in (("best", ((i + 1) / n) ** k - (i / n) ** k), ("worst", ((n - i) / n) ** k - ((n - i - 1) / n) ** k)):
            mean = (w * order).sum()
            out |= {f"{end}@{k}/mean": mean, f"{end}@{k}/std": np.sqrt((w * (order - mean) ** 2).sum())}
    return out


@pytest.mark.parametrize("cell", [5, 20_000])
def test_validation_metrics(spark, monkeypatch, cell):
    """One method at every size: single responses, ties, and a prompt whose values are ranked in several cells."""
    monkeypatch.setattr(resample, "CELL", cell)
    rng = random.Random(5)
    groups = {("a", 1): 1, ("a", 2): 21, ("b", 3): 300, (None, None): 2}
    values = {g: [float(rng.randrange(30)) for _ in range(n)] for g, n in groups.items()}
    values["a", 2][-1] = 50.0
    rows = spark.createDataFrame([(s, p, v) for (s, p), x in values.items() for v in x], "s string, p long, v double").repartition(3)
    got = {(r.s, r.metric): r.value for r in resample.validation_metrics(rows, "s", "p", "v").collect()}
    each = {}
    for (s, _), x in values.items():
        for m, v in expected(x).items():
            each.setdefault((s, m), []).append(v)
    assert got == pytest.approx({k: np.mean(v) for k, v in each.items()}, abs=1e-6)
    odd = spark.createDataFrame([("a", 1, None), ("a", 1, 1.0)], "s string, p long, v double")
    assert all(np.isnan(r.value) for r in resample.validation_metrics(odd, "s", "p", "v").collect() if r.metric.startswith("mean"))
    assert resample.validation_metrics(odd.limit(0), "s", "p", "v").collect() == []


def test_majorities(spark):
    """The majority of 3 of 5 votes against all 125 samples, and of whole keys with ties."""
    votes = [("x", 1.0), ("x", 1.0), ("y", 0.0), ("z", 0.5), (None, 0.25)]
    rows = spark.createDataFrame([("k", *v) for v in votes] + [("one", "x", 3.0)], "k string, vote string, score double")
    said = []
    for sample in itertools.product(votes, repeat=3):
        names = [v for v, _ in sample]
        best = max(names, key=lambda v: (names.count(v), -names.index(v)))
        said.append(next(s for v, s in sample if v == best))
    found = resample.majorities(rows, ["k"], "vote", "score", draws=6000, sizes=lambda n: F.array(F.lit(3).cast("long"))).collect()
    by = {r[0]: r for r in found}
    assert by["k"]["mean"] == pytest.approx(np.mean(said), abs=0.02) and by["k"]["std"] == pytest.approx(np.std(said), abs=0.02)
    assert (by["one"]["mean"], by["one"]["std"]) == (3.0, 0.0)
    both = resample.validation_metrics(rows, "k", "k", "score", vote="vote", draws=50)
    assert {r.metric for r in both.where("k = 'k'").collect()} >= {"maj@2/mean", "maj@4/std", "maj@5/mean", "best@4/mean", "mean@5"}


def test_poisson_draws(spark):
    """Weights repeat, are Poisson numbers of mean 1, and independent between units and draws; the mean's spread is right."""
    units = spark.range(4000).select("id", resample.poisson_weights(F.col("id"), 40, 3).alias("w"))
    w = np.array([r.w for r in units.orderBy("id").collect()])
    assert (w == np.array([r.w for r in units.repartition(7).orderBy("id").collect()])).all()
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert (w == k).mean() == pytest.approx(share, abs=0.005)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0::2].ravel(), w[1::2].ravel())[0, 1]) < 0.02
    x = np.random.default_rng(1).normal(5, 2, 2000)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)] + [("n", 1, None)], "k string, i long, v double")
    (r,) = resample.bootstrap(rows, ["k"], "v", 800, 9, "i").collect()
    assert r.n == 2000 and r.mean == pytest.approx(x.mean())
    assert (r.high - r.low) == pytest.approx(2 * 1.96 * x.std() / 2000**0.5, rel=0.12)


def test_reduces_of_users(spark):
    rows = spark.createDataFrame([("a", i, float(i % 10)) for i in range(300)], "k string, i long, v double")
    reduces = {"most": lambda w: F.max(F.when(w > 0, F.col("v"))), "total": lambda w: F.sum(w * F.col("v"))}
    got = resample.drawn(rows, ["k"], "i", reduces, 30, 1).collect()
    assert len(got) == 30 and {r.most for r in got} == {9.0} and np.mean([r.total for r in got]) == pytest.approx(1350, rel=0.05)


def test_threshold_interval(spark):
    """Curves from 0.9 down to 0.1 with noise a unit: the interval holds the true crossing; few crossings give none."""
    rng = random.Random(2)
    rows = [("a", u, x, 1 - x / 10 + rng.gauss(0, 0.1)) for u in range(200) for x in range(1, 10)] + [("b", u, x, 0.9) for u in range(20) for x in range(1, 4)]
    rows += [("a", 900, 1, 50.0), ("a", 901, 2, None)]
    frame = spark.createDataFrame(rows, "k string, u long, x int, y double")
    got = {r.k: r for r in resample.threshold_interval(frame, ["k"], "u", "x", "y", 0.5, 200, 4).collect()}
    assert set(got) == {"a"} and got["a"].crossed == 200
    assert got["a"].low < 5 < got["a"].high and got["a"].high - got["a"].low < 0.5
    few = resample.threshold_interval(frame, ["k"], "u", "x", "y", 0.5, 40, 4).first()
    assert (few.crossed, few.low, few.high) == (40, None, None)


def test_mrcr_ratio_compares_whole_texts(spark, tmp_path):
    rng = random.Random(7)
    texts = ["", "short", *["".join(rng.choice("abcdefgh é\n") for _ in range(n)) for n in (150, 190, 900, 3000)]]
    texts += ["".join(map(chr, range(200, 1000))), "".join(map(chr, range(200, 520))) + "x" * 500, "y" * 310 + "".join(map(chr, range(200, 700)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.ratio for r in answers.mrcr_ratio(spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(SequenceMatcher(None, t, t[10:]).ratio(), abs=1e-6) for i, t in enumerate(texts)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1, *row[1:]] if not b else edits_row(row, x, b, i + 1)
    return row[-1]


def edits_row(row, x, b, first):
    out = [first]
    for j, y in enumerate(b):
        out.append(min(out[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
    return out


def test_scores_over_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    said = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(n)) for n in (1, 5, 20, 45, 150)]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(said[:4])), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    gold = "x" * 24 + " and then more"
    turns = [(1, 0, "user", gold), (1, 1, "assistant", "holds " + gold[:30]), (1, 2, "user", "q" * 40), (1, 3, "assistant", "Holds " + gold.upper())]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    cer = {r.doc_id: r.cer for r in scores.char_error_rate(spark, str(tmp_path)).collect()}
    assert cer == {i: pytest.approx(edits(t, t[10:].strip()) / max(1, len(t[10:].strip())), abs=1e-6) for i, t in enumerate(said)}
    wer = {r.item_id: (r.edits, r.wer) for r in scores.wer_hit(spark, str(tmp_path)).collect()}
    for i, t in enumerate(said[:4]):
        n = edits(t.split(" "), t.split(" ")[::-1])
        assert wer[i] == (n, pytest.approx(n / len(t.split(" ")), abs=1e-6))
    best = {r.turn: (r.n_golds, r.best) for r in scores.multi_gold_best(spark, str(tmp_path)).collect()}
    assert best == {1: (2, pytest.approx(1 / (1 + len(gold)), abs=1e-6)), 3: (2, 1.0)}
