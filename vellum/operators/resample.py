"""Resampling, runs of equal values, and nearest vectors."""

from __future__ import annotations

from functools import reduce
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import rollup

#: Draws that one row makes.
DRAWS = 25
#: Rows times draws that one task weighs, about.
DRAWN = 8_000_000
#: Distinct values of large groups that are ranked in one task, about.
CELL = 20_000


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: their number in the key's order, value and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    marked = rows.withColumn("start_", start).withColumn("island", F.sum("start_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.any_value(value).alias("kind"), F.count("*").alias("n"))


#: The prime that draws are numbers below, and how many of them have at most 0, 1, 2, ... as their Poisson number of mean 1.
PRIME = 2_147_483_647
POISSON = [ceil(PRIME * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(12)]


def poisson_weights(unit: Column, draws: int, seed: int) -> Column:
    """How often a unit is in each draw: an array of Poisson numbers of mean 1, which seed, unit and draw alone decide.

    Units are independent of each other in every draw, and any two draws of a unit are; a unit's numbers are an arithmetic
    progression modulo PRIME whose start and step are digits of its md5.
    """
    a, b = progression(unit, seed)

    def weights(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: weight((s["a"] + s["b"] * d) % PRIME))

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), weights)[0]


def progression(unit: Column, seed: int) -> tuple[Column, Column]:
    """Where a unit's numbers of poisson_weights start, and their step."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string")))
    digits = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("long")
    return digits(1) % PRIME, digits(16) % (PRIME - 1) + 1


def weight(x: Column) -> Column:
    """The Poisson number of mean 1 that a draw's number below PRIME stands for."""
    return reduce(lambda rest, k: F.when(x < POISSON[k], k).otherwise(rest), reversed(range(len(POISSON))), F.lit(len(POISSON)))


def tasks(rows: DataFrame, draws: int) -> int:
    """How many tasks draw from rows, so that each makes DRAWN draws at most, about."""
    return 1 + rows.count() * draws // DRAWN


def drawn(rows: DataFrame, keys: list[str], unit: str, reduces: dict, draws: int, seed: int, parts: int | None = None) -> DataFrame:
    """keys, draw and a column a reduce function, over resampled units.

    reduces: functions of the weight column that give an aggregate, e.g. lambda w: F.sum(w * F.col("x")) / F.sum(w). Rows of one
    unit are drawn together. Weights come from hashes, so each task draws and adds up its own rows before the shuffle, and
    no task holds a group. Rows are dealt to parts (``tasks``) by ranges of keys and units first: a task meets few keys,
    however many there are in all, and a large key's rows go to several tasks. Null keys and units are values like others.
    """
    of = F.coalesce(F.col(unit).cast("string"), F.lit(""))
    a, b = progression(of, seed)
    dealt = rows.repartitionByRange(parts or tasks(rows, draws), *keys, of).withColumns({"a_": a, "b_": b})
    each = dealt.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("x_", (F.col("a_") + F.col("b_") * F.col("draw")) % PRIME)
    weighed = each.where(F.col("x_") >= POISSON[0]).withColumn("weight_", weight(F.col("x_")))
    return weighed.groupBy(*keys, "draw").agg(*[f(F.col("weight_")).alias(name) for name, f in reduces.items()])


def bootstrap(rows: DataFrame, keys: list[str], value: str, draws: int, seed: int, unit: str) -> DataFrame:
    """n, mean, and the 2.5 and 97.5 percentiles of the mean over resampled groups. Null values don't count."""
    kept = rows.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, unit, value]))
    parts = tasks(kept, draws)
    of = drawn(kept, keys, unit, {"m": lambda w: F.sum(w * F.col(value)) / F.sum(w)}, draws, seed, parts)
    # all means of a key side by side: what Spark keeps of a percentile is too large to be sent for each mean
    of = of.repartition(parts, *keys)
    ends = of.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ends, keys, "left").select(*keys, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def threshold_interval(rows: DataFrame, keys: list[str], unit: str, x: str, y: str, level: float, draws: int, seed: int, least: int = 50) -> DataFrame:
    """keys, draws that cross the level, and the 2.5 and 97.5 percentiles of where, over resampled units; percentiles are null unless
    more than ``least`` draws cross.

    rows: a unit's y at each x; units that lack an x of their key, or a y, are left out. A draw's curve is the mean over
    its units, and crosses where first_crossing says.
    """
    full = rows.where(F.col(y).isNotNull())
    xs = full.select(*keys, x).distinct().groupBy(*keys).agg(F.count("*").alias("xs_"))
    units = full.groupBy(*keys, unit).agg(F.count_distinct(x).alias("own_")).join(xs, keys).where("own_ = xs_").select(*keys, unit)
    curves = drawn(full.join(units, [*keys, unit], "left_semi"), [*keys, x], unit, {"m_": lambda w: F.sum(w * F.col(y)) / F.sum(w)}, draws, seed)
    crossed = rollup.first_crossing(curves, [*keys, "draw"], x, "m_", level)
    q = F.percentile("threshold", F.array(F.lit(0.025), F.lit(0.975)))
    found = crossed.groupBy(*keys).agg(F.count("threshold").alias("crossed"), q.alias("q"))
    return found.select(*keys, "crossed", *[F.when(F.col("crossed") > least, F.col("q")[i]).alias(n) for i, n in enumerate(("low", "high"))])


def positions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, c (how often it stands there), below (rows of the key with less), n and mean of the key's rows.

    Equal values are counted first; the distinct ones are ranked in cells of the values' range, so no task sees a whole group.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    total = counted.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    cells = min(1000, 1 + counted.count() // CELL)
    bounds = sorted(set(counted.approxQuantile(value, [i / cells for i in range(1, cells)], 0.1 / cells))) if cells > 1 else []
    splits = [-float("inf"), *[x for x in bounds if np.isfinite(x)], float("inf")]
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol=value, outputCol="cell", handleInvalid="keep").transform(counted)
    else:
        dealt = counted.withColumn("cell", F.lit(0.0))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy(*keys, "cell").agg(F.sum("c").alias("n_cell")).select(*keys, "cell", F.coalesce(F.sum("n_cell").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    both = own.join(offset, [*keys, "cell"]).join(total, keys)
    return both.select(*keys, value, "c", (F.col("offset") + F.col("own")).alias("below"), "n", "mean")


def sample_sizes(n: Column) -> Column:
    """2, 4, ... below n, and n."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda b: F.pow(F.lit(2.0), b).cast("long"))
    return F.concat(F.filter(powers, lambda k: k < n), F.array(n))


def validation_metrics(rows: DataFrame, source: str, prompt: str, value: str, vote: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """source, metric and value: mean@n, the population std@n, and mean and deviation of the best, the worst and (with vote) the
    majority of k responses drawn with replacement (k = 2, 4, ..., n), for each prompt with all its n responses and then
    averaged over the prompts of a source.

    Best and worst are the expected values that draws estimate, from order statistics, at any number of responses; the
    majority is drawn (``majorities``). A null or NaN value makes a prompt's measures NaN.
    """
    rows = rows.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))
    # nulls are keys like others, which joins of plain columns wouldn't match
    boxed = rows.select(F.struct(F.col(source).alias("source"), F.col(prompt).alias("prompt")).alias("key_"), value, *([vote] if vote else []))
    at = positions(boxed, ["key_"], value)
    y, share, k = F.col(value) - F.col("mean"), lambda m: m / F.col("n"), F.col("k")
    pair = lambda name, v: F.struct(name.alias("metric"), v.alias("v"))
    n = F.any_value("n")
    whole = at.groupBy("key_").agg(n.alias("n"), F.any_value("mean").alias("mean"), F.sqrt(F.sum(y * y * F.col("c")) / F.sum("c")).alias("std"))
    of_all = whole.select("key_", F.inline(F.array(pair(F.concat(F.lit("mean@"), "n"), F.col("mean")), pair(F.concat(F.lit("std@"), "n"), F.col("std")))))
    at_k = at.withColumn("k", F.explode(sample_sizes(F.col("n"))))
    best = F.pow(share(F.col("below") + F.col("c")), k) - F.pow(share(F.col("below")), k)
    worst = F.pow(share(F.col("n") - F.col("below")), k) - F.pow(share(F.col("n") - F.col("below") - F.col("c")), k)
    sums = at_k.groupBy("key_", "k").agg(F.any_value("mean").alias("mean"), *[F.sum(f * w).alias(a) for a, f, w in (("b1", y, best), ("b2", y * y, best), ("w1", y, worst), ("w2", y * y, worst))])
    ends = lambda end, one, two: [
        pair(F.concat(F.lit(f"{end}@"), k, F.lit("/mean")), F.col("mean") + F.col(one)),
        pair(F.concat(F.lit(f"{end}@"), k, F.lit("/std")), F.sqrt(F.greatest(F.col(two) - F.col(one) * F.col(one), F.lit(0.0)))),
    ]
    per = of_all.unionByName(sums.select("key_", F.inline(F.array(*ends("best", "b1", "b2"), *ends("worst", "w1", "w2")))))
    if vote:
        votes = majorities(boxed.withColumnRenamed("key_", "key"), ["key"], vote, value, draws, seed)
        per = per.unionByName(votes.select(F.col("key").alias("key_"), F.inline(F.array(*[pair(F.concat(F.lit("maj@"), "sample_size", F.lit(f"/{c}")), F.col(c)) for c in ("mean", "std")]))))
    return per.groupBy(F.col("key_.source").alias(source), "metric").agg(F.avg("v").alias("value"))


def majorities(rows: DataFrame, keys: list[str], vote: str, value: str, draws: int = 1000, seed: int = 42, sizes=sample_sizes) -> DataFrame:
    """keys, sample_size (k), and mean and deviation, over ``draws`` samples of k rows of a key, of the value of the sample's commonest vote.

    Draws are with replacement and come from hashes of key, draw and place, so a rerun repeats them. Votes that tie go to the
    one drawn first, and of a vote's values the one drawn first counts. sizes: the k of a key of n rows. A key's rows are one
    array of small numbers, sent to the tasks that make some of its draws each; places are drawn and counted there.
    """
    own = rows.select(F.struct(*keys).alias("key_"), F.col(vote).alias("vote_"), F.col(value).alias("value_"))
    kinds = own.groupBy("key_", "vote_", "value_").agg(F.count("*").alias("m")).withColumn("vote_", F.dense_rank().over(Window.partitionBy("key_").orderBy(F.asc_nulls_first("vote_"))).cast("long"))
    held = kinds.groupBy("key_").agg(F.sum("m").alias("n"), F.sort_array(F.collect_list(F.struct("vote_", "value_", "m"))).alias("kinds"))
    seats = F.flatten(F.transform("kinds", lambda x, i: F.array_repeat(i, x["m"].cast("int"))))
    asked = held.select("key_", "n", seats.alias("seats"), F.transform("kinds", lambda x: x["vote_"]).alias("votes"), F.transform("kinds", lambda x: x["value_"]).alias("values"), F.explode(sizes(F.col("n"))).alias("k"))
    asked = asked.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(DRAWS))))
    # few bytes, but much work: Spark may not put these parts together
    asked = asked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key_", "k", "first")
    seat = lambda draw, place: F.get("seats", F.pmod(F.xxhash64("key_", "k", draw, place, F.lit(seed)), F.col("n")).cast("int"))
    shift = 1 << 32

    low = lambda x: x.bitwiseAND(F.lit(shift - 1))

    def longest(s: Column, x: Column) -> Column:
        # the first of a run of equal votes, its length so far, and the best run: its length, then what its first place lacks to the last
        same = F.call_function("shiftright", s["head"], F.lit(32)) == F.call_function("shiftright", x, F.lit(32))
        head, times = F.when(same, s["head"]).otherwise(x), F.when(same, s["times"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(head.alias("head"), times.alias("times"), F.greatest(s["best"], times * F.lit(shift) + F.lit(shift - 1) - low(head)).alias("best"))

    def won(draw: Column) -> Column:
        # votes with the places where they were drawn, equal votes side by side
        drawn_ = F.sort_array(F.transform(F.sequence(F.lit(1).cast("long"), "k"), lambda p: F.get("votes", seat(draw, p)) * F.lit(shift) + p))
        zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("head", "times", "best")])
        return F.get("values", seat(draw, F.lit(shift - 1) - low(F.aggregate(drawn_, zero, longest)["best"])))

    found = asked.select("key_", "k", F.explode(F.transform(F.sequence("first", F.least(F.col("first") + DRAWS - 1, F.lit(draws))), won)).alias("v"))
    return found.groupBy("key_", "k").agg(F.avg("v").alias("mean"), F.when(F.min("v") == F.max("v"), F.min("v") - F.max("v")).otherwise(F.stddev_pop("v")).alias("std")).select(*[F.col(f"key_.{c}").alias(c) for c in keys], F.col("k").alias("sample_size"), "mean", "std")


def nearest(rows: DataFrame, key: str, vector: str, queries: Column, k: int, block: int = 512) -> DataFrame:
    """The k rows of largest cosine for each query row: a stated query set, sent to all rows, against all of them.

    Each task keeps the best of what it has seen; only these meet in the end. A task compares ``block`` queries with four
    times as many rows at once, so that what it holds beside the queries and their best doesn't grow with them. The queries
    must fit in memory.
    """
    asked = rows.where(queries).select(key, vector)
    ids, matrix = [], []
    for i, v in asked.orderBy(key).toLocalIterator():
        ids.append(i)
        matrix.append(v)
    q = np.array(matrix, float).reshape(len(ids), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    sent = rows.sparkSession.sparkContext.broadcast((np.array(ids), q))

    def run(batches):
        own, unit = sent.value
        best = np.full((len(own), k), -np.inf)
        ids_ = np.zeros((len(own), k), np.int64)
        for batch in batches:
            for first in range(0, len(batch), 4 * block):
                some = batch.iloc[first : first + 4 * block]
                v = np.stack(some[vector].to_numpy()).astype(float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                others = some[key].to_numpy()
                for at in range(0, len(own), block):
                    part = slice(at, at + block)
                    cosine = (unit[part] @ v.T).round(6)
                    cosine[own[part, None] == others] = -np.inf
                    # all that may be among the best: as good as the k-th, ties included
                    least = np.partition(cosine, -k, axis=1)[:, -k] if cosine.shape[1] > k else np.full(len(cosine), -np.inf)
                    least = np.maximum(least, best[part, -1])
                    q, o = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))
                    q_all = np.concatenate([q, np.repeat(np.arange(len(cosine)), k)])
                    c_all, i_all = np.concatenate([cosine[q, o], best[part].ravel()]), np.concatenate([others[o], ids_[part].ravel()])
                    order = np.lexsort((i_all, -c_all, q_all))
                    starts = np.searchsorted(q_all[order], np.arange(len(cosine)))
                    chosen = order[starts[:, None] + np.arange(k)]
                    best[part], ids_[part] = c_all[chosen], i_all[chosen]
        for at in range(0, len(own), block):
            part = slice(at, at + block)
            there = best[part] > -np.inf
            yield pd.DataFrame({key: np.repeat(own[part], k)[there.ravel()], "other": ids_[part][there], "cosine": best[part][there]})

    found = rows.select(key, vector).mapInPandas(run, f"{key} long, other long, cosine double") if ids else rows.select(F.col(key), F.col(key).alias("other"), F.lit(0.0).alias("cosine")).limit(0)
    w = Window.partitionBy(key).orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k).drop("rank_")
