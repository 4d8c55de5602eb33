"""Advantages, returns, penalties and losses over recorded rollouts.

Scores are one a response; token series are arrays in a row, or a row a token. Group statistics are windows over the
group's key; whitening takes moments of the whole batch as a one-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8


def grpo(rows: DataFrame, uid: str, score: str, epsilon: float = 1e-6, by_std: bool = True, singleton: str = "raw") -> DataFrame:
    """rows with advantage: (score - mean) / (std + epsilon) in the group of uid, with the sample deviation.

    A group of one keeps its raw score over 1 + epsilon (mean 0, deviation 1), or gets 0 with singleton="zero".
    """
    w = Window.partitionBy(uid)
    n, s = F.count("*").over(w), F.col(score)
    mean = F.when(n == 1, F.lit(0.0) if singleton == "raw" else s).otherwise(F.avg(score).over(w))
    spread = F.when(n == 1, F.lit(1.0)).otherwise(F.stddev_samp(score).over(w))
    return rows.withColumn("advantage", (s - mean) / (spread + epsilon) if by_std else s - mean)


def rloo(rows: DataFrame, uid: str, score: str) -> DataFrame:
    """rows with advantage: the score less the mean of the group's others; a group of one keeps its score."""
    w = Window.partitionBy(uid)
    n, s = F.count("*").over(w), F.col(score)
    return rows.withColumn("advantage", F.when(n == 1, s).otherwise((s - F.avg(score).over(w)) * n / F.nullif(n - 1, F.lit(0))))


def masked_moments(rows: DataFrame, value: Column, mask: Column) -> DataFrame:
    """One row: mean and unbiased variance of the values where mask is 1."""
    n = F.sum(mask)
    mean = F.sum(value * mask) / (n + EPSILON)
    square = F.sum(value * value * mask) / (n + EPSILON)
    biased = square - 2 * mean * mean + mean * mean * n / (n + EPSILON)
    return rows.agg(mean.alias("mean_"), (biased * n / (n - 1)).alias("var_"))


def whitened(rows: DataFrame, value: str, mask: str, name: str, shift: bool = True) -> DataFrame:
    """rows with name: the values less their mean, over their deviation. The moments are one row, sent to all tasks."""
    moments = masked_moments(rows, F.col(value), F.col(mask))
    scaled = (F.col(value) - F.col("mean_")) / F.sqrt(F.col("var_") + EPSILON)
    return rows.join(F.broadcast(moments)).withColumn(name, scaled if shift else scaled + F.col("mean_")).drop("mean_", "var_")


def rfpp_baseline(rows: DataFrame, uid: str, score: str, mask: str) -> DataFrame:
    """rows with advantage: the score less the group's mean (0 for a group of one), whitened over the batch's tokens."""
    w = Window.partitionBy(uid)
    mean = F.when(F.count("*").over(w) == 1, F.lit(0.0)).otherwise(F.avg(score).over(w))
    return whitened(rows.withColumn("centred_", F.col(score) - mean), "centred_", mask, "advantage").drop("centred_")


def reverse_fold(series: Column, zero: Column, step) -> Column:
    """An array whose entry t is the state after step(state, entry) from the end to t."""
    merged = F.aggregate(F.reverse(series), F.array(zero), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))
    return F.reverse(F.slice(merged, F.lit(2), F.size(series)))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reward plus the discounted return of what follows; masked tokens don't discount."""
    both = F.zip_with(rewards, mask, lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m")))
    return reverse_fold(both, F.lit(0.0), lambda g, x: x["r"] + (x["m"] * gamma + 1 - x["m"]) * g)


def remax(rewards: Column, mask: Column, baseline: Column) -> Column:
    """Masked rewards from each token to the end, less the baseline on unmasked tokens."""
    both = F.zip_with(rewards, mask, lambda r, m: F.struct((r * m).cast("double").alias("r"), m.cast("double").alias("m")))
    sums = reverse_fold(both, F.lit(0.0), lambda g, x: x["r"] + g)
    return F.zip_with(sums, mask, lambda s, m: s - baseline * m)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """array of struct(advantage, ret): generalised advantages, not whitened, that skip masked tokens, and returns of the rewards."""
    zipped = F.transform(
        F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")),
        lambda x: F.struct(x["r"].cast("double").alias("r"), x["v"].cast("double").alias("v"), x["m"].cast("double").alias("m")),
    )
    zero = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in (("advantage", 0), ("ret", 0), ("next", 0), ("v", 0), ("m", 1))])

    def step(s: Column, x: Column) -> Column:
        after = (1 - s["m"]) * s["next"] + s["m"] * s["v"]
        g, k = x["m"] * gamma + 1 - x["m"], x["m"] * lam + 1 - x["m"]
        delta = (x["r"] + g * after - x["v"]) * x["m"]
        return F.struct(
            (delta + g * k * s["advantage"]).alias("advantage"), (g * s["ret"] + x["m"] * x["r"]).alias("ret"), after.alias("next"), x["v"].alias("v"), x["m"].alias("m")
        )

    return F.transform(reverse_fold(zipped, zero, step), lambda s: F.struct(s["advantage"].alias("advantage"), s["ret"].alias("ret")))


def on_last_token(length: Column, reward: Column, width: Column) -> Column:
    """An array of zeros with the reward on the last valid token."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.when(i == length, reward).otherwise(F.lit(0.0)))


def overlong_penalty(length: Column, most: Column, buffer: Column, factor: float) -> Column:
    """A penalty that grows in the buffer before the longest length allowed, at most 0; none without a buffer."""
    return F.coalesce(F.least(-(length - (most - buffer)) / F.nullif(buffer, F.lit(0)) * factor, F.lit(0.0)), F.lit(0.0))


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """kl, abs, mse or low_var_kl (clamped to 10 either way)."""
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(-d) + d - 1))
    raise ValueError(f"unknown KL estimate {kind}")


def adaptive_coefficient(start: Column, kls: Column, target: float, horizon: float, steps: int) -> Column:
    """The coefficient after each of the ordered KL values in turn."""
    return F.aggregate(kls, start, lambda c, k: c * (1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), k / target - 1)) * steps / horizon))


def loss_modes(tokens: DataFrame, seq: str, loss: Column, mask: Column, width: int) -> DataFrame:
    """One row with the four ways to sum up a token loss: first by sequence, then over sequences."""
    per = tokens.groupBy(seq).agg(F.sum(loss * mask).alias("s"), F.sum(mask).alias("n"))
    return per.agg(
        (F.sum("s") / (F.sum("n") + EPSILON)).alias("token_mean"), F.avg("s").alias("seq_mean_token_sum"),
        F.avg(F.try_divide(F.col("s"), F.col("n"))).alias("seq_mean_token_mean"), (F.sum("s") / width).alias("seq_mean_token_sum_norm"),
    )


def dual_clip(ratio: Column, advantage: Column, low: float, high: float, c: float) -> dict[str, Column]:
    """loss, and whether the upper and the lower clip took effect."""
    plain, cut = -advantage * ratio, -advantage * F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
    first = F.greatest(plain, cut)
    floor = -advantage * c
    return {
        "loss": F.when(advantage < 0, F.least(floor, first)).otherwise(first),
        "clipped": (cut > plain).cast("int"), "clipped_low": ((advantage < 0) & (first > floor)).cast("int"),
    }


def clipped_value_loss(value: Column, old: Column, ret: Column, clip: float) -> Column:
    near = F.least(F.greatest(value, old - clip), old + clip)
    return 0.5 * F.greatest((value - ret) * (value - ret), (near - ret) * (near - ret))


def entropy_of(logits: Column) -> Column:
    """Entropy of a small array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + x * F.exp(x - top)) / total
    return F.log(total) + top - mean
