"""Measures of a training step: lengths of responses, time and work per token, and turns of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def response_info(attention: Column, n_response: Column, action: Column | None = None) -> Column:
    """struct(response_mask, prompt_length, response_length, obs_length): the mask's last n_response places are the
    response's; what the action mask leaves out of these are observations, which don't count for the response."""
    n = F.size(attention)
    response, prompt = F.slice(attention, n - n_response + 1, n_response), F.slice(attention, F.lit(1), n - n_response)
    seen = F.lit(0).cast("long")
    if action is not None:
        own = F.slice(action, F.size(action) - n_response + 1, n_response)
        seen = total(F.zip_with(response, own, lambda r, a: r * (1 - a)))
    return F.struct(response.alias("response_mask"), total(prompt).alias("prompt_length"), (total(response) - seen).alias("response_length"), seen.alias("obs_length"))


#: Sections whose time is spread over all tokens; that of ``gen`` is spread over the response's. Fixed values.
ALL_TOKENS = ("ref", "values", "adv", "update_critic", "update_actor")


def timing(rows: DataFrame, seconds: dict[str, float], devices: int = 1) -> DataFrame:
    """One row over rows (prompt_length, response_length): each section's seconds, its milliseconds a token, and tokens a second and device."""
    response, both = F.sum("response_length"), F.sum(F.col("prompt_length") + F.col("response_length"))
    out = [F.lit(float(s)).alias(f"timing_s/{k}") for k, s in seconds.items()]
    out += [(F.lit(1000.0 * s) / (response if k == "gen" else both)).alias(f"timing_per_token_ms/{k}") for k, s in seconds.items() if k == "gen" or k in ALL_TOKENS]
    if "step" in seconds:
        out += [both.alias("perf/total_num_tokens"), F.lit(float(seconds["step"])).alias("perf/time_per_step"), (both / F.lit(float(seconds["step"]) * devices)).alias("perf/throughput")]
    return rows.agg(*out)


def agent_turns(rows: DataFrame) -> DataFrame:
    """One row over rows (tool_cnt, agent_prompt_lengths, agent_response_lengths): calls a sample, and means over the turns
    that were taken; places of -1 are padding. Arrays of a row that differ in length raise."""
    prompt, response = F.col("agent_prompt_lengths"), F.col("agent_response_lengths")
    even = F.when(F.size(prompt) == F.size(response), F.arrays_zip(prompt.alias("p"), response.alias("r")))
    checked = F.coalesce(even, F.raise_error(F.lit("prompt and response lengths of a sample differ in number")).cast("array<struct<p:bigint,r:bigint>>"))
    turns = rows.select("tool_cnt", F.filter(checked, lambda t: (t["p"] >= 0) & (t["r"] >= 0)).alias("t"))
    of = lambda k: F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t[k])
    sums = turns.select("tool_cnt", F.size("t").alias("n"), of("p").alias("p"), of("r").alias("r"))
    n = F.nullif(F.sum("n"), F.lit(0))
    return sums.agg(
        F.avg("tool_cnt").alias("tool_call_mean"), F.max("tool_cnt").alias("tool_call_max"), F.min("tool_cnt").alias("tool_call_min"),
        ((F.sum("p") + F.sum("r")) / n).alias("sample_length_mean"), (F.sum("p") / n).alias("prompt_length_mean"), (F.sum("r") / n).alias("response_length_mean"),
        F.when(n.isNotNull(), F.avg("n")).alias("turns_mean"),
    )


def mean_by_metric(rows: DataFrame) -> DataFrame:
    """metric and its mean."""
    return rows.groupBy("metric").agg(F.avg("value").alias("value"))


def dense_flops(lengths: DataFrame, hidden: int, vocab: int, layers: int, kv_heads: int, heads: int, middle: int, seconds: float) -> DataFrame:
    """Teraflops a second of a dense decoder over rows (length): six for each weight and token, and attention by the squares of the lengths."""
    head = hidden // heads
    per_layer = hidden * middle * 3 + hidden * (2 * head * heads + 2 * head * kv_heads)
    weights = per_layer * layers + 2 * vocab * hidden
    tokens, squares = F.sum(F.col("length").cast("double")), F.sum(F.col("length").cast("double") * F.col("length"))
    return lengths.agg(((6.0 * weights * tokens + 12.0 * head * heads * layers * squares) / F.lit(seconds) / 1e12).alias("tflops"))


def data_metrics(sequences: DataFrame, tokens: DataFrame, most_prompt: int, most_response: int) -> DataFrame:
    """metric and value of a batch: mean, max and min of eight series, shares of lengths at their bounds, how much of the
    returns the values explain, and the actor's lengths.

    sequences: score, reward, prompt_length, response_length, obs_length. tokens: advantage, return, value, and mask, which
    is 1 for what the policy wrote. Two aggregates of one row each. Without values there are none of these rows; an empty
    batch gives nulls, and nulls in a series don't count.
    """
    ends = lambda name, c: [f(c).cast("double").alias(f"{name}/{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    c = F.col
    response, prompt = c("response_length"), c("prompt_length")
    per_sequence = [
        *ends("critic/score", c("score")), *ends("critic/rewards", c("reward")), *ends("response_length", response), F.avg((response == most_response).cast("double")).alias("response_length/clip_ratio"),
        *ends("obs_length", c("obs_length")), *ends("prompt_length", prompt), F.avg((prompt == most_prompt).cast("double")).alias("prompt_length/clip_ratio"),
        F.avg((prompt + response + c("obs_length")).cast("double")).alias("actor/sample_length/mean"), F.avg(prompt).alias("actor/prompt_length/mean"),
        F.avg(response).alias("actor/response_length/mean"), F.avg(c("obs_length")).alias("actor/observation_length/mean"),
    ]
    per_token = [*ends("critic/advantages", c("advantage")), *ends("critic/returns", c("return"))]
    if "value" in tokens.columns:
        left = 1 - F.var_samp(c("return") - c("value")) / (F.var_samp("return") + 1e-5)
        per_token += [*ends("critic/values", c("value")), left.alias("critic/vf_explained_var")]

    def long(row: DataFrame) -> DataFrame:
        return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in row.columns])))

    return long(sequences.agg(*per_sequence)).unionByName(long(tokens.where("mask = 1").agg(*per_token)))
