"""Summaries of generations: rows with a score, an error or a reason why they were skipped, to one row a task or report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import resample


def set_(c: str) -> Column:
    """Whether a text field says anything."""
    return F.coalesce(F.col(c) != "", F.lit(False))


def nonzero_mean(value: Column, where: Column) -> Column:
    """The mean of a column over the rows that count, in which zeros stand for missing values."""
    return F.avg(F.when(where, F.nullif(value, F.lit(0))))


def task_summary(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Per task: n, accuracy, mean token counts and pages, errors and truncated ones.

    A row with an error scores 0 and counts for nothing else. The first turn's prompt tokens go before those of all.
    """
    ok = ~set_("error")
    prompt = F.coalesce("initial_prompt_tokens", "prompt_tokens")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(ok, F.col(score)).otherwise(0.0)).alias("accuracy"),
        nonzero_mean(prompt, ok).alias("prompt_tokens"), nonzero_mean(F.col("completion_tokens"), ok).alias("completion_tokens"),
        nonzero_mean(F.col("vision_tokens_est"), ok).alias("vision_tokens_est"), nonzero_mean(F.col("num_pages"), ok).alias("num_pages"),
        F.count_if(~ok).alias("errors"), F.count_if(ok & (F.col("finish_reason") == "length")).alias("truncated"),
    )


def needle_measures(score: Column, prefix_hit: Column) -> dict[str, Column]:
    """The fifteen measures of a needle-recall report, by name. Only rows neither skipped nor failed have a score; pages count for all."""
    made = ~set_("skipped_reason") & ~set_("error")
    requested, generated = F.count("*"), F.count_if(made)
    prompt = F.when(made, F.coalesce("initial_prompt_tokens", "prompt_tokens"))
    response = F.when(made, F.coalesce("cumulative_usage.completion_tokens", "completion_tokens"))
    pages = F.coalesce("num_pages", F.lit(0))
    share = lambda part, whole, places: F.when(whole > 0, F.bround(100 * part / whole, places)).otherwise(0.0)
    total = F.coalesce(F.sum(F.when(made, score)), F.lit(0.0))
    return {
        "requested": requested, "generated": generated, "skipped": F.count_if(set_("skipped_reason")), "errors": F.count_if(set_("error")),
        "truncated": F.count_if(made & (F.col("finish_reason") == "length")), "coverage_pct": share(generated, requested, 2),
        "score_all": share(total, requested, 2), "score_generated": share(total, generated, 2), "prefix_hit_pct": share(F.count_if(made & prefix_hit), generated, 2),
        "mean_prompt_tokens": F.bround(F.avg(prompt), 0).cast("long"), "max_prompt_tokens": F.max(prompt),
        "mean_response_tokens": F.bround(F.avg(response), 0).cast("long"), "max_response_tokens": F.max(response),
        "mean_pages": F.coalesce(F.bround(F.avg(pages), 1), F.lit(0.0)), "max_pages": F.coalesce(F.max(pages), F.lit(0)),
    }


def with_reasoning(base: Column, hits: Column, golds: Column, reasoning: Column, exact: Column, each: Column) -> Column:
    """A score with credit for golds that the reasoning holds, for tasks where this counts (exact).

    each: the task's score is the mean over golds, so a gold's own hit (hits) is raised to 1 if the reasoning holds it;
    otherwise the whole score is, if it holds any. An empty reasoning gives no credit.
    """
    said = F.lower(F.coalesce(reasoning, F.lit("")))
    inside = F.transform(golds, lambda g: F.contains(said, F.lower(g)).cast("double"))
    raised = F.aggregate(F.zip_with(hits, inside, lambda h, i: F.greatest(h, i)), F.lit(0.0), lambda a, x: a + x) / F.size(golds)
    return F.when(~exact | (said == ""), base).when(each, raised).otherwise(F.greatest(base, F.array_max(inside)))


def reasoning_of(native: Column, raw: Column) -> Column:
    """The reasoning field, or the first think block of the raw generation where that is empty."""
    block = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?is)<think>\s*(.*?)\s*</think>", 1)
    return F.when(F.coalesce(native, F.lit("")) != "", native).otherwise(block)


def finite_mean(value: Column) -> Column:
    """The mean of the values that are numbers, finite ones."""
    number = value.cast("double")
    return F.avg(F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number))


def majority_at(rows: DataFrame, keys: list[str], vote: str, value: str, k: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and deviation of the value of the commonest vote of k rows of a group, as resample.majorities draws them."""
    found = resample.majorities(rows, keys, vote, value, draws, seed, sizes=lambda n: F.array(F.lit(k).cast("long")))
    return found.select(*keys, F.col("mean").alias(f"maj_at_{k}_mean"), F.col("std").alias(f"maj_at_{k}_std"))


#: Fields that every record of a run keeps. Fixed values.
COMMON = (
    "index", "_id", "dataset", "subset", "length_bin", "answers", "answer", "random_string_to_prepend", "n_needles", "desired_msg_index", "total_messages",
    "num_pages", "vision_tokens", "source_file", "source_row",
)


def common_record(rows: DataFrame, fields: tuple[str, ...] = COMMON) -> DataFrame:
    """The fields that records share; one that the rows lack is null."""
    return rows.select(*[F.col(f"`{f}`") if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])


def response_tokens(rows: DataFrame) -> Column:
    """The tokens of a response: those of all its turns where they were added up, else those of the one that is recorded."""
    of_all = F.col("cumulative_usage.completion_tokens") if "cumulative_usage" in rows.columns else F.lit(None).cast("long")
    return F.coalesce(of_all, F.col("completion_tokens"))
