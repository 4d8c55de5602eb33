"""Summaries by dataset, resolution, sample and training step, each one aggregate that is taken in part before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.scoring import set_

#: The metric of each dataset, the most new tokens of an answer, and datasets of which only the first line counts. Fixed values.
METRICS = {
    "narrativeqa": "qa_f1", "qasper": "qa_f1", "multifieldqa_en": "qa_f1", "multifieldqa_zh": "qa_f1_zh", "hotpotqa": "qa_f1", "2wikimqa": "qa_f1", "musique": "qa_f1",
    "dureader": "rouge_zh", "gov_report": "rouge", "qmsum": "rouge", "multi_news": "rouge", "vcsum": "rouge_zh", "trec": "classification", "triviaqa": "qa_f1", "samsum": "rouge",
    "lsht": "classification", "passage_retrieval_en": "retrieval", "passage_count": "count", "passage_retrieval_zh": "retrieval_zh", "lcc": "code_sim", "repobench-p": "code_sim",
}
MOST_TOKENS = {
    "narrativeqa": 128, "qasper": 128, "multifieldqa_en": 64, "multifieldqa_zh": 64, "hotpotqa": 32, "2wikimqa": 32, "musique": 32, "dureader": 128, "gov_report": 512, "qmsum": 512,
    "multi_news": 512, "vcsum": 512, "trec": 64, "triviaqa": 32, "samsum": 128, "lsht": 64, "passage_count": 32, "passage_retrieval_en": 32, "passage_retrieval_zh": 32, "lcc": 64, "repobench-p": 64,
}
FIRST_LINE = ("trec", "triviaqa", "samsum", "lsht")
SETTINGS = {name: (metric, MOST_TOKENS[name], name in FIRST_LINE) for name, metric in METRICS.items()}
#: Datasets that take part only if asked for. Fixed values.
OPTIONAL = ("multifieldqa_zh", "dureader", "vcsum", "lsht", "passage_retrieval_zh")


def with_settings(rows: DataFrame, dataset: str, settings: dict = SETTINGS, strict: bool = True) -> DataFrame:
    """rows with metric, most_tokens and first_line of their dataset; an unknown one raises, or gives nulls if not strict."""
    kind = "struct<metric:string,most_tokens:int,first_line:boolean>"
    pairs = [x for name, (metric, most, first) in settings.items() for x in (F.lit(name), F.struct(F.lit(metric).alias("metric"), F.lit(most).alias("most_tokens"), F.lit(first).alias("first_line")))]
    found = F.try_element_at(F.create_map(*pairs), F.col(dataset))
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("unknown dataset: "), F.coalesce(F.col(dataset), F.lit("null")))).cast(kind))
    return rows.withColumn("settings_", found).select(*rows.columns, "settings_.*")


def taking_part(rows: DataFrame, dataset: str, with_optional: bool = False, optional: tuple = OPTIONAL) -> DataFrame:
    """rows of datasets that take part; those without a dataset do."""
    return rows if with_optional else rows.where(F.col(dataset).isNull() | ~F.col(dataset).isin(*optional))


def dataset_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per dataset: score (100 times the mean of score, two digits), n, errors, truncated, and means and maxima of tokens and pages.

    prompt tokens are those of the first turn where a record has any, else those of all turns; cumulative ones are those of
    all turns of records that have both. Zeros and nulls are no counts, but pages that are missing are none. Means of
    tokens are whole, halves to even; no count gives null.
    """
    first, every = F.nullif("initial_prompt_tokens", F.lit(0)), F.nullif("prompt_tokens", F.lit(0))
    # a record that states 0 for its first turn has no count; only one that states nothing falls back
    prompt = F.when(F.col("initial_prompt_tokens").isNull(), every).otherwise(first)
    both = F.when(first.isNotNull(), every)
    pages = F.coalesce("num_pages", F.lit(0))
    whole = lambda c: F.bround(F.avg(c), 0).cast("long")
    return rows.groupBy(*keys).agg(
        F.bround(100 * F.avg("score"), 2).alias("score"), F.count("*").alias("n"), F.count_if(set_("error")).alias("errors"), F.count_if(F.col("finish_reason") == "length").alias("truncated"),
        whole(prompt).alias("mean_prompt_tokens"), F.max(prompt).alias("max_prompt_tokens"), whole(both).alias("mean_cumulative_prompt_tokens"), F.max(both).alias("max_cumulative_prompt_tokens"),
        F.bround(F.avg(pages), 1).alias("mean_pages"), F.max(pages).alias("max_pages"),
    )


def by_resolution(rows: DataFrame, dpi: str = "dpi") -> DataFrame:
    """Per resolution: n, and means of pages and tokens with one digit; rows without a count are left out of its mean."""
    return rows.groupBy(dpi).agg(F.count("*").alias("n"), *[F.bround(F.avg(c), 1).alias(f"mean_{c}") for c in ("pages", "tokens")])


#: Counts that a turn reports. Fixed values.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Per sample: its turns and what they used in sum; a turn that doesn't report a count adds nothing."""
    return turns.groupBy(*keys).agg(F.count("*").alias("turns"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in USAGE])


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different values of some columns together, with how many rows have each; nulls are values."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def step_metrics(rows: DataFrame, peak: float, split: int = 1) -> DataFrame:
    """Per step, from a row a rank: rank means, least and most of lengths, use of the devices, and totals up to the step.

    rows: step, loss, flops (done in the step), tokens (array: lengths summed by batch), samples, least and most (lengths of
    single samples), seconds. peak: flops a second of a device; split: devices that share a sequence. A step's seconds
    are those of its slowest rank. Totals run over the steps, of which there are few.
    """
    total = F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x.cast("double"))
    own = rows.select("*", (total / split).alias("length"), (total / F.size("tokens")).alias("batch"), F.array_min("tokens").alias("low"), F.array_max("tokens").alias("high"))
    n = F.count("*")
    steps = own.groupBy("step").agg(
        (F.sum("loss") / n).alias("loss"), (F.sum(F.col("flops") / split / peak) / n).alias("mfu"), (F.sum("batch") / n).alias("seq_len_avg"),
        F.min("low").alias("seq_len_min"), F.max("high").alias("seq_len_max"), F.min("least").alias("micro_seq_len_min"), F.max("most").alias("micro_seq_len_max"),
        (F.sum("length") / F.sum("samples")).alias("micro_seq_len_avg"), F.sum("length").alias("length_"), F.sum("samples").alias("samples_"), F.max("seconds").alias("delta_time"), n.alias("ranks"),
    )
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    speed: Column = F.col("length_") / F.col("delta_time")
    return steps.select(
        "step", "loss", F.bround("mfu", 2).alias("mfu"), "seq_len_avg", "seq_len_min", "seq_len_max", "micro_seq_len_min", "micro_seq_len_max", "micro_seq_len_avg",
        F.bround("delta_time", 2).alias("delta_time"), F.sum("length_").over(so_far).alias("total_tokens"), F.sum("samples_").over(so_far).alias("total_samples"),
        F.bround(speed, 0).cast("long").alias("tokens_per_second"), F.bround(speed / split / F.col("ranks"), 0).cast("long").alias("tokens_per_device"),
    )


def thinking(messages: Column, system: str = "You are a helpful assistant", opened: str = "<think>\n") -> Column:
    """array<struct<role, content: array<struct<type, text, url>>>> as a model that thinks was trained on: texts stripped,
    empty ones dropped, the first system turn alone (a default one where there is none), and an assistant turn left open."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    empty = F.lit(None).cast("string")
    spoken = lambda role, said: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit(said).alias("text"), empty.alias("url"))).alias("content"))
    parts = lambda m: F.filter(F.transform(m["content"], lambda p: F.struct(p["type"].alias("type"), F.when(p["type"] == "text", strip(p["text"])).alias("text"), p["url"].alias("url"))), lambda p: (p["type"] != "text") | (p["text"] != ""))
    first = F.array_min(F.transform(messages, lambda m, i: F.when(m["role"] == "system", i)))
    kept = F.filter(messages, lambda m, i: (m["role"] != "system") | (i == first))
    own = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), parts(m).alias("content")))
    return F.concat(F.when(first.isNull(), F.array(spoken("system", system))).otherwise(F.slice(own, 1, 0)), own, F.array(spoken("assistant", opened)))
