"""Training-set sources: readers of several Parquet files each, and document rows turned into rollout rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import messages, prompts
from vellum.sources.manifests import concatenated, nested

#: Columns that may hold a document's pages, at the resolution of the prompt and at a higher one, by preference. Fixed values.
LOW = ("low_res_images", "images_72dpi", "image_dpi72", "image", "images")
HIGH = ("high_res_images", "images_high_res", "images_144dpi", "image_dpi144", "images_96dpi", "image_dpi96")


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows of one or several Parquet files, one file's after the other's; columns that a file lacks are null."""
    return concatenated([spark.read.parquet(p) for p in ([paths] if isinstance(paths, str) else paths)])


def within(rows: DataFrame, length: Column | str, most: int) -> DataFrame:
    """Rows whose prompt, by a given length, isn't too long; rows without a length stay."""
    n = F.col(length) if isinstance(length, str) else length
    return rows.where(n.isNull() | (n <= most))


def rollouts(spark: SparkSession, paths: str | list[str], length: Column | str | None = None, most: int | None = None) -> DataFrame:
    """Rollout prompts, without those that are too long."""
    rows = files(spark, paths)
    return rows if length is None or most is None else within(rows, length, most)


def supervised(spark: SparkSession, paths: str | list[str], prompt: str = "prompt", response: str = "response", prompt_keys: list[str] = (), response_keys: list[str] = ()) -> DataFrame:
    """prompt and response, each below its column by keys; an array of one element counts as that element."""
    rows = files(spark, paths)
    for column, keys in ((prompt, prompt_keys), (response, response_keys)):
        for key in keys:
            rows = nested(rows, column, [key], column)
    return rows.select(F.col(prompt).alias("prompt"), F.col(response).alias("response"))


def conversations(spark: SparkSession, paths: str | list[str], column: str = "messages") -> DataFrame:
    """Multi-turn rows: messages as array of struct(role, content); a row without a turn raises when it is read."""
    turns = F.col(column)
    checked = F.when(F.size(turns) > 0, turns).otherwise(F.raise_error(F.lit("a conversation has no turns")).cast("array<struct<role:string,content:string>>"))
    return files(spark, paths).select(F.transform(checked, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def preferences(spark: SparkSession, paths: str | list[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt, chosen and rejected."""
    return files(spark, paths).select(*[F.col(c).alias(n) for c, n in ((prompt, "prompt"), (chosen, "chosen"), (rejected, "rejected"))])


def stacked(pairs: DataFrame) -> DataFrame:
    """A row per response of a preference pair: prompt, response and whether it was chosen, the chosen one first."""
    both = F.array(*[F.struct(F.col(c).alias("response"), F.lit(c == "chosen").alias("is_chosen")) for c in ("chosen", "rejected")])
    return pairs.select("prompt", F.inline(both))


def evaluations(spark: SparkSession, paths: str | list[str], responses: str = "responses", source: str = "data_source", truth: str = "reward_model") -> DataFrame:
    """A row per response of an offline evaluation: its row and place, data_source and ground_truth."""
    rows = files(spark, paths).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", F.col(source).alias("data_source"), F.col(f"{truth}.ground_truth").alias("ground_truth"), F.posexplode(responses).alias("place", "response"))


def first_column(rows: DataFrame, names: tuple[str, ...]) -> tuple[Column, Column]:
    """Of the columns named the first that isn't empty, by row: its name, and its value as an array."""
    there = [c for c in names if c in rows.columns]
    as_array = lambda c: F.col(c) if rows.schema[c].dataType.typeName() == "array" else F.when(F.col(c) != "", F.array(c))
    full = [F.size(F.coalesce(as_array(c), F.array())) > 0 for c in there]
    none = F.lit(None)
    name = F.coalesce(none.cast("string"), *[F.when(f, F.lit(c)) for f, c in zip(full, there, strict=True)])
    return name, F.coalesce(none.cast("array<string>"), *[F.when(f, as_array(c)) for f, c in zip(full, there, strict=True)])


def dpi_of(name: Column, explicit: Column) -> Column:
    """The resolution that is given, or else the one in a column's name (dpi72, 72dpi)."""
    found = F.regexp_extract(name, r"dpi(\d+)|(\d+)dpi", 0)
    return F.coalesce(explicit.cast("double"), F.nullif(F.regexp_replace(found, "dpi", ""), F.lit("")).cast("double"))


def gold_answers(gold: Column) -> Column:
    """Trimmed answers that aren't empty, of an array or of one text."""
    return F.filter(F.transform(F.coalesce(gold, F.array()), lambda g: F.trim(g.cast("string"))), lambda g: g != "")


def rollout_rows(rows: DataFrame, source: str, env: str, system: str, suffix: str) -> DataFrame:
    """Document rows as rollout rows, and those that can't be with a reason.

    rows: id, index, conversations (turns of either dialect), gold (array), page columns of LOW and HIGH, and, where
    known, num_pages, low_dpi, high_dpi, evidence_locations, task, ruler_version. reason is null for rows to keep: a
    gold answer, a user turn left, page pairs in equal number and of different files, and a higher resolution for the
    second of each pair (or 144 for both).
    """
    def opt(c: str, kind: str) -> Column:
        return F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)

    low_name, low = first_column(rows, LOW)
    high_name, high = first_column(rows, HIGH)
    low_dpi, high_dpi = dpi_of(low_name, opt("low_dpi", "double")), dpi_of(high_name, opt("high_dpi", "double"))
    native = F.coalesce((low_dpi == 144) & (high_dpi == 144), F.lit(False))
    turns = messages.without_last_assistant(messages.unified_turns(F.col("conversations")))
    turns = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.when(t["role"] == "user", prompts.without_number_stem(t["content"])).otherwise(t["content"]).alias("content")))
    golds, n = gold_answers(F.col("gold")), F.coalesce(opt("num_pages", "int"), F.size(low))
    same = F.exists(F.arrays_zip(low.alias("a"), high.alias("b")), lambda p: p["a"] == p["b"])
    reason = (
        F.when(F.size(golds) == 0, "no gold answer")
        .when(~F.exists(turns, lambda t: t["role"] == "user"), "no user turn")
        .when(F.exists(turns, lambda t: ~t["role"].isin("user", "assistant", "system")), "unknown role")
        .when(low.isNull() | high.isNull(), "no page pairs")
        .when((F.size(low) != F.size(high)) | (n != F.size(low)), "page counts differ")
        .when(~native & same, "both pages are one file")
        .when(~native & (high_dpi <= low_dpi), "the higher resolution isn't higher")
    )
    extra = F.struct(
        F.col("index").cast("long").alias("index"), F.col("id").cast("string").alias("id"), golds.alias("gold"), n.alias("num_pages"), low_dpi.alias("dpi"), high_dpi.alias("high_res_dpi"),
        (F.col("evidence_locations") if "evidence_locations" in rows.columns else F.lit(None).cast("array<struct<page:int,bbox:array<double>>>")).alias("evidence_locations"),
        F.coalesce(opt("task", "string"), F.lit("")).alias("task"), F.coalesce(opt("ruler_version", "string"), F.lit("")).alias("ruler_version"),
    )
    return rows.select(
        F.lit(source).alias("data_source"), F.lit(env).alias("env_name"), F.lit(True).alias("enable_tools"),
        messages.with_prompt(turns, F.lit(system), F.lit(suffix), gap="\n\n").alias("prompt"), low.alias("images"), high.alias("high_res_images"),
        F.struct(F.lit("rule").alias("style"), golds.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"), reason.alias("reason"),
    )
