"""Rollups from rows to tasks to groups to runs, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_task(rows: DataFrame, keys: list[str], score: str, stats: dict[str, str], digits: int = 2) -> DataFrame:
    """n, the rounded mean score, and mean and maximum of further columns, in which zeros count as missing."""
    more = []
    for name, c in stats.items():
        known = F.nullif(F.col(c), F.lit(0))
        more += [F.bround(F.avg(known), 0).alias(f"mean_{name}"), F.max(known).alias(f"max_of_{name}")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bround(F.avg(score), digits).alias("score"), *more)


def macro(tasks: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """The unweighted mean of the tasks' rounded scores, with the number of tasks and rows."""
    most = [F.max(c).alias(c) for c in tasks.columns if c.startswith("max_of_")]
    return tasks.groupBy(*keys).agg(F.count("*").alias("tasks"), F.sum("n").alias("n"), F.bround(F.avg("score"), digits).alias("score"), *most)


def overall(tasks: DataFrame, expected: int) -> DataFrame:
    """The mean over tasks, valid only if all are there."""
    return tasks.agg(F.avg("score").alias("score"), F.count("*").alias("tasks"), (F.count("*") == expected).alias("valid"))


def overall_and_by(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures over everything (null keys) and by keys, in one pass."""
    sets = rows.groupingSets([[], [F.col(k) for k in keys]], *keys)
    return sets.agg(*[c.alias(name) for name, c in measures.items()])


def report(rows: DataFrame, row: str, column: str, values: list, measure: Column) -> DataFrame:
    """A pivot with known columns, so that they needn't be looked for first."""
    return rows.groupBy(row).pivot(column, values).agg(measure)


def median_bins(rows: DataFrame, keys: list[str], ordinal: str, value: str, size: int) -> DataFrame:
    """Blocks of so many ordinals, ranked by the median of a value."""
    blocks = rows.groupBy(*keys, F.floor(F.col(ordinal) / size).alias("block")).agg(F.median(value).alias("mid"))
    return blocks.withColumn("bin", F.row_number().over(Window.partitionBy(*keys).orderBy("mid", "block")))


def with_bins(rows: DataFrame, bins: DataFrame, keys: list[str], ordinal: str, size: int, name: Column | list[str]) -> DataFrame:
    """rows with bin_name: the name of their block's bin, from a list or made of bin (from 1, of median_bins). A row without
    a block, or a bin without a name, raises. There is one short row a block of so many rows."""
    named = F.try_element_at(F.lit(list(name)), F.col("bin").cast("int")) if isinstance(name, list) else name
    both = rows.withColumn("block", F.floor(F.col(ordinal) / size)).join(bins.select(*keys, "block", "bin"), [*keys, "block"], "left")
    return both.withColumn("bin_name", F.coalesce(named, F.raise_error(F.lit("a block without a named bin")).cast("string"))).drop("block", "bin")


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value that most rows have; of equals, that seen first."""
    votes = rows.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("first_"))
    best = F.max_by(F.struct(F.col(value).alias("winner"), "votes"), F.struct(F.col("votes"), -F.col("first_")))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def best_of_k(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Expected maximum and minimum of k draws with replacement, from order statistics instead of resampling."""
    by = Window.partitionBy(*keys)
    ranked = rows.select(*keys, value, F.row_number().over(by.orderBy(value)).alias("i"), F.count("*").over(by).alias("n"))
    power = lambda c: F.pow(c / F.col("n"), F.lit(k))
    i, n = F.col("i"), F.col("n")
    return ranked.groupBy(*keys).agg(
        F.round(F.sum(F.col(value) * (power(i) - power(i - 1))), 6).alias(f"best_at_{k}"),
        F.round(F.sum(F.col(value) * (power(n - i + 1) - power(n - i))), 6).alias(f"worst_at_{k}"),
    )


def first_crossing(curve: DataFrame, keys: list[str], x: str, y: str, level: float) -> DataFrame:
    """Where a curve first crosses a level, by interpolation that is linear in the logarithm of x."""
    w = Window.partitionBy(*keys).orderBy(x)
    steps = curve.withColumns({"x2": F.lead(x).over(w), "y2": F.lead(y).over(w)})
    crossed = steps.where(((F.col(y) - level) * (F.col("y2") - level) <= 0) & (F.col(y) != F.col("y2")))
    at = F.exp(F.log(x) + (level - F.col(y)) / (F.col("y2") - F.col(y)) * (F.log("x2") - F.log(x)))
    return crossed.groupBy(*keys).agg(F.round(F.min_by(at, x), 6).alias("threshold"))
