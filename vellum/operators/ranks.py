"""Rows dealt to ranks: by equal shares of work, and in batches of like length, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.sequences import ranked


def rebalanced(rows: DataFrame, length: str, key: str, ranks: int) -> DataFrame:
    """rows with rank (from 0) and place in it: ranks get equally many rows, one more at most, and sums of lengths that
    differ by no more than the longest length.

    Rows are numbered by falling length over sorted ranges and dealt back and forth: 0, 1, ..., 1, 0. A null length counts
    as 0; equal lengths go by key, and rows that repeat both in any order. An empty table gives no rows.
    """
    down = rows.withColumn("down_", -F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")))
    at = ranked(down, ["down_", key], "at_")
    lap, step = F.floor(F.col("at_") / ranks), F.col("at_") % ranks
    return at.withColumn("rank", F.when(lap % 2 == 0, step).otherwise(ranks - 1 - step).cast("int")).withColumn("place", lap).drop("down_", "at_", "total_")


def sent(rows: DataFrame, ranks: int) -> DataFrame:
    """rows in as many partitions as ranks, each rank's rows in the partition of its number."""
    return rows.repartitionById(ranks, F.col("rank"))


def rank_sums(rows: DataFrame, length: str) -> DataFrame:
    """rank, n and total of rows that have been dealt."""
    return rows.groupBy("rank").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(length).cast("long")), F.lit(0)).alias("total"))


def shuffled_key(seed: int, epoch: int, key: Column) -> Column:
    """An order of rows that seed and epoch alone decide, the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), key.cast("string")))


def dealt(rows: DataFrame, at: str, total: str, ranks: int, drop_last: bool) -> DataFrame:
    """rows by their places as rank and step: place modulo ranks and over ranks. The last, shorter round goes, or is filled
    up with the first rows again, as often as it takes."""
    n, place = F.col(total), F.col(at)
    if drop_last:
        kept = rows.where(place < n - n % ranks)
    else:
        missing = F.pmod(-n, F.lit(ranks))
        # a row comes again at n + place, 2 n + place, ... while that is below n + missing
        times = F.when(place < missing, F.ceil((missing - place) / n)).otherwise(0)
        kept = rows.withColumn(at, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), times.cast("long")), lambda k: place + k * n)))
    return kept.withColumn("rank", (F.col(at) % ranks).cast("int")).withColumn("step", F.floor(F.col(at) / ranks)).drop(at, total)


def sampler(rows: DataFrame, key: str, ranks: int, seed: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """rows with rank and step, shuffled anew each epoch."""
    mixed = rows.withColumn("mixed_", shuffled_key(seed, epoch, F.col(key)))
    return dealt(ranked(mixed, ["mixed_", key], "at_"), "at_", "total_", ranks, drop_last).drop("mixed_")


def length_grouped(rows: DataFrame, length: str, key: str, batch: int, ranks: int, seed: int, epoch: int = 0, batches: int = 50, drop_last: bool = False) -> DataFrame:
    """rows with rank and step, where rows of like length come together: shuffled, cut into groups of ``batches`` batches
    (of fewer for small tables), and sorted by falling length inside each; the longest row of all comes first.

    A group is the most that one task sorts. A null length counts as 0; equal lengths go by key. Repeated rows are rows of
    their own; an empty table gives no rows.
    """
    own = rows.withColumn("mixed_", shuffled_key(seed, epoch, F.col(key))).withColumn("long_", F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")))
    own = ranked(own, ["mixed_", key], "at_")
    size = F.greatest(F.least(F.floor(F.col("total_") / (4 * batch)), F.lit(batches)), F.lit(1)) * batch
    own = own.withColumn("size_", size).withColumn("group_", F.floor(F.col("at_") / size))
    inside = F.row_number().over(Window.partitionBy("group_").orderBy(F.desc("long_"), key, "mixed_")) - 1
    own = own.withColumn("at_", F.col("group_") * F.col("size_") + inside)
    # the first group whose longest row is the longest of all changes places with the first one's
    firsts = own.where(F.col("at_") == F.col("group_") * F.col("size_")).agg(F.min(F.struct((-F.col("long_")).alias("n"), F.col("at_").alias("at")))["at"].alias("longest_"))
    swapped = F.when(F.col("at_") == 0, F.col("longest_")).when(F.col("at_") == F.col("longest_"), 0).otherwise(F.col("at_"))
    own = own.crossJoin(F.broadcast(firsts)).withColumn("at_", swapped)  # one row
    return dealt(own, "at_", "total_", ranks, drop_last).drop("mixed_", "long_", "size_", "group_", "longest_")
