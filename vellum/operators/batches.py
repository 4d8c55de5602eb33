"""Batches as tables: choosing, renaming and folding of rows and columns, and their order over epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.sequences import ranked


def selected(rows: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Some columns; one that isn't there raises, or is left out if not strict."""
    missing = [c for c in columns if c not in rows.columns]
    if missing and strict:
        raise ValueError(f"no columns {missing}")
    return rows.select(*[c for c in columns if c not in missing])


def popped(rows: DataFrame, columns: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows without some columns, and these columns by themselves, both with the key."""
    return rows.drop(*columns), selected(rows, [*key, *columns])


def renamed(rows: DataFrame, old: list[str] | str, new: list[str] | str) -> DataFrame:
    """Columns under new names; as many new ones as old."""
    old, new = ([x] if isinstance(x, str) else x for x in (old, new))
    if len(old) != len(new):
        raise ValueError(f"{len(old)} columns, but {len(new)} names")
    return selected(rows, rows.columns + [c for c in old if c not in rows.columns]).withColumnsRenamed(dict(zip(old, new, strict=True)))


def pruned(rows: DataFrame, suffix: str) -> DataFrame:
    """Rows without the columns whose whole suffix matches a pattern."""
    import re

    return rows.drop(*[c for c in rows.columns if re.search(f"(?:{suffix})$", c)])


def folded(rows: DataFrame, place: str, n: int, total: int, name: str = "items") -> DataFrame:
    """n rows, each with an equal share of the rows in the order of their places (0 .. total - 1)."""
    if total % n:
        raise ValueError(f"{total} rows don't fold into {n}")
    own = F.struct(place, *[c for c in rows.columns if c != place])
    return rows.groupBy(F.floor(F.col(place) / (total // n)).alias("fold")).agg(F.array_sort(F.collect_list(own)).alias(name))


def unfolded(folds: DataFrame, name: str = "items") -> DataFrame:
    return folds.select(F.inline(name))


def columns_of(items: Column, fields: list[str]) -> Column:
    """An array of structs as one struct of arrays."""
    own = lambda f: F.transform(items, lambda x: x[f])
    return F.struct(*[own(f).alias(f) for f in fields])


def items_of(columns: Column, fields: list[str]) -> Column:
    """A struct of arrays as one array of structs; arrays that differ in length raise."""
    sizes = F.array(*[F.size(columns[f]) for f in fields])
    even = F.when(F.array_min(sizes) == F.array_max(sizes), columns[fields[0]]).otherwise(F.raise_error(F.lit("columns differ in length")).cast("array<string>"))
    first = F.transform(even, lambda x, i: i)
    return F.transform(first, lambda i: F.struct(*[F.get(columns[f], i).alias(f) for f in fields]))


def chosen(rows: DataFrame, order: str, tasks: list[str] = (), length: int = 0, skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows of some tasks and of one length (0: of any), without the first so many, at most so many (0: all), in order."""
    if tasks:
        rows = rows.where(F.col("task").isin(*tasks))
    if length:
        rows = rows.where(F.coalesce("ruler_length", F.lit(0)) == length)
    rows = rows.orderBy(order).offset(skip) if skip else rows.orderBy(order)
    return rows.limit(limit) if limit else rows


def calibrated(rows: DataFrame) -> DataFrame:
    """Calibration rows that went well and have an error rate, which is cut at 1."""
    return rows.where(F.coalesce("ok", F.lit(True)) & F.col("cer").isNotNull()).withColumn("cer", F.least("cer", F.lit(1.0)))


def reordered(rows: DataFrame, order: DataFrame, place: str) -> DataFrame:
    """The rows that order (place, new_place) names, as often as it does, with new_place as their place."""
    return rows.join(order, place).drop(place).withColumnRenamed("new_place", place)


def sliced(rows: DataFrame, place: str, start: int | None, stop: int | None, step: int, total: int) -> DataFrame:
    """The rows at places that a slice names; negative bounds count from the end."""
    first, last, by = slice(start, stop, step).indices(total)
    if by < 1:
        raise ValueError("a slice goes forward")
    p = F.col(place)
    return rows.where((p >= first) & (p < last) & ((p - first) % by == 0)).withColumn(place, F.floor((p - first) / by))


def minibatches(rows: DataFrame, place: str, size: int, epochs: int, total: int | None = None, seed: int | None = None) -> DataFrame:
    """epoch, step and slot of each row in each epoch: batches of one size, in order, or shuffled anew each epoch by a hash
    of seed, epoch and place.

    Places are 0 .. total - 1, once each (total: counted if it isn't given, and a multiple of size); one beyond raises. Shuffled
    ranks come from sorted ranges, so no task sorts an epoch.
    """
    total = rows.count() if total is None else total
    if total % size:
        raise ValueError(f"{total} rows don't make batches of {size}")
    inside = F.when((F.col(place) >= 0) & (F.col(place) < total), F.col(place)).otherwise(F.raise_error(F.lit(f"a place that isn't among {total}")).cast("long"))
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("at_", inside)
    if seed is not None:
        mixed = each.withColumn("mixed_", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("at_").cast("string"))))
        # every epoch has all rows, and so an equal share of the ranks
        each = ranked(mixed, ["epoch", "mixed_", "at_"], "rank_").withColumn("at_", F.col("rank_") % F.floor(F.col("total_") / epochs)).drop("mixed_", "rank_", "total_")
    return each.withColumn("step", F.floor(F.col("at_") / size)).withColumn("slot", F.col("at_") % size).drop("at_")


def by_bin(rows: DataFrame, bins: list[str], column: str, key: str) -> DataFrame:
    """Rows in the order of named bins, then by key; other bins come last."""
    return rows.orderBy(F.coalesce(*[F.when(F.col(column) == b, F.lit(i)) for i, b in enumerate(bins)], F.lit(len(bins))), key)


def sample_of_generations(rows: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """The same n rows whenever the same rows are there: those with the least hashes of seed and key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
