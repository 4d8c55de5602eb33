"""Relational operators over keyed tables: compaction, resume, unions with checks, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_or_error(rows: DataFrame, key: str) -> DataFrame:
    """rows, or an error as soon as a key is null, empty or repeated."""
    checked = rows.groupBy(key).agg(F.count("*").alias("n_")).where(F.col(key).isNull() | (F.col(key).cast("string") == "") | (F.col("n_") > 1))
    bad = checked.limit(1).collect()
    if bad:
        raise ValueError(f"{key} is missing or repeated: {bad[0][key]!r}")
    return rows


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum, which is taken in part before the shuffle, where a window would move every row."""
    own = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(own).select("row.*")


def unfinished(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose key isn't among done; rows of done with an error don't count as done."""
    if "error" in done.columns:
        done = done.where("error IS NULL")
    return wanted.join(done.select(*keys), keys, "left_anti")


def keys_with_all(rows: DataFrame, keys: list[str], part: str, n: int) -> DataFrame:
    """Keys that have n different parts."""
    return rows.groupBy(*keys).agg(F.count_distinct(part).alias("n_")).where(F.col("n_") == n).drop("n_")


def union_conflicts(a: DataFrame, b: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """How many keys two batches have together, and on how many a shared column differs."""
    b = b.select(F.col(key), *[F.col(c).alias(f"{c}_b") for c in shared])
    differ = F.lit(False)
    for c in shared:
        differ |= ~F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return a.join(b, key, "full").agg(F.count("*").alias("n"), F.count_if(differ).alias("conflicts"))


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a with b's further columns; a column of both must agree, and so must the keys."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    more = b.select(key, *[F.col(c).alias(f"{c}_b") for c in shared], *[c for c in b.columns if c not in a.columns])
    both = a.withColumn("in_a", F.lit(True)).join(more.withColumn("in_b", F.lit(True)), key, "full")
    ok = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for c in shared:
        ok &= F.col(c).eqNullSafe(F.col(f"{c}_b"))
    checked = both.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("batches of a union disagree")).cast("boolean")))
    return checked.select(*a.columns, *[c for c in b.columns if c not in a.columns])


def overlap_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and f1 of the token arrays p and g, by counts of tokens instead of comparisons of all with all."""

    def counts(side: str) -> DataFrame:
        return rows.select(*keys, F.explode(side).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias(f"n_{side}"))

    shared = counts("p").join(counts("g"), [*keys, "w"]).groupBy(*keys).agg(F.sum(F.least("n_p", "n_g")).alias("o"))
    sizes = rows.select(*keys, F.size("p").alias("n_p"), F.size("g").alias("n_g"))
    return sizes.join(shared, keys, "left").select(*keys, F.coalesce(2.0 * F.col("o") / (F.col("n_p") + F.col("n_g")), F.lit(0.0)).alias("f1"))


def contained(boxes: DataFrame, points: DataFrame, on: list[str], keys: list[str], padding: float = 0) -> DataFrame:
    """Per box, the points inside it: how many, and their envelope with a padding. An equi-join on ``on`` with a filter."""
    b = F.col("box")
    met = boxes.join(points, on).where(F.col("cx").between(b[0], b[2]) & F.col("cy").between(b[1], b[3]))
    return met.groupBy(*keys).agg(
        F.count("*").alias("glyphs"), (F.min("cx") - padding).alias("x0"), (F.min("cy") - padding).alias("y0"),
        (F.max("cx") + padding).alias("x1"), (F.max("cy") + padding).alias("y1"),
    )


def page_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Old page to the sorted new pages that its glyphs went to."""
    return rows.groupBy(*keys, "old_page").agg(F.sort_array(F.collect_set("new_page")).alias("new_pages"))


def location_lookup(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each source location with its targets, in order; a location without targets raises."""
    held = targets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "target"))).alias("held"))
    both = sources.join(held, keys, "left")
    found = F.when(F.col("held").isNull(), F.raise_error(F.lit("a location has no target"))).otherwise(F.transform("held", lambda x: x["target"]))
    return both.withColumn("targets", found).drop("held")


def transposed(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """One row a key, with its values as an array by order."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("x"))
    return held.select(key, F.transform("x", lambda s: s[value]).alias(name))
