"""Sharding, batching, packing and balancing of sequences."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import staged


def contiguous_shards(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Contiguous shards of a whole table, the first ones longer by one. Ranks come from sorted ranges, not from one task."""
    return ranked(rows, [order], "rank_").withColumn("shard", shard_of(F.col("rank_"), F.col("total_"), shards)).drop("rank_", "total_")


def shard_of(rank: Column, total: Column, shards: int) -> Column:
    """The shard (from 1) of a rank (from 0) if total rows are cut into as equal parts as can be, longer ones first."""
    size, more = F.floor(total / shards), total % shards
    long_part = more * (size + 1)
    late = F.when(size > 0, more + F.floor((rank - long_part) / F.nullif(size, F.lit(0))))
    return (F.when(rank < long_part, F.floor(rank / (size + 1))).otherwise(late) + 1).cast("long")


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their global rank (from 0) and total_, without sending all rows to one task.

    Rows are dealt by range of the order; ranks within a range are a window there, and add to the sizes of the ranges before.
    The dealt rows are written once: bounds are sampled and parts put together anew each time a plan runs, so that sizes and
    rows of two runs wouldn't fit.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = sizes.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy()).alias("total_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "range_").withColumn(name, F.col("before_") + own).drop("range_", "before_")


def strided_shard(rows: DataFrame, order: list[str], shards: int, index: int) -> DataFrame:
    """Every shards-th row in order, from index on."""
    return ranked(rows, order, "rank_").where(F.col("rank_") % shards == index).drop("rank_", "total_")


def first_per_group(rows: DataFrame, keys: list[str], order: list[str], n: int, prefix: Column) -> DataFrame:
    """The first n rows of each key, with an id made of a prefix and their number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("rank_", F.row_number().over(w) - 1).where(F.col("rank_") < n)
    return numbered.withColumn("task_id", F.concat(prefix, F.lit("_"), F.lpad(F.col("rank_").cast("string"), 4, "0"))).drop("rank_")


def nextfit(rows: DataFrame, keys: list[str], order: str, length: str, capacity: int, most: int | None = None) -> DataFrame:
    """Packs in order with one open bin: a row opens a new one if it doesn't fit. Rows over ``most`` go; a null most is no cap.

    A shard (the rows of a key) is one ordered fold, as the rule is sequential.
    """
    kept = rows if most is None else rows.where(F.col(length) <= most)
    held = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("long").alias("n")))).alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,pack:bigint,offset:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + x["n"] > capacity)
        pack, start = s["pack"] + new.cast("long"), F.when(new, F.lit(0).cast("long")).otherwise(s["used"])
        own = F.struct(x["o"].alias("o"), pack.alias("pack"), start.alias("offset"))
        return F.struct(pack.alias("pack"), (start + x["n"]).alias("used"), F.concat(s["out"], F.array(own)).alias("out"))

    packed = held.select(*keys, F.explode(F.aggregate("x", zero, step)["out"]).alias("p"))
    return packed.select(*keys, F.col("p.o").alias(order), "p.pack", "p.offset")


def rebatched(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Full batches of so many rows in order; the last, shorter one is dropped."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumns({"rank_": F.row_number().over(w.orderBy(order)) - 1, "total_": F.count("*").over(w)})
    kept = numbered.withColumn("batch", F.floor(F.col("rank_") / size)).where(F.col("batch") < F.floor(F.col("total_") / size))
    return kept.drop("rank_", "total_")


def padded_to(rows: DataFrame, order: list[str], divisor: int) -> DataFrame:
    """rows and, flagged is_pad, its first ones again until the number of rows is a multiple of divisor."""
    numbered = ranked(rows, order, "rank_")
    missing = F.pmod(-F.col("total_"), F.lit(divisor))
    times = F.ceil((missing - F.col("rank_")) / F.col("total_"))
    again = numbered.where(F.col("rank_") < missing).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1)))))
    pads = again.drop("copy_").withColumn("is_pad", F.lit(True))
    return numbered.withColumn("is_pad", F.lit(False)).unionByName(pads).drop("rank_", "total_")


def repeated(rows: DataFrame, order: Column, times: int, interleave: bool) -> DataFrame:
    """Each row so many times, with copy and the order that interleaving (or tiling) gives."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    first, second = (order, F.col("copy")) if interleave else (F.col("copy"), order)
    return out.withColumn("position", F.struct(first.alias("a"), second.alias("b")))


def imbalance(rows: DataFrame, order: list[str], length: str, parts: int) -> DataFrame:
    """Sums of contiguous parts: least, greatest and their difference."""
    sums = contiguous_shards(rows, order[0], parts).groupBy("shard").agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("difference"))


def karmarkar_karp(lengths: list[int], parts: int, equal: bool) -> list[list[int]]:
    """Indices dealt to parts by largest differencing: the two most uneven partial solutions are joined, large to small sums.

    equal: all parts get as many indices, which needs a number of lengths that parts divides. A partial solution holds its
    parts that have indices alone, by rising sums; the smaller one is sorted into the larger, so that work and memory grow
    with the number of lengths, however many parts there are.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal:
        if len(lengths) % parts:
            raise ValueError("the parts can't be of equal size")
        groups = [order[i : i + parts] for i in range(0, len(order), parts)]
    else:
        groups = [[i] for i in order]
    # a part is its sum, a number that orders equal sums, and its indices
    spread = lambda sets: sets[0][0] * (len(sets) == parts) - sets[-1][0]
    heap, serial = [], len(order)
    for g, group in enumerate(groups):
        sets = [(lengths[i], n, [i]) for n, i in enumerate(group)]
        heap.append((spread(sets), g, sets))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, small), (_, _, large) = heapq.heappop(heap), heapq.heappop(heap)
        if len(small) > len(large):
            small, large = large, small
        # the largest of one meet the smallest of the other, first the parts without indices
        empty = min(len(small), parts - len(large))
        low, large[: len(small) - empty] = large[: len(small) - empty], []
        met = small[len(small) - empty :]
        for (x, _, own), (y, n, more) in zip(reversed(small[: len(small) - empty]), low, strict=True):
            own, more = (own, more) if len(own) > len(more) else (more, own)
            own.extend(more)
            met.append((x + y, n, own))
        for x, _, own in met:
            serial += 1
            bisect.insort(large, (x, serial, own))
        heapq.heappush(heap, (spread(large), serial, large))
    found = [sorted(own) for _, _, own in reversed(heap[0][2])] if heap else []
    return found + [[] for _ in range(parts - len(found))]


def balanced(rows: DataFrame, keys: list[str], order: str, length: str, parts: int, equal: bool = False) -> DataFrame:
    """rows' keys and order with the part that balances the sums of lengths in each batch (the rows of a key)."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(order, ignore_index=True)
        out = batch[[*keys, order]].copy()
        part = np.zeros(len(batch), int)
        for k, own in enumerate(karmarkar_karp(batch[length].tolist(), parts, equal)):
            part[own] = k
        out["part"] = part
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, order).schema.fields)
    return rows.select(*keys, order, length).groupBy(*keys).applyInPandas(run, f"{kinds}, part long")


def micro_batches(rows: DataFrame, keys: list[str], order: str, length: str, most_tokens: int) -> DataFrame:
    """As balanced, with as many parts in each batch as its tokens need."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(order, ignore_index=True)
        out = batch[[*keys, order]].copy()
        parts = min(len(batch), max(1, -(-int(batch[length].sum()) // most_tokens)))
        part = np.zeros(len(batch), int)
        for k, own in enumerate(karmarkar_karp(batch[length].tolist(), parts, False)):
            part[own] = k
        out["part"] = part
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, order).schema.fields)
    return rows.select(*keys, order, length).groupBy(*keys).applyInPandas(run, f"{kinds}, part long")


def greedy_parts(lengths: Column, parts: int) -> Column:
    """The part of each length in turn: the first of those with the least sum so far."""
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), parts).alias("sums"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        at = F.array_position(s["sums"], F.array_min(s["sums"])).cast("int")
        return F.struct(F.transform(s["sums"], lambda x, i: F.when(i == at - 1, x + n).otherwise(x)).alias("sums"), F.concat(s["out"], F.array(at - 1)).alias("out"))

    return F.aggregate(lengths, zero, step)["out"]


def bestfit_bins(lengths: list[int], capacity: int, look_ahead: int) -> list[list[int]]:
    """Bins filled from a pool of the next look_ahead items: the largest that still fits, or else the bin is closed."""
    pool: list[tuple[int, int]] = []
    at, bins = 0, []

    def refill() -> None:
        nonlocal at
        while at < len(lengths) and len(pool) < look_ahead:
            bisect.insort(pool, (lengths[at], -at))
            at += 1

    refill()
    while pool:
        room, own = capacity, []
        while pool:
            k = bisect.bisect_right(pool, (room, 1)) - 1
            if k < 0:
                break
            n, i = pool.pop(k)
            own.append(-i)
            room -= n
            refill()
        if not own:
            own.append(-pool.pop()[1])
            refill()
        bins.append(own)
    return bins


def length_grouped_bins(lengths: list[int], capacity: int, most_items: int, most_tokens: int, padded: bool) -> list[list[int]]:
    """Bins cut from bounded pools sorted by falling length: an item opens a new bin when the cost (padded: the longest
    times the number; else the sum) would pass the capacity. The last, underfull bin of a pool goes on into the next."""
    bins: list[list[int]] = []
    pool: list[int] = []

    def cut(final: bool) -> list[int]:
        items = sorted(pool, key=lambda i: (-lengths[i], i))
        own: list[int] = []
        for i in items:
            cost = lengths[own[0]] * (len(own) + 1) if own and padded else sum(lengths[j] for j in own) + lengths[i]
            if own and cost > capacity:
                bins.append(own)
                own = []
            own.append(i)
        if final and own:
            bins.append(own)
            own = []
        return own

    tokens = 0
    for i, n in enumerate(lengths):
        pool.append(i)
        tokens += n
        if len(pool) >= most_items or tokens >= most_tokens:
            left = cut(False)
            if len(left) >= most_items:
                bins.append(left)
                left = []
            pool[:] = left
            tokens = sum(lengths[j] for j in pool)
    cut(True)
    return bins


def packed_by(rows: DataFrame, keys: list[str], order: str, length: str, bins) -> DataFrame:
    """Packs of each shard (the rows of a key) by bins(lengths): pack, slot and offset."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(order, ignore_index=True)
        lengths = shard[length].tolist()
        found = []
        for p, own in enumerate(bins(lengths)):
            offset = 0
            for slot, i in enumerate(own):
                found.append((*[shard[k].iloc[i] for k in keys], shard[order].iloc[i], p, slot, offset))
                offset += lengths[i]
        return pd.DataFrame(found, columns=[*keys, order, "pack", "slot", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, order).schema.fields)
    return rows.select(*keys, order, length).groupBy(*keys).applyInPandas(run, f"{kinds}, pack long, slot long, offset long")


def hash_shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded order that is the same on every run and any number of tasks."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)
