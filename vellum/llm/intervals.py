"""Joins of intervals that overlap, partitioned by length, and the sale and session pairs built on them.

``overlapping`` groups the right side by key, logarithmic length class and start granule: class k holds lengths of over
2^(k-1) up to 2^k, and its granules are 2^k long, so an interval of class k that meets [first, last] starts in one of the
granules from first - 2^k + 1 to last. A left interval probes these granules alone, in each class that its key has, by an
equi-join; what is found is then verified. Open intervals, which never end, are a class of their own.

A long or open left interval would probe each small granule that it spans. Granules therefore also stand in groups of 4,
16, 64, ...: a right interval is listed once under each, and a left one probes the few aligned groups that make up its
range exactly, at most six a size. Each pair is met once.

Nothing is sent to all tasks and no group of a key is held by one: hot keys are many granules, and Spark splits those that
are still large while it joins. Of the data the driver sees one number, the widest range of granules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import staged

#: Granules of one size in a granule of the next, as a power of two.
STEP = 2
#: The class of intervals that never end.
OPEN = -1
MINUTE = 60_000_000
SLOT = 360 * MINUTE


def micros(df: DataFrame, column: str) -> Column:
    """Whole microseconds since 1970 of a timestamp with or without a zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(column))
    return F.unix_micros(F.col(column))


def floored(value: Column, unit: int) -> Column:
    """The whole number of units in value, rounded down below zero too."""
    return F.call_function("div", value - F.pmod(value, F.lit(unit)), F.lit(unit))


def relation(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """How an interval lies to another that it shares a point with; a null end is later than all others and equal to itself."""
    never = F.lit(2**63 - 1)
    a, b = F.coalesce(last, never), F.coalesce(other_last, never)
    by_end = lambda earlier, same, later: F.when(a < b, earlier).when(a == b, same).otherwise(later)
    return (
        F.when(first < other_first, by_end("overlaps", "finished_by", "contains"))
        .when(first == other_first, by_end("starts", "equals", "started_by"))
        .otherwise(by_end("during", "finishes", "overlapped_by"))
    )


def shared(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """Points that both have; null if neither ends."""
    return F.least(last, other_last) - F.greatest(first, other_first) + 1


def length_class(first: Column, last: Column) -> Column:
    """k for 2^(k-1) < points <= 2^k; OPEN without an end."""
    return F.when(last.isNull(), OPEN).when(last <= first, 0).otherwise(F.length(F.bin(last - first)))


def granule(point: Column, size_class: Column) -> Column:
    return F.call_function("shiftright", point, F.greatest(size_class, F.lit(0)))


def ceiling(x: Column, level: int) -> Column:
    return F.shiftright(x + F.lit((1 << STEP * level) - 1), STEP * level)


def groups(low: Column, high: Column, levels: int) -> Column:
    """(level, granule) of the fewest aligned groups of 1, 4, 16, ... granules that make up low to high."""
    out = []
    for level in range(levels + 1):
        at, end = ceiling(low, level), F.shiftright(high + 1, STEP * level) - 1
        span = lambda a, b, level=level: F.when(a <= b, F.transform(F.sequence(a, b), lambda g: F.struct(F.lit(level).alias("level"), g.alias("granule"))))
        if level == levels:
            out.append(span(at, end))
            continue
        up, top = ceiling(low, level + 1), F.shiftright(high + 1, STEP * (level + 1)) - 1
        inner = up <= top
        out.append(span(at, F.when(inner, F.shiftleft(up, STEP) - 1).otherwise(end)))
        out.append(F.when(inner, span(F.shiftleft(top + 1, STEP), end)))
    return F.flatten(F.filter(F.array(*out), lambda x: x.isNotNull()))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, left and right (structs of all columns of a side) of all rows of equal key whose intervals share a point,
    with relation (of left to right) and shared (points; null if both are open).

    Both sides: key of any type, first and last (long, both inclusive; last null: the interval never ends), and other
    columns of any name. Rows with a null key or first, or a last before first, pair with nothing. Repeated rows pair
    one by one. An empty side gives no rows. Points lie within 2^61 of zero. right is read three times, so stage it if
    it is costly.
    """
    usable = F.col("key").isNotNull() & F.col("first").isNotNull() & (F.col("last").isNull() | (F.col("last") >= F.col("first")))
    boxed = lambda df, name: df.where(usable).select("key", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    r = boxed(right, "right").withColumn("class", length_class(F.col("right.first"), F.col("right.last")))
    r = r.withColumn("at", granule(F.col("right.first"), F.col("class")))
    ranges = r.groupBy("key", "class").agg(F.min("right.first").alias("low"), F.max("right.first").alias("high"), F.min("at").alias("a"), F.max("at").alias("b"))
    wide = ranges.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    levels = -(-int(wide).bit_length() // STEP)
    # a row a key, of at most 65 classes
    classes = ranges.groupBy("key").agg(F.collect_list(F.struct("class", "low", "high")).alias("classes"))
    l = boxed(left, "left").join(classes.hint("merge"), "key").select("key", "left", F.inline("classes"))  # noqa: E741
    reach = F.when(F.col("class") == OPEN, F.col("low")).otherwise(F.col("left.first") - F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("class", F.lit(0))) + 1)
    low, high = F.greatest("low", reach), F.least(F.coalesce("left.last", "high"), "high")
    l = l.where(low <= high).select("key", "left", "class", F.inline(groups(granule(low, F.col("class")), granule(high, F.col("class")), levels)))  # noqa: E741
    listed = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.struct(n.alias("level"), F.call_function("shiftright", F.col("at"), n * STEP).alias("granule")))
    r = r.select("key", "right", "class", F.inline(listed))
    a, b = F.col("left"), F.col("right")
    ends = a["first"], a["last"], b["first"], b["last"]
    met = (a["first"] <= F.coalesce(b["last"], a["first"])) & (b["first"] <= F.coalesce(a["last"], b["first"]))
    both = l.join(r.hint("merge"), ["key", "class", "level", "granule"]).where(met)
    return both.select("key", "left", "right", relation(*ends).alias("relation"), shared(*ends).alias("shared"))


def sessions(clicks: DataFrame, gap: int = 30 * MINUTE, block: int = 336) -> DataFrame:
    """client_id, first, last (microseconds) and open of click sessions: a click more than gap after its client's
    previous one begins another, and one is open if a click at its last time has kind error.

    clicks: client_id, ts and kind; rows with a null client_id or ts are ignored, repeated rows change nothing.

    Clicks of a client within one gap-long grain of time belong together, so they are summed to a row a grain before they
    are shuffled. Grains are chained within blocks of so many, and blocks within clients: a client with any number of
    clicks is as many rows as its time has grains, and no task gets more than a block of these, or a row a block.
    """
    rows = clicks.select("client_id", micros(clicks, "ts").alias("ts"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error"))
    rows = rows.where("client_id IS NOT NULL AND ts IS NOT NULL").withColumn("grain", floored(F.col("ts"), gap))
    grains = rows.groupBy("client_id", "grain").agg(F.min("ts").alias("first"), F.max(F.struct("ts", "error")).alias("end"))
    grains = grains.withColumn("block", floored(F.col("grain"), block))
    inside = Window.partitionBy("client_id", "block").orderBy("grain")
    before = F.lag("end.ts").over(inside)
    grains = grains.withColumn("begin", F.when(F.col("first") - before > gap, F.col("first")))
    blocks = grains.groupBy("client_id", "block").agg(F.min("first").alias("first"), F.max("end.ts").alias("last"), F.max("begin").alias("begin"))
    along = Window.partitionBy("client_id").orderBy("block")
    goes_on = F.coalesce(F.col("first") - F.lag("last").over(along) <= gap, F.lit(False))
    blocks = blocks.withColumn("goes_on", goes_on)
    newest = F.coalesce("begin", F.when(~F.col("goes_on"), F.col("first")))
    carried = F.last(newest, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("client_id", "block", F.when(F.col("goes_on"), carried).otherwise(F.col("first")).alias("carried"))
    own = F.last("begin", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chained = grains.withColumn("own", own).join(blocks.hint("merge"), ["client_id", "block"])
    found = chained.groupBy("client_id", F.coalesce("own", "carried").alias("first")).agg(F.max("end").alias("end"))
    return found.select("client_id", "first", F.col("end.ts").alias("last"), F.col("end.error").alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client_id, first, last (microseconds) and open of sales with a client_id and sold_at.

    A sale runs from sold_at through the latest of it and shipped_at of the lines with its sale_id, and is open if its
    status is open. Each row of sales is a sale of its own; lines of no sale, and times before sold_at, change nothing.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("shipped")).where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max("shipped").alias("shipped"))
    rows = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    rows = rows.where("client_id IS NOT NULL AND first IS NOT NULL").join(shipped.hint("merge"), "sale_id", "left")
    return rows.select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def slots(df: DataFrame, unit: int) -> DataFrame:
    """key, and first and last as slots; no last if open."""
    last = F.when(~F.col("open"), floored(F.col("last"), unit))
    rest = [c for c in df.columns if c not in ("client_id", "first", "last", "open")]
    return df.select(F.col("client_id").alias("key"), floored(F.col("first"), unit).alias("first"), last.alias("last"), *rest)


def sale_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, unit: int = SLOT) -> DataFrame:
    """Per sale_id and relation: n_pairs with sessions of the same client that share a slot, overlap_slots (null if both
    are open) and sessions_crc, the sum of crc32 of the sessions' exact first time as decimal text.

    Slots alone are compared, so equal intervals of a client are joined once: sessions are summed by interval, and what
    an interval of sales found is given to each of its sales. Sales that pair with nothing give no row; rows of sales
    that repeat a sale_id add up. Empty tables give no rows.
    """
    clicked = sessions(clicks).withColumn("crc", F.crc32(F.col("first").cast("string").cast("binary")))
    clicked = slots(clicked, unit).groupBy("key", "first", "last").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    clicked = staged(clicked, "sessions")
    sold = staged(slots(sale_intervals(sales, lines), unit), "sales")
    kinds = sold.groupBy("key", "first", "last").agg(F.lit(True).alias("seen"))
    pairs = overlapping(kinds, clicked)
    found = pairs.groupBy("key", F.col("left.first").alias("first"), F.col("left.last").alias("last"), "relation").agg(
        F.sum("right.n").alias("n_pairs"), F.sum(F.col("shared") * F.col("right.n")).alias("overlap_slots"), F.sum("right.crc").alias("sessions_crc")
    )
    # null stands for a missing end and has to meet itself
    never = lambda df: df.withColumn("last", F.coalesce("last", F.lit(2**63 - 1)))
    given = never(sold).join(never(found).hint("merge"), ["key", "first", "last"])
    return given.groupBy("sale_id", "relation").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")])


ORACLE_SQL = """
WITH RECURSIVE crc_bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
c AS (SELECT client_id, epoch_us(ts) AS t, bool_or(coalesce(kind = 'error', false)) AS e FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY t) AS k FROM n),
s AS (SELECT client_id, min(t) AS f, CASE WHEN NOT arg_max(e, t) THEN CAST(floor(max(t) / 21600000000) AS BIGINT) END AS z FROM g GROUP BY client_id, k),
h AS (SELECT client_id, CAST(floor(f / 21600000000) AS BIGINT) AS a, z,
  xor(list_reduce(list_transform(string_split(CAST(f AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda y, x: xor(y // 256, t[1 + xor(y % 256, x)]), 4294967295), 4294967295) AS crc FROM s, crc),
w AS (SELECT sale_id, max(epoch_us(shipped_at)) AS z FROM sale_lines GROUP BY sale_id),
v AS (SELECT sales.sale_id, client_id, CAST(floor(epoch_us(sold_at) / 21600000000) AS BIGINT) AS a,
  CASE WHEN status IS DISTINCT FROM 'open' THEN CAST(floor(greatest(epoch_us(sold_at), coalesce(w.z, epoch_us(sold_at))) / 21600000000) AS BIGINT) END AS z
  FROM sales LEFT JOIN w ON sales.sale_id = w.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, h.crc, least(v.z, h.z) - greatest(v.a, h.a) + 1 AS n, CASE WHEN v.z IS NULL AND h.z IS NULL THEN true ELSE false END AS both_open,
  CASE WHEN v.a < h.a THEN 'overlaps finished_by contains' WHEN v.a = h.a THEN 'starts equals started_by' ELSE 'during finishes overlapped_by' END AS names,
  CASE WHEN coalesce(v.z, 9e15) < coalesce(h.z, 9e15) THEN 1 WHEN coalesce(v.z, 9e15) = coalesce(h.z, 9e15) THEN 2 ELSE 3 END AS i
  FROM v JOIN h ON v.client_id = h.client_id AND v.a <= coalesce(h.z, 9e15) AND h.a <= coalesce(v.z, 9e15))
SELECT sale_id, string_split(names, ' ')[i] AS relation, count(*) AS n_pairs, CAST(sum(CASE WHEN NOT both_open THEN n END) AS BIGINT) AS overlap_slots,
  CAST(sum(crc) AS BIGINT) AS sessions_crc FROM p GROUP BY ALL
"""
