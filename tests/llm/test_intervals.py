"""Sessions, overlap joins and the pairs of sales and sessions against brute force."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellum.llm import intervals

SIDE = "key long, first long, last long, `class` string, level string, `left` long, granule string, relation string, at long"


def met(a, b):
    never = float("inf")
    a1, b1 = (never if x[2] is None else x[2] for x in (a, b))
    if a[0] is None or b[0] != a[0] or a[1] is None or b[1] is None or a1 < a[1] or b1 < b[1] or a[1] > b1 or b[1] > a1:
        return None
    names = [["overlaps", "finished_by", "contains"], ["starts", "equals", "started_by"], ["during", "finishes", "overlapped_by"]]
    sign = lambda x, y: (x > y) - (x < y)
    both = min(a1, b1)
    return names[sign(a[1], b[1]) + 1][sign(a1, b1) + 1], None if both == never else both - max(a[1], b[1]) + 1


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        first = rng.choice([rng.randrange(-700, 700), rng.randrange(-5, 5)])
        last = rng.choice([None, first, first + rng.randrange(4), first + rng.randrange(900), first - 1])
        out.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([first, first, first, None]), last))
    return out + out[:3]


@pytest.mark.parametrize("n, m", [(90, 120), (0, 20), (20, 0), (1, 1)])
def test_overlapping(spark, n, m):
    left, right = rows_of(1, n), rows_of(2, m)
    made = lambda rows: spark.createDataFrame([(*r, "c", "l", i, "g", "r", 5) for i, r in enumerate(rows)], SIDE)
    got = sorted((r["left"]["left"], r["right"]["left"], r.relation, r.shared) for r in intervals.overlapping(made(left), made(right)).collect())
    want = sorted((i, j, *x) for i, a in enumerate(left) for j, b in enumerate(right) if (x := met(a, b)))
    assert got == want


def test_points_alone(spark):
    one = spark.createDataFrame([("k", 3, 3)], "key string, first long, last long")
    assert [(r.relation, r.shared) for r in intervals.overlapping(one, one).collect()] == [("equals", 1)]


START = datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, first string, block long"


def clicked(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        client = rng.choice([1, 1, 2, 3, None])
        at = START + timedelta(seconds=rng.choice([rng.randrange(40 * 86400), 1800 * rng.randrange(300)])) + timedelta(microseconds=rng.choice([0, 0, 1]))
        out.append((i, rng.choice([at] * 9 + [None]), client, rng.choice(["error", "click", None]), "x", 1))
    # one client never pauses over a block of grains, to the microsecond
    out += [(n + i, START + timedelta(minutes=30 * i), 9, "click", "x", 1) for i in range(800)]
    out += [(n + 900, START + timedelta(minutes=30 * 799), 9, "error", "x", 1), (n + 901, START + timedelta(minutes=30 * 800, microseconds=1), 9, "view", "x", 1)]
    return out + out[:5]


def brute_sessions(rows):
    by = defaultdict(list)
    for _, ts, client, kind, *_ in rows:
        if client is not None and ts is not None:
            by[client].append(((ts - datetime(1970, 1, 1)) // timedelta(microseconds=1), kind))
    out = []
    for client, own in by.items():
        own.sort(key=lambda x: x[0])
        some = [own[0]]
        for x in [*own[1:], (10**18, None)]:
            if x[0] - some[-1][0] > 1_800_000_000:
                out.append((client, some[0][0], some[-1][0], any(k == "error" for t, k in some if t == some[-1][0])))
                some = []
            some.append(x)
    return sorted(out)


@pytest.mark.parametrize("zone", ["timestamp_ntz", "timestamp"])
def test_sessions(spark, zone):
    rows = clicked(4, 600)
    clicks = spark.createDataFrame(rows, CLICKS).withColumn("ts", F.col("ts").cast(zone)).repartition(5)
    got = sorted(tuple(r) for r in intervals.sessions(clicks).collect())
    assert got == brute_sessions(rows)
    assert sum(c == 9 for c, *_ in got) == 2


def test_sale_sessions(spark):
    rng = random.Random(8)
    clicks = clicked(5, 500)
    sales = [(i, rng.choice([1, 2, 3, 9, 7, None]), rng.choice(["open", "done", None]), rng.choice([START + timedelta(hours=rng.randrange(900))] * 5 + [None]), "x") for i in range(150)]
    sales += [*sales[:4], (None, 1, "done", START, "x")]
    lines = [(rng.choice([*range(200), 5, 5, None]), rng.choice([START + timedelta(hours=rng.randrange(-10, 1200)), None])) for _ in range(300)]
    got = intervals.sale_sessions(
        spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz, key string"),
        spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"), spark.createDataFrame(clicks, CLICKS),
    )
    micro = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    slot = 21_600_000_000
    found = [(c, f // slot, None if o else z // slot, f) for c, f, z, o in brute_sessions(clicks)]
    want = defaultdict(lambda: [0, None, 0])
    for i, client, status, sold, _ in sales:
        if client is None or sold is None:
            continue
        end = max([micro(sold), *[micro(t) for k, t in lines if k == i and i is not None and t]])
        own = (client, micro(sold) // slot, None if status == "open" else end // slot)
        for s in found:
            if x := met(own, s):
                at = want[i, x[0]]
                at[0] += 1
                at[1] = at[1] if x[1] is None else (at[1] or 0) + x[1]
                at[2] += zlib.crc32(str(s[3]).encode())
    assert {(r.sale_id, r.relation): [r.n_pairs, r.overlap_slots, r.sessions_crc] for r in got.collect()} == dict(want)
    assert len({k for _, k in want}) >= 8


def test_empty_shop(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    sales = none("sale_id long, client_id long, status string, sold_at timestamp_ntz")
    assert intervals.sale_sessions(sales, none("sale_id long, shipped_at timestamp_ntz"), none(CLICKS)).collect() == []


def test_no_group_grows_with_repeats(spark):
    """A client's clicks and sales in any number are as many joined rows as its distinct intervals."""
    def rows(n):
        sales = spark.range(n).selectExpr("id AS sale_id", "1L AS client_id", "'open' AS status", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, id % 48) AS sold_at")
        clicks = spark.range(n).selectExpr("1L AS client_id", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(id % 20) AS ts", "'click' AS kind")
        kinds = intervals.slots(intervals.sale_intervals(sales, spark.createDataFrame([], "sale_id long, shipped_at timestamp_ntz")), intervals.SLOT)
        return intervals.overlapping(kinds.select("key", "first", "last").distinct(), intervals.slots(intervals.sessions(clicks), intervals.SLOT)).count()

    assert rows(500) == rows(5000) > 0
