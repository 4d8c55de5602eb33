"""Two streams of characters laid out differently: proof that they are the same, where they first differ, and their pairs.

A stream's hash is the sum of code * base^place, modulo a prime, over two primes. Sums merge in any order, so a stream is
never brought together, yet each character counts at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Primes below 2^31, so that products stay below 2^62, and a base for each.
PRIMES = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))


def power(base: int, exponent: Column, prime: int, bits: int = 40) -> Column:
    """base^exponent modulo prime, by squaring."""
    squares, x = [], base
    for _ in range(bits):
        squares.append(x)
        x = x * x % prime
    table = F.array(*[F.lit(s).cast("long") for s in squares])
    step = lambda a, i: F.when(F.call_function("shiftright", exponent, i).bitwiseAND(F.lit(1)) == 1, a * F.get(table, i) % prime).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(F.bin(exponent)) - 1, F.lit(0))), F.lit(1).cast("long"), step)


def hashes(place: Column, code: Column, places: int | None = None) -> list[Column]:
    """What a character adds to each of a stream's hashes. places: all places are below it, so that powers are looked up."""
    raised = lambda base, prime: F.get(F.array(*[F.lit(pow(base, i, prime)).cast("long") for i in range(places)]), place) if places else power(base, place, prime)
    return [(code.cast("long") + 1) * raised(base, prime) % prime for prime, base in PRIMES]


def digests(rows: DataFrame, keys: list[str], place: str, code: str, places: int | None = None) -> DataFrame:
    """keys, n and h (array) of the streams of rows."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"h{i}") for i, x in enumerate(hashes(F.col(place), F.col(code), places))])
    return sums.select(*keys, "n", F.array(*[F.col(f"h{i}") % prime for i, (prime, _) in enumerate(PRIMES)]).alias("h"))


def letters(glyphs: DataFrame, key: str, page: str, order: str, text: str) -> DataFrame:
    """A row per character other than white space of each glyph: all columns, with its place in the key's stream and code.

    Places are numbered within pages and moved on by the pages before, so that a window is a page at most. A null text
    has no characters; glyphs of equal order on a page go by their text.
    """
    chars = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda c: ~c.rlike(r"(?U)^\s*$"))
    own = glyphs.withColumn("chars_", chars).withColumn("n_", F.size("chars_").cast("long"))
    inside = Window.partitionBy(key, page).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("before_", F.coalesce(F.sum("n_").over(inside), F.lit(0)))
    pages = own.groupBy(key, page).agg(F.sum("n_").alias("n_"))
    ahead = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(key, page, F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("ahead_"))
    own = own.join(pages.hint("merge"), [key, page]).select(*glyphs.columns, (F.col("ahead_") + F.col("before_")).alias("first_"), F.posexplode("chars_").alias("k_", "char"))
    return own.withColumn("place", F.col("first_") + F.col("k_")).withColumn("code", F.ascii("char")).drop("first_", "k_", "char")


def differences(source: DataFrame, target: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """key, n_source, n_target, identical and first_difference: the first place where two streams differ, or where the
    shorter ends; null if they don't. Both: key, place, code. A key that one side lacks has an empty stream there.

    Hashes are compared by block; characters are joined in the first block that differs alone. No side is broadcast: a row
    per character is far larger than the table it comes from, by whose size Spark would judge.
    """
    blocked = lambda df: df.select(key, "place", "code", F.floor(F.col("place") / block).alias("block"), (F.col("place") % block).alias("inside_"))
    s, t = blocked(source), blocked(target)
    own = lambda df: digests(df, [key, "block"], "inside_", "code", block)
    both = own(s).alias("s").join(own(t).hint("merge").alias("t"), [key, "block"], "full")
    same = F.coalesce((F.col("s.n") == F.col("t.n")) & (F.col("s.h") == F.col("t.h")), F.lit(False))
    n = lambda side: F.coalesce(F.sum(f"{side}.n"), F.lit(0))
    found = both.groupBy(key).agg(n("s").alias("n_source"), n("t").alias("n_target"), F.min(F.when(~same, F.col("block"))).alias("block"))
    odd = found.where("block IS NOT NULL").select(key, "block")
    near = lambda df, name: df.join(odd.hint("merge"), [key, "block"]).select(key, "place", F.col("code").alias(name))
    apart = near(s, "a").join(near(t, "b").hint("merge"), [key, "place"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    first = apart.groupBy(key).agg(F.min("place").alias("first_difference"))
    return found.join(first.hint("merge"), key, "left").select(key, "n_source", "n_target", F.col("block").isNull().alias("identical"), "first_difference")


def paired(source: DataFrame, target: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """key, place, source and target (structs of the other columns) of the characters of identical streams, place by place."""
    boxed = lambda df, name: df.select(key, "place", F.struct(*[c for c in df.columns if c not in (key, "place", "code")]).alias(name))
    same = found.where("identical").select(key)
    return boxed(source, "source").join(same.hint("merge"), key).join(boxed(target, "target").hint("merge"), [key, "place"])
