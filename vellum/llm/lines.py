"""Line dedup by distinct-site spread, in DataFrame expressions alone.

Every line of at least ``min_words`` words is known by two 64-bit hashes. Per line, a HyperLogLog sketch of the
sites it stands on is merged by aggregation, partly before the shuffle, so a line that a third of all documents
carry is one small row a task. Lines whose estimate lies clearly above the threshold are boilerplate; those within
four standard errors of it get exact distinct counts. A boilerplate line stays in the document with the smallest
doc_id that has it, where it stands first, and goes from all others.

The lines table is written once and read by each step. Boilerplate lines are sent to the lines while they are few, and
meet them in a salted join beyond that; only the places of removed lines go back to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_bounded, let, staged, text_key, words

KEY = ["k1", "k2"]


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line that counts: its hashes, site, document and place."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")
    site = F.coalesce("source", F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), site.alias("site"), lines)
    rows = rows.where(F.size(words(F.col("line"))) >= min_words)
    return rows.select(
        F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "site", "doc_id", "text_key", "pos"
    )


def spread(lines: DataFrame, min_sites: int, lg_k: int = 12, errors: float = 4) -> DataFrame:
    """The hashes of boilerplate lines, and first: the document and place that keep the line."""
    seen = lines.groupBy(*KEY).agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first")
    )
    seen = staged(seen.select(*KEY, "first", F.hll_sketch_estimate("sites").alias("sites")).where(F.col("sites") > 1), "spread")
    margin = errors * 1.04 / math.sqrt(2**lg_k) * min_sites
    low, high = math.floor(min_sites - margin), math.ceil(min_sites + margin)
    near = seen.where(F.col("sites").between(low, high))
    exact = join_bounded(lines, near.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.count_distinct("site").alias("exact"))
    counted = near.join(exact, KEY).where(F.col("exact") >= min_sites).select(*KEY, "first")
    return seen.where(F.col("sites") > high).select(*KEY, "first").unionByName(counted)


def dedup(docs: DataFrame, min_sites: int = 8, min_words: int = 3) -> DataFrame:
    """docs without the boilerplate lines, and with n_lines and n_removed.

    docs: doc_id, text, source, and any other columns, which stay, but for columns named n_lines or n_removed, which
    are replaced. A null text stays null and has no lines; a null source is a site of its own. Lines of fewer than ``min_words`` words count for nothing and are never removed.
    Repeated rows lose the same lines, and a null doc_id counts as the smallest. Empty tables give no rows.
    """
    lines = staged(line_table(docs, min_words), "lines")
    found = staged(spread(lines, min_sites), "boilerplate")
    hit = join_bounded(lines, found, KEY).where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    gone = hit.groupBy("doc_id", "text_key").agg(F.array_distinct(F.collect_list("pos")).alias("gone_"))
    # the caller's columns travel in one struct, so that theirs and ours can't be taken for each other
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("key"))
    both = own.join(gone, own["row.doc_id"].eqNullSafe(gone["doc_id"]) & (own["key"] == gone["text_key"]), "left")
    text = F.col("row.text")
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    left = let(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone_")), lambda i: F.get(p, i)), "\n"))
    counts = F.size(F.filter(parts, lambda x: F.size(words(x)) >= min_words)).cast("long")
    found = both.select(
        "row", F.when(F.col("gone_").isNull(), text).otherwise(left).alias("text"),
        counts.alias("n_lines"), F.coalesce(F.size("gone_"), F.lit(0)).cast("long").alias("n_removed"),
    )
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return found.select(*kept, "text", "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text", "source"), min_words=1).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, line, pos,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 1 AS counts
  FROM (SELECT doc_id, source, unnest(p) AS line, unnest(range(0, len(p))) AS pos
        FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
), b AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM l WHERE counts
  GROUP BY line HAVING count(DISTINCT site) >= 8
), m AS (
  SELECT l.*, coalesce(counts AND b.line IS NOT NULL AND struct_pack(d := doc_id, p := pos) <> first, false) AS gone
  FROM l LEFT JOIN b ON l.line = b.line
)
SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM m GROUP BY doc_id
"""
