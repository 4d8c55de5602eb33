"""The corpus pipeline: documents to packed sequences, by five operators.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. All but the last
return the columns of documents; n_chars follows the text where a stage changes it. Rows with a null or repeated
doc_id go through every stage like others; empty tables give no rows. Columns beyond those of documents are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, lines, ngram_join, packing, quality
from vellum.llm.common import forget, staged, text_key
from vellum.session import table


def boxed(docs: DataFrame, *open_: str) -> DataFrame:
    """These columns of docs, and all others in one struct, so that an operator's columns can't clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in open_]
    return docs.select(*open_, F.struct(*(rest or [F.lit(0).alias("none")])).alias("row"))


def unboxed(found: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs again, with those given anew."""
    old = lambda c: F.col(c) if c in found.columns and c in ("doc_id", "text", "source") else F.col("row").getField(c)
    return found.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])


def rows_of(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs whose (doc_id, text) is among those of found (left_semi), or isn't (left_anti)."""
    keyed = boxed(docs, "doc_id", "text").withColumn("key", text_key(F.col("text")))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    met = keyed["doc_id"].eqNullSafe(found["found_id"]) & (keyed["key"] == found["found_key"])
    return unboxed(keyed.join(found, met, how), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return unboxed(quality.judge(boxed(docs, "text")).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share, short ones too."""
    found = lines.dedup(boxed(docs, "doc_id", "text", "source"), min_words=1)
    new = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {}
    return unboxed(found, docs, **new)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates; repeated rows once. Documents without words stay."""
    chosen = ngram_join.cluster(docs).where("chosen").groupBy("doc_id", "text_key").agg(F.count(F.when(F.col("n_shingles") > 0, 1)).alias("times"))
    chosen = staged(chosen, "chosen")
    again = chosen.where("times > 1")
    kept = rows_of(docs, chosen.where("times <= 1"), "left_semi")
    return kept if again.isEmpty() else kept.unionByName(rows_of(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't cover to a twentieth or more of their words."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where(decontaminate.contaminated())
    return rows_of(docs, found, "left_anti")


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("harmonic_packing", harmonic_packing),
]

#: SQL can't express the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents. What a stage returned is deleted once the next one's result is written, but for the
    documents that the last stage reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
