"""What the operators of this subpackage share: staging tables and word patterns."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality and n-gram contracts: runs without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates words of the decontamination contract, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later uses don't compute it again."""
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    df.write.parquet(path)
    del df
    # shuffle files go once nothing refers to them; the written table needs none of those before it
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join_bounded(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = 500_000, salts: int = 32) -> DataFrame:
    """big joined with a table of one short row a key: sent to all tasks if it has at most so many rows, so that hot keys
    of big stay where they are; otherwise each key of big is dealt over several tasks, and small repeated for them."""
    if small.count() <= most:
        return big.join(F.broadcast(small), keys, how)
    rest = [c for c in big.columns if c not in keys]
    big = big.withColumn("salt_", F.pmod(F.xxhash64(*rest), F.lit(salts)))
    small = small.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return big.join(small, [*keys, "salt_"], how).drop("salt_")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def pieces(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most so many rows and bytes of that column's texts; a longer text is a slice of its own."""
    for batch in batches:
        first = total = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > first and (i - first >= rows or total + n > size):
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if batch.num_rows > first:
            yield batch.slice(first)
    # a worker lives on between tasks, beside those of other tasks
    pa.default_memory_pool().release_unused()


def plain_texts(texts: pa.Array) -> pa.Array:
    """Texts with nulls as empty ones, in an array of their own: some kernels misread arrays that begin inside another's buffers."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pa.concat_arrays([texts, pa.array([], pa.large_string())])
