"""Result sinks: fan-out, failures aside, append and compact, and reports."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.tables import last_per_key, unfinished
from vellum.session import staged


def fan_out(rows: DataFrame, path: str, by: str = "dpi") -> int:
    """JSON lines below path/by=value. Rows with an error go to path/failed instead, and then nothing else is written; returns their number."""
    failed = rows.where("error IS NOT NULL")
    n = failed.count()
    if n:
        failed.write.mode("overwrite").json(f"{path}/failed")
    else:
        rows.drop("error").write.mode("overwrite").partitionBy(by).json(f"{path}/all")
    return n


def training_parquet(rows: DataFrame, path: str) -> None:
    """A training table; an empty one is an error."""
    if rows.isEmpty():
        raise ValueError("no row was selected")
    rows.write.mode("overwrite").parquet(path)


def append_results(rows: DataFrame, path: str, attempt: int) -> None:
    """Results of one attempt, added to those before."""
    rows.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(path)


def compacted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, in order."""
    return last_per_key(rows, keys, ["attempt"]).orderBy(*order)


def still_to_do(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has to do: keys whose last record is missing or has an error."""
    return unfinished(wanted, last_per_key(rows, keys, ["attempt"]), keys)


def transposed_samples(rows: DataFrame, key: str) -> DataFrame:
    """One row a prompt with its sampled responses as an array."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample", "response"))).alias("x"))
    return held.select(key, F.transform("x", lambda s: s["response"]).alias("responses"))


def metrics_table(step: int, metrics: dict[str, float], spark) -> DataFrame:
    return spark.createDataFrame([(step, k, float(v)) for k, v in metrics.items()], "step long, key string, value double")


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def check_resume(spark, path: str, config: dict) -> None:
    """Remember a config below a path; another one raises there."""
    own = spark.createDataFrame([(fingerprint(config), json.dumps(config, sort_keys=True))], "fingerprint string, config string")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/config")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        own.coalesce(1).write.parquet(f"{path}/config")
        return
    before = spark.read.parquet(f"{path}/config").first()
    if before["fingerprint"] != fingerprint(config):
        raise ValueError("the config differs from that of the run to resume")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table."""
    found = rows.limit(most).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])


def reports(rows: DataFrame, path: str, by: list[str]) -> None:
    """A report as JSON lines, CSV with a header and Markdown, in order, one file each below path. Reports are short."""
    own = rows.orderBy(*by).coalesce(1)
    own.write.mode("overwrite").json(f"{path}/json")
    own.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    spark = rows.sparkSession
    spark.createDataFrame([(markdown(rows.orderBy(*by)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def running_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with their place in each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def digest_of_all(rows: DataFrame, text: str, order: str, n: str) -> DataFrame:
    """One row: the sum of n, and digest, the md5 of all texts in order with commas between them; null without rows.

    A digest is one stream, which no other task can go on with: one task reads the sorted parts one after the other, a
    batch at a time, and keeps the digest's state alone. It is written at once, as few bytes that later steps read.
    """

    def run(batches):
        state, total, some = hashlib.md5(), 0, False
        for batch in batches:
            total += pc.sum(batch.column(1)).as_py() or 0
            for value in batch.column(0):
                state.update(("," if some else "").encode() + value.as_py().encode())
                some = True
        yield pa.RecordBatch.from_pylist([{"n": total, "digest": state.hexdigest() if some else None}], pa.schema([("n", pa.int64()), ("digest", pa.string())]))

    ordered = rows.orderBy(order).select(text, F.col(n).cast("long")).coalesce(1)
    # at most one row; none of a plan that Spark knows to be empty
    return staged(ordered.mapInArrow(run, "n long, digest string"), "digest").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"))
