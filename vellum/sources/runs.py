"""What a run leaves behind to go on from: completion markers, rollout logs and the state of a loader, as tables.

Markers and states are appended and the newest counts, so a job that dies between its output and its marker does the
sample again, and one that is run twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.tables import last_per_key

MARKER = "sample string, dpi int, version string, font string, pages array<struct<name:string,width:int,height:int>>, written timestamp"


def there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def mark(done: DataFrame, path: str, version: str) -> None:
    """Add a marker for each row of done (sample, dpi, font, pages), made by this version of the renderer."""
    done.select("sample", "dpi", F.lit(version).alias("version"), "font", "pages", F.current_timestamp().alias("written")).write.mode("append").parquet(path)


def unmarked(wanted: DataFrame, path: str, version: str) -> DataFrame:
    """Rows of wanted (sample, dpi, font) whose newest marker isn't one of this version and font with pages."""
    spark = wanted.sparkSession
    if not there(spark, path):
        return wanted
    newest = last_per_key(spark.read.schema(MARKER).parquet(path), ["sample", "dpi"], ["written"])
    good = newest.where((F.col("version") == version) & (F.size("pages") > 0)).select("sample", "dpi", "font")
    return wanted.join(good, ["sample", "dpi", "font"], "left_anti")


def valid_part(values: Column, mask: Column) -> Column:
    """The first so many values as the mask has ones."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.slice(values, 1, n)


def rollout_log(rows: DataFrame, step: int) -> DataFrame:
    """Log rows of a step: step, prompt, response, logprobs, token_rewards, reward, ground_truth and values.

    rows: prompt, response, response_mask (array), logprobs, token_rewards, token_scores and values (arrays by place of
    the response, padded like the mask; values may be null), ground_truth. reward is the sum of the valid scores.
    """
    own = lambda c: valid_part(F.col(c), F.col("response_mask"))
    return rows.select(
        F.lit(step).cast("long").alias("step"), "prompt", "response", own("logprobs").alias("logprobs"), own("token_rewards").alias("token_rewards"),
        F.aggregate(own("token_scores"), F.lit(0.0), lambda a, x: a + x).alias("reward"), "ground_truth", own("values").alias("values"),
    )


def append_log(rows: DataFrame, path: str, step: int) -> None:
    """JSON lines of a step, added to those of steps before; a step that is logged again replaces its own lines."""
    rollout_log(rows, step).drop("step").write.mode("overwrite").json(f"{path}/step={step}")


def save_loader(spark: SparkSession, path: str, step: int, epoch: int, place: int, seed: int) -> None:
    """Where a loader stands after a step: its epoch, how many rows of it were taken, and the seed of its order."""
    state = spark.createDataFrame([(step, epoch, place, seed)], "step long, epoch long, place long, seed long")
    state.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def latest_loader(spark: SparkSession, path: str) -> dict | None:
    """The state of the last step, as it was saved last; None if none was."""
    if not there(spark, path):
        return None
    newest = spark.read.parquet(path).orderBy(F.desc("step"), F.desc("written")).limit(1).collect()
    return {k: newest[0][k] for k in ("step", "epoch", "place", "seed")} if newest else None


def rest_of_epoch(rows: DataFrame, state: dict | None, rank: str) -> DataFrame:
    """Rows that a loader has yet to give in its epoch, by their rank in the order of its seed."""
    return rows if state is None else rows.where(F.col(rank) >= state["place"])
