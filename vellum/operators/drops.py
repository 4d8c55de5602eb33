"""Rows that are dropped on the way and counted in the pass that drops them.

Reasons are tested in order, and a row counts for the first that holds. The counts are observed metrics of the scan that
feeds the result, so nothing is read twice; they are there once an action has run over the kept rows, and raise before.
Spark counts the rows of tasks that succeed; a task that failed and ran again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Drops:
    """A named stage of filters with its counts."""

    def __init__(self, stage: str, **reasons: Column):
        """reasons: conditions under which a row is dropped; null counts as not."""
        self.stage, self.reasons = stage, reasons
        self.seen: Observation | None = None

    def reason(self) -> Column:
        """The first reason that holds, or null for rows to keep."""
        out = F.lit(None).cast("string")
        for name, condition in reversed(self.reasons.items()):
            out = F.when(condition, name).otherwise(out)
        return out

    def kept(self, rows: DataFrame) -> DataFrame:
        """rows without those that a reason drops; repeated and empty input is fine. A stage is for one table."""
        if self.seen is not None:
            raise ValueError(f"stage {self.stage} is in use")
        self.seen = Observation(self.stage)
        marked = rows.withColumn("__reason", self.reason())
        counts = [F.count(F.when(F.col("__reason") == name, 1)).alias(name) for name in self.reasons]
        return marked.observe(self.seen, F.count(F.lit(1)).alias("__rows"), *counts).where(F.col("__reason").isNull()).drop("__reason")

    def counts(self) -> dict[str, int]:
        """rows that came in, dropped rows by reason, and kept ones; waits for an action over the kept rows."""
        if self.seen is None:
            raise ValueError(f"stage {self.stage} has no rows yet")
        found = dict(self.seen.get)
        total = found.pop("__rows")
        return {"rows": total, **found, "kept": total - sum(found.values())}


def report(spark, stages: list[Drops]) -> DataFrame:
    """stage, reason and n of stages whose rows have been read: those that came in, by reason, and kept."""
    rows = [(s.stage, reason, n) for s in stages for reason, n in s.counts().items()]
    return spark.createDataFrame(rows, "stage string, reason string, n long")
