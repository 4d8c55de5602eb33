"""What the operators share."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from vellum.llm import common


def test_join_bounded_gives_the_same_either_way(spark):
    big = spark.range(500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"), "id")
    small = spark.createDataFrame([(k, f"v{k}") for k in (1, 7, 20)], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        rows = [sorted(map(tuple, common.join_bounded(big, small, ["k"], how, most=most).collect()), key=str) for most in (10, 0)]
        assert rows[0] == rows[1]


def test_plain_texts_of_a_slice():
    texts = pa.array(["É Ab", None, "ÇC", "xY"] * 50)
    got = pc.ascii_lower(common.plain_texts(texts.slice(121, 60))).to_pylist()
    assert got == [{"É Ab": "É ab", None: "", "ÇC": "Çc", "xY": "xy"}[t] for t in texts.slice(121, 60).to_pylist()]


def test_staged_tables_keep_rows_and_lie_in_the_shared_folder(spark):
    df = common.staged(spark.range(5).withColumn("s", F.lit(None).cast("string")), "x")
    folder = common.shared_dir(spark).split("file:")[-1].strip("/")
    assert df.count() == 5 and all(folder in f for f in df.inputFiles())
