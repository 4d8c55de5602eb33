"""Manifest, training-set and result sources with declared schemas, validation and quarantine."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import geometry
from vellum.operators.tables import unique_or_error

TURN = "struct<from:string,value:string,role:string,content:string>"
LOCATION = "struct<page:int,bbox:array<double>>"
MANIFEST = f"id string, image_dpi72 array<string>, image array<string>, text_path string, conversations array<{TURN}>, metadata string"
RESULT = (
    "id string, index long, task string, dataset string, subset string, length_bin string, generation string, raw_generation string, "
    "reasoning_content string, expected_answer array<string>, answers array<string>, answer string, all_classes array<string>, length long, "
    "random_string_to_prepend string, prompt_tokens long, initial_prompt_tokens long, completion_tokens long, cumulative_usage struct<completion_tokens:long>, "
    "finish_reason string, num_pages long, vision_tokens_est long, error string, skipped_reason string"
)
ROLLOUT = (
    "data_source string, env_name string, enable_tools boolean, prompt array<struct<role:string,content:string>>, images array<string>, high_res_images array<string>, "
    "reward_model struct<style:string,ground_truth:array<string>>, extra_info struct<index:long,id:string,gold:array<string>,num_pages:int,dpi:double,"
    f"high_res_dpi:double,evidence_locations:array<{LOCATION}>,evidence_bboxes_by_dpi:map<string,string>,task:string,ruler_version:string>"
)
CORRUPT = "_corrupt_record"


def read_lines(spark: SparkSession, path: str | list[str], schema: str, keep_file: bool = False) -> DataFrame:
    """JSON lines with a declared schema. Blank lines are no rows; lines that don't parse keep their text in _corrupt_record."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file")) if keep_file else rows


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that parsed, and the text of those that didn't."""
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A document manifest: every id is there and unique, or the first bad one raises."""
    return unique_or_error(parted(read_lines(spark, path, schema))[0], "id")


def load(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """One source by kind: json (an array in a file), jsonl, csv (with header), parquet, orc, or arrow (a folder of IPC files)."""
    if kind == "arrow":
        return arrow_folder(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "json":
        return reader.option("multiLine", "true").json(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "csv":
        return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    raise ValueError(f"unknown kind of source: {kind}")


def arrow_folder(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of a folder, read by one task each."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arrow").load(path)
    first = files.select("content").first()

    def opened(data: bytes):
        try:
            return pa.ipc.open_stream(data).read_all()
        except pa.ArrowInvalid:
            return pa.ipc.open_file(data).read_all()

    if first is None:
        raise ValueError(f"no Arrow file below {path}")
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(opened(first["content"]).schema)

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from opened(data).to_batches()

    return files.select("content").mapInArrow(run, schema)


def mixed(spark: SparkSession, sources: list[dict], on_error: str = "skip") -> DataFrame:
    """Several sources as one table. Each has path, data_type, data_folder, and perhaps a schema.

    A source that can't be read, or that holds images inside its rows, is left out (or raises, with on_error="raise").
    Ids of different sources may clash, so they are dropped; columns that a source lacks are null.
    """
    parts = []
    for s in sources:
        try:
            rows = load(spark, s["path"], s["data_type"], s.get("schema"))
            if any(f.dataType.simpleString().startswith("struct<bytes:binary") for f in rows.schema.fields):
                raise ValueError(f"images inside rows: {s['path']}")
        except Exception:
            if on_error == "raise":
                raise
            continue
        parts.append(rows.drop("id").withColumn("data_folder", F.lit(s.get("data_folder"))))
    if not parts:
        raise ValueError("no source could be read")
    return concatenated(parts)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """The rows of all tables; columns that one lacks are null there."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def nested(rows: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """A field below a column by its keys; arrays of one element give that element."""
    value = F.col(".".join([column, *keys]))
    kind = rows.select(value).schema.fields[0].dataType.typeName()
    return rows.withColumn(name, F.when(F.size(value) == 1, value[0]) if kind == "array" else value)


def numbered(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet rows with their file and their place in it, reading only the columns named."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))


def numbered_over(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As numbered, but the rows of a table in many files are numbered on from file to file, in the order of their paths."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("own_"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file
    sizes = rows.groupBy("source_file").agg(F.count("*").alias("n_")).select("source_file", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    return rows.join(F.broadcast(sizes), "source_file").withColumn("source_row", F.col("first_") + F.col("own_")).drop("own_", "first_")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width and height of PNG files, from their headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    size = geometry.png_size(F.substring("content", 1, 24))
    return files.select("path", size.alias("size")).select("path", "size.width", "size.height")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """text_path and text of whole files, to be joined with a manifest's column."""
    rows = spark.read.option("wholetext", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("text_path"), F.col("value").alias("text"))


def resolved(images: Column, folder: Column) -> Column:
    """Paths of an array that aren't absolute, below a folder."""
    return F.transform(images, lambda x: F.when(x.startswith("/") | x.contains("://"), x).otherwise(F.concat_ws("/", folder, x)))


def swapped_dpi(path: Column, dpi: int) -> Column:
    """The first dpi_N folder of a path as that of another resolution."""
    return F.regexp_replace(path, r"^(.*?)/dpi_\d+/", rf"$1/dpi_{dpi}/")


def config(path: str) -> dict:
    """A JSON config with what it inherits (``_base_``: a path beside it), and environment variables put in."""
    own = json.loads(Path(path).read_text())
    base = own.pop("_base_", None)
    merged = merge(config(os.path.join(os.path.dirname(path), base)), own) if base else own
    return expanded(merged)


def merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def expanded(value):
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value
