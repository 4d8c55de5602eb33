"""Training sets as Spark data sources: mixes of files with filters inside the scan, and classes from a user's file.

A mix is read by tasks that own ranges of its files: row groups of Parquet whose middle lies in the range, lines of JSONL
that begin in it, other files whole. Filters on whole numbers, text, booleans and dates go into the scan, where Parquet
skips row groups by their statistics; Spark applies the rest. A file that can't be read isn't an error: it gives one row
with its path and the reason, so that the pass that reads the others can count it (``vellum.operators.drops``).
"""

from __future__ import annotations

import importlib.util
import io
import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema

#: Columns that a mix has beside those of its schema: the file, the source's folder for relative paths, why it couldn't be read.
OWN = "source_file string, data_folder string, unreadable string"
OWN_NAMES = [x.split()[0] for x in OWN.split(", ")]
KINDS = ("parquet", "jsonl", "json", "csv", "arrow")
#: Types whose values Arrow compares as Spark does; not so doubles (NaN) and times (zones).
COMPARED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType)


def sources_of(path: str) -> list[dict]:
    """The sources of a mix, from a YAML or JSON file with a list of them, or with one below ``datasets``."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return found["datasets"] if isinstance(found, dict) else found


def arrow_filter(filter_: Filter, kinds: dict[str, T.DataType]) -> pc.Expression | None:
    """The filter for Arrow, or None where Arrow would decide otherwise than Spark."""
    if isinstance(filter_, Not):
        inner = arrow_filter(filter_.child, kinds)
        return None if inner is None else ~inner
    if len(filter_.attribute) != 1 or not isinstance(kinds.get(name := filter_.attribute[0]), COMPARED):
        return None
    column = pc.field(name)
    if isinstance(filter_, IsNull):
        return column.is_null()
    if isinstance(filter_, IsNotNull):
        return column.is_valid()
    value = filter_.value
    if isinstance(filter_, In):
        return None if any(x is None for x in value) else column.isin(list(value))
    if isinstance(filter_, EqualNullSafe):
        return column.is_null() if value is None else pc.if_else(column.is_null(), False, column == value)
    if value is None:
        return None
    if isinstance(filter_, StringStartsWith):
        return pc.starts_with(column, value)
    if isinstance(filter_, StringEndsWith):
        return pc.ends_with(column, value)
    if isinstance(filter_, StringContains):
        return pc.match_substring(column, value)
    compare = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}.get(type(filter_))
    return getattr(column, compare)(value) if compare else None


@dataclass
class Range(InputPartition):
    """The part of a file that a task reads: what begins, or has its middle, from first up to after."""

    path: str
    kind: str
    folder: str | None
    first: int
    after: int


class MixReader(DataSourceReader):
    def __init__(self, schema: T.StructType, sources: list[dict], split: int):
        self.schema, self.sources, self.split = schema, sources, split
        self.fields = [f for f in schema.fields if f.name not in OWN_NAMES]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {f.name: f.dataType for f in self.fields}
        for filter_ in filters:
            if arrow_filter(filter_, kinds) is None:
                yield filter_
            else:
                self.filters.append(filter_)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        out = []
        for s in self.sources:
            if s["data_type"] not in KINDS:
                raise ValueError(f"unknown kind of source: {s['data_type']}")
            store, path = fs.FileSystem.from_uri(s["path"]) if "://" in s["path"] else (fs.LocalFileSystem(), s["path"])
            info = store.get_file_info(path)
            if info.type == fs.FileType.Directory:
                inside = store.get_file_info(fs.FileSelector(path, recursive=True))
                files = sorted((f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
            else:
                files = [info]
            whole = s["data_type"] not in ("parquet", "jsonl")
            scheme = s["path"].split("://")[0] + "://" if "://" in s["path"] else ""
            for f in files:
                size = f.size or 0
                for first in range(0, 1 if whole else max(size, 1), self.split):
                    after = size + 1 if whole or first + self.split >= size else first + self.split
                    out.append(Range(f"{scheme}{f.path}", s["data_type"], s.get("data_folder"), first, after))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        own = to_arrow_schema(self.schema)
        wanted = pa.schema([own.field(f.name) for f in self.fields])
        kinds = {f.name: f.dataType for f in self.fields}
        conditions = [arrow_filter(f, kinds) for f in self.filters]
        condition = None
        for c in conditions:
            condition = c if condition is None else condition & c

        def row(n: int, values: dict) -> pa.RecordBatch:
            fixed = {"source_file": part.path, "data_folder": part.folder, "unreadable": None}
            columns = [values[f.name] if f.name in values else pa.array([fixed.get(f.name)] * n, f.type) for f in own]
            return pa.RecordBatch.from_arrays(columns, schema=own)

        try:
            for batch in batches_of(part, wanted, condition):
                yield row(batch.num_rows, dict(zip(batch.schema.names, batch.columns, strict=True)))
        except (OSError, ValueError, pa.ArrowException) as error:
            values = {f.name: pa.nulls(1, f.type) for f in wanted}
            reason = f"{type(error).__name__}: {error}"[:500]
            yield row(1, values | {"unreadable": pa.array([reason], own.field("unreadable").type)})


def fitted(batch: pa.RecordBatch, wanted: pa.Schema) -> pa.RecordBatch:
    """The wanted columns, cast; those that aren't there are null."""
    columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in wanted]
    return pa.RecordBatch.from_arrays(columns, schema=wanted)


def lines_from(file, first: int, after: int) -> Iterator[bytes]:
    """The lines that begin from first up to after: the one that is under way at first is another range's."""
    if first:
        file.seek(first - 1)
        file.readline()
    while file.tell() < after and (line := file.readline()):
        if line.strip():
            yield line


def batches_of(part: Range, wanted: pa.Schema, condition: pc.Expression | None, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq
    from pyarrow import csv, fs, ipc
    from pyarrow import json as pajson

    store, path = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
    if part.kind == "parquet":
        with store.open_input_file(path) as file:
            meta = pq.ParquetFile(file).metadata
            own = []
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                at = min(group.column(c).dictionary_page_offset or group.column(c).data_page_offset for c in range(group.num_columns))
                middle = at + sum(group.column(c).total_compressed_size for c in range(group.num_columns)) // 2
                if part.first <= middle < part.after:
                    own.append(g)
        if not own:
            return
        fragment = ds.ParquetFileFormat().make_fragment(path, store, row_groups=own)
        there = fragment.physical_schema
        scanned = pa.schema([f for f in wanted if f.name in there.names])
        lacking = [f for f in wanted if f.name not in there.names]
        whole = pa.schema([*scanned, *lacking])
        yield from (fitted(b, wanted) for b in fragment.scanner(schema=whole, columns=wanted.names, filter=condition).to_batches() if b.num_rows)
        return

    def kept(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = fitted(batch, wanted)
        if condition is not None:
            batch = pa.Table.from_batches([batch]).filter(condition).combine_chunks()
            yield from batch.to_batches()
        else:
            yield batch

    if part.kind == "jsonl":
        with io.BufferedReader(store.open_input_file(path), 1 << 20) as file:
            options = pajson.ParseOptions(explicit_schema=wanted, unexpected_field_behavior="ignore")
            held: list[bytes] = []
            for line in lines_from(file, part.first, part.after):
                held.append(line if line.endswith(b"\n") else line + b"\n")
                if len(held) == rows:
                    yield from (b for t in kept_table(pajson, held, options) for b in kept(t))
                    held = []
            if held:
                yield from (b for t in kept_table(pajson, held, options) for b in kept(t))
    elif part.kind == "json":
        with store.open_input_stream(path) as file:
            found = json.loads(file.read())
        yield from kept(pa.RecordBatch.from_pylist([{k: x.get(k) for k in wanted.names} for x in found], wanted))
    elif part.kind == "csv":
        with store.open_input_stream(path) as file:
            options = csv.ConvertOptions(column_types=wanted, include_columns=wanted.names, include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False)
            for batch in csv.open_csv(file, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=options):
                yield from kept(batch)
    else:
        with store.open_input_file(path) as file:
            raw = file.read()
        try:
            found = ipc.open_stream(raw).read_all()
        except pa.ArrowInvalid:
            found = ipc.open_file(raw).read_all()
        for batch in found.to_batches():
            yield from kept(batch)


def kept_table(pajson, lines: list[bytes], options) -> list[pa.RecordBatch]:
    raw = b"".join(lines)
    return pajson.read_json(pa.BufferReader(raw), pajson.ReadOptions(block_size=len(raw) + 1), options).to_batches()


class Mix(DataSource):
    """Options: schema by spark.read.schema(); sources, a JSON list of {path, data_type, data_folder}; split, bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "vellum_mix"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MixReader(schema, json.loads(self.options["sources"]), int(self.options.get("split", 128 << 20)))


def mix(spark: SparkSession, sources: list[dict] | str, schema: str, split: int = 128 << 20) -> DataFrame:
    """The rows of several sources with the columns of schema, and OWN: source_file, data_folder and unreadable.

    sources: {path (a file or folder), data_type (one of KINDS), data_folder} each, or the path of a file that lists them.
    Columns that a file lacks are null, others are left out. A file that can't be read, or isn't there, gives a row whose
    unreadable isn't null for each of its ranges that fails (filters that Spark applies itself drop it like other rows of
    nulls); an empty folder gives none. What a range gave before it failed stays.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mix)
    found = sources_of(sources) if isinstance(sources, str) else sources
    return spark.read.format(Mix.name()).schema(f"{schema}, {OWN}").option("sources", json.dumps(found)).option("split", split).load()


def readable() -> Column:
    return F.col("unreadable").isNull()


def class_from(path: str, name: str, base: type) -> type:
    """A class of a user's file by name. A file or class that isn't there, or that doesn't derive from base, raises."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    spec = importlib.util.spec_from_file_location(f"user_{abs(hash(path))}", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    found = getattr(module, name, None)
    if found is None:
        raise AttributeError(f"{path} has no {name}")
    if not (isinstance(found, type) and issubclass(found, base)):
        raise TypeError(f"{name} of {path} must derive from {base.__name__}")
    # tasks can't import the user's file, so it travels with them
    cloudpickle.register_pickle_by_value(module)
    return found


def custom(spark: SparkSession, path: str, name: str, schema: str | None = None, **options) -> DataFrame:
    """The rows of a user's own data source: a class of a Python file that derives from pyspark's DataSource."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = class_from(path, name, DataSource)
    spark.dataSource.register(found)
    reader = spark.read.format(found.name()).options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load()
