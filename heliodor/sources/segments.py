"""Reading and writing segments, and attaching Parquet files as read-only ones."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import DbError
from ..functions.values import DataType
from ..plans.bind import Table


def schema(table: Table) -> T.StructType:
    fields = []
    for i, c in enumerate(table.columns):
        fields.append(T.StructField(f"c{i}", c.type.spark()))
        if c.type.name == "DECIMAL":
            fields.append(T.StructField(f"s{i}", T.ByteType()))
    return T.StructType(fields)


FILE = "_metadata.file_name"


def _columns(table: Table, segment: dict) -> list[Column]:
    """Columns of an attached segment."""
    columns: list[Column] = []
    for i, (c, source) in enumerate(zip(table.columns, segment["columns"])):
        column = F.expr(source).cast(c.type.spark())
        columns.append(column.alias(f"c{i}"))
        if c.type.name == "DECIMAL":
            columns.append(F.when(column.isNotNull(), F.lit(c.type.scale)).cast("byte").alias(f"s{i}"))
    return columns


def _frames(spark: SparkSession, root: str, table: Table, segments: list, extra: list[Column], only: list[str] | None = None) -> list[tuple[list, DataFrame]]:
    """(segments, rows with extra columns) of each scan: all stored segments are one. Files that a segment has lost (or that are not asked for) are pruned by name."""
    stored = [s for s in segments if "dir" in s]
    plain = [F.col(f.name) for f in schema(table)]
    scans = [([s], spark.read.parquet(s["path"]), _columns(table, s)) for s in segments if "path" in s]
    if stored:
        scans.insert(0, (stored, spark.read.schema(schema(table)).parquet(*[os.path.join(root, s["dir"]) for s in stored]), plain))
    out = []
    for members, frame, columns in scans:
        lost = [f for s in members for f in s.get("without", [])]
        if lost:
            frame = frame.filter(~F.col(FILE).isin(lost))
        if only is not None:
            frame = frame.filter(F.col(FILE).isin(only))
        out.append((members, frame.select(*columns, *extra)))
    return out


def read(spark: SparkSession, root: str, table: Table, segments: list | None = None, only: list[str] | None = None) -> DataFrame:
    """All rows of a table (or of some of its segments, or of some files)."""
    frames = [f for _, f in _frames(spark, root, table, table.segments if segments is None else segments, [], only)]
    if not frames:
        return spark.createDataFrame([], schema(table))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def count(spark: SparkSession, root: str, table: Table, matched: Column) -> list[dict[str, tuple[int, int]]]:
    """For each segment of the table, rows and matching rows of each file, in one job."""
    out: list[dict] = [{} for _ in table.segments]
    place = {s["dir"]: i for i, s in enumerate(table.segments) if "dir" in s}
    extra = [F.col(FILE).alias("file"), F.col("_metadata.file_path").alias("path")]
    whole = None
    for members, frame in _frames(spark, root, table, table.segments, extra):
        # A stored file names its segment; an attached segment is a scan of its own.
        at = F.regexp_extract("path", r"/(seg-[0-9a-f]+)/[^/]*$", 1) if "dir" in members[0] else F.lit(str(table.segments.index(members[0])))
        frame = frame.withColumn("segment", at)
        whole = frame if whole is None else whole.union(frame)
    if whole is not None:
        for r in whole.groupBy("segment", "file").agg(F.count("*").alias("n"), F.count_if(matched).alias("hits")).collect():
            out[place[r.segment] if r.segment in place else int(r.segment)][r.file] = (r.n, r.hits)
    return out


def write(frame: DataFrame, root: str, name: str, key: int, spread: bool, files: int | None = None) -> None:
    """Write a segment; a large one is range-clustered (into that many files, else as many as adaptive execution finds right) and sorted by the key, so key bounds skip files and row groups."""
    try:
        frame = frame.repartitionByRange(*[n for n in (files,) if n], f"c{key}").sortWithinPartitions(f"c{key}") if spread else frame.coalesce(1).sortWithinPartitions(f"c{key}")
        frame.write.mode("error").parquet(os.path.join(root, name))
    except OSError as e:
        raise DbError("STORAGE_FULL", str(e)) from e


def starts(spark: SparkSession, root: str, table: Table, name: str) -> list:
    """Smallest key of each file of a range-clustered segment, in order: where an ordered reader may cut it."""
    if table.key_column.type.name not in ("INTEGER", "TEXT"):
        return []
    frame = spark.read.schema(schema(table)).parquet(os.path.join(root, name))
    rows = frame.groupBy("_metadata.file_path").agg(F.min(f"c{table.key}").alias("first")).select("first").orderBy("first").collect()
    return [r.first for r in rows]


def attach_spec(path: str, columns: list[str]) -> dict:
    """A segment that is a Parquet file or directory elsewhere: one Spark expression for each column. Its key must be unique and not null."""
    return {"path": path, "columns": columns}


def column_type(text: str) -> DataType:
    return DataType.parse(text)
