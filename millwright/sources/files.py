"""Spreadsheet exports, typed CSV, JSON arrays, archives, snapshots and inventories, as sources and sinks.

Sinks write folders of part files, as many as there are partitions; nothing is gathered for the sake of one file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Kinds of archive members by the end or the beginning of their names (lower case), first match first.
MEMBERS = (("report", "report.csv", ""), ("build_assignment", "buildassignment.json", ""), ("rmc", "", "rmc"), ("ncr", "", "ncr"), ("casting_map", "castingmap.json", ""), ("vendor_info", "vendorinfo.json", ""))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An exported sheet: the first row names the columns, columns without a name go, all values are text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.drop(*[c for c in df.columns if not c.strip() or c.startswith("_c")])


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a fixed schema; what doesn't parse is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)


def read_json_array(spark: SparkSession, path: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """A file that is one array of objects, or a line for each; columns are renamed."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumnsRenamed(renamed or {})


def members(archives: DataFrame) -> DataFrame:
    """archives (path, content) -> path, member, kind and content of all files in them. An archive is opened in its row's
    task; one that isn't a zip file gives a row of the kind `broken`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        rows = [(path, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    rows = [(path, None, None)]
                for row in rows:  # one member at a time in memory on the JVM's side
                    yield pd.DataFrame([row], columns=["path", "member", "content"])

    rows = archives.select("path", "content").mapInPandas(run, "path string, member string, content binary")
    base = F.lower(F.element_at(F.split("member", "/"), -1))
    kind = F.when(F.col("member").isNull(), "broken")
    for name, end, begin in MEMBERS:
        kind = kind.when(base.endswith(end) if end else base.startswith(begin), name)
    return rows.select("path", "member", kind.otherwise("other").alias("kind"), "content")


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    return members(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def inventory(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """name, length and modified of the files of one kind; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def append_snapshot(df: DataFrame, path: str, kind: str, batch: int, user: str) -> None:
    """Each row as JSON, with the kind, batch, user and time, behind what is there."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    df.select(F.lit(kind).alias("kind"), F.lit(batch).cast("long").alias("batch_no"), row.alias("json"), F.lit(user).alias("updated_by"), F.current_timestamp().alias("updated_on")).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, hidden: tuple[str, ...] = ()) -> None:
    """With a header and quotes where they are needed, without hidden columns; nested values are JSON in their cell."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    shown = [f for f in df.schema.fields if f.name not in hidden]
    cells = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in shown]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """An object a line; read_json_array reads it as it reads an array."""
    df.write.json(path)


def write_groups(df: DataFrame, path: str, group: str) -> None:
    """A folder for each group, which stands for a sheet; a large group has several files."""
    df.write.partitionBy(group).option("header", True).option("escape", '"').csv(path)


def append_events(events: DataFrame, path: str, batch: int) -> None:
    """Appends audit events as one batch, in a folder of its own: written again, after a failure, it replaces itself and no other."""
    events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of append_events(), with their numbers."""
    return spark.read.schema(schema.add("batch", "long")).parquet(path)
