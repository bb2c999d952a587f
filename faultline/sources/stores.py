"""File-backed stores: directories of JSON records, append-only event logs, phase checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_records(spark: SparkSession, path: str, schema: StructType | str, required: list[str], multiline: bool = True) -> DataFrame:
    """Records of a directory; what is no JSON object or lacks a required field is left out."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    full = StructType.fromDDL(schema.toDDL() + ", _corrupt_record string")
    df = spark.read.schema(full).option("multiLine", multiline).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    good = F.col("_corrupt_record").isNull()
    for c in required:
        good = good & F.col(c).isNotNull()
    # the corrupt column alone cannot be asked of a scan that is pruned to it, so the rows are kept whole until filtered
    return df.filter(good).drop("_corrupt_record")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments (id, created_at, body) of an issue from files that each hold one page, a JSON array, of the tracker's answer."""
    return spark.read.schema("id long, created_at string, body string").option("multiLine", True).json(path).filter("id is not null")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """path, body of text files, each whole; one that is no UTF-8 has an empty body, and an empty one no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("body"))


def append_events(events: DataFrame, path: str, key: str) -> None:
    """Append to an event log that has a folder for each incident."""
    events.write.mode("append").partitionBy(key).json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of all incidents; blank, torn and foreign lines are left out."""
    return read_json_records(spark, path, schema, [], multiline=False)


def recent(events: DataFrame, at: str, now, seconds: int) -> DataFrame:
    """Events of the last seconds before `now` (a timestamp column), oldest first; unreadable times are left out.  A column
    that is a time already is compared as it is, so that the filter reaches the scan."""
    ts = F.try_to_timestamp(F.col(at)) if dict(events.dtypes)[at] == "string" else F.col(at)
    return events.filter(ts >= now - F.make_dt_interval(secs=F.lit(seconds))).orderBy(at)


def json_or_text(text):
    """(is_json, value): whether a text parses as JSON, and what it holds; a text that does not is a JSON string itself."""
    parsed = F.try_parse_json(text)
    return parsed.isNotNull(), F.coalesce(parsed, F.try_parse_json(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)))


def write_checkpoint(checkpoints: DataFrame | None, new: DataFrame) -> DataFrame:
    """Checkpoints (incident_id, phase, output, written_at) with the new rows merged in: the last written of a phase counts."""
    every = new if checkpoints is None else checkpoints.unionByName(new)
    return every.groupBy("incident_id", "phase").agg(F.max_by(F.struct("output", "written_at"), "written_at").alias("r")).select("incident_id", "phase", "r.*")


def last_phase(checkpoints: DataFrame) -> DataFrame:
    """The phase that was written last, which need not be the furthest."""
    return checkpoints.groupBy("incident_id").agg(F.max_by("phase", "written_at").alias("last_phase"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "output")))).alias("outputs"))
