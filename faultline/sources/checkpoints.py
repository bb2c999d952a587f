"""Checkpoints of incidents: a JSON document for each, written beside its old one and moved over it."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checked import PHASES

VERSION = 1
FIELDS = "format_version int, incident_id string, started_at string, updated_at string, rca_stage string, last_completed_phase string, phase_outputs map<string,string>"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def accepted(docs: DataFrame, file_id: str, text: str) -> DataFrame:
    """The checkpoints in these documents.  Left out are missing (null) and corrupt ones, what is no object, other versions,
    and documents that name another incident than their file."""
    whole = F.when(F.try_parse_json(F.col(text)).isNotNull() & F.col(text).rlike(r"^\s*\{"), F.from_json(text, FIELDS))
    rows = docs.select(F.col(file_id).alias("_file"), whole.alias("c"))
    return rows.filter((F.col("c.format_version") == VERSION) & (F.col("c.incident_id") == F.col("_file"))).select("c.*")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The accepted checkpoints of a folder."""
    docs = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return accepted(docs.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("_id"), "value"), "_id", "value")


def merged(existing: DataFrame | None, phases: DataFrame, now: Column) -> DataFrame:
    """Checkpoints after these phases (incident_id, phase, output as JSON, rca_stage, seq): outputs by phase, the last of a
    phase counts; the phase of the greatest seq is the last completed one; a stage that is set stays.  An unknown phase
    ends the job."""
    known = F.when(F.col("phase").isin(*PHASES), True).otherwise(F.raise_error(F.concat(F.lit("unknown phase: "), F.coalesce("phase", F.lit("null")))).cast("boolean"))
    first_stage = F.min(F.when(F.col("rca_stage").isNotNull(), F.struct("seq", "rca_stage")))
    latest = phases.filter(known).groupBy("incident_id", "phase").agg(F.max("seq").alias("seq"), F.max_by("output", "seq").alias("output"), first_stage.alias("stage"))
    new = latest.groupBy("incident_id").agg(
        F.map_from_entries(F.collect_list(F.struct("phase", "output"))).alias("_outputs"), F.max_by("phase", "seq").alias("_last"), F.min("stage")["rca_stage"].alias("_stage"),
    )
    if existing is None:
        existing = phases.sparkSession.createDataFrame([], FIELDS)
    both = existing.join(new, "incident_id", "full_outer")
    none = F.create_map().cast("map<string,string>")
    old, fresh = F.coalesce("phase_outputs", none), F.coalesce("_outputs", none)
    return both.select(
        F.lit(VERSION).alias("format_version"), "incident_id", F.coalesce("started_at", now).alias("started_at"), F.when(F.col("_last").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce(F.nullif("rca_stage", F.lit("")), "_stage").alias("rca_stage"), F.coalesce("_last", "last_completed_phase").alias("last_completed_phase"),
        F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh).alias("phase_outputs"),
    )


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else "file://" + os.path.abspath(path))


def write_checkpoints(checkpoints: DataFrame, path: str) -> int:
    """Write one document for each incident; a reader sees the old one or the new one, never a part.  The number written."""

    def run(batches):
        system, root = _at(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                outputs = {k: json.loads(v) if v is not None else None for k, v in row["phase_outputs"] or []}
                body = json.dumps(row | {"phase_outputs": outputs}, indent=2, sort_keys=True)
                temporary = f"{root}/.{row['incident_id']}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temporary) as f:
                    f.write(body.encode())
                system.move(temporary, f"{root}/{row['incident_id']}.json")
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return checkpoints.select(*NAMES).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_some(incidents: DataFrame, path: str) -> DataFrame:
    """The accepted checkpoints of these incidents (incident_id); only their own files are opened."""

    def run(batches):
        system, root = _at(path)
        for batch in batches:
            texts = []
            for i in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{root}/{i}.json") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except FileNotFoundError:
                    texts.append(None)
            yield pa.record_batch({"_id": batch.column(0), "value": pa.array(texts, pa.string())})

    return accepted(incidents.select(F.col("incident_id").cast("string")).mapInArrow(run, "_id string, value string"), "_id", "value")


def phase_sink(path: str):
    """A sink for foreachBatch that merges completed phases (incident_id, phase, output as JSON, rca_stage, seq, at) into the
    incidents' documents, so a job that is started again finds how far each incident has come.

    A batch that comes again changes nothing: one that was finished has left a mark with its number, and one that was cut off
    merges the same phases into what it had written, with the batch's greatest `at` as the time of writing.
    """

    def write(batch: DataFrame, number: int) -> None:
        system, root = _at(path)
        mark = f"{root}/_batches/{number}"
        if system.get_file_info(mark).type == fs.FileType.File:
            return
        phases = batch.persist()
        try:
            now = phases.agg(F.max("at")).first()[0]
            if now is not None:
                before = read_some(phases.select("incident_id").distinct(), path)
                write_checkpoints(merged(before, phases.drop("at"), F.lit(now)), path)
        finally:
            phases.unpersist()
        system.create_dir(f"{root}/_batches", recursive=True)
        with system.open_output_stream(mark):
            pass

    return write


#: Batches of a document table after which one writes every document again, so that a reader meets no more than these.
WHOLE_EVERY = 16


def _marks(path: str) -> dict[int, str]:
    """The finished batches of a document table and what they wrote: `part` (the incidents they touched), `whole` or `none`."""
    system, root = _at(path)
    marks = {}
    for info in system.get_file_info(fs.FileSelector(f"{root}/_batches", allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.isdigit():
            with system.open_input_stream(info.path) as f:
                marks[int(info.base_name)] = f.read().decode()
    return marks


def read_document_table(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The newest document of each incident in a folder of `table_sink`, of batches below this number; batches that were cut
    off do not count."""
    marks = {k: v for k, v in _marks(path).items() if v != "none" and (below is None or k < below)}
    since = max((k for k, v in marks.items() if v == "whole"), default=0)
    numbers = sorted(k for k in marks if k >= since)
    if not numbers:
        return spark.createDataFrame([], FIELDS)
    rows = spark.read.schema(f"{FIELDS}, batch long").parquet(*[f"{path}/batch-{k}" for k in numbers])
    if len(numbers) == 1:
        return rows.drop("batch")
    return rows.groupBy("incident_id").agg(F.max_by(F.struct(*NAMES), "batch").alias("c")).select("c.*")


def table_sink(path: str):
    """A sink for foreachBatch like `phase_sink` for very many incidents, for which a file each is too slow to write and too
    many to list: a batch writes the documents of its incidents as one table, and the newest of an incident counts.
    `read_document_table` reads them; outputs stay the JSON that they came as, and one that is no JSON ends the job.

    A batch that comes again changes nothing: a finished one has left a mark, and one that was cut off is written anew from
    the batches below it.
    """

    def write(batch: DataFrame, number: int) -> None:
        system, root = _at(path)
        marks = _marks(path)
        if number in marks:
            return
        now = batch.agg(F.max("at")).first()[0]
        kind = "none"
        if now is not None:
            kinds = [marks[k] for k in sorted(marks) if marks[k] != "none"]
            kind = "whole" if len(kinds) >= WHOLE_EVERY and "whole" not in kinds[-WHOLE_EVERY + 1 :] else "part"
            before = read_document_table(batch.sparkSession, path, number)
            if kind == "part":
                before = before.join(batch.select("incident_id").distinct(), "incident_id", "left_semi")
            good = F.when(F.col("output").isNull() | F.try_parse_json("output").isNotNull(), F.col("output")).otherwise(F.raise_error(F.concat(F.lit("the output is no JSON: "), "output")))
            docs = merged(before, batch.drop("at").withColumn("output", good), F.lit(now))
            docs.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        system.create_dir(f"{root}/_batches", recursive=True)
        temporary = f"{root}/_batches/.{number}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as f:
            f.write(kind.encode())
        system.move(temporary, f"{root}/_batches/{number}")

    return write


def first_open(outputs: Column) -> Column:
    """The first phase in order that has no output yet; null if all have one."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in PHASES]), lambda p: ~F.map_contains_key(outputs, p)), F.lit(0))


def next_phase(checkpoints: DataFrame) -> DataFrame:
    """incident_id, next_phase: the first phase in order that has no output yet; null if all have one."""
    return checkpoints.select("incident_id", first_open(F.col("phase_outputs")).alias("next_phase"))


def clear_checkpoints(incidents: DataFrame, path: str) -> DataFrame:
    """incident_id, existed: whether there was a checkpoint, which is gone then."""

    def run(batches):
        system, root = _at(path)
        for batch in batches:
            there = []
            for i in batch.column(0).to_pylist():
                there.append(system.get_file_info(f"{root}/{i}.json").type == fs.FileType.File)
                if there[-1]:
                    system.delete_file(f"{root}/{i}.json")
            yield pa.record_batch({"incident_id": batch.column(0), "existed": pa.array(there, pa.bool_())})

    return incidents.select(F.col("incident_id").cast("string")).distinct().mapInArrow(run, "incident_id string, existed boolean")
