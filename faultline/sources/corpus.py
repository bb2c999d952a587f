"""A corpus of labelled post-mortems: a directory with a JSON document for each incident, and what makes one unusable."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("incident_id", "ground_truth", "ticket")
SHAPE = (
    "incident_id string, ground_truth struct<start:string,end:string>, ticket struct<title:string,summary:string,description:string,reported_at:string>, lookback_hours double, "
    "metrics map<string,map<string,array<struct<t:string,v:double>>>>, deploys array<struct<repo:string,sha:string,merged_at:string>>, pages array<struct<service:string,paged_at:string>>, "
    "vendor_anomalies array<struct<service:string,metric:string,severity:string,start:string,end:string>>"
)


def seconds_of(text: Column) -> Column:
    """Seconds since 1970 of an ISO time; one without a zone is UTC, and null what cannot be read."""
    zoned = F.when(text.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned)) / 1_000_000


def iso(seconds: Column) -> Column:
    """2026-03-14T14:05:00Z of whole seconds since 1970, whatever the session's zone."""
    return F.date_format(F.timestamp_add("SECOND", seconds.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def judged(docs: DataFrame, file: str, text: str) -> DataFrame:
    """file, reason and `doc`, the parsed document: reason is null for a usable one, and else says what it lacks.  A field that
    is there with a null counts as there; ground truth that is no object has neither start nor end."""
    v = F.try_parse_json(F.col(text))
    there = lambda path: F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
    missing = F.array_join(F.array_compact(F.array(*[F.when(~there(k), F.lit(k)) for k in REQUIRED])), ", ")
    reason = (
        F.when(v.isNull(), "invalid JSON").when(missing != "", F.concat(F.lit("missing fields: "), missing))
        .when(~there("ground_truth.start") | ~there("ground_truth.end"), "ground_truth missing start/end")
    )
    return docs.select(F.col(file).alias("file"), reason.alias("reason"), F.from_json(text, SHAPE).alias("doc"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """judged() of every *.json file of a folder; an empty file, which Spark's scan passes over, has no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return judged(files.select(F.col("_metadata.file_name").alias("_file"), F.try_validate_utf8(F.col("content").cast("string")).alias("_text")), "_file", "_text")


def postmortems(corpus: DataFrame) -> DataFrame:
    """Of usable documents, in seconds: truth_start, truth_end, reported_at, lookback, the ticket's text, pages, deploys and
    vendor anomalies (start, end, severity) in their order, and the metrics."""
    d = lambda c: F.col(f"doc.{c}")
    times = lambda c, field: F.transform(d(c), lambda x: seconds_of(x[field]))
    vendor = F.transform(d("vendor_anomalies"), lambda x: F.struct(seconds_of(x["start"]).alias("start"), seconds_of(x["end"]).alias("end"), x["severity"].alias("severity")))
    return corpus.filter("reason is null").select(
        d("incident_id").alias("incident_id"), seconds_of(d("ground_truth.start")).alias("truth_start"), seconds_of(d("ground_truth.end")).alias("truth_end"), seconds_of(d("ticket.reported_at")).alias("reported_at"),
        (F.coalesce(d("lookback_hours"), F.lit(24.0)) * 3600).alias("lookback"), F.concat_ws(" ", d("ticket.title"), d("ticket.summary"), d("ticket.description")).alias("text"),
        times("pages", "paged_at").alias("pages"), times("deploys", "merged_at").alias("deploys"), vendor.alias("vendor"), d("metrics").alias("metrics"),
    )


def write_documents(rows: DataFrame, path: str) -> int:
    """Write each row (name, body) as a file of its own; the number written."""

    def run(batches):
        system, root = fs.FileSystem.from_uri(path if ":" in path else "file://" + os.path.abspath(path))
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write((body or "").encode())
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select("name", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
