"""Session settings, and the way this package reaches the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers once per application, so that they need no path of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="faultline-code-")
    path = os.path.join(folder, "faultline_code.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; made once where that is unset on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set")
            folder = "file://" + tempfile.mkdtemp(prefix="faultline-")
        context.setCheckpointDir(folder)
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, whatever kind of storage it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written below spark.checkpoint.dir, so that plans stay small and a lost executor costs no earlier step."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


class Written:
    """Tables of one computation, written to the shared folder; they are deleted when the block ends, so its result must
    have been written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def kept(self, rows: DataFrame) -> DataFrame:
        """The rows, written and read back: lineage is cut, and lost executors lose nothing."""
        self.paths.append(shared_path(self.spark, "step"))
        rows.write.parquet(self.paths[-1])
        return self.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def __enter__(self) -> Written:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)
