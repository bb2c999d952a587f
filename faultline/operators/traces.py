"""Traces from text: span lines, their parents by indentation, and spans that went well with a wrong result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logs

# fixed values: the mark of an indented span, and what a detail of a wrong result says
INDENT = r"^(\s*└─\s*)"
CLUES = r"(?i)wrong|should be|expected|stored\s+\d+.*(?:expected|should)"


def level_of(line: Column) -> Column:
    """Depth of a span line: half the length of its indentation with the mark, 0 without one."""
    return F.floor(F.length(F.regexp_extract(line, INDENT, 1)) / 2)


def with_parents(spans: DataFrame, trace: str, order: str, level: str = "level") -> DataFrame:
    """Adds span_id, the number of a span in its trace from 0, and parent_id: the nearest span above with a lower level.

    A trace's rows are read in order with the open spans as state, which are no more than the levels.
    """
    kinds = dict(spans.dtypes)
    names = spans.columns

    def run(batches):
        now, open_, n = None, [], 0
        for batch in batches:
            ids, parents = [], []
            for t, depth in zip(batch.column(names.index(trace)).to_pylist(), batch.column(names.index(level)).to_pylist(), strict=True):
                if t != now or not n:
                    now, open_, n = t, [], 0
                while open_ and open_[-1][0] >= depth:
                    open_.pop()
                ids.append(n)
                parents.append(open_[-1][1] if open_ else None)
                open_.append((depth, n))
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(parents, pa.int64())], [*names, "span_id", "parent_id"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", span_id long, parent_id long"
    return spans.repartition(F.col(trace)).sortWithinPartitions(trace, order).mapInArrow(run, schema)


def parsed_traces(lines: DataFrame, trace: str, order: str, line: str) -> DataFrame:
    """The spans of each trace's lines with ids and parents; lines that are no spans are left out."""
    found = logs.spans(lines.withColumn("level", level_of(F.col(line))), line)
    return with_parents(found.drop(line, "span_no"), trace, order).drop("level")


def is_silent(status: Column, detail: Column) -> Column:
    """Whether a span that is ok says that its result is wrong."""
    return (status == "ok") & F.coalesce(detail.rlike(CLUES), F.lit(False))
