"""Table functions for SQL: parse_apm_text and parse_trace, for `FROM t, LATERAL parse_trace(t.text)`.

They give what text_snapshots and parsed_traces give, for callers who have SQL only; those stay the faster way.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.logs import SPAN
from ..operators.traces import INDENT
from .metrics import ARROW, LEAST, METRICS

_METRICS = {name: (re.compile(pattern, re.ASCII), scale) for name, (pattern, scale) in METRICS.items()}
_ARROW, _SPAN, _INDENT, _HTTP = (re.compile(p, re.ASCII) for p in (ARROW, SPAN, INDENT, r"HTTP\s+(\d{3})"))


@udtf(returnType="block int, label string, " + ", ".join(f"{m} double" for m in METRICS))
class ParseApmText:
    """Snapshots of the metrics in a text: block, label (baseline or incident) and the six features; a null text has none."""

    def eval(self, text: str):
        whole = (text or "").strip(" \t\n\x0b\f\r")
        blocks = re.split(r"\n{2,}", whole)
        if len(blocks) == 1:
            blocks = [line for line in whole.split("\n") if line.strip()]
        for k, block in enumerate(blocks):
            shown, behind = {}, {}
            for name, (pattern, scale) in _METRICS.items():
                m = pattern.search(block)
                if not m:
                    continue
                line = block[block.rfind("\n", 0, m.start()) + 1 :].split("\n")[0]
                arrow = _ARROW.search(line)
                for into, value in ((shown, m[1]), (behind, arrow[2] if arrow else None)):
                    if value is not None:
                        v = float(value)
                        into[name] = min(1.0, v / scale if name != "error_rate" or "%" in line or v > 1 else v)
            if len(shown) >= LEAST:
                yield k, "baseline", *[shown.get(m, 0.0) for m in METRICS]
            merged = shown | behind
            if behind and len(merged) >= LEAST:
                yield k, "incident", *[merged.get(m, 0.0) for m in METRICS]


@udtf(returnType="span_id long, parent_id long, service string, operation string, duration_ms long, status string, detail string, http_status int")
class ParseTrace:
    """The spans of a trace in text form, one line each, with ids in order and parents by indentation; other lines are passed over."""

    def eval(self, text: str):
        open_: list[tuple[int, int]] = []
        n = 0
        for line in (text or "").split("\n"):
            m = _SPAN.search(line)
            if not m:
                continue
            indent = _INDENT.match(line)
            level = len(indent[1]) // 2 if indent else 0
            while open_ and open_[-1][0] >= level:
                open_.pop()
            http = _HTTP.search(m[6] or "")
            yield n, open_[-1][1] if open_ else None, m[2].strip(" "), m[3].split("(")[0].strip(" "), int(m[4]), m[5].lower(), m[6] or None, int(http[1]) if http else None
            open_.append((level, n))
            n += 1


def register(spark: SparkSession) -> SparkSession:
    """Make both functions known to the session's SQL."""
    spark.udtf.register("parse_apm_text", ParseApmText)
    spark.udtf.register("parse_trace", ParseTrace)
    return spark
