"""Service graphs and traces.

A service graph has a node for each service, so after aggregation it is small whatever the traffic; its iterations run in
one task behind a check of the edge count, beyond which they are refused; reachability is joins whose reach doubles.  Traces
are worked off one by one, in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import edge_weight
from ..session import Written, kept
from .traces import is_silent

#: Most distinct edges that one task iterates over.
MOST_EDGES = 2_000_000


def chain_edges(calls: DataFrame, trace: str, order: str, service: str, status: str, duration: str, ahead: int = 4) -> DataFrame:
    """src, dst, weight: from each call to the next call of another service among the following `ahead`, weights summed."""
    w = Window.partitionBy(trace).orderBy(order)
    nexts = [F.when(F.lead(service, k).over(w) != F.col(service), F.lead(service, k).over(w)) for k in range(1, ahead + 1)]
    found = calls.select(F.col(service).alias("src"), F.coalesce(*nexts).alias("dst"), edge_weight(F.col(status), F.col(duration)).alias("weight"))
    return merged(found.filter("dst is not null"))


def merged(edges: DataFrame) -> DataFrame:
    """Parallel edges become one, weights summed; graphs are merged by a union before."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def issue_edges(issues: DataFrame, service: str, called: str, kind: str) -> DataFrame:
    """src, dst, weight, call_type of calls that code issues name: an issue whose kind speaks of an error counts twice.  An
    issue without either service is left out, and a null kind is no error."""
    named = issues.filter((F.col(service) != "") & (F.col(called) != ""))
    weight = F.when(F.lower(kind).contains("error"), 2.0).otherwise(1.0)
    return merged(named.select(F.col(service).alias("src"), F.col(called).alias("dst"), weight.alias("weight"))).withColumn("call_type", F.lit("rpc"))


def _rank(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, restart: np.ndarray, damping: float, tol: float, rounds: int) -> np.ndarray:
    """Power iteration; weight that leaves through no edge is lost, and on convergence the iterate before it counts."""
    out = np.bincount(src, weights=weight, minlength=n)
    share = weight / out[src]
    r = restart.copy()
    for _ in range(rounds):
        new = (1 - damping) * restart + damping * np.bincount(dst, weights=share * r[src], minlength=n)
        if np.sqrt(((new - r) ** 2).sum()) < tol:
            break
        r = new
    return r


def pagerank(edges: DataFrame, errors: DataFrame | None = None, damping: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> DataFrame:
    """service, score (greatest is 1), rank.  errors (service, n_errors) bias start and restart towards failing services."""
    n_edges = edges.count()
    if n_edges > MOST_EDGES:
        raise ValueError(f"{n_edges} edges; a service graph has at most {MOST_EDGES}")
    rows = edges.select(F.lit(0).alias("g"), "src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("double").alias("err"))
    if errors is not None:
        rows = rows.unionByName(errors.select(F.lit(0).alias("g"), F.col("service").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight"), F.col("n_errors").cast("double").alias("err")))

    biased = errors is not None  # the function below must not hold a DataFrame

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf["dst"].notna()].sort_values(["src", "dst"])
        names = sorted(set(e["src"]) | set(e["dst"]))
        if not names:
            return pd.DataFrame({"service": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
        at = {s: k for k, s in enumerate(names)}
        n = len(names)
        restart = np.full(n, 1.0 / n)
        if biased:
            x = np.ones(n)
            for s, v in pdf.loc[pdf["dst"].isna(), ["src", "err"]].itertuples(index=False):
                if s in at:
                    x[at[s]] += v
            restart = x / x.sum()
        r = _rank(e["src"].map(at).to_numpy(), e["dst"].map(at).to_numpy(), e["weight"].to_numpy(), n, restart, damping, tol, rounds)
        return pd.DataFrame({"service": names, "score": r / r.max() if r.max() > 0 else r})

    scores = rows.groupBy("g").applyInPandas(run, "service string, score double")
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "service")))


def blast_radius(edges: DataFrame, root: str, most_pairs: int = 20_000_000) -> DataFrame:
    """service, hops of every service reachable from the root, itself at 0; nothing for an unknown root, which no edge names.

    Runs to the fixpoint.  `reach` holds the least distance of all pairs up to a span, at first the edges with span 1; a
    round joins the services at the greatest distance so far with it, which gives all that lie up to one span further, and
    then joins it with itself, which doubles the span.  So the rounds are logarithmic in the greatest distance.  The pairs
    that a doubling would make are counted beforehand, from the degrees; beyond `most_pairs` the span stays as it is, which
    costs rounds only.  Every table is written, so plans keep their size.
    """
    spark = edges.sparkSession
    hop = F.lit(1).cast("long")
    with Written(spark) as written:
        reach = written.kept(edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst", hop.alias("d")).distinct())
        known = not edges.filter((F.col("src") == root) | (F.col("dst") == root)).isEmpty()
        start = spark.createDataFrame([(root, 0)] if known else [], "service string, hops long")
        seen, last, span = start, 0, 1
        while known:
            edge = seen.filter(F.col("hops") == last).select("service")
            found = edge.join(reach, F.col("service") == F.col("src")).groupBy(F.col("dst").alias("service")).agg((F.min("d") + last).alias("hops"))
            both = written.kept(seen.unionByName(found).groupBy("service").agg(F.min("hops").alias("hops")))
            furthest = both.agg(F.max("hops")).first()[0]
            if furthest < last + span:  # nothing lies a whole span further, so nothing lies beyond
                seen = both
                break
            seen, last = both, last + span
            ways = reach.groupBy("dst").agg(F.count("*").alias("i")).join(reach.groupBy("src").agg(F.count("*").alias("o")), F.col("dst") == F.col("src"))
            if (ways.agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) <= most_pairs:
                further = reach.select(F.col("src").alias("a"), F.col("dst").alias("via"), F.col("d").alias("d1")).join(reach.select(F.col("src").alias("via"), F.col("dst").alias("b"), F.col("d").alias("d2")), "via")
                pairs = reach.unionByName(further.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("d1") + F.col("d2")).alias("d")).filter("src <> dst"))
                reach = written.kept(pairs.groupBy("src", "dst").agg(F.min("d").alias("d")))
                span *= 2
        return kept(seen)


def articulation_points(edges: DataFrame, order: str = "ord") -> DataFrame:
    """Cut vertices by a depth-first search over outgoing edges, nodes and edges in order of first appearance.

    Parallel edges count once, at their first appearance; more than MOST_EDGES distinct ones are an error.
    """
    edges = edges.groupBy("src", "dst").agg(F.min(order).alias(order))
    n_edges = edges.count()
    if n_edges > MOST_EDGES:
        raise ValueError(f"{n_edges} edges; a service graph has at most {MOST_EDGES}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        after: dict[str, list[str]] = {}
        for s, d in pdf[["src", "dst"]].itertuples(index=False):
            after.setdefault(s, [])
            after.setdefault(d, [])
            after[s].append(d)
        when, low, cut, clock = {}, {}, set(), 0
        for root in after:
            if root in when:
                continue
            when[root] = low[root] = clock = clock + 1
            stack, kids = [(root, None, iter(after[root]))], 0
            while stack:
                u, parent, rest = stack[-1]
                v = next(rest, None)
                if v is None:
                    stack.pop()
                    if stack:
                        p = stack[-1][0]
                        low[p] = min(low[p], low[u])
                        if p != root and low[u] >= when[p]:
                            cut.add(p)
                elif v not in when:
                    kids += u == root
                    when[v] = low[v] = clock = clock + 1
                    stack.append((v, u, iter(after[v])))
                elif v != parent:
                    low[u] = min(low[u], when[v])
            if kids > 1:
                cut.add(root)
        return pd.DataFrame({"service": sorted(cut)}, dtype=object)

    return edges.select(F.lit(0).alias("g"), "src", "dst", order).groupBy("g").applyInPandas(run, "service string")


TRACE = "critical_path array<bigint>, critical_ms bigint, root_failure bigint, failure_path array<bigint>, n_failed bigint, n_cascaded bigint, root_ms bigint"


def _walked(ids: list, parents: list, ms: list, bad: list) -> tuple:
    """What `TRACE` names of one trace, whose spans come in order of their ids."""
    at = {i: k for k, i in enumerate(ids)}
    kids: list[list[int]] = [[] for _ in ids]
    roots = []
    for k, p in enumerate(parents):
        up = at.get(p) if p is not None else None
        roots.append(k) if up is None or up == k else kids[up].append(k)
    order, stack = [], roots[:1]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += reversed(kids[k])
    best, down, link = list(ms), [-1] * len(ids), [-1] * len(ids)
    for k in reversed(order):  # children before parents; pointers, so nothing is copied from level to level
        if kids[k]:
            down[k] = max(kids[k], key=best.__getitem__)
            best[k] += best[down[k]]
            link[k] = next((c for c in kids[k] if bad[c]), -1)

    def along(k: int, pointer: list[int]) -> list:
        out = []
        while k >= 0:
            out.append(ids[k])
            k = pointer[k]
        return out

    first = next((k for k in order if bad[k]), -1)
    source = next((k for k in order if bad[k] and link[k] < 0), -1)
    n_failed = sum(bad)
    top = order[0] if order else -1
    return along(top, down), best[top] if order else 0, ids[source] if source >= 0 else None, along(first, link), n_failed, max(0, n_failed - (source >= 0)), ms[top] if order else 0


def analyse_traces(spans: DataFrame, trace: str) -> DataFrame:
    """Of each trace (columns span_id, parent_id, duration_ms, status): the root-to-leaf path with the greatest sum of
    durations, the first failed span in pre-order without a failed child, the first chain of failures, and counts.

    Children are in order of span_id; a parent that is missing counts as none; of several roots the first is walked; a null
    duration counts 0.  Traces come one after another, and a task holds one at a time.
    """
    kind = dict(spans.dtypes)[trace]
    fields = pa.schema([(f.split(" ")[0], pa.list_(pa.int64()) if "array" in f else pa.int64()) for f in TRACE.split(", ")])
    failed = F.coalesce(F.col("status").isin("error", "timeout"), F.lit(False))
    rows = spans.select(F.col(trace).alias("t"), F.col("span_id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("up"), F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)).alias("ms"), failed.alias("bad"))

    def run(batches):
        names, out, own, now, of = [], [], ([], [], [], []), None, None

        def take() -> None:
            if own[0]:
                names.append(now)
                out.append(_walked(*own))

        def made() -> pa.RecordBatch:
            arrays = [pa.array(names, of), *(pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields))]
            return pa.RecordBatch.from_arrays(arrays, [trace, *fields.names])

        for batch in batches:
            of = batch.schema.field(0).type
            t, *columns = (c.to_pylist() for c in batch.columns)
            cuts = [0, *(k for k in range(1, len(t)) if t[k] != t[k - 1]), len(t)] if t else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if t[a] != now:
                    take()
                    own, now = ([], [], [], []), t[a]
                for held, c in zip(own, columns, strict=True):
                    held += c[a:b]
            if len(out) > 1000:
                yield made()
                names, out = [], []
        take()
        if out:
            yield made()

    return rows.repartition("t").sortWithinPartitions("t", "id").mapInArrow(run, f"{trace} {kind}, {TRACE}")


def trace_reports(spans: DataFrame, trace: str) -> DataFrame:
    """The whole report of each trace (also columns service, operation, detail, http_status): analyse_traces, the call chain and
    services in order, the root failure, how failures spread, silent corruptions, the critical path by name, and what to fix.
    Spans are gathered by trace once more, as the report holds each of them."""
    call = F.struct("span_id", "service", "operation", "duration_ms", "status", "http_status", "detail", is_silent(F.col("status"), F.col("detail")).alias("silent"))
    calls = spans.groupBy(trace).agg(F.sort_array(F.collect_list(call)).alias("call_chain"))
    out = analyse_traces(spans, trace).join(calls, trace)
    out = out.withColumnRenamed("root_failure", "_root_id")
    of = F.map_from_entries(F.transform("call_chain", lambda c: F.struct(c["span_id"], c)))
    found = lambda c: F.transform(c, lambda i: F.try_element_at(F.col("_of"), i))
    out = out.withColumn("_of", of).withColumn("_root", F.try_element_at("_of", "_root_id")).withColumn("_chain", found("failure_path"))
    named = lambda c: F.struct(c["service"].alias("service"), c["operation"].alias("operation"))
    problem = F.when(F.col("_root").isNotNull(), F.struct(F.col("_root.service").alias("service"), F.col("_root.operation").alias("operation"), F.coalesce("_root.detail", F.lit("error")).alias("what_to_fix")))
    return out.select(
        trace, F.col("root_ms").alias("total_ms"), F.size("call_chain").alias("n_spans"), "n_failed", "n_cascaded", F.array_distinct(F.transform("call_chain", lambda c: c["service"])).alias("services"), "call_chain",
        F.when(F.col("_root").isNotNull(), F.struct(named(F.col("_root")).alias("at"), F.col("_root.detail").alias("error"))).alias("root_failure"),
        F.transform("_chain", lambda c, k: F.struct((k + 1).alias("step"), c["service"].alias("service"), F.when(c["span_id"] == F.col("_root_id"), "root").otherwise("cascaded").alias("type"), F.concat(c["operation"], F.lit(" → "), F.coalesce(c["detail"], c["status"])).alias("description"))).alias("failure_propagation"),
        F.transform(F.filter("call_chain", lambda c: c["silent"]), lambda c: F.struct(c["service"].alias("service"), c["operation"].alias("operation"), c["detail"].alias("description"))).alias("silent_corruptions"),
        F.transform(found("critical_path"), lambda c: F.concat(c["service"], F.lit("/"), c["operation"], F.lit(" ("), c["duration_ms"].cast("string"), F.lit("ms)"))).alias("critical_path"),
        F.array_compact(F.array(problem)).alias("fix_targets"),
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """The entries of the matrix A[i, j] = weight(j -> i) / sum of j's weights, as rows (i, j, to, from, share): services are
    numbered in order of their names, and entries without an edge, which are 0, have no row.  A source whose weights sum to 0
    is divided by 1."""
    names = edges.select(F.col("src").alias("service")).union(edges.select("dst")).distinct()
    numbered = names.withColumn("no", F.row_number().over(Window.orderBy("service")) - 1)  # one row for each service
    total = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    out = edges.join(total, "src").join(numbered.select(F.col("service").alias("src"), F.col("no").alias("j")), "src").join(numbered.select(F.col("service").alias("dst"), F.col("no").alias("i")), "dst")
    return out.select("i", "j", F.col("dst").alias("to"), F.col("src").alias("from"), (F.col("weight") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))).alias("share"))


def latency_breakdown(spans: DataFrame, trace: str) -> DataFrame:
    """Milliseconds of each service in each trace, and its percentage of the root span's duration (may exceed 100)."""
    root = spans.groupBy(trace).agg(F.min_by(F.col("duration_ms"), F.struct(F.col("parent_id").isNotNull(), F.col("span_id"))).alias("root_ms"))
    by = spans.groupBy(trace, "service").agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n_spans"))
    return by.join(root, trace).withColumn("percent", F.when(F.col("root_ms") > 0, F.bround(100.0 * F.col("ms") / F.col("root_ms"), 1)).otherwise(0.0))
