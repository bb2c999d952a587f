"""Merkle manifest of a dataset: one tree of `FAN` children a node for each group, and one over the groups' roots.

Leaves are numbered inside their group by a range shuffle and counts of its partitions, so no task holds a group.  Each
level is a window over (group, parent index): the ordered full-frame collect_list of at most `FAN` digests is the
parent's preimage and holds every child's siblings; parents are deduplicated before the next level.  Groups that have
come down to one node rest until the largest is done.  The paths are then joined level by level from the roots down.

Defined results: null fields are `-`, an empty text is `0:`; null groups come first and are a group; null ids come first;
equal ids keep their rows, ordered by leaf, and rows equal in all hashed fields are leaves of their own; an empty table has
no rows and no root; columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, read, saved

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts behind each other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    each = [F.concat(F.octet_length(s := f.cast("string")).cast("string"), F.lit(":"), s) for f in fields]
    return digest(*[F.coalesce(e, F.lit("-")) for e in each])


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings before and after it at each level."""
    return F.aggregate(path, start, lambda h, step: digest(step["before"], h, step["after"]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with `at`, the place inside the group from 0, and `n`, the group's size.  Nulls come first."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    laid = scratch.saved(laid, "merkle-order").withColumn("_part", F.shiftright("_id", 33))
    own = Window.partitionBy(group)
    count = laid.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = count.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    found = laid.join(count, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return found.withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_group", "_p", "_shift")


def _runs(nodes: DataFrame) -> DataFrame:
    """Each node with `up`, its parent's index, and `run`, the digests of that parent's children in order."""
    nodes = nodes.withColumn("up", F.floor(F.col("at") / FAN))
    frame = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("h").over(frame))


def _climb(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, at, n, h) of every level, from the given one to the roots of all trees."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parent = F.when(F.col("n") == 1, F.col("h")).otherwise(F.sha2(F.array_join("run", ""), 256))
        up = _runs(levels[-1].select("g", "at", "n", "h")).select("g", F.col("up").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), parent.alias("h"))
        levels.append(scratch.saved(up.dropDuplicates(["g", "at"]), "merkle-level"))
        most = -(-most // FAN)
    return levels


def _descend(scratch: Scratch, levels: list[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The lowest level with `path` and the carried columns; above has them for each tree (g, at = 0)."""
    for k, nodes in enumerate(reversed(levels[:-1])):
        last = k == len(levels) - 2
        place = (F.col("at") % FAN).cast("int")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(FAN)), "").alias("after"))
        over = above.select(F.col("g").alias("_g"), F.col("at").alias("_up"), F.col("path").alias("_path"), *carried)
        rows = _runs(nodes).join(over, (F.col("g") == F.col("_g")) & (F.col("up") == F.col("_up")))
        path = F.when(F.col("n") == 1, F.col("_path")).otherwise(F.concat(F.array(step), F.col("_path")))
        rows = rows.withColumn("path", path).select(*nodes.columns, "path", *carried)
        above = rows if last else scratch.saved(rows, "merkle-path")
    if len(levels) == 1:
        over = above.select(F.col("g").alias("_g"), "path", *carried)
        above = levels[0].join(over, F.col("g") == F.col("_g")).select(*levels[0].columns, "path", *carried)
    return above


def manifest(scratch: Scratch, docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: its key, `leaf`, `subroot`, `root`, the `path` of siblings from the leaf to the root,
    and the columns of `keep`, which are computed from docs.  The result reads tables of `scratch`."""
    keep = keep or {}
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf([F.col(f) for f in fields]).alias("h"), *[c.alias(f"keep_{k}") for k, c in keep.items()])
    leaves = scratch.saved(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = numbered(scratch, leaves, "grp", ["key", "h", "row"]).drop("row")
    names = leaves.groupBy("grp").agg(F.count("*").alias("size")).withColumn("all", F.lit(0))
    names = scratch.saved(numbered(scratch, names, "all", ["grp"]).select("grp", F.col("at").alias("g"), F.col("n").alias("groups")), "merkle-groups")
    of = names.select(F.col("grp").alias("_grp"), "g")
    leaves = scratch.saved(leaves.join(of, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp", "grp"), "merkle-numbered")
    levels = _climb(scratch, leaves)
    roots = levels[-1].select("g", F.col("h").alias("subroot"))
    tops = scratch.saved(roots.join(names.select("g", "groups"), "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.col("groups").alias("n"), F.col("subroot").alias("h")), "merkle-tops")
    over = _climb(scratch, tops)
    root = over[-1].select("g", "at", F.lit(None).cast(_PATH).alias("path"), F.col("h").alias("root")).withColumn("path", F.array().cast(_PATH))
    above = _descend(scratch, over, root, ["root"]).select(F.col("at").alias("g"), F.lit(0).cast("long").alias("at"), "path", F.col("h").alias("subroot"), "root")
    out = _descend(scratch, levels, scratch.saved(above, "merkle-subroots"), ["subroot", "root"])
    return out.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"keep_{k}").alias(k) for k in keep])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still verifies after one in five is tampered with."""
    changed = leaf([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed)
    with Scratch(spark) as scratch:
        rows = manifest(scratch, read(spark, sf_dir, "documents"), keep={"tampered": tampered})
        rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
        return saved(rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")), "merkle")


#: Levels by recursion; a resting root keeps its digest.  The CRC of decimal digits is worked out bit by bit.
OP12_SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS row_no FROM documents),
f AS (SELECT row_no, doc_id, source, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, coalesce(octet_length(encode(text)) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-') AS changed,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc FROM d),
v AS (SELECT row_no, doc_id, source, sha256(head || tail) AS leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0 THEN sha256(head || changed) ELSE sha256(head || tail) END AS tampered FROM f),
s AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM v),
lo AS (SELECT 0 AS level, g, pos, n, leaf AS h FROM s UNION ALL
  SELECT level + 1, g, pos // 16, (n + 15) // 16, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END FROM lo WHERE level < (SELECT ceil(log2(max(n)) / 4) FROM s) GROUP BY level, g, pos // 16, n),
t AS (SELECT g, h FROM lo WHERE level = (SELECT max(level) FROM lo)),
hi AS (SELECT 0 AS level, g AS pos, (SELECT count(*) FROM t) AS n, h FROM t UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM hi WHERE n > 1 GROUP BY level, pos // 16, n),
a AS (SELECT level, g, pos, n, h FROM lo UNION ALL SELECT (SELECT max(level) FROM lo) + level, -1, pos, n, h FROM hi),
x AS (SELECT s.row_no, l.level, l.pos, CASE WHEN l.level < (SELECT max(level) FROM lo) THEN s.g ELSE -1 END AS tree FROM s,
  LATERAL (SELECT level, CASE WHEN level < (SELECT max(level) FROM lo) THEN s.pos // CAST(16 ** level AS BIGINT) ELSE s.g // CAST(16 ** (level - (SELECT max(level) FROM lo)) AS BIGINT) END AS pos FROM (SELECT DISTINCT level FROM a) WHERE level < (SELECT max(level) FROM a)) l),
y AS (SELECT x.row_no, x.level, coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (a.pos < x.pos), '') AS before, coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (a.pos > x.pos), '') AS after, count(*) AS k, min(a.n) AS n
  FROM x JOIN a ON a.level = x.level AND a.g = x.tree AND a.pos // 16 = x.pos // 16 GROUP BY x.row_no, x.level, x.pos),
p AS (SELECT row_no, list({{'b': before, 'a': after}} ORDER BY level) AS path, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM y WHERE n > 1 GROUP BY row_no),
z AS (SELECT s.doc_id, s.leaf, t.h AS subroot, (SELECT h FROM hi WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  list_reduce(list_prepend({{'b': s.tampered, 'a': ''}}, coalesce(path, [])), lambda q, w: {{'b': sha256(w.b || q.b || w.a), 'a': ''}}).b AS folded_root FROM s JOIN t USING (g) LEFT JOIN p USING (row_no))
SELECT *, folded_root = root AS verified FROM z"""
