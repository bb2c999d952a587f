"""N-gram Jaccard join by a grouped prefix filter.

Two sets with Jaccard similarity t or more share a token within the first |x| - ceil(t|x|) + 1 tokens of each, in any
fixed order of tokens.  The order here puts tokens that many sets share last, so that passages of thousands of documents
stay out of most prefixes.  Sets of one size with one prefix form a group; only groups meet in the buckets of the prefix
tokens, group pairs are filtered by size, position and number of shared prefix tokens, and the survivors are expanded to
members, whose whole sets decide.

Equal sets are one node from the start.  Rounds of stars come first: each compares the groups of a large bucket with the
bucket's most central group of like size only (the one in whose prefix the token stands first, so that fewest tokens are
its own), and the members of a group with its least member; what is not yet connected to that centre goes on to the next
round, as long as the pairs that are left are many more than the entries.  At last every remaining candidate pair is taken
whose two sides are not yet in one component, so that in each bucket only what is outside the largest component is compared
with the rest.  No candidate is dropped unless it is already connected, so the components
are those of all links, while a group of thousands of near copies costs little more than its size.

A bucket that stays large has groups that are all unlike its centres although their rarest shared token is that frequent,
which takes texts put together from the same few passages; their pairs are all compared, as the result is exact.

The index is dealt to slices of a bounded number of entries; an executor holds one slice at a time, and a token of more
sets than `PART` is dealt to several.  Hashes of 64 bits stand for shingles and for whole sets.

Defined results: null, empty and blank texts have the empty set, no links and their own doc_id as component_id; repeated
rows (same doc_id, same text) come out once each with equal values; a null doc_id gets the component of its equal texts,
null if none of those has an id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch, saved
from .components import components

WORDS = 5
PERCENT = 75
#: A token is frequent if found in so many distinct sets of one input slice, and in so many altogether.
LOCAL, FREQUENT = 2, 6
#: Most frequent tokens that take part in the order (16 bytes each); beyond it, the rest count as rare ones, which only costs time.
MOST_FREQUENT = 1 << 18
#: Buckets of at least so many groups go through the first round.
STAR = 6
#: Most candidate documents that are broadcast by id (16 bytes each); beyond it, texts are shuffled to them.
MOST_BROADCAST = 1 << 20
#: Prefix tokens of one slice of the index, and most partitions that slices are dealt to (each works on its slices in turn).
SLICE, PARTITIONS = 400_000, 1 << 14
#: A token of more sets than that is dealt to as many slices as needed.
PART = 200_000
#: Stars go on while the pairs left are so many times the entries, for so many rounds at most.
PAIRS, ROUNDS = 8, 8
#: Tokens that are counted, and that are dealt to slices, at a time.
_COUNT, _FLUSH = 4_000_000, 1_000_000


def sets_of(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts lower-cased in A-Z."""
    data = X.LOWER[data]
    start, end, doc = X.words(data, off)
    h = X.hashes(data, start, end)
    at = np.searchsorted(doc, np.arange(len(off)))
    for k in range(len(off) - 1):
        yield np.unique(X.windows(h[at[k] : at[k + 1]], WORDS))


def digest(tokens: np.ndarray) -> np.int64:
    return X.mix(np.sum(X.mix(tokens), keepdims=True, dtype=np.uint64) + np.uint64(len(tokens))).view(np.int64)[0]


def prefix_size(n, percent: int = PERCENT):
    """|x| - ceil(t|x|) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _rest(c: str, percent: int):
    """Tokens of a set of size c behind its prefix: ceil(t|x|) - 1."""
    return F.floor((F.lit(percent) * F.col(c) + F.lit(99)) / F.lit(100)) - F.lit(1)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, set size and digest (null if empty) of every row; kind 1: a token and the number of distinct sets of this slice that hold it."""
    seen: set[int] = set()
    kept: list[np.ndarray] = []
    held, kind_of = 0, None

    def flush():
        if not kept:
            return
        token, n = np.unique(np.concatenate(kept), return_counts=True)
        kept.clear()
        seen.clear()
        many = n >= LOCAL
        m = int(many.sum())
        yield pa.record_batch({"kind": pa.array(np.ones(m, np.int32)), "doc_id": pa.nulls(m, kind_of), "n": pa.array(n[many]), "key": pa.array(token[many].view(np.int64))})

    for batch in batches:
        kind_of = batch.schema.field("doc_id").type
        for part in X.blocks(batch, "text"):
            size, key = [], []
            for s in sets_of(*X.as_bytes(part.column("text"))):
                size.append(len(s))
                key.append(int(digest(s)) if len(s) else None)
                if len(s) and key[-1] not in seen:
                    seen.add(key[-1])
                    kept.append(s)
                    held += len(s)
            yield pa.record_batch({"kind": pa.array(np.zeros(len(size), np.int32)), "doc_id": part.column("doc_id"), "n": pa.array(size, pa.int64()), "key": pa.array(key, pa.int64())})
            if held > _COUNT:
                yield from flush()
                held = 0
    yield from flush()


def _index(frequent: np.ndarray, rank: np.ndarray, parts: np.ndarray, slices: int, percent: int):
    """Cut each distinct set's prefix and deal its tokens to `slices` slices: rows of packed arrays, so that the shuffle
    moves few large rows.  Tokens of more than one part go to as many further slices, by their group.  A set that stands
    in many rows of one input slice is sent once from there."""
    many = bool((parts > 1).any())

    def slice_of(token: np.ndarray, group: np.ndarray) -> np.ndarray:
        to = (token % np.uint64(slices)).astype(np.int64)
        if many:
            at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
            n = np.where(frequent[at] == token, parts[at], 1)
            part = group.view(np.uint64) % n.astype(np.uint64)
            to = np.where(n > 1, slices + (X.mix(token + X.mix(part + np.uint64(1))) % np.uint64(slices)).astype(np.int64), to)
        return to

    def prefix(s: np.ndarray) -> np.ndarray:
        p = int(prefix_size(len(s), percent))
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            hot = frequent[at] == s
            s = np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]], kind="stable")]])
        return s[:p]

    def run(batches):
        seen: set[int] = set()
        cut: list[tuple[np.ndarray, int, int, int]] = []
        held = 0

        def flush():
            if not cut:
                return
            size = np.array([len(c[0]) for c in cut])
            token = np.concatenate([c[0] for c in cut])
            group, n, node = (np.array([c[k] for c in cut], np.int64) for k in (1, 2, 3))
            pos = np.minimum(np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size), 65535)
            of_group = np.repeat(group, size)
            to = slice_of(token, of_group)
            order = np.argsort(to, kind="stable")
            to, token, pos, of_group, of_n = to[order], token[order], pos[order].astype("<u2"), of_group[order], np.repeat(n, size)[order].astype("<u4")
            mine = (group.view(np.uint64) % np.uint64(slices)).astype(np.int64)
            member = np.argsort(mine, kind="stable")
            mine = mine[member]
            rows = []
            for p in np.union1d(to, mine):
                a, b = np.searchsorted(to, p), np.searchsorted(to, p, "right")
                m = member[np.searchsorted(mine, p) : np.searchsorted(mine, p, "right")]
                rows.append((p, token[a:b].tobytes(), of_group[a:b].tobytes(), of_n[a:b].tobytes(), pos[a:b].tobytes(), group[m].tobytes() + node[m].tobytes() + n[m].tobytes()))
            cut.clear()
            seen.clear()
            for k in range(0, len(rows), 64):
                part = rows[k : k + 64]
                yield pa.record_batch({"slice": pa.array([r[0] for r in part], pa.int64()), **{name: pa.array([r[j + 1] for r in part], pa.binary()) for j, name in enumerate(("tokens", "groups", "sizes", "places", "members"))}})

        for batch in batches:
            for part in X.blocks(batch, "text"):
                for s in sets_of(*X.as_bytes(part.column("text"))):
                    if not len(s) or (node := int(digest(s))) in seen:
                        continue
                    seen.add(node)
                    head = prefix(s)
                    group = int(X.mix(np.sum(head * X.mix(np.arange(1, len(head) + 1, dtype=np.uint64)), keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])
                    cut.append((head, group, len(s), node))
                    held += len(head)
                if held > _FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


#: In larger buckets all entries count as having a partner.
_COMPARED = 64


def _has_partner(token: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which entries (ascending by token) have another one in their bucket that they could link with, judged by size and
    by what is left from this token on."""
    near = np.zeros(len(token), bool)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.concatenate([first, [len(token)]]))
    near[np.repeat(size > _COMPARED, size)] = True
    for d in range(1, min(_COMPARED, int(size.max(initial=1)))):
        a = np.flatnonzero(token[d:] == token[:-d])
        if not len(a):
            break
        b = a + d
        like = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        room = (100 + percent) * np.minimum(n[a] - place[a], n[b] - place[b]) >= percent * (n[a] + n[b])
        near[a[like & room]] = near[b[like & room]] = True
    return near


def _meet(slices: int, percent: int):
    """The entries and members of each slice in turn; the rows come in order of slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k, number in enumerate(batch.column("slice").to_pylist()):
                if number != now and held:
                    yield from _meet_slice(held, now >= slices, percent)
                    held = []
                now = number
                held.append({c: batch.column(c)[k].as_py() for c in ("tokens", "groups", "sizes", "places", "members")})
        if held:
            yield from _meet_slice(held, now >= slices, percent)
        X.release()

    return run


def _meet_slice(rows: list[dict[str, bytes]], is_part: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Of one slice of the index: kind 0, the entries of tokens that two or more groups hold (kind 2 those of them that
    have no partner they could link with there); kind 1, the groups' members.  In parts of tokens every entry is kind 0,
    as its partners may be in another part."""
    m = np.concatenate([np.frombuffer(r["members"], np.int64).reshape(3, -1) for r in rows], 1)
    if m.size:
        order = np.lexsort((m[1], m[0]))
        m = m[:, order]
        m = m[:, np.concatenate([[True], (m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1])])]
        none = pa.nulls(m.shape[1], pa.int64())
        yield pa.record_batch({"kind": pa.array(np.ones(m.shape[1], np.int32)), "token": none, "grp": pa.array(m[0]), "n": pa.array(m[2]), "place": none, "node": pa.array(m[1])})
    token = np.frombuffer(b"".join([r["tokens"] for r in rows]), np.uint64)
    if not len(token):
        return
    order = np.argsort(token, kind="stable")
    if not is_part:
        t = token[order]
        same = t[1:] == t[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    token = token[order]
    group = np.frombuffer(b"".join([r["groups"] for r in rows]), np.int64)[order]
    n = np.frombuffer(b"".join([r["sizes"] for r in rows]), "<u4")[order].astype(np.int64)
    place = np.frombuffer(b"".join([r["places"] for r in rows]), "<u2")[order].astype(np.int64)
    order = np.lexsort((group, token))
    token, group, n, place = token[order], group[order], n[order], place[order]
    if not len(token):
        return
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
    token, group, n, place = token[new], group[new], n[new], place[new]
    same = token[1:] == token[:-1]
    live = np.arange(len(token)) if is_part else np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    kind = np.full(len(token), 2, np.int32)
    kind[live if is_part else live[_has_partner(token[live], n[live], place[live], percent)]] = 0
    for k in range(0, len(live), 100_000):
        at = live[k : k + 100_000]
        yield pa.record_batch({"kind": pa.array(kind[at]), "token": pa.array(token[at].view(np.int64)), "grp": pa.array(group[at]), "n": pa.array(n[at]), "place": pa.array(place[at]), "node": pa.nulls(len(at), pa.int64())})


def _chosen_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in X.blocks(batch, "text"):
            asked = part.column("node").to_pylist()
            got = [(k, s.tobytes()) for k, s in zip(asked, sets_of(*X.as_bytes(part.column("text"))), strict=True) if len(s) and int(digest(s)) == k]
            yield pa.record_batch({"node": pa.array([x[0] for x in got], pa.int64()), "tokens": pa.array([x[1] for x in got], pa.binary())})


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """The pairs (a, b) of nodes whose whole sets link; None if there are no pairs."""
    pairs = scratch.saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = scratch.saved(asked.join(nodes, "node").select("node", F.col("first_id").alias("id")), "asked")
    n = asked.count()
    if not n:
        return None
    side = F.broadcast(asked) if n <= MOST_BROADCAST else asked
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    sets = scratch.saved(texts.mapInArrow(_chosen_sets, "node long, tokens binary").dropDuplicates(["node"]), "sets")
    with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    with_y = with_x.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return scratch.saved(with_y.mapInArrow(_linked(percent), "a long, b long"), "links")


def _least(percent: int):
    """Least overlap that two sets of sizes n and m need to link."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent))


def _step(percent: int):
    """Sets of like size, by powers of the similarity."""
    return F.floor(F.log("n") / F.lit(float(np.log(100 / percent))))


def _room(percent: int):
    """Whether the tokens from a pair's first common one on are enough to link."""
    return F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2")) >= _least(percent)


def _pairs_left(entries: DataFrame, keys: list[str]) -> float:
    """Pairs within the buckets of what is left."""
    k = F.count("*").cast("double")
    return entries.groupBy(*keys).agg((k * (k - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0.0


def _stars(live: DataFrame, members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, label) of what rounds of stars connect: groups of a bucket with its centre, members with their group's least."""
    heads = members.groupBy("grp").agg(F.min("node").alias("head"))
    crowd = members.join(members.groupBy("grp").agg(F.count("*").alias("k")).filter("k > 1"), "grp", "left_semi").select("grp", "node")
    left, links, label = live.withColumn("step", _step(percent)), None, nodes.sparkSession.createDataFrame([], "node long, label long")
    n_entries = None
    for turn in range(ROUNDS):
        hub = F.min(F.struct("place", "grp", "n"))
        hubs = left.groupBy("token", "step").agg(hub.alias("hub"), F.count("*").alias("size")).filter(F.col("size") >= STAR)
        hubs = scratch.saved(hubs.select("token", "step", F.col("hub.grp").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.place").alias("place2")), "hubs")
        near = left.join(hubs, ["token", "step"]).filter(F.col("grp") != F.col("hub"))
        spokes = near.filter(_room(percent)).select("grp", "hub").distinct()
        pairs = spokes.join(heads.withColumnRenamed("head", "a"), "grp").join(heads.select(F.col("grp").alias("hub"), F.col("head").alias("b")), "hub").select("a", "b")
        first = crowd.groupBy("grp").agg(F.min("node").alias("low"))
        pairs = pairs.union(crowd.join(first, "grp").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
        found = _verified(pairs, nodes, docs, percent, scratch)
        if found is None:
            break
        links = found if links is None else links.union(found)
        label = components(links, save=scratch.saved)
        # what a round leaves: entries and members that are not in their centre's component
        named = lambda c, out: label.select(F.col("node").alias(c), F.col("label").alias(out))  # noqa: B023, E731
        by_group = heads.join(named("head", "of"), "head", "left").select("grp", F.coalesce("of", "head").alias("of"))
        centres = hubs.join(by_group.select(F.col("grp").alias("hub"), F.col("of").alias("of2")), "hub").select("token", "step", "hub", "of2")  # one for each bucket
        near = left.join(centres, ["token", "step"]).filter(F.col("grp") != F.col("hub")).join(by_group, "grp").filter("of <> of2")
        left = scratch.saved(near.select("token", "grp", "n", "place", "step"), "left")
        side = crowd.join(first, "grp").filter("node <> low").join(named("node", "of"), "node", "left").join(named("low", "of2"), "low", "left")
        crowd = scratch.saved(side.filter(F.coalesce("of", "node") != F.coalesce("of2", "low")).select("grp", "node"), "crowd")
        n_entries = n_entries or live.count()
        if _pairs_left(left, ["token", "step"]) + _pairs_left(crowd, ["grp"]) <= PAIRS * n_entries:
            break
    return label


def _rows_with_class(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n, key (digest of the set, null if empty), label (least digest of the class) of every row, and component_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    survey = scratch.saved(docs.select("doc_id", "text").mapInArrow(_survey, f"kind int, doc_id {kind}, n long, key long"), "survey")
    rows = survey.filter("kind = 0")
    nodes = scratch.saved(rows.filter("key is not null").groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n")), "nodes")
    frequent = (
        survey.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()
    )
    token = frequent["key"].to_numpy(np.int64).view(np.uint64)
    by_token = np.argsort(token)
    rank = len(token) - 1 - np.arange(len(token))  # rarer ones first
    parts = -(-frequent["n"].to_numpy(np.int64) // PART)
    total = nodes.agg(F.sum(F.col("n") - _rest("n", percent))).first()[0] or 0
    slices = int(max(8, -(-total // SLICE)))
    dealt = docs.select("doc_id", "text").mapInArrow(
        _index(token[by_token], rank[by_token], parts[by_token], slices, percent), "slice long, tokens binary, groups binary, sizes binary, places binary, members binary"
    )
    in_turn = dealt.repartition(min(PARTITIONS, slices), "slice").sortWithinPartitions("slice")
    met = scratch.saved(in_turn.mapInArrow(_meet(slices, percent), "kind int, token long, grp long, n long, place long, node long"), "index")
    live = met.filter("kind = 0").select("token", "grp", "n", "place")
    shared = met.filter("kind <> 1").select("token", "grp")
    members = met.filter("kind = 1").select("grp", "node", "n")
    label = _stars(live, members, nodes, docs, percent, scratch)

    # all candidates between components
    named = members.join(label, "node", "left").select("grp", "node", "n", F.coalesce("label", "node").alias("label"))
    whole = named.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    # of a bucket's groups those in its largest component need only meet the others
    side = live.join(whole, "grp").withColumn("of", F.when(F.col("low") == F.col("high"), F.col("low")))
    largest = side.filter("of is not null").groupBy("token", "of").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("of", F.struct("k", "of")).alias("big"))
    side = scratch.saved(side.join(largest, "token", "left").select("token", "grp", "n", "place", "of", (F.col("of").isNull() | (F.col("of") != F.col("big"))).alias("apart")), "sides")
    x, y = side.filter("apart").drop("apart"), side.select("token", F.col("grp").alias("grp2"), F.col("n").alias("m"), F.col("place").alias("place2"), F.col("of").alias("of2"), F.col("apart").alias("apart2"))
    once = (F.col("grp") < F.col("grp2")) | ((F.col("grp") > F.col("grp2")) & ~F.col("apart2"))
    one = F.coalesce(F.col("of") == F.col("of2"), F.lit(False))
    like = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    met_pairs = x.join(y, "token").filter(once & ~one & like & _room(percent))
    a_first = F.col("grp") < F.col("grp2")
    ordered = met_pairs.select(F.least("grp", "grp2").alias("grp"), F.greatest("grp", "grp2").alias("grp2"), F.when(a_first, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(a_first, F.col("m")).otherwise(F.col("n")).alias("m"))
    found = scratch.saved(ordered.groupBy("grp", "grp2").agg(F.first("n").alias("n"), F.first("m").alias("m")), "found")
    asked = found.select("grp").union(found.select("grp2")).distinct()
    shared_tokens = shared.join(asked, "grp", "left_semi").groupBy("grp").agg(F.collect_list("token").alias("tokens"))  # no more than a prefix each
    both = found.join(shared_tokens, "grp").join(shared_tokens.select(F.col("grp").alias("grp2"), F.col("tokens").alias("tokens2")), "grp2")
    enough = F.size(F.array_intersect("tokens", "tokens2")) + F.greatest(_rest("n", percent), _rest("m", percent)) >= _least(percent)
    candidates = both.filter(enough).select("grp", "grp2")
    left = named.select("grp", F.col("node").alias("a"), F.col("label").alias("la"))
    right = named.select(F.col("grp").alias("grp2"), F.col("node").alias("b"), F.col("label").alias("lb"))
    across = candidates.join(left, "grp").join(right, "grp2").filter("la <> lb").select("a", "b")
    mixed = named.join(whole.filter("low <> high").select("grp"), "grp")
    within = mixed.select("grp", F.col("node").alias("a"), F.col("label").alias("la"))
    within = within.join(mixed.select("grp", F.col("node").alias("b"), F.col("label").alias("lb")), "grp").filter("a < b and la <> lb").select("a", "b")
    more = _verified(across.union(within), nodes, docs, percent, scratch)
    if more is not None:
        label = components(more.union(label.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))), save=scratch.saved)

    at = nodes.select("node", "first_id").join(label, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    ids = at.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = at.join(ids, "label").select(F.col("node").alias("key"), "label", "component_id")
    out = rows.filter("key is not null").select("doc_id", "n", "key").join(by_node, "key").select("doc_id", "n", "key", "label", "component_id")
    none = F.lit(None).cast("long")
    return out.unionByName(rows.filter("key is null").select("doc_id", "n", "key", none.alias("label"), F.col("doc_id").alias("component_id")))


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows = _rows_with_class(docs, percent, scratch)
        return saved(rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "classes")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the digests of their sets as a last column."""
    for batch in batches:
        for part in X.blocks(batch, "text"):
            key = [int(digest(s)) if len(s) else None for s in sets_of(*X.as_bytes(part.column("text")))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key, pa.int64())], [*part.schema.names, "_set_key"])


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, all columns, of one document of each class: the one with the least doc_id, rows without an id last.  Of
    rows that repeat a doc_id with the same set one stays; a doc_id that has several texts keeps those that have no near
    copy elsewhere.  Texts without words stay, once for each doc_id and text."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.saved(_rows_with_class(docs, percent, scratch), "rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
        best = rows.filter("label is not null").groupBy("label").agg(first).select("label", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
        gone = rows.filter("label is not null").join(best, "label").filter("not (doc_id <=> first_id and key = first_key)").select("doc_id", "key").distinct()
        gone = saved(gone, "gone")
        n_rows, n_ids = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
        n_gone = gone.count()
    side = F.broadcast(gone) if n_gone <= MOST_BROADCAST else gone
    if n_rows == n_ids:
        return docs.join(side.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    keyed = docs.mapInArrow(_keyed, f"{docs.schema.toDDL()}, _set_key long")
    gone_id, gone_key = F.col("_gone_id"), F.col("_gone_key")
    side = side.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    kept = keyed.join(side, F.col("doc_id").eqNullSafe(gone_id) & (F.col("_set_key") == gone_key), "left_anti")
    return kept.withColumn("_same", F.coalesce("_set_key", F.xxhash64("text"))).dropDuplicates(["doc_id", "_same"]).select(*docs.columns)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
