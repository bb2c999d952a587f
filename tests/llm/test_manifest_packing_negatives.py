"""Operators 11 to 13 against plain Python, on odd and repeated rows, and what else was mended beside them."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import bestfit, byte_encoding, html_text, language, merkle, negatives, pii
from faultline.llm import _text as X
from faultline.llm._store import Scratch

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def naive_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) by lists, for rows (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: SHA("".join(map(field, r)))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [SHA("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
            levels.append(nodes)
        return levels

    def path(levels, at):
        for nodes in levels[:-1]:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            yield run[: at % 16], run[at % 16 + 1 :]
            at //= 16

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[g]]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            steps = [*path(trees[k], at), *path(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf((*r[:4], low(r[4]))) if changed else leaf(r)
            for before, after in steps:
                h = SHA("".join([*before, h, *after]))
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], SHA("".join("".join(a) + "".join(b) for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 2), (700, 40)])
def test_manifest_against_lists(spark, tmp_path, n, sources):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]) if k % 9 == 0 else k, rng.choice([None, "é", *map(str, range(sources))]) if n > 100 else "s", rng.choice([None, "en"]), k, rng.choice([None, "", "Some Text", "lower", "Ü x"])) for k in range(n)]
    rows += rows[:3] if n > 16 else []
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema + ", at int, path string, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == naive_manifest(rows)


def test_byte_encoder_gives_the_tokenizers_ids():
    encoder = byte_encoding.ByteEncoder.of(public_tokenizers.path(bestfit.TOKENIZER))
    rng = random.Random(3)
    bits = ["a", "Bc", "é", "×", " ", "  ", "\n", "\t", "\r\n", "1", "42", "'", "'s", "'re", "!", "--", " ", "　", " ", "日本", "Ж", "<|endoftext|>", "<|", "\x1c", "½", "é", "😀", "\x00", "'ll"]
    texts = ["".join(rng.choice(bits[: rng.choice((12, 16, len(bits)))]) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["", None]
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        data, off = X.as_bytes(pa.array(part, pa.string()))
        u = encoder.units(data, off)
        got = np.split(u.stream(), np.cumsum(np.bincount(u.doc, weights=u.size, minlength=len(part)).astype(int))[:-1])
        for text, ids in zip(part, got, strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_sum_of_squares_against_a_plain_loop():
    rng = np.random.default_rng(2)
    for limit, n in ((10, 300), (64, 400), (1024, 300)):
        sizes = rng.integers(1, limit, n)
        bins, square, total = [], 0, {}
        got, offset = bestfit.sum_of_squares(sizes, limit)
        for k, s in enumerate(sizes.tolist()):
            def after(g):  # noqa: B023
                count = dict(total)
                if g < limit:
                    count[g] -= 1
                if g > s:
                    count[g - s] = count.get(g - s, 0) + 1
                return sum(v * v for v in count.values())

            able = sorted(g for g, v in total.items() if v and g >= s) + [limit]
            best = min(after(g) for g in able)
            mine = limit - int(offset[k])
            assert mine in able and after(mine) == best
            if mine == limit:
                assert got[k] == len(bins)
                bins.append(0)
            else:
                total[mine] -= 1
            assert bins[got[k]] == offset[k]
            bins[got[k]] += s
            if mine > s:
                total[mine - s] = total.get(mine - s, 0) + 1
        _, _, fewer = bestfit.packed(sizes, limit, np.argsort(-sizes, kind="stable"))
        assert -(-sizes.sum() // limit) <= fewer <= len(bins) + 1


def test_best_fit_round_trip(spark, data):
    rows = bestfit.op13_best_fit_packing(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(bestfit.TOKENIZER))
    want = []
    for doc, text in docs.itertuples(index=False):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    placed = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (placed.cumsum() - rows.sort_values(["sequence_id", "offset"]).length == rows.sort_values(["sequence_id", "offset"]).offset).all() and placed.sum().max() <= 1024
    assert rows.sequence_id.nunique() <= 1.02 * -(-rows.length.sum() // 1024)


def test_slices_keep_every_piece(spark):
    docs = spark.createDataFrame([(k % 7, "word " * (k % 90)) for k in range(500)], "doc_id int, text string")
    rows = bestfit.pieces(docs, public_tokenizers.path(bestfit.TOKENIZER), 64).withColumn("row", F.monotonically_increasing_id()).filter("length < 64").cache()
    out = bestfit.place(rows, 64, slices=5).toPandas()
    assert len(out) == rows.count() and out.groupby("sequence_id").length.sum().max() <= 64 and out.groupby("sequence_id").offset.min().max() == 0


def brute_negatives(rows):
    """rows (id, label, v) of whole numbers, one for each id."""
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, k) for j, k, w in rows if j != i]
        for p, positive in [(-s, j) for s, j, k in sorted(score) if k == label][:5]:
            found = [(-s, j) for s, j, k in sorted(score) if k != label and 50 * p <= 100 * -s <= 95 * p][:3]
            out += [(i, positive, rank, j, p, s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, dim, block", [(1.0, 6, None), (0.02, 3, None), (1.0, 6, 700), (2.0**40, 2, None)])
def test_negatives_against_brute_force(spark, monkeypatch, scale, dim, block):
    if block:  # many small blocks
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, dim)) + rng.integers(0, 3, (400, 1)), 2) * scale
    label = rng.integers(0, 3, 400)
    rows = [(k, x[k].tolist(), int(label[k])) for k in range(400)]
    odd = [(3, x[3].tolist(), int(label[3])), (401, [1.0, None], 1), (402, [float("nan")] * dim, 1), (403, [float("inf")] * dim, 1), (404, None, 1), (None, [1.0] * dim, 1), (405, [1.0] * dim, None), (450, [scale], 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, rank int, v string")
    with Scratch(spark) as scratch:
        got = sorted(tuple(r) for r in negatives.mine(scratch, negatives.rows_of(table, F.col("label")), F.col("vec_id") % 50 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    whole = [(k, c, [int(np.floor(256 * y)) for y in v]) for k, v, c in [*rows, odd[-1]]]
    want = brute_negatives(whole)
    if scale > 1e6:  # scores beyond 64 bits are shown as the nearest
        limit = 2**63 - 1
        want = sorted((*r[:4], *(min(limit, s) for s in r[4:])) for r in want)
    assert want and got == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    v, a = rng.integers(-150, 150, (500, 16)), rng.integers(-150, 150, (20, 16))
    edges = np.stack([np.linspace(-150, 150, negatives.CELLS + 1).astype(int)] * 16)
    low, high = negatives.bounds(a, negatives.cells_of(v, edges), edges)
    exact = a @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.2 * (exact.max() - exact.min())


def test_viterbi_with_many_languages():
    score = np.full((6, 200), -5.0)
    score[np.arange(6), [150, 150, 150, 199, 199, 199]] = 0
    assert language.viterbi(score, np.zeros(6, int), 1, 2.0).tolist() == [150, 150, 150, 199, 199, 199]
    assert language.viterbi(np.repeat(score[:1], 4, 0)[:, :150], np.zeros(4, int), 1, 2.0).tolist() == [0] * 4  # a tie goes to the first


def test_iban_ends_with_its_length_and_no_column_is_lost(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "pay to IBAN DE89370400440532013000 BIC COBADEFFXXX", "GB82 WEST 1234 5698 7654 32 account", "IBAN DE89 3704 0044 0532 0130 01", "IBAN ZZ89 3704 0044 0532 0130 00"]
    df = spark.createDataFrame([(k, t, "mine", "too", "also") for k, t in enumerate([*texts, None])], "doc_id int, text string, _order string, __spans string, _m_card string")
    out = pii.redacted(df)
    assert out.columns == df.columns
    rows = out.orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["IBAN [IBAN] BIC COBADEFFXXX", "pay to IBAN [IBAN] BIC COBADEFFXXX", "[IBAN] account", texts[3], texts[4], None]
    assert {(r._order, r["__spans"], r._m_card) for r in rows} == {("mine", "too", "also")}


def test_replies_boxes_and_site_names_are_no_article():
    text = lambda w, n=4: "".join(f"<p>{w}{k} " + "some running prose of a text that goes on " * 8 + "</p>" for k in range(n))
    main = html_text.main_text
    for mark in ('class="reply"', 'id="comment-7"', 'itemtype="https://schema.org/Comment"'):
        assert "said" not in main(f"<main><article><h1>T</h1>{text('art')}</article><article {mark}>{text('said', 1)}</article></main>")
    assert "box" not in main(f"<body><div><h1>T</h1>{text('art')}</div><div><h3>About us</h3>{text('box', 1)}</div></body>")
    assert main(f'<body><div id="top"><h1>My Site</h1></div><article><h2>Head</h2>{text("art")}</article></body>').startswith("Head art0")
    assert main(f'<body><div id="top"><h1>My Site</h1></div><article>{text("art")}</article></body>').startswith("art0")
    assert main(f"<body><h1>Title</h1><article><h2>Head</h2>{text('art')}</article></body>").startswith("Title Head art0")
    assert main(f"<body><div><h1>Title</h1></div><article>{text('art')}</article></body>").startswith("Title art0")
    assert main("<p>R&<b>amp;D</b> R&amp;D &<!-- x -->lt;</p>") == "R&amp;D R&D &lt;"
