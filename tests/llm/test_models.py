"""Scores against plain loops, verdicts on held-out rows, and a small unigram model built by hand."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import _text as X
from faultline.llm import html_text, media, quality, rules, sentencepiece_codec, token_counts

DATA = "/root/testdata/sf0.1"


def parted(spark, table):
    """The table, and its labels: those to fit on and those held out (a quarter of the documents)."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return spark.read.parquet(f"{DATA}/{table}.parquet"), labels.filter(~held), labels.filter(held)


def test_quality_classifier_on_held_out_documents(spark):
    docs, fitted, held = parted(spark, "documents")
    out = quality.score(docs, quality.fit(docs, fitted)).join(held, "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    right, base, n = out.agg(F.avg((F.col("kept") == good).cast("int")), F.avg(good.cast("int")), F.count("*")).first()
    assert n > 900 and right > 0.93 and right > base + 0.1, (right, base)


def test_quality_rules_on_held_out_documents(spark):
    docs, fitted, held = parted(spark, "documents")
    out = rules.judge(docs, rules.fit(docs, fitted)).filter("not base_failed").join(held, "doc_id")
    right, base, n = out.agg(F.avg((F.col("kept") == (F.col("quality") > 0)).cast("int")), F.avg("quality"), F.count("*")).first()
    assert n > 800 and right > 0.97 and right > base + 0.05, (right, base)


def test_grades_against_a_plain_loop(spark):
    texts = ["good words that stand here", "", None, "Good good GOOD words", "x" * 300, "日本 words\nline"]
    rng = np.random.RandomState(2)
    model = quality.Model(rng.randn(1 << quality.BITS), np.array([-1.0, 0.5]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    for k, t in enumerate(texts):
        data, off = X.as_bytes(pa.array([t], pa.string()))
        s = sum(model.weights[b] for b in quality.features(data, off)[1])
        tail = [1 / (1 + math.exp(c - s)) for c in model.cuts]
        assert got[k].p_not_toxic == pytest.approx(tail[0]) and got[k].p_good == pytest.approx(tail[1]) and got[k].expected_grade == pytest.approx(sum(tail))
        assert got[k].kept == (tail[1] >= 0.5)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["one two three", "two three four two", "", "é one"]
    alone = [sorted(quality.features(*X.as_bytes(pa.array([t])))[1].tolist()) for t in texts]
    doc, bucket = quality.features(*X.as_bytes(pa.array(texts)))
    assert [sorted(bucket[doc == k].tolist()) for k in range(len(texts))] == alone


def test_flat_forest_against_a_tree_walk():
    rng = np.random.RandomState(4)
    x = rng.rand(400, 3)
    f = rules.grow(x, (x[:, 0] * x[:, 1] > 0.3).astype(float), [0, 1, -1], trees=12)

    def walk(k, row):
        while f.feature[k] >= 0:
            k = f.left[k] if row[f.feature[k]] <= f.threshold[k] else f.right[k]
        return f.value[k]

    want = [1 / (1 + math.exp(-(f.base + sum(walk(r, row) for r in f.roots)))) for row in x]
    assert f.probability(x) == pytest.approx(want)


def unigram_model(pieces, byte_fallback):
    """A model file: pieces with scores, and settings, as protobuf fields."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    number = lambda k, n: varint(k << 3) + varint(n)
    block = lambda k, raw: varint(k << 3 | 2) + varint(len(raw)) + raw
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback), *((p, s, 1) for p, s in pieces)]
    body = b"".join(block(1, block(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, k)) for p, s, k in rows)
    trainer = number(3, 1) + number(35, int(byte_fallback)) + number(40, 0) + number(41, 1) + number(42, 2)
    return body + block(2, trainer) + block(3, block(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_models(tmp_path, byte_fallback):
    rng = random.Random(8)
    letters = list("▁abcdeé日")
    pieces = {c: -6.0 - rng.random() for c in letters}
    while len(pieces) < 120:
        pieces["".join(rng.choice(letters[1:]) for _ in range(rng.randrange(2, 5)))] = -3.0 - 6 * rng.random()
    pieces |= {"▁" + p: s - 0.5 for p, s in list(pieces.items())[10:60]}
    path = tmp_path / "small.model"
    path.write_bytes(unigram_model(pieces.items(), byte_fallback))
    c = sentencepiece_codec.Codec(str(path))
    assert c.spec.unigram
    texts = ["", "abc", "a  b", *("".join(rng.choice("abcde é日 xz") for _ in range(rng.randrange(1, 40))) for _ in range(400))]
    e = c.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert e.ids[e.at[k] : e.at[k + 1]].tolist() == c.parity.encode(t), t
        if byte_fallback:
            assert e.text[e.text_at[k] : e.text_at[k + 1]].tobytes().decode() == t
    assert e.parity.all()


def test_histogram_of_a_giant_text_is_small(spark):
    df = spark.createDataFrame([(1, "word " * 200_000), (2, "a b"), (3, None)], "doc_id long, text string")
    rows = token_counts.lengths(df, token_counts.public_tokenizers.path(token_counts.TOKENIZER)).collect()
    assert sorted(r.n_docs for r in rows) == [1, 1, 1] and max(r.n_tokens for r in rows) >= 200_000


def test_media_directory_is_read_again(spark, tmp_path):
    folder = f"file://{tmp_path}/arc"
    df = spark.createDataFrame([(k, "text" * k) for k in range(20)], "doc_id long, text string").repartition(1)
    media.store(df, folder).collect()
    media.store(df, folder).collect()  # finds its archives there
    reader = media.ArchiveReader({"path": folder, "retries": "2"})
    real, calls = media.ArchiveReader.directory, []

    def flaky(f):
        calls.append(1)
        if len(calls) < 3:
            raise media.zipfile.BadZipFile("half of it")
        return real(f)

    reader.directory = flaky
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20 and len(calls) == 3


def test_pages_beside_each_other_do_not_mix(spark):
    rows = [(k, None, f"<body><p>page {k} " + "word " * k + "</p></body>") for k in range(30)] + [(30, "u", None)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(30):
        assert got[k].text == (f"page {k} " + "word " * k).strip() and got[k].n_chars == len(got[k].text)
    assert got[30].text == ""
