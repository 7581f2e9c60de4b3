"""Decontamination, language ID and quality."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.llm import decontaminate, langid, quality

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# decontamination

def brute_report(docs, items, span):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item_id, text in items:
            q = words(text)
            n = min(span, len(q))
            wins = {tuple(q[p:p + n]) for p in range(len(q) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p:p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found.add(str(item_id))
        out.append((i or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_report_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    def text(n): return " ".join(rng.choice(["Ab", "cd,", "é", "7", "x-y", "the"]) + rng.choice(["", "", "!", "Q"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 25, 40, 12, 0])] + [(14, None), (15, "zz yy xx")]
    docs = [(i, " ".join([text(rng.randrange(30)), rng.choice(items)[1] or "", text(8)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "zz yy"), (104, "ZZ yy-xx"), (104, "ZZ yy-xx")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k1", F.lit(1)).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    for span, gram in ((10, 5), (4, 3)):
        got = sorted(tuple(r) for r in decontaminate.report(d, b, span, gram).collect())
        assert got == brute_report(docs, items, span)
    monkeypatch.setattr("spanlab.llm.common.BROADCAST_ROWS", 0)  # the way beyond a broadcast
    assert sorted(tuple(r) for r in decontaminate.report(d, b).collect()) == brute_report(docs, items, 10)


def test_report_odd_and_empty(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away"), (None, "12345"), (2, None)],
                                  "item_id long, text string")
    rows = decontaminate.report(odd_docs, items).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id for r in rows if r.n_items} == {1, 2, 9, 10, None}
    assert [(r.n_hit, r.n_items, r.contaminated) for r in rows if r.doc_id == 8] == [(1, 0, True)]
    assert decontaminate.report(no_docs, items).collect() == []
    clean = decontaminate.report(odd_docs, items.limit(0)).collect()
    assert len(clean) == odd_docs.count() and not any(r.contaminated for r in clean)


def test_winnowing_guarantee():
    rng = random.Random(2)
    for _ in range(50):
        shared = [rng.choice("abcdefgh").encode() * rng.randrange(1, 4) for _ in range(10)]
        sides = [[rng.choice("uvwxyz").encode() for _ in range(rng.randrange(12))] for _ in range(4)]
        a, b = (b" ".join(x) for x in (sides[0] + shared + sides[1], sides[2] + shared + sides[3]))
        kept = [set(decontaminate.winnow(*decontaminate.word_hashes([t]), 10, 5)[1].tolist()) for t in (a, b)]
        assert kept[0] & kept[1]


# language

def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    size, steps, width = 3, 5, 2
    d = langid.Direction(rng.normal(0, .5, (3 * size, 256)), rng.normal(0, .5, (3 * size, size)), rng.normal(0, .5, size))
    x = rng.integers(0, 4, (steps, width)).astype(np.uint8)
    out_weight = rng.normal(size=(steps, size, width))

    def loss():
        return float((langid._train_states(d, x)[0] * out_weight).sum())
    _, kept = langid._train_states(d, x)
    table, u, b = langid._backward(d, x, kept, out_weight)
    for array, grad in ((d.table, table), (d.u, u), (d.b, b)):
        for at in [tuple(rng.integers(0, n) if n != 256 else rng.integers(0, 4) for n in array.shape) for _ in range(8)]:
            keep = array[at]
            array[at] = keep + 1e-4
            up = loss()
            array[at] = keep - 1e-4
            down = loss()
            array[at] = keep
            assert abs((up - down) / 2e-4 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id])
    assert (held == out.held_out).all()
    assert (out.lang == out.lang_pred)[held].mean() > 0.97
    assert out.score.between(0, 1).all()


def test_sample_counts_copies_once(spark):
    copies = spark.range(20_000).selectExpr("concat('copied text ', id % 5) text", "'few' lang")  # 4,000 of each
    mixed = (spark.range(300).selectExpr("concat('another text ', id) text", "'mixed' lang")
             .union(spark.range(100_000).selectExpr("'one and the same' text", "'mixed' lang")))
    got = langid.sample(copies.union(mixed), F.col("lang"), F.lit(True), 50)
    of = {name: [s for s, l in got if l == name] for name in ("few", "mixed")}
    assert sorted(of["few"]) == [b"copied text %d" % i for i in range(5)]
    assert len(of["mixed"]) == len(set(of["mixed"])) == 50


def test_language_odd_documents(spark, odd_docs, no_docs):
    net = langid.train([(b"the cat and the dog " * 9, "en"), ("le chat et le chien é ".encode() * 9, "fr")], steps=30)
    rows = langid.predict(odd_docs, net, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    x, lengths, of = langid.segments([b"ab" * 100, b"", b"c"])
    assert lengths.tolist() == [96, 96, 8, 1] and of.tolist() == [0, 0, 0, 2]
    p = langid.position_probabilities(net, np.ascontiguousarray(x.T))
    assert p.shape == (96, 2, 4) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    untaught = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, untaught, ["doc_id"]).collect()} == {"und"}
    one = langid.train([(b"only one language here", "xx")])
    assert {r.lang_pred for r in langid.predict(odd_docs, one, ["doc_id"]).collect()} == {"xx", "und"}
    assert langid.predict(no_docs, net, ["doc_id"]).collect() == []


# quality

@needs_data
def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.op10_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0.3) == out.predicted).all()
    assert (out.quality == out.predicted).mean() > 0.95
    low, high = out.score[out.quality == 0], out.score[out.quality == 1]
    assert (low.to_numpy()[:, None] < high.to_numpy()).mean() > 0.97


def test_quality_odd_documents(spark, odd_docs, no_docs):
    texts = ["good clean text about things"] * 3 + ["BUY!! NOW!! NOW!!"] * 3
    model = quality.fit(quality.counts(texts), np.array([1, 1, 1, 0, 0, 0]))
    rows = quality.score(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4)} == {0.5}
    got = quality.score(spark.createDataFrame([(1, texts[0]), (2, texts[-1])], "doc_id long, text string"), model, ["doc_id"])
    assert [r.score for r in got.orderBy("doc_id").collect()] == [1.0, 0.0]
    untaught = quality.fit(*quality.sample(no_docs, spark.createDataFrame([], "doc_id long, label int"), F.lit(True)))
    assert {r.score for r in quality.score(odd_docs, untaught, ["doc_id"]).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (7, None), (None, 1)], "doc_id long, label int")
    raw, y = quality.sample(odd_docs, labels, F.lit(True))
    assert y.tolist() == [0, 1] and len(raw) == 2


def test_counts_cover_whole_texts(monkeypatch):
    text = "abc déf " * 500
    whole = quality.counts([text])
    monkeypatch.setattr(quality, "HELD_BYTES", 37)
    assert (quality.counts([text]) == whole).all()
