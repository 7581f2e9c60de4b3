"""Subword windows against the tokenizer's own overflow windows and a plain alignment."""

import os
import random
import struct

import numpy as np
import pytest

from spanlab import schemas
from spanlab.operators import subword

P = pytest.importorskip("public_tokenizers")
xxhash = pytest.importorskip("xxhash")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
SF = "/root/testdata/sf0.001"
BEGIN = END = "<|endoftext|>"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = ["", "  \n ", "Été :  l'IRM — tumeur 😀 gauche\n<|endoftext|>", "mot " * 61, "é" * 40 + " fin",
         "a b\tc  d", "grade 2, " * 33 + "ok", None]


def own(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


def trimmed(text, a, b):
    w = text[a:b]
    return (a, b) if not w.strip() else (a + len(w) - len(w.lstrip()), a + len(w.rstrip()))


def xx(values):
    """xxhash64 of an integer array: each value hashed with the hash so far as the seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("size,stride", [(12, 4), (8, 0), (512, 256)])
def test_windows_equal_the_overflow_of_the_tokenizer(spark, name, size, stride):
    v = subword.Vocabulary(spark, P.path(name))
    rows = subword.encode_windows(frame(spark, TEXTS), v, BEGIN, END, None, size, stride, surface=True).collect()
    got = {(r.doc_id, r.chunk): r for r in rows}
    assert len(got) == len(rows)
    t = own(name)
    t.enable_truncation(size - 2, stride=stride)
    special, n = t.token_to_id(BEGIN), 0
    for d, text in enumerate(TEXTS):
        text = text or ""
        first = t.encode(text, add_special_tokens=False)
        for c, enc in enumerate([first, *first.overflowing]):
            r, k = got[d, c], len(enc.ids)
            n += 1
            pad = size - 2 - k
            assert r.input_ids == [special, *enc.ids, special] + [0] * pad
            assert r.attention_mask == [1] * (k + 2) + [0] * pad
            assert r.special_tokens_mask == [1] + [0] * k + [1] * (pad + 1)
            assert [tuple(o) for o in r.offsets] == [(0, 0)] + [trimmed(text, *o) for o in enc.offsets] + [(0, 0)] * (pad + 1)
            assert [x.w for x in r.tokens] == [text[slice(*trimmed(text, *o))] for o in enc.offsets]
            assert [x.word for x in r.tokens] == enc.word_ids
            assert r.n_overlap == (min(stride, k) if c else 0)
    assert n == len(rows)


def test_no_specials_no_rows_and_bad_geometry(spark):
    v = subword.Vocabulary(spark, P.path(FILES[0]))
    r = subword.encode_windows(frame(spark, ["one two"]), v, max_length=4, stride=1).first()
    assert len(r.input_ids) == 4 and r.special_tokens_mask == [0, 0, 1, 1]
    assert subword.encode_windows(frame(spark, []), v, max_length=4, stride=1).count() == 0
    with pytest.raises(ValueError):
        subword.encode_windows(frame(spark, []), v, BEGIN, END, max_length=4, stride=2)
    with pytest.raises(ValueError):
        v.id("<no such token>")


def plain_labels(offsets, spans):
    """Label ids: first span in order that contains the token; B- once per span."""
    begun, out = set(), []
    for s, e in offsets:
        hit = next(((o, lab) for o, a, b, lab in spans if s >= a and e <= b), None)
        out.append("O" if hit is None else ("I-" if hit[0] in begun else "B-") + hit[1])
        begun |= {hit[0]} if hit else set()
    return [schemas.LABEL2ID[x] for x in out]


@pytest.mark.parametrize("name", FILES)
def test_labels_of_subwords(spark, name):
    texts = ["Adénocarcinome lieberkühnien du côlon droit,  grade 2"] * 2 + ["rien ici", ""]
    label = next(x[2:] for x in schemas.LABELS if x.startswith("B-"))
    spans = [(0, 0, 0, 28, label), (0, 1, 32, 43, label), (1, 0, 47, 54, label), (0, 2, 0, 14, label)]
    docs = frame(spark, texts)
    sp = spark.createDataFrame(spans, "doc_id long, ord long, start int, end int, label string")
    v = subword.Vocabulary(spark, P.path(name))
    rows = subword.labelled_windows(docs, sp, v, BEGIN, END, None, 512, 0).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3]
    for r in rows:
        enc = own(name).encode(texts[r.doc_id], add_special_tokens=False)
        want = plain_labels([trimmed(texts[r.doc_id], *o) for o in enc.offsets], [s[1:] for s in spans if s[0] == r.doc_id])
        assert r.labels == [-100] + want + [-100] * (511 - len(want))
        assert r.input_ids[1:len(want) + 1] == enc.ids
        assert (sum(x > 0 for x in want) > 0) == (r.doc_id < 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_queries_against_plain_python(spark):
    from spanlab.plans import q_subword as q

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spans = {}
    for r in q.word_spans(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id", "ord").collect():
        spans.setdefault(r.doc_id, []).append((r.ord, r.start, r.end, r.label))
    t = own(q.VOCABULARY)
    b, e = t.token_to_id(q.BEGIN), t.token_to_id(q.END)
    content, step = q.MAX_LENGTH - 2, q.MAX_LENGTH - 2 - q.STRIDE
    windows, labels = {}, {}
    for d, text in docs.items():
        enc = t.encode(text, add_special_tokens=False)
        offsets = [trimmed(text, *o) for o in enc.offsets]
        tags, first, c = plain_labels(offsets, spans.get(d, [])), 0, 0
        while True:
            ids, at = enc.ids[first:first + content], offsets[first:first + content]
            pad = content - len(ids)
            framed = xx([b, *ids, e] + [e] * pad)
            places = [(0, 0), *at, (0, 0)] + [(0, 0)] * pad
            windows[d, c] = (len(ids), min(q.STRIDE, len(ids)) if c else 0, places[1][0], framed,
                             xx([1] * (len(ids) + 2) + [0] * pad), xx(x for o in places for x in o))
            # an entity begins once, in the first window that holds its first token
            seen = content - step if c else 0
            own_tags = [schemas.LABEL2ID["I-" + schemas.ID2LABEL[x][2:]] if k < seen and schemas.ID2LABEL[x][0] == "B" else x
                        for k, x in enumerate(tags[first:first + content])]
            labels[d, c] = (len(ids), sum(x > 0 for x in own_tags), framed, xx([-100] + own_tags + [-100] * (pad + 1)))
            if first + content >= len(enc.ids):
                break
            first, c = first + step, c + 1
    got = {(r.doc_id, r.chunk): tuple(r)[2:] for r in q.q_subword_windows(spark, SF).collect()}
    assert got == windows
    got = {(r.doc_id, r.chunk): tuple(r)[2:] for r in q.q_subword_labels(spark, SF).collect()}
    assert got == labels and sum(x[1] for x in labels.values()) > 100


def test_painted_labels_equal_the_definition():
    rnd = random.Random(5)
    label = [x[2:] for x in schemas.LABELS if x.startswith("B-")]
    for shuffled in (False, True):
        for _ in range(200):
            at = sorted((a, a + rnd.randint(0, 4)) for a in (rnd.randint(0, 30) for _ in range(rnd.randint(0, 15))))
            at = sorted(at, key=lambda x: (x[0], x[1])) if not shuffled else rnd.sample(at, len(at))
            spans = [(k, a, a + rnd.randint(0, 12), rnd.choice(label)) for k, a in
                     enumerate(rnd.choices(range(30), k=rnd.randint(0, 6)))]
            rows = [dict(zip(("ord", "start", "end", "label"), x)) for x in rnd.sample(spans, len(spans))]
            got = subword._labels(np.array(at, np.int32).reshape(-1, 2), rows)
            assert got.tolist() == plain_labels(at, spans)


def test_plug_in_keeps_offsets_and_words(spark):
    v = subword.Vocabulary(spark, P.path(FILES[1]))
    rows = subword.tokenizer(v)(frame(spark, TEXTS)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6}
    for r in rows:
        assert TEXTS[r.doc_id][r.s:r.e] == r.w and r.id >= 0 and r.word >= 0


def test_windows_are_cut_without_a_shuffle(spark):
    v = subword.Vocabulary(spark, P.path(FILES[0]))
    plan = subword.encode_windows(frame(spark, ["x"]), v, BEGIN, END)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
