"""Fill-in-the-middle, hard negatives and packing against plain versions of them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlab.llm import hard_negatives as H
from spanlab.llm import infill, packing

DIR = "/root/testdata/sf0.001"


# ---- fill in the middle


def naive_infill(text, doc_id):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", "a", "é", "日本語" * 30000, "x" * 200_000, ("ab" * 20 + "é") * 5000, "a€𝄞é" * 9000, "<P>a", "b<M", "a<S>b",
         "x" * 65535 + "é" + "y" * 70000, "x" * 65536 + "日", "<" * 50, "<P" * 30]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_every_boundary_is_selected(text):
    boundaries = infill.Boundaries(text.encode())
    assert len(boundaries) == len(text) + 1
    sizes = np.cumsum([0, *(len(c.encode()) for c in text)])
    for i in {0, len(text), *random.Random(1).sample(range(len(text) + 1), min(300, len(text) + 1))}:
        assert boundaries.select(i) == sizes[i]


def test_all_three_containers_occur():
    assert isinstance(infill.Boundaries(b"x" * 100).containers[0], infill.Runs)
    assert isinstance(infill.Boundaries(("é" * 10).encode()).containers[0], infill.Array)
    assert isinstance(infill.Boundaries(("é" * 30000).encode()).containers[0], infill.Bitmap)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 10**6))
def test_transform_is_the_plain_one(text, doc_id):
    text = text.encode("utf-8", "ignore").decode()
    *rest, output = infill.transform(text, doc_id)
    assert (*rest, output.decode()) == naive_infill(text, doc_id)


def test_infill_query_on_odd_documents(spark, odd_docs):
    got = infill.fill_in_middle(odd_docs.withColumn("form", F.lit("clash")).withColumn("N", F.lit(1)))
    rows = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r.doc_id, *naive_infill(r.text, r.doc_id)) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == want
    assert all(r.back == (r.text or "") for r in rows)
    assert {"lang", "key", "score"} <= set(got.columns)
    texts = spark.createDataFrame([(i, t) for i in range(20) for t in TEXTS], "doc_id long, text string")
    back = infill.fill_in_middle(texts).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    assert {r.form for r in back.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_infill_of_an_empty_table(no_docs):
    assert infill.fill_in_middle(no_docs).count() == 0


# ---- hard negatives


def naive_negatives(rows, every=50):
    """``rows``: (id, label, vector); every row is a row of its own."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (aid, label, vector) in enumerate(rows):
        if aid % every:
            continue
        scored = [(-dot(vector, v), r, lab == label) for j, (r, lab, v) in enumerate(rows) if j != i]
        for s, pid, _ in sorted(x for x in scored if x[2])[:5]:
            ps = -s
            fits = sorted(x for x in scored if not x[2] and 50 * ps <= -100 * x[0] <= 95 * ps)
            out += [(aid, pid, k + 1, nid, ps, -ns) for k, (ns, nid, _) in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>").repartition(3)
    got = H.hard_negatives(df, **kw).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dim,spread,same", [(40, 60, 0), (7, 5, 0), (33, 200, 150), (2, 3, 40)])
def test_negatives_against_brute_force(spark, dim, spread, same):
    rng = random.Random(dim)
    hot = [rng.randint(-spread, spread) for _ in range(dim)]
    rows = [(i, rng.randrange(4), [rng.randint(-spread, spread) for _ in range(dim)] if i > same else hot) for i in range(400)]
    assert mined(spark, rows) == naive_negatives(rows)


def test_negatives_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randint(-9, 9) for _ in range(6)]) for i in range(120)]
    rows += [(50, 0, rows[50][2]), (51, 1, rows[51][2]), (51, 1, rows[51][2])]  # repeated ids
    rows += [(200, 7, [1, 2, 3, 4, 5, 6])]  # alone in its label
    rows += [(300, 1, []), (301, 2, [5, 5]), (302, 1, [0] * 6), (-50, 1, [3] * 6)]  # short, zero, negative id
    want = naive_negatives(rows)
    assert want and mined(spark, rows) == want
    odd = [(None, 1, [1] * 6), (400, None, [9] * 6), (401, 1, None)]
    big = [(402, 1, [1 << 40] * 6)]
    df = rows + odd + big
    assert mined(spark, df) == want
    assert mined(spark, []) == []


def test_negatives_dealt_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, i % 4, [rng.randint(-50, 50) for _ in range(20)]) for i in range(500)]
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(H, "DEAL", 1)
    assert mined(spark, rows, every=10) == naive_negatives(rows, 10)


def test_scaled_components(spark):
    rows = [([0.5, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(H.scaled(F.col("v"))).collect()]
    assert got == [[128, -1], None, None, None, [], None]


def test_index_leaves_rows_out_but_loses_no_pair():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-100, 100, (300, 64)) * (rng.random((300, 1)) < 0.5)
    queries = rng.integers(-100, 100, (20, 64))
    scores = queries @ vectors.T
    for least in (0, 20_000, 60_000, 120_000):
        index = H.SuffixIndex(vectors, np.arange(64))
        found = {(q, int(r)): int(s) for q, rows, s_ in H.reached(queries, index, np.full(20, least)) for r, s in zip(rows, s_)}
        assert found == {(q, r): int(scores[q, r]) for q, r in zip(*np.nonzero(scores >= least))}
        if least > 60_000:
            assert index.first.max() > 0


# ---- packing


def plain_best_two_fit(lengths, capacity):
    """One bin after the other, looking at every pair."""
    left, bins = Counter(lengths), []
    while left := +left:
        bin_, room = [], capacity
        while True:
            while fits := [n for n in left if left[n] and n <= room]:
                bin_.append(max(fits))
                left[bin_[-1]] -= 1
                room -= bin_[-1]
            gap = room + min(bin_)
            pairs = [(x + y, x, y) for x in left for y in left if left[x] and left[y] and (x != y or left[x] > 1)
                     and min(bin_) < x + y <= gap]
            if not room or not pairs:
                break
            _, x, y = min(p for p in pairs if p[0] == max(pairs)[0])
            left[x] -= 1
            left[y] -= 1
            left[min(bin_)] += 1
            bin_.remove(min(bin_))
            bin_ += [x, y]
            room = capacity - sum(bin_)
        bins.append(tuple(sorted(bin_)))
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan_is_best_two_fit_one_by_one(case):
    capacity, lengths = case
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    bins = packing.best_two_fit(counts, capacity)
    got = sorted(b for d, times in bins for b in [tuple(sorted(n for n, k in d.items() for _ in range(k)))] * times)
    assert got == plain_best_two_fit(lengths, capacity)
    plan = packing.plan(counts, capacity)
    length = np.array(sorted(lengths), np.int64)
    rank = np.concatenate([np.arange(k) for k in counts] or [[]]).astype(np.int64)
    if len(length):
        check_places(zip(length, *plan.place(length, rank)), capacity, plan.n_sequences)


def check_places(rows, capacity, n_sequences=None):
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[int(sequence)].append((int(offset), int(length)))
    assert n_sequences is None or sorted(by) == list(range(n_sequences))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 2048), minlength=2049)
    few, many = packing.best_two_fit(counts, 2048), packing.best_two_fit(counts * 10**6, 2048)
    assert len(many) < 1.5 * len(few)
    tokens = int((counts * np.arange(2049)).sum())
    assert sum(k for _, k in few) <= 1.001 * tokens / 2048 + 1
    assert sum(k for _, k in many) <= 1.001 * tokens * 10**6 / 2048 + 1


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ09é'sİΣ \n\t.,;!)(_-́क़ ß日 \x1c"), max_size=30), max_size=5))
def test_encoder_is_the_library(texts):
    import pyarrow as pa
    data, stops = ENCODER.encode(pa.array(texts, pa.string()))
    ids = [np.frombuffer(memoryview(data)[a:b], np.uint32).tolist() for a, b in zip(stops, stops[1:])]
    assert ids == [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]


ENCODER = packing.WordEncoder(P.path("word_bpe_49k.json"))


def expected_pieces(rows, capacity):
    t, out = library(), Counter()
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for n, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            out[doc_id, n, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def test_packing_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = packing.pack(odd_docs.withColumn("length", F.lit("clash")).withColumn("rank", F.lit(1)),
                       P.path("word_bpe_49k.json"), 256, tokens=True)
    assert {"lang", "key"} <= set(got.columns)
    found = got.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected_pieces(rows, 256)
    check_places([(r.length, r.sequence_id, r.offset) for r in found], 256)
    for s in packing.sequences(got).collect():
        parts = sorted((r.offset, r.tokens) for r in found if r.sequence_id == s.sequence_id)
        assert s.tokens == b"".join(t for _, t in parts) and s.starts == [o for o, _ in parts]


def test_packing_an_empty_table(no_docs):
    assert packing.pack(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    found = packing.op13_best_fit_packing(spark, DIR).collect()
    want = expected_pieces(rows, 2048)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    n = check_places([(r.length, r.sequence_id, r.offset) for r in found], 2048)
    assert n == len(plain_best_two_fit([k[3] for k in want.elements()], 2048))


def test_encoder_with_a_small_cache(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing, "CACHE", 20)
    encoder = packing.WordEncoder(P.path("word_bpe_49k.json"))
    for text in ("one two three. four, five! " * 3, "six seven " + "x" * 500, "one " + "x" * 500 + " eight nine ten"):
        data, stops = encoder.encode(pa.array([text, None, "a b c " + text]))
        ids = [np.frombuffer(memoryview(data)[a:b], np.uint32).tolist() for a, b in zip(stops, stops[1:])]
        assert ids == [e.ids for e in encoder.tokenizer.encode_batch([text, "", "a b c " + text], add_special_tokens=False)]


def test_broadcast_counts_every_wide_column(spark):
    from spanlab.llm.common import materialise, small
    hint = lambda df: "BroadcastExchange" in spark.range(3).join(
        small(df), "id")._jdf.queryExecution().executedPlan().toString()
    narrow = materialise(spark.range(1000), "small-narrow")
    wide = materialise(spark.range(1000).withColumn("x", F.repeat(F.lit("y"), 20_000)), "small-wide")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert hint(narrow) and not hint(wide)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
