"""Tokens, windows and BIO tags (FX4 and window fixtures)."""

from pyspark.sql import functions as F

from spanlab.operators import bio
from spanlab.operators import tokens as tok


def tags_frame(spark, seq, doc=1):
    rows = [(doc, k, 10 * k, 10 * k + 9, t, sc) for k, (t, sc) in enumerate(seq)]
    return spark.createDataFrame(rows, "doc_id long, i int, s int, e int, tag string, score double")


def decode(spark, seq):
    return [(r.label, r.start, r.end, r.score) for r in
            bio.decode(tags_frame(spark, seq)).orderBy("start").collect()]


def test_decode_cases(spark):
    assert decode(spark, [("B-morphologie", 0.9), ("I-morphologie", 0.8), ("O", 1.0)]) == \
        [("morphologie", 0, 19, 0.85)]
    assert decode(spark, [("O", 1.0), ("O", 1.0)]) == []
    assert decode(spark, [("I-topographie", 0.5)]) == [("topographie", 0, 9, 0.5)]
    assert [x[0] for x in decode(spark, [("B-morphologie", 1.0), ("O", 1.0),
                                         ("B-topographie", 1.0)])] == ["morphologie", "topographie"]
    assert decode(spark, [("B-morphologie", 1.0), ("I-topographie", 1.0)]) == \
        [("morphologie", 0, 9, 1.0), ("topographie", 10, 19, 1.0)]
    assert decode(spark, [("B-morphologie", 1.0), ("B-morphologie", 1.0)]) == \
        [("morphologie", 0, 9, 1.0), ("morphologie", 10, 19, 1.0)]
    assert decode(spark, [("O", 1.0), ("B-morphologie", 0.6), ("I-morphologie", 0.6)]) == \
        [("morphologie", 10, 29, 0.6)]


def test_tokenize_offsets(spark):
    text = "  Carcinome  canalaire\tinfiltré.\n"
    d = spark.createDataFrame([(1, text), (2, ""), (3, "a")], "doc_id long, text string")
    t = tok.tokenize(d).orderBy("doc_id", "i").collect()
    got = [(r.doc_id, r.i, r.w, text[r.s:r.e] if r.doc_id == 1 else r.w) for r in t]
    assert [(g[1], g[2]) for g in got if g[0] == 1] == [(0, "Carcinome"), (1, "canalaire"),
                                                          (2, "infiltré.")]
    assert all(g[2] == g[3] for g in got)
    assert [(r.i, r.s, r.e) for r in t if r.doc_id == 3] == [(0, 0, 1)]


def test_tokenize_unicode_blanks_and_shared_keys(spark):
    texts = ["aa bb", "cccc dd", "\u00a0x\u2003y\u3000\U0001f642z ", None, "\x85", "e\u0301 q"]
    d = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").coalesce(1)
    got = [(r.i, r.s, r.e, r.w) for r in tok.tokenize(d).collect()]
    assert got == [(0, 0, 2, "aa"), (1, 3, 5, "bb"), (0, 0, 4, "cccc"), (1, 5, 7, "dd"), (0, 1, 2, "x"), (1, 3, 4, "y"),
                   (2, 5, 7, "\U0001f642z"), (0, 0, 2, "e\u0301"), (1, 3, 4, "q")]
    counts = {r.n_tokens for r in tok.token_counts(d.where("text = '\u00a0x\u2003y\u3000\U0001f642z '")).collect()}
    assert counts == {3}


def test_tokenize_has_no_shuffle(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = tok.tokenize(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_windows_cover_every_token(spark):
    rows = [(1, k, k * 2, k * 2 + 1, f"w{k}") for k in range(1100)]
    t = spark.createDataFrame(rows, "doc_id long, i int, s int, e int, w string")
    w = tok.windows(t, 512, 256, 0).orderBy("chunk").collect()
    content, step = 512, 256
    n = 1100
    assert len(w) == 1 + -(-(n - content) // step)
    assert [(r.first_i, r.last_i) for r in w] == [(0, 511), (256, 767), (512, 1023), (768, 1099)]
    assert [r.n_overlap for r in w] == [0, 256, 256, 256]
    wt = tok.window_tokens(t, 512, 256, 0)
    assert wt.select("i").distinct().count() == n


def test_align_first_span_wins_and_b_once(spark):
    toks = spark.createDataFrame([(1, k, 10 * k, 10 * k + 9, f"w{k}") for k in range(6)],
                                 "doc_id long, i int, s int, e int, w string")
    spans = spark.createDataFrame([(1, 1, 10, 29, "morphologie"), (1, 2, 20, 39, "topographie"),
                                   (1, 3, 50, 59, "topographie")],
                                  "doc_id long, ord long, start int, end int, label string")
    a = {r.i: r.tag for r in bio.align(toks, spans).collect()}
    assert a == {0: "O", 1: "B-morphologie", 2: "I-morphologie", 3: "B-topographie",
                 4: "O", 5: "B-topographie"}


def test_dedupe_last_label_first_position(spark):
    spans = spark.createDataFrame([(1, 1, 0, 5, "morphologie"), (1, 2, 0, 5, "expression_CIM")],
                                  "doc_id long, ord long, start int, end int, label string")
    r = bio.dedupe_spans(spans).first()
    assert (r.ord, r.label) == (1, "expression_CIM")


def test_merge_windows_first_wins(spark):
    rows = [(1, 0, 3, 30, 39, "B-morphologie", 0.9), (1, 1, 0, 30, 39, "O", 0.7),
            (1, 1, 1, 40, 49, "I-morphologie", 0.6)]
    df = spark.createDataFrame(rows, "doc_id long, chunk int, j int, s int, e int, tag string, "
                                     "score double")
    m = {r.s: (r.tag, r.score) for r in bio.merge_windows(df).collect()}
    assert m == {30: ("B-morphologie", 0.9), 40: ("I-morphologie", 0.6)}


def test_softmax_argmax(spark):
    import math
    lg = [0.1, 2.0, -1.0, 0.5, 0.0, 0.0, 0.0, 0.3, 1.9]
    df = spark.createDataFrame([(lg,)], "logits array<double>")
    idx, p = bio.softmax_argmax(F.col("logits"))
    r = df.select(idx.alias("i"), p.alias("p"), bio.id_label_expr(idx).alias("t")).first()
    ex = [math.exp(x - max(lg)) for x in lg]
    assert r.i == 1 and r.t == "B-morphologie" and abs(r.p - 1 / sum(ex)) < 1e-12


def test_pad_windows(spark):
    rows = [(1, 0, k, 2 * k, 2 * k + 1, f"w{k}", 0) for k in range(3)]
    wt = spark.createDataFrame(rows, "doc_id long, chunk int, j int, s int, e int, w string, "
                                     "label_id int")
    p = tok.pad_windows(tok.window_arrays(wt, label_col="label_id"), 8).first()
    assert p.attention_mask == [1, 1, 1, 0, 0, 0, 0, 0]
    assert p.labels == [0, 0, 0, -100, -100, -100, -100, -100]
    assert len(p.tokens) == 8


def test_decode_columns_equals_decode(spark):
    import random
    rnd = random.Random(5)
    labels = ["O", "B-morphologie", "I-morphologie", "I-topographie", "B-topographie"]
    rows = [(d, k, 10 * k, 10 * k + 9, rnd.choice(labels), rnd.choice(labels), rnd.randint(1, 255) / 256)
            for d in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, i int, s int, e int, tag string, tag_m string, "
                                     "score_m double")
    multi = bio.decode_columns(df, {"gold": ("tag", None), "m": ("tag_m", "score_m")})
    cols = ["doc_id", "ord", "label", "start", "end", "n_tokens"]
    for side, tc, sc in (("gold", "tag", None), ("m", "tag_m", "score_m")):
        one = bio.decode(df.withColumnRenamed(tc, "t_").withColumnRenamed("t_", "tag_x"),
                         tag_col="tag_x", score_col=sc)
        a = sorted(tuple(r) for r in multi.where(f"side = '{side}'").select(*cols).collect())
        b = sorted(tuple(r) for r in one.select(*cols).collect())
        assert a == b
    sc = sorted(r.score for r in multi.where("side = 'm'").collect())
    assert sc == sorted(r.score for r in bio.decode(df.select("doc_id", "i", "s", "e",
                                                              F.col("tag_m").alias("tag"),
                                                              F.col("score_m").alias("score"))).collect())
