"""Strict span evaluation and error analysis (FX6)."""

import random

from spanlab.operators import evaluate as ev

SCHEMA = "doc_id long, ord long, start int, end int, label string"


def run(spark, gold, pred):
    g = spark.createDataFrame(gold, SCHEMA)
    p = spark.createDataFrame(pred, SCHEMA)
    return g, p, ev.strict_outcomes(g, p)


def counts(out):
    return {r.label: (r.tp, r.boundary_errors, r.fn_pure, r.fp_pure)
            for r in ev.error_counts(out).collect()}


def test_taxonomy(spark):
    gold = [(1, 1, 0, 10, "morphologie"), (1, 2, 20, 30, "morphologie"), (1, 3, 40, 50, "topographie"),
            (1, 4, 60, 70, "topographie")]
    pred = [(1, 1, 0, 10, "morphologie"), (1, 2, 22, 30, "morphologie"),
            (1, 3, 60, 70, "morphologie"), (1, 4, 80, 90, "differenciation")]
    _, _, out = run(spark, gold, pred)
    c = counts(out)
    assert c["morphologie"] == (1, 1, 0, 1)          # exact, shifted, spurious (other label)
    assert c["topographie"] == (0, 0, 2, 0)          # missed, same span other label -> FN
    assert c["differenciation"] == (0, 0, 0, 1)


def test_two_preds_one_gold_and_tie(spark):
    gold = [(1, 1, 0, 10, "morphologie")]
    pred = [(1, 1, 0, 5, "morphologie"), (1, 2, 5, 10, "morphologie")]  # tie in overlap
    _, _, out = run(spark, gold, pred)
    rows = {(r.type, r.pred_start) for r in out.collect()}
    assert rows == {("BOUNDARY", 0), ("FP_PURE", 5)}  # first pred in order wins the tie


def test_boundary_only_label_kept(spark):  # Q18
    _, _, out = run(spark, [(1, 1, 0, 10, "differenciation")], [(1, 1, 2, 10, "differenciation")])
    m = {r.label: r for r in ev.strict_metrics(out).collect()}
    assert m["differenciation"].boundary_errors == 1
    assert (m["differenciation"].precision, m["differenciation"].f1) == (0.0, 0.0)


def test_length_categories_and_no_errors(spark):
    docs = spark.createDataFrame([(1, "x" * 2999), (2, "x" * 3000), (3, "x" * 7999), (4, "x" * 8000)],
                                 "doc_id long, text string")
    gold = [(d, 1, 0, 5, "morphologie") for d in (1, 2, 3, 4)]
    g, p, out = run(spark, gold, gold)
    by_doc = {r.doc_id: (r.category, r.error_rate) for r in ev.error_rate_by_doc(out, g, docs).collect()}
    assert by_doc == {1: ("court (<3000)", 0.0), 2: ("moyen (3000-8000)", 0.0),
                      3: ("moyen (3000-8000)", 0.0), 4: ("long (>8000)", 0.0)}
    cats = ev.error_rate_by_category(ev.error_rate_by_doc(out, g, docs)).collect()
    assert {r.category for r in cats} == {"court (<3000)", "moyen (3000-8000)", "long (>8000)"}


def test_greedy_properties(spark):
    """One-to-one, and no candidate left that should have gone before those that took its sides."""
    rnd = random.Random(11)
    gold, pred = [], []
    for d in range(8):
        for k in range(25):
            s = rnd.randint(0, 300)
            gold.append((d, k, s, s + rnd.randint(1, 30), rnd.choice("ab")))
        for k in range(25):
            s = rnd.randint(0, 300)
            pred.append((d, k, s, s + rnd.randint(1, 30), rnd.choice("ab")))
    g = spark.createDataFrame(gold, SCHEMA)
    p = spark.createDataFrame(pred, SCHEMA)
    cands = {(r.doc_id, r.g_ord, r.p_ord): (-r.overlap, r.g_ord, r.p_ord) for r in ev.overlap_pairs(g, p).collect()}
    got = {(r.doc_id, r.g_ord, r.p_ord) for r in ev.greedy_match(ev.overlap_pairs(g, p)).collect()}
    assert got <= set(cands)
    by_g, by_p = {(d, a): cands[d, a, b] for d, a, b in got}, {(d, b): cands[d, a, b] for d, a, b in got}
    assert len(by_g) == len(by_p) == len(got)
    for (d, a, b), order in cands.items():
        if (d, a, b) not in got:
            assert min(by_g.get((d, a), (1,)), by_p.get((d, b), (1,))) < order
    out = ev.strict_outcomes(g, p)
    c = ev.error_counts(out).collect()
    assert sum(r.tp + r.boundary_errors + r.fn_pure for r in c) == len(gold)  # invariant
    assert sum(r.tp + r.boundary_errors + r.fp_pure for r in c) == len(pred)


def test_strict_by_model_and_truncated(spark):
    gold = [(1, 1, 0, 10, "morphologie"), (1, 2, 20, 30, "morphologie")]
    models = {"a": [(1, 1, 0, 10, "morphologie"), (1, 2, 20, 30, "morphologie")], "b": [(1, 1, 2, 10, "morphologie")]}
    g = ev.per_model(spark.createDataFrame(gold, SCHEMA), list(models))
    p = spark.createDataFrame([(*r, m) for m, rows in models.items() for r in rows], SCHEMA + ", model string")
    got = {r.model: (r.tp, r.boundary_errors, r.fn_pure) for r in ev.strict_metrics(
        ev.strict_outcomes(g, p, ("doc_id", "model")), ("model",)).collect()}
    assert got == {"a": (2, 0, 0), "b": (0, 1, 1)}
    limits = spark.createDataFrame([(1, 15)], "doc_id long, last_char int")
    cut = ev.truncated(spark.createDataFrame(models["a"], SCHEMA), limits)
    out = ev.strict_outcomes(spark.createDataFrame(gold, SCHEMA), cut)
    assert counts(out)["morphologie"] == (1, 0, 1, 0)


def test_confusion_and_summary(spark):
    gold = [(1, 1, 0, 10, "morphologie"), (1, 2, 20, 30, "topographie")]
    pred = [(1, 1, 0, 8, "morphologie"), (1, 2, 40, 50, "differenciation")]
    _, _, out = run(spark, gold, pred)
    cm = {r.gold_label: r.asDict() for r in ev.confusion(out, spark).collect()}
    assert cm["morphologie"]["morphologie"] == 1 and cm["topographie"]["O"] == 1
    assert cm["O"]["differenciation"] == 1 and len(cm) == 5
    s = {(r.type, r.label): r.n for r in ev.error_summary(out).collect()}
    assert s[("BOUNDARY", "ALL")] == 1 and s[("FP_PURE", "differenciation")] == 1
    micro = {r.label: r for r in ev.strict_micro(out).collect()}
    assert micro["ALL"].tp == 0 and micro["ALL"].fn_pure == 1


def test_seq_eval(spark):
    rows = [(1, 0, 0, "B-morphologie", "B-morphologie"), (1, 0, 1, "I-morphologie", "I-morphologie"),
            (1, 0, 2, "O", "B-topographie"), (1, 0, 3, "B-topographie", "O")]
    pairs = spark.createDataFrame(rows, "doc_id long, chunk int, j int, gold_tag string, pred_tag string")
    r = ev.seq_eval(pairs).first()
    assert (r.n_gold, r.n_pred, r.n_correct) == (2, 2, 1)
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.5, 0.5, 0.5, 0.5)


def test_seq_eval_systems_and_masks(spark):
    rows = [(1, 0, 0, "B-morphologie", "B-morphologie", "O", False), (1, 0, 1, "I-morphologie", "I-morphologie", "O", False),
            (1, 1, 0, "I-morphologie", "I-morphologie", "O", True), (1, 1, 1, "O", "O", "O", False)]
    pairs = spark.createDataFrame(rows, "doc_id long, chunk int, j int, gold_tag string, a string, b string, overlap boolean")
    got = {r.model: r for r in ev.seq_eval(pairs, preds={"m1": "a", "m2": "b"}).collect()}
    assert (got["m1"].f1, got["m1"].n_gold, got["m1"].n_chunks) == (1.0, 2, 2)
    assert (got["m2"].f1, got["m2"].n_pred, got["m2"].accuracy) == (0.0, 0, 0.25)
    masked = ev.seq_eval(pairs.where("not overlap"), preds={"m1": "a"}).first()
    assert (masked.n_gold, masked.n_correct, masked.n_chunks) == (1, 1, 2)
    assert ev.seq_eval(pairs.limit(0), preds={"m1": "a"}).collect() == []
