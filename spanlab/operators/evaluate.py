"""Span-level (strict) and sequence-level evaluation
(J10-J14, A12-A19, A24, A25, U3, U5, W10, W11, M6-M8).

Inputs are entity tables ``(doc_id, ord, start, end, label)`` for gold and
predictions (``ord`` = row order inside the document).  Everything is keyed
on ``doc_id`` (plus ``model`` when several prediction sets are evaluated at
once), so plans reuse one document partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab import schemas
from spanlab.functions.text import length_category, safe_div, text_slice

BIN = 64  # position bin (chars) of the overlap range join


def _bins(start, end):
    lo = F.floor(start / BIN).cast("int")
    hi = F.floor(F.greatest(end - 1, start) / BIN).cast("int")
    return F.sequence(lo, hi)


def overlap_pairs(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("doc_id",)
                  ) -> DataFrame:
    """Same-label (gold, pred) pairs with overlap = min(end) - max(start) > 0.

    Range join by 64-char bins on ``(keys, label, bin)``; a pair that shares
    several bins is kept only in the bin of ``max(start)`` (its first common
    bin), so no distinct is needed.
    """
    k = list(keys)
    g = gold.select(*k, "label", F.col("ord").alias("g_ord"), F.col("start").alias("g_start"),
                    F.col("end").alias("g_end"))
    p = pred.select(*k, "label", F.col("ord").alias("p_ord"), F.col("start").alias("p_start"),
                    F.col("end").alias("p_end"))
    g = g.withColumn("_bin", F.explode(_bins(F.col("g_start"), F.col("g_end"))))
    p = p.withColumn("_bin", F.explode(_bins(F.col("p_start"), F.col("p_end"))))
    j = g.join(p, k + ["label", "_bin"], "inner")
    ov = F.least("g_end", "p_end") - F.greatest("g_start", "p_start")
    first_bin = F.floor(F.greatest("g_start", "p_start") / BIN).cast("int")
    return (j.where((ov > 0) & (F.col("_bin") == first_bin))
            .withColumn("overlap", ov).drop("_bin"))


def greedy_match(cands: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One-to-one assignment, candidates taken by (overlap desc, gold
    order, pred order) and accepted when neither side is used yet.

    Candidates that share an entity overlap, so they fall into clusters of overlapping
    candidates per (keys, label): gaps and islands on the union of both spans.  No
    choice in one cluster touches another.  One pass: a lone candidate is accepted as it
    is, larger clusters are folded with used-sets; a fold is bounded by its cluster.
    """
    k = list(keys)
    lo, hi = F.least("g_start", "p_start"), F.greatest("g_end", "p_end")
    w = Window.partitionBy(*k, "label").orderBy(lo, "g_ord", "p_ord")
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = cands.withColumn("_new", F.coalesce((lo >= reach).cast("int"), F.lit(1)))
    c = c.withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    fields = [c_ for c_ in cands.columns if c_ not in (*k, "label")]
    item = F.struct((-F.col("overlap")).alias("_neg"), F.col("g_ord").alias("_g"),
                    F.col("p_ord").alias("_p"), F.struct(*fields).alias("_row"))
    clusters = c.groupBy(*k, "label", "_c").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    init = F.struct(F.array().cast("array<bigint>").alias("g"),
                    F.array().cast("array<bigint>").alias("p"),
                    F.array().cast(clusters.schema["_l"].dataType).alias("acc"))

    def step(acc, x):
        used = F.array_contains(acc["g"], x["_g"].cast("bigint")) | \
            F.array_contains(acc["p"], x["_p"].cast("bigint"))
        return F.when(used, acc).otherwise(F.struct(
            F.array_append(acc["g"], x["_g"].cast("bigint")).alias("g"),
            F.array_append(acc["p"], x["_p"].cast("bigint")).alias("p"),
            F.array_append(acc["acc"], x).alias("acc")))

    taken = F.when(F.size("_l") == 1, F.col("_l")).otherwise(F.aggregate("_l", init, step)["acc"])
    return (clusters.select(*k, "label", F.explode(taken).alias("_x"))
            .select(*k, "label", "_x._row.*").select(*cands.columns))


def outcomes(gold: DataFrame, pred: DataFrame, matched: DataFrame,
             keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """J12 + U5: TP / BOUNDARY for matched pairs, FN_PURE for unmatched gold,
    FP_PURE for unmatched predictions.

    Columns: keys, type, gold_label, pred_label, gold_start, gold_end,
    pred_start, pred_end, g_ord, p_ord.

    One grouping per entity instead of two anti joins: an entity's own row and the row
    that its match contributes meet, so the matches are read once.
    """
    k = list(keys)
    pair = "struct<p_ord:bigint,p_start:int,p_end:int>"

    def own(df: DataFrame, side: str) -> DataFrame:
        return df.select(*k, F.lit(side).alias("side"), F.col("ord").cast("bigint").alias("ord"), "label",
                         F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                         F.lit(False).alias("used"), F.lit(None).cast(pair).alias("pair"))

    sides = F.array(
        F.struct(F.lit("g").alias("side"), F.col("g_ord").cast("bigint").alias("ord"),
                 F.struct(F.col("p_ord").cast("bigint").alias("p_ord"), F.col("p_start").cast("int").alias("p_start"),
                          F.col("p_end").cast("int").alias("p_end")).alias("pair")),
        F.struct(F.lit("p").alias("side"), F.col("p_ord").cast("bigint").alias("ord"),
                 F.lit(None).cast(pair).alias("pair")))
    used = (matched.select(*k, F.explode(sides).alias("_s"))
            .select(*k, "_s.side", "_s.ord", F.lit(None).cast("string").alias("label"),
                    F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
                    F.lit(True).alias("used"), F.col("_s.pair").alias("pair")))
    met = (own(gold, "g").unionByName(own(pred, "p")).unionByName(used)
           .groupBy(*k, "side", "ord")
           .agg(F.max("label").alias("label"), F.max("start").alias("start"), F.max("end").alias("end"),
                F.max("used").alias("used"), F.max("pair").alias("pair")))
    met = met.where((F.col("side") == "g") | ~F.col("used"))
    is_g, hit = F.col("side") == "g", F.col("pair").isNotNull()
    exact = (F.col("pair.p_start") == F.col("start")) & (F.col("pair.p_end") == F.col("end"))
    return met.select(
        *k, F.when(~is_g, F.lit("FP_PURE")).when(~hit, F.lit("FN_PURE"))
        .when(exact, F.lit("TP")).otherwise(F.lit("BOUNDARY")).alias("type"),
        F.when(is_g, F.col("label")).otherwise(F.lit("O")).alias("gold_label"),
        F.when(is_g & ~hit, F.lit("O")).otherwise(F.col("label")).alias("pred_label"),
        F.when(is_g, F.col("start")).alias("gold_start"), F.when(is_g, F.col("end")).alias("gold_end"),
        F.when(is_g, F.col("pair.p_start")).otherwise(F.col("start")).alias("pred_start"),
        F.when(is_g, F.col("pair.p_end")).otherwise(F.col("end")).alias("pred_end"),
        F.when(is_g, F.col("ord")).alias("g_ord"),
        F.when(is_g, F.col("pair.p_ord")).otherwise(F.col("ord")).alias("p_ord"))


def strict_outcomes(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("doc_id",)
                    ) -> DataFrame:
    """M7 core: overlap join -> greedy match -> outcome per entity.  With
    ``keys=("doc_id", "model")`` several prediction sets are evaluated at once."""
    matched = greedy_match(overlap_pairs(gold, pred, keys), keys)
    return outcomes(gold, pred, matched, keys)


def per_model(gold: DataFrame, models: list[str]) -> DataFrame:
    """Gold entities once for every model (``model`` column)."""
    return gold.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def truncated(pred: DataFrame, limits: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Predictions a single window would give: those that end by ``limits.last_char``
    (the end of the last token kept); documents without a limit have none."""
    return pred.join(limits, doc_col).where(F.col("end") <= F.col("last_char")).drop("last_char")


def errors_with_text(out: DataFrame, docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Error rows (no TP) with gold/pred surface text."""
    e = out.where(F.col("type") != "TP")
    d = docs.select(doc_col, F.col("text").alias("_t"))
    return (e.join(d, doc_col, "inner")
            .withColumn("gold_text", F.when(F.col("gold_start").isNotNull(),
                                            text_slice("_t", "gold_start", "gold_end")))
            .withColumn("pred_text", F.when(F.col("pred_start").isNotNull(),
                                            text_slice("_t", "pred_start", "pred_end")))
            .drop("_t"))


def _outcome_label():
    return F.when(F.col("type") == "FP_PURE", F.col("pred_label")).otherwise(F.col("gold_label"))


def error_counts(out: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A12 + U3: TP / BOUNDARY / FN_PURE / FP_PURE per label (every label that
    has any outcome, including boundary-only labels)."""
    return out.groupBy(*keys, _outcome_label().alias("label")).agg(
        F.count_if(F.col("type") == "TP").alias("tp"),
        F.count_if(F.col("type") == "BOUNDARY").alias("boundary_errors"),
        F.count_if(F.col("type") == "FN_PURE").alias("fn_pure"),
        F.count_if(F.col("type") == "FP_PURE").alias("fp_pure"))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """Strict P/R/F1, boundary errors in both denominators, 0 when undefined."""
    fp_total = F.col("fp_pure") + F.col("boundary_errors")
    fn_total = F.col("fn_pure") + F.col("boundary_errors")
    p = safe_div(F.col("tp"), F.col("tp") + fp_total)
    r = safe_div(F.col("tp"), F.col("tp") + fn_total)
    f1 = F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
    return c.select(*[x for x in c.columns if x not in ("tp", "boundary_errors", "fn_pure",
                                                       "fp_pure")],
                    F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                    F.round(f1, 4).alias("f1"), "tp", "fp_pure", "fn_pure", "boundary_errors",
                    fp_total.alias("fp_total"), fn_total.alias("fn_total"))


def strict_metrics(out: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return metrics_from_counts(error_counts(out, keys))


def strict_micro(out: DataFrame) -> DataFrame:
    """Per-label and overall (label 'ALL') strict metrics in one rollup."""
    c = out.withColumn("label", _outcome_label()).rollup("label").agg(
        F.count_if(F.col("type") == "TP").alias("tp"),
        F.count_if(F.col("type") == "BOUNDARY").alias("boundary_errors"),
        F.count_if(F.col("type") == "FN_PURE").alias("fn_pure"),
        F.count_if(F.col("type") == "FP_PURE").alias("fp_pure"),
        F.grouping("label").alias("_total"))
    c = c.withColumn("label", F.when(F.col("_total") == 1, F.lit("ALL")).otherwise(F.col("label")))
    return metrics_from_counts(c.drop("_total"))


def error_summary(out: DataFrame) -> DataFrame:
    """Errors by type, and by (type, label) -- one grouping-sets pass.

    ``label`` is the gold label for FN_PURE/BOUNDARY and the predicted label
    for FP_PURE; the by-type rows have ``label = 'ALL'``.
    """
    e = out.where(F.col("type") != "TP").withColumn("label", _outcome_label())
    s = e.groupingSets([["type"], ["type", "label"]], "type", "label").agg(
        F.grouping("label").alias("_all"), F.count("*").alias("n"))
    return s.select("type", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("label")).alias("label"), "n")


def error_rate_by_doc(out: DataFrame, gold_rows: DataFrame, docs: DataFrame,
                      doc_col: str = "doc_id") -> DataFrame:
    """A16 + J14: (FN_PURE + FP_PURE) / gold rows per document with gold rows,
    document length and category; documents without errors rate 0."""
    g = gold_rows.groupBy(doc_col).agg(F.count("*").alias("n_gold"))
    e = out.groupBy(doc_col).agg(
        F.count_if(F.col("type").isin("FN_PURE", "FP_PURE")).alias("n_errors"))
    d = docs.select(doc_col, F.length("text").cast("long").alias("length"))
    j = g.join(d, doc_col, "inner").join(e, doc_col, "left")
    rate = F.coalesce("n_errors", F.lit(0)).cast("double") / F.col("n_gold").cast("double")
    return j.select(doc_col, "length", F.round(rate, 6).alias("error_rate"),
                    length_category("length").alias("category"))


def error_rate_by_category(by_doc: DataFrame) -> DataFrame:
    """Mean error rate per length category."""
    return by_doc.groupBy("category").agg(F.round(F.avg("error_rate"), 6).alias("mean_error_rate"),
                                          F.count("*").alias("n_docs"))


def confusion(out: DataFrame, spark: SparkSession, with_tp: bool = False) -> DataFrame:
    """Gold x predicted label counts over the five fixed labels, from
    the error rows (diagonal = BOUNDARY); ``with_tp`` adds TP to the diagonal."""
    labels = schemas.CONFUSION_LABELS
    e = out if with_tp else out.where(F.col("type") != "TP")
    counts = e.groupBy("gold_label").pivot("pred_label", labels).count()
    all_rows = spark.createDataFrame([(x,) for x in labels], "gold_label string")
    j = all_rows.join(counts, "gold_label", "left")
    return j.select("gold_label", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
                                    for x in labels])


def boundary_examples(errors: DataFrame, n: int = 5, doc_col: str = "doc_id") -> DataFrame:
    """The first ``n`` boundary errors in (document, gold start) order."""
    return (errors.where(F.col("type") == "BOUNDARY")
            .orderBy(doc_col, "gold_start", "pred_start").limit(n))


# ---- sequence (token BIO) evaluation -----------------------------------------

def seq_eval(pairs: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk"),
             preds: dict[str, str] | None = None, name: str = "model") -> DataFrame:
    """Seqeval-style overall P/R/F1 and token accuracy.

    ``pairs`` has one row per scored position: keys, ``j``, ``gold_tag`` and a column
    of predicted tags (``pred_tag``), or one per system: ``preds`` maps a system to its
    column and gives a row each, named in ``name``.  Ignored positions are dropped
    before (F3).  Entities are decoded per window and counted correct when (window,
    label, start, end) agree.

    With arrays in those columns a row is a window, its positions in order (``j``, an array too,
    where positions repeat): it is counted in its row and only counts are shuffled.

    With a row per position: one pass, all columns are decoded in the same windows, a
    window's own counts ride on its first position, and one grouping by
    (window, label, start, end) tells which sides have an entity.
    """
    k = list(keys)
    systems = list((preds or {"": "pred_tag"}).items())
    if isinstance(pairs.schema["gold_tag"].dataType, T.ArrayType):
        return _seq_metrics(_window_totals(pairs, [c for _, c in systems]), systems, bool(preds), name)
    tags = {"gold": "gold_tag"} | {f"p{n}": c for n, (_, c) in enumerate(systems)}
    w = Window.partitionBy(*k).orderBy("j")
    whole = Window.partitionBy(*k)
    f = pairs.select(*k, "j", *dict.fromkeys(tags.values()))
    from spanlab.operators.bio import start_flag
    for side, c in tags.items():
        f = f.withColumn(f"_f_{side}", start_flag(F.col(c), F.lag(c).over(w)).cast("int"))
    f = f.withColumn("_first", F.row_number().over(w) == 1)
    for side in tags:
        f = f.withColumn(f"_g_{side}", F.sum(f"_f_{side}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.sum((F.col("gold_tag") == F.col(c)).cast("long")).over(whole).alias(f"_same_{side}")
            for side, c in tags.items() if side != "gold"]
    f = f.select("*", F.count("*").over(whole).alias("_n"), *same)

    def item(side, keep, label, grp, n, equal):
        return F.when(keep, F.struct(
            F.lit(side).alias("side"), label.alias("label"), grp.cast("long").alias("grp"),
            n.cast("long").alias("n"), F.array(*equal).cast("array<bigint>").alias("same")))

    none = F.lit(None)
    items = [item(side, F.col(c) != "O", F.substring(c, 3, 1 << 30), F.col(f"_g_{side}"), none,
                  [none] * len(systems)) for side, c in tags.items()]
    items.append(item("window", F.col("_first"), F.lit(""), F.lit(0), F.col("_n"),
                      [F.col(f"_same_{side}") for side in tags if side != "gold"]))
    rows = f.select(*k, "j", F.explode(F.array(*items)).alias("_x")).where(F.col("_x").isNotNull())
    entities = rows.groupBy(*k, "_x.side", "_x.grp", "_x.label").agg(
        F.min("j").alias("start_j"), F.max("j").alias("end_j"), F.max("_x.n").alias("n"), F.max("_x.same").alias("same"))
    agreed = entities.groupBy(*k, "label", "start_j", "end_j").agg(
        F.max("n").alias("n"), F.max("same").alias("same"),
        *[F.max((F.col("side") == side).cast("int")).alias(side) for side in tags])
    totals = agreed.agg(
        F.count("n").alias("n_chunks"), F.sum("n").alias("n"), F.sum("gold").alias("gold"),
        *[x for n, _ in enumerate(systems) for x in (
            F.sum(F.col("same")[n]).alias(f"same{n}"), F.sum(f"p{n}").alias(f"pred{n}"),
            F.sum(F.col("gold") * F.col(f"p{n}")).alias(f"ok{n}"))])
    return _seq_metrics(totals, systems, bool(preds), name)


def _window_totals(windows: DataFrame, columns: list[str]) -> DataFrame:
    from spanlab.operators.documents import sequence_counts
    kind = T.ArrayType(T.LongType())

    def run(gold, places, *preds):
        return sequence_counts(gold, places, list(preds))

    places = F.col("j") if "j" in windows.columns else F.transform("gold_tag", lambda x, j: j)
    counts = F.arrow_udf(run, kind)(F.col("gold_tag"), places, *[F.col(c) for c in columns])
    c = windows.select(counts.alias("_c"))
    names = ["n", "gold"] + [f"{x}{n}" for n in range(len(columns)) for x in ("same", "pred", "ok")]
    return c.agg(F.count("*").alias("n_chunks"), *[F.sum(F.col("_c")[k]).alias(x) for k, x in enumerate(names)])


def _seq_metrics(totals: DataFrame, systems: list[tuple[str, str]], preds: bool, name: str) -> DataFrame:
    """Metrics of every system from (n_chunks, n, gold) and its (same, pred, ok)."""
    each = totals.select("n_chunks", "n", F.coalesce("gold", F.lit(0)).alias("n_gold"), F.explode(F.array(*[
        F.struct(F.lit(system).alias("system"), F.coalesce(f"same{n}", F.lit(0)).alias("same"),
                 F.coalesce(f"pred{n}", F.lit(0)).alias("n_pred"), F.coalesce(f"ok{n}", F.lit(0)).alias("n_correct"))
        for n, (system, _) in enumerate(systems)])).alias("_s"))
    each = each.select("n_chunks", "n", "n_gold", "_s.*").where("n_chunks > 0")
    p = safe_div(F.col("n_correct"), F.col("n_pred"))
    r = safe_div(F.col("n_correct"), F.col("n_gold"))
    f1 = F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
    return each.select(*([F.col("system").alias(name)] if preds else []),
                       F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"),
                       F.round(F.col("same") / F.col("n"), 6).alias("accuracy"), "n_chunks", "n_gold", "n_pred", "n_correct")


def model_compare(results: DataFrame, models: DataFrame) -> DataFrame:
    """J13 + M6: every listed model with its scores; a model without results
    keeps null scores (a failed run), ``optimized`` flags the variant.  Best F1 first."""
    r = results.select("model", F.col("precision").alias("seqeval_precision"),
                       F.col("recall").alias("seqeval_recall"), F.col("f1").alias("seqeval_f1"),
                       "n_chunks")
    return (models.join(r, "model", "left")
            .withColumn("optimized", F.lower("model").contains("optimized"))
            .orderBy(F.desc_nulls_last("seqeval_f1"), "model"))  # W10: a row per model


def model_gain(results: DataFrame) -> DataFrame:
    """Optimised vs baseline family, mean F1 and gain in points."""
    opt = F.lower("model").contains("optimized")
    return results.agg(
        F.count_if(~opt).alias("n_baseline"), F.count_if(opt).alias("n_optimized"),
        F.round(F.avg(F.when(~opt, F.col("f1"))), 6).alias("f1_baseline"),
        F.round(F.avg(F.when(opt, F.col("f1"))), 6).alias("f1_optimized"),
        F.round((F.avg(F.when(opt, F.col("f1"))) - F.avg(F.when(~opt, F.col("f1")))) * 100, 4)
        .alias("gain_points"))
