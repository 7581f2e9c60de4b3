"""Row-local document operators against the token-table operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlab.operators import bio, documents as dc, evaluate as ev, tokens as tok
from spanlab.plans import testviews as tv

LONG = " ".join(f"w{k % 37}" for k in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, "a b  c"), (2, "a b  c"), (3, None), (4, ""), (None, "x y z " * 5), (5, "été " + LONG)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(1, 2, 0, 5, "A"), (1, 1, 3, 12, "B"), (1, 3, 100, 400, "A"), (2, 1, 0, 3, "A"), (5, 1, 4, 9, "C"), (6, 1, 0, 4, "A")]
    return spark.createDataFrame(rows, "doc_id long, ord long, start int, end int, label string")


def rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


def no_token_sort(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" not in plan and "Generate explode" in plan


def tagger():
    def tags(keys, t):  # not a name of this module: workers cannot import it
        gold = tv.gold_codes(t)
        return {"gold": gold, "m1": tv.pred_codes(keys, t, gold, "m1", 20, True)}
    return tags


def test_decode_equals_token_table(docs):
    table = tv.sides_of(tv.gold_tags_of(tok.tokenize(docs)))
    want = bio.decode_columns(table, {"gold": ("tag", None), "m1": ("tag_m1", "score_m1")})
    got = dc.decode(docs, tagger())
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))
    assert no_token_sort(got)


def test_decode_text_equals_join(docs):
    table = tv.gold_tags_of(tok.tokenize(docs))
    want = bio.with_text(bio.decode(table, score_col=None), docs)
    got = dc.decode(docs, lambda keys, t: {"gold": tv.gold_codes(t)}, text=True).drop("side", "score")
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))


def test_align_equals_token_table(docs, spans):
    want = bio.align(tok.tokenize(docs), spans)
    got = dc.align(docs, spans)
    assert rows(got) == rows(want, *got.columns)
    assert no_token_sort(got)


@pytest.mark.parametrize("stride", [0, 3])
def test_windows_and_sequence_counts_equal_token_table(docs, spans, stride):
    al = bio.align(tv.sides_of(tv.gold_tags_of(tok.tokenize(docs))).drop("tag"), spans)
    wl = bio.window_labels(al, 8, stride, 0)
    want = wl.groupBy("doc_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("j", "s", "e", "w", "tag"))).alias("x"), F.count_if("overlap").alias("n_overlap"))

    def extra(keys, t, at, chunk):
        return {"tag_m1": tv.pred_codes(keys, t, tv.gold_codes(t), "m1", 20).take(at)}

    got = dc.labelled_windows(docs, spans, 8, stride, 0, extra, ("tag_m1",))
    flat = got.select("doc_id", "chunk", F.transform(F.arrays_zip("j", "tokens", "tags"), lambda x: F.struct(
        x["j"], x["tokens"]["s"], x["tokens"]["e"], x["tokens"]["w"], x["tags"].alias("tag"))).alias("x"), "n_overlap")
    plain = lambda df: sorted((str(r.doc_id), r.chunk, [tuple(x) for x in r.x], r.n_overlap) for r in df.collect())
    assert plain(flat) == plain(want)
    by_window = ev.seq_eval(got.withColumnRenamed("tags", "gold_tag"), preds={"m1": "tag_m1"})
    by_place = ev.seq_eval(wl.withColumnRenamed("tag", "gold_tag"), preds={"m1": "tag_m1"})
    assert rows(by_window) == rows(by_place, *by_window.columns)


def test_pieces_are_cut_in_bounded_parts(monkeypatch):
    texts = pa.array(["a b", None, "", "c " * 50, "d"] * 7)
    whole = tok.pieces(texts).to_pylist()
    sizes, cut = [], tok._pieces_of
    monkeypatch.setattr(tok, "CUT_BYTES", 60)
    monkeypatch.setattr(tok, "_pieces_of", lambda x: sizes.append(sum(len(t or "") for t in x.to_pylist())) or cut(x))
    assert tok.pieces(texts).to_pylist() == whole
    assert len(sizes) > 5 and max(sizes) <= 160


def test_arrow_batches_are_bounded(spark):
    from spanlab.session import ARROW_ROWS, configure
    own = spark.newSession()
    configure(own)
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    configure(own)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"


@pytest.mark.parametrize("stride", [0, 3])
def test_scored_documents_equal_token_table(docs, stride):
    from spanlab.operators.scoring import model_scorer, score_documents

    def model():
        import numpy as np
        return lambda batch: [np.eye(9)[[len(w) % 9 for w in words]].reshape(-1, 9) for words in batch]

    want = model_scorer(model, 8, stride)(tok.tokenize(docs))
    got = score_documents(docs, model, 8, stride)
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [doc_id")[0]


def strict_by_table(docs, models, most_tokens=None):
    """The outcomes from entity tables, a side per model."""
    ents = dc.decode(docs, tv.sides(models))
    gold = ev.per_model(ents.where("side = 'gold'").drop("side"), [m for m, _ in models])
    pred = ents.where("side <> 'gold'").withColumnRenamed("side", "model")
    if most_tokens is not None:
        limits = tok.truncate(tok.tokenize(docs), most_tokens, 0).groupBy("doc_id").agg(F.max("e").alias("last_char"))
        pred = ev.truncated(pred, limits)
    return ev.strict_outcomes(gold, pred, ("doc_id", "model")).withColumnRenamed("model", "side")


@pytest.mark.parametrize("most_tokens", [None, 9])
def test_outcomes_equal_entity_tables(spark, docs, most_tokens):
    words = " ".join(f"w{k * k % 97}" for k in range(900))
    more = spark.createDataFrame([(7, words), (8, words[1:]), (8, "w" + words), (8, LONG), (None, words)], docs.schema)
    all_docs = docs.union(more)
    want = strict_by_table(all_docs, tv.MODELS, most_tokens)
    got = dc.outcomes(all_docs, tv.sides(tv.MODELS), most_tokens)
    assert most_tokens or {r.type for r in got.select("type").distinct().collect()} == set(dc.OUTCOMES)
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))
    assert dict(got.dtypes) == dict(want.dtypes)
    # documents are the only rows that are shuffled
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("seed", range(20))
def test_greedy_pairs_against_one_by_one(seed):
    import numpy as np
    rng = np.random.default_rng(seed)

    def spans(n):
        doc, start = rng.integers(0, 3, n), rng.integers(0, 40, n)
        return dc.Spans(doc, rng.integers(0, 2, n), start, start + rng.integers(1, 12, n), rng.permutation(n))

    g, p = spans(25), spans(30)
    gi, pi, common = dc.overlaps(g, p)
    want = {(a, b): c for a in range(25) for b in range(30) if (g.doc[a], g.kind[a]) == (p.doc[b], p.kind[b])
            and (c := min(g.end[a], p.end[b]) - max(g.start[a], p.start[b])) > 0}
    assert dict(zip(zip(gi.tolist(), pi.tolist()), common.tolist())) == want and len(gi) == len(want)
    used, matched = set(), np.full(30, -1)
    for a, b in sorted(want, key=lambda x: (-want[x], g.number[x[0]], p.number[x[1]])):
        if a not in used and matched[b] < 0:
            used.add(a)
            matched[b] = a
    assert dc.greedy(g, p, gi, pi, common).tolist() == matched.tolist()


def test_alignment_reads_the_documents_once(spark, tmp_path):
    """Spans decoded from the documents and the tokens they are aligned to share the documents' one shuffle."""
    from spanlab.plans import q_tokens as qt
    known = [(k, f"{LONG} word{k}") for k in range(1, 8)]
    spark.createDataFrame([*known, (None, LONG), (8, None)], "doc_id long, text string").selectExpr(
        "*", "'en' as lang").write.parquet(str(tmp_path / "documents.parquet"))
    got = qt.aligned(spark, str(tmp_path))
    tagged = {r.doc_id for r in got.collect() if r.tag != "O"}
    assert tagged <= {k for k, _ in known} and len(tagged) > 3
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_batches_are_worked_on_in_slices(monkeypatch):
    """Memory follows a slice of the texts, and the entities are those of the whole batch."""
    monkeypatch.setattr(dc, "SLICE_BYTES", 300)
    rows_ = [[LONG], [], None, ["a b"], [None], [LONG, "x y"], [LONG * 9], ["z"], [LONG]]
    texts = pa.array([None if r is None else [{"text": x} for x in r] for r in rows_], pa.list_(pa.struct([("text", pa.string())])))
    keys = pa.array(range(len(rows_)), pa.int64())
    seen = []

    def run(k, part):
        seen.append((len(part), sum(len(x["text"] or "") for row in part.to_pylist() for x in row or [])))
        return dc.entity_lists(k, part, tagger(), False)

    for first, many in ((0, len(rows_)), (3, 5), (0, 0)):
        k, part = keys.slice(first, many), texts.slice(first, many)
        assert dc.sliced(run)(k, part).to_pylist() == dc.entity_lists(k, part, tagger(), False).to_pylist()
    assert all(n <= 300 or rows == 1 for rows, n in seen) and len(seen) > 5
