"""Annotation rows: cleaning, spans, validation, statistics, splits (FX1)."""

from pyspark.sql import functions as F

from spanlab.operators import corpus, splits
from spanlab.sources import tables

ROWS = [
    ("doc1.ann", "T1", "morphologie", "8010/3", "carcinome infiltrant", "0 9"),
    ("doc1.ann", "T2", "topographie", "C50.9", "sein gauche", "0 9;20 31"),
    ("doc2.ann", "T1", "differenciation", "G2", "moyennement différencié", "12 35"),
    ("doc2.ann", "T2", "expression_CIM", "8010/3-C50.9", "carcinome du sein", "40 57"),
    ("doc3.ann", "T1", "morphologie", "8500/3", "carcinome canalaire", "5 24"),
    ("doc3.ann", "T2", "topographie", "C50.4", "quadrant supéro-externe", "30 53"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_name string, id string, label string, code string,"
                                       " content string, full_span string")


def test_clean_shape_and_types(spark):
    c = corpus.clean(frame(spark))
    assert c.count() == 6
    assert c.columns == ["doc_name", "id", "label", "code", "content", "span_start", "span_end"]
    types = dict(c.dtypes)
    assert types["span_start"] == "int" and types["span_end"] == "int"


def test_discontinuous_span_envelope(spark):
    c = corpus.clean(frame(spark)).where("doc_name = 'doc1.ann'").orderBy("id").collect()
    assert (c[0].span_start, c[0].span_end) == (0, 9)
    assert (c[1].span_start, c[1].span_end) == (0, 31)


def test_whitespace_trim_and_bad_spans_quarantined(spark):
    rows = [("\tdoc9.ann ", "T1", "  morphologie\t", " 8000/3 ", "\n tumeur \t", " 3 9\t"),
            ("doc9.ann", "T2", "topographie", "C1", "x", "a b"),
            (None, "T3", "topographie", "C1", "y", "1 2"),
            ("doc9.ann", "T4", "topographie", "C1", "z", "9 3")]
    valid, bad = corpus.split_valid(corpus.clean(frame(spark, rows)))
    v = valid.collect()
    assert len(v) == 1
    assert (v[0].doc_name, v[0].label, v[0].code, v[0].content) == \
        ("doc9.ann", "morphologie", "8000/3", "tumeur")
    assert (v[0].span_start, v[0].span_end) == (3, 9)
    reasons = {r.id: r.reject_reason for r in bad.collect()}
    assert reasons == {"T2": "bad_span", "T3": "no_doc", "T4": "bad_range"}


def test_span_list(spark):
    p = corpus.parse_spans(frame(spark)).where("id = 'T2' and doc_name = 'doc1.ann'").first()
    assert [(s.start, s.end) for s in p.spans] == [(0, 9), (20, 31)]
    assert p.is_discontinuous


def test_statistics(spark):
    c = corpus.clean(frame(spark))
    dist = {r.label: (r["count"], r.share) for r in corpus.label_distribution(c).collect()}
    assert dist["morphologie"] == (2, round(2 / 6, 6))
    assert corpus.n_documents(c).first().n_documents == 3
    nulls = {r.column_name: r.n_null for r in corpus.null_profile(c).collect()}
    assert all(v == 0 for v in nulls.values())
    avg = {r.label: r.avg_length for r in corpus.avg_length_by_label(c).collect()}
    assert avg["topographie"] == round((len("sein gauche") + len("quadrant supéro-externe")) / 2, 6)


def _many(spark, n_docs=200):
    rows = [(f"d{i}.ann", f"T{k}", "morphologie", "c", "x", "0 1")
            for i in range(n_docs) for k in range(2)]
    return corpus.clean(frame(spark, rows))


def test_hash_split_no_leakage_cover_reproducible(spark):
    df = _many(spark)
    for method in ("xxhash64", "md5"):
        s = splits.hash_split(df, method=method)
        leak = splits.split_leakage(s).first()
        assert leak.n_docs == 200 and leak.n_covered == 200
        assert leak.n_train_val == leak.n_train_test == leak.n_val_test == 0
        a = sorted(s.select("doc_name", "split").distinct().collect())
        b = sorted(splits.hash_split(df, method=method).select("doc_name", "split").distinct().collect())
        assert a == b


def test_exact_split_counts(spark):
    df = _many(spark, 101)
    d = splits.exact_split_docs(df)
    counts = {r.split: r["count"] for r in d.groupBy("split").count().collect()}
    assert counts == {"train": int(101 * 0.8), "val": int(101 * 0.1),
                      "test": 101 - int(101 * 0.8) - int(101 * 0.1)}
    ranks = sorted(r["rank"] for r in d.collect())
    assert ranks == list(range(1, 102))
    s = splits.exact_split(df)
    assert s.count() == df.count()
    stats = {r.split: r.n_docs for r in splits.split_stats(s).collect()}
    assert sum(stats.values()) == 101


def test_parquet_round_trip_partitioned(spark, tmp_dir):
    df = splits.exact_split(corpus.clean(frame(spark)))
    path = f"{tmp_dir}/splits"
    tables.write_splits(df, path)
    back = tables.read_split(spark, path)
    assert back.count() == 6
    train = tables.read_split(spark, path, "train")
    plan = train._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1]
    assert filters.startswith("isnotnull(split") and "= train" in filters.split("]")[0]
    assert train.count() == df.where("split = 'train'").count()


def test_read_annotation_csv(spark, tmp_dir):
    path = f"{tmp_dir}/ann.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("doc_name,id,label,code,content,full_span\n")
        f.write('doc1.ann,T1,morphologie,8010/3,"carcinome, ""infiltrant""",0 9\n')
        f.write("doc1.ann,T2,topographie,C50.9,sein,0 9;20 31\n")
    df = tables.read_annotation_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["string"] * 6
    rows = df.orderBy("id").collect()
    assert rows[0].content == 'carcinome, "infiltrant"'
    c = corpus.clean(df).orderBy("id").collect()
    assert (c[1].span_start, c[1].span_end) == (0, 31)


def test_csv_rows_with_wrong_cells_are_rejected(spark, tmp_dir):
    path = f"{tmp_dir}/bad.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("doc_name,id,label,code,content,full_span\n")
        f.write("d.ann,T1,morphologie,8000/3,x,0 1\nd.ann,T2,morphologie,8000/3,x,0 1,extra\nd.ann,T3,short\n")
    assert [r.id for r in tables.read_annotation_csv(spark, path).collect()] == ["T1"]
    assert [r.doc_name for r in tables.read_annotation_csv(spark, path).select("doc_name").collect()] == ["d.ann"]
    rejected = tables.rejected_csv_lines(spark, path)
    assert sorted(r.line.split(",")[1] for r in rejected.collect()) == ["T2", "T3"]
    assert rejected.select("line").count() == 2


def test_csv_line_breaks_in_cells(spark, tmp_dir):
    path = f"{tmp_dir}/multi.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('doc_name,id,label,code,content,full_span\nd.ann,T1,morphologie,c,"two\nlines",0 1\n')
    assert [r.content for r in tables.read_annotation_csv(spark, path, multi_line=True).collect()] == ["two\nlines"]


def test_hash_split_honours_uneven_ratios(spark):
    df = spark.range(20000).select(F.concat(F.lit("d"), F.col("id")).alias("doc_name"))
    for train, val in ((0.805, 0.1), (0.57, 0.335)):
        n = {r.split: r["count"] for r in splits.hash_split(df, train_ratio=train, val_ratio=val, method="md5")
             .groupBy("split").count().collect()}
        assert abs(n["train"] / 20000 - train) < 0.01 and abs(n["val"] / 20000 - val) < 0.01
    at = lambda r: {x.doc_name for x in splits.hash_split(df, train_ratio=r, val_ratio=0.1).where(
        "split = 'train'").collect()}
    assert at(0.57) > at(0.56)
    nulls = spark.createDataFrame([(None,), ("d",)], "doc_name string")
    assert [r.split is None for r in splits.hash_split(nulls).orderBy("doc_name").collect()] == [True, False]


def test_csv_and_json_sinks(spark, tmp_dir):
    df = corpus.parse_spans(frame(spark))
    tables.write_csv(df, f"{tmp_dir}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/csv")
    assert back.count() == 6 and "spans" in back.columns
    tables.write_json(df.select("doc_name", "spans"), f"{tmp_dir}/json")
    assert spark.read.json(f"{tmp_dir}/json").count() == 6


def test_discontinuous_and_reconcile(spark):
    ann = frame(spark)
    st = corpus.discontinuous_stats(ann).first()
    assert (st.n_docs_discontinuous, st.n_entities_discontinuous) == (1, 1)
    parsed = ann.where("id = 'T1'")
    r = {x.doc_name: x.diff for x in corpus.reconcile(parsed, ann).collect()}
    assert r == {"doc1.ann": -1, "doc2.ann": -1, "doc3.ann": -1}
