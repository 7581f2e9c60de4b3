"""Stratified splits: shares per label, cover, ties and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanlab.operators import stratify as st

LABELS = ["p", "q", "r", "s"]


def shares(given, n_labels):
    return [[sum(g[k] for m, g in given.items() if m >> b & 1) for k in range(3)] for b in range(n_labels)]


@pytest.mark.parametrize("seed", range(40))
def test_every_label_meets_its_share_where_masks_can_be_exchanged(seed):
    rng = random.Random(seed)
    counts = {m: rng.choice([1, 2, 7, 40, 900]) for m in range(16) if rng.random() < 0.95}
    given = st.plan(counts, 4, (80, 10, 10))
    assert {m: sum(g) for m, g in given.items()} == counts and min(min(g) for g in given.values()) >= 0
    for b, got in enumerate(shares(given, 4)):
        want = st.apportion(sum(c for m, c in counts.items() if m >> b & 1), (80, 10, 10))
        assert all(abs(x - y) <= 1 for x, y in zip(got, want)), (b, got, want)


def test_labels_that_always_come_together_share_one_decision():
    given = st.plan({0b11: 7, 0b100: 1, 0: 12}, 3, (80, 10, 10))
    assert shares(given, 3) == [st.apportion(7, (80, 10, 10))] * 2 + [[1, 0, 0]]
    assert [sum(g[k] for g in given.values()) for k in range(3)] == [16, 2, 2]


def test_apportion_is_whole_and_breaks_ties_early():
    assert st.apportion(5, (80, 10, 10)) == [4, 1, 0]
    assert st.apportion(0, (1, 1)) == [0, 0]
    assert all(sum(st.apportion(n, (7, 2, 2))) == n for n in range(200))


def test_documents_are_covered_once_and_rare_labels_reach_every_split(spark):
    rng = random.Random(5)
    rows = []
    for d in range(400):
        rows += [(f"d{d}", x, "extra") for x in LABELS if rng.random() < {"p": 0.9, "q": 0.5, "r": 0.2, "s": 0.05}[x]] or [(f"d{d}", None, "")]
    rows += [("d0", "p", "again")] * 500 + [(None, "s", ""), ("d1", "unknown", "")]
    df = spark.createDataFrame(rows, "doc_name string, label string, split string").repartition(5)
    parts = st.stratified_split_docs(df, LABELS)
    got = parts.collect()
    assert sorted(r.doc_name for r in got) == sorted({r[0] for r in rows if r[0]})
    again = st.stratified_split_docs(df.repartition(2), LABELS).collect()
    assert sorted(got) == sorted(again)
    n = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert abs(n["train"] - 320) <= 4 and n["val"] > 0 and n["test"] > 0
    for x in LABELS:
        total = len({r[0] for r in rows if r[1] == x and r[0]})
        have = {r.split: r.n_docs for r in st.label_shares(df, parts, LABELS).where(F.col("label") == x).collect()}
        want = dict(zip(("train", "val", "test"), st.apportion(total, (80, 10, 10))))
        assert all(abs(have[s] - want[s]) <= 1 for s in want), (x, have, want)


def test_empty_tables_and_wrong_arguments(spark):
    empty = spark.createDataFrame([], "doc_name string, label string")
    assert st.stratified_split_docs(empty, LABELS).count() == 0
    with pytest.raises(ValueError):
        st.stratified_split_docs(empty, [str(k) for k in range(17)])
    with pytest.raises(ValueError):
        st.stratified_split_docs(empty, LABELS, weights=(1, 1))
