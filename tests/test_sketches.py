"""Mergeable profiles: exact parts, bounded errors, batches added one by one, odd rows."""

import random

import pytest

from spanlab.operators import sketches as sk


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(f"d{rng.randrange(9000)}", "hot" if rng.random() < 0.8 else "cold", "x" * rng.randrange(1, 200), k)
            for k in range(40000)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_name string, label string, content string, n int")


def test_estimates_are_close_and_counts_exact(spark, rows):
    got = {r.label: r for r in sk.profile(sk.states(table(spark, rows).repartition(6))).collect()}
    for label in ("hot", "cold"):
        of = [r for r in rows if r[1] == label]
        lengths = sorted(len(r[2]) for r in of)
        assert got[label].n == len(of) and got[label].avg_length == round(sum(lengths) / len(of), 6)
        assert abs(got[label].n_documents / len({r[0] for r in of}) - 1) < 0.04
        for q, name in ((0.5, "q50"), (0.9, "q90")):
            at = getattr(got[label], name)
            assert sum(x < at for x in lengths) / len(of) < q + 0.02 and sum(x <= at for x in lengths) / len(of) > q - 0.02


def test_batches_add_up_to_a_full_rebuild_and_replays_change_nothing(spark, rows, tmp_dir):
    path = f"{tmp_dir}/states"
    for b in range(4):
        sk.add_batch(table(spark, rows[b::4]), path, f"0{b}")
    once = sk.load(spark, path)
    assert {r.batch for r in once.select("batch").distinct().collect()} == {"00", "01", "02", "03"}
    whole = {r.label: r for r in sk.profile(sk.states(table(spark, rows))).collect()}

    def same():
        got = {r.label: r for r in sk.profile(sk.load(spark, path)).collect()}
        assert got.keys() == whole.keys()
        for label, r in whole.items():
            assert (got[label].n, got[label].avg_length, got[label].n_documents) == (r.n, r.avg_length, r.n_documents)
    same()
    sk.add_batch(table(spark, rows[1::4]), path, "01")
    same()
    (everything,) = sk.profile(sk.load(spark, path), keys=()).collect()
    assert everything.n == len(rows) and abs(everything.n_documents / len({r[0] for r in rows}) - 1) < 0.04


def test_odd_rows(spark):
    df = table(spark, [(None, "a", None, 1), ("d", "a", "", 1), ("d", "a", "", 1), (None, "b", None, 2), ("e", None, "é" * 3, 3)])
    got = {r.label: r for r in sk.profile(sk.states(df)).collect()}
    assert (got["a"].n, got["a"].avg_length, got["a"].n_documents, got["a"].q50) == (3, 0.0, 1, 0)
    assert (got["b"].n, got["b"].avg_length, got["b"].n_documents, got["b"].q50) == (1, None, 0, None)
    assert (got[None].avg_length, got[None].q90) == (3.0, 3)
    assert sk.profile(sk.states(df.where("n > 9"))).count() == 0
