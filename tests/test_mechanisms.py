"""Failure isolation, the phrase automaton on batches and streams, and label drift."""

import datetime as dt
import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanlab.operators import annotate as an, automaton as am, benchmark as bm, bio, lexicon as lx
from spanlab.operators import tokens as tok
from spanlab.sources import tables
from spanlab.streaming import drift

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module

# ---- several models, some of which fail


def eye(label):
    return lambda: lambda batch: [np.eye(9)[[label] * len(words)].reshape(-1, 9) for words in batch]


def failing_on(word):
    def make():
        whole = eye(1)()

        def predict(batch):
            for words in batch:
                if word in words:
                    raise ValueError(f"no {word} please")
            return whole(batch)
        return predict
    return make


def no_weights():
    raise OSError("no weights")


def windows(spark, texts):
    tokens = tok.tokenize(tables.texts_frame(spark, texts))
    tags = tokens.withColumn("tag", F.when(F.col("i") % 3 == 0, "B-morphologie").otherwise("O")).withColumn("span_ord", F.lit(0))
    return tok.window_arrays(bio.window_labels(tags, 8, 3), label_col="label_id")


def test_a_failing_model_does_not_stop_the_others(spark):
    w = windows(spark, [f"a b c d e f {i} g h i j" for i in range(30)] + ["x bad y"])
    n = w.count()
    rows = {r.model: r for r in bm.benchmark_models(w, {
        "plain": eye(1), "quiet_optimized": eye(0), "picky": failing_on("bad"), "absent": no_weights,
        "short": lambda: lambda batch: [np.zeros((0, 9)) for _ in batch]}).collect()}
    assert rows["plain"].status == "ok" and rows["plain"].reason is None and rows["plain"].seqeval_recall > 0
    assert rows["quiet_optimized"].optimized and rows["quiet_optimized"].seqeval_f1 == 0.0
    assert (rows["picky"].status, rows["picky"].n_failed, rows["picky"].reason) == ("failed", 1, "ValueError: no bad please")
    assert (rows["absent"].n_failed, rows["absent"].reason) == (n, "OSError: no weights")
    assert (rows["short"].n_failed, rows["short"].reason) == (n, "ValueError: the model returned a wrong number of rows")
    assert all(rows[m].seqeval_f1 is None and rows[m].n_chunks is None for m in ("picky", "absent", "short"))
    assert {r.n_windows for r in rows.values()} == {n}


def test_only_the_failing_windows_lose_their_scores(spark):
    w = windows(spark, ["a b c"] * 20 + ["bad"] + ["d e f g"] * 20)
    rows = bm.model_scores(w, {"m": failing_on("bad")}).collect()
    assert sum(r.error_0 is not None for r in rows) == 1
    assert all((r.ids_0 is None) == (r.error_0 is not None) and (r.error_0 or len(r.ids_0) == len(r.labels)) for r in rows)


def test_results_of_one_model_alone_are_the_same(spark):
    w = windows(spark, ["a b c d e", "f g", "bad"])
    both = {r.model: r for r in bm.benchmark_models(w, {"a": eye(1), "b": failing_on("bad")}).collect()}
    alone = bm.benchmark_models(w, {"a": eye(1)}).first()
    assert tuple(both["a"]) == tuple(alone)


# ---- phrase automaton


def naive_spans(words, phrases):
    out, i = [], 0
    while i < len(words):
        best = max((len(p) for p in phrases if words[i:i + len(p)] == list(p)), default=0)
        if best:
            out.append((i, best, min(label for p, label in phrases.items() if words[i:i + best] == list(p))))
        i += best or 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_automaton_against_a_walk(seed):
    rnd = random.Random(seed)
    phrases = {tuple(rnd.choice("abc") for _ in range(rnd.randint(1, 7))): rnd.choice("xyz") for _ in range(rnd.randint(1, 25))}
    auto = am.PhraseAutomaton.of([(list(p), label) for p, label in phrases.items()])
    lists = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 40))] for _ in range(20)] + [[], ["a"]]
    import pyarrow as pa
    got = auto.spans(pa.array(lists, pa.list_(pa.string()))).to_pylist()
    assert [[(x["i"], x["n"], x["label"]) for x in row] for row in got] == [naive_spans(words, phrases) for words in lists]
    words = lists[0]
    every = sorted((i, len(p), label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p)] == list(p))
    found = auto.matches([auto.words.get(w, 0) for w in words])
    assert sorted((i, n, auto.labels[k]) for i, n, k in found) == every


def test_equal_phrases_take_the_smallest_label():
    auto = am.PhraseAutomaton.of([(["a", "b"], "z"), (["a", "b"], "k"), (["b"], "q"), ([], "e")])
    assert [(i, n, auto.labels[k]) for i, n, k in auto.tags([auto.words["a"], auto.words["b"]])] == [(0, 2, "k")]


LEXICON = [("morphologie", "tumeur de grade deux", "9001/1"), ("topographie", "Foie", "D10.1"), ("topographie", "lobe du foie", "D10.2"),
           ("differenciation", "peu  marqué", "H2"), ("morphologie", "grade", "9009/9"), ("vide", "   ", "0"), ("expression_CIM", "É\u00a0net", "E1")]
DOCS = ["Tumeur de grade deux , lobe du FOIE peu marqué .", "", " \t ", None, "grade grade Foie\u00a0foie\n lobe du foi",
        "rien", "é net tumeur de grade trois", "x " * 3000 + "foie"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "label string, content string, code string")


def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)] + [(None, "foie")], "doc_id long, text string")


def test_array_tags_are_those_of_the_join(spark, lexicon):
    known = docs(spark).where("doc_id is not null and text is not null")
    want = an.lexicon_tag(tok.tokenize(known), an.phrases(lexicon)).collect()
    got = am.tag_documents(known, am.automaton(lexicon)).collect()
    key = lambda r: (r.doc_id, r.i, r.s, r.e, r.w, r.tag, r.score)
    assert sorted(map(key, got)) == sorted(map(key, want))


def entity(r):
    return (-1 if r.doc_id is None else r.doc_id, r.start, r.end, r.label, r.score, r.text, r.icdo_code or "", r.match or "")


def test_exact_entities_are_those_of_the_pipeline(spark, lexicon):
    known = docs(spark).where("doc_id is not null")
    idx = lx.index(lexicon, ordinal_col=None)
    want = an.entity_rows(known, an.lexicon_scorer(an.phrases(lexicon)), idx, fuzzy=False).collect()
    got = am.exact_entities(known, am.automaton(lexicon), idx).collect()
    assert got and sorted(map(entity, got)) == sorted(map(entity, want))
    assert am.exact_entities(known, am.automaton(lexicon)).where("icdo_code is not null").count() == 0


def test_no_shuffle_but_the_link(spark, lexicon):
    plan = am.exact_entities(docs(spark), am.automaton(lexicon))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_stream_appends_the_entities_of_the_batch(spark, lexicon, tmp_path):
    d, auto, idx = docs(spark), am.automaton(lexicon), lx.index(lexicon, ordinal_col=None)
    for n in range(3):
        d.where(F.coalesce("doc_id", F.lit(0)) % 3 == n).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = am.annotate_stream_exact(stream, auto, idx)
    q = (out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet"))
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(entity, got)) == sorted(map(entity, am.exact_entities(d, auto, idx).collect()))
    with pytest.raises(ValueError):
        am.annotate_stream_exact(d, auto, idx)


def test_dealt_phrases_give_what_one_automaton_gives(spark, lexicon):
    more = lexicon.union(spark.createDataFrame([(f"l{i % 3}", f"grade grade foie x{i}", str(i)) for i in range(40)], lexicon.schema))
    idx = lx.index(more, ordinal_col=None)
    auto, table = am.automaton(more), am.fitted(more, max_bytes=10)  # was TooLarge at any such size
    assert isinstance(table, type(lexicon)) and isinstance(am.fitted(more), am.PhraseAutomaton)
    key = lambda r: (r.doc_id is None, r.doc_id, r.i, r.s, r.e, r.w, r.tag, r.score)
    d = docs(spark).union(docs(spark).where("doc_id > 4"))
    assert sorted(map(key, am.tag_documents(d, table).collect())) == sorted(map(key, am.tag_documents(d, auto).collect()))
    want = sorted(map(entity, am.exact_entities(d, auto, idx).collect()))
    assert want and sorted(map(entity, am.exact_entities(d, table, idx).collect())) == want
    small = am.dealt_spans(d, table, ["doc_id"], part_bytes=8).collect()
    one = am.phrase_spans(d, auto, ["doc_id"]).collect()
    assert sorted(map(str, small)) == sorted(map(str, one))


def test_a_phrase_is_dealt_to_the_parts_that_hold_its_first_words():
    import pyarrow as pa
    kind = pa.list_(pa.string())
    texts = am.heads(pa.array([["a", "b", "c", "d"], [], None, ["b"], ["a", "a", "a", "a"]], kind)).to_pylist()
    phrases = am.head(pa.array([["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "x"], ["b"], ["c", "a"], ["a", "a", "a"]], kind)).to_pylist()
    assert [[k in set(t) for k in phrases] for t in texts] == [
        [True, True, True, True, True, False, False], [False] * 7, [False] * 7,
        [False, False, False, False, True, False, False], [True, False, False, False, False, False, True]]
    assert [len(t) for t in texts] == [9, 0, 0, 1, 3]


def test_size_of_the_phrases_is_checked(lexicon, spark):
    with pytest.raises(am.TooLarge):
        am.automaton(lexicon, max_bytes=10)
    nothing = am.automaton(lexicon.limit(0))
    assert am.exact_entities(docs(spark), nothing).count() == 0


# ---- label drift

T0 = dt.datetime(2031, 5, 1)


def labelled(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=h), l) for h, l in rows], "ts timestamp, label string")


def jsd(p, q):
    names = set(p) | set(q)
    half = lambda a, b: sum(a.get(x, 0) * math.log2(2 * a[x] / (a[x] + b.get(x, 0))) for x in names if a.get(x, 0))
    return (half(p, q) + half(q, p)) / 2


def test_drift_against_plain_python(spark):
    rnd = random.Random(2)
    rows = [(rnd.uniform(0, 72), rnd.choice("aaabbcdn")) for _ in range(800)] + [(1, None), (80, "a"), (81, "a")]
    reference = drift.reference_shares(labelled(spark, [(0, x) for x in "aaabbcd"] + [(0, None)]))
    assert reference == {"a": 3 / 7, "b": 2 / 7, "c": 1 / 7, "d": 1 / 7}
    got = {r.window_start: r for r in drift.label_drift(labelled(spark, rows), reference, window="12 hours").collect()}
    by = {}
    for h, l in rows:
        if l:
            by.setdefault(T0 + dt.timedelta(hours=12 * int(h // 12)), []).append(l)
    assert set(got) == set(by)
    for start, labels in by.items():
        p = {x: labels.count(x) / len(labels) for x in "abcd"} | {"": labels.count("n") / len(labels)}
        r = got[start]
        assert (r.n, r.n_new) == (len(labels), labels.count("n"))
        assert r.divergence == pytest.approx(jsd(p, reference), abs=1e-9)
        assert abs(r["shift"]) == pytest.approx(max(abs(p[x] - reference.get(x, 0)) for x in p), abs=1e-9)
    assert got[T0 + dt.timedelta(hours=72)].shifted == "a" and got[T0 + dt.timedelta(hours=72)]["shift"] == pytest.approx(4 / 7)


def test_late_rows_are_dropped_on_the_stream(spark, tmp_path):
    reference = {"a": 0.5, "b": 0.5}
    batches = [[(1, "a"), (2, "b"), (13, "a")], [(40, "a")], [(3, "b"), (30, "b"), (41, "b")], [(90, "a")], [(91, "a")]]
    stream_dir = tmp_path / "in"
    schema = "ts timestamp, label string"
    out = []
    for n, rows in enumerate(batches):
        labelled(spark, rows).coalesce(1).write.mode("append").parquet(str(stream_dir))
        stream = spark.readStream.schema(schema).parquet(str(stream_dir))
        q = (drift.label_drift(stream, reference, window="12 hours", lateness="6 hours").writeStream.outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
             .start(str(tmp_path / "out"), format="parquet"))
        q.awaitTermination(180)
    out = {r.window_start: (r.n, round(r.divergence, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.window_start: (r.n, round(r.divergence, 9)) for r in drift.label_drift(
        labelled(spark, [x for b in batches for x in b]), reference, window="12 hours").collect()}
    at = lambda h: T0 + dt.timedelta(hours=h)
    # hour 3 came when the watermark stood at hour 34: dropped; hour 30 was behind it, in a closed window
    assert out[at(0)] == (2, 0.0) and batch[at(0)][0] == 3
    assert out[at(12)] == (1, round(jsd({"a": 1.0}, reference), 9)) == batch[at(12)]
    assert out[at(36)] == batch[at(36)] == (2, 0.0)
    assert at(84) not in out  # still open


def test_drift_needs_a_reference_and_a_lateness(spark):
    with pytest.raises(ValueError):
        drift.label_drift(labelled(spark, [(1, "a")]), {})
    assert drift.label_drift(labelled(spark, []), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        drift.reference_shares(spark.range(drift.MAX_LABELS + 5).select(F.col("id").cast("string").alias("label")))
