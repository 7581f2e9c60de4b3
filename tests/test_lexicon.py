"""Lexicon linking (FX3) and similarity laws."""

import pytest
from pyspark.sql import functions as F

from spanlab.functions.text import similarity
from spanlab.operators import lexicon as lx

LEX = [
    ("morphologie", "carcinome canalaire infiltrant", "8500/3", 1),
    ("morphologie", "adénocarcinome", "8140/3", 2),
    ("topographie", "sein", "C50.9", 3),
    ("topographie", "quadrant supéro-externe", "C50.4", 4),
    ("differenciation", "bien différencié", "G1", 5),
    ("expression_CIM", "Carcinome du sein", "8010/3-C50.9", 6),
    ("morphologie", "carcinome canalaire infiltrant", "8500/9", 0),  # Q3: two codes
    ("morphologie", "carcinome lobulaire", "8520/3", 7),             # Q4 tie partner
    ("morphologie", "carcinome lobulairx", "8520/9", 8),
]


@pytest.fixture(scope="module")
def idx(spark):
    lex = spark.createDataFrame(LEX, "label string, content string, code string, ordinal long")
    return lx.index(lex)


def link_one(spark, idx, text, label, fuzzy=True, t=0.8):
    m = spark.createDataFrame([(1, text, label, "keep")], "id long, text string, label string, extra string")
    return lx.link(m, idx, fuzzy=fuzzy, threshold=t).first()


def test_exact_case_blank_and_bio_prefix(spark, idx):
    assert link_one(spark, idx, "carcinome canalaire infiltrant", "morphologie").code == "8500/9"
    assert link_one(spark, idx, "CARCINOME Canalaire Infiltrant", "B-morphologie").code == "8500/9"
    assert link_one(spark, idx, "  sein \t", "I-topographie").code == "C50.9"
    r = link_one(spark, idx, "adénocarcinome", "morphologie")
    assert (r.code, r.match, r.extra) == ("8140/3", "exact", "keep")


def test_expression_cim_links(spark, idx):  # Q1 fixed
    assert link_one(spark, idx, "carcinome du sein", "expression_CIM").code == "8010/3-C50.9"


def test_wrong_label_unknown_and_fuzzy_off(spark, idx):
    assert link_one(spark, idx, "sein", "morphologie", fuzzy=False).code is None
    assert link_one(spark, idx, "xyz", "morphologie").code is None
    assert link_one(spark, idx, "adenocarcinome", "morphologie", fuzzy=False).code is None


def test_fuzzy_typo_and_threshold(spark, idx):
    r = link_one(spark, idx, "carcinome canalaire infiltran", "morphologie")
    assert (r.code, r.match) == ("8500/9", "fuzzy")
    assert link_one(spark, idx, "adenocarcinome.", "morphologie").code == "8140/3"
    assert link_one(spark, idx, "carcinome canalaire", "morphologie", t=0.99).code is None


def test_fuzzy_tie_breaks_on_content(spark, idx):  # Q4
    r = link_one(spark, idx, "carcinome lobulairy", "morphologie")
    assert r.code == "8520/3"  # 'carcinome lobulaire' < 'carcinome lobulairx'


def test_similarity_laws(spark):
    df = spark.createDataFrame([("abc", "abc"), ("", "abc"), ("", ""), ("kitten", "sitting"),
                                ("sitting", "kitten")], "a string, b string")
    r = [x.s for x in df.select(similarity("a", "b").alias("s")).collect()]
    assert r[0] == 1.0 and r[1] == 0.0 and r[2] == 1.0
    assert 0.0 <= r[3] < 1.0 and r[3] == r[4]


def test_stats(spark):
    lex = spark.createDataFrame(LEX, "label string, content string, code string, ordinal long")
    st = {r.label: r for r in lx.stats(lex).collect()}
    assert set(st) == {"morphologie", "topographie", "differenciation", "expression_CIM"}
    assert all(r.n_unique_codes > 0 and r.n_unique_expressions > 0 for r in st.values())


def test_fuzzy_matches_brute_force(spark, idx):
    import random
    rnd = random.Random(7)
    words = [c for _, c, _, _ in LEX]
    rows = []
    for k in range(60):
        w = list(rnd.choice(words).lower())
        for _ in range(rnd.randint(0, 3)):
            p = rnd.randrange(len(w))
            w[p] = rnd.choice("abcdexyz")
        rows.append((k, "".join(w), rnd.choice(["morphologie", "topographie"])))
    m = spark.createDataFrame(rows, "id long, text string, label string")
    got = {r.id: r.code for r in lx.link(m, idx, threshold=0.7).collect()}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, cb in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
        return d[len(b)]
    index = {}
    for lab, c, code, o in sorted(LEX, key=lambda x: (x[3], x[2])):
        index.setdefault((lab.lower(), c.lower()), code)
    for k, text, lab in rows:
        exact = index.get((lab, text))
        if exact:
            assert got[k] == exact
            continue
        best = None
        for (l2, c), code in index.items():
            if l2 != lab:
                continue
            mx = max(len(text), len(c))
            s = 1.0 if mx == 0 else 1.0 - lev(text, c) / mx
            if s >= 0.7 and s > 0 and (best is None or (-s, c) < (-best[0], best[1])):
                best = (s, c, code)
        assert got[k] == (best[2] if best else None), (text, lab)


@pytest.mark.parametrize("t", [0.5, 0.8, 0.9])
def test_passjoin_equals_length_band(spark, t):
    import random
    rnd = random.Random(int(t * 100))
    alphabet = "abcde "
    lex = [("l", "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 18))), f"c{k}", k)
           for k in range(150)]
    idx = lx.index(spark.createDataFrame(lex, "label string, content string, code string, ordinal long"))
    ms = []
    for k in range(120):
        w = list(rnd.choice(lex)[1])
        for _ in range(rnd.randint(0, 4)):
            op = rnd.randrange(3)
            p = rnd.randrange(len(w) + 1)
            if op == 0:
                w.insert(p, rnd.choice(alphabet))
            elif op == 1 and p < len(w):
                del w[p]
            elif p < len(w):
                w[p] = rnd.choice(alphabet)
        ms.append((k, "".join(w).strip() or "a", "l"))
    m = lx.mention_keys(spark.createDataFrame(ms, "id long, text string, label string"))
    a = {(r.content_key, r.lex_key) for r in lx.fuzzy_candidates(m, idx, t, "passjoin").collect()}
    b = {(r.content_key, r.lex_key) for r in lx.fuzzy_candidates(m, idx, t, "length").collect()}
    assert a == b and len(b) > 0


def test_probe_rows_of_long_mentions(spark):
    k = spark.createDataFrame([("l", "x" * n, n) for n in (10, 40, 80)], "label_key string, m_key string, m_len int")
    n = {r.m_len: r["count"] for r in lx.mention_probes(k, 0.8).groupBy("m_len").count().collect()}
    assert n[80] <= 21_973 / 5 and n[40] <= 3_074 / 3


def test_threshold_zero_needs_some_similarity(spark, idx):
    r = link_one(spark, idx, "s", "topographie", t=0.0)
    assert (r.code, r.match) == ("C50.9", "fuzzy")
    assert link_one(spark, idx, "0000", "topographie", t=0.0).code is None
    assert "BroadcastNestedLoopJoin" not in lx.fuzzy_candidates(lx.mention_keys(
        spark.createDataFrame([("s", "topographie")], "text string, label string")), idx, 0.0
    )._jdf.queryExecution().executedPlan().toString()
