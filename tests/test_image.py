"""The annotation image and its cleaning: short cuts give what the plain forms give."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from spanlab.functions import text as tx
from spanlab.operators import corpus
from spanlab.plans import testviews as tv


def test_words_hashed_at_once():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé漢x😀") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    words += ["", "a" * 53, "a" * 54, "a" * 55, "a" * 200]
    for salt in (b"g", b"h"):
        plain = tv._buckets([w.encode() + salt for w in words]).tolist()
        assert tv._word_buckets(pa.array(words), salt).tolist() == plain
        assert tv._word_buckets(pa.array(words).slice(3, 50), salt).tolist() == plain[3:53]
    assert not len(tv._word_buckets(pa.array([], pa.string()), b"g"))


def test_trim_and_envelope_without_patterns(spark):
    cells = [None, "", " ", "a", "\t 1 2;3 4  ", "1 2;", ";1 2", "1\t2", "5", " x　y\r\n", "1 2 \n", "x 9", "1  2"]
    df = spark.createDataFrame([(c,) for c in cells], "full_span string")
    parts = F.split(F.regexp_replace("full_span", tx.TRIM, ""), r"[; \t]+")
    start, end = tx.span_envelope("full_span")
    rows = df.select(tx.trim_ws("full_span").alias("a"), F.regexp_replace("full_span", tx.TRIM, "").alias("b"),
                     start.alias("s"), F.try_element_at(parts, F.lit(1)).try_cast("int").alias("s0"),
                     end.alias("e"), F.try_element_at(parts, F.lit(-1)).try_cast("int").alias("e0")).collect()
    assert all((r.a, r.s, r.e) == (r.b, r.s0, r.e0) for r in rows)
    image = df.select(F.lit("d").alias("doc_name"), F.lit("l").alias("label"), F.lit("c").alias("code"),
                      F.col("full_span").alias("content"), "full_span")
    plan = corpus.clean(image)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan
