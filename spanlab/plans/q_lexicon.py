"""Queries: lexicon statistics and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions.text import normalise_key, similarity
from spanlab.operators import lexicon as lx
from spanlab.plans import testviews as tv
from spanlab.plans.catalogue import query
from spanlab.plans.oracle import edits, register, register_single_bytes

THRESHOLD = 0.8

register("o_lex_index", r"""o_lex_index AS (
  SELECT lower(regexp_replace(label, '@TRIM@', '', 'g')) AS label_key,
         lower(regexp_replace(content, '@TRIM@', '', 'g')) AS content_key,
         first(regexp_replace(code, '@TRIM@', '', 'g')
               ORDER BY ordinal, regexp_replace(code, '@TRIM@', '', 'g')) AS code
  FROM v_lexicon GROUP BY 1, 2)""")
register("o_mkeys", r"""o_mkeys AS (
  SELECT mention_id, text, label,
         lower(regexp_replace(text, '@TRIM@', '', 'g')) AS content_key,
         lower(regexp_replace(regexp_replace(label, '@TRIM@', '', 'g'), '^[BI]-', '')) AS label_key
  FROM v_mentions)""")
register("o_exact", """o_exact AS (
  SELECT m.*, x.code FROM o_mkeys m
  LEFT JOIN o_lex_index x ON x.label_key = m.label_key AND x.content_key = m.content_key)""")
register_single_bytes("o_lex_bytes", "SELECT content_key AS x FROM o_mkeys UNION ALL SELECT content_key FROM o_lex_index")
register("o_fuzzy", f"""o_fuzzy AS (
  SELECT label_key, content_key, lex_key AS matched, code, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY label_key, content_key
                                 ORDER BY sim DESC, lex_key) AS rn
    FROM (SELECT m.label_key, m.content_key, x.content_key AS lex_key, x.code,
                 CASE WHEN greatest(length(m.content_key), length(x.content_key)) = 0 THEN 1.0
                      ELSE 1.0::DOUBLE - {edits('m.content_key', 'x.content_key', 'o_lex_bytes')}::DOUBLE
                           / greatest(length(m.content_key), length(x.content_key))::DOUBLE
                 END AS sim
          FROM (SELECT DISTINCT label_key, content_key FROM o_exact WHERE code IS NULL) m
          JOIN o_lex_index x ON x.label_key = m.label_key)
    WHERE sim >= {THRESHOLD} AND sim > 0)
  WHERE rn = 1)""")


def _index(spark, sf):
    return lx.index(tv.lexicon(spark, sf))


@query("lexicon_stats", r"""
SELECT label, count(DISTINCT code) AS n_unique_codes, count(DISTINCT content) AS n_unique_expressions,
       count(*) AS n_entries
FROM (SELECT DISTINCT regexp_replace(label, '@TRIM@', '', 'g') AS label,
                      lower(regexp_replace(content, '@TRIM@', '', 'g')) AS content,
                      regexp_replace(code, '@TRIM@', '', 'g') AS code FROM v_lexicon)
GROUP BY label""")
def q_lexicon_stats(spark, sf):
    return lx.stats(tv.lexicon(spark, sf))


@query("similarity", rf"""
SELECT m.mention_id,
       round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0
                  ELSE 1.0::DOUBLE - {edits('a', 'b', 'o_lex_bytes')}::DOUBLE / greatest(length(a), length(b))::DOUBLE
             END, 6) AS sim
FROM (SELECT mention_id, lower(regexp_replace(text, '@TRIM@', '', 'g')) AS a FROM v_mentions) m
JOIN (SELECT p_partkey, lower(p_name) AS b FROM part) p ON p.p_partkey = m.mention_id""")
def q_similarity(spark, sf):
    m = tv.mentions(spark, sf)
    p = tv.table(spark, sf, "part").select(F.col("p_partkey").alias("mention_id"), "p_name")
    j = m.join(p, "mention_id")
    return j.select("mention_id",
                    F.round(similarity(normalise_key("text"), F.lower("p_name")), 6).alias("sim"))


@query("link_exact", "SELECT mention_id, label_key, content_key, code FROM o_exact")
def q_link_exact(spark, sf):
    return lx.link_exact(tv.mentions(spark, sf), _index(spark, sf)).select(
        "mention_id", "label_key", "content_key", "code")


@query("link_fuzzy", """
SELECT label_key, content_key, matched, code, round(sim, 6) AS sim FROM o_fuzzy""")
def q_link_fuzzy(spark, sf):
    idx = _index(spark, sf)
    ex = lx.link_exact(tv.mentions(spark, sf), idx)
    misses = ex.where(F.col("code").isNull())
    best = lx.best_candidates(lx.fuzzy_candidates(misses, idx, THRESHOLD))
    return best.withColumn("sim", F.round("sim", 6))


@query("link_entities", """
SELECT e.mention_id, coalesce(e.code, f.code) AS code,
       CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN f.code IS NOT NULL THEN 'fuzzy' END AS match,
       round(CASE WHEN e.code IS NOT NULL THEN 1.0 ELSE f.sim END, 6) AS sim
FROM o_exact e
LEFT JOIN o_fuzzy f ON f.label_key = e.label_key AND f.content_key = e.content_key""")
def q_link_entities(spark, sf):
    out = lx.link(tv.mentions(spark, sf), _index(spark, sf), fuzzy=True, threshold=THRESHOLD)
    return out.select("mention_id", "code", "match", F.round("sim", 6).alias("sim"))
