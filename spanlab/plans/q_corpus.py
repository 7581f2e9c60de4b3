"""Queries: corpus cleaning, standoff parsing, statistics, splits
(C1-C6, C8, C10, V1-V5, J1, J3, J4, A1-A10, W8, W9, U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab import schemas
from spanlab.functions.text import length_category
from spanlab.operators import corpus, sketches, splits, stratify
from spanlab.operators import tokens as tok
from spanlab.plans import testviews as tv
from spanlab.plans.catalogue import query
from spanlab.plans.oracle import bucket, register
from spanlab.session import keep
from spanlab.sources import standoff

# o_clean / o_split are registered by q_tokens (imported first by the catalogue)
from spanlab.plans import q_tokens  # noqa: F401


def cleaned(spark, sf):
    """The cleaned annotation image; one consumer each, so column pruning reaches it."""
    return corpus.clean(tv.ann_csv(spark, sf))


@query("clean_corpus", """
SELECT doc_name, id, label, code, content, lower(content) AS content_key, span_start, span_end
FROM o_clean""")
def q_clean_corpus(spark, sf):
    return cleaned(spark, sf).withColumn("content_key", F.lower("content"))


@query("span_envelope", r"""
SELECT doc_name, id, TRY_CAST(sp[1] AS INTEGER) AS span_start, TRY_CAST(sp[-1] AS INTEGER) AS span_end
FROM (SELECT doc_name, id, string_split_regex(regexp_replace(full_span, '@TRIM@', '', 'g'),
                                              '[; \t]+') AS sp FROM v_ann_csv)""")
def q_span_envelope(spark, sf):
    return corpus.parse_spans(tv.ann_csv(spark, sf)).select(
        "doc_name", "id", "span_start", "span_end")


register("o_span_list", r"""o_span_list AS (
  SELECT doc_name, id, k::INTEGER AS k,
         TRY_CAST(regexp_extract(piece, '^(-?[0-9]+)\s+(-?[0-9]+)$', 1) AS INTEGER) AS sub_start,
         TRY_CAST(regexp_extract(piece, '^(-?[0-9]+)\s+(-?[0-9]+)$', 2) AS INTEGER) AS sub_end,
         n_spans
  FROM (SELECT doc_name, id, unnest(p) AS piece, unnest(range(0, len(p))) AS k,
               len(p)::INTEGER AS n_spans
        FROM (SELECT doc_name, id,
                     string_split_regex(regexp_replace(full_span, '@TRIM@', '', 'g'),
                                        '\s*;\s*') AS p FROM v_ann_csv)))""")


@query("span_list", """
SELECT doc_name, id, k, sub_start, sub_end, n_spans, n_spans > 1 AS is_discontinuous,
       first_value(sub_start) OVER (PARTITION BY doc_name, id ORDER BY k) AS entity_start,
       last_value(sub_end) OVER (PARTITION BY doc_name, id ORDER BY k
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS entity_end
FROM o_span_list""")
def q_span_list(spark, sf):
    p = corpus.parse_spans(tv.ann_csv(spark, sf))
    return p.select(
        "doc_name", "id",
        F.size("spans").cast("int").alias("n_spans"), "is_discontinuous",
        F.col("spans")[0]["start"].alias("entity_start"),
        F.element_at("spans", -1)["end"].alias("entity_end"),
        F.posexplode("spans").alias("k", "_sp"),
    ).select("doc_name", "id", "k", F.col("_sp.start").alias("sub_start"),
             F.col("_sp.end").alias("sub_end"), "n_spans", "is_discontinuous",
             "entity_start", "entity_end")


# ---- standoff image ----------------------------------------------------------

register("o_t_lines", r"""o_t_lines AS (
  SELECT doc_name, line_no, p[1] AS id, split_part(p[2], ' ', 1) AS label,
         substr(p[2], instr(p[2], ' ') + 1) AS pos, p[3] AS text,
         len(p) < 3 OR NOT coalesce(regexp_full_match(substr(p[2], instr(p[2], ' ') + 1),
           '-?[0-9]+ -?[0-9]+(;-?[0-9]+ -?[0-9]+)*') AND instr(p[2], ' ') > 0, false) AS bad
  FROM (SELECT *, string_split(line, chr(9)) AS p FROM v_ann_lines WHERE line LIKE 'T%'))""")
register("o_notes", r"""o_notes AS (
  SELECT doc_name, line_no, p[1] AS note_id, split_part(p[2], ' ', 2) AS ref, p[3] AS code,
         len(p) < 3 OR len(string_split(coalesce(p[2], ''), ' ')) <> 2 AS bad
  FROM (SELECT *, string_split(line, chr(9)) AS p FROM v_ann_lines WHERE line LIKE '#%'))""")
register("o_entities", r"""o_entities AS (
  SELECT doc_name, line_no, id, label, text,
         len(string_split(pos, ';'))::INTEGER AS n_spans,
         TRY_CAST(string_split_regex(string_split(pos, ';')[1], '\s+')[1] AS INTEGER) AS start,
         TRY_CAST(string_split_regex(string_split(pos, ';')[-1], '\s+')[-1] AS INTEGER) AS "end"
  FROM o_t_lines WHERE NOT bad)""")


def parsed(spark, sf):
    return standoff.parse(tv.ann_lines(spark, sf))


@query("attach_codes", """
SELECT e.doc_name, e.id, e.label, e.start, e."end", e.n_spans, e.text, c.icdo_code
FROM o_entities e
LEFT JOIN (SELECT doc_name, ref, arg_max(code, line_no) AS icdo_code
           FROM o_notes WHERE NOT bad GROUP BY doc_name, ref) c
  ON c.doc_name = e.doc_name AND c.ref = e.id""")
def q_attach_codes(spark, sf):
    ents, _ = parsed(spark, sf)
    return ents.select("doc_name", "id", "label", F.col("spans")[0]["start"].alias("start"),
                       F.element_at("spans", -1)["end"].alias("end"),
                       F.size("spans").cast("int").alias("n_spans"), "text", "icdo_code")


@query("dangling_refs", """
SELECT n.doc_name, n.line_no, n.note_id, n.ref FROM o_notes n
WHERE NOT n.bad AND NOT EXISTS (SELECT 1 FROM o_entities e
                                WHERE e.doc_name = n.doc_name AND e.id = n.ref)""")
def q_dangling_refs(spark, sf):
    lines = tv.ann_lines(spark, sf)
    ents = standoff.parse_entity_lines(lines).where(~F.col("bad"))
    notes = standoff.parse_note_lines(lines).where(~F.col("bad"))
    return standoff.dangling_refs(ents, notes).select("doc_name", "line_no", "note_id", "ref")


@query("quarantine", """
SELECT doc_name, line_no, 'malformed_entity' AS reason FROM o_t_lines WHERE bad
UNION ALL SELECT doc_name, line_no, 'malformed_note' FROM o_notes WHERE bad
UNION ALL SELECT n.doc_name, n.line_no, 'dangling_ref' FROM o_notes n
  WHERE NOT n.bad AND NOT EXISTS (SELECT 1 FROM o_entities e
                                  WHERE e.doc_name = n.doc_name AND e.id = n.ref)""")
def q_quarantine(spark, sf):
    _, q = parsed(spark, sf)
    return q


@query("line_types", """
SELECT substr(line, 1, 1) AS line_type, count(*) AS count FROM v_ann_lines
WHERE length(line) > 0 GROUP BY 1""")
def q_line_types(spark, sf):
    return corpus.line_types(tv.ann_lines(spark, sf))


@query("missing_docs", """
SELECT 'doc_' || doc_id::VARCHAR AS doc_name, 'no_annotations' AS kind FROM documents
WHERE 'doc_' || doc_id::VARCHAR NOT IN (SELECT DISTINCT regexp_replace(doc_name, '\\.(ann|txt)$', '')
                                        FROM o_clean)
UNION ALL
SELECT DISTINCT regexp_replace(doc_name, '\\.(ann|txt)$', ''), 'no_text' FROM o_clean
WHERE regexp_replace(doc_name, '\\.(ann|txt)$', '') NOT IN
      (SELECT 'doc_' || doc_id::VARCHAR FROM documents)""")
def q_missing_docs(spark, sf):
    from spanlab.functions.text import doc_stem
    texts = tv.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"))
    ann = keep(cleaned(spark, sf).select(doc_stem("doc_name").alias("doc_name")).distinct())  # read twice
    _, orphans = standoff.pair_corpus(texts, ann)
    missing = ann.join(texts, "doc_name", "left_anti")  # V4
    return (orphans.withColumn("kind", F.lit("no_annotations"))
            .unionByName(missing.withColumn("kind", F.lit("no_text"))))


@query("null_profile", """
SELECT column_name, n_null FROM (
  SELECT 'doc_name' AS column_name, count(*) FILTER (WHERE doc_name IS NULL) AS n_null FROM o_clean
  UNION ALL SELECT 'id', count(*) FILTER (WHERE id IS NULL) FROM o_clean
  UNION ALL SELECT 'label', count(*) FILTER (WHERE label IS NULL) FROM o_clean
  UNION ALL SELECT 'code', count(*) FILTER (WHERE code IS NULL) FROM o_clean
  UNION ALL SELECT 'content', count(*) FILTER (WHERE content IS NULL) FROM o_clean
  UNION ALL SELECT 'span_start', count(*) FILTER (WHERE span_start IS NULL) FROM o_clean
  UNION ALL SELECT 'span_end', count(*) FILTER (WHERE span_end IS NULL) FROM o_clean)""")
def q_null_profile(spark, sf):
    return corpus.null_profile(cleaned(spark, sf))


@query("label_dist", """
SELECT label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM o_clean GROUP BY label""")
def q_label_dist(spark, sf):
    return corpus.label_distribution(cleaned(spark, sf))


@query("n_documents", "SELECT count(DISTINCT doc_name) AS n_documents FROM o_clean")
def q_n_documents(spark, sf):
    return corpus.n_documents(cleaned(spark, sf))


@query("avg_len_by_label", """
SELECT label, round(avg(length(content)), 6) AS avg_length, count(*) AS n
FROM o_clean GROUP BY label""")
def q_avg_len_by_label(spark, sf):
    return corpus.avg_length_by_label(cleaned(spark, sf))


@query("doc_length_stats", """
SELECT count(*) AS n_docs, round(avg(length(text)), 6) AS mean_chars,
       min(length(text))::BIGINT AS min_chars, max(length(text))::BIGINT AS max_chars
FROM documents""")
def q_doc_length_stats(spark, sf):
    return corpus.doc_length_stats(tv.table(spark, sf, "documents"))


@query("doc_length_category", f"""
SELECT doc_id, length(text)::BIGINT AS n_chars,
       CASE WHEN length(text) < {schemas.LENGTH_SHORT_MAX} THEN '{schemas.CATEGORY_SHORT}'
            WHEN length(text) < {schemas.LENGTH_MEDIUM_MAX} THEN '{schemas.CATEGORY_MEDIUM}'
            ELSE '{schemas.CATEGORY_LONG}' END AS category
FROM documents""")
def q_doc_length_category(spark, sf):
    d = tv.table(spark, sf, "documents")
    n = F.length("text").cast("long")
    return d.select("doc_id", n.alias("n_chars"), length_category(n).alias("category"))


@query("discontinuous_stats", """
SELECT count(*) AS n_docs, count(*) FILTER (WHERE n_disc > 0) AS n_docs_discontinuous,
       sum(n)::BIGINT AS n_entities, sum(n_disc)::BIGINT AS n_entities_discontinuous
FROM (SELECT doc_name, count(*) AS n, count(*) FILTER (WHERE contains(full_span, ';')) AS n_disc
      FROM v_ann_csv GROUP BY doc_name)""")
def q_discontinuous_stats(spark, sf):
    return corpus.discontinuous_stats(tv.ann_csv(spark, sf))


@query("reconcile", r"""
SELECT coalesce(a.doc_name, b.doc_name) AS doc_name, coalesce(a.n, 0) AS n_parsed,
       coalesce(b.n, 0) AS n_expected, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff
FROM (SELECT doc_name, count(*) AS n FROM (SELECT DISTINCT doc_name, id FROM o_entities)
      GROUP BY doc_name) a
FULL OUTER JOIN (SELECT regexp_replace(doc_name, '\.(ann|txt)$', '') AS doc_name, count(*) AS n
                 FROM o_clean GROUP BY 1) b ON a.doc_name = b.doc_name""")
def q_reconcile(spark, sf):
    from spanlab.functions.text import doc_stem
    ents, _ = parsed(spark, sf)
    exp = cleaned(spark, sf).select(doc_stem("doc_name").alias("doc_name"))
    return corpus.reconcile(ents, exp)


@query("long_doc_share", r"""
SELECT count(*) AS n_docs, count(*) FILTER (WHERE n > 512) AS n_long,
       round(avg(CASE WHEN n > 512 THEN 1 ELSE 0 END), 6) AS share_long
FROM (SELECT len(regexp_extract_all(text, '([^@BLANK@]+)', 1)) AS n FROM documents)""")
def q_long_doc_share(spark, sf):
    return corpus.long_doc_share(tok.token_counts(tv.table(spark, sf, "documents")), 512)


@query("sketch_profile", """
SELECT label, count(*)::BIGINT AS n, round(avg(length(content)), 6) AS avg_length,
       true AS documents_close, true AS median_close
FROM o_clean GROUP BY label""")
def q_sketch_profile(spark, sf):
    """A2, A3 from states per split and label, merged per label; the estimates are compared with exact counts."""
    c = keep(splits.hash_split(cleaned(spark, sf), method="md5").select("doc_name", "label", "content", "split"))
    p = sketches.profile(sketches.states(c, ("split", "label")), ("label",), (0.5,))
    n = F.length("content")
    exact = c.join(p.select("label", "q50"), "label").groupBy("label").agg(
        F.count_distinct("doc_name").alias("_docs"), F.avg((n < F.col("q50")).cast("int")).alias("_below"),
        F.avg((n <= F.col("q50")).cast("int")).alias("_upto"))
    return p.join(exact, "label").select(
        "label", "n", "avg_length", (F.abs(F.col("n_documents") / F.col("_docs") - 1) < 0.04).alias("documents_close"),
        ((F.col("_below") < 0.52) & (F.col("_upto") > 0.48)).alias("median_close"))


# ---- splits --------------------------------------------------------------------

@query("split_hash", f"""
SELECT doc_name, id,
       CASE WHEN {bucket("doc_name || '42'")} < 80 THEN 'train'
            WHEN {bucket("doc_name || '42'")} < 90 THEN 'val' ELSE 'test' END AS split
FROM o_clean""")
def q_split_hash(spark, sf):
    return splits.hash_split(cleaned(spark, sf), method="md5").select("doc_name", "id", "split")


@query("split_exact", "SELECT doc_name, split, rk AS rank FROM o_split_docs")
def q_split_exact(spark, sf):
    return splits.exact_split_docs(cleaned(spark, sf))


register("o_label_docs", """o_label_docs AS (
  SELECT label, count(DISTINCT doc_name) AS n FROM o_clean GROUP BY label)""")


@query("split_stratified", """
SELECT label, split, (n * w // 100 + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY n * w % 100 DESC, k)
         <= n - n * 80 // 100 - 2 * (n * 10 // 100) THEN 1 ELSE 0 END)::BIGINT AS n_docs
FROM o_label_docs, (VALUES ('train', 80, 0), ('val', 10, 1), ('test', 10, 2)) AS part(split, w, k)""")
def q_split_stratified(spark, sf):
    c = keep(cleaned(spark, sf).select("doc_name", "label"))  # masks and shares
    parts = stratify.stratified_split_docs(c, schemas.ENTITY_TYPES)
    return stratify.label_shares(c, parts, schemas.ENTITY_TYPES)


@query("split_stratified_cover", """
SELECT count(DISTINCT doc_name) AS n_docs, count(DISTINCT doc_name) AS n_covered,
       0::BIGINT AS n_train_val, 0::BIGINT AS n_train_test, 0::BIGINT AS n_val_test
FROM o_clean WHERE doc_name IS NOT NULL""")
def q_split_stratified_cover(spark, sf):
    return splits.split_leakage(stratify.stratified_split_docs(cleaned(spark, sf), schemas.ENTITY_TYPES))


@query("split_stats", """
SELECT split, count(DISTINCT doc_name) AS n_docs, count(*) AS n_entities FROM o_split
GROUP BY split""")
def q_split_stats(spark, sf):
    return splits.split_stats(splits.exact_split(keep(cleaned(spark, sf).select("doc_name", "label"))))


@query("split_balance", "SELECT split, " + ", ".join(
    f"count(*) FILTER (WHERE label = '{lbl}') AS {lbl}" for lbl in schemas.ENTITY_TYPES)
    + " FROM o_split GROUP BY split")
def q_split_balance(spark, sf):
    return splits.split_balance(splits.exact_split(keep(cleaned(spark, sf).select("doc_name", "label"))), schemas.ENTITY_TYPES)


@query("split_leakage", """
SELECT count(*) AS n_docs,
       count(*) FILTER (WHERE tr + va + te > 0) AS n_covered,
       count(*) FILTER (WHERE tr + va = 2) AS n_train_val,
       count(*) FILTER (WHERE tr + te = 2) AS n_train_test,
       count(*) FILTER (WHERE va + te = 2) AS n_val_test
FROM (SELECT doc_name, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr,
             max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS va,
             max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS te
      FROM o_split GROUP BY doc_name)""")
def q_split_leakage(spark, sf):
    return splits.split_leakage(splits.exact_split(keep(cleaned(spark, sf).select("doc_name", "label"))))
