"""DuckDB SQL for the derived views of ``testviews`` and a helper that
prefixes a query with the views it uses.

These strings are the independent oracle: they restate each view and query
in plain SQL over the driver's pre-registered tables.  Regex literals are
written for DuckDB (RE2), offsets are code points like Spark's.
"""

from __future__ import annotations

import re

from spanlab.functions.text import BLANK, TRIM


def bucket(x: str, modulo: int = 100) -> str:
    return f"((('0x' || substr(md5({x}), 1, 8))::BIGINT) % {modulo})"


def _tag_case(b: str) -> str:
    from spanlab.plans.testviews import TAG_BUCKETS
    whens = " ".join(f"WHEN {b} < {bound} THEN '{tag}'" for bound, tag in TAG_BUCKETS)
    return f"CASE {whens} ELSE 'O' END"


def _pred_tags(name: str, src: str, model: str, noise: int) -> str:
    key = f"(doc_id::VARCHAR || '/' || s::VARCHAR || '/' || '{model}')"
    return f"""{name} AS (
  SELECT doc_id, i, s, e, w,
         CASE WHEN {bucket(key + " || 'p'")} < {noise}
              THEN {_tag_case(bucket("w || 'h'"))} ELSE tag END AS tag,
         0.5 + {bucket(key + " || 'q'", 128)}::DOUBLE / 256.0 AS score
  FROM {src})"""


def _decode(name: str, src: str, with_score: bool, extra_key: str = "") -> str:
    part = f"doc_id{', ' + extra_key if extra_key else ''}"
    score = ", round(avg(score), 4) AS score" if with_score else ""
    return f"""{name}_flag AS (
  SELECT *, sum(flag) OVER (PARTITION BY {part} ORDER BY s
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS ord
  FROM (SELECT *, CASE WHEN tag LIKE 'B-%' OR (tag LIKE 'I-%' AND (prev IS NULL OR prev = 'O'
                        OR substr(prev, 3) <> substr(tag, 3))) THEN 1 ELSE 0 END AS flag
        FROM (SELECT *, lag(tag) OVER (PARTITION BY {part} ORDER BY s) AS prev FROM {src}))),
{name} AS (
  SELECT {part}, ord, min(s) AS start, max(e) AS "end", substr(min(tag), 3) AS label,
         count(*) AS n_tokens, arg_min(e, s) AS first_end, max(s) AS last_start{score}
  FROM {name}_flag WHERE tag <> 'O' GROUP BY {part}, ord)"""


def _views() -> list[tuple[str, str]]:
    from spanlab.plans.testviews import DEFAULT_MODEL, MODELS
    v: list[tuple[str, str]] = []
    v.append(("v_docs", """v_docs AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN replace(text, '. ', '.' || chr(160)) ELSE text END AS text,
         length(text)::BIGINT AS n_chars, lang FROM documents)"""))
    v.append(("v_pieces", """v_pieces AS (
  SELECT doc_id, lead, unnest(p) AS w, unnest(range(0, len(p))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '([^@BLANK@]+|[@BLANK@]+)', 1) AS p,
               CASE WHEN regexp_matches(text, '^[@BLANK@]') THEN 1 ELSE 0 END AS lead
        FROM v_docs))"""))
    v.append(("v_tokens", """v_tokens AS (
  SELECT doc_id, ((pos - lead) // 2)::INTEGER AS i, s::INTEGER AS s,
         (s + length(w))::INTEGER AS e, w
  FROM (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v_pieces)
  WHERE (pos - lead) % 2 = 0)"""))
    v.append(("v_gold_tags", f"""v_gold_tags AS (
  SELECT doc_id, i, s, e, w, {_tag_case(bucket("w || 'g'"))} AS tag FROM v_tokens)"""))
    noise = dict(MODELS)
    v.append(("v_pred_tags", _pred_tags("v_pred_tags", "v_gold_tags", DEFAULT_MODEL,
                                        noise[DEFAULT_MODEL])))
    parts = []
    for m, n in MODELS:
        parts.append(_pred_tags(f"v_pt_{m}", "v_gold_tags", m, n))
    v.append(("v_pt_models", ",\n".join(parts)))
    union = " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM v_pt_{m}" for m, _ in MODELS)
    v.append(("v_preds_multi_tags", f"v_preds_multi_tags AS ({union})"))
    v.append(("v_gold", _decode("v_gold", "v_gold_tags", False)))
    v.append(("v_pred", _decode("v_pred", "v_pred_tags", True)))
    v.append(("v_preds_multi", _decode("v_preds_multi", "v_preds_multi_tags", True, "model")))
    v.append(("v_gold_text", """v_gold_text AS (
  SELECT g.*, substr(d.text, g.start + 1, g."end" - g.start) AS text
  FROM v_gold g JOIN v_docs d USING (doc_id))"""))
    v.append(("v_pred_text", """v_pred_text AS (
  SELECT p.*, substr(d.text, p.start + 1, p."end" - p.start) AS text
  FROM v_pred p JOIN v_docs d USING (doc_id))"""))
    v.append(("v_ann_csv", f"""v_ann_csv AS (
  SELECT 'doc_' || g.doc_id::VARCHAR || '.ann' AS doc_name,
         'T' || g.ord::VARCHAR AS id,
         CASE WHEN g.ord % 3 = 0 THEN ' ' || chr(160) || g.label ELSE g.label END AS label,
         '8' || lpad({bucket("g.label || '|' || g.text", 1000)}::VARCHAR, 3, '0') || '/3' AS code,
         CASE WHEN g.ord % 4 = 0 THEN chr(9) || g.text || chr(8201) || ' ' ELSE g.text END AS content,
         CASE WHEN g.ord % 5 = 0 THEN ' ' || sp || chr(9) ELSE sp END AS full_span
  FROM (SELECT g.*,
               CASE WHEN g.ord % 7 = 0 AND g.n_tokens >= 2
                    THEN g.start::VARCHAR || ' ' || g.first_end::VARCHAR || ';' || g.last_start::VARCHAR
                         || ' ' || g."end"::VARCHAR
                    ELSE g.start::VARCHAR || ' ' || g."end"::VARCHAR END AS sp
        FROM v_gold_text g) g)"""))
    v.append(("v_gold_sp", f"""v_gold_sp AS (
  SELECT g.*, 'doc_' || g.doc_id::VARCHAR AS doc_name, 'T' || g.ord::VARCHAR AS tid,
         regexp_replace(g.text, '\\s+', ' ', 'g') AS tn,
         '8' || lpad({bucket("g.label || '|' || g.text", 1000)}::VARCHAR, 3, '0') || '/3' AS code,
         CASE WHEN g.ord % 7 = 0 AND g.n_tokens >= 2
              THEN g.start::VARCHAR || ' ' || g.first_end::VARCHAR || ';' || g.last_start::VARCHAR
                   || ' ' || g."end"::VARCHAR
              ELSE g.start::VARCHAR || ' ' || g."end"::VARCHAR END AS sp
  FROM v_gold_text g)"""))
    v.append(("v_ann_lines", f"""v_ann_lines AS (
  SELECT doc_name, ord * 10 AS line_no, tid || chr(9) || label || ' ' || sp || chr(9) || tn AS line
  FROM v_gold_sp
  UNION ALL
  SELECT doc_name, ord * 10 + 1, '#' || ord::VARCHAR || chr(9) || 'AnnotatorNotes ' || tid
         || chr(9) || code
  FROM v_gold_sp WHERE {bucket("'n' || label || text")} < 70
  UNION ALL
  SELECT doc_name, ord * 10 + 2, '#' || ord::VARCHAR || 'b' || chr(9) || 'AnnotatorNotes ' || tid
         || chr(9) || 'X' || code
  FROM v_gold_sp WHERE ord % 11 = 0
  UNION ALL
  SELECT doc_name, ord * 10 + 3, '#' || ord::VARCHAR || 'd' || chr(9) || 'AnnotatorNotes T'
         || (ord + 1000000)::VARCHAR || chr(9) || code
  FROM v_gold_sp WHERE ord % 13 = 0
  UNION ALL
  SELECT doc_name, ord * 10 + 4, tid || 'x' || chr(9) || 'broken' FROM v_gold_sp WHERE ord % 17 = 0
  UNION ALL
  SELECT doc_name, ord * 10 + 5, '# free comment' FROM v_gold_sp WHERE ord % 19 = 0
  UNION ALL
  SELECT doc_name, ord * 10 + 6, tid || 'y' || chr(9) || 'morphologie 12' || chr(9) || 'one number'
  FROM v_gold_sp WHERE ord % 23 = 0
  UNION ALL
  SELECT doc_name, ord * 10 + 7, tid || 'z' || chr(9) || 'morphologie 0 5 9' || chr(9) || 'three numbers'
  FROM v_gold_sp WHERE ord % 29 = 0)"""))
    v.append(("v_lexicon", """v_lexicon AS (
  SELECT p_type AS label, CASE WHEN p_partkey % 11 = 0 THEN replace(p_name, 'a', 'à') ELSE p_name END AS content,
         p_brand AS code, p_partkey AS ordinal FROM part)"""))
    v.append(("v_mentions", """v_mentions AS (
  SELECT p_partkey AS mention_id,
         CASE WHEN p_partkey % 3 = 0 THEN upper(t)
              WHEN p_partkey % 3 = 1 THEN '  ' || t || ' ' ELSE t END AS text,
         CASE WHEN p_partkey % 2 = 0 THEN 'B-' ELSE 'I-' END || p_type AS label
  FROM (SELECT *, substr(x, 1, (p_partkey % length(x))::INTEGER) || substr(x, (p_partkey % length(x))::INTEGER + 2) AS t
        FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN replace(p_name, 'a', 'à')
                             WHEN p_partkey % 13 = 0 THEN replace(p_name, 'o', 'ô') ELSE p_name END AS x FROM part)))"""))
    v.append(("v_msgs", """v_msgs AS (
  SELECT conv_id * 4294967296 + turn AS doc_id, text FROM conversations)"""))
    v.append(("v_logits", """v_logits AS (
  SELECT vec_id, list_transform(range(9), lambda k: list_reduce(list_transform(list_filter(
           range(1, len(embedding) + 1), lambda i: (i - 1) % 9 = k), lambda i: embedding[i]::DOUBLE),
           lambda a, x: a + x)) AS logits FROM embeddings)"""))
    return v


def register_single_bytes(name: str, strings: str) -> None:
    """A one-row CTE (src, dst) for ``translate``: every non-ASCII character of the strings (a
    SELECT of one column ``x``) and an ASCII character that none of them has.

    DuckDB's ``levenshtein`` counts bytes; see :func:`edits`.
    """
    register(name, f"""{name} AS (
  SELECT CASE WHEN count(*) FILTER (WHERE r IS NULL) > 0 THEN error('too many different characters')
              ELSE coalesce(string_agg(c, '' ORDER BY c), '') END AS src,
         coalesce(string_agg(r, '' ORDER BY c), '') AS dst
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS k
        FROM (SELECT DISTINCT unnest(regexp_extract_all(x, '(?s).')) AS c FROM ({strings})) WHERE unicode(c) > 127)
  LEFT JOIN (SELECT r, row_number() OVER (ORDER BY r) AS k
             FROM (SELECT chr(i::INTEGER) AS r FROM range(1, 128) t(i))
             WHERE r NOT IN (SELECT DISTINCT unnest(regexp_extract_all(x, '(?s).')) FROM ({strings}))) USING (k))""")


def edits(a: str, b: str, single_bytes: str) -> str:
    """Edit distance in code points."""
    return (f"levenshtein(translate({a}, (SELECT src FROM {single_bytes}), (SELECT dst FROM {single_bytes})), "
            f"translate({b}, (SELECT src FROM {single_bytes}), (SELECT dst FROM {single_bytes})))")


_VIEWS: list[tuple[str, str]] | None = None
# extra named CTEs registered by query modules (name -> sql), appended after views
_EXTRA: list[tuple[str, str]] = []


def register(name: str, sql: str) -> None:
    """Register a shared CTE (used by several oracle queries).

    ``@BLANK@`` and ``@TRIM@`` stand for the patterns of ``functions.text``."""
    _EXTRA.append((name, sql))


def _all() -> list[tuple[str, str]]:
    global _VIEWS
    if _VIEWS is None:
        _VIEWS = _views()
    return [(n, _materialised(sql)) for n, sql in _VIEWS + _EXTRA]


def _materialised(sql: str) -> str:
    """Every view is computed once, however many others read it."""
    if "-- recursive" in sql:
        return sql
    return re.sub(r"(^|\),\n)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", sql)


def _names_in(sql: str, names: list[str]) -> set[str]:
    return {n for n in names if re.search(rf"\b{re.escape(n)}\b", sql)}


def with_views(body: str) -> str:
    """Prefix ``body`` with every view it needs (transitively), in order."""
    defs = _all()
    names = [n for n, _ in defs]
    sql_of = dict(defs)
    # view groups that define helper CTEs under other names
    alias = {f"v_pt_{m}": "v_pt_models" for m in ("m1", "m2", "m3_optimized")}
    alias.update({"v_gold_flag": "v_gold", "v_pred_flag": "v_pred",
                  "v_preds_multi_flag": "v_preds_multi"})
    need = set()
    stack = [alias.get(n, n) for n in _names_in(body, names + list(alias))]
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        for d in _names_in(sql_of[n], names + list(alias)):
            d = alias.get(d, d)
            if d != n and d not in need:
                stack.append(d)
    ctes = [sql_of[n] for n in names if n in need]
    recursive = "RECURSIVE " if any("-- recursive" in c for c in ctes) else ""
    sql = body if not ctes else f"WITH {recursive}" + ",\n".join(ctes) + "\n" + body
    return sql.replace("@TRIM@", TRIM).replace("@BLANK@", BLANK)
