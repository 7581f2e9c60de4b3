"""Queries: label drift over event time (the batch form of the stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import splits
from spanlab.plans import testviews as tv
from spanlab.plans.catalogue import query
from spanlab.plans.oracle import bucket, register
from spanlab.streaming import drift

# every second event is a reference candidate; "signup" is not known to the reference
register("o_events", f"""o_events AS (
  SELECT ts, event_type AS label, {bucket("event_id::VARCHAR || '42'")} < 50 AS reference FROM events)""")
register("o_ref", """o_ref AS (
  SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM o_events
  WHERE reference AND label <> 'signup' GROUP BY label)""")
register("o_ref_labels", """o_ref_labels AS (SELECT label, q FROM o_ref UNION ALL SELECT NULL, 0.0)""")
register("o_drift_counts", """o_drift_counts AS (
  SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, r.label, count(*) AS c
  FROM o_events e LEFT JOIN o_ref r ON r.label = e.label WHERE NOT e.reference AND e.ts IS NOT NULL AND e.label IS NOT NULL
  GROUP BY 1, 2)""")
register("o_drift", """o_drift AS (
  SELECT w.window_start, w.n, r.label, r.q, coalesce(c.c, 0) AS c, coalesce(c.c, 0)::DOUBLE / w.n::DOUBLE AS p
  FROM (SELECT window_start, sum(c)::BIGINT AS n FROM o_drift_counts GROUP BY 1) w CROSS JOIN o_ref_labels r
  LEFT JOIN o_drift_counts c ON c.window_start = w.window_start AND c.label IS NOT DISTINCT FROM r.label)""")


@query("label_drift", """
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(window_start + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS window_end, any_value(n) AS n,
       sum(c) FILTER (WHERE label IS NULL)::BIGINT AS n_new,
       round(greatest(0.0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS divergence,
       first(label ORDER BY round(abs(p - q), 9) DESC, label NULLS LAST) AS shifted,
       round(first(p - q ORDER BY round(abs(p - q), 9) DESC, label NULLS LAST), 6) AS shift
FROM o_drift GROUP BY window_start""")
def q_label_drift(spark, sf):
    """Drift of event types in windows of six hours from those of a reference split."""
    events = splits.hash_split(tv.table(spark, sf, "events").withColumnRenamed("event_type", "label"),
                               doc_col="event_id", train_ratio=0.5, val_ratio=0.0, method="md5")
    reference = drift.reference_shares(events.where("split = 'train' and label <> 'signup'"))
    d = drift.label_drift(events.where("split = 'test'"), reference, window="6 hours")
    day = "yyyy-MM-dd HH:mm:ss"
    return d.withColumns({"divergence": F.round("divergence", 6), "shift": F.round("shift", 6),
                          "window_start": F.date_format("window_start", day), "window_end": F.date_format("window_end", day)})
