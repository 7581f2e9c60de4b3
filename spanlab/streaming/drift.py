"""Label drift: shares of labels per event-time window against a reference.

One windowed aggregation counts every reference label and all others together, so the
state is one row per open window, whatever the number of events.  The divergence is
an expression over that row.  Batch and stream share it: on a stream the watermark
closes windows, later rows are dropped, and closed windows come out once (append mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference labels: each is a column of the window's state.
MAX_LABELS = 1000


def reference_shares(rows: DataFrame, label: str = "label") -> dict[str, float]:
    """Share of every label among the rows whose label is known; at most MAX_LABELS labels."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    total = sum(r["count"] for r in counts)
    return {r[0]: r["count"] / total for r in sorted(counts, key=lambda r: r[0])}


def _half(p: Column, q: Column) -> Column:
    """p's term of the Jensen-Shannon divergence, in bits."""
    return F.when(p > 0, p * F.log2(p * 2.0 / (p + q))).otherwise(F.lit(0.0))


def label_drift(rows: DataFrame, reference: dict[str, float], time: str = "ts", label: str = "label",
                window: str = "1 day", slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """``(window_start, window_end, n, n_new, divergence, shifted, shift)`` per window with a row.

    ``n`` counts rows with a known label and ``n_new`` those with a label that the reference
    lacks.  ``divergence`` is the Jensen-Shannon divergence (0 to 1) of the label shares from
    the reference's, new labels counting as one; ``shifted`` is the label whose share has
    moved most (the first by name of equals, null where it is the new ones) and ``shift`` by
    how much.  Rows with a null time or label are not counted.

    On a stream give ``lateness``: rows that much behind the latest event are dropped.
    """
    if not reference:
        raise ValueError("the reference has no labels")
    if rows.isStreaming and lateness is None:
        raise ValueError("a stream needs a lateness")
    rows = rows.where(F.col(time).isNotNull() & F.col(label).isNotNull()).select(
        F.col(time).alias("_t"), F.col(label).alias("_l"))
    if lateness is not None:
        rows = rows.withWatermark("_t", lateness)
    names = sorted(reference)
    per = rows.groupBy(F.window("_t", window, slide).alias("_w")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("_l") == name).alias(f"_n{i}") for i, name in enumerate(names)])
    counts = [F.col(f"_n{i}") for i in range(len(names))]
    new = F.col("n") - sum(counts[1:], counts[0])
    table = F.array(*[F.struct(F.lit(name).alias("label"), F.lit(float(reference[name])).alias("q"), c.alias("c"))
                      for name, c in zip(names, counts)],
                    F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("q"), new.alias("c")))
    shares = F.transform(table, lambda x: F.struct(
        x["label"].alias("label"), (x["c"] / F.col("n")).alias("p"), x["q"].alias("q")))
    per = per.select("_w", "n", new.alias("n_new"), shares.alias("_s"))
    divergence = F.aggregate("_s", F.lit(0.0), lambda s, x: s + (_half(x["p"], x["q"]) + _half(x["q"], x["p"])) / 2.0)
    # the first of the largest moves, in the order of names
    most = F.aggregate("_s", F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("by")),
                       lambda s, x: F.when(F.abs(x["p"] - x["q"]) > F.abs(s["by"]) + 1e-12, F.struct(
                           x["label"].alias("label"), (x["p"] - x["q"]).alias("by"))).otherwise(s))
    return per.withColumn("_m", most).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", "n_new",
        F.greatest(F.lit(0.0), divergence).alias("divergence"), F.col("_m.label").alias("shifted"),
        F.col("_m.by").alias("shift"))
