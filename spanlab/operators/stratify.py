"""Multi-label stratified document split (W8, stratified mode).

Iterative stratification, rarest label first.  A document's labels are one bit mask, and only
the number of documents per mask (at most ``2 ** len(labels)`` rows, whatever the corpus)
is planned on the driver; documents themselves are ranked inside their mask by a hash.

Guarantee: documents are never cut; every document with a key is in exactly one split.  A label's number of
documents in a split is its exact share (largest remainder), unless no two masks that differ in
that label alone have documents to exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.operators.splits import SPLITS
from spanlab.session import keep

#: Masks are planned on the driver: at most 2 ** MAX_LABELS rows of (mask, count).
MAX_LABELS = 16


def apportion(n: int, weights: Sequence[int]) -> list[int]:
    """``n`` in proportion to whole ``weights``, by largest remainder (ties: the earlier part)."""
    total = sum(weights)
    parts = [n * w // total for w in weights]
    order = sorted(range(len(weights)), key=lambda s: (-(n * weights[s] % total), s))
    for s in order[:n - sum(parts)]:
        parts[s] += 1
    return parts


def _spread(rows: list[int], quota: list[int]) -> list[list[int]]:
    """Split every row count so that parts add up to ``quota``; each row stays near proportion.

    One part after the other is taken off by cumulative rounding, which keeps both margins."""
    out, left = [[0] * len(quota) for _ in rows], list(rows)
    for s, q in enumerate(quota):
        total, seen, done = sum(left), 0, 0
        for r, c in enumerate(left):
            seen += c
            upto = (2 * seen * q + total) // (2 * total) if total else 0
            out[r][s], done = upto - done, upto
        left = [c - o[s] for c, o in zip(left, out)]
    return out


def plan(counts: dict[int, int], n_labels: int, weights: Sequence[int]) -> dict[int, list[int]]:
    """Documents of every label mask that go to each part.

    Rarest label first: all masks with it that are still open are shared out such that
    the label meets its share.  Then, label by label, documents of two masks that differ
    only in this label change places between a part with too many and one with too few.
    """
    parts = range(len(weights))
    bits = range(n_labels)
    given: dict[int, list[int]] = {}

    def have(bit: int | None) -> list[int]:
        return [sum(g[s] for m, g in given.items() if bit is None or m >> bit & 1) for s in parts]

    def share(masks: list[int], quota: list[int]) -> None:
        n = sum(counts[m] for m in masks)
        if n:  # earlier labels may have overdrawn a part: nothing more goes there
            quota = apportion(n, [max(0, q) for q in quota])
            given.update(zip(masks, _spread([counts[m] for m in masks], quota)))

    sizes = [sum(c for m, c in counts.items() if m >> b & 1) for b in bits]
    target = [apportion(n, weights) for n in sizes]
    rare = sorted(bits, key=lambda b: (sizes[b], b))
    todo = set(bits)
    while todo:
        open_n = {b: sum(c for m, c in counts.items() if m not in given and m >> b & 1) for b in todo}
        b = min(todo, key=lambda x: (open_n[x], x))
        todo.remove(b)
        # neighbours in this order share their rarer labels, so that those stay near proportion
        masks = sorted((m for m in counts if m not in given and m >> b & 1),
                       key=lambda m: [m >> x & 1 for x in rare])
        share(masks, [t - h for t, h in zip(target[b], have(b))])
    whole = apportion(sum(counts.values()), weights)
    share([m for m in counts if m not in given], [t - h for t, h in zip(whole, have(None))])

    for b in bits:
        off = [h - t for h, t in zip(have(b), target[b])]
        for m in sorted(x for x in given if x >> b & 1 and x ^ 1 << b in given):
            with_label, without = given[m], given[m ^ 1 << b]
            for s in parts:
                for t in parts:
                    n = min(off[s], -off[t], with_label[s], without[t])
                    if n > 0:
                        for row, sign in ((with_label, -n), (without, n)):
                            row[s] += sign
                            row[t] -= sign
                        off[s] -= n
                        off[t] += n
    return given


def label_masks(df: DataFrame, labels: Sequence[str], doc_col: str = "doc_name", label_col: str = "label") -> DataFrame:
    """``(document, _mask)``: bit k is set if the document has ``labels[k]``.

    Combined before the shuffle.  Null and unknown labels set no bit; rows without a document key are left out."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col))
    bit = F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (at - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
    return df.where(F.col(doc_col).isNotNull()).groupBy(doc_col).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("_mask"))


def _split_of(rank: Column, cuts: Column, names: Sequence[str]) -> Column:
    out = F.when(rank <= cuts[0], F.lit(names[0]))
    for k, name in enumerate(names[1:], 1):
        out = out.when(rank <= cuts[k], F.lit(name))
    return out


def stratified_split_docs(df: DataFrame, labels: Sequence[str], weights: Sequence[int] = (80, 10, 10),
                          doc_col: str = "doc_name", label_col: str = "label", seed: int = 42,
                          names: Sequence[str] = SPLITS, prefix_hex: int = 3) -> DataFrame:
    """``(document, split)`` with every label's documents shared out by ``weights`` (whole numbers).

    One job counts the documents per mask.  The rank inside a mask follows ``md5(document || seed)``: masks
    are cut into buckets by the first hex digits, so that one mask with all documents is no task of
    its own, and at most ``16 ** prefix_hex`` bucket sizes per mask give the offsets.
    """
    if not 0 < len(labels) <= MAX_LABELS:
        raise ValueError(f"1 to {MAX_LABELS} labels")
    if len(weights) != len(names) or min(weights) < 0 or not sum(weights):
        raise ValueError("one weight, not negative, per split")
    masks = keep(label_masks(df, labels, doc_col, label_col))
    counts = {r["_mask"]: r["n"] for r in masks.groupBy("_mask").agg(F.count("*").alias("n")).collect()}
    cuts = []
    for mask, given in plan(counts, len(labels), weights).items():
        cuts.append((mask, [sum(given[:k + 1]) for k in range(len(given))]))
    schema = T.StructType([T.StructField("_mask", T.LongType()), T.StructField("_cuts", T.ArrayType(T.LongType()))])
    cut_rows = df.sparkSession.createDataFrame(cuts, schema)

    hashed = masks.withColumn("_h", F.md5(F.concat(F.col(doc_col).cast("string"), F.lit(str(seed)))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, prefix_hex))
    before = Window.partitionBy("_mask").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy("_mask", "_b").agg(F.count("*").alias("_nb")).select(
        "_mask", "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"))
    rank = F.col("_off") + F.row_number().over(Window.partitionBy("_mask", "_b").orderBy("_h", doc_col))
    ranked = hashed.join(offsets, ["_mask", "_b"]).withColumn("_rank", rank)
    return (ranked.join(F.broadcast(cut_rows), "_mask")
            .select(doc_col, _split_of(F.col("_rank"), F.col("_cuts"), names).alias("split")))


def label_shares(df: DataFrame, doc_splits: DataFrame, labels: Sequence[str], doc_col: str = "doc_name",
                 label_col: str = "label", names: Sequence[str] = SPLITS) -> DataFrame:
    """Documents per label and split, zeros included: ``(label, split, n_docs)``."""
    known = df.where(F.col(label_col).isin(list(labels))).select(doc_col, label_col).distinct()
    met = known.join(doc_splits.select(doc_col, "split"), doc_col).groupBy(F.col(label_col).alias("label"), "split").count()
    grid = df.sparkSession.createDataFrame([(x, s) for x in labels for s in names], "label string, split string")
    return grid.join(met, ["label", "split"], "left").select(
        "label", "split", F.coalesce("count", F.lit(0)).cast("long").alias("n_docs"))
