"""Schemas and the label vocabulary, defined once for the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the annotation scheme of the corpus.
# Entity types in vocabulary order, and the BIO label list built from them
# ("O" first, then B-/I- per type), so that label ids are stable.
ENTITY_TYPES = ["morphologie", "topographie", "differenciation", "expression_CIM"]
# Display names used by the entity table.
DISPLAY_NAMES = {
    "morphologie": "Morphologie",
    "topographie": "Topographie",
    "differenciation": "Différenciation",
    "expression_CIM": "Expression CIM",
}
# Label set of the confusion matrix: the entity types plus "O".
CONFUSION_LABELS = ENTITY_TYPES + ["O"]
# Ignored position in label sequences.
IGNORE_INDEX = -100
# Length categories of the error-rate-by-length report (chars).
LENGTH_SHORT_MAX = 3000
LENGTH_MEDIUM_MAX = 8000
CATEGORY_SHORT = "court (<3000)"
CATEGORY_MEDIUM = "moyen (3000-8000)"
CATEGORY_LONG = "long (>8000)"
# ---------------------------------------------------------------------------


def bio_labels(entity_types: list[str] | None = None) -> list[str]:
    types = ENTITY_TYPES if entity_types is None else entity_types
    out = ["O"]
    for t in types:
        out += [f"B-{t}", f"I-{t}"]
    return out


LABELS = bio_labels()
LABEL2ID = {lbl: i for i, lbl in enumerate(LABELS)}
ID2LABEL = {i: lbl for i, lbl in enumerate(LABELS)}

# Annotation rows as read from CSV -- all strings, never inferred.
ANNOTATION_CSV = T.StructType(
    [
        T.StructField("doc_name", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("full_span", T.StringType()),
    ]
)

# D3: one character span, 0-based, end exclusive, in code points.
SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
)

# Standoff entity.
ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("text", T.StringType()),
        T.StructField("icdo_code", T.StringType()),
    ]
)

# Token with offsets (W1 output).
TOKEN = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("s", T.IntegerType()),
        T.StructField("e", T.IntegerType()),
        T.StructField("w", T.StringType()),
    ]
)
