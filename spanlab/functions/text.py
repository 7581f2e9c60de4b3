"""Column expressions (all built-in, JVM side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlab import schemas

# The characters that count as blank, as the inside of a regex class
# (valid for Java and for RE2) -- ASCII white space and separators, next line, no-break
# space, ogham space, the U+2000 spaces, line and paragraph separators, narrow no-break
# space, mathematical space, ideographic space.
BLANK = (r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TRIM = rf"^[{BLANK}]+|[{BLANK}]+$"
#: The same characters one by one.
BLANK_CHARACTERS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: str | Column) -> Column:
    """Strip every leading/trailing blank character (see ``BLANK``).

    What ``TRIM`` matches, but only the ends are looked at: the pattern is tried at every character.
    """
    return F.btrim(_c(c), F.lit(BLANK_CHARACTERS))


def is_blank(c: str | Column) -> Column:
    """No character but blanks (stops at the first other one)."""
    return ~_c(c).rlike(rf"[^{BLANK}]")


def clean_label(c: str | Column) -> Column:
    """Drop an anchored BIO prefix, trim and case-fold a label."""
    return F.lower(F.regexp_replace(trim_ws(c), r"^[BI]-", ""))


def normalise_key(c: str | Column) -> Column:
    """C1+C2: mention / lexicon lookup key."""
    return F.lower(trim_ws(c))


def doc_stem(c: str | Column) -> Column:
    """Document key without the .ann/.txt suffix."""
    return F.regexp_replace(_c(c), r"\.(ann|txt)$", "")


def md5_bucket(c: str | Column, modulo: int = 100) -> Column:
    """First 8 hex digits of md5(x) as an integer, modulo ``modulo``."""
    return (F.conv(F.substring(F.md5(_c(c).cast("string")), 1, 8), 16, 10)
            .cast("bigint") % F.lit(modulo))


def text_slice(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """text[start:end] with 0-based, end-exclusive code point offsets."""
    s, e = _c(start), _c(end)
    return F.substring(_c(text), s + 1, e - s)


def span_envelope(full_span: str | Column) -> tuple[Column, Column]:
    """(start, end) of the envelope of a ``"s e[;s e]*"`` span string.

    Blanks and tabs around the string are removed first; a part that is not
    an integer gives null (try_cast), so bad rows can be quarantined.
    """
    # what is before the first separator and after the last: the parts between are not cut
    ends = []
    for k in (1, -1):
        part = trim_ws(full_span)
        for separator in (" ", ";", "\t"):
            part = F.substring_index(part, separator, k)
        ends.append(part.try_cast("int"))
    return ends[0], ends[1]


SUB_SPAN = r"^(-?[0-9]+)\s+(-?[0-9]+)$"


def span_list(full_span: str | Column) -> Column:
    """C4: ``"s e;s e"`` -> array<struct<start:int,end:int>> (in order).

    A piece that is not exactly two integers gives nulls.
    """
    pieces = F.split(trim_ws(full_span), r"\s*;\s*")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.regexp_extract(p, SUB_SPAN, 1).try_cast("int").alias("start"),
            F.regexp_extract(p, SUB_SPAN, 2).try_cast("int").alias("end"),
        ),
    )


def similarity(a: str | Column, b: str | Column) -> Column:
    """Normalised Levenshtein similarity 1 - d / max(len); 1.0 for two empties."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double")
    )


def length_category(n: str | Column) -> Column:
    """Document length category."""
    n = _c(n)
    return (F.when(n < schemas.LENGTH_SHORT_MAX, F.lit(schemas.CATEGORY_SHORT))
            .when(n < schemas.LENGTH_MEDIUM_MAX, F.lit(schemas.CATEGORY_MEDIUM))
            .otherwise(F.lit(schemas.CATEGORY_LONG)))


def safe_div(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0 (ANSI safe)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def html_escape(c: str | Column) -> Column:
    c = _c(c)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
