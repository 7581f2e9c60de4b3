"""Queries of this package: name -> builder, and the DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlab.llm import (bpe, decontaminate, exact, fuzzy_lines, hard_negatives, infill, langid, lengths, packing, quality,
                         repeats, simhash, warc)
from spanlab.llm.common import share_package

def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_suffix_dedup": repeats.op2_suffix_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_token_counts": lengths.op4_token_counts,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_line_dedup": fuzzy_lines.op6_line_dedup,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}
QUERIES = {name: _query(fn) for name, fn in QUERIES.items()}
ORACLE: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op7_exact_dedup": exact.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_fill_in_middle": infill.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
