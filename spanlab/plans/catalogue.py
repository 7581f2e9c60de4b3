"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver's tables (or
views Spark derives from them) in full.  Modules under ``spanlab.plans``
register their queries here with :func:`query`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorator: register a Spark builder (and its oracle SQL body)."""
    def deco(fn: Builder) -> Builder:
        _QUERIES[name] = fn
        if oracle is not None:
            from spanlab.plans.oracle import with_views
            _ORACLE[name] = with_views(oracle)
        return fn
    return deco


def _load() -> None:
    # import for side effects: each module registers its queries
    from spanlab.plans import (  # noqa: F401
        q_corpus, q_tokens, q_subword, q_lexicon, q_evaluate, q_serving, q_stream)


def queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
