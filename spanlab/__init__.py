"""spanlab: DataFrame operators for annotated clinical text on Spark.

Modules: ``functions`` (column expressions), ``sources`` (readers/writers),
``operators`` (tokens, BIO, corpus, splits, lexicon, evaluation, annotation,
scoring, training), ``plans`` (derived test views, oracle SQL, query
catalogue) and ``streaming``.
"""

__version__ = "0.1.0"
