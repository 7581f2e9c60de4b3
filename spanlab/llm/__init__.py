"""Operators of a training-data pipeline (tokenising, deduplication, language
identification, decontamination, WARC archives, quality scoring).

Nothing outside this package imports it; ``catalogue`` lists its queries.
"""
