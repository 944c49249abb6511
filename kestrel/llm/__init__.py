"""Operators of a training-data pipeline: near-duplicates, toxicity, byte-level
BPE, quality, packing, line dedup, personal data and secrets.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries (``kestrel.llm.queries``) when it can be imported.
"""
