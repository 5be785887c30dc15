"""The registered queries of the training-data operators, and their SQL."""

from millrace.llm import (
    op01_quality,
    op02_neardup,
    op03_fingerprints,
    op04_tables,
    op05_rules,
    op06_shards,
    op07_mixing,
    op08_counts,
    op09_pieces,
    op10_substrings,
)

_MODULES = (
    op01_quality,
    op02_neardup,
    op03_fingerprints,
    op04_tables,
    op05_rules,
    op06_shards,
    op07_mixing,
    op08_counts,
    op09_pieces,
    op10_substrings,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
