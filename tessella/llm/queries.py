"""The queries of the training-data operators by name, and their SQL."""

from . import chat, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, token_files, toxicity

MODULES = (exact_dedup, chat, packing, token_files, mixing, toxicity, pii, line_dedup, quality, near_dedup)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
