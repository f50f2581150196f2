"""Imports every operator module, which registers its query."""

from fieldspark.llm import chat_format, decontaminate, embedding_dedup, license_scan, line_runs, mix_sources, ngram_join, personal_data, pivot_index, prefix_trie, slot_shards, token_alignment, toxicity  # noqa: F401
from fieldspark.llm.queries import ORACLES, QUERIES  # noqa: F401
