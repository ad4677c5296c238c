"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import audio, chat, decontaminate, divergence, html_diff, langid, mixing, near_dup, ngram_join, paragraphs, secrets, suffixes, whitening

MODULES = (audio, suffixes, mixing, html_diff, decontaminate, chat, paragraphs, near_dup, secrets, langid, divergence, ngram_join, whitening)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
