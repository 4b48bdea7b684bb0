"""Importing this module registers every query of the package."""

from inkwell.llm import (  # noqa: F401
    bpe, embedding_dedup, exact_dedup, filter_audit, langid, minhash, packing, periodic_runs, secret_scan,
    substring_dedup, token_files, toxicity, url_filter)
from inkwell.llm.registry import ORACLE, QUERIES  # noqa: F401
