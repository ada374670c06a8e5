"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from docket.llm import (
    block_dedup, collocations, decontaminate, disclosure, importance, jaccard_join, lexical_search, license_scan, sentencepiece_codec, subspace_join,
    token_counts, toxicity, url_filter,
)

_MODULES = (
    block_dedup, jaccard_join, decontaminate, toxicity, disclosure, importance, sentencepiece_codec, url_filter, token_counts, license_scan,
    collocations, subspace_join, lexical_search,
)
QUERIES = {name: f for module in _MODULES for name, f in vars(module).items() if name.startswith("op") and name[2].isdigit()}
CHECKS: dict[str, str] = {name: sql for module in _MODULES for name, sql in getattr(module, "CHECKS", {}).items()}
