"""The queries opN_<name> and their SQL, by module."""

from __future__ import annotations

from . import ann, embedding_dedup, mixing, packing, quality, secrets, sharding, simhash, token_files, toxicity

_MODULES = (simhash, toxicity, token_files, secrets, ann, quality, mixing, embedding_dedup, packing, sharding)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE", {}).items()}
