"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, decontaminate, embedding_dedup, language_id, lexical_search, license_scan, line_dedup, minhash, packing, pii, preference_format, sentencepiece_codec, spelling

MODULES = [
    sentencepiece_codec, ann, line_dedup, minhash, packing, license_scan, preference_format, embedding_dedup, pii, language_id, spelling,
    decontaminate, lexical_search
]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
