"""The corpus operators' queries over the sample tables, and their oracle SQL."""

from __future__ import annotations

from treeline.llm import q_chat, q_decontamination, q_html, q_layout, q_media, q_merkle, q_neardup, q_packing, q_secret_scan, q_sharding, q_token_output, q_toxicity, q_url_filter

_ALL = (q_sharding, q_toxicity, q_neardup, q_url_filter, q_packing, q_decontamination, q_token_output, q_html, q_chat, q_media, q_merkle, q_secret_scan, q_layout)
QUERIES = {m.NAME: m.query for m in _ALL}
ORACLES = {m.NAME: m.ORACLE for m in _ALL if m.ORACLE}
