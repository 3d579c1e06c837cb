"""Pieces of oracle SQL that several queries use."""

from __future__ import annotations

#: The usual table of the polynomial 0xEDB88320, built in place.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text expression's UTF-8 bytes; CRC_TABLE's column tab has to be at hand. Null for null."""
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))"
    return f"CASE WHEN {text} IS NOT NULL THEN xor({fold}, 4294967295::BIGINT) END"
