"""Pieces of DuckDB SQL for functions that DuckDB lacks."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The 256 entries of the reflected CRC-32 table, from its polynomial."""
    out = []
    for entry in range(256):
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        out.append(entry)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    table = f"CAST([{', '.join(map(str, _crc_table()))}] AS BIGINT[])"
    characters = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {characters}), lambda c, b: {step}), 4294967295)"
