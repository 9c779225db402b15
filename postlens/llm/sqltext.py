"""DuckDB SQL shared by the oracles of this subpackage."""

from __future__ import annotations

#: The reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, null if null: each byte, then eight shifts (marked -1)."""
    steps = (f"list_prepend({0xFFFFFFFF}::BIGINT, flatten(list_transform(range(1, len({text}) + 1), "
             f"lambda crc_at: list_concat([ord(({text})[crc_at])::BIGINT], list_transform(range(8), lambda crc_shift: -1::BIGINT)))))")
    return (f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce({steps}, lambda crc_acc, crc_step: CASE WHEN crc_step >= 0 THEN xor(crc_acc, crc_step) "
            f"WHEN crc_acc & 1 = 1 THEN xor(crc_acc >> 1, {_POLYNOMIAL}::BIGINT) ELSE crc_acc >> 1 END), {0xFFFFFFFF}::BIGINT) END")
