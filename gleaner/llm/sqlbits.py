"""CRC-32 for SQL engines that lack it: text of SQL that the operators' oracles share."""

from __future__ import annotations


def _table() -> list[int]:
    """The 256 remainders of the reflected polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32_of_bytes(codes: str) -> str:
    """codes: SQL for a list of byte values as BIGINT."""
    step = f"xor(a >> 8, [{','.join(map(str, _table()))}][(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {step}), CAST(4294967295 AS BIGINT))"


def crc32_of_digits(text: str) -> str:
    return crc32_of_bytes(f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))")


def crc32_of_text(text: str) -> str:
    """Of the UTF-8 bytes of any text."""
    return crc32_of_bytes(f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))")
