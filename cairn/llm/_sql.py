"""DuckDB SQL that several oracles share."""

#: One row, table t: the 256 remainders of CRC-32 (reflected polynomial EDB88320), made by its rule.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t)"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string of code points under 2048 in UTF-8; needs crc's t in scope."""
    points = f"list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)"
    octets = f"flatten(list_transform({points}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
