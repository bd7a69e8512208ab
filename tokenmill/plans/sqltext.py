"""Fragments of SQL text shared by the SQL twins."""

from __future__ import annotations


def h_hex(seed, *keys: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"({k})::VARCHAR" for k in keys) + "))"


def h_int(seed, *keys: str) -> str:
    return f"('0x' || substr({h_hex(seed, *keys)}, 1, 15))::BIGINT"


def h_uniform(seed, *keys: str) -> str:
    return f"({h_int(seed, *keys)}::DOUBLE / 1152921504606846976::DOUBLE)"


def h_below(bound, seed, *keys: str) -> str:
    return f"({h_int(seed, *keys)} % ({bound})::BIGINT)"


def words(text: str) -> str:
    """Whitespace words of a text; a blank text has none."""
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def codes(text: str) -> str:
    """Code points of a text, as the character-level tokenizer numbers them."""
    return f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: unicode(c)::INTEGER)"


def joined(array: str) -> str:
    return f"array_to_string({array}, ' ')"
