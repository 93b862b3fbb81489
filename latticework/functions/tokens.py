"""Column expressions over token strings and token bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT_LENGTH = 6


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the other bytes follow from U+0100 on in their order."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level(token: Column) -> Column:
    """Bytes of a token of a byte-level vocabulary; null if it holds a character that stands for no byte."""
    symbols = byte_symbols()
    # Symbols beyond Latin-1 are moved to their byte's character; then each character is one byte.
    moved = {c: chr(b) for c, b in symbols.items() if ord(c) != b and b}
    own = "".join(f"\\x{{{ord(c):x}}}" for c in symbols)
    latin = F.translate(token, "".join(moved), "".join(moved.values()))
    latin = F.replace(latin, F.lit(chr(0x100)), F.lit("\0"))  # which translate would take for a deletion
    return F.when(token.rlike(f"\\A[{own}]*\\z"), F.encode(latin, "ISO-8859-1"))


def spell_byte_level(text: Column) -> Column:
    """A text as a byte-level vocabulary spells its UTF-8 bytes."""
    moved = {chr(b): c for c, b in byte_symbols().items() if ord(c) != b}
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(moved), "".join(moved.values()))


def byte_fallback(token: Column, space: str = " ") -> Column:
    """Bytes of a token of a byte-fallback vocabulary: ``<0xNN>`` is one byte, else ``space`` stands for a blank. Null if ``<0x..>`` holds no hex digits."""
    data = F.encode(token, "UTF-8")
    special = (F.octet_length(token) == REPLACEMENT_LENGTH) & token.startswith("<0x") & token.endswith(">")
    return F.when(special, F.when(token.rlike("^<0x[0-9A-Fa-f]{2}>$"), F.unhex(F.substring(token, 4, 2)))).otherwise(F.encode(F.replace(token, F.lit(space), F.lit(" ")), "UTF-8") if space != " " else data)


def spell_byte_fallback(text: Column, space: str = " ") -> Column:
    """A text as tokens of a byte-fallback vocabulary: printable ASCII characters, ``space`` for a blank, and one ``<0xNN>`` for each byte of any other character."""

    def spelled(c: Column) -> Column:
        digits = F.hex(F.encode(c, "UTF-8"))
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.concat(F.lit("<0x"), F.substr(digits, i, F.lit(2)), F.lit(">")))
        return F.when(c == " ", F.array(F.lit(space))).when(c.rlike(r"\A[\x21-\x7E]?\z"), F.array(c)).otherwise(each)

    return F.flatten(F.transform(F.split(text, ""), spelled))


def bytes_of(token: Column) -> Column:
    """A binary column as an array of numbers; empty for the empty token."""
    digits = F.hex(token)
    at = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    return F.when(F.length(digits) == 0, F.array().cast("array<int>")).otherwise(F.transform(at, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int")))


def int_array(values) -> Column:
    """A constant array of any length as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
