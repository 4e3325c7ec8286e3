"""Words of whole texts in Python tasks: one translation and one split, a bounded stretch at a time.

Word rules here are sets of bytes. Every byte of a character above U+007F is in a word, so a rule on
bytes finds the words that the rule on characters finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of one text that are words in memory at a time; a longer word is a stretch alone.
STRETCH = 1 << 20


def fold_table(inside: str) -> bytes:
    """Maps ASCII capitals to small letters, and ASCII outside ``inside`` (a set of one byte each) to a blank."""
    keep = re.compile(f"[{inside}]".encode())
    out = bytearray(range(256))
    for i in range(128):
        small = bytes([i]).lower()
        out[i] = small[0] if keep.match(small) else 0x20
    return bytes(out)


#: Digits, letters and all above ASCII.
LETTERS_DIGITS = fold_table("0-9a-z")


def stretches(text: bytes, table: bytes, most: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from at most ``most`` bytes each or from one longer word."""
    if len(text) <= most:
        yield text.translate(table).split()
        return
    start, rest = 0, b""
    while start < len(text):
        piece = rest + text[start : start + most].translate(table)
        start += most
        cut = len(piece) if start >= len(text) else piece.rfind(b" ") + 1
        words, rest = piece[:cut].split(), piece[cut:]
        if words:
            yield words
