"""Byte channels: how text comes to be decoded wrongly, and how to undo it.

A channel is a single-byte table through which the bytes of a text were read by
mistake. Reading UTF-8 through such a table turns every character beyond ASCII
into a lead and its continuations, which hardly ever stand together otherwise;
`Channel.sure` counts them, and `unread` maps them back. Readings with bytes
lost are the business of `lattice`.
"""

from __future__ import annotations

import re
from functools import lru_cache

LOST = "\ufffd"

# Single-byte tables through which UTF-8 is read by mistake.
TABLES = ("cp1252", "cp1251", "mac-roman", "cp437", "cp850", "cp1250", "koi8-r", "cp866")
# Pairs (written in, read as) of single-byte tables confused with each other, for letters of another script.
CONFUSED = (("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1252"), ("cp1251", "mac-roman"), ("cp1251", "cp866"), ("cp866", "cp1251"))


def byte_table(name: str) -> list[str | None]:
    """The character of each byte; bytes that cp1252 leaves open read as control characters."""
    table: list[str | None] = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(b) if name.startswith("cp125") else None)
    return table


QUOTES = frozenset("«»“”„‘’‚‹›–—…•")


class Channel:
    """One table through which UTF-8 was read."""

    def __init__(self, name: str):
        self.name = name
        table = byte_table(name)
        self.bytes = {c: b for b, c in enumerate(table) if c is not None}
        if name == "cp1252":  # many readers keep the bytes 80-9F as control characters
            for b in range(0x80, 0xA0):
                self.bytes.setdefault(chr(b), b)
        group = lambda low, high: "[" + "".join(re.escape(c) for c, b in self.bytes.items() if low <= b <= high) + "]"
        tail = group(0x80, 0xBF)
        self.pattern = re.compile(f"(?:{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}})")
        self.leads = frozenset(c for c, b in self.bytes.items() if 0xC2 <= b <= 0xF4)

    def decoded(self, span: str) -> str | None:
        try:
            char = bytes(self.bytes[c] for c in span).decode("utf-8")
        except UnicodeDecodeError:
            return None
        return char if common(char) or control(char) else None

    def unread(self, text: str) -> str:
        """`text` with every span that is a common character under this table decoded again."""
        return self.pattern.sub(lambda m: self.decoded(m.group()) or m.group(), text)

    def sure(self, text: str) -> int:
        """How many characters of `text` stand in spans that nobody writes on purpose.

        A span that gives a Cyrillic letter counts where another one touches
        it. One that begins with a Cyrillic letter and goes on with a letter or
        a quotation mark counts where another one or a Latin letter touches it,
        or the rest of the text has no Cyrillic: capitals before closing quotes
        and other alphabets have such pairs too.
        """
        spans = [(m.start(), m.end(), d) for m in self.pattern.finditer(text) if (d := self.decoded(m.group())) is not None]
        total = 0
        alone = bool(spans) and not any(map(cyrillic, self.pattern.sub("", text)))
        for k, (start, end, char) in enumerate(spans):
            span = text[start:end]
            fine = True
            if cyrillic(char) or cyrillic(span[0]) and all(c.isalpha() or c in QUOTES for c in span[1:]):
                fine = k > 0 and spans[k - 1][1] == start or k + 1 < len(spans) and spans[k + 1][0] == end
                if not fine and not cyrillic(char):
                    beside = text[max(0, start - 1) : start] + text[end : end + 1]
                    fine = end - start > 2 or any(c.isalpha() and not cyrillic(c) for c in beside) or alone
            elif end - start == 2 and span[1] in QUOTES and not any(c.isalpha() for c in text[max(0, start - 1) : start] + text[end : end + 1]):
                # a capital before a closing quotation mark
                fine = False
            total += (end - start) * bool(fine)
        return total


@lru_cache(maxsize=1)
def channels() -> tuple[Channel, ...]:
    return tuple(Channel(name) for name in TABLES)


@lru_cache(maxsize=1)
def confusions() -> tuple[tuple[str, str, dict[int, str]], ...]:
    """(written in, read as, map of characters) of the confused single-byte tables."""
    found = []
    for written, read in CONFUSED:
        right, wrong = byte_table(written), byte_table(read)
        found.append((written, read, {ord(w): r for r, w in zip(right[128:], wrong[128:], strict=True) if r is not None and w is not None and len(w) == 1}))
    return tuple(found)


# Signs beyond letters that scholarly texts are full of.
SIGNS = frozenset("€–—‘’“”„‚…•™‰ƒˆ˜‹›≤≥≠≈√∑∏∫∂∞−←→†‡№")


@lru_cache(maxsize=4096)
def common(char: str) -> bool:
    """Whether a decoded character is one that texts are full of."""
    c = ord(char)
    return char in SIGNS or 0xA0 <= c <= 0x17F or 0x391 <= c <= 0x3C9 or cyrillic(char) or c < 0x80


def cyrillic(char: str) -> bool:
    return "А" <= char <= "я" or char in "Ёё"


def control(char: str) -> bool:
    return 0x80 <= ord(char) <= 0x9F
