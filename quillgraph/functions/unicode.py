"""Unicode facts used by several operators."""

from __future__ import annotations

import re
import unicodedata

# fixed values: the code points with the Unicode property White_Space
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# fixed values: characters treated as quotes and as hyphens or dashes
QUOTES = "'\"`" + "".join(map(chr, [0xAB, 0xB4, 0xBB, *range(0x2018, 0x2020), 0x2032, 0x2033, 0x2039, 0x203A, 0xFF02, 0xFF07]))
DASHES = "-" + "".join(map(chr, [0xAD, *range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D]))

#: Java/RE2 class of one word character (anything but white space).
WORD = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE) + "]+"
PY_WORD = re.compile("[^" + re.escape(WHITE_SPACE) + "]+")

_FOLD = {ord(c): None for c in QUOTES} | {ord(c): " " for c in DASHES} | {ord(c): " " for c in WHITE_SPACE}


def reference_key(name: str | None) -> str | None:
    """A name as references compare it: NFKD, no accents or quotes, lower case, dashes as spaces, one space, no outer ``.,;:``."""
    if name is None:
        return None
    kept = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    out = []
    for c in kept.lower():
        if unicodedata.category(c) == "Pd":
            c = " "
        out.append(c)
    return " ".join("".join(out).translate(_FOLD).split()).strip(" .,;:")
