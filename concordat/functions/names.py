"""Column-name normalisation. Works on the list of names only, never on rows."""

from __future__ import annotations

import unicodedata

# Letters that do not decompose under NFKD.
LETTER_FOLDS = {
    "ß": "ss",
    "æ": "ae",
    "Æ": "AE",
    "œ": "oe",
    "Œ": "OE",
    "ø": "o",
    "Ø": "O",
    "ł": "l",
    "Ł": "L",
    "đ": "d",
    "Đ": "D",
    "ð": "d",
    "Ð": "D",
    "þ": "th",
    "Þ": "Th",
    "ı": "i",
}


def fold_ascii(text: str) -> str:
    folded = "".join(LETTER_FOLDS.get(ch, ch) for ch in text)
    return unicodedata.normalize("NFKD", folded).encode("ascii", "ignore").decode("ascii")


def normalise_name(name: str) -> str:
    return fold_ascii(str(name)).strip().lower().translate(str.maketrans(" -", "__"))


def unique_names(names: list[str]) -> list[str]:
    """Repeats get the first free ``_1``, ``_2``, ... so ``a, a, a_1`` cannot collide."""
    given, used, out = set(names), set(), []
    for name in names:
        candidate, n = name, 0
        while candidate in used or (n and candidate in given):
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate)
        out.append(candidate)
    return out


def normalise_names(names: list[str]) -> list[str]:
    return unique_names([normalise_name(n) for n in names])
