"""Cell values as SQL text: blanks, null tokens, numbers and dates."""

from __future__ import annotations

import re

from concordat.functions.sql import literal

# What counts as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Text that stands for null once trimmed and lower-cased.
NULL_TOKENS = ["", "null", "none", "na", "n/a", "?", "nan", "nil", "n.a.", "nd", "#n/a"]

# Fixed values: (shape, format), tried in this order. A column takes either the formats with the day before the
# month or those with the month first (``date_readings``), never both. A failed parse is an exception inside the task, so a text is parsed only
# by formats whose shape it has.
CLOCK = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}([.][0-9]{3}|[.][0-9]{6})?"
PLAIN_CLOCK = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}"
DATE_FORMATS = [
    (rf"[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} {CLOCK}", "yyyy-M-d H:mm:ss[.SSSSSS][.SSS]"),
    (rf"[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}T{CLOCK}", "yyyy-M-d'T'H:mm:ss[.SSSSSS][.SSS]"),
    (r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"),
    (r"[0-9]{8}", "yyyyMMdd"),
    (rf"[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {PLAIN_CLOCK}", "d/M/yyyy H:mm:ss"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy"),
    (rf"[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}} {PLAIN_CLOCK}", "d-M-yyyy H:mm:ss"),
    (r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-yyyy"),
    (rf"[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}} {PLAIN_CLOCK}", "d.M.yyyy H:mm:ss"),
    (r"[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}", "d.M.yyyy"),
    (rf"[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {PLAIN_CLOCK}", "M/d/yyyy H:mm:ss"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
]
# Cheap test that comes before all shapes.
DATE_START = r"^([0-9]{8}$|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})"

# try_cast also takes Java suffixes such as "1d"; this is the shape of plain numerals.
NUMERAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

YEAR = r"^[0-9]{4}$"


def strip_text(c: str) -> str:
    """Both ends; plain ``trim`` takes spaces only."""
    return f"trim(BOTH {literal(WHITE_SPACE)} FROM {c})"


def null_tokens_to_null(c: str) -> str:
    tokens = ", ".join(literal(t) for t in NULL_TOKENS)
    return f"CASE WHEN lower({strip_text(c)}) IN ({tokens}) THEN NULL ELSE {c} END"


# The functions below read text whose ends are stripped already. Callers strip in a
# projection of its own, so that it happens once per cell and not once per expression.


def is_numeral(c: str) -> str:
    return f"({c} RLIKE {literal(NUMERAL)})"


def to_number(c: str, kind: str = "double") -> str:
    """Null where the text is not a finite numeral of that type."""
    return f"CASE WHEN {is_numeral(c)} THEN try_cast({c} AS {kind}) END"


def date_order(date_format: str) -> str:
    """In which order a format has year (y), month (M) and day (d), as three letters."""
    bare = re.sub(r"'[^']*'", "", date_format)
    return "".join(sorted({x for x in bare if x in "yMd"}, key=bare.index))


# Orders that read one text as two days. A column is read in one of each of these.
RIVAL_ORDERS = (("dMy", "Mdy"), ("yMd", "ydM"))


def date_readings(formats: list[str] | None = None) -> list[tuple[str, ...]]:
    """The ways a column may be read: each the orders that it takes, the first named in the list of formats first."""
    listed = list(dict.fromkeys(date_order(f) for f in formats or [f for _, f in DATE_FORMATS]))
    free = [o for o in listed if not any(o in r for r in RIVAL_ORDERS)]
    out = [tuple(free)]
    for rivals in RIVAL_ORDERS:
        if present := [o for o in listed if o in rivals]:
            out = [(*taken, o) for taken in out for o in present]
    return out


def to_datetime(c: str, formats: list[str] | None = None, orders: tuple[str, ...] | None = None) -> str:
    """Timestamp without zone by the first format that fits, else null. ``formats`` replaces
    the built-in list; of the list only formats with one of ``orders`` are tried, or those of its first reading."""
    orders = orders or date_readings(formats)[0]
    if formats:
        tries = [f"try_to_timestamp({c}, {literal(f)})" for f in formats if date_order(f) in orders]
        return f"CAST(coalesce({', '.join(tries)}) AS timestamp_ntz)"
    tries = [
        f"CASE WHEN {c} RLIKE {literal(f'^{shape}$')} THEN try_to_timestamp({c}, {literal(f)}) END"
        for shape, f in DATE_FORMATS
        if date_order(f) in orders
    ]
    return f"CAST(CASE WHEN {c} RLIKE {literal(DATE_START)} THEN coalesce({', '.join(tries)}) END AS timestamp_ntz)"


def is_integral(c: str) -> str:
    """Digits that a long holds for certain."""
    return f"({c} RLIKE {literal('^[+-]?[0-9]{1,18}$')})"


def is_year(c: str) -> str:
    return f"(CAST({c} AS string) RLIKE {literal(YEAR)})"
