"""String functions over review text, bank and product names.

Java regular expressions are ASCII by default; every whitespace test here uses
``WS``, the exact set of code points Python's ``str.isspace`` accepts, so the
results match the record-at-a-time semantics on Unicode text. The class is
written with ``\\x{..}`` escapes, which both Java regex and RE2 understand.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as defined by Python's str.isspace.
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same set as code-point ranges, for ``translate`` (a per-character map,
# much cheaper on long texts than testing a regex class at every position).
WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))
WS_RUN = f"[{WS}]+"
NON_WS = f"[^{WS}]"
# Word characters as Python's re \w sees them (letters, digits, underscore).
WORD = r"\p{L}\p{N}_"

# Fixed values used by the reference clean-up of bank and product names.
BANK_UNKNOWN = "Unknown"
BANK_CUT_SUFFIX = "а"
BANK_REPLACE = ("Банка", "Банк")
BANK_STOP_WORDS = ["продуктах", "картах", "ипотеке", "вкладах", "кредитах"]
BANK_MARKER = " – отзыв о"
BANK_DELETE = "от"
BANK_PATTERN_CUT_SUFFIX = "е"
BANK_PATTERN_REPLACE = ("банке", "Банк")
PRODUCT_CATEGORIES = [
    ("продуктах", "все продукты"),
    ("дебетовых картах", "дебетовая карта"),
    ("ипотеке", "ипотека"),
    ("вкладах", "вклады"),
    ("кредитах", "кредиты"),
    ("кредитных", "кредитная карта"),
    ("РКО", "РКО"),
    ("Unknown", "все продукты"),
]
TITLE_START = "–"
TITLE_END = "от"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_literal(s: str) -> str:
    """Regex that matches ``s`` literally (Java and RE2)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def strip_ws(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), f"^{WS_RUN}|{WS_RUN}$", "")


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', s).strip()``."""
    return F.trim(F.regexp_replace(_col(c), WS_RUN, " "))


def clean_text(c) -> Column:
    """Drop ``http…`` tokens, collapse whitespace, trim, lower-case; NULL → ''.

    Every Unicode whitespace character is first mapped to a plain space by
    ``translate``; the URL and collapse steps then need only trivial patterns
    (``http[^ ]+`` and runs of two or more spaces), instead of a Unicode
    class tested at every position of a long text.
    """
    t = F.translate(_col(c), WS_CHARS, " " * len(WS_CHARS))
    t = F.regexp_replace(F.regexp_replace(t, "http[^ ]+", ""), " {2,}", " ")
    return F.coalesce(F.lower(F.trim(t)), F.lit(""))


def upper_strip(c) -> Column:
    return strip_ws(F.upper(_col(c)))


def _cut_suffix(c: Column, suffix: str) -> Column:
    """Remove one trailing ``suffix`` if present."""
    if not suffix:
        return c
    return F.when(c.endswith(suffix), c.substr(F.lit(1), F.length(c) - F.lit(len(suffix)))).otherwise(c)


def _remove_words(c: Column, words: Sequence[str]) -> Column:
    for w in words:
        c = F.regexp_replace(c, f"(?iu)(?<![{WORD}]){_java_literal(w)}(?![{WORD}])", "")
    return c


def normalise_bank_unknown(product, fallback=BANK_UNKNOWN, cut_suffix: str = BANK_CUT_SUFFIX,
                           replace: tuple[str, str] = BANK_REPLACE,
                           stop_words: Sequence[str] = BANK_STOP_WORDS) -> Column:
    """Bank name recovered from the product heading (used when bank is unknown).

    Last two whitespace-separated words of ``product`` (one if only one, the
    fallback if none) → cut one trailing ``cut_suffix`` → replace
    ``replace[0]`` by ``replace[1]`` ignoring case → delete stop words at word
    boundaries ignoring case → collapse whitespace.
    """
    p = strip_ws(_col(product))
    words = F.split(p, WS_RUN)
    n = F.when(p == "", F.lit(0)).otherwise(F.size(words))
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    r = (F.when(n >= 2, F.concat_ws(" ", F.slice(words, -2, 2)))
         .when(n == 1, F.element_at(words, 1))
         .otherwise(fb))
    r = _cut_suffix(r, cut_suffix)
    if replace:
        r = F.regexp_replace(r, f"(?iu){_java_literal(replace[0])}", _java_replacement(replace[1]))
    r = _remove_words(r, stop_words)
    return collapse_ws(r)


def normalise_bank_pattern(bank, marker: str = BANK_MARKER, delete: str = BANK_DELETE,
                           cut_suffix: str = BANK_PATTERN_CUT_SUFFIX,
                           replace: tuple[str, str] = BANK_PATTERN_REPLACE) -> Column:
    """Two words after ``marker``; delete every ``delete`` substring; collapse
    whitespace; cut one trailing ``cut_suffix``, else replace ``replace[0]``
    (any case) by ``replace[1]``. No match → the input unchanged; NULL → NULL."""
    b = _col(bank)
    cap = F.regexp_extract(b, f"{_java_literal(marker)}{WS_RUN}({NON_WS}+{WS_RUN}{NON_WS}+)", 1)
    r = collapse_ws(F.replace(cap, F.lit(delete), F.lit("")) if delete else cap)
    r = (F.when(r.endswith(cut_suffix), r.substr(F.lit(1), F.length(r) - F.lit(len(cut_suffix))))
         .otherwise(F.regexp_replace(r, f"(?iu){_java_literal(replace[0])}", _java_replacement(replace[1]))))
    return F.when(cap == "", b).otherwise(r)


def normalise_bank(bank, product, unknown: str = BANK_UNKNOWN, unknown_kw: dict | None = None,
                   pattern_kw: dict | None = None) -> Column:
    """Full bank clean-up: unknown bank → from product; else the title pattern."""
    b, p = _col(bank), _col(product)
    return (F.when((b == unknown) & p.isNotNull(),
                   normalise_bank_unknown(p, fallback=b, **(unknown_kw or {})))
            .when(b.isNull() | (b == unknown), b)
            .otherwise(normalise_bank_pattern(b, **(pattern_kw or {}))))


def categorise_product(c, categories: Sequence[tuple[str, str]] = PRODUCT_CATEGORIES) -> Column:
    """First listed substring contained in the value gives its category; else unchanged."""
    x = _col(c)
    out = None
    for key, value in categories:
        cond = x.contains(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(x)


def extract_between(c, start: str = TITLE_START, end: str = TITLE_END, default: str = BANK_UNKNOWN) -> Column:
    """Text between the first ``start`` and the next ``end``, stripped; else ``default``."""
    t = _col(c)
    s = F.instr(t, start)
    e = F.call_function("locate", F.lit(end), t, s + F.lit(len(start)))
    inner = strip_ws(t.substr(s + F.lit(len(start)), e - s - F.lit(len(start))))
    return F.when((s > 0) & (e > 0), inner).otherwise(F.lit(default))


def parse_digits(c) -> Column:
    """Value of an all-ASCII-digit string (after stripping) as a long, else
    NULL; so is a number beyond 64 bits, which no column here can hold."""
    t = strip_ws(_col(c))
    return F.when(t.rlike(r"^[0-9]+\z"), t.try_cast("bigint"))
