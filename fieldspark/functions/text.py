"""Column functions on text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_tables() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from canonical decomposition."""
    src, dst = [], []
    for first, last in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for point in range(first, last + 1):
            char = chr(point)
            parts = unicodedata.normalize("NFD", char)
            base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
            if len(parts) > 1 and len(base) == 1:
                src.append(char)
                dst.append(base)
    marks = [chr(p) for p in range(0x0300, 0x0370) if unicodedata.category(chr(p)) == "Mn"]
    return "".join(src + marks), "".join(dst)


_ACCENTED, _PLAIN = _accent_tables()


def strip_accents(col: Column) -> Column:
    return F.translate(col, _ACCENTED, _PLAIN)


def norm_text(col: Column) -> Column:
    """Trimmed of any white space, upper case, without accents; null counts as empty."""
    return strip_accents(F.upper(F.btrim(F.coalesce(col, F.lit("")), F.lit(" \t\n\r\f"))))


def blank_to_null(col: Column) -> Column:
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string (blanks count as values)."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def strip_irrigation_suffix(col: Column) -> Column:
    """Crop name without its irrigation mark, in brackets or at the end, with or without accent."""
    bracketed = F.regexp_replace(col, r"(?i)\s*[(\[]\s*(?:regad[íi]o|secano|riego|irrigado)\s*[)\]]", "")
    trailing = F.regexp_replace(F.trim(bracketed), r"(?i)\s+(?:regad[íi]o|secano)\s*$", "")
    return F.trim(trailing)


def fix_mojibake(col: Column) -> Column:
    """UTF-8 text that was once read as Latin-1; untouched unless both steps succeed."""
    latin = F.when(col.rlike(r"^[\u0000-ÿ]*$"), col)
    repaired = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.coalesce(repaired, col)


def phone_es(col: Column) -> Column:
    """``+34#########`` from the three accepted spellings, else null."""
    kept = F.regexp_replace(col, r"[^\d+]", "")
    after_plus = F.regexp_replace(F.regexp_replace(kept, r"^\+34", ""), r"\D", "")
    return (
        F.when(kept.startswith("+34"), F.when(F.length(after_plus) == 9, F.concat(F.lit("+34"), after_plus)))
        .when(kept.startswith("34") & (F.length(kept) == 11), F.concat(F.lit("+34"), F.substring(kept, 3, 9)))
        .when(F.length(kept) == 9, F.concat(F.lit("+34"), kept))
    )


def pad_code(col: Column, width: int) -> Column:
    """Left zero padding that never cuts longer codes."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def numeric_text_rank(col: Column) -> Column:
    """Sort key: numeric codes by value, anything else last."""
    return F.when(col.rlike(r"^[0-9]+$"), col.try_cast("int")).otherwise(F.lit(999999))


def capped(col: Column, width: int) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, width)
