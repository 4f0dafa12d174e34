"""Text helpers with the semantics of the chat parser, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the parser counts as white space (wider than Java's \s).
WS = r"\t\n\x0B\f\r    -     　﻿"
# Marks without width that exports and editors put into texts.
INVISIBLE = r"­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿"


def js_trim(c: Column) -> Column:
    """Strip the wide white space class at both ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def remove_first(c: Column, needle: str) -> Column:
    """Remove the first occurrence of a plain string, leaving later ones."""
    at = F.instr(c, needle)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(needle), F.length(c)))).otherwise(c)


def is_ascii(c: Column) -> Column:
    """As many bytes as characters: such texts need no pass for marks or accents."""
    return F.octet_length(c) == F.length(c)


def strip_invisible(c: Column) -> Column:
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(c, f"[{INVISIBLE}]", ""))


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by the rule of canonical decomposition."""
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            src.append(chr(cp))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_SRC, _DST = _fold_table()


def fold_accents(c: Column) -> Column:
    """Base letters for accented Latin letters, composed or with combining marks."""
    return F.when(is_ascii(c), c).otherwise(F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), _SRC, _DST))


def sender_key(c: Column) -> Column:
    """One key for all spellings of a sender: case, accents, spacing, invisible marks and the
    tilde of unsaved numbers don't count. Null or blank gives null."""
    t = fold_accents(strip_invisible(c))
    t = F.regexp_replace(F.lower(t), rf"[~{WS}]+", " ")
    t = F.trim(t)
    return F.when(t == "", None).otherwise(t)


def fold_py(s: str) -> str:
    """The Python twin of fold_accents plus lower case, for bounded tables and tests."""
    out = unicodedata.normalize("NFD", s)
    return "".join(ch for ch in out if not unicodedata.combining(ch)).casefold()
