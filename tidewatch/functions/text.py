"""Accent and punctuation folding built from native string expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_JAMO_L, _JAMO_V, _JAMO_T = 0x1100, 0x1161, 0x11A7
_N_V, _N_T = 21, 28
#: Any character from the first combining mark (U+0300) on.
_ABOVE_LATIN = r"[^\x{0}-\x{2ff}]"


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose canonical decomposition, without marks, differs from them."""
    single: dict[str, str] = {}
    longer: dict[str, str] = {}
    for cp in range(0x80, 0x30000):
        if _HANGUL_FIRST <= cp <= _HANGUL_LAST or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if nfd == ch:
            continue
        base = "".join(c for c in nfd if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            single[ch] = base
        elif len(base) > 1 and unicodedata.category(ch)[0] == "L":
            longer[ch] = base  # marks and symbols end up as a space either way
    return "".join(single), "".join(single.values()), longer


def _split_hangul(text: Column) -> Column:
    """Hangul syllables to their Jamo, as canonical decomposition does."""

    def jamo(start: int, count: int) -> Column:
        return F.array(*[F.lit(chr(start + i)) for i in range(count)])

    def one(ch: Column) -> Column:
        offset = F.ascii(ch) - F.lit(_HANGUL_FIRST)
        lead = F.floor(offset / (_N_V * _N_T)).cast("int")
        vowel = F.floor(F.pmod(offset, F.lit(_N_V * _N_T)) / _N_T).cast("int")
        tail = F.pmod(offset, F.lit(_N_T)).cast("int")
        parts = F.concat(
            F.get(jamo(_JAMO_L, 19), lead),
            F.get(jamo(_JAMO_V, _N_V), vowel),
            F.when(tail > 0, F.get(jamo(_JAMO_T, _N_T), tail)).otherwise(""),
        )
        return F.when(ch.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), parts).otherwise(ch)

    return F.when(
        text.rlike(f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]"),
        F.array_join(F.transform(F.split(text, ""), one), ""),
    ).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without combining marks; letters such as đ stay.

    One translation settles composed letters.  Only texts that still hold
    marks, Hangul or a letter with several parts pay for the rest.  None of
    these lies below the first combining mark, which most texts stay below.
    """
    source, target, longer = _decompositions()
    folded = F.translate(text, source, target)
    rare = rf"[\p{{Mn}}{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}{''.join(longer)}]"
    expanded = folded
    for ch, base in longer.items():
        expanded = F.replace(expanded, F.lit(ch), F.lit(base))
    unmarked = F.regexp_replace(_split_hangul(expanded), r"\p{Mn}+", "")
    return F.when(folded.rlike(_ABOVE_LATIN) & folded.rlike(rare), unmarked).otherwise(folded)


def normalize_description(text: Column | str) -> Column:
    """Lower case, no accents, words separated by single spaces; NULL gives ''."""
    c = F.col(text) if isinstance(text, str) else text
    words = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(words, r"[^\p{L}\p{N}_]+", " "))


def fold_for_matching(text: Column | str) -> Column:
    """Accent-free lower case with đ as d, used for chat phrases."""
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.translate(strip_accents(F.coalesce(c, F.lit(""))), "đĐ", "dD"))
