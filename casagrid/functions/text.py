"""Text folding and keys as native column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from casagrid.functions.numbers import col

# Characters whose wrongly decoded forms are repaired.
RECOVERABLE = "ÁÉÍÓÚÜÑáéíóúüñ°º²×–—‘’“”…·"

# Cheap test for text that can hold a wrongly decoded sequence; plain text skips the replacements.
MOJIBAKE_MARK = "[ÂÃâ]"


@lru_cache(maxsize=1)
def mojibake_pairs() -> tuple[tuple[str, str], ...]:
    """UTF-8 read as Latin-1 / CP1252, once or twice, longest first."""
    found: dict[str, str] = {}
    for char in RECOVERABLE:
        for codec in ("latin-1", "cp1252"):
            text = char
            for _ in range(2):
                try:
                    text = text.encode("utf-8").decode(codec)
                except UnicodeDecodeError:
                    break
                found[text] = char
    return tuple(sorted(found.items(), key=lambda item: -len(item[0])))


HANGUL = range(0xAC00, 0xD7A4)


def plain_letters(char: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))


@lru_cache(maxsize=1)
def decompositions() -> tuple[dict[str, str], dict[str, str], str]:
    """Characters with one plain letter, those with several or none, and the combining marks; all of Unicode.

    Hangul syllables, which decompose by arithmetic, are in neither table.
    """
    one, several, marks = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        if code in HANGUL or 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
        elif (plain := plain_letters(char)) != char:
            (one if len(plain) == 1 else several)[char] = plain
    return one, several, "".join(marks)


def char_class(chars: str) -> str:
    """A pattern for any of ``chars``, none of them ASCII; runs of neighbours as ranges.

    The matcher tries the ranges one by one, so plain letters are told apart before.
    """
    codes, runs = sorted(map(ord, chars)), []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return r"[\x{80}-\x{10FFFF}&&[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]]"


@lru_cache(maxsize=1)
def mark_class() -> str:
    return char_class(decompositions()[2])


@lru_cache(maxsize=1)
def several_class() -> str:
    return char_class("".join(decompositions()[1]) + "".join(map(chr, HANGUL)))


def hangul_letters(c: Column) -> Column:
    """The two or three letters of one Hangul syllable."""
    place = F.ascii(c) - HANGUL.start
    codes = F.array(place.cast("long") / 588 + 0x1100, F.pmod(place, F.lit(588)) / 28 + 0x1161, F.when(F.pmod(place, F.lit(28)) > 0, F.pmod(place, F.lit(28)) + 0x11A7))
    units = F.transform(F.array_compact(codes), lambda n: F.lpad(F.hex(F.floor(n)), 4, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-16BE")


def expand_several(c: Column) -> Column:
    """Every character that decomposes into several letters, or none, replaced; each that occurs is looked up once."""
    table = decompositions()[1]
    known = F.from_json(F.lit(json.dumps(list(table))), "array<string>")
    plain = F.from_json(F.lit(json.dumps(list(table.values()))), "array<string>")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({several_class()})")))

    def letters(x: Column) -> Column:
        return F.when(F.ascii(x).between(HANGUL.start, HANGUL.stop - 1), hangul_letters(x)).otherwise(F.element_at(plain, F.array_position(known, x).cast("int")))

    return F.when(c.rlike(several_class()), F.reduce(found, c, lambda acc, x: F.replace(acc, x, letters(x)))).otherwise(c)


def replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Apply the replacements in order as one fold over a constant array, which keeps generated code small."""
    rules = F.from_json(F.lit(json.dumps(pairs)), "array<array<string>>")
    return F.reduce(rules, c, lambda acc, r: F.replace(acc, r[0], r[1]))


def repair_mojibake(c: Column | str) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c.rlike(MOJIBAKE_MARK), replace_all(c, mojibake_pairs())).otherwise(c)


def strip_marks(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks, for every character of Unicode."""
    one = decompositions()[0]
    out = F.translate(expand_several(col(c)), "".join(one), "".join(one.values()))
    return F.when(col(c).rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, mark_class() + "+", "")).otherwise(col(c))


def fold_plain(c: Column | str) -> Column:
    return F.lower(strip_marks(F.coalesce(col(c), F.lit(""))))


def fold_text(c: Column | str) -> Column:
    return fold_plain(repair_mojibake(c))


def squeeze(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def normalize_whitespace(c: Column | str) -> Column:
    return squeeze(repair_mojibake(c))


def text_key(c: Column | str) -> Column:
    """Letters and digits only, for joins between differently written names."""
    return F.regexp_replace(fold_plain(c), "[^a-z0-9]+", "")


def snake_key(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_plain(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.btrim(col(c), F.lit(chars))


FIELD_BREAK = "\u0001"


def search_text(*columns: Column | str) -> Column:
    """Folded words separated by single blanks; a blank also leads, so a prefix test is ``contains``."""
    parts = [fold_text(c) for c in columns]
    joined = F.concat_ws(f" {FIELD_BREAK} ", *parts)
    return F.concat(F.lit(" "), F.regexp_replace(joined, rf"[^\p{{L}}\p{{N}}{FIELD_BREAK}]+", " "))


def fold_literal(text: str) -> str:
    """Driver-side twin of :func:`fold_text` for query strings."""
    for old, new in mojibake_pairs():
        text = text.replace(old, new)
    return plain_letters(text).lower()


def contains_folded(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | c.contains(word)
    return out


def rlike_any(c: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return c.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
