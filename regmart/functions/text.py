"""Text normalization as Column -> Column functions: Spark's own expressions, but for ``nfkc``, which works on Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Damaged sequences and what they stand for, in the order of application.
MOJIBAKE = [
    ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã\u0081", "Á"), ("Ã‰", "É"), ("Ã\u008d", "Í"), ("Ã“", "Ó"), ("Ãš", "Ú"), ("Ã±", "ñ"), ("Ã‘", "Ñ"),
    ("Â", ""), ("贸", "ó"), ("铆", "í"), ("茅", "é"), ("谩", "á"), ("煤", "ú"), ("帽", "ñ"), ("鈥", "-"),
]
# Whole words that the sequences leave wrong.
WORD_FIXES = [("Maritímo", "Marítimo"), ("HOSPITALIZACIóN", "HOSPITALIZACIÓN"), ("HospitalizaciÓn", "Hospitalización")]
#: A text without any of these holds nothing to repair: how damage begins, and the letters of the words.
DAMAGED = "[ÃÂÐÑ" + "".join(sorted({p[0] for p, _ in MOJIBAKE} - set("ÃÂ")) + sorted({c for w, _ in WORD_FIXES for c in w if not c.isascii()})) + "]"
ENTITY_NOISE = ("SOCIEDAD ANONIMA", "S A", "SA")


def _accents() -> list[tuple[str, str]]:
    """By rule, over all code points: letters with accents (U+0300 to U+036F) and their base."""
    pairs = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xA0, 0x30000) if not 0xAC00 <= c < 0xF900)
    return [(c, base[0]) for c, base in pairs if len(base) > 1 and all(0x300 <= ord(x) < 0x370 for x in base[1:])]


ACCENTS = _accents()


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def repair_mojibake(c: Column, drop_circumflex_a: bool = True) -> Column:
    """Undoes UTF-8 read as Latin-1; the re-decoding counts only when its bytes are valid UTF-8."""
    suspicious = c.rlike("Ã.|Â|Ð|Ñ") & c.rlike("^[\\u0000-\\u00ff]*$")
    raw = F.encode(F.when(suspicious, c).otherwise(F.lit("")), "ISO-8859-1").cast("string")
    decoded = F.when(suspicious & F.is_valid_utf8(raw), raw).otherwise(c)
    pairs = [p for p in MOJIBAKE if drop_circumflex_a or p[0] != "Â"]
    sound = (F.octet_length(c) == F.length(c)) | ~c.rlike(DAMAGED)
    return F.when(sound, c).otherwise(replace_all(replace_all(decoded, pairs), WORD_FIXES))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _translate(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.translate(c, "".join(x for x, _ in pairs), "".join(y for _, y in pairs))


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition (null: null). Spark has no such function, so texts go to Python in Arrow batches; callers normalize distinct texts and small dimensions, and the plan holds no tables."""
    return pa.array([x and unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def strip_diacritics(c: Column) -> Column:
    """Letters with accents become their base letter and loose accents (U+0300 to U+036F) go; other scripts' marks stay."""
    return F.regexp_replace(_translate(c, ACCENTS), "[\\u0300-\\u036f]", "")


def normalize_text(c: Column) -> Column:
    return F.upper(collapse(nfkc(repair_mojibake(c))))


def is_plain(c: Column, around: str = "") -> Column:
    """Whether ``normalize_text`` does no more than put the text into capitals: ASCII without white space but single blanks inside. With ``around``, no blank stands beside that separator either."""
    blanks = ["  ", "\t", "\n", "\x0b", "\f", "\r", *([f" {around}", f"{around} "] if around else [])]
    return reduce(lambda x, y: x & ~y, [*[c.contains(b) for b in blanks], c.startswith(" "), c.endswith(" ")], F.octet_length(c) == F.length(c))


def _separators(c: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(F.upper(c), r"[/\\|]+", " "), r"[().,]+", " "))


def normalize_alias(c: Column) -> Column:
    return _separators(strip_diacritics(nfkc(repair_mojibake(c))))


def normalize_format_only(c: Column) -> Column:
    return _separators(nfkc(repair_mojibake(c)))


def normalize_entity_alias(c: Column, noise: tuple[str, ...] = ENTITY_NOISE) -> Column:
    out = reduce(lambda x, w: F.regexp_replace(x, rf"\b{w}\b", " "), noise, normalize_alias(c))
    return collapse(F.regexp_replace(out, r"\bCIA\b", "COMPANIA"))


def normalize_header_key(c: Column) -> Column:
    return collapse(F.regexp_replace(normalize_text(c), r"[.,;:()\-_/]", " "))


def slug_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(strip_diacritics(normalize_text(c))), r"[^a-z0-9\s-]", "")), r"[\s-]+", "-")


def sanitize_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^a-zA-Z0-9._-]", "_")


def required_normalization(strategy: Column, c: Column) -> Column:
    return F.when(strategy.startswith("direct"), False).when(strategy.startswith("normalized"), True).otherwise((repair_mojibake(c) != c) | (normalize_format_only(c) != c))
