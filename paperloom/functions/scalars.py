"""Column expressions of question and export rules; all run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"

# Question types and difficulties in declaration order (fixed values).
QUESTION_TYPES = ("single_choice", "multiple_choice", "true_false", "blank", "short_answer", "essay")
DIFFICULTIES = ("easy", "medium", "hard")

# Accented Latin letters fold to their base letter; made by rule, not listed.
_FOLD = {
    chr(c): unicodedata.normalize("NFD", chr(c))[0]
    for c in range(0xC0, 0x250)
    if len(unicodedata.normalize("NFD", chr(c))) > 1
}


def rank_of(col: Column, order: tuple[str, ...]) -> Column:
    """Place of a closed value in its declaration order; null for other values."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), col), F.lit(0)) - 1


def trim_all(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def fold(col: Column) -> Column:
    """Lower case without Latin diacritics; a text of bytes alone has none."""
    low = F.lower(col)
    return F.when(F.octet_length(col) == F.length(col), low).otherwise(F.translate(low, "".join(_FOLD), "".join(_FOLD.values())))


def unique_strings(items: Column) -> Column:
    """Trimmed, non-blank, distinct strings in first order."""
    return F.array_distinct(F.filter(F.transform(items, trim_all), lambda x: x != ""))


def parse_list(raw: Column) -> Column:
    """A JSON array's strings, else the parts between ; , or |; trimmed, non-blank, distinct."""
    text = F.coalesce(raw, F.lit(""))
    parts = F.split(text, "[;,|]")
    as_json = F.from_json(text, "array<string>")
    return unique_strings(F.when(F.ltrim(text).startswith("["), F.coalesce(as_json, parts)).otherwise(parts))


def tri_bool(raw: Column) -> Column:
    """true/1/yes/y, false/0/no/n in any case, else null."""
    x = F.lower(trim_all(raw))
    return F.when(x.isin("true", "1", "yes", "y"), True).when(x.isin("false", "0", "no", "n"), False)


def has_math(col: Column) -> Column:
    """Whether a text holds two dollar signs."""
    return F.coalesce(F.length(col) - F.length(F.replace(col, F.lit("$"), F.lit(""))) >= 2, F.lit(False))


def score_weight(raw: Column) -> Column:
    """Canonical DECIMAL(8,4) text of a plain positive decimal, null when invalid."""
    x = trim_all(raw)
    ok = x.rlike(r"^[0-9]+(\.[0-9]{0,4})?$")
    value = F.when(ok, F.regexp_replace(x, r"\.$", "")).try_cast("decimal(38,4)")
    inside = (value >= F.lit("0.0001").cast("decimal(38,4)")) & (value <= F.lit("9999.9999").cast("decimal(38,4)"))
    return F.when(inside, F.regexp_replace(value.cast("string"), r"\.?0+$", ""))


def import_weight(raw: Column) -> Column:
    """Number clamped to 0.01..100 with four decimals; 1 for zero and what is no number."""
    x = raw.try_cast("double")
    x = F.when(x.isNull() | F.isnan(x) | x.isin(0.0, float("inf"), float("-inf")), F.lit(1.0)).otherwise(x)
    return F.format_string("%.4f", F.least(F.greatest(x, F.lit(0.01)), F.lit(100.0)))


def bounded_int(raw: Column, fallback: int, low: int, high: int) -> Column:
    """Truncated and clamped; the fallback for what is no finite number."""
    x = raw.try_cast("double")
    cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)
    return F.when(usable, F.least(F.greatest(cut, F.lit(low)), F.lit(high))).otherwise(fallback).cast("int")


def is_canonical_decimal(col: Column) -> Column:
    """No sign, exponent, leading or trailing zeros."""
    return F.coalesce(col.rlike(r"^(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$"), F.lit(False))


def bounded_decimal(col: Column, precision: int, scale: int, least: str) -> Column:
    """The canonical decimal within precision, scale and minimum, else null."""
    value = F.when(is_canonical_decimal(col) & col.rlike(rf"^[0-9]+(\.[0-9]{{1,{scale}}})?$"), col).try_cast(
        f"decimal({precision},{scale})"
    )
    return F.when(value >= F.lit(least).cast(f"decimal({precision},{scale})"), value)


def safe_filename(title: Column, extension: str, default: str = "paper") -> Column:
    """Forbidden and control characters as spaces, runs collapsed, 80 characters at most."""
    x = F.regexp_replace(title, r'[<>:"/\\|?*\p{Cntrl}]', " ")
    x = F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 80)
    return F.concat(F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default)), F.lit(f".{extension}"))


def attachment_errors(filename: Column, media_type: Column) -> Column:
    """What a file name or a media type breaks: a bare name of 1 to 255 bytes, and a lower-case type/subtype of 3 to 127."""
    name = F.octet_length(filename).between(1, 255) & ~filename.rlike(r"[/\\\p{Cntrl}]") & ~filename.isin(".", "..")
    kind = F.octet_length(media_type).between(3, 127) & media_type.rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$")
    bad = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
    return F.filter(F.array(bad(name, "filename is invalid"), bad(kind, "mediaType is invalid")), lambda e: e.isNotNull())


def safe_archive_path(path: Column) -> Column:
    """Whether an archive member stays in its folder: relative, forward slashes, no empty, . or .. part, no drive or control character."""
    parts = F.split(path, "/")
    ok = ~path.rlike(r"[\\:\p{Cntrl}]") & ~F.exists(parts, lambda x: x.isin("", ".", ".."))
    return F.coalesce(ok, F.lit(False))


def media_extension(media_type: Column) -> Column:
    """File extension of an image media type; null for others."""
    kinds = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp"}
    out = F.lit(None).cast("string")
    for kind, ext in kinds.items():
        out = F.when(media_type == kind, ext).otherwise(out)
    return out


def xml_escape(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def option_label(index: Column) -> Column:
    """A, B, C ... from 0."""
    return F.chr(index + 65)


def density(n_items: Column) -> Column:
    return F.when(n_items >= 24, "dense").when(n_items >= 14, "compact").otherwise("normal")


def error_code(code: Column) -> Column:
    """A code of A-Z 0-9 _ up to 128 characters, else SYNC_REMOTE_FAILURE; null stays."""
    return F.when(code.isNull(), None).when(code.rlike("^[A-Z0-9_]{1,128}$"), code).otherwise("SYNC_REMOTE_FAILURE")


def backoff_micros(attempt: Column) -> Column:
    """2 ^ min(attempt - 1, 8) seconds."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(attempt - 1, F.lit(8)).cast("int")) * 1_000_000
