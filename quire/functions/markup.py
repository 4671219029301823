"""XML escaping, identifiers, numerals, dates and normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Letters that ligatures stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Fixed value: code points that XML 1.0 forbids.
INVALID_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def escape_xml(text: Column) -> Column:
    out = F.regexp_replace(text, INVALID_XML, "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def roman(text: Column) -> Column:
    """Value of a small roman numeral, null for anything else."""
    value = F.create_map(*(x for c, v in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in (F.lit(c), F.lit(v))))
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: value[c])
    following = F.concat(F.slice(digits, 2, 64), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(digits, following, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(text.rlike("^[ivxlcdm]+$"), total)


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` with an optional zone, any tail missing; UTC."""
    parts = [F.regexp_extract(text, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?", k) for k in range(1, 7)]
    full = [F.when(p == "", d).otherwise(p) for p, d in zip(parts, ("", "01", "01", "00", "00", "00"), strict=True)]
    at = F.try_to_timestamp(F.concat(*full), F.lit("yyyyMMddHHmmss"))
    zone = [F.regexp_extract(text, r"([+-])(\d{2})'?(\d{2})?'?$", k) for k in (1, 2, 3)]
    minutes = F.coalesce(zone[1].try_cast("int"), F.lit(0)) * 60 + F.coalesce(zone[2].try_cast("int"), F.lit(0))
    return F.timestamp_seconds(F.unix_seconds(at) - F.when(zone[0] == "-", -1).otherwise(1) * F.when(zone[0] == "", 0).otherwise(minutes) * 60)


def nfc(text: Column) -> Column:
    """Composed form; Spark has no expression for it."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return composed(text)


def normalise_text(text: Column) -> Column:
    """Ligatures as letters, soft hyphens and zero-width marks out, composed, runs of spaces as one, no spaces at the end."""
    out = text
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    out = F.regexp_replace(out, "[\u00ad\ufeff\u200b]", "")
    return F.rtrim(F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, "[ \t\n]+", " ")).otherwise(out))
