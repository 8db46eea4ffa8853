"""Names, replies, times and other strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a folder scan takes, and what counts as the one and the other half of a twin pair.
SCANNED = (".jpg", ".jpeg", ".png", ".heic", ".webp")
JPEG, HEIC = (".jpg", ".jpeg"), (".heic", ".heif")
TWIN_CHARS = 15


def suffix(name: Column) -> Column:
    """The last dot and what follows, lower-cased; empty if there is none or only a leading one."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def twin_key(stem_: Column) -> Column:
    return F.substring(stem_, 1, TWIN_CHARS)


def capture_time(*raw: Column) -> Column:
    """The first of the raw strings, in order, that reads as `Y:m:d H:M:S` or `Y-m-d H:M:S`; no zone."""
    read = [F.try_to_timestamp(r, F.lit(p)) for r in raw for p in ("y:M:d H:m:s", "y-M-d H:m:s")]
    return F.coalesce(*read).cast("timestamp_ntz")


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def shown(time: Column) -> Column:
    """As a person reads it."""
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def reply(text: Column) -> Column:
    """struct<score, reason> of a model's reply: its first brace-free {...} as JSON, score as a whole number from 0 to 100.

    A whole number in a string counts, a fraction in one does not; a bare fraction is cut, true is 1. No JSON: 0 and the
    first 120 characters of the text.
    """
    plain = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(plain, r"(?s)(\{[^{}]*\})", 1)
    parsed = F.try_parse_json(F.when(found != "", found))
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.score", "variant"))
    raw = F.try_variant_get(parsed, "$.score", "string")
    whole = (
        F.when(kind == "STRING", F.when(F.trim(raw).rlike(r"^[+-]?[0-9]+$"), F.trim(raw).try_cast("decimal(38,0)")))
        .when(kind == "BOOLEAN", F.when(raw == "true", F.lit(1)).otherwise(F.lit(0)).cast("decimal(38,0)"))
        .otherwise(F.when(raw.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), F.signum(raw.try_cast("double")) * F.floor(F.abs(raw.try_cast("double")))).try_cast("decimal(38,0)"))
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(whole, F.lit(0).cast("decimal(38,0)")))).cast("int")
    reason = F.substring(F.trim(F.coalesce(F.try_variant_get(parsed, "$.reason", "string"), F.lit(""))), 1, 200)
    bad = parsed.isNull()
    return F.struct(F.when(bad, F.lit(0)).otherwise(score).alias("score"), F.when(bad, F.substring(F.trim(plain), 1, 120)).otherwise(reason).alias("reason"))


def padded(number: Column, width: Column) -> Column:
    """Zeros before a number up to a width; longer ones stay whole."""
    said = number.cast("string")
    return F.lpad(said, F.greatest(width.cast("int"), F.length(said)), F.lit("0"))


def rolling_hash(text: Column) -> Column:
    """The 31-multiplier hash of the characters, modulo 2**32."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % F.lit(4294967296)))


def label_signature(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), "|")
