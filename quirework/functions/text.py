"""Column functions over text.  Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t\r\n\f]+"

# Detection patterns, case-insensitive, in the order in which they are tried.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\+?(?:\d{1,4}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}",
    "ssn": r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b|\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "date": r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
    "bitcoin_address": r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b",
    "ethereum_address": r"\b0x[a-fA-F0-9]{40}\b",
}
# Citation patterns that need no look-behind.
CITATION_PATTERNS = {
    "direct_quote": r"\"([^\"]+)\"",
    "inline_reference": r"(?i)(?:see|refer to|as shown in|as described in)\s+(?:section|chapter)?\s*([^.,\"]+)",
    "numbered_reference": r"\[(\d+)\]|\((\d+)\)",
    "author_year": r"\(([^)]+?,\s*\d{4}(?:-\d{4})?)\)",
    "url": r"https?://\S+|www\.\S+",
}

# All citation families of the reference, curly quotes and quoted sections included.
CITATION_FAMILIES = {
    **CITATION_PATTERNS,
    "direct_quote": r"\"([^\"]+)\"|\u201C([^\u201D]+)\u201D",
    "inline_reference": r"(?i)(?:see|refer to|as shown in|as described in)\s+(?:section|chapter)?\s*\"?([^.,\"]+)\"?",
    "footnote": r"(?:(?<=[^0-9])|^)\[(\d+)\]|\{\^(\d+)\}",
}


def clean(text: Column) -> Column:
    """Runs of white space become one blank, outer ones go; null becomes the empty text."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))


def word_count(text: Column) -> Column:
    """Words of the cleaned text, 0 for null and blank."""
    cleaned = clean(text)
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def chunks_by_chars(df: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """``(key, pos, chunk)``: windows of ``size`` characters, each ``size - overlap`` after the last.

    The tail window is given out even where it lies inside the one before.
    Null and empty texts have no chunk; ``overlap`` must be below ``size``.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.ceil(F.length(text) / step).cast("int") - 1)
    body = df.where(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("pos", "nth"))
    return body.select(key, "pos", F.substring(F.col(text), F.col("nth") * step + 1, F.lit(size)).alias("chunk"))


def chunks_by_words(df: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """``(key, pos, chunk)``: windows of ``size`` words; the last window is the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    words = df.select(key, F.split(clean(F.col(text)), " ").alias("w"), clean(F.col(text)).alias("c")).where("c != ''").select(key, "w")
    windows = F.when(F.size("w") <= size, 1).otherwise(F.ceil((F.size("w") - size) / step).cast("int") + 1)
    cut = words.select(key, "w", F.explode(F.sequence(F.lit(0), windows - 1)).alias("pos"))
    return cut.select(key, "pos", F.array_join(F.slice("w", F.col("pos") * step + 1, size), " ").alias("chunk"))


def pattern_counts(text: Column) -> dict[str, Column]:
    """Matches of each personal-data pattern."""
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}")) for name, p in PII_PATTERNS.items()}


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash, parameters, query or fragment."""
    bare = F.regexp_replace(url, r"[;?#].*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    return F.concat(head, F.regexp_replace(F.substring(bare, F.length(head) + 1, F.lit(100000)), r"/+$", ""))


def valid_url(url: Column) -> Column:
    """http or https, a host, no blanks, no doubled slash in the path."""
    return F.coalesce(url.rlike(r"^https?://[^/\s]+(/[^/\s]+)*/?$"), F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of a text."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(raw, 1, 8),
        F.substring(raw, 9, 4),
        F.concat(F.lit("5"), F.substring(raw, 14, 3)),
        F.concat(variant, F.substring(raw, 18, 3)),
        F.substring(raw, 21, 12),
    )


def to_int(value: Column) -> Column:
    """Whole part of a number in a text, null if there is none."""
    return F.btrim(value).try_cast("double").try_cast("int")


def duration(seconds: Column) -> Column:
    """``1h 2m 3s``, leaving out leading zero parts; ``unknown`` for null, zero and below."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    parts = F.concat(
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "))).otherwise(""),
        F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m "))).otherwise(""),
        (s % 60).cast("string"),
        F.lit("s"),
    )
    return F.when(seconds > 0, parts).otherwise("unknown")


def leading_summary(text: Column, words: int) -> Column:
    """Whole leading sentences up to ``words`` words, at least the first one."""
    sentences = F.filter(F.split(clean(text), r"(?<=[.!?]) "), lambda s: s != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(acc: Column, s: Column) -> Column:
        n = F.size(F.split(s, " "))
        fits = acc["open"] & ((acc["n"] == 0) | (acc["n"] + n <= words))
        return F.struct(
            F.when(fits, F.concat(acc["out"], F.when(acc["n"] > 0, " ").otherwise(""), s)).otherwise(acc["out"]).alias("out"),
            F.when(fits, acc["n"] + n).otherwise(acc["n"]).alias("n"),
            fits.alias("open"),
        )

    return F.aggregate(sentences, start, take, lambda acc: acc["out"])
