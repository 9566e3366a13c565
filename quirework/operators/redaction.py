"""Pattern matches of personal data: spans that do not overlap, and replacement by type.

Spans are found and replaced on the cleaned text.  Of overlapping spans the one
that starts first is kept, at equal starts the shorter, at equal ends the type
listed first.  Keeping spans is a fold along one text, so a text is handled by a
small helper inside Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import PII_PATTERNS, clean

# Replacement of each type.
TOKENS = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "ssn": "[SSN]",
    "credit_card": "[CREDIT_CARD]",
    "ip_address": "[IP]",
    "date": "[DATE]",
    "passport": "[PASSPORT]",
    "bitcoin_address": "[BITCOIN]",
    "ethereum_address": "[ETH]",
}
_COMPILED = {n: re.compile(p, re.IGNORECASE) for n, p in PII_PATTERNS.items()}


def spans(text: str) -> list[tuple[str, int, int]]:
    found = sorted(((m.start(), m.end(), i, n) for i, (n, p) in enumerate(_COMPILED.items()) for m in p.finditer(text)), key=lambda s: s[:3])
    kept, end = [], 0
    for a, b, _, name in found:
        if a >= end and b > a:
            kept.append((name, a, b))
            end = b
    return kept


def redacted(text: str, tokens: dict[str, str], found: list[tuple[str, int, int]] | None = None) -> str:
    """``text`` with its spans, or those given in order, replaced."""
    out, at = [], 0
    for name, a, b in spans(text) if found is None else found:
        out += [text[at:a], tokens.get(name, f"[REDACTED:{name}]")]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, key: str, text: str, custom: dict[str, str] | None = None) -> DataFrame:
    """``(key, redacted, matches)``; null texts are empty ones."""
    tokens = {**TOKENS, **(custom or {})}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t) for t in texts]
            clean_texts = [redacted(t, tokens, f) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(clean_texts, pa.string()), pa.array([len(f) for f in found], pa.int32())],
                names=[key, "redacted", "matches"],
            )

    schema = df.select(key).withColumns({"redacted": F.lit(""), "matches": F.lit(0)}).schema
    return df.select(key, clean(F.col(text)).alias("t")).mapInArrow(run, schema)
