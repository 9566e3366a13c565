"""Sizes in tokens of a public tokenizer.

The vocabulary file is a parameter (``TOKENIZER_FILE``), read where a task runs
and never copied.  Texts that occur in one batch more than once are counted once.
Long texts go to the tokenizer in parts of about ``PIECE`` characters, cut only
where the split pattern itself always cuts, so the count is that of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_FILE = os.environ.get("QUIREWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pattern that splits text before this vocabulary's merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 200_000  # characters handed to the tokenizer at once, or up to the next place where the pattern cuts
# The pattern never matches across these places: white space after anything else, and a change between letters,
# numbers and marks, but for the apostrophe before letters.  What comes before such a place is matched alike without the rest.
CUT = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\r\t])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")

_loaded: dict = {}


def encoder(path: str = TOKENIZER_FILE):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        m = CUT.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count(text: str | None, path: str = TOKENIZER_FILE) -> int:
    """Tokens of a text, 0 for null."""
    if not text:
        return 0
    enc = encoder(path)
    return sum(len(enc.encode_ordinary(part)) for part in parts(text))


def sized(df: DataFrame, text: str, out: str = "tokens", path: str = TOKENIZER_FILE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) with the size of ``text``."""
    kept = keep if keep is not None else [c for c in df.columns if c not in (text, out)]
    names = [*kept, out]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            seen: dict = {}
            sizes = []
            for t in batch.column(len(kept)).to_pylist():
                n = seen.get(t)
                if n is None:
                    n = seen[t] = count(t, path)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64())], names=names)

    source = df.select(*kept, F.col(text).alias("__text"))
    return source.mapInArrow(run, df.select(*kept).withColumn(out, F.lit(0).cast("long")).schema)


def encoded(text: str | None, path: str = TOKENIZER_FILE) -> list[int]:
    """The tokens of a text, none for null."""
    return [t for part in parts(text) for t in encoder(path).encode_ordinary(part)] if text else []


def chunks(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50, path: str = TOKENIZER_FILE) -> DataFrame:
    """``(key, pos, n_tokens, chunk)``: windows of ``size`` tokens, each ``size - overlap`` after the last.

    The tail window is given out even where it lies inside the one before.  A
    window that begins or ends within a character shows the replacement character
    there.  Null and empty texts have no chunk; repeated rows repeat theirs.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    schema = df.select(key).withColumns({"pos": F.lit(0), "n_tokens": F.lit(0), "chunk": F.lit("")}).schema

    def run(batches: Iterator) -> Iterator:
        enc = encoder(path)
        for batch in batches:
            for i, body in enumerate(batch.column(1).to_pylist()):
                all_ = encoded(body, path)
                cut = [all_[at : at + size] for at in range(0, len(all_), size - overlap)]
                if not cut:
                    continue
                shown = pa.array([enc.decode(c) for c in cut], pa.string())
                sizes = pa.array([len(c) for c in cut], pa.int32())
                keys = batch.column(0).take(pa.array([i] * len(cut), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(cut)), pa.int32()), sizes, shown], names=schema.names)

    return df.select(key, text).where(F.length(text) > 0).mapInArrow(run, schema)
