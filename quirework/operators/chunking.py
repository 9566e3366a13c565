"""Block-aware chunkers.

A text is a run of lines whose kind (code, list, table, prose) decides where it
may be cut; that is a fold over lines, so one document is chunked by a small
Python helper inside Arrow batches, whole texts at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in words.
LEAST, MOST, OVERLAP = 25, 100, 5
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def line_kind(line: str, in_code: bool) -> str:
    s = line.strip()
    if in_code or s.startswith("```"):
        return "code"
    if not s:
        return "blank"
    if s.startswith("|") or s.count("|") >= 2:
        return "table"
    return "list" if _LIST.match(line) else "prose"


def blocks(text: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of maximal runs of lines of one kind; blank lines end prose, lists and tables."""
    out: list[tuple[str, list[str]]] = []
    in_code, open_ = False, False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        kind = line_kind(line, in_code)
        if kind == "blank":
            open_ = False
            continue
        fence = line.strip().startswith("```")
        if open_ and out and out[-1][0] == kind and not (kind == "code" and fence and not in_code):
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
        open_ = True
        if fence:
            in_code = not in_code
            open_ = in_code
    return [(k, "\n".join(lines)) for k, lines in out]


def split_large(text: str, most: int, overlap: int, least: int) -> list[str]:
    """Windows of ``most`` words; a last piece under ``least`` words joins the one before."""
    words = text.split()
    if len(words) <= most:
        return [text]
    step, out = most - overlap, []
    for at in range(0, len(words), step):
        piece = words[at : at + most]
        if out and len(piece) < least:
            out[-1] = " ".join([*out[-1].split(" "), *piece[overlap:]])
        else:
            out.append(" ".join(piece))
        if at + most >= len(words):
            break
    return out


def sentences(text: str, most: int) -> list[str]:
    """Sentences packed to at most ``most`` words; a longer sentence stays whole."""
    out, n = [], 0
    for s in _SENTENCE.split(text):
        k = len(s.split())
        if out and n + k <= most:
            out[-1] += " " + s
            n += k
        else:
            out.append(s)
            n = k
    return out


def block_chunks(text: str, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """``(kind, chunk)``: code and tables whole, prose and lists cut at ``most`` words, small neighbours joined up to ``most``."""
    parts: list[tuple[str, str]] = []
    for kind, block in blocks(text):
        parts += [(kind, block)] if kind in ("code", "table") else [(kind, p) for p in split_large(block, most, overlap, least)]
    out: list[tuple[str, str]] = []
    for kind, part in parts:
        n = len(part.split())
        if out and out[-1][0] == kind and kind != "code" and len(out[-1][1].split()) + n <= most:
            out[-1] = (kind, out[-1][1] + "\n" + part)
        else:
            out.append((kind, part))
    return out


def paragraph_chunks(text: str, least: int = LEAST, most: int = MOST) -> list[tuple[str, str]]:
    """``(kind, chunk)``: blocks packed in order until a chunk has ``least`` words; large prose is cut at sentences."""
    out: list[tuple[str, str]] = []
    open_: list[str] = []
    for kind, block in blocks(text):
        pieces = [block] if kind in ("code", "table") else sentences(block, most) if len(block.split()) > most else [block]
        for piece in pieces:
            n, held = len(piece.split()), sum(len(p.split()) for p in open_)
            if open_ and held + n > most:
                out.append(("mixed", "\n\n".join(open_)))
                open_ = []
            open_.append(piece)
            if sum(len(p.split()) for p in open_) >= least:
                out.append(("mixed" if len(open_) > 1 else kind, "\n\n".join(open_)))
                open_ = []
    if open_:
        out.append(("mixed", "\n\n".join(open_)))
    return out


def chunks(df: DataFrame, key: str, text: str, kind: str = "block") -> DataFrame:
    """``(key, pos, kind, chunk)``.  Null and blank texts have no chunk."""
    cut = {"block": block_chunks, "paragraph": paragraph_chunks}[kind]
    schema = df.select(key).withColumns({"pos": F.lit(0), "kind": F.lit(""), "chunk": F.lit("")}).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, pos, kinds, bodies = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, (k, c) in enumerate(cut(t)):
                    rows.append(i)
                    pos.append(n)
                    kinds.append(k)
                    bodies.append(c)
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), pa.array(bodies, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "pos", "kind", "chunk"])

    return df.select(key, text).where(f"length(trim({text})) > 0").mapInArrow(run, schema)
