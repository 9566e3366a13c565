"""Citations in texts, and the texts that hold what they cite.

A quotation, a section name or an address is cited; the text that holds it is
its target.  Every text is read whole and no pair of texts meets: cited texts
and bodies are reduced to hashed grams, a cited text looks for bodies by the
gram that the fewest of them have, and only those are searched for it.
Repeated keys count as one text each; nulls hold nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import CITATION_FAMILIES
from quirework.session import Scratch, small

RESOLVED = ("direct_quote", "inline_reference", "url")
SHORT, GRAM, WINDOW = (1, 2, 3, 6), 8, 17  # texts of GRAM + WINDOW - 1 characters or more are told by one gram in each window
NEEDLES = 1000  # cited texts that one body is searched for at a time


def detected(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, citation_type, nth, cited, start_pos, end_pos)``: every citation of each family.

    ``nth`` counts a family's citations in a text from 1; positions count code
    points.  ``cited`` is the pattern's first group that took part, or the whole
    match.  Null and empty texts have none.
    """
    patterns = {name: re.compile(p) for name, p in CITATION_FAMILIES.items()}
    more = {"citation_type": F.lit(""), "nth": F.lit(0), "cited": F.lit(""), "start_pos": F.lit(0), "end_pos": F.lit(0)}
    schema = df.select(key).withColumns(more).schema

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, out = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for name, pattern in patterns.items():
                    for nth, m in enumerate(pattern.finditer(body), 1):
                        rows.append(i)
                        out.append((name, nth, next((g for g in m.groups() if g is not None), m.group()), *m.span()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names=schema.names)

    return df.select(key, text).where(F.length(text) > 0).mapInArrow(find, schema)


def _folded(text: Column) -> Column:
    """Lower case that does not depend on what stands around a letter."""
    return F.translate(F.lower(text), "ς", "σ")


def _grams(df: DataFrame, key: str, text: str, cited: bool) -> DataFrame:
    """``(key, gram)``: the grams of a text, each once.

    A body has all its grams of the lengths ``SHORT`` and the least gram of
    ``GRAM`` characters of every window.  A cited text has the least grams of its
    windows, or, where it is too short for one, its grams of the greatest of the
    short lengths that it reaches.  So a body that holds it has all of its grams.
    """
    schema = df.select(key).withColumn("gram", F.lit(0).cast("long")).schema

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def hashed(codes, q):
            h = np.full(len(codes) - q + 1, q, np.uint64)
            for i in range(q):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - q + 1 + i]
            h ^= h >> np.uint64(31)
            return h * np.uint64(0xBF58476D1CE4E5B9)

        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
                parts = []
                if len(codes) >= GRAM + WINDOW - 1:
                    parts.append(np.lib.stride_tricks.sliding_window_view(hashed(codes, GRAM), WINDOW).min(1))
                if not cited or not parts:
                    sizes = [q for q in SHORT if q <= len(codes)]
                    parts += [hashed(codes, q) for q in (sizes[-1:] if cited else sizes)]
                own = np.unique(np.concatenate(parts))
                found.append(own)
                rows.append(np.full(len(own), i))
            if not rows:
                continue
            keys = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found).view(np.int64))], names=[key, "gram"])

    return df.select(key, text).where(F.length(text) > 0).mapInArrow(run, schema)


def edges(citations: DataFrame, bodies: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """``(src, dst, citation_type, cited)``: each cited text with the first other body that holds it.

    Quotations and addresses are looked for as they stand, section names in any
    case; the first is that of the smallest ``key``.  Citations that no other body
    holds, blank ones and those of other families have no edge; equal citations
    of a text count once.
    """
    section = F.col("citation_type") == "inline_reference"
    needle = F.when(section, _folded(F.btrim("cited", F.lit(" \t\r\n")))).otherwise(F.col("cited"))
    asked = citations.where(F.col("citation_type").isin(*RESOLVED)).select(key, "citation_type", "cited", needle.alias("needle"))
    asked = asked.where(F.length("needle") > 0).distinct()
    asked = scratch.save(asked.withColumn("cid", F.sha2(F.concat(F.when(section, "s").otherwise("q"), "needle"), 256)))
    once = asked.groupBy("cid").agg(F.first("needle").alias("needle"), F.first(section).alias("any_case"))
    once = scratch.save(once.withColumn("folded", _folded(F.col("needle"))))
    own = scratch.save(_grams(once, "cid", "folded", True))
    held = _grams(bodies.select(key, _folded(F.col(text)).alias("__folded")), key, "__folded", False)
    held = scratch.save(held.join(small(scratch.save(own.select("gram").distinct())), "gram", "left_semi"))
    rare = own.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rare = rare.groupBy("cid").agg(F.min(F.struct("n", "gram")).alias("m")).select("cid", F.col("m.gram").alias("gram"))
    met = scratch.save(rare.join(held, "gram").select("cid", key).join(once.select("cid", "needle", "any_case"), "cid"))
    # a body is read once for up to NEEDLES cited texts
    share = met.groupBy(key).agg(F.ceil(F.count("*") / NEEDLES).alias("__parts"))
    lots = met.join(share, key).groupBy(key, F.pmod(F.xxhash64("cid"), "__parts").alias("__part"))
    lots = lots.agg(F.collect_list(F.struct("cid", "needle", "any_case")).alias("__asked"))
    read = bodies.join(small(scratch.save(share.select(key))), key, "left_semi").select(key, F.col(text).alias("__body"), _folded(F.col(text)).alias("__folded"))
    holds = lambda x: F.contains(F.when(x["any_case"], F.col("__folded")).otherwise(F.col("__body")), x["needle"])
    met = lots.join(read, key).select(key, F.explode(F.filter("__asked", holds)).alias("x")).select(key, "x.cid").distinct()
    ranked = met.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy(key))).where("nth <= 2")
    two = ranked.groupBy("cid").agg(F.min(key).alias("__one"), F.max(key).alias("__two"))
    dst = F.when(F.col("__one") != F.col(key), F.col("__one")).when(F.col("__two") != F.col(key), F.col("__two"))
    out = asked.join(two, "cid").select(F.col(key).alias("src"), dst.alias("dst"), "citation_type", "cited")
    return out.where("dst is not null")
