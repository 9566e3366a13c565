"""Usable vectors, unit length, one row per class of equal vectors.

A vector is usable if it has ``dim`` finite values that are not all zero.  A
document counts once, with the usable vector of its smallest record.  Documents
with the same direction form a class that the later steps treat as one point,
so a vector repeated by a third of all rows costs one row there.

Between steps a vector is kept as given, but for a power of two that brings its
largest value to [0.5, 1), and no value changes.  Values that are whole multiples
of a power of two down to ``2 ** -BITS`` are kept bit plane by bit plane, as many
as the finest of them needs: embeddings stored with few binary digits then take
a third of their bytes.  All others are kept byte plane by byte plane.  ``unpack`` tells the
two by their length and gives unit vectors back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import Scratch

DIM = 64
BITS = 23  # planes of more bits would be as long as floats
SHOWN = 6  # members of a class that neighbour lists may need: five and the document itself


def _digits(scaled: np.ndarray) -> np.ndarray:
    """The least ``b`` of each row for which all its values are whole multiples of ``2 ** -b``."""
    part, exponent = np.frexp(scaled)
    whole = np.ldexp(part, 24).astype(np.int64)  # the digits of a float32
    low = np.frexp((whole & -whole).astype(np.float64))[1] - 1
    return np.where(whole != 0, 24 - exponent - low, 0).max(1, initial=0)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of finite, not all zero float32 values as bytes, plane by plane."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0.0))
    scaled = np.ldexp(x, -exponent[:, None]).astype("<f4") + np.float32(0.0)
    digits = _digits(scaled) if x.shape[1] % 8 == 0 else np.full(len(x), BITS + 1)
    out: list[bytes] = [b""] * len(x)
    for b in np.unique(digits):
        at = np.flatnonzero(digits == b)
        if b > BITS:
            planes = np.ascontiguousarray(scaled[at]).view(np.uint8).reshape(len(at), -1, 4).transpose(0, 2, 1)
        else:
            whole = np.ldexp(scaled[at], b).astype(np.int32)  # negative ones as complements of two
            planes = np.packbits(np.stack([(whole >> j & 1).astype(np.uint8) for j in range(b + 1)], 1), axis=2)
        for i, r in zip(at, np.ascontiguousarray(planes)):
            out[i] = r.tobytes()
    return out


def unpack(column: Iterable, dim: int = DIM) -> np.ndarray:
    """Unit float32 rows of an Arrow column that ``pack`` made."""
    rows = [v.as_py() for v in column]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    x = np.empty((len(rows), dim))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        raw = np.frombuffer(b"".join(rows[i] for i in at), np.uint8)
        if n == 4 * dim:
            x[at] = np.ascontiguousarray(raw.reshape(-1, 4, dim).transpose(0, 2, 1)).view("<f4").reshape(-1, dim)
        else:
            bits = np.unpackbits(raw.reshape(len(at), -1, dim // 8), axis=2)
            whole = bits[:, -1].astype(np.int32) * -(1 << bits.shape[1] - 1)
            for j in range(bits.shape[1] - 1):
                whole += bits[:, j].astype(np.int32) << j
            x[at] = whole
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32) if len(x) else x.astype(np.float32)


def unit(df: DataFrame, key: str, record: str, vector: str, dim: int = DIM) -> DataFrame:
    """``(doc_id, record_id, vec)`` of the usable rows, ``vec`` packed."""
    v = F.col(vector)
    good = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) == dim)

    def scale(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            ok = np.isfinite(flat).all(1)
            ok &= (flat != 0).any(1)
            keep = np.flatnonzero(ok)
            at = pa.array(keep, pa.int64())
            vec = pa.array(pack(flat[keep]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), vec], names=["doc_id", "record_id", "vec"])

    rows = df.where(good).select(F.col(key).cast("string").alias("doc_id"), F.col(record).cast("long").alias("record_id"), v.cast("array<float>"))
    return rows.mapInArrow(scale, "doc_id string, record_id long, vec binary")


def classes(units: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, classes and points.

    ``members(doc_id, h, h2)`` has a row per document, ``sets(h, h2, rep, n)`` a row
    per class with its smallest document, and ``points(doc_id, vec)`` one
    vector per class under its smallest document's name.  Only hashes are
    shuffled to form them; each vector moves once.
    """
    hashed = units.select("doc_id", "record_id", F.xxhash64("vec").alias("h"), F.hash("vec").alias("h2"))
    docs = hashed.groupBy("doc_id").agg(F.min(F.struct("record_id", "h", "h2")).alias("r"))
    members = scratch.save(docs.select("doc_id", "r.record_id", "r.h", "r.h2"))
    rep = F.min(F.struct("doc_id", "record_id"))
    grouped = members.groupBy("h", "h2").agg(rep.alias("r"), F.count("*").alias("n"))
    sets = scratch.save(grouped.select("h", "h2", F.col("r.doc_id").alias("rep"), F.col("r.record_id").alias("record_id"), "n"))
    points = units.join(sets.select(F.col("rep").alias("doc_id"), "record_id"), ["doc_id", "record_id"], "left_semi").select("doc_id", "vec")
    return members.drop("record_id"), sets.drop("record_id"), points


def shown(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` with ``shown``, the ``SHOWN`` smallest documents of each class; classes of one need no ranking."""
    several = members.join(sets.where("n > 1").select("h", "h2"), ["h", "h2"], "left_semi")
    first = Window.partitionBy("h", "h2").orderBy("doc_id")
    ranked = several.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SHOWN)
    lists = ranked.groupBy("h", "h2").agg(F.sort_array(F.collect_list("doc_id")).alias("list"))
    return sets.join(lists, ["h", "h2"], "left").select("h", "h2", "rep", "n", F.coalesce("list", F.array("rep")).alias("shown"))
