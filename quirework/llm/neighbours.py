"""Most similar vectors for every vector, by additive quantisation.

Each vector is stored in the leaf of its best path and visits the leaves of its
``PATHS`` best cells.  In a leaf, lookup tables of the codebooks and the stored
norms give the distance of each query to the sum that stands for each stored
vector.  The sum lies ``err`` away from its vector, and the way from the query to
the vector makes some angle with that error: with ``slack`` as the greatest
cosine of the angle, a stored vector is at least ``-slack * err + sqrt((slack *
err)^2 + distance^2 - err^2)`` away.  At ``slack`` 1 this holds without exception;
random directions in 64 dimensions rarely exceed 0.3.  Whatever may still be among
the ``k`` nearest, and not below the wanted cosine, is compared exactly: however
many near copies a leaf holds, none is left out, and vectors that are far away
cost a few table lookups.  The best of all leaves of a query are merged by their
exact cosine.

Edge cases.  Missing, unusable and wrong-length vectors are left out; a document
counts once; equal vectors are neighbours with cosine one, found through their
class without listing its pairs.  Ties are broken by ``doc_id``.  A leaf that
many queries visit is repeated for groups of them, so no task meets an unbounded
group.  An empty table gives an empty result, and a single vector no neighbour.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm import quantise, vectors
from quirework.session import Scratch

K = 5
SLACK = 1.0
VISITS = 4096  # queries of a leaf in one task
BLOCK = 512
PAIRS = 1 << 17  # exact comparisons at once


def _within(cosine: np.ndarray | float) -> np.ndarray:
    """The distance of unit vectors at a cosine."""
    return np.sqrt(np.maximum(2 - 2 * np.asarray(cosine), 0))


def _exact(x: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("rd,rd->r", x[rows[part]].astype(np.float64), x[others[part]].astype(np.float64))
    return out


def _score(q: quantise.Quantiser, k: int, floor: float, slack: float):
    """The function that compares one leaf's queries with its stored vectors."""

    def run(table):
        import pyarrow as pa

        nid = table.column("nid").to_numpy()
        x = vectors.unpack(table.column("vec"))
        stored = np.flatnonzero(table.column("stored").to_numpy(zero_copy_only=False))
        asking = np.flatnonzero(table.column("asking").to_numpy(zero_copy_only=False))
        parts = []
        if len(stored):
            raw = b"".join(v.as_py() for v in table.column("codes").take(pa.array(stored)))
            codes = np.frombuffer(raw, "<u2").reshape(len(stored), -1)
            norm, err = (table.column(c).to_numpy(zero_copy_only=False)[stored] for c in ("norm", "err"))
            scorer = quantise.Scorer(q, codes, norm)
            reach, lost = slack * err[:, None], ((1 - slack * slack) * err * err)[:, None]
            for at in range(0, len(asking), BLOCK):
                rows = asking[at : at + BLOCK]
                near = scorer.distances(x[rows])
                near[nid[stored][:, None] == nid[rows][None, :]] = np.inf
                low = np.sqrt(np.maximum(near - lost, 0)) - reach - 1e-4  # no stored vector is nearer than this
                limit = np.full(len(rows), _within(floor) if floor > -1 else np.inf)
                open_ = (low <= limit).sum(0)
                many = np.flatnonzero(open_ > 4 * k)
                if len(many):
                    # the k-th best of a first choice by codes is as near as the k-th best of all, or farther
                    first = np.argpartition(low[:, many], 2 * k, axis=0)[: 2 * k]
                    who = np.repeat(rows[many][None, :], len(first), 0)
                    cos = _exact(x, who.ravel(), stored[first].ravel()).reshape(first.shape)
                    limit[many] = np.minimum(limit[many], _within(np.partition(cos, len(cos) - k, axis=0)[len(cos) - k] - 1e-9))
                b, a = np.nonzero(low <= limit[None, :])
                a, b = rows[a], stored[b]
                cos = _exact(x, a, b)
                ok = cos >= floor
                a, b, cos = a[ok], b[ok], cos[ok]
                order = np.lexsort((nid[b], -cos, a))
                a, b, cos = a[order], b[order], cos[order]
                start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
                nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
                best = nth < k
                parts.append((nid[a[best]], nid[b[best]], cos[best]))
        kinds = ("a", np.int64), ("b", np.int64), ("cos", np.float64)
        return pa.table({n: np.concatenate([p[i] for p in parts]).astype(t) if parts else np.zeros(0, t) for i, (n, t) in enumerate(kinds)})

    return run


def visits(points: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(leaf, part, nid, vec, codes, norm, err, stored, asking)``: each vector in each of its leaves, with codes where it is stored."""
    light = scratch.save(quantise.leaves(points, quantise.full_regions(points, scratch)))
    busy = light.groupBy("leaf").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts")).where("parts > 1")
    own = F.pmod(F.xxhash64("nid"), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.when(F.col("best"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array("own"))
    placed = light.join(busy, "leaf", "left").withColumn("own", own).withColumn("part", F.explode(every))
    kept = points.select("nid", "vec", "codes", "norm", "err")
    return placed.join(kept, "nid").select(
        "leaf",
        "part",
        "nid",
        "vec",
        *[F.when(F.col("best"), F.col(c)).alias(c) for c in ("codes", "norm", "err")],
        F.col("best").alias("stored"),
        (F.col("part") == F.col("own")).alias("asking"),
    )


def nearest(
    df: DataFrame,
    key: str,
    record: str,
    vector: str,
    scratch: Scratch,
    k: int = K,
    floor: float = -2.0,
    paths: int = quantise.PATHS,
    per_cell: int = quantise.PER_CELL,
    slack: float = SLACK,
) -> DataFrame:
    """``(doc_id, neighbour, cos)``: the up to ``k`` nearest of each document with cosine ``floor`` or more.

    ``paths`` cells of about ``per_cell`` vectors are visited; a ``slack`` below 1
    compares fewer vectors exactly and may lose some.
    """
    units = scratch.save(vectors.unit(df, key, record, vector))
    q = quantise.fit(units, df.count(), per_cell)
    members, sets, points = vectors.classes(units, scratch)
    sets = scratch.save(vectors.shown(members, sets))
    points = scratch.save(quantise.encoded(points, q, paths, turning=min(paths, quantise.PATHS)))
    found = visits(points, scratch).groupBy("leaf", "part").applyInArrow(_score(q, k, floor, slack), "a long, b long, cos double")
    found = scratch.save(found)
    # what a sees of b, b sees of a
    both = found.union(found.select("b", "a", "cos")).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    name = points.select("nid", "doc_id")
    named = both.join(name.select(F.col("nid").alias("a"), F.col("doc_id").alias("rep")), "a").join(
        name.select(F.col("nid").alias("b"), F.col("doc_id").alias("other")), "b"
    )
    order = Window.partitionBy("rep").orderBy(F.col("cos").desc(), "other")
    top = named.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    # neighbour classes are named by their smallest members, the class itself first
    shown = sets.select(F.col("rep").alias("other"), "shown")
    lists = (
        top.join(shown, "other")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("nth", F.transform("shown", lambda d: F.struct(d.alias("d"), F.col("cos").alias("cos"))).alias("list")))).alias("l"))
        .select("rep", F.flatten(F.transform("l", lambda s: s["list"])).alias("others"))
    )
    kept = sets.join(lists, "rep", "left")
    own = F.transform("shown", lambda d: F.struct(d.alias("d"), F.lit(1.0).alias("cos")))
    empty = F.array().cast("array<struct<d:string,cos:double>>")
    wanted = F.filter(F.concat(own, F.coalesce("others", empty)), lambda s: s["d"] != F.col("doc_id"))
    per_doc = members.join(kept.select("h", "h2", "shown", "others"), ["h", "h2"]).select("doc_id", F.explode(F.slice(wanted, 1, k)).alias("s"))
    return per_doc.select("doc_id", F.col("s.d").alias("neighbour"), F.col("s.cos").alias("cos"))


def pairs(near: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)`` with a < b of which one is among the nearest of the other."""
    return near.select(F.least("doc_id", "neighbour").alias("doc_id_a"), F.greatest("doc_id", "neighbour").alias("doc_id_b")).distinct()
