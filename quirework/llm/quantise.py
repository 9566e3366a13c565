"""Additive quantisation: codebooks, beam-search codes and an index of leaves.

A vector is approximated by a sum of one entry from each of several codebooks
over all dimensions.  The books are fitted one after the other to residuals and
then all together by least squares; the beam search keeps the ``BEAM`` best
partial sums at each book.  The first two books are the coarse part: their code
pair names a cell, and a cell with too many vectors is divided by the next,
small books until its leaves are small (``leaves``).  The remaining books only
sharpen the sum.  The coarse books grow with the square root of the rows up to
``COARSE_MOST`` entries; beyond that only the index books divide further, so the
books have a bounded size and the sample stays large enough for them.

``Scorer`` gives the squared distance of queries to the sums of a leaf's codes
from one table of products per book and the stored norms.

Books are fitted to a sample of at most ``FIT_ROWS`` vectors, spread evenly by a
hash of the id; every vector is encoded and indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import vectors
from quirework.llm.vectors import DIM
from quirework.session import Scratch

FIT_ROWS = 8192
PER_CELL = 128  # mean vectors per cell
COARSE_MOST = 64  # entries of a coarse book; FIT_ROWS holds 128 vectors for each
INDEX_BOOKS, INDEX_SIZE = 5, 8  # divide full cells
FINE_BOOKS, FINE_SIZE = 6, 128
BEAM = 4
PATHS = 4  # cells a vector visits as a query
LEAF_ROWS = 2048
DEPTH = 2 + INDEX_BOOKS
KMEANS_ROUNDS = 8
SEED = 11


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(KMEANS_ROUNDS):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


@dataclass
class Quantiser:
    books: list[np.ndarray]

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([0, *[len(b) for b in self.books[:-1]]])

    @staticmethod
    def fit(x: np.ndarray, sizes: list[int]) -> Quantiser:
        rng = np.random.default_rng(SEED)
        if not len(x):
            return Quantiser([np.zeros((k, DIM), np.float32) for k in sizes])
        rest, books = x.astype(np.float32), []
        for k in sizes:
            book = _kmeans(rest, k, rng)
            books.append(book)
            rest = rest - book[((book * book).sum(1) - 2 * rest @ book.T).argmin(1)]
        q = Quantiser(books)
        at = q.encode(x, 1)[0][:, 0] + q.offsets
        total = sum(sizes)
        pairs, target = np.zeros((total, total)), np.zeros((total, x.shape[1]))
        for i in range(len(sizes)):
            np.add.at(target, at[:, i], x)
            for j in range(len(sizes)):
                np.add.at(pairs, (at[:, i], at[:, j]), 1)
        solved = np.linalg.solve(pairs + 0.1 * np.eye(total), target + 0.1 * np.concatenate(books)).astype(np.float32)
        return Quantiser([solved[o : o + k] for o, k in zip(q.offsets, sizes)])

    def encode(self, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes ``(rows, keep, books)`` of the best sums, best first, and their squared errors."""
        n, dim = x.shape
        rest, err, codes = x[:, None, :], (x * x).sum(1)[:, None], np.zeros((n, 1, 0), np.int32)
        beam = max(BEAM, keep)
        for book in self.books:
            e = err[:, :, None] - 2 * (rest.reshape(-1, dim) @ book.T).reshape(n, -1, len(book)) + (book * book).sum(1)
            e = e.reshape(n, -1)
            b = min(beam, e.shape[1])
            best = np.argpartition(e, b - 1, axis=1)[:, :b]
            best = np.take_along_axis(best, np.take_along_axis(e, best, 1).argsort(1, kind="stable"), 1)
            err = np.take_along_axis(e, best, 1)
            way, code = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, way[:, :, None], 1) - book[code]
            codes = np.concatenate([np.take_along_axis(codes, way[:, :, None], 1), code[:, :, None].astype(np.int32)], 2)
        return codes[:, :keep], err[:, :keep]

    def cells(self, x: np.ndarray, keep: int) -> np.ndarray:
        """The ``keep`` best pairs of coarse codes, best first."""
        k = min(keep, len(self.books[0]) * len(self.books[1]))
        return Quantiser(self.books[:2]).encode(x, max(k, 2 * BEAM))[0][:, :k]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


class Scorer:
    """Distances to the stored vectors of one leaf by their codes."""

    def __init__(self, q: Quantiser, codes: np.ndarray, norms: np.ndarray):
        # what comes before the fine books is shared by many vectors of a leaf: each such sum is one table entry
        first = np.ascontiguousarray(codes[:, :DEPTH])
        _, at, self.prefix = np.unique(first, axis=0, return_index=True, return_inverse=True)
        self.centres = Quantiser(q.books[:DEPTH]).decode(first[at])
        self.fine, self.codes = q.books[DEPTH:], codes[:, DEPTH:]
        self.norms = norms

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances, a row per stored vector and a column per unit vector of ``x``."""
        product = np.take(self.centres @ x.T, self.prefix.ravel(), axis=0)
        for m, book in enumerate(self.fine):
            product += np.take(book @ x.T, self.codes[:, m], axis=0)
        product *= -2
        product += 1 + self.norms[:, None]
        return np.maximum(product, 0, out=product)


def fit(units: DataFrame, rows: int, per_cell: int = PER_CELL) -> Quantiser:
    """Books for about ``rows`` vectors, fitted to at most ``FIT_ROWS`` of them."""
    share = max(1, rows // FIT_ROWS)
    sample = units.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("vec").limit(FIT_ROWS).collect()
    x = vectors.unpack([pa.scalar(bytes(r["vec"])) for r in sample])
    coarse = min(COARSE_MOST, max(2, round((rows / per_cell) ** 0.5)))
    return Quantiser.fit(x, [coarse, coarse, *[INDEX_SIZE] * INDEX_BOOKS, *[FINE_SIZE] * FINE_BOOKS])


def _ways(rest: np.ndarray, books: list[np.ndarray], turns: int) -> list[np.ndarray]:
    """Greedy codes of ``rest``, and ``turns`` variants that take the second best at one early book."""
    out = []
    for turn in range(-1, turns):
        left, codes = rest, np.zeros((len(rest), len(books)), np.int64)
        for m, book in enumerate(books):
            e = (book * book).sum(1) - 2 * left @ book.T
            pick = e.argmin(1)
            if m == turn:
                e[np.arange(len(e)), pick] = np.inf
                pick = e.argmin(1)
            codes[:, m] = pick
            left = left - book[pick]
        out.append(codes)
    return out


def encoded(points: DataFrame, q: Quantiser, paths: int = PATHS, sums: bool = True, turning: int = PATHS) -> DataFrame:
    """``points`` with ``codes`` (all books), squared ``norm`` of their sum, its distance ``err`` from the vector, and ``paths``.

    A path is a cell followed by the codes of the index books, a 16-bit number
    each, so its prefixes name ever smaller regions around the vector.  The first
    path is where the vector is stored; further ones turn off at one index book
    or start in the next best cells, and matter as far as cells are divided.
    Cells from ``turning`` on have no variants.  Without ``sums`` only the index books are searched, and ``codes`` ends there.
    """
    fine = Quantiser(q.books[2:])
    index = fine.books[:INDEX_BOOKS]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = vectors.unpack(part.column(1))
                cells = q.cells(x, paths)
                ways, best = [], None
                for p in range(cells.shape[1]):
                    rest = x - q.books[0][cells[:, p, 0]] - q.books[1][cells[:, p, 1]]
                    turns = _ways(rest, index, 3 if p == 0 else 1 if p < turning else 0)
                    if p == 0:
                        best = np.concatenate([cells[:, 0], fine.encode(rest, 1)[0][:, 0] if sums else turns[0]], 1)
                    for codes in turns:
                        ways.append(np.concatenate([cells[:, p], codes], 1).astype(">u2"))
                norm, err = np.zeros((2, len(x)), np.float32)
                if sums:
                    total = q.decode(best)
                    norm, err = (total * total).sum(1), np.sqrt(((x - total) ** 2).sum(1))
                lists = [[w[i].tobytes() for w in ways] for i in range(len(x))]
                arrays = [
                    part.column(0),
                    part.column(1),
                    pa.array([r.tobytes() for r in best.astype(np.uint16)], pa.binary()),
                    pa.array(norm.astype(np.float32)),
                    pa.array(err.astype(np.float32)),
                    pa.array(lists, pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "vec", "codes", "norm", "err", "paths"])

    out = points.select("doc_id", "vec").mapInArrow(run, "doc_id string, vec binary, codes binary, norm float, err float, paths array<binary>")
    return out.withColumn("nid", F.monotonically_increasing_id()).select("nid", "doc_id", "vec", "codes", "norm", "err", "paths")


def full_regions(points: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Per depth, from two codes on, the prefixes under which more than ``LEAF_ROWS`` points are stored, with their number."""
    state, out = points.select(F.element_at("paths", 1).alias("path")), []
    for depth in range(2, DEPTH + 1):
        state = state.withColumn("leaf", F.substring("path", 1, 2 * depth))
        full = scratch.save(state.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_ROWS))
        if full.isEmpty():
            break
        out.append(full)
        state = state.join(full, "leaf", "left_semi")
    return out


def leaves(points: DataFrame, full: list[DataFrame], first: int = 0, last: int = 1000) -> DataFrame:
    """``(nid, leaf, best)``: the leaves of a point's paths from ``first`` to before ``last``.

    A leaf is the shortest prefix of at least two codes that is not full; what
    the last index book cannot divide is stored in blocks by a hash, each a leaf
    of its own, and a point visits all of them.  ``best`` marks the leaf where
    the point is stored.  Depths without full regions cost nothing.
    """
    paths = points.select("nid", F.posexplode("paths").alias("nth", "path")).where((F.col("nth") >= first) & (F.col("nth") < last))
    state = paths.select("nid", "path", (F.col("nth") == 0).alias("best"), F.substring("path", 1, 4).alias("leaf"))
    for step, regions in enumerate(full[: DEPTH - 2]):
        state = state.join(regions.select("leaf").withColumn("more", F.lit(True)), "leaf", "left")
        deeper = F.when(F.col("more"), F.substring("path", 1, 2 * (step + 3))).otherwise(F.col("leaf"))
        state = state.select("nid", "path", "best", deeper.alias("leaf"))
    for regions in full[DEPTH - 2 :]:
        blocks = F.ceil(F.col("n") / LEAF_ROWS).cast("int")
        state = state.join(regions.withColumn("blocks", blocks).select("leaf", "blocks"), "leaf", "left")
        state = state.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        own = F.col("blocks").isNull() | (F.pmod(F.xxhash64("nid", F.lit(1)), F.col("blocks")) == F.col("block"))
        named = F.when(F.col("blocks").isNull(), F.col("leaf")).otherwise(F.concat("leaf", F.unhex(F.lpad(F.hex("block"), 8, "0"))))
        state = state.select("nid", (F.col("best") & own).alias("best"), named.alias("leaf"))
    return state.groupBy("nid", "leaf").agg(F.max("best").alias("best"))
