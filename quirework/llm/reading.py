"""Reading level of each document by smoothed unigram models per level.

Raters' bands become, per document, a distribution over levels (raters err, so a
rating speaks for its band most and for the next ones a little).  One unigram
model per level is counted over the sentences of the labelled documents and
smoothed towards the mean of all levels.  A document's level is that of the
highest posterior: the prior of a level, its likelihood of the document's words,
and the mean posterior of the level over the document's stretches of ``WINDOW``
words, so that sure words in a minority of sentences do not decide a mixed text
alone.  Words are not independent, so both likelihood terms are tempered: two
exponents, the same for all levels, and the prior are all that is fitted, to
labelled documents that the scoring models did not see (two halves, crosswise).

Labels are a sample; at most ``LABEL_DOCS`` labelled documents, spread by a hash
of their id, train the models.  Where they lack a level or are fewer than
``MIN_LABELLED``, as many documents are added whose level a formula of sentence
and word length seeds.  Every document is then scored in full.

Sentences are the text without fenced code, tables, headings, log lines, code
lines, links and e-mail addresses; list items count.

Edge cases.  Null and blank texts and texts with fewer than ``MIN_WORDS`` words
of sentences have no band.  Words that no labelled document has say nothing.
Null bands, ratings of unknown documents and repeated ratings are ignored.
Without any labelled or seeded document there is no band at all.  Ties go to the
lower level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import Scratch

LEVELS = 4
MIN_WORDS = 60
LABEL_DOCS = 8000
MIN_LABELLED = 60
SMOOTH = 1.0
WINDOW = 16
STRETCH_EXPONENT = 0.5  # of a stretch's likelihood
FLOOR = 0.02  # least mean posterior of a level
PER_DOC = 100.0  # words that each labelled document counts for
OWN, NEXT, OTHER = 0.82, 0.08, 0.02  # what a rating of a level says about each level

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_SKIP = re.compile(
    r"^\s*(?:[|#>]|[-=_*]{3,}\s*$|\+[-+]+|\[?\d{4}-\d\d-\d\d\b|\[?\d\d:\d\d(?::\d\d)?\b|\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b)|\t[^|\n]*\t"
    r"|^\s*(?:[\w.\]\[]+ *(?:[-+*/|&]?=|:=) *\S|(?:def|class|import|from|return|for|while|if|elif|else|try|except|with|let|const|var|function|public|private|SELECT|INSERT|UPDATE)\b.*[:{;(]\s*$|[{}()\[\];]+\s*$)"
)
_LINK = re.compile(r"(?:https?://|ftp://|www\.)\S+|\S+@\S+\.\w+")
_MARK = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?]+(?:\s|$)")


def prose(text: str) -> str:
    """The sentences of a text, a line each."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    kept = [_MARK.sub("", line) for line in text.split("\n") if line and not _SKIP.search(line)]
    out = "\n".join(kept)
    return _LINK.sub(" ", out) if "://" in out or "www." in out or "@" in out else out


def words(text: str | None) -> list[str]:
    return _WORD.findall(prose(text).lower()) if text else []


def formula(text: str) -> int:
    """A level from sentence and word length, on the scale of school grades."""
    body = prose(text)
    found = _WORD.findall(body)
    if not found:
        return 0
    per_sentence = len(found) / max(1, len(_END.findall(body)))
    syllables = sum(max(1, len(re.findall(r"[aeiouyäöüéèêàâîôûœ]+", w.lower()))) for w in found) / len(found)
    grade = 0.39 * per_sentence + 11.8 * syllables - 15.59
    return 1 + sum(grade >= g for g in (5.0, 10.0, 17.0))


def _formulas(texts: pd.Series) -> pd.Series:
    return texts.map(formula)


def labelled(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, text, half, p1..p4)`` of the labelled documents, seeded ones included where needed."""
    votes = labels.where(F.col("band").between(1, LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "rater", "band").distinct()
    counts = votes.groupBy("doc_id").agg(*[F.count_if(F.col("band") == b).alias(f"n{b}") for b in range(1, LEVELS + 1)])

    def weight(level: int):
        # log of the product over ratings of what each says about the level
        said = [F.lit(float(np.log(OWN if b == level else NEXT if abs(b - level) == 1 else OTHER))) * F.col(f"n{b}") for b in range(1, LEVELS + 1)]
        return F.exp(sum(said[1:], said[0]))

    raw = counts.select("doc_id", *[weight(b).alias(f"w{b}") for b in range(1, LEVELS + 1)])
    total = sum((F.col(f"w{b}") for b in range(2, LEVELS + 1)), F.col("w1"))
    chosen = raw.select("doc_id", *[(F.col(f"w{b}") / total).alias(f"p{b}") for b in range(1, LEVELS + 1)])
    chosen = scratch.save(chosen.orderBy(F.xxhash64("doc_id")).limit(LABEL_DOCS))
    texts = documents.select("doc_id", "text").where("text is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half")
    known = scratch.save(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", half, "p1", "p2", "p3", "p4"))
    have = known.agg(F.count("*").alias("n"), *[F.sum((F.col(f"p{b}") > 0.5).cast("int")).alias(f"n{b}") for b in range(1, LEVELS + 1)]).first()
    if have["n"] >= MIN_LABELLED and all(have[f"n{b}"] for b in range(1, LEVELS + 1)):
        return known
    sample = texts.orderBy(F.xxhash64("doc_id")).limit(8 * MIN_LABELLED)
    seeded = F.pandas_udf(_formulas, "int")(F.col("text"))
    seed = sample.withColumn("level", seeded).where("level > 0")
    said = [F.when(F.col("level") == b, OWN).when(F.abs(F.col("level") - b) == 1, NEXT).otherwise(OTHER).alias(f"p{b}") for b in range(1, LEVELS + 1)]
    return scratch.save(known.unionByName(seed.join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text", half, *said)))


@dataclass
class Model:
    """Word numbers and the log probability of each word under each level."""

    vocabulary: dict[str, int]
    logp: np.ndarray

    @staticmethod
    def of(names: list[str], counts: np.ndarray) -> Model:
        totals = np.maximum(counts.sum(0), 1e-9)
        mean = (counts / totals).mean(1) + 1e-12
        return Model({w: i for i, w in enumerate(names)}, np.log((counts + SMOOTH * mean[:, None]) / (totals + SMOOTH)))

    def evidence(self, found: list[str]) -> np.ndarray:
        """Per level the mean log likelihood of a word, and the log of the mean posterior over stretches."""
        get = self.vocabulary.get
        at = [i for i in map(get, found) if i is not None]
        if not at:
            return np.zeros((2, LEVELS))
        scores = self.logp[at]
        mean = scores.sum(0) / len(found)
        parts = STRETCH_EXPONENT * np.add.reduceat(scores, np.arange(0, len(at), WINDOW), axis=0)
        parts = np.exp(parts - parts.max(1, keepdims=True))
        share = (parts / parts.sum(1, keepdims=True)).mean(0)
        return np.array([mean - mean.mean(), np.log(share + FLOOR)])


@dataclass
class Posterior:
    """The two exponents and the log prior."""

    exponents: np.ndarray
    prior: np.ndarray

    def of(self, evidence: np.ndarray) -> np.ndarray:
        """Posteriors of ``evidence``, a row per document."""
        z = np.tensordot(evidence, self.exponents, (1, 0)) + self.prior
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @staticmethod
    def fit(evidence: np.ndarray, levels: np.ndarray, steps: int = 3000, rate: float = 0.3) -> Posterior:
        """The exponents and prior of greatest likelihood for ``levels``, a distribution per document."""
        scale = np.maximum(evidence.std(axis=(0, 2)), 1e-9)
        scaled = evidence / scale[None, :, None]
        p = Posterior(np.ones(2), np.zeros(LEVELS))
        for _ in range(steps):
            off = p.of(scaled) - levels
            p.exponents -= rate * np.einsum("nb,neb->e", off, scaled) / len(scaled)
            p.prior -= rate * off.mean(0)
        return Posterior(p.exponents / scale, p.prior)


def _counts(rows: DataFrame) -> DataFrame:
    """Weighted word counts per half and level, summed in each task before the shuffle."""

    def count(batches: Iterator) -> Iterator:
        from collections import Counter, defaultdict

        for batch in batches:
            sums: dict = defaultdict(lambda: np.zeros(LEVELS))
            p = np.column_stack([batch.column(3 + b).to_numpy(zero_copy_only=False) for b in range(LEVELS)])
            for text, half, share in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), p):
                found = words(text)
                for w, n in Counter(found).items():
                    sums[half, w] += share * (n * PER_DOC / len(found))
            keys = list(sums)
            values = np.array([sums[k] for k in keys]).reshape(len(keys), LEVELS)
            arrays = [pa.array([h for h, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), *[pa.array(values[:, b]) for b in range(LEVELS)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["half", "word", "c1", "c2", "c3", "c4"])

    made = rows.select("doc_id", "text", "half", "p1", "p2", "p3", "p4").mapInArrow(count, "half int, word string, c1 double, c2 double, c3 double, c4 double")
    return made.groupBy("half", "word").agg(*[F.sum(f"c{b}").alias(f"c{b}") for b in range(1, LEVELS + 1)])


def fit(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Model, Posterior] | None:
    rows = labelled(documents, labels, scratch)
    table = _counts(rows).toPandas()
    if not len(table):
        return None
    names = sorted(set(table["word"]))
    number = {w: i for i, w in enumerate(names)}
    counts = np.zeros((2, len(names), LEVELS))
    counts[table["half"].to_numpy(), table["word"].map(number).to_numpy()] = table[["c1", "c2", "c3", "c4"]].to_numpy()
    cross = [Model.of(names, counts[1]), Model.of(names, counts[0])]  # each half is scored by the other

    def score(batches: Iterator) -> Iterator:
        for batch in batches:
            p = np.column_stack([batch.column(3 + b).to_numpy(zero_copy_only=False) for b in range(LEVELS)])
            e = [cross[h].evidence(words(t)).ravel() for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))], names=["e", "p"])

    # at most LABEL_DOCS rows of twelve numbers
    made = rows.select("doc_id", "text", "half", "p1", "p2", "p3", "p4").mapInArrow(score, "e array<double>, p array<double>").collect()
    if len(made) < MIN_LABELLED:  # too few for exponents: the likelihoods of all words decide
        return Model.of(names, counts.sum(0)), Posterior(np.array([MIN_WORDS, 0.0]), np.zeros(LEVELS))
    x, y = np.array([r["e"] for r in made]).reshape(-1, 2, LEVELS), np.array([r["p"] for r in made])
    return Model.of(names, counts.sum(0)), Posterior.fit(x, np.eye(LEVELS)[y.argmax(1)])


def levels(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, words, band, posterior)`` of every document with text."""
    fitted = fit(documents, labels, scratch)

    def predict(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            n = np.array([len(f) for f in found], np.int32)
            bands, best = [None] * len(found), [None] * len(found)
            at = np.flatnonzero(n >= MIN_WORDS) if fitted else []
            if len(at):
                model, posterior = fitted
                e = posterior.of(np.array([model.evidence(found[i]) for i in at]))
                for i, row in zip(at, e):
                    bands[i], best[i] = int(row.argmax()) + 1, float(row.max())
            arrays = [batch.column(0), pa.array(n), pa.array(bands, pa.int32()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "words", "band", "posterior"])

    return documents.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(
        predict, "doc_id long, words int, band int, posterior double"
    )
