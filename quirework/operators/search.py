"""Keyword, vector and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import vector
from quirework.session import Scratch

K1, B = 1.2, 0.75
# Words that the index leaves out.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
BLOCK = 256


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, without stop words."""
    found = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9À-ɏ]+", " ")), " ")
    return F.filter(found, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, length, term, tf)``; the length is that of the document in terms."""
    listed = df.select(key, terms(F.col(text)).alias("t"))
    return listed.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def _only(term: str) -> Column:
    return F.filter("t", lambda t: t == term)


def bm25(df: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """``(key, bm25)`` of the documents that hold a query term.

    Only the query's terms are kept from each document, before any shuffle;
    document frequencies come from the few rows that are left, and the corpus
    totals from one aggregate.
    """
    wanted = sorted({q.lower() for q in query} - set(STOP_WORDS))
    if not wanted:
        return df.select(key, F.lit(0.0).alias("bm25")).where(F.lit(False))
    body = df.select(key, terms(F.col(text)).alias("t"))
    sizes = body.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))
    hits = body.select(key, F.size("t").alias("length"), *[F.size(_only(w)).alias(f"tf{i}") for i, w in enumerate(wanted)]).where(" or ".join(f"tf{i} > 0" for i in range(len(wanted))))
    rows = hits.select(key, "length", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"tf{i}").alias("tf")) for i, w in enumerate(wanted)])).alias("p"))
    rows = rows.select(key, "length", "p.term", "p.tf").where("tf > 0")
    df_ = rows.groupBy("term").agg(F.count("*").alias("df"))
    scored = rows.join(F.broadcast(df_), "term").crossJoin(F.broadcast(sizes))  # a row per query term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_len")))
    return scored.groupBy(key).agg(F.sum(weight).alias("bm25"))


def vector_top(df: DataFrame, key: str, embedding: str, query: list[float], k: int, least: float = 0.0) -> DataFrame:
    """The ``k`` rows of greatest certainty: ``(key, cosine, certainty)``.  Vectors of another length are left out."""
    cos = vector.cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query]))
    scored = df.where(F.size(embedding) == len(query)).select(key, cos.alias("cosine")).where("cosine is not null")
    scored = scored.withColumn("certainty", vector.certainty(F.col("cosine"))).where(F.col("certainty") >= least)
    return scored.orderBy(F.col("cosine").desc(), key).limit(k)


def l2_top(df: DataFrame, key: str, embedding: str, query: list[float], k: int) -> DataFrame:
    d = vector.squared_distance(F.col(embedding), F.array(*[F.lit(float(x)) for x in query]))
    return df.where(F.size(embedding) == len(query)).select(key, d.alias("distance")).orderBy("distance", key).limit(k)


def hybrid(text_scores: DataFrame, vector_scores: DataFrame, key: str, alpha: float, k: int) -> DataFrame:
    """Min-max fusion of two scored lists: ``alpha`` 0 is text alone, 1 the vector alone.

    ``text_scores`` has ``bm25``, ``vector_scores`` ``cosine``.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")

    def scaled(df: DataFrame, col: str) -> DataFrame:
        ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
        share = F.when(F.col("hi") > F.col("lo"), (F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        return df.crossJoin(F.broadcast(ends)).select(key, share.alias(f"{col}_share"))

    both = scaled(text_scores, "bm25").join(scaled(vector_scores, "cosine"), key, "full")
    score = alpha * F.coalesce("cosine_share", F.lit(0.0)) + (1 - alpha) * F.coalesce("bm25_share", F.lit(0.0))
    return both.withColumn("score", score).orderBy(F.col("score").desc(), key).limit(k).select(key, "score")


def nearest_to(queries: DataFrame, base: DataFrame, key: str, embedding: str, k: int, least: float) -> DataFrame:
    """``(src, dst, similarity)``: for a stated set of query rows, the ``k`` most similar rows of ``base``.

    Both sides are gathered into blocks of ``BLOCK`` vectors; a pair of blocks is
    one matrix product that leaves ``k`` rows per query, and the blocks' results
    are merged by a ranked window.  Rows never meet one by one.  Null and zero
    vectors are left out; ties go to the smaller id.
    """

    def blocks(df: DataFrame, ids: str, vecs: str) -> DataFrame:
        good = df.where(F.col(embedding).isNotNull() & (vector.norm(F.col(embedding)) > 0))

        def gather(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x = np.array(part.column(1).to_pylist(), np.float64)
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=[ids, vecs])

        return good.select(F.col(key).cast("long"), F.col(embedding)).mapInArrow(gather, f"{ids} array<long>, {vecs} binary")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for qi, qv, bi, bv in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                qi, bi = np.array(qi), np.array(bi)
                cos = np.frombuffer(qv).reshape(len(qi), -1) @ np.frombuffer(bv).reshape(len(bi), -1).T
                cos[qi[:, None] == bi[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(bi, cos.shape), -np.round(cos, 12)))[:, :k]
                top = np.take_along_axis(cos, order, 1)
                ok = top >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, ok.sum(1))), pa.array(bi[order][ok]), pa.array(top[ok])], names=["src", "dst", "similarity"])

    # the smaller side's blocks meet the other's: rows here are whole blocks
    met = blocks(base, "bi", "bv").crossJoin(blocks(queries, "qi", "qv")).select("qi", "qv", "bi", "bv")
    found = met.mapInArrow(compare, "src long, dst long, similarity double")
    order = Window.partitionBy("src").orderBy(F.round("similarity", 12).desc(), "dst")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def centroids(df: DataFrame, label: str, embedding: str) -> DataFrame:
    """``(label, pos, value)``: the mean vector of each group, summed in each task first."""
    return df.select(label, F.posexplode(embedding).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def nearest_topic(df: DataFrame, key: str, embedding: str, means: DataFrame, most: int = 10_000) -> DataFrame:
    """``(key, topic, similarity)``: the topic whose mean vector has the greatest cosine, the smaller topic of equal ones.

    ``means`` is ``(label, pos, value)`` of ``centroids``; above ``most`` topics it is refused, because the means go
    to every task.  Vectors that are null, zero or of another length than the means have no topic.
    """
    import numpy as np

    rows = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("mean")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} topics")
    out = f"{key} {df.schema[key].dataType.simpleString()}, topic {means.schema['label'].dataType.simpleString()}, similarity double"
    rows = sorted((r for r in rows if r["label"] is not None and any(r["mean"])), key=lambda r: r["label"])
    if not rows:
        return df.sparkSession.createDataFrame([], out)
    labels, centres = [r["label"] for r in rows], np.array([r["mean"] for r in rows])
    centres /= np.sqrt((centres * centres).sum(1))[:, None]

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
                cos = x @ centres.T / np.sqrt((x * x).sum(1))[:, None]
                best = np.round(cos, 9).argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([labels[i] for i in best]).cast(pa.int32() if isinstance(labels[0], int) else pa.string()), pa.array(cos[np.arange(len(x)), best])],
                    names=[key, "topic", "similarity"],
                )

    good = df.where((vector.check(F.col(embedding), centres.shape[1]) == "ok"))
    return good.select(key, embedding).mapInArrow(assign, out)


def topic_terms(df: DataFrame, topic: str, key: str, text: str, k: int, scratch: Scratch, least: int = 4) -> DataFrame:
    """``(topic, term, score)``: the ``k`` terms of greatest TF-IDF of each topic.

    A term's frequency is its share of the topic's terms, its weight that of the
    smoothed inverse document frequency over all topics.  Terms under ``least``
    letters and null topics are left out; ties go to the smaller term.
    """
    kept = df.where(F.col(topic).isNotNull())
    found = kept.select(topic, key, F.explode(terms(F.col(text))).alias("term")).where(F.length("term") >= least)
    counts = found.groupBy(topic, key, "term").agg(F.count("*").alias("n")).groupBy(topic, "term").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    counts = scratch.save(counts)
    docs = kept.agg(F.count("*").alias("docs"))
    total = counts.groupBy(topic).agg(F.sum("n").alias("total"))
    seen = counts.groupBy("term").agg(F.sum("d").alias("df"))
    rows = counts.join(seen, "term").join(total, topic).crossJoin(F.broadcast(docs))  # one row
    score = F.round(F.col("n") / F.col("total") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1), 9)
    order = Window.partitionBy(topic).orderBy(F.col("score").desc(), "term")
    return rows.withColumn("score", score).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select(topic, "term", "score")


def elbow(df: DataFrame, embedding: str, most: int, least_size: int, seed: int = 42) -> DataFrame:
    """``(k, cost, chosen)`` for k from 1 to ``most``, or to as many as leave ``least_size`` rows each.

    ``chosen`` marks the k before the largest fall of the cost (the sum of squared
    distances to the centres); a single k is chosen itself.  Null vectors are left
    out; no vectors give no rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(embedding).isNotNull()).select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    rows = rows.cache()
    n = rows.count()
    costs = []
    if n:
        from pyspark.ml.stat import Summarizer

        spread = rows.select(Summarizer.metrics("variance").summary(F.col("features")).alias("s")).select("s.variance").first()[0]
        costs.append(float(sum(spread)) * (n - 1))
        for k in range(2, max(1, min(most, n // least_size)) + 1):
            costs.append(KMeans(k=k, seed=seed, maxIter=20).fit(rows).summary.trainingCost)
    rows.unpersist()
    falls = [b - a for a, b in zip(costs, costs[1:])]
    best = falls.index(min(falls)) + 1 if falls else 1
    return df.sparkSession.createDataFrame([(k, c, k == best) for k, c in enumerate(costs, 1)], "k int, cost double, chosen boolean")
