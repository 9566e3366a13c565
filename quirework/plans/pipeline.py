"""The document pipeline: chosen steps in their fixed order, each a frame to a frame.

Models are hooks.  Without one, texts are embedded by hashed term counts and
summarised by their leading sentences, so the pipeline runs without any model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import text
from quirework.operators import documents, redaction, search

Step = Callable[[DataFrame], DataFrame]
ORDER = ("load", "deduplicate", "pii", "summarize", "embed", "cluster", "index")
DIM = 64


def load(df: DataFrame) -> DataFrame:
    """Rows with a body that is not blank; the whole body without outer blanks."""
    return df.where(F.length(text.clean(F.col("body"))) > 0).withColumn("body", F.btrim("body"))


def deduplicate(df: DataFrame) -> DataFrame:
    """One row per body over the whole table, that of the smallest id."""
    first = documents.dedup_exact(df, "body", "id").select(F.col("first").alias("id"))
    return df.join(first, "id", "left_semi")


def pii(df: DataFrame) -> DataFrame:
    clean = redaction.redact(df, "id", "body")
    return df.drop("body").join(clean.select("id", F.col("redacted").alias("body"), F.col("matches").alias("pii_matches")), "id")


def summarize(df: DataFrame, words: int = 30) -> DataFrame:
    body = F.col("body")
    return df.withColumn("summary", F.when(text.word_count(body) < words, text.clean(body)).otherwise(text.leading_summary(body, words)))


def embed(df: DataFrame) -> DataFrame:
    """Hashed term counts of length one; a text without terms has none."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    listed = df.withColumn("__terms", search.terms(F.col("body")))
    counted = HashingTF(numFeatures=DIM, inputCol="__terms", outputCol="__tf").transform(listed)
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn("embedding", F.when(F.size("__terms") > 0, vector_to_array("__unit"))).drop("__terms", "__tf", "__unit")


def cluster(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """The nearest of ``k`` centres; rows without a vector keep a null cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = df.where("embedding is not null").withColumn("features", array_to_vector("embedding"))
    if usable.isEmpty():
        return df.withColumn("cluster", F.lit(None).cast("int"))
    labels = KMeans(k=k, seed=seed, predictionCol="cluster").fit(usable).transform(usable).select("id", "cluster")
    return df.join(labels, "id", "left")


STEPS: dict[str, Step] = {"load": load, "deduplicate": deduplicate, "pii": pii, "summarize": summarize, "embed": embed, "cluster": cluster}


def run(df: DataFrame, steps: tuple[str, ...] = ORDER[:-1], hooks: dict[str, Step] | None = None) -> DataFrame:
    """``df(id, body)`` through the chosen steps; ``hooks`` replace steps or name the ``index`` sink."""
    unknown = set(steps) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    for name in ORDER:
        step = {**STEPS, **(hooks or {})}.get(name)
        if name in steps and step:
            df = df.transform(step)
    return df
