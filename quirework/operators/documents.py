"""Versions, deduplication, filters, updates and relations of document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text, vector


def dedup_exact(df: DataFrame, body: str, order: str) -> DataFrame:
    """``(body_hash, first, copies)``: equal trimmed bodies, the smallest ``order`` first.

    Null and blank bodies are no documents.  The hash is aggregated in each task
    before the shuffle, so a body that a third of all rows share is no hot group.
    """
    trimmed = F.btrim(F.col(body), F.lit(" \t\r\n"))
    return df.where(F.length(trimmed) > 0).groupBy(F.sha2(trimmed, 256).alias("body_hash")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def document_hash(*parts: str) -> Column:
    """SHA-256 of the parts put end to end, null parts as empty texts."""
    return F.sha2(F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key (upsert, the latest wins).  Orders of a key are distinct."""
    row = F.struct(F.col(order), *[F.col(c) for c in df.columns if c not in (key, order)])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.col(order)).alias("row"))
    return best.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns])


def content_status(body: str, title: str, version: str, limit: int = 100 * 1024, least: int = 10) -> Column:
    """The first failing check of a document row, or ``ok``."""
    b = F.col(body)
    return (
        F.when(b.isNull(), "body_missing")
        .when(F.length(text.clean(b)) == 0, "body_blank")
        .when(F.octet_length(b) > limit, "body_too_large")
        .when(b.contains("\x00") | b.contains("\x1b"), "control_character")
        .when(F.length(F.btrim(b)) < least, "body_too_short")
        .when(F.coalesce(F.btrim(F.col(title)), F.lit("")) == "", "title_empty")
        .when(F.col(version).isNull() | (F.col(version) <= 0), "version")
        .otherwise("ok")
    )


def relation_status(key: str, parent: str, chunks: str, most: int = 1000) -> Column:
    """Parent and chunk id checks of a row."""
    c = F.coalesce(F.col(chunks), F.array().cast("array<string>"))
    return (
        F.when(F.col(parent) == F.col(key), "own_parent")
        .when(F.exists(c, lambda x: x.isNull()), "chunk_null")
        .when(F.size(F.array_distinct(c)) < F.size(c), "chunk_repeated")
        .when(F.array_contains(c, F.col(key)), "own_chunk")
        .when(F.size(c) > most, "too_many_chunks")
        .otherwise("ok")
    )


def page(df: DataFrame, condition: Column, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of the matching rows with ``total``, the number of all matches.

    Rows are filtered before they are limited.  The total is counted beside the
    page, not by a window over one partition.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    kept = df.where(condition)
    total = kept.agg(F.count("*").alias("total"))
    return kept.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the non-null values of ``changes`` (one row per key) in place of its own."""
    given = [c for c in changes.columns if c != key]
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in given])
    joined = df.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in df.columns])


def deleted(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """``df`` without the keys of ``tombstones``; unknown keys are tolerated."""
    return df.join(tombstones.select(key).distinct(), key, "left_anti")


def version_changes(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """``(key, order, change_type, previous, new)``: each version of a key against the one before."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.where(F.col(key).isNotNull()).select(key, order, value.alias("new"))
    rows = rows.withColumn("previous", F.lag("new").over(w)).withColumn("nth", F.row_number().over(w))
    kind = F.when(F.col("nth") == 1, "created").when(F.col("new").eqNullSafe(F.col("previous")), "unchanged").otherwise("updated")
    return rows.select(key, order, kind.alias("change_type"), "previous", "new")


def weekly(df: DataFrame, ts: str) -> DataFrame:
    """``(week, documents)``, weeks from Monday."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("documents"))


def embedding_status(df: DataFrame, record: str, embedding: str, dim: int) -> DataFrame:
    return df.select(record, vector.check(F.col(embedding), dim).alias("status"))


def conform(df: DataFrame, names: dict[str, str], constants: dict[str, Column]) -> DataFrame:
    """One source's rows in the common shape; columns it lacks are null."""
    cols = [(F.col(old) if old in df.columns else F.lit(None).cast("string")).alias(new) for new, old in names.items()]
    return df.select(*cols, *[c.alias(n) for n, c in constants.items()])
