"""Edges and events that are added to what is stored: guards, merges, removals, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.references import REVERSE, _literal_map


def guarded(proposed: DataFrame, edges: DataFrame, intervals: DataFrame, on_circles: DataFrame) -> DataFrame:
    """``(parent, child, status)``: what is to become of each proposed edge.

    ``unknown_parent`` and ``unknown_child`` have no record, ``exists`` is stored
    already, ``circle`` would close a circle (a self-link is one) and ``ok`` may be
    added.  ``intervals`` are those of ``hierarchy.intervals`` and ``on_circles``
    the rows of ``hierarchy.circles``: the child is above the parent if the child's
    interval holds the parent's number, or if it lies on the circle that the
    parent's way up enters.  So no walk is needed, however deep the parent lies.
    Each edge is checked against what is stored, not against the other proposals;
    nulls at either end are no edges, repeated ones count once.
    """
    asked = proposed.select("parent", "child").where("parent is not null and child is not null").distinct()
    at = intervals.select(F.col("doc_id").alias("parent"), F.col("root_id").alias("parent_root"), F.col("first").alias("at"))
    over = intervals.select(F.col("doc_id").alias("child"), F.col("root_id").alias("child_root"), "first", "last")
    ring = on_circles.select(F.col("doc_id").alias("child"), F.col("circle_id").alias("ring"))
    stored = edges.select("parent", "child").distinct().withColumn("stored", F.lit(True))
    rows = asked.join(at, "parent", "left").join(over, "child", "left").join(ring, "child", "left").join(stored, ["parent", "child"], "left")
    above = (F.col("parent_root") == F.col("child_root")) & F.col("at").between(F.col("first"), F.col("last"))
    status = (
        F.when(F.col("at").isNull(), "unknown_parent")
        .when(F.col("first").isNull(), "unknown_child")
        .when(F.col("stored"), "exists")
        .when((F.col("parent") == F.col("child")) | above | (F.col("ring") == F.col("parent_root")), "circle")
        .otherwise("ok")
    )
    return rows.select("parent", "child", status.alias("status"))


def removed(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``(src, dst, ref_type)`` without the edges of ``gone`` and their reverses; a null type there means any."""
    kind = F.coalesce(F.try_element_at(_literal_map(REVERSE), F.col("ref_type")), F.col("ref_type"))
    out = gone.select("src", "dst", "ref_type")
    out = out.union(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"), kind.alias("ref_type"))).distinct()
    every = out.where("ref_type is null").select("src", "dst")
    return edges.join(out.where("ref_type is not null"), ["src", "dst", "ref_type"], "left_anti").join(every, ["src", "dst"], "left_anti").select("src", "dst", "ref_type")


def of_type(edges: DataFrame, ref_type: str | None) -> DataFrame:
    """``(src, ref_type, targets)``: distinct targets of each source by type, or of one type only."""
    kept = edges if ref_type is None else edges.where(F.col("ref_type") == ref_type)
    return kept.select("src", "ref_type", "dst").distinct().groupBy("src", "ref_type").agg(F.count("*").alias("targets"))


def edge_status(ref_type: str, similarity: str, citation_type: str) -> Column:
    """A similar edge needs a similarity in [0, 1], a citation its type."""
    s = F.col(similarity)
    return (
        F.when((F.col(ref_type) == "similar") & ~F.coalesce(s.between(0, 1) & ~F.isnan(s), F.lit(False)), "similarity")
        .when((F.col(ref_type) == "citation") & F.col(citation_type).isNull(), "citation_type")
        .otherwise("ok")
    )


def relation(similarity: Column) -> Column:
    """The edge type of a similarity; null for null."""
    return F.when(similarity >= 0.7, "similar").when(similarity >= 0.5, "context").when(similarity.isNotNull(), "related")


def merged(df: DataFrame, key: str, fields: str, order: str) -> DataFrame:
    """``(key, field, value)``: maps of a key merged field by field, the greatest ``order`` that fills a field wins.

    Null values do not overwrite; null maps and keys count for nothing.
    """
    flat = df.where(F.col(key).isNotNull()).select(key, order, F.explode(fields).alias("field", "value")).where("value is not null")
    return flat.groupBy(key, "field").agg(F.max_by("value", order).alias("value"))


def metric_values(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``(key, last, total)`` of metric events: the value last set, and the sum of all as increments; nulls count for nothing."""
    given = events.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return given.groupBy(key).agg(F.max_by(value, F.struct(*order, value)).alias("last"), F.sum(value).alias("total"))


def bounded(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """``df`` with ``nth``: the newest ``most`` rows of each key, numbered from 1.

    Ranks are limited in each task before the shuffle, so no key brings more than
    ``most`` rows of a task along.  ``order`` tells all rows of a key apart.
    """
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= most)


def traversed(edges: DataFrame, starts: DataFrame, depth: int, types: list[str] | None = None, least: float | None = None) -> DataFrame:
    """``(id, hops)``: what can be reached from ``starts(id)`` in at most ``depth`` edges, with the fewest hops.

    Only edges of ``types`` and of a ``weight`` of ``least`` or more are followed.
    One join a hop; what was reached before is not visited again.
    """
    ways = edges if types is None else edges.where(F.col("ref_type").isin(*types))
    ways = (ways if least is None else ways.where(F.col("weight") >= least)).select("src", "dst").distinct()
    reached = front = starts.select("id").where("id is not null").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = front.join(ways, front["id"] == ways["src"]).select(F.col("dst").alias("id")).distinct()
        front = step.join(reached, "id", "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(front)
    return reached


def quality_score(completeness: Column, consistency: Column, readability: Column, accuracy: Column) -> Column:
    return 0.3 * completeness + 0.2 * consistency + 0.2 * readability + 0.3 * accuracy


def authority_score(reputation: Column, verification: Column, expertise: Column, trust: Column) -> Column:
    """A missing part counts 0."""
    r, v, e, t = (F.coalesce(c, F.lit(0.0)) for c in (reputation, verification, expertise, trust))
    return 0.3 * r + 0.3 * v + 0.2 * e + 0.2 * t


def update_frequency(updates: Column, seconds: Column) -> Column:
    """Updates over the seconds since the last one, at most one a second."""
    return F.least(F.lit(1.0), updates / F.greatest(seconds.cast("double"), F.lit(1.0)))


def reliability_score(authority: Column, quality: Column, completeness: Column, frequency: Column) -> Column:
    return 0.3 * authority + 0.3 * quality + 0.2 * completeness + 0.2 * F.least(frequency, F.lit(1.0))


def retry_due(attempts: Column, most: Column, started: Column, timeout: Column, due: Column, now: Column) -> Column:
    """Whether an item may be tried again: attempts left, not timed out, its time come.  Null bounds do not bind."""
    left = F.coalesce(attempts < most, F.lit(True))
    return left & F.coalesce(now - started <= timeout, F.lit(True)) & F.coalesce(due <= now, F.lit(True))


def statement_kind(sql: Column) -> Column:
    """select, insert, update, delete or other, by the first word."""
    word = F.lower(F.regexp_extract(F.coalesce(sql, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(word.isin("select", "insert", "update", "delete"), word).otherwise("other")


def json_shape(json: Column) -> tuple[Column, Column]:
    """``(depth, fields)`` of a JSON text: nesting of objects (arrays do not add) and keys at all levels; null for null."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "s")
    signs = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def step(acc: Column, sign: Column) -> Column:
        at = acc["at"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(acc["top"], at).alias("top"))

    return F.aggregate(signs, start, step, lambda acc: acc["top"]), F.regexp_count(bare, F.lit(r"s\s*:"))


def shaped(df: DataFrame, score: Column | None = None) -> DataFrame:
    """Flat index rows as results: ``(record_id, doc_id, content, metadata, score)``, the score 0 where there is none."""
    none = F.array().cast("array<string>")
    return df.select(
        "record_id",
        "doc_id",
        F.struct(F.col("content_body").alias("body"), F.col("content_summary").alias("summary"), F.col("content_title").alias("title")).alias("content"),
        F.struct("timestamp_utc", "schema_version", "parent_id", F.coalesce("chunk_ids", none).alias("chunk_ids")).alias("metadata"),
        F.coalesce(score if score is not None else F.lit(None).cast("double"), F.lit(0.0)).alias("score"),
    )
