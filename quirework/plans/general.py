"""Queries of the general problems: hierarchies and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import hierarchy, timestamps
from quirework.session import Scratch, read_table


def _labelled(spark: SparkSession, base: str):
    scratch = Scratch(spark, "hierarchy")
    nodes, edges = hierarchy.links(read_table(spark, base, "lineage"), scratch)
    return nodes, edges, hierarchy.label(nodes, edges, scratch)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.found(*_labelled(spark, base))


def p1_paths(spark: SparkSession, base: str) -> DataFrame:
    nodes, _, labels = _labelled(spark, base)
    out = hierarchy.paths(nodes, labels)
    return out.selectExpr("doc_id", "root_id", "depth", "array_join(path, '/') AS path", "n_descendants")


def p1_descendants(spark: SparkSession, base: str) -> DataFrame:
    nodes, _, labels = _labelled(spark, base)
    return hierarchy.descendants(nodes, labels)


def p1_circles(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.circles(*_labelled(spark, base))


def p1_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Links to a second or later parent, which the other results leave out."""
    nodes, edges = hierarchy.links(read_table(spark, base, "lineage"), Scratch(spark, "hierarchy"))
    return hierarchy.named_conflicts(nodes, edges)


def p1_segments(spark: SparkSession, base: str) -> DataFrame:
    """Paths as stretches of chains, at most log2(n) of them a document."""
    nodes, _, labels = _labelled(spark, base)
    return hierarchy.segments(nodes, labels)


def p1_intervals(spark: SparkSession, base: str) -> DataFrame:
    """Descendants as an interval of the root's numbering."""
    nodes, _, labels = _labelled(spark, base)
    return hierarchy.intervals(nodes, labels)


TIME_FIELDS = (
    ("index_documents", "timestamp_utc", "source"),
    ("document_metadata", "last_modified_utc", "source"),
    ("lineage", "created_at", "origin_source"),
)


def _written_times(spark: SparkSession, base: str) -> DataFrame:
    """The values of the three fields as ``(table_name, record_id, written, source)``."""
    tables = [
        read_table(spark, base, table).select(
            F.lit(table).alias("table_name"), "record_id", F.col(field).alias("written"), F.col(source).alias("source")
        )
        for table, field, source in TIME_FIELDS
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    values = _written_times(spark, base).where(~F.col("written").rlike(timestamps.ISO_UTC))
    out = timestamps.normalise(values, "written", "source", read_table(spark, base, "source_systems"))
    return out.where("utc_micros IS NOT NULL").select("table_name", "record_id", "utc_micros")


def p2_normalised(spark: SparkSession, base: str) -> DataFrame:
    """Every value of the three fields with its instant, status, format and posterior."""
    values = _written_times(spark, base)
    out = timestamps.normalise(values, "written", "source", read_table(spark, base, "source_systems"), declared="prior")
    return out.select("table_name", "record_id", "utc_micros", "status", "format", "posterior")


QUERIES = {
    "p1_found": p1_found,
    "p1_paths": p1_paths,
    "p1_descendants": p1_descendants,
    "p1_circles": p1_circles,
    "p1_conflicts": p1_conflicts,
    "p1_segments": p1_segments,
    "p1_intervals": p1_intervals,
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
}
