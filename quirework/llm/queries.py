"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import clusters, mixing, neighbours, packing, pii, reading, tokens
from quirework.session import Scratch, read_table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    bodies = read_table(spark, base, "index_documents")
    return pii.spans(bodies, "record_id", "content_body", read_table(spark, base, "name_list")).drop("end_pos")


def p3_redacted(spark: SparkSession, base: str) -> DataFrame:
    bodies = read_table(spark, base, "index_documents").select("record_id", "content_body")
    return pii.redact(bodies, "content_body", read_table(spark, base, "name_list")).select("record_id", "redacted")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "index_documents").select("doc_id", "record_id", "embedding")
    near = neighbours.nearest(rows, "doc_id", "record_id", "embedding", Scratch(spark, "neighbours"), k=5, floor=0.975)
    return neighbours.pairs(near)


def p4_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """The five nearest of every document, whatever their cosine."""
    rows = read_table(spark, base, "index_documents").select("doc_id", "record_id", "embedding")
    return neighbours.nearest(rows, "doc_id", "record_id", "embedding", Scratch(spark, "neighbours"), k=5, paths=16, per_cell=1024, slack=0.1)


def _grouping(spark: SparkSession, base: str) -> clusters.Grouping:
    rows = read_table(spark, base, "index_documents").select("doc_id", "record_id", "embedding")
    return clusters.Grouping(rows, "doc_id", "record_id", "embedding", Scratch(spark, "clusters"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _grouping(spark, base).found()


def p5_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Communities of the groups of five or more, with size and most typical members."""
    return _grouping(spark, base).described().withColumn("typical", F.array_join("typical", ","))


def p5_quality(spark: SparkSession, base: str) -> DataFrame:
    """Rounds of neighbour descent and modularity of the communities."""
    return _grouping(spark, base).quality()


def _sizes(spark: SparkSession, base: str) -> DataFrame:
    return tokens.sized(read_table(spark, base, "documents").select("doc_id", "text"), "text")


def token_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Windows of 512 tokens with 50 shared, of every text."""
    cut = tokens.chunks(read_table(spark, base, "documents"), "doc_id", "text")
    return cut.select("doc_id", "pos", "n_tokens", F.md5("chunk").alias("chunk_hash"))


def p6_assignments(spark: SparkSession, base: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    return packing.pack(scratch.save(_sizes(spark, base)), read_table(spark, base, "pack_profiles"), scratch)


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    return packing.report(p6_assignments(spark, base), read_table(spark, base, "pack_profiles"))


def _mixed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "mixing")
    documents = read_table(spark, base, "documents").select("doc_id", "source", "text")
    sized = scratch.save(tokens.sized(documents, "text"))
    targets = read_table(spark, base, "mix_targets")
    return mixing.mix(sized, targets, scratch), sized, targets


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[0]


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, base))


def _levels(spark: SparkSession, base: str) -> DataFrame:
    documents, labels = read_table(spark, base, "documents"), read_table(spark, base, "reading_labels")
    return reading.levels(documents, labels, Scratch(spark, "reading"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _levels(spark, base).where("band is not null").select("doc_id", "band")


def p8_profile(spark: SparkSession, base: str) -> DataFrame:
    """Documents and words per source and band."""
    documents = read_table(spark, base, "documents").select(F.col("doc_id").cast("long"), "source")
    return (
        _levels(spark, base)
        .join(documents, "doc_id")
        .groupBy("source", "band")
        .agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.round(F.avg("posterior"), 4).alias("posterior"))
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p5_quality": p5_quality,
    "token_chunks": token_chunks,
    "p6_assignments": p6_assignments,
    "p6_report": p6_report,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
}

# all pairs of usable vectors, for small tables
_UNITS = """u AS (SELECT doc_id, arg_min(CAST(embedding AS DOUBLE[]), record_id) AS v FROM index_documents WHERE doc_id IS NOT NULL AND len(embedding) = 64
 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 GROUP BY doc_id)"""
SQL: dict[str, str] = {
    "p4_found": f"""WITH {_UNITS}, c AS (SELECT a.doc_id AS a, b.doc_id AS b, round(list_cosine_similarity(a.v, b.v), 7) AS cos FROM u a JOIN u b ON a.doc_id <> b.doc_id),
 n AS (SELECT a, b, cos FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) <= 5)
 SELECT DISTINCT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM n WHERE cos >= 0.975""",
    "p5_found": f"""WITH RECURSIVE {_UNITS}, e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.doc_id <> b.doc_id WHERE list_cosine_similarity(a.v, b.v) >= 0.8),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 m AS (SELECT a AS doc_id, least(a, min(b)) AS cluster_id FROM r GROUP BY a)
 SELECT cluster_id, doc_id FROM m QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 5""",
}
