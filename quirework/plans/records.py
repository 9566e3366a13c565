"""Queries of user rules, schema overlays, change logs, progress and profiles, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text
from quirework.operators import references, rules, search, steps, timestamps
from quirework.plans import reference, retrieval
from quirework.plans.reference import CLEAN, FACTS, T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query("""SELECT record_id, array_to_string(list_filter([CASE WHEN coalesce(trim(content_title), '') = '' THEN 'no title' END, CASE WHEN NOT coalesce(length(content_body) >= 200, false) THEN 'short body' END,
 CASE WHEN NOT coalesce(lower(trim(language)) IN ('en', 'de', 'fr'), false) THEN 'language' END, CASE WHEN NOT coalesce(schema_version > 0, false) THEN 'version' END], lambda x: x IS NOT NULL), '; ') AS violations FROM index_documents""")
def rule_violations(spark: SparkSession, base: str) -> DataFrame:
    """Each record with the messages of the registered rules that it breaks."""
    r = rules.Rules().add_check(F.btrim("content_title") != "", "no title").add_check(F.length("content_body") >= 200, "short body")
    r.add_check(F.lower(F.btrim("language")).isin("en", "de", "fr"), "language").add_check(F.col("schema_version") > 0, "version")
    return T(spark, base, "index_documents").select("record_id", F.array_join(r.violated(), "; ").alias("violations"))


@query(f"""WITH t AS (SELECT doc_id, lower({CLEAN.format('text')}) AS text FROM documents) SELECT doc_id, md5(text) AS text_hash FROM t WHERE length(text) >= 100 AND NOT contains(text, 'http')""")
def filtered_texts(spark: SparkSession, base: str) -> DataFrame:
    """Texts through registered transformers and filters."""
    r = rules.Rules().add_transformer(text.clean).add_transformer(F.lower)
    r.add_filter(lambda c: F.length(c) >= 100).add_filter(lambda c: ~c.contains("http"))
    return r.applied(T(spark, base, "documents"), "text").select("doc_id", F.md5("text").alias("text_hash"))


@query("""SELECT record_id, CASE WHEN metadata['pages'] IS NULL THEN 'missing:pages' WHEN metadata['type'] IS NULL THEN 'missing:type'
 WHEN try_cast(metadata['pages'] AS INTEGER) IS NULL THEN 'type:pages' ELSE 'ok' END AS status FROM lineage""")
def field_types(spark: SparkSession, base: str) -> DataFrame:
    """Custom fields of the lineage metadata against their types."""
    of = lambda n: F.col("metadata")[n]
    return T(spark, base, "lineage").select("record_id", rules.field_status({"pages": (of("pages"), "int"), "type": (of("type"), "string")}).alias("status"))


@query("""SELECT doc_id, source, CAST(n_chars AS VARCHAR) AS n_chars, CAST(NULL AS DOUBLE) AS priority, regexp_extract(source, '([a-z]+)$', 1) AS tenant_id FROM documents WHERE source IS NOT NULL""")
def tenant_overlay(spark: SparkSession, base: str) -> DataFrame:
    """Documents in a tenant's schema: one field of another type, one that is new, and the tenant."""
    rows = T(spark, base, "documents").where("source is not null").withColumn("tenant_id", F.regexp_extract("source", "([a-z]+)$", 1))
    schema = rules.overlay(rows.select("doc_id", "source", "n_chars").schema, {"n_chars": "string", "priority": "double"}, "tenant_id")
    return rules.conformed(rows, schema)


@query(f"""WITH {FACTS}, tag AS (SELECT DISTINCT source, epoch_us(date_trunc('month', ts)) AS us FROM facts WHERE source IS NOT NULL),
 ch AS (SELECT source, epoch_us(ts) AS us, max(doc_id || '/' || lpad(CAST(seq AS VARCHAR), 6, '0')) AS change FROM facts WHERE source IS NOT NULL AND doc_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
 last AS (SELECT t.source, max(c.us) AS us FROM tag t JOIN ch c ON c.source = t.source AND c.us <= t.us GROUP BY t.source, t.us)
 SELECT DISTINCT ch.source, ch.us, ch.change FROM ch JOIN last USING (source, us) WHERE us BETWEEN 1640995200000000 AND 1704067199999999""")
def change_log(spark: SparkSession, base: str) -> DataFrame:
    """Changes in a time range, both ends included, that a monthly tag points to."""
    rows = steps.facts(T(spark, base, "processing_steps")).where("source is not null").withColumn("us", F.unix_micros("ts"))
    tags = rows.select("source", F.unix_micros(F.date_trunc("month", "ts")).alias("us")).distinct()
    name = F.concat("doc_id", F.lit("/"), F.lpad(F.col("seq").cast("string"), 6, "0"))
    changes = rows.where("doc_id is not null and seq is not null and us is not null").groupBy("source", "us").agg(F.max(name).alias("change"))
    return steps.change_log(changes, "source", 1640995200000000, 1704067199999999, tags)


@query()
def lineage_created(spark: SparkSession, base: str) -> DataFrame:
    """Lineage snapshots created in a time range, whatever the notation of their time."""
    rows = T(spark, base, "lineage").select("record_id", "doc_id", "created_at", F.col("origin_source").alias("source"))
    read = timestamps.normalise(rows, "created_at", "source", T(spark, base, "source_systems"))
    return read.where(F.col("utc_micros").between(1640995200000000, 1704067199999999)).select("record_id", "doc_id", "utc_micros")


@query(f"""WITH {FACTS}, e AS (SELECT max(epoch_us(ts)) AS now_us FROM facts), f AS (SELECT *, epoch_us(ts) >= now_us - 86400000000 AS late FROM facts, e WHERE ts IS NOT NULL)
 SELECT count(DISTINCT doc_id) AS documents, count(*) AS steps, count(*) FILTER (status IN ('failed', 'error')) AS failed, count(*) FILTER (status IN ('in_progress', 'running')) AS active,
 count(DISTINCT doc_id) FILTER (late) AS recent_documents, count(*) FILTER (late) AS recent_steps, count(*) FILTER (late AND status IN ('failed', 'error')) AS recent_failed,
 count(*) FILTER (late AND status IN ('in_progress', 'running')) AS recent_active FROM f""")
def recent_status(spark: SparkSession, base: str) -> DataFrame:
    """Documents and steps of all times and of the last day before the last step."""
    return steps.recent_status(T(spark, base, "processing_steps"), 86400)


@query("""SELECT record_id, unnest(map_keys(metadata)) AS field, unnest(map_values(metadata)) AS value FROM lineage""")
def metadata_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Metadata written as JSON text and read back."""
    json = F.to_json("metadata", {"ignoreNullFields": "false"})
    rows = T(spark, base, "lineage").select("record_id", json.alias("metadata_json"))
    return rows.select("record_id", F.explode(F.from_json("metadata_json", "map<string,string>")).alias("field", "value"))


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS greatest FROM document_metadata"
    for c in ("record_id", "doc_id", "title", "source", "author", "path", "language", "timestamp_utc")
)


@query(_STATS)
def column_stats(spark: SparkSession, base: str) -> DataFrame:
    """Filled, missing and distinct values and bounds of each column of a table."""
    rows = T(spark, base, "document_metadata")
    return rules.column_stats(rows, ["record_id", "doc_id", "title", "source", "author", "path", "language", "timestamp_utc"])


@query(f"""WITH f AS (SELECT step_name, status, count(*) AS n FROM (SELECT DISTINCT doc_id, seq, step_name, status, ts, source, duration_ms FROM processing_steps) WHERE status IN ('failed', 'error') AND step_name IS NOT NULL GROUP BY 1, 2)
 SELECT step_name, step_name || ': ' || CAST(sum(n) AS VARCHAR) || ' (' || string_agg(status || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY status) || ')' AS report FROM f GROUP BY step_name""")
def error_summary(spark: SparkSession, base: str) -> DataFrame:
    """One line of text for each failing kind of step."""
    return steps.error_summary(T(spark, base, "processing_steps"))


@query(f"""WITH {FACTS}, b AS (SELECT source, date_trunc('day', ts) AS batch, count(*) AS items, count(*) FILTER (status IN ('failed', 'error')) AS failed, CAST(sum(CAST(round(duration_ms * 1000) AS BIGINT)) AS BIGINT) AS us
 FROM facts WHERE source IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
 SELECT source, count(*) AS batches, CAST(sum(items) AS BIGINT) AS items, CAST(sum(failed) AS BIGINT) AS failed, round(100.0::DOUBLE * (sum(items) - sum(failed)) / sum(items), 2) AS percent_done,
 min(us) AS fastest_us, max(us) AS slowest_us, CAST(sum(us) // count(us) AS BIGINT) AS mean_us, round(sum(CASE WHEN us IS NOT NULL THEN items END) * 1000000.0::DOUBLE / nullif(sum(us), 0), 6) AS items_per_second FROM b GROUP BY source""")
def batch_progress(spark: SparkSession, base: str) -> DataFrame:
    """Progress of each source, a day's steps being a batch."""
    rows = steps.facts(T(spark, base, "processing_steps")).where("source is not null and ts is not null")
    us = F.round(F.col("duration_ms") * 1000).cast("long")
    return steps.progress(rows.select("source", "status", F.date_trunc("day", "ts").alias("batch"), us.alias("us")), "source", "batch", "us")


@query("""WITH s AS (SELECT event_type, epoch_us(ts) AS us, event_id, value FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
 d AS (SELECT event_type, us // 3600000000 * 3600000000 AS start_us, value, lag(value) OVER (PARTITION BY event_type ORDER BY us, event_id) AS last FROM s)
 SELECT event_type, start_us, round(sum(CASE WHEN last IS NULL THEN 0 WHEN value >= last THEN value - last ELSE value END), 4) AS increase FROM d GROUP BY 1, 2""")
def counter_increase(spark: SparkSession, base: str) -> DataFrame:
    """Hourly increase of the values of each type of event read as a counter that may begin anew."""
    rows = T(spark, base, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return steps.increase(rows, "event_type", "us", "event_id", "value", 3600)


@query(f"""WITH c AS (SELECT label, list(v ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x) AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY label),
 s AS (SELECT record_id, label, round({retrieval._COS.format('i.embedding', 'c.mean')}, 9) AS cos FROM index_documents i, c WHERE {retrieval._OK.format('i.embedding')})
 SELECT record_id, label AS topic, round(cos, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY cos DESC, label) = 1""")
def nearest_topic(spark: SparkSession, base: str) -> DataFrame:
    """The topic of each indexed record by the means of the labelled vectors."""
    means = search.centroids(T(spark, base, "embeddings"), "label", "embedding")
    out = search.nearest_topic(T(spark, base, "index_documents"), "record_id", "embedding", means)
    return out.withColumn("similarity", F.round(F.round("similarity", 9), 6))


@query(f"""WITH {reference._EDGES} SELECT parent, child, '{{"type":"child"' || CASE WHEN told_by <> 'both' THEN ',"told_by":"' || told_by || '"' ELSE '' END || '}}' AS metadata_json FROM edges""")
def edge_metadata_json(spark: SparkSession, base: str) -> DataFrame:
    """Links with their metadata as JSON, fields that are null left out."""
    edges = references.lineage_edges(T(spark, base, "lineage"))
    told = F.when(F.col("told_by") != "both", F.col("told_by")).alias("told_by")
    return edges.select("parent", "child", F.to_json(F.struct(F.lit("child").alias("type"), told)).alias("metadata_json"))


@query("""SELECT step_name, status, count(*) AS calls, count(*) FILTER (duration_ms <= 10) AS le_10, count(*) FILTER (duration_ms <= 100) AS le_100, count(*) FILTER (duration_ms <= 1000) AS le_1000,
 count(duration_ms) AS le_inf, round(sum(duration_ms), 3) AS total_ms FROM processing_steps GROUP BY 1, 2""")
def duration_buckets(spark: SparkSession, base: str) -> DataFrame:
    """Calls and durations of each kind of step and outcome in cumulative buckets."""
    ms = F.col("duration_ms")
    buckets = [F.count_if(ms <= n).alias(f"le_{n}") for n in (10, 100, 1000)]
    total = F.round(F.sum(ms), 3).alias("total_ms")
    return T(spark, base, "processing_steps").groupBy("step_name", "status").agg(F.count("*").alias("calls"), *buckets, F.count(ms).alias("le_inf"), total)


@query(f"""WITH l AS ({retrieval.SQL['topic_labels']}), c AS ({reference.SQL['chunk_words']}), t AS (SELECT source, string_agg(term, ',' ORDER BY score DESC, term) AS topics FROM l GROUP BY source)
 SELECT c.doc_id, c.pos, c.chunk_hash, t.topics FROM c JOIN documents d USING (doc_id) LEFT JOIN t ON t.source = d.source""")
def enriched_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of words with the topic labels of their source, joined by id."""
    terms = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))), lambda x: x["term"])
    labels = retrieval.topic_labels(spark, base).groupBy("source").agg(F.array_join(terms, ",").alias("topics"))
    sources = T(spark, base, "documents").select("doc_id", "source").join(labels, "source", "left").select("doc_id", "topics")
    return reference.chunk_words(spark, base).join(sources, "doc_id")
