"""Queries of the document system's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text, vector
from quirework.operators import chunking, documents, redaction, references, search, steps, timestamps
from quirework.plans import pipeline
from quirework.session import Scratch, read_table
from quirework.sources.files import log_status
from quirework.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


T = read_table
CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\r\n\f]+', ' ', 'g'))"
FACTS = "facts AS (SELECT DISTINCT doc_id, seq, step_name, status, ts, source, duration_ms FROM processing_steps)"
LATEST = (
    FACTS
    + """, latest AS (SELECT doc_id, max(struct_pack(seq := seq, us := epoch_us(ts), step_name := step_name, status := status)) AS m,
 min(epoch_us(ts)) AS first_micros, max(epoch_us(ts)) AS last_micros, count(*) AS steps FROM facts WHERE doc_id IS NOT NULL GROUP BY doc_id)"""
)


# ---- documents -------------------------------------------------------------


@query("""SELECT sha256(trim(content_body, E' \\t\\r\\n')) AS body_hash, min(record_id) AS first, count(*) AS copies FROM index_documents
 WHERE length(trim(content_body, E' \\t\\r\\n')) > 0 GROUP BY 1""")
def dedup_exact(spark: SparkSession, base: str) -> DataFrame:
    return documents.dedup_exact(T(spark, base, "index_documents"), "content_body", "record_id")


@query("""SELECT sha256(coalesce(content_body, '') || coalesce(content_title, '') || coalesce(timestamp_utc, '')) AS document_hash,
 min(record_id) AS first, count(*) AS copies FROM index_documents GROUP BY 1""")
def dedup_hash(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents").withColumn("document_hash", documents.document_hash("content_body", "content_title", "timestamp_utc"))
    return rows.groupBy("document_hash").agg(F.min("record_id").alias("first"), F.count("*").alias("copies"))


_NEWEST = """SELECT doc_id, record_id, content_title FROM index_documents WHERE doc_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY record_id DESC) = 1"""


@query(_NEWEST)
def latest_version(spark: SparkSession, base: str) -> DataFrame:
    """The newest record of each document; one without a title is the newest all the same."""
    return documents.latest(T(spark, base, "index_documents").select("doc_id", "record_id", "content_title"), "doc_id", "record_id")


@query(_NEWEST)
def latest_record(spark: SparkSession, base: str) -> DataFrame:
    """The newest record of each document, whether it has a title or not."""
    return documents.latest(T(spark, base, "index_documents").select("doc_id", "record_id", "content_title"), "doc_id", "record_id")


@query(f"""SELECT record_id, md5({CLEAN.format('content_body')}) AS cleaned, CASE WHEN {CLEAN.format('content_body')} = '' THEN 0
 ELSE len(string_split({CLEAN.format('content_body')}, ' ')) END AS words FROM index_documents""")
def clean_words(spark: SparkSession, base: str) -> DataFrame:
    body = F.col("content_body")
    return T(spark, base, "index_documents").select("record_id", F.md5(text.clean(body)).alias("cleaned"), text.word_count(body).cast("long").alias("words"))


@query("""SELECT record_id, substring(content_body, 1, 8192) AS body FROM index_documents WHERE length(trim(content_body, E' \\t\\r\\n')) > 0""")
def length_gate(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents").where(F.length(F.btrim(F.col("content_body"), F.lit(" \t\r\n"))) > 0)
    return rows.select("record_id", text.truncate(F.col("content_body"), 8192).alias("body"))


@query("""SELECT doc_id, CAST(n AS INTEGER) AS pos, length(chunk) AS n_chars, md5(chunk) AS chunk_hash FROM (
 SELECT doc_id, n, substring(text, CAST(n * 462 + 1 AS INTEGER), 512) AS chunk FROM
 (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 462.0) AS BIGINT) - 1)) AS n FROM documents WHERE length(text) > 0))""")
def chunk_chars(spark: SparkSession, base: str) -> DataFrame:
    cut = text.chunks_by_chars(T(spark, base, "documents"), "doc_id", "text", 512, 50)
    return cut.select("doc_id", "pos", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("chunk_hash"))


@query(f"""SELECT doc_id, CAST(n AS INTEGER) AS pos, md5(array_to_string(w[n * 80 + 1 : n * 80 + 100], ' ')) AS chunk_hash FROM (
 SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 100 THEN 0 ELSE CAST(ceil((len(w) - 100) / 80.0) AS BIGINT) END)) AS n
 FROM (SELECT doc_id, string_split({CLEAN.format('text')}, ' ') AS w FROM documents WHERE {CLEAN.format('text')} <> ''))""")
def chunk_words(spark: SparkSession, base: str) -> DataFrame:
    cut = text.chunks_by_words(T(spark, base, "documents"), "doc_id", "text", 100, 20)
    return cut.select("doc_id", "pos", F.md5("chunk").alias("chunk_hash"))


_PII_SQL = ", ".join(
    f"len(regexp_extract_all(coalesce(content_body, ''), '{p}', 0, 'i')) AS {n}" for n, p in text.PII_PATTERNS.items()
)


@query(f"SELECT record_id, {_PII_SQL} FROM index_documents")
def pii_pattern_counts(spark: SparkSession, base: str) -> DataFrame:
    counts = text.pattern_counts(F.col("content_body"))
    return T(spark, base, "index_documents").select("record_id", *[c.cast("long").alias(n) for n, c in counts.items()])


_FOUND = "len(regexp_extract_all(coalesce(content_body, ''), '{}'))"
_CITED = {
    "direct_quote": _FOUND.format('"([^"]+)"|“([^”]+)”'),
    "inline_reference": _FOUND.format(text.CITATION_FAMILIES["inline_reference"].replace('\\"', '"')),
    "numbered_reference": _FOUND.format(text.CITATION_FAMILIES["numbered_reference"]),
    "author_year": _FOUND.format(text.CITATION_FAMILIES["author_year"]),
    # this engine has no look-behind: those in brackets less those behind a digit
    "footnote": f"{_FOUND.format(r'\[(\d+)\]')} - {_FOUND.format(r'[0-9]\[(\d+)\]')} + {_FOUND.format(r'\{{\^(\d+)\}}')}",
    "url": _FOUND.format(text.CITATION_FAMILIES["url"]),
}


@query("SELECT record_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _CITED.items()) + " FROM index_documents")
def citation_counts(spark: SparkSession, base: str) -> DataFrame:
    """Matches of all citation families."""
    return citation_all_counts(spark, base)


@query()
def pii_all_counts(spark: SparkSession, base: str) -> DataFrame:
    """Matches of all personal-data patterns, phones and cards included."""
    counts = text.pattern_counts(F.col("content_body"))
    return T(spark, base, "index_documents").select("record_id", *[c.cast("long").alias(n) for n, c in counts.items()])


@query()
def citation_all_counts(spark: SparkSession, base: str) -> DataFrame:
    """Matches of all citation families; DuckDB's engine has no look-behind."""
    body = F.coalesce("content_body", F.lit(""))
    counts = [F.regexp_count(body, F.lit(p)).cast("long").alias(k) for k, p in text.CITATION_FAMILIES.items()]
    return T(spark, base, "index_documents").select("record_id", *counts)


@query(f"""SELECT record_id, CASE WHEN content_body IS NULL THEN 'body_missing' WHEN length({CLEAN.format('content_body')}) = 0 THEN 'body_blank'
 WHEN octet_length(encode(content_body)) > 102400 THEN 'body_too_large' WHEN contains(content_body, chr(27)) THEN 'control_character'
 WHEN length(trim(content_body)) < 10 THEN 'body_too_short' WHEN coalesce(trim(content_title), '') = '' THEN 'title_empty'
 WHEN schema_version IS NULL OR schema_version <= 0 THEN 'version' ELSE 'ok' END AS status FROM index_documents""")
def content_checks(spark: SparkSession, base: str) -> DataFrame:
    return T(spark, base, "index_documents").select("record_id", documents.content_status("content_body", "content_title", "schema_version").alias("status"))


@query("""SELECT record_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension'
 WHEN len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) > 0 THEN 'not_finite'
 WHEN len([x for x in embedding if x <> 0]) = 0 THEN 'zero' ELSE 'ok' END AS status FROM index_documents""")
def embedding_checks(spark: SparkSession, base: str) -> DataFrame:
    return documents.embedding_status(T(spark, base, "index_documents"), "record_id", "embedding", 64)


@query("""SELECT record_id, CASE WHEN parent_id = doc_id THEN 'own_parent' WHEN len([x for x in coalesce(chunk_ids, []) if x IS NULL]) > 0 THEN 'chunk_null'
 WHEN len(list_distinct(coalesce(chunk_ids, []))) < len(coalesce(chunk_ids, [])) THEN 'chunk_repeated'
 WHEN list_contains(coalesce(chunk_ids, []), doc_id) THEN 'own_chunk' WHEN len(coalesce(chunk_ids, [])) > 1000 THEN 'too_many_chunks' ELSE 'ok' END AS status FROM index_documents""")
def relation_checks(spark: SparkSession, base: str) -> DataFrame:
    return T(spark, base, "index_documents").select("record_id", documents.relation_status("doc_id", "parent_id", "chunk_ids").alias("status"))


_STATS = "SELECT lower(file_type) AS file_type, count(*) AS documents, sum(length(text)) AS characters FROM documents WHERE coalesce(trim(file_type), '') <> '' GROUP BY 1"


@query(_STATS.replace("sum(length(text))", "CAST(sum(length(text)) AS BIGINT)"))
def stats_by_type(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "documents").where("coalesce(trim(file_type), '') <> ''")
    return rows.groupBy(F.lower("file_type").alias("file_type")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query("""WITH m AS (SELECT doc_id, title, epoch_us(added_at) AS added FROM documents WHERE lower(file_type) = 'md' AND epoch_us(added_at) BETWEEN 1577836800000000 AND 1672531199999999)
 SELECT doc_id, title, added, (SELECT count(*) FROM m) AS total FROM m ORDER BY added DESC, doc_id LIMIT 10 OFFSET 5""")
def filtered_page(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "documents").withColumn("added", F.unix_micros("added_at"))
    wanted = (F.lower("file_type") == "md") & F.col("added").between(1577836800000000, 1672531199999999)
    return documents.page(rows, wanted, [F.col("added").desc(), F.col("doc_id")], 10, 5).select("doc_id", "title", "added", "total")


@query("SELECT record_id, doc_id FROM index_documents WHERE timestamp_utc >= '2022-01-01T00:00:00Z' AND timestamp_utc <= '2023-12-31T23:59:59Z' AND length(timestamp_utc) = 20 AND timestamp_utc LIKE '%T%Z'")
def time_range(spark: SparkSession, base: str) -> DataFrame:
    stamp = F.col("timestamp_utc")
    rows = T(spark, base, "index_documents").where(stamp.between("2022-01-01T00:00:00Z", "2023-12-31T23:59:59Z"))
    return rows.where((F.length(stamp) == 20) & stamp.like("%T%Z")).select("record_id", "doc_id")


@query()
def time_range_any_notation(spark: SparkSession, base: str) -> DataFrame:
    """The same range over values in any notation, read as instants."""
    rows = T(spark, base, "index_documents").select("record_id", "doc_id", "timestamp_utc", "source")
    read = timestamps.normalise(rows, "timestamp_utc", "source", T(spark, base, "source_systems"))
    return read.where(F.col("utc_micros").between(1640995200000000, 1704067199999999)).select("record_id", "doc_id", "utc_micros")


@query("""SELECT p.doc_id, count(DISTINCT c.doc_id) AS children FROM (SELECT DISTINCT doc_id FROM index_documents) p
 JOIN index_documents c ON c.parent_id = p.doc_id GROUP BY 1""")
def relationship_children(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents")
    links = rows.where("parent_id is not null").select(F.col("parent_id").alias("doc_id"), F.col("doc_id").alias("child")).distinct()
    return links.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("children"))


@query("""SELECT d.doc_id, coalesce(m.title, d.title) AS title, coalesce(m.source, d.source) AS source FROM
 (SELECT doc_id, arg_max(content_title, record_id) AS title, arg_max(source, record_id) AS source FROM
   (SELECT doc_id, record_id, coalesce(content_title, '') AS content_title, coalesce(source, '') AS source FROM index_documents) GROUP BY doc_id) d
 LEFT JOIN (SELECT doc_id, max(title) AS title, max(source) AS source FROM document_metadata GROUP BY doc_id) m ON m.doc_id = d.doc_id""")
def partial_update(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents").select(
        "doc_id", "record_id", F.coalesce("content_title", F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("source")
    )
    changes = T(spark, base, "document_metadata").groupBy("doc_id").agg(F.max("title").alias("title"), F.max("source").alias("source"))
    return documents.updated(documents.latest(rows, "doc_id", "record_id").drop("record_id"), changes, "doc_id")


@query("SELECT record_id, doc_id FROM index_documents i WHERE NOT EXISTS (SELECT 1 FROM lineage l WHERE l.doc_id = i.doc_id AND l.metadata['type'] = 'eml')")
def tombstoned(spark: SparkSession, base: str) -> DataFrame:
    gone = T(spark, base, "lineage").where(F.col("metadata")["type"] == "eml")
    return documents.deleted(T(spark, base, "index_documents").select("record_id", "doc_id"), gone, "doc_id")


@query("""SELECT doc_id, record_id, CASE WHEN nth = 1 THEN 'created' WHEN h IS NOT DISTINCT FROM prev THEN 'unchanged' ELSE 'updated' END AS change_type, prev AS previous, h AS new FROM (
 SELECT doc_id, record_id, h, lag(h) OVER w AS prev, row_number() OVER w AS nth FROM
 (SELECT doc_id, record_id, md5(content_body) AS h FROM index_documents WHERE doc_id IS NOT NULL) WINDOW w AS (PARTITION BY doc_id ORDER BY record_id))""")
def version_changes(spark: SparkSession, base: str) -> DataFrame:
    return documents.version_changes(T(spark, base, "index_documents"), "doc_id", "record_id", F.md5("content_body"))


@query("SELECT strftime(date_trunc('week', added_at), '%Y-%m-%d') AS week, count(*) AS documents FROM documents WHERE added_at IS NOT NULL GROUP BY 1")
def weekly_documents(spark: SparkSession, base: str) -> DataFrame:
    return documents.weekly(T(spark, base, "documents"), "added_at")


@query("""SELECT 'index' AS origin, doc_id AS id, content_title AS title, source FROM index_documents UNION ALL
 SELECT 'metadata', doc_id, title, source FROM document_metadata UNION ALL SELECT 'corpus', CAST(doc_id AS VARCHAR), title, source FROM documents""")
def union_sources(spark: SparkSession, base: str) -> DataFrame:
    parts = [
        documents.conform(T(spark, base, "index_documents"), {"id": "doc_id", "title": "content_title", "source": "source"}, {"origin": F.lit("index")}),
        documents.conform(T(spark, base, "document_metadata"), {"id": "doc_id", "title": "title", "source": "source"}, {"origin": F.lit("metadata")}),
        documents.conform(T(spark, base, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), {"id": "doc_id", "title": "title", "source": "source"}, {"origin": F.lit("corpus")}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("origin", "id", "title", "source")


@query("""SELECT tag, count(DISTINCT doc_id) AS documents, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM
 (SELECT doc_id, source, unnest(tags) AS tag FROM document_metadata) WHERE tag IS NOT NULL GROUP BY tag HAVING count(DISTINCT doc_id) >= 3""")
def tag_frequency(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "document_metadata").select("doc_id", "source", F.explode("tags").alias("tag")).where("tag is not null")
    out = rows.groupBy("tag").agg(F.count_distinct("doc_id").alias("documents"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return out.where("documents >= 3")


@query("""SELECT coalesce(file_type, 'all') AS file_type, count(*) AS overdue, CAST(max(days) AS BIGINT) AS longest FROM (
 SELECT coalesce(file_type, 'none') AS file_type, date_diff('day', CAST(added_at AS DATE), DATE '2026-01-01') AS days FROM documents WHERE added_at IS NOT NULL)
 WHERE days > CASE file_type WHEN 'md' THEN 7 WHEN 'docx' THEN 14 ELSE 30 END GROUP BY ROLLUP (file_type)""")
def overdue_rollup(spark: SparkSession, base: str) -> DataFrame:
    days = F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("added_at"))
    rows = T(spark, base, "documents").where("added_at is not null").select(F.coalesce("file_type", F.lit("none")).alias("file_type"), days.alias("days"))
    due = F.when(F.col("file_type") == "md", 7).when(F.col("file_type") == "docx", 14).otherwise(30)
    out = rows.where(F.col("days") > due).rollup("file_type").agg(F.count("*").alias("overdue"), F.max("days").cast("long").alias("longest"))
    return out.select(F.coalesce("file_type", F.lit("all")).alias("file_type"), "overdue", "longest")


@query(r"""SELECT url, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) ||
 regexp_replace(substring(bare, length(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/+$', '') AS normal, n FROM
 (SELECT url, regexp_replace(url, '[;?#].*$', '') AS bare, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'https?://[^\s]+')) AS url FROM documents) GROUP BY url)""")
def links_in_text(spark: SparkSession, base: str) -> DataFrame:
    found = T(spark, base, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"https?://[^\s]+"), 0)).alias("url"))
    return found.groupBy("url").agg(F.count("*").alias("n")).select("url", text.normalise_url(F.col("url")).alias("normal"), "n")


# ---- search ----------------------------------------------------------------

BM25_QUERY = ["agreement", "archive", "schedule"]
_TERMS = "[x for x in string_split(lower(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9À-ɏ]+', ' ', 'g')), ' ') if x <> '' AND x NOT IN ({1})]"
_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_BM25 = """body AS (SELECT {key} AS key, {terms} AS t FROM {table}),
 sizes AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM body),
 post AS (SELECT key, len(t) AS length, q.term, len([x for x in t if x = q.term]) AS tf FROM body, (SELECT unnest([{query}]) AS term) q),
 hit AS (SELECT * FROM post WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
 bm AS (SELECT key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))) AS bm25 FROM hit JOIN df USING (term), sizes GROUP BY key)"""


def _bm25_sql(table: str, key: str, body: str) -> str:
    return _BM25.format(key=key, terms=_TERMS.format(body, _STOP), table=table, query=", ".join(f"'{q}'" for q in sorted(BM25_QUERY)))


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text')} SELECT key AS doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 6) DESC, key LIMIT 50")
def bm25_search(spark: SparkSession, base: str) -> DataFrame:
    scored = search.bm25(T(spark, base, "documents"), "doc_id", "text", BM25_QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))
    return scored.orderBy(F.col("bm25").desc(), "doc_id").limit(50)


def _query_vector(spark: SparkSession, base: str) -> list[float]:
    return T(spark, base, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COSQ = _COS.format("e.embedding", "q.embedding")
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT e.vec_id, round({_COSQ}, 6) AS cosine, round((1 + {_COSQ}) / 2, 6) AS certainty FROM embeddings e, {_Q} q WHERE (1 + {_COSQ}) / 2 >= 0.5 ORDER BY {_COSQ} DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, base: str) -> DataFrame:
    top = search.vector_top(T(spark, base, "embeddings"), "vec_id", "embedding", _query_vector(spark, base), 10, 0.5)
    return top.select("vec_id", F.round("cosine", 6).alias("cosine"), F.round("certainty", 6).alias("certainty"))


_L2 = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))])"


@query(f"SELECT e.vec_id, round({_L2}, 6) AS distance FROM embeddings e, {_Q} q ORDER BY {_L2}, vec_id LIMIT 5")
def l2_topk(spark: SparkSession, base: str) -> DataFrame:
    top = search.l2_top(T(spark, base, "embeddings"), "vec_id", "embedding", _query_vector(spark, base), 5)
    return top.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT src, dst, round(s, 6) AS similarity FROM (SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS nth FROM
 (SELECT q.vec_id AS src, e.vec_id AS dst, {_COS.format('q.embedding', 'e.embedding')} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
 WHERE s >= 0.3) WHERE nth <= 3""")
def semantic_references(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "embeddings")
    near = search.nearest_to(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 3, 0.3)
    return near.select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query("""SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM
 (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2""")
def topic_centroids(spark: SparkSession, base: str) -> DataFrame:
    return search.centroids(T(spark, base, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


@query(f"""WITH c AS (SELECT label, list(v ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS v FROM
 (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY label),
 n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
 SELECT c.label, round({_COS.format('c.centre', 'q.embedding')}, 6) AS similarity, size FROM c JOIN n USING (label), {_Q} q ORDER BY similarity DESC, c.label LIMIT 5""")
def similar_topics(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "embeddings")
    centres = search.centroids(rows, "label", "embedding").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("c"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("size"))
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, base)])
    cos = F.round(vector.cosine(F.transform("c", lambda s: s["value"]), q), 6)
    return centres.join(sizes, "label").select("label", cos.alias("similarity"), "size").orderBy(F.col("similarity").desc(), "label").limit(5)


@query("""SELECT source, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (SELECT source, unnest([x / n for x in v]) AS x, generate_subscripts(v, 1) - 1 AS pos FROM
 (SELECT source, v, sqrt(list_sum([x * x for x in v])) AS n FROM (SELECT source, CAST(embedding AS DOUBLE[]) AS v FROM index_documents
 WHERE source IS NOT NULL AND len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)) WHERE n > 0) GROUP BY 1, 2""")
def mean_pooling(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents").where("source is not null").where(vector.check(F.col("embedding"), 64) == "ok")
    # the length is a column of its own: inside the rewrite of each element it would be computed for each
    sized = rows.select("source", "embedding", vector.norm(F.col("embedding")).alias("n")).where("n > 0")
    parts = sized.select("source", "n", F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("source", "pos").agg(F.round(F.avg(F.col("x").cast("double") / F.col("n")), 6).alias("value"))


@query(f"""WITH {_bm25_sql('index_documents', 'record_id', 'content_body')},
 q AS (SELECT embedding FROM index_documents WHERE record_id = (SELECT min(record_id) FROM index_documents WHERE len(embedding) = 64 AND list_sum([abs(x) for x in embedding]) BETWEEN 0.001 AND 1e9)),
 vt AS (SELECT record_id AS key, round(c, 9) AS cosine FROM (SELECT e.record_id, {_COSQ} AS c FROM index_documents e, q WHERE len(e.embedding) = 64
   AND len([x for x in e.embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in e.embedding if x <> 0]) > 0) ORDER BY round(c, 9) DESC, record_id LIMIT 100),
 tt AS (SELECT key, round(bm25, 9) AS bm25 FROM bm ORDER BY round(bm25, 9) DESC, key LIMIT 100),
 f AS (SELECT coalesce(vt.key, tt.key) AS key, (cosine - (SELECT min(cosine) FROM vt)) / ((SELECT max(cosine) - min(cosine) FROM vt)) AS a,
  (bm25 - (SELECT min(bm25) FROM tt)) / ((SELECT max(bm25) - min(bm25) FROM tt)) AS b FROM vt FULL JOIN tt ON vt.key = tt.key)
 SELECT key AS record_id, round(0.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0), 5) AS score FROM f ORDER BY 0.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0) DESC, key LIMIT 20""")
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents")
    usable = rows.where(vector.check(F.col("embedding"), 64) == "ok")
    q = usable.orderBy("record_id").select("embedding").first()[0]
    by_vector = search.vector_top(usable.withColumn("embedding", F.col("embedding").cast("array<double>")), "record_id", "embedding", q, 100)
    by_vector = by_vector.select("record_id", F.round("cosine", 9).alias("cosine"))
    by_text = search.bm25(rows, "record_id", "content_body", BM25_QUERY).select("record_id", F.round("bm25", 9).alias("bm25"))
    by_text = by_text.orderBy(F.col("bm25").desc(), "record_id").limit(100)
    return search.hybrid(by_text, by_vector, "record_id", 0.5, 20).select("record_id", F.round("score", 5).alias("score"))


@query(f"""WITH t AS (SELECT source, unnest({_TERMS.format('text', _STOP)}) AS term FROM documents WHERE source IS NOT NULL)
 SELECT source, term, n FROM (SELECT source, term, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) AS nth FROM t WHERE length(term) > 3 GROUP BY source, term) WHERE nth <= 5""")
def source_keywords(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window

    found = T(spark, base, "documents").where("source is not null").select("source", F.explode(search.terms(F.col("text"))).alias("term"))
    counts = found.where(F.length("term") > 3).groupBy("source", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "term")
    return counts.withColumn("nth", F.row_number().over(w)).where("nth <= 5").drop("nth")


# ---- references and lineage ------------------------------------------------

_KEY = r"""CASE WHEN length({d}) = 32 THEN regexp_replace({d}, '^([0-9a-f]{{8}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{12}})$', '\1-\2-\3-\4-\5')
 WHEN {t} IN ('', 'n/a', 'na', 'none', 'null', 'nan', 'nil', '-', '--', '?', 'unknown') THEN NULL ELSE {t} END"""


def _key_sql(col: str) -> str:
    t = f"lower(trim({col}, E' \\t\\r\\n'))"
    return _KEY.format(t=t, d=f"translate(replace({t}, 'urn:uuid:', ''), '-{{}}', '')")


_EDGES = f"""told AS (SELECT {_key_sql('p')} AS parent, {_key_sql('doc_id')} AS child, 'child' AS told FROM (SELECT doc_id, unnest(list_append(coalesce(parents, []), derived_from)) AS p FROM lineage)
 UNION ALL SELECT {_key_sql('doc_id')}, {_key_sql('c')}, 'parent' FROM (SELECT doc_id, unnest(coalesce(children, [])) AS c FROM lineage)),
 edges AS (SELECT parent, child, CASE WHEN min(told) <> max(told) THEN 'both' ELSE min(told) END AS told_by FROM told WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY 1, 2),
 known AS (SELECT DISTINCT {_key_sql('doc_id')} AS id FROM lineage WHERE doc_id IS NOT NULL)"""


@query(f"WITH {_EDGES} SELECT parent, child, told_by FROM edges")
def lineage_edges(spark: SparkSession, base: str) -> DataFrame:
    return references.lineage_edges(T(spark, base, "lineage"))


@query(f"""WITH {_EDGES} SELECT parent, child, 'parent_missing' AS problem FROM edges WHERE parent NOT IN (SELECT id FROM known) UNION ALL
 SELECT parent, child, 'child_missing' FROM edges WHERE child NOT IN (SELECT id FROM known) UNION ALL
 SELECT parent, child, 'self_link' FROM edges WHERE parent = child UNION ALL SELECT parent, child, 'one_sided' FROM edges WHERE told_by <> 'both'""")
def lineage_problems(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "lineage")
    return references.integrity(references.lineage_edges(rows), rows, "doc_id")


_TREE = f"""{_EDGES}, tree AS (SELECT child, min(parent) AS parent FROM edges WHERE parent IN (SELECT id FROM known) AND child IN (SELECT id FROM known) GROUP BY child),
 reach AS (SELECT child AS doc, parent AS anc FROM tree UNION SELECT r.doc, t.parent FROM reach r JOIN tree t ON r.anc = t.child)"""

# the hierarchy problem's results, by plain recursion over all pairs
SQL["p1_found"] = f"""WITH RECURSIVE {_TREE}, ring AS (SELECT doc AS id FROM reach WHERE doc = anc),
 agg AS (SELECT doc, count(*) AS depth, min(CASE WHEN anc NOT IN (SELECT child FROM tree) THEN anc END) AS root, min(CASE WHEN anc IN (SELECT id FROM ring) THEN anc END) AS ringed FROM reach GROUP BY doc)
 SELECT doc AS doc_id, coalesce(ringed, root) AS root_id, CAST(CASE WHEN ringed IS NULL THEN depth ELSE -1 END AS INTEGER) AS depth FROM agg"""
SQL["p1_circles"] = f"""WITH RECURSIVE {_TREE}, ring AS (SELECT doc AS id, min(anc) AS circle_id FROM reach WHERE doc IN (SELECT doc FROM reach WHERE doc = anc)
   AND anc IN (SELECT doc FROM reach WHERE doc = anc) GROUP BY doc),
 step AS (SELECT circle_id, id AS doc_id, 0 AS step FROM ring WHERE id = circle_id UNION ALL
  SELECT s.circle_id, t.child, s.step + 1 FROM step s JOIN tree t ON t.parent = s.doc_id JOIN ring r ON r.id = t.child WHERE t.child <> s.circle_id)
 SELECT circle_id, doc_id, CAST(step AS INTEGER) AS step FROM step"""

SQL["p1_conflicts"] = f"""WITH {_EDGES}, tree AS (SELECT child, min(parent) AS parent FROM edges WHERE parent IN (SELECT id FROM known) AND child IN (SELECT id FROM known) GROUP BY child)
 SELECT e.child AS doc_id, t.parent AS kept_parent, e.parent AS other_parent FROM edges e JOIN tree t ON t.child = e.child WHERE e.parent > t.parent AND e.parent IN (SELECT id FROM known)"""

_CUT = f"""{_TREE}, ring AS (SELECT doc AS id, min(anc) AS circle_id FROM reach WHERE doc IN (SELECT doc FROM reach WHERE doc = anc)
   AND anc IN (SELECT doc FROM reach WHERE doc = anc) GROUP BY doc),
 cut AS (SELECT child, parent FROM tree WHERE child NOT IN (SELECT circle_id FROM ring)),
 below AS (SELECT parent AS anc, child AS d, 1 AS distance FROM cut UNION ALL SELECT c.parent, b.d, b.distance + 1 FROM below b JOIN cut c ON c.child = b.anc)"""
SQL["p1_descendants"] = f"WITH RECURSIVE {_CUT} SELECT anc AS ancestor_id, d AS descendant_id, CAST(distance AS INTEGER) AS distance FROM below"
SQL["p1_paths"] = f"""WITH RECURSIVE {_CUT}, up AS (SELECT d, string_agg(anc, '/' ORDER BY distance DESC) AS way, max(distance) AS depth FROM below GROUP BY d),
 down AS (SELECT anc, count(*) AS n FROM below GROUP BY anc),
 p AS (SELECT k.id AS doc_id, CASE WHEN way IS NULL THEN k.id ELSE way || '/' || k.id END AS path, coalesce(depth, 0) AS depth, coalesce(n, 0) AS n FROM known k LEFT JOIN up ON up.d = k.id LEFT JOIN down ON down.anc = k.id)
 SELECT doc_id, split_part(path, '/', 1) AS root_id, CAST(CASE WHEN split_part(path, '/', 1) IN (SELECT circle_id FROM ring) THEN -1 ELSE depth END AS INTEGER) AS depth, path, n AS n_descendants FROM p"""


@query("""WITH p AS (SELECT DISTINCT doc_id, seq FROM processing_steps), n AS (SELECT doc_id, seq, lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM p)
 SELECT doc_id, seq AS src, nxt AS dst, 'next' AS ref_type FROM n WHERE nxt IS NOT NULL UNION ALL SELECT doc_id, nxt, seq, 'previous' FROM n WHERE nxt IS NOT NULL""")
def sequential_references(spark: SparkSession, base: str) -> DataFrame:
    return references.sequential(T(spark, base, "processing_steps"), "doc_id", "seq")


@query("SELECT e.label, e.vec_id AS src, h.dst, h.size FROM embeddings e JOIN (SELECT label, min(vec_id) AS dst, count(*) AS size FROM embeddings GROUP BY label) h ON h.label = e.label WHERE e.vec_id <> h.dst")
def topic_references(spark: SparkSession, base: str) -> DataFrame:
    return references.topic_links(T(spark, base, "embeddings"), "vec_id", "label")


_TYPED = """typed AS (SELECT DISTINCT doc_id AS src, parent_id AS dst, 'parent' AS ref_type FROM index_documents WHERE parent_id IS NOT NULL AND doc_id IS NOT NULL UNION
 SELECT DISTINCT doc_id, chunk, 'child' FROM (SELECT doc_id, unnest(chunk_ids) AS chunk FROM index_documents) WHERE chunk IS NOT NULL AND doc_id IS NOT NULL)"""


def _typed(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "index_documents").where("doc_id is not null")
    up = rows.where("parent_id is not null").select(F.col("doc_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("parent").alias("ref_type"))
    down = rows.select(F.col("doc_id").alias("src"), F.explode("chunk_ids").alias("dst"), F.lit("child").alias("ref_type")).where("dst is not null")
    return up.union(down).distinct()


@query(f"WITH {_TYPED} SELECT src, dst, ref_type FROM typed UNION SELECT dst, src, CASE ref_type WHEN 'parent' THEN 'child' ELSE 'parent' END FROM typed")
def edges_with_reverse(spark: SparkSession, base: str) -> DataFrame:
    return references.with_reverse(_typed(spark, base))


@query(f"WITH {_TYPED} SELECT src, dst, ref_type FROM typed a WHERE NOT EXISTS (SELECT 1 FROM typed b WHERE b.src = a.dst AND b.dst = a.src AND b.ref_type = CASE a.ref_type WHEN 'parent' THEN 'child' ELSE 'parent' END)")
def missing_back_edges(spark: SparkSession, base: str) -> DataFrame:
    return references.missing_reverse(_typed(spark, base))


@query(f"WITH {_TYPED} SELECT src, dst, ref_type, 'structural' AS category, 0.75::DOUBLE AS confidence FROM typed")
def classified_edges(spark: SparkSession, base: str) -> DataFrame:
    return references.classified(_typed(spark, base)).select("src", "dst", "ref_type", "category", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_TYPED}, e AS (SELECT DISTINCT src, dst FROM typed) SELECT id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM
 (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id""")
def edge_degrees(spark: SparkSession, base: str) -> DataFrame:
    return references.degrees(_typed(spark, base))


@query("""SELECT doc_id, max(last_modified) AS last_modified, count(*) AS snapshots, count(DISTINCT origin_source) AS sources FROM lineage WHERE last_modified BETWEEN '2021-01-01T00:00:00Z' AND '2024-12-31T23:59:59Z' GROUP BY doc_id""")
def lineage_snapshots(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "lineage").where(F.col("last_modified").between("2021-01-01T00:00:00Z", "2024-12-31T23:59:59Z"))
    return rows.groupBy("doc_id").agg(F.max("last_modified").alias("last_modified"), F.count("*").alias("snapshots"), F.count_distinct("origin_source").alias("sources"))


@query("SELECT coalesce(origin_source, 'none') AS origin_source, coalesce(metadata['type'], 'none') AS type, count(DISTINCT doc_id) AS documents FROM lineage GROUP BY 1, 2")
def lineage_by_source(spark: SparkSession, base: str) -> DataFrame:
    kind = F.coalesce(F.try_element_at("metadata", F.lit("type")), F.lit("none"))
    return T(spark, base, "lineage").groupBy(F.coalesce("origin_source", F.lit("none")).alias("origin_source"), kind.alias("type")).agg(F.count_distinct("doc_id").alias("documents"))


# ---- steps, health, time series ---------------------------------------------


@query(f"WITH {LATEST} SELECT doc_id, m.status AS status, m.step_name AS step_name, m.us AS ts_micros, first_micros, last_micros, steps FROM latest")
def step_latest(spark: SparkSession, base: str) -> DataFrame:
    return steps.latest(T(spark, base, "processing_steps"))


@query(f"WITH {LATEST} SELECT m.status AS status, count(*) AS documents FROM latest GROUP BY 1")
def status_counts(spark: SparkSession, base: str) -> DataFrame:
    return steps.status_counts(T(spark, base, "processing_steps"))


_METRICS = (
    LATEST
    + """, per AS (SELECT f.source, f.doc_id, max(l.m.status) AS last_status, count(*) AS steps, count(*) FILTER (f.status IN ('failed', 'error')) AS errors,
 count(*) FILTER (f.status = 'warning') AS warnings, sum(duration_ms) AS ms, count(duration_ms) AS timed, max(duration_ms) AS slowest, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi
 FROM facts f JOIN latest l USING (doc_id) GROUP BY 1, 2),
 m AS (SELECT source, count(*) AS documents, count(*) FILTER (last_status IN ('success', 'completed')) AS completed, count(*) FILTER (last_status IN ('failed', 'error')) AS failed,
 count(*) FILTER (last_status IN ('in_progress', 'running')) AS active, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings,
 sum(ms) AS ms, sum(timed) AS timed, max(slowest) AS slowest_ms, min(lo) AS first_micros, max(hi) AS last_micros FROM per GROUP BY source)"""
)


@query(f"""WITH {_METRICS} SELECT source, documents, completed, failed, active, steps, errors, warnings, round(ms / timed, 6) AS avg_ms, slowest_ms,
 round(100.0 * failed / greatest(completed + failed, 1), 2)::DOUBLE AS error_rate, round(100.0 * completed / greatest(completed + failed, 1), 2)::DOUBLE AS success_rate, first_micros, last_micros FROM m""")
def pipeline_metrics(spark: SparkSession, base: str) -> DataFrame:
    return steps.pipeline_metrics(T(spark, base, "processing_steps"), "source")


@query(f"WITH {LATEST} SELECT doc_id, steps, round((last_micros - first_micros) / 1e6, 3) AS seconds FROM latest WHERE steps > 1")
def step_spans(spark: SparkSession, base: str) -> DataFrame:
    return steps.spans(T(spark, base, "processing_steps"))


@query(f"""WITH {_METRICS}, h AS (SELECT source, documents, failed, failed::DOUBLE / documents AS share, errors FROM m)
 SELECT source, documents, failed, round(share, 6) AS failed_share, CASE WHEN share >= 0.1 THEN 'critical' WHEN share >= 0.05 OR errors > 0 THEN 'warning' ELSE 'healthy' END AS status,
 CASE WHEN share >= 0.1 THEN 2 WHEN share >= 0.05 OR errors > 0 THEN 1 ELSE 0 END AS severity FROM h""")
def health_status(spark: SparkSession, base: str) -> DataFrame:
    return steps.health(T(spark, base, "processing_steps"), "source")


@query("""SELECT step_name, count(*) AS n, round(min(duration_ms), 4) AS lo, round(max(duration_ms), 4) AS hi, round(avg(duration_ms), 4) AS mean, round(stddev_pop(duration_ms), 4) AS deviation,
 round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99
 FROM processing_steps WHERE duration_ms IS NOT NULL GROUP BY step_name""")
def performance_summary(spark: SparkSession, base: str) -> DataFrame:
    return steps.performance(T(spark, base, "processing_steps"), "step_name", "duration_ms", Scratch(spark, "performance"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(value) AS slowest, min(value) AS fastest FROM events GROUP BY event_type")
def operation_times(spark: SparkSession, base: str) -> DataFrame:
    return steps.operation_times(T(spark, base, "events"), "event_type", "value")


@query(f"WITH {FACTS} SELECT step_name, status, count(*) AS n FROM facts WHERE status IN ('failed', 'error') GROUP BY 1, 2 ORDER BY n DESC, step_name, status LIMIT 5")
def frequent_errors(spark: SparkSession, base: str) -> DataFrame:
    return steps.frequent_errors(T(spark, base, "processing_steps"), 5)


@query(f"WITH {FACTS} SELECT doc_id, seq, step_name, status, epoch_us(ts) AS ts_micros FROM facts WHERE status IN ('failed', 'error') AND epoch_us(ts) >= 1672531200000000")
def recent_errors(spark: SparkSession, base: str) -> DataFrame:
    return steps.recent_errors(T(spark, base, "processing_steps"), 1672531200000000)


@query(f"""WITH {FACTS}, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, epoch_us(ts), step_name, status) AS attempt FROM facts WHERE status IN ('failed', 'error'))
 SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, 1.0::DOUBLE AS linear, least(60.0, power(2.0, attempt))::DOUBLE AS exponential,
 least(60.0, round(power((1 + sqrt(5)) / 2, attempt + 1) / sqrt(5)))::DOUBLE AS fibonacci FROM b""")
def retry_delays(spark: SparkSession, base: str) -> DataFrame:
    return steps.retry_delays(T(spark, base, "processing_steps"))


@query(f"""WITH {FACTS}, b AS (SELECT step_name, floor(((SELECT max(epoch_us(ts)) FROM facts) - epoch_us(ts)) / (7776000.0 * 1000000)) AS period FROM facts WHERE status IN ('failed', 'error')),
 g AS (SELECT step_name, p FROM (SELECT DISTINCT step_name FROM b), (SELECT unnest(generate_series(0, 5)) AS p))
 SELECT g.step_name, CAST(g.p AS INTEGER) AS period, count(b.step_name) AS n FROM g LEFT JOIN b ON b.step_name = g.step_name AND b.period = g.p GROUP BY 1, 2""")
def error_trends(spark: SparkSession, base: str) -> DataFrame:
    return steps.error_trend(T(spark, base, "processing_steps"), 6, 90 * 86400)


_FILLED = " + ".join(f"CASE WHEN coalesce(trim({c}), '') <> '' THEN 1.0 ELSE 0.0 END" for c in ("title", "author", "path", "language"))


@query(f"""WITH {_METRICS}, c AS (SELECT source, avg(({_FILLED}) / 4) AS completeness FROM document_metadata WHERE source IS NOT NULL GROUP BY source),
 r AS (SELECT source, round(100.0 * completed / greatest(completed + failed, 1), 2)::DOUBLE / 100 AS quality, 1 - errors::DOUBLE / steps AS authority,
 least(1.0, steps / greatest((last_micros - first_micros) / 1e6 / greatest(steps - 1, 1), 1.0)) AS frequency FROM m WHERE source IS NOT NULL)
 SELECT source, round(completeness, 6) AS completeness, round(quality, 6) AS quality, round(authority, 6) AS authority, round(frequency, 6) AS frequency,
 round(0.3 * authority + 0.3 * quality + 0.2 * completeness + 0.2 * frequency, 5) AS score FROM c JOIN r USING (source)""")
def reliability_scores(spark: SparkSession, base: str) -> DataFrame:
    return steps.reliability(T(spark, base, "document_metadata"), T(spark, base, "processing_steps"), "source", ["title", "author", "path", "language"])


@query(f"""WITH {FACTS}, tag AS (SELECT DISTINCT source, epoch_us(date_trunc('month', ts)) AS us FROM facts WHERE source IS NOT NULL),
 ch AS (SELECT source, epoch_us(ts) AS us, max(doc_id || '/' || lpad(CAST(seq AS VARCHAR), 6, '0')) AS change FROM facts WHERE source IS NOT NULL AND doc_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2)
 SELECT t.source, t.us, arg_max(c.change, c.us) AS change FROM tag t LEFT JOIN ch c ON c.source = t.source AND c.us <= t.us GROUP BY 1, 2""")
def change_at_tag(spark: SparkSession, base: str) -> DataFrame:
    rows = steps.facts(T(spark, base, "processing_steps")).where("source is not null")
    tags = rows.select("source", F.unix_micros(F.date_trunc("month", "ts")).alias("us")).distinct()
    name = F.concat("doc_id", F.lit("/"), F.lpad(F.col("seq").cast("string"), 6, "0"))
    changes = rows.where("doc_id is not null and seq is not null").groupBy("source", F.unix_micros("ts").alias("us")).agg(F.max(name).alias("change"))
    return steps.as_of(tags, changes, "source", "us")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS valid FROM events""")
def json_props(spark: SparkSession, base: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return T(spark, base, "events").select("event_id", parsed["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(count(*) / 3600.0, 6)::DOUBLE AS per_second FROM events GROUP BY 1, 2""")
def counter_rate(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"))
    return rows.select("event_type", "hour", "n", F.round(F.col("n") / 3600, 6).alias("per_second"))


@query("""WITH b AS (SELECT event_type, le, count(*) AS n FROM (SELECT event_type, CASE WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 WHEN value <= 250 THEN 250 ELSE 1000 END AS le FROM events WHERE value IS NOT NULL) GROUP BY 1, 2),
 c AS (SELECT event_type, le, n, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS upto, sum(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low FROM b)
 SELECT event_type, round(low + (le - low) * (0.95 * total - (upto - n)) / n, 6)::DOUBLE AS p95 FROM c WHERE upto >= 0.95 * total AND upto - n < 0.95 * total""")
def histogram_p95(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window

    v = F.col("value")
    le = F.lit(1000)
    for edge in (250, 100, 50, 25, 10, 5):
        le = F.when(v <= edge, edge).otherwise(le)
    b = T(spark, base, "events").where("value is not null").groupBy("event_type", le.alias("le")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("le")
    c = b.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("event_type"))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0)))
    inside = (F.col("upto") >= 0.95 * F.col("total")) & (F.col("upto") - F.col("n") < 0.95 * F.col("total"))
    p = F.col("low") + (F.col("le") - F.col("low")) * (0.95 * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return c.where(inside).select("event_type", F.round(p, 6).alias("p95"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6)::DOUBLE AS error_percent FROM events GROUP BY 1")
def error_ratio(spark: SparkSession, base: str) -> DataFrame:
    share = 100 * F.count_if(F.col("event_type") == "error") / F.count("*")
    return T(spark, base, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(share, 6).alias("error_percent"))


@query()
def alert_cooldown(spark: SparkSession, base: str) -> DataFrame:
    """Failures as alerts per source and status, without those in the cooldown of a sent one."""
    rows = steps.facts(T(spark, base, "processing_steps")).where(F.col("status").isin(*steps.BAD) & F.col("ts").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(
        F.concat_ws("/", F.coalesce("source", F.lit("none")), "status").alias("key"), F.floor(F.unix_micros("ts") / 1000000).alias("seconds"), "doc_id", "seq"
    )
    return steps.cooled(rows, "key", "seconds", "doc_id", 86400)


@query()
def extractive_summary(spark: SparkSession, base: str) -> DataFrame:
    """Leading sentences of each body up to 30 words, bodies below 30 words as they are."""
    body = F.col("content_body")
    short = text.word_count(body) < 30
    out = F.when(short, text.clean(body)).otherwise(text.leading_summary(body, 30))
    return T(spark, base, "index_documents").where("content_body is not null").select("record_id", out.alias("summary"), text.word_count(body).alias("words"))


@query()
def topic_kmeans(spark: SparkSession, base: str) -> DataFrame:
    """k-means with fixed k and seed: ``(vec_id, cluster, size)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = T(spark, base, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=42, maxIter=20).fit(rows)
    out = model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))
    return out.join(out.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("vec_id", "cluster", "size")


@query("""SELECT file_path, lower(substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST(strpos('0123456789abcdef', substring(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12)) AS id FROM
 (SELECT path AS file_path, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path)) AS h FROM (SELECT DISTINCT path FROM document_metadata WHERE path IS NOT NULL))""")
def path_ids(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "document_metadata").where("path is not null").select(F.col("path").alias("file_path")).distinct()
    return rows.select("file_path", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("file_path")).alias("id"))


@query()
def pii_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Cleaned bodies with pattern matches replaced by their type."""
    return redaction.redact(T(spark, base, "index_documents"), "record_id", "content_body")


@query()
def block_chunks(spark: SparkSession, base: str) -> DataFrame:
    return chunking.chunks(T(spark, base, "documents"), "doc_id", "text", "block")


@query()
def paragraph_chunks(spark: SparkSession, base: str) -> DataFrame:
    return chunking.chunks(T(spark, base, "documents"), "doc_id", "text", "paragraph")


@query()
def document_pipeline(spark: SparkSession, base: str) -> DataFrame:
    """All pipeline steps over the index documents."""
    rows = T(spark, base, "index_documents").select(F.col("record_id").alias("id"), F.col("content_body").alias("body"))
    return pipeline.run(rows).select("id", "pii_matches", "summary", "cluster")


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'syntax' WHEN value IS NULL THEN 'missing:value' ELSE 'ok' END AS status FROM events""")
def log_validation(spark: SparkSession, base: str) -> DataFrame:
    """Events as JSON log lines, every fiftieth cut short, through the line checks."""
    rows = T(spark, base, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.when(F.col("event_id") % 50 == 0, F.left(line, F.length(line) - 3)).otherwise(line)
    status = log_status(cut, {"event_id": "number", "event_type": "string", "value": "number"})
    return rows.select("event_id", status.alias("status"))


@query("""SELECT doc_id, array_to_string(list_sort([f for f in ['author', 'language', 'path', 'title'] if NOT list_contains(have, f)]), ',') AS missing, len(have) / 4.0::DOUBLE AS completeness FROM
 (SELECT doc_id, [f for f in [CASE WHEN max(author) IS NOT NULL THEN 'author' END, CASE WHEN max(language) IS NOT NULL THEN 'language' END, CASE WHEN max(path) IS NOT NULL THEN 'path' END, CASE WHEN max(title) IS NOT NULL THEN 'title' END] if f IS NOT NULL] AS have
 FROM document_metadata WHERE doc_id IS NOT NULL GROUP BY doc_id)""")
def required_fields(spark: SparkSession, base: str) -> DataFrame:
    """Required fields that no record of a document fills, and the filled share."""
    names = ("author", "language", "path", "title")
    merged = T(spark, base, "document_metadata").where("doc_id is not null").groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    have = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    wanted = F.array(*[F.lit(n) for n in names])
    return merged.select(
        "doc_id", F.array_join(F.array_sort(F.array_except(wanted, have)), ",").alias("missing"), (F.size(F.array_intersect(wanted, have)) / len(names)).alias("completeness")
    )


@query(f"""WITH {_METRICS} SELECT source, CASE WHEN failed::DOUBLE / documents >= 0.1 THEN 'critical' ELSE 'warning' END AS severity,
 CASE WHEN failed::DOUBLE / documents >= 0.1 THEN 'email,webhook' ELSE 'webhook' END AS channels FROM m WHERE failed::DOUBLE / documents >= 0.05""")
def threshold_alerts(spark: SparkSession, base: str) -> DataFrame:
    metrics = steps.pipeline_metrics(T(spark, base, "processing_steps"), "source")
    out = streams.threshold_alerts(metrics, F.col("failed") / F.col("documents"), steps.WARNING_SHARE, steps.CRITICAL_SHARE)
    return out.select("source", "severity", F.array_join("channels", ",").alias("channels"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, nth""")
def user_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Runs of a user's events with gaps of at most half an hour (an extension)."""
    rows = T(spark, base, "events").where("ts is not null and user_id is not null")
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return out.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("""SELECT step_name, 100.0 * count(*) FILTER (status IN ('success', 'completed')) / count(*)::DOUBLE AS success_percent, count(*) AS attempts, count(DISTINCT doc_id) AS documents FROM
 (SELECT DISTINCT doc_id, seq, step_name, status, ts, source, duration_ms FROM processing_steps) GROUP BY step_name""")
def retry_summary(spark: SparkSession, base: str) -> DataFrame:
    rows = steps.facts(T(spark, base, "processing_steps"))
    share = 100 * F.count_if(F.col("status").isin(*steps.DONE)) / F.count("*")
    return rows.groupBy("step_name").agg(share.alias("success_percent"), F.count("*").alias("attempts"), F.count_distinct("doc_id").alias("documents"))
