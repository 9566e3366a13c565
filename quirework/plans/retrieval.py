"""Queries of citations, retrieval, guarded appends, histories and component scores, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text, vector
from quirework.operators import appends, citations as cited, documents, hierarchy, references, search, steps
from quirework.plans import general, reference
from quirework.plans.reference import BM25_QUERY, FACTS, T
from quirework.session import Scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# ---- citations -------------------------------------------------------------

_TEXTS = """texts AS (SELECT 'i' || record_id AS doc, content_body AS body FROM index_documents WHERE length(content_body) > 0
 UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE length(text) > 0)"""


def _family(name: str, pattern: str) -> str:
    body = "body"
    pattern = pattern.replace('\\"', '"').replace(r"\u201C", "\u201c").replace(r"\u201D", "\u201d")
    if name == "footnote":  # this engine has no look-behind: brackets behind a digit are masked
        pattern, body = r"\[(\d+)\]|\{\^(\d+)\}", r"regexp_replace(body, '([0-9])\[', '\1' || chr(1), 'g')"
    first, second = ("1", "2") if "|" in pattern.replace("(?:section|chapter)", "").replace("see|refer to|as shown in|as described in", "") else ("1", "1")
    if name == "url":
        first = second = "0"
    groups = ", ".join(f"unnest(regexp_extract_all(shown, '{pattern}', {g})) AS g{i}" for i, g in enumerate(("0", first, second)))
    return f"""SELECT doc, '{name}' AS citation_type, shown, generate_subscripts(regexp_extract_all(shown, '{pattern}', 0), 1) AS nth, {groups}
 FROM (SELECT doc, {body} AS shown FROM texts)"""


_MATCHES = f"""{_TEXTS}, m AS (SELECT doc, citation_type, shown, CAST(nth AS INTEGER) AS nth, g0, coalesce(nullif(g1, ''), g2) AS cited FROM (
 {" UNION ALL ".join(_family(n, p) for n, p in text.CITATION_FAMILIES.items())}))"""


def _texts(spark: SparkSession, base: str) -> DataFrame:
    index = T(spark, base, "index_documents").select(F.concat(F.lit("i"), "record_id").alias("doc"), F.col("content_body").alias("body"))
    return index.unionByName(T(spark, base, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.col("text").alias("body")))


@query(f"""WITH RECURSIVE {_MATCHES}, p AS (SELECT doc, citation_type, nth, g0, cited, instr(shown, g0) - 1 AS s FROM m WHERE nth = 1 UNION ALL
 SELECT m.doc, m.citation_type, m.nth, m.g0, m.cited, p.s + length(p.g0) + instr(substr(m.shown, p.s + length(p.g0) + 1), m.g0) - 1
 FROM p JOIN m ON m.doc = p.doc AND m.citation_type = p.citation_type AND m.nth = p.nth + 1)
 SELECT doc, citation_type, nth, md5(cited) AS cited_hash, CAST(s AS INTEGER) AS start_pos, CAST(s + length(g0) AS INTEGER) AS end_pos FROM p""")
def citations(spark: SparkSession, base: str) -> DataFrame:
    """Every citation of the index and the corpus with its place."""
    return cited.detected(_texts(spark, base), "doc", "body").select("doc", "citation_type", "nth", F.md5("cited").alias("cited_hash"), "start_pos", "end_pos")


@query(f"""WITH {_MATCHES}, c AS (SELECT DISTINCT doc, citation_type, cited, CASE citation_type WHEN 'inline_reference' THEN lower(trim(cited, E' \\t\\r\\n')) ELSE cited END AS needle
 FROM m WHERE citation_type IN ('direct_quote', 'inline_reference', 'url'))
 SELECT c.doc AS src, min(t.doc) AS dst, citation_type, md5(cited) AS cited_hash FROM c JOIN texts t ON t.doc <> c.doc
 AND contains(CASE citation_type WHEN 'inline_reference' THEN lower(t.body) ELSE t.body END, needle) WHERE needle <> '' GROUP BY c.doc, citation_type, cited""")
def citation_edges(spark: SparkSession, base: str) -> DataFrame:
    """Quotations, section names and addresses with the first other text that holds them."""
    scratch = Scratch(spark, "citations")
    bodies = _texts(spark, base)
    out = cited.edges(cited.detected(bodies, "doc", "body"), bodies, "doc", "body", scratch)
    return out.select("src", "dst", "citation_type", F.md5("cited").alias("cited_hash"))


# ---- retrieval -------------------------------------------------------------

_OK = "len({0}) = 64 AND len([x for x in {0} if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in {0} if x <> 0]) > 0"
_NEWEST = "n AS (SELECT * FROM index_documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY record_id DESC) = 1)"
_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _usable(col: str) -> Column:
    return vector.check(F.col(col), 64) == "ok"


@query(f"""WITH {_NEWEST}, u AS (SELECT *, {_OK.format('embedding')} AS ok FROM n), r AS (SELECT p.doc_id AS parent_id, p.content_title AS parent_title, c.doc_id, c.content_title AS title,
 CASE WHEN p.ok AND c.ok THEN round({_COS.format('p.embedding', 'c.embedding')}, 6) END AS similarity FROM u p JOIN u c ON c.parent_id = p.doc_id)
 SELECT *, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY similarity DESC NULLS LAST, doc_id) AS INTEGER) AS nth FROM r
 QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY similarity DESC NULLS LAST, doc_id) <= 10""")
def retrieved_children(spark: SparkSession, base: str) -> DataFrame:
    """The ten children most similar to each parent, newest records on both sides."""
    rows = documents.latest(T(spark, base, "index_documents").select("doc_id", "record_id", "content_title", "parent_id", "embedding"), "doc_id", "record_id")
    parents = rows.select(F.col("doc_id").alias("parent_id"), F.col("content_title").alias("parent_title"), F.col("embedding").alias("of"))
    children = rows.where("parent_id is not null").select("doc_id", F.col("content_title").alias("title"), "parent_id", "embedding")
    near = F.when(_usable("of") & _usable("embedding"), F.round(vector.cosine(F.col("of"), F.col("embedding")), 6))
    met = children.join(parents, "parent_id").select("parent_id", "parent_title", "doc_id", "title", near.alias("similarity"))
    return appends.bounded(met, "parent_id", [F.col("similarity").desc_nulls_last(), F.col("doc_id")], 10)


@query("""SELECT record_id, doc_id, content_title AS title, md5(content_body) AS body_hash, parent_id, len(coalesce(chunk_ids, [])) AS chunks,
 len(coalesce(chunk_ids, [])) / 10.0::DOUBLE AS score FROM index_documents""")
def shaped_results(spark: SparkSession, base: str) -> DataFrame:
    """Flat rows as nested results, read back through the nested columns."""
    out = appends.shaped(T(spark, base, "index_documents"), F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))) / 10)
    chunks = F.size("metadata.chunk_ids").cast("long")
    return out.select("record_id", "doc_id", "content.title", F.md5("content.body").alias("body_hash"), "metadata.parent_id", chunks.alias("chunks"), "score")


@query(f"""WITH {_NEWEST}, w AS (SELECT DISTINCT doc_id FROM document_metadata WHERE timestamp_utc BETWEEN '2022-01-01T00:00:00Z' AND '2023-12-31T23:59:59Z'),
 q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
 SELECT n.doc_id, round({_COS.format('n.embedding', 'q.embedding')}, 6) AS cosine FROM n SEMI JOIN w ON w.doc_id = n.doc_id, q WHERE {_OK.format('n.embedding')}
 ORDER BY round({_COS.format('n.embedding', 'q.embedding')}, 6) DESC, n.doc_id LIMIT 10""")
def time_range_vectors(spark: SparkSession, base: str) -> DataFrame:
    """The ten documents of a time range most similar to a vector."""
    rows = documents.latest(T(spark, base, "index_documents").select("doc_id", "record_id", "embedding"), "doc_id", "record_id")
    when = T(spark, base, "document_metadata").where(F.col("timestamp_utc").between("2022-01-01T00:00:00Z", "2023-12-31T23:59:59Z"))
    q = F.array(*[F.lit(float(x)) for x in reference._query_vector(spark, base)])
    found = rows.join(when.select("doc_id"), "doc_id", "left_semi").where(_usable("embedding"))
    return found.select("doc_id", F.round(vector.cosine(F.col("embedding"), q), 6).alias("cosine")).orderBy(F.col("cosine").desc(), "doc_id").limit(10)


@query(f"""WITH {reference._bm25_sql('documents', 'doc_id', 'text')} SELECT key AS doc_id, round(bm25, 6) AS bm25, (SELECT count(*) FROM bm) AS total FROM bm
 ORDER BY round(bm25, 6) DESC, key LIMIT 10 OFFSET 10""")
def keyword_page(spark: SparkSession, base: str) -> DataFrame:
    """The second page of a keyword search with the number of all matches."""
    hits = search.bm25(T(spark, base, "documents"), "doc_id", "text", BM25_QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))
    hits = Scratch(spark, "keywords").save(hits)
    return documents.page(hits, F.lit(True), [F.col("bm25").desc(), F.col("doc_id")], 10, 10)


@query("SELECT record_id, doc_id, content_title FROM index_documents WHERE source = 'hub-general'")
def tenant_rows(spark: SparkSession, base: str) -> DataFrame:
    """One tenant's rows; the source stands for the tenant."""
    return T(spark, base, "index_documents").where(F.col("source") == "hub-general").select("record_id", "doc_id", "content_title")


@query(f"""WITH v AS (SELECT i.record_id, {_COS.format('i.embedding', 'q.embedding')} AS c, CASE WHEN i.source = 'hub-general' THEN 1.0 ELSE 0.0 END AS topic,
 date_diff('day', CAST(substr(m.t, 1, 10) AS DATE), DATE '2026-01-01') AS age FROM index_documents i JOIN (SELECT doc_id, max(timestamp_utc) AS t FROM document_metadata GROUP BY doc_id) m
 ON m.doc_id = i.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_OK.format('i.embedding')} AND m.t IS NOT NULL)
 SELECT record_id, round(0.3 * topic + 0.7 * c + exp(-age / 365.0::DOUBLE), 6) AS score FROM v ORDER BY score DESC, record_id LIMIT 20""")
def ranked_signals(spark: SparkSession, base: str) -> DataFrame:
    """Topic, similarity and recency in one score."""
    q = F.array(*[F.lit(float(x)) for x in reference._query_vector(spark, base)])
    newest = T(spark, base, "document_metadata").where("timestamp_utc is not null").groupBy("doc_id").agg(F.max("timestamp_utc").alias("t"))
    rows = T(spark, base, "index_documents").where(_usable("embedding")).join(newest, "doc_id")
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.substring("t", 1, 10).cast("date"))
    topic = F.when(F.col("source") == "hub-general", 1.0).otherwise(0.0)
    score = F.round(0.3 * topic + 0.7 * vector.cosine(F.col("embedding"), q) + F.exp(-age / 365.0), 6)
    return rows.select("record_id", score.alias("score")).orderBy(F.col("score").desc(), "record_id").limit(20)


_LABELS = f"""t AS (SELECT source, doc_id, unnest({reference._TERMS.format('text', reference._STOP)}) AS term FROM documents WHERE source IS NOT NULL),
 p AS (SELECT source, term, count(*) AS n, count(DISTINCT doc_id) AS d FROM t WHERE length(term) > 3 GROUP BY 1, 2),
 df AS (SELECT term, sum(d) AS df FROM p GROUP BY 1), tot AS (SELECT source, sum(n) AS total FROM p GROUP BY 1), c AS (SELECT count(*) AS docs FROM documents WHERE source IS NOT NULL)"""


@query(f"""WITH {_LABELS} SELECT source, term, score FROM (SELECT p.source, p.term, round(n / total::DOUBLE * (ln((1 + docs) / (1 + df)::DOUBLE) + 1), 9) AS score
 FROM p JOIN df USING (term) JOIN tot ON tot.source = p.source, c) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, term) <= 3""")
def topic_labels(spark: SparkSession, base: str) -> DataFrame:
    """The three terms of greatest TF-IDF of each source."""
    return search.topic_terms(T(spark, base, "documents"), "source", "doc_id", "text", 3, Scratch(spark, "labels"))


# ---- edges and lineage -----------------------------------------------------


@query(f"""WITH RECURSIVE {reference._TREE}, asked AS (SELECT {reference._key_sql('parent_id')} AS parent, {reference._key_sql('doc_id')} AS child FROM index_documents
 UNION SELECT {reference._key_sql('doc_id')}, {reference._key_sql('parent_id')} FROM index_documents)
 SELECT a.parent, a.child, CASE WHEN a.parent NOT IN (SELECT id FROM known) THEN 'unknown_parent' WHEN a.child NOT IN (SELECT id FROM known) THEN 'unknown_child'
 WHEN e.parent IS NOT NULL THEN 'exists' WHEN a.parent = a.child OR r.doc IS NOT NULL THEN 'circle' ELSE 'ok' END AS status
 FROM asked a LEFT JOIN edges e ON e.parent = a.parent AND e.child = a.child LEFT JOIN reach r ON r.doc = a.parent AND r.anc = a.child
 WHERE a.parent IS NOT NULL AND a.child IS NOT NULL""")
def guarded_appends(spark: SparkSession, base: str) -> DataFrame:
    """The links that the index tells, read both ways, as new edges of the lineage."""
    rows = T(spark, base, "index_documents").select(hierarchy.uuid_key(F.col("doc_id")).alias("d"), hierarchy.uuid_key(F.col("parent_id")).alias("p"))
    asked = rows.select(F.col("p").alias("parent"), F.col("d").alias("child")).union(rows.select("d", "p"))
    nodes, edges, labels = general._labelled(spark, base)
    stored = references.lineage_edges(T(spark, base, "lineage"))
    return appends.guarded(asked, stored, hierarchy.intervals(nodes, labels), hierarchy.circles(nodes, edges, labels))


@query(f"""WITH {reference._TYPED}, gone AS (SELECT doc_id FROM document_metadata WHERE language = 'de') SELECT src, dst, ref_type FROM typed t
 WHERE NOT (ref_type = 'parent' AND src IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL))
 AND NOT (ref_type = 'child' AND EXISTS (SELECT 1 FROM typed p WHERE p.ref_type = 'parent' AND p.src = t.dst AND p.dst = t.src AND p.src IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)))""")
def edges_removed(spark: SparkSession, base: str) -> DataFrame:
    """Typed edges without the parent links, and their reverses, of documents in one language."""
    typed = reference._typed(spark, base)
    of = T(spark, base, "document_metadata").where("language = 'de'").select(F.col("doc_id").alias("src"))
    return appends.removed(typed, typed.where("ref_type = 'parent'").join(of, "src", "left_semi"))


@query(f"WITH {reference._TYPED} SELECT src, ref_type, count(DISTINCT dst) AS targets FROM typed WHERE ref_type = 'child' GROUP BY 1, 2")
def edges_of_type(spark: SparkSession, base: str) -> DataFrame:
    return appends.of_type(reference._typed(spark, base), "child")


_PAIRS = f"""s AS (SELECT q.vec_id AS src, e.vec_id AS dst, {_COS.format('q.embedding', 'e.embedding')} AS c FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
 near AS (SELECT src, dst, round(c, 6) AS similarity FROM s WHERE c >= 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(c, 12) DESC, dst) <= 20)"""


def _near(spark: SparkSession, base: str) -> DataFrame:
    rows = T(spark, base, "embeddings")
    near = search.nearest_to(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 20, 0.0)
    return near.select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT src, dst, similarity, CASE WHEN similarity >= 0.7 THEN 'similar' WHEN similarity >= 0.5 THEN 'context' ELSE 'related' END AS ref_type FROM near")
def semantic_relations(spark: SparkSession, base: str) -> DataFrame:
    """The twenty nearest of the query vectors, typed by similarity."""
    return _near(spark, base).withColumn("ref_type", appends.relation(F.col("similarity")))


@query(f"""WITH {_PAIRS}, e AS (SELECT src, dst, CASE WHEN dst % 3 = 0 THEN 'citation' ELSE 'similar' END AS ref_type, CASE WHEN dst % 5 > 0 THEN similarity END AS similarity, CASE WHEN dst % 2 = 0 THEN 'url' END AS kind FROM near)
 SELECT src, dst, CASE WHEN ref_type = 'similar' AND similarity IS NULL THEN 'similarity' WHEN ref_type = 'citation' AND kind IS NULL THEN 'citation_type' ELSE 'ok' END AS status FROM e""")
def edge_metadata_checks(spark: SparkSession, base: str) -> DataFrame:
    """Edges with parts of their metadata left out, through the metadata check."""
    near = _near(spark, base)
    made = near.select(
        "src",
        "dst",
        F.when(F.col("dst") % 3 == 0, "citation").otherwise("similar").alias("ref_type"),
        F.when(F.col("dst") % 5 > 0, F.col("similarity")).alias("similarity"),
        F.when(F.col("dst") % 2 == 0, "url").alias("kind"),
    )
    return made.select("src", "dst", appends.edge_status("ref_type", "similarity", "kind").alias("status"))


@query(f"""WITH RECURSIVE {reference._EDGES}, st AS (SELECT DISTINCT {reference._key_sql('doc_id')} AS id FROM lineage WHERE origin_type = 'eml'),
 w AS (SELECT id, 0 AS hops FROM st WHERE id IS NOT NULL UNION SELECT e.child, w.hops + 1 FROM w JOIN edges e ON e.parent = w.id WHERE w.hops < 3 AND e.told_by = 'both')
 SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY id""")
def bounded_traversal(spark: SparkSession, base: str) -> DataFrame:
    """What is within three links, told by both ends, below the documents of one origin."""
    lineage = T(spark, base, "lineage")
    edges = references.lineage_edges(lineage).select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.col("told_by").alias("ref_type"))
    starts = lineage.where("origin_type = 'eml'").select(hierarchy.uuid_key(F.col("doc_id")).alias("id"))
    return appends.traversed(Scratch(spark, "traversal").save(edges), starts, 3, ["both"])


@query("""SELECT doc_id, field, arg_max(value, record_id) AS value FROM (SELECT doc_id, record_id, unnest(map_keys(metadata)) AS field, unnest(map_values(metadata)) AS value FROM lineage
 WHERE doc_id IS NOT NULL) WHERE value IS NOT NULL GROUP BY 1, 2""")
def merged_metadata(spark: SparkSession, base: str) -> DataFrame:
    """The metadata of all snapshots of a document, merged field by field."""
    return appends.merged(T(spark, base, "lineage"), "doc_id", "metadata", "record_id")


# ---- steps and scores ------------------------------------------------------


@query(f"""WITH {FACTS} SELECT source, doc_id, seq, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY epoch_us(ts) DESC NULLS LAST, doc_id, seq, step_name, status, duration_ms) AS nth
 FROM facts WHERE source IS NOT NULL AND doc_id IS NOT NULL) WHERE nth <= 100""")
def bounded_history(spark: SparkSession, base: str) -> DataFrame:
    """The last hundred steps of each source."""
    rows = steps.facts(T(spark, base, "processing_steps")).where("source is not null and doc_id is not null")
    order = [F.unix_micros("ts").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("doc_id", "seq", "step_name", "status", "duration_ms")]]
    return appends.bounded(rows, "source", order, 100).select("source", "doc_id", "seq", "nth")


@query("""SELECT doc_id, arg_max(duration_ms, (seq, epoch_us(ts), duration_ms)) AS last, round(sum(duration_ms), 4) AS total FROM
 (SELECT DISTINCT doc_id, seq, step_name, status, ts, source, duration_ms FROM processing_steps) WHERE doc_id IS NOT NULL AND duration_ms IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL GROUP BY doc_id""")
def metric_values(spark: SparkSession, base: str) -> DataFrame:
    """Durations as metric events: the last one set, and all as increments."""
    rows = steps.facts(T(spark, base, "processing_steps")).where("seq is not null and ts is not null").withColumn("us", F.unix_micros("ts"))
    out = appends.metric_values(rows, "doc_id", "duration_ms", ["seq", "us"])
    return out.withColumn("total", F.round("total", 4))


@query(f"""WITH {FACTS} SELECT step_name, count(*) AS slow, max(duration_ms) AS slowest FROM facts WHERE duration_ms >= 1000 GROUP BY 1""")
def slow_steps(spark: SparkSession, base: str) -> DataFrame:
    """Steps of a second or more."""
    rows = steps.facts(T(spark, base, "processing_steps").where("duration_ms >= 1000"))
    return rows.groupBy("step_name").agg(F.count("*").alias("slow"), F.max("duration_ms").alias("slowest"))


@query(f"""WITH {FACTS}, w AS (SELECT doc_id, seq, step_name, status, epoch_us(ts) AS us FROM facts WHERE status IN ('failed', 'error') AND step_name = 'validate')
 SELECT doc_id, seq, us FROM w WHERE us BETWEEN 1640995200000000 AND 1704067199999999""")
def steps_of_type(spark: SparkSession, base: str) -> DataFrame:
    """Failed steps of one type in a time range, both ends included."""
    wanted = F.col("status").isin(*steps.BAD) & (F.col("step_name") == "validate") & F.unix_micros("ts").between(1640995200000000, 1704067199999999)
    return steps.facts(T(spark, base, "processing_steps").where(wanted)).select("doc_id", "seq", F.unix_micros("ts").alias("us"))


@query(f"""WITH {FACTS}, f AS (SELECT doc_id, count(*) AS attempts, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM facts WHERE status IN ('failed', 'error') AND doc_id IS NOT NULL GROUP BY doc_id),
 e AS (SELECT max(epoch_us(ts)) AS now_us FROM facts) SELECT doc_id, attempts, attempts < 3 AND now_us - first_us <= 63072000000000 AND last_us + 60000000 <= now_us AS due FROM f, e WHERE first_us IS NOT NULL""")
def retry_eligibility(spark: SparkSession, base: str) -> DataFrame:
    """Which failed documents may be tried again: under three attempts, within two years, a minute after the last."""
    rows = steps.facts(T(spark, base, "processing_steps")).withColumn("us", F.unix_micros("ts"))
    failed = rows.where(F.col("status").isin(*steps.BAD) & F.col("doc_id").isNotNull())
    failed = failed.groupBy("doc_id").agg(F.count("*").alias("attempts"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).where("first_us is not null")
    now = T(spark, base, "processing_steps").agg(F.max(F.unix_micros("ts")).alias("now_us"))
    due = appends.retry_due(F.col("attempts"), F.lit(3), F.col("first_us"), F.lit(63072000000000), F.col("last_us") + 60000000, F.col("now_us"))
    return failed.crossJoin(F.broadcast(now)).select("doc_id", "attempts", due.alias("due"))  # one row


@query(f"""WITH {FACTS}, e AS (SELECT max(epoch_us(ts)) AS now_us FROM facts) SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS kept FROM facts, e
 WHERE epoch_us(ts) >= now_us - 7776000000000 GROUP BY 1""")
def retained_steps(spark: SparkSession, base: str) -> DataFrame:
    """Steps of the last ninety days, by day."""
    rows = T(spark, base, "processing_steps")
    now = rows.agg(F.max(F.unix_micros("ts")).alias("now_us"))
    kept = steps.facts(rows).crossJoin(F.broadcast(now)).where(F.unix_micros("ts") >= F.col("now_us") - 7776000000000)  # one row
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("kept"))


@query(f"""WITH {FACTS}, d AS (SELECT source, avg(({reference._FILLED}) / 4) AS completeness, avg(CASE WHEN lower(trim(language)) IN ('en', 'de', 'fr') THEN 1.0 ELSE 0.0 END) AS consistency,
 avg(CASE WHEN coalesce(trim(author), '') <> '' THEN 1.0 ELSE 0.0 END) AS reputation, avg(CASE WHEN len(tags) > 0 THEN 1.0 ELSE 0.0 END) AS expertise, count(*) AS updates FROM document_metadata WHERE source IS NOT NULL GROUP BY source),
 b AS (SELECT source, avg(CASE WHEN length(trim(content_body)) >= 10 THEN 1.0 ELSE 0.0 END) AS readability FROM index_documents WHERE source IS NOT NULL GROUP BY source),
 s AS (SELECT source, avg(CASE WHEN status IN ('failed', 'error') THEN 0.0 ELSE 1.0 END) AS accuracy, avg(CASE WHEN status IN ('success', 'completed') THEN 1.0 ELSE 0.0 END) AS verification, max(epoch_us(ts)) AS us
  FROM facts WHERE source IS NOT NULL GROUP BY source), e AS (SELECT max(us) AS now_us FROM s),
 q AS (SELECT d.source, 0.3 * completeness + 0.2 * consistency + 0.2 * readability + 0.3 * accuracy AS quality, 0.3 * reputation + 0.3 * verification + 0.2 * expertise AS authority,
  least(1.0, updates / greatest((now_us - us) / 1e6, 1.0)) AS frequency, completeness FROM d JOIN b USING (source) JOIN s USING (source), e)
 SELECT source, round(quality, 6) AS quality, round(authority, 6) AS authority, round(frequency, 6) AS frequency, round(0.3 * authority + 0.3 * quality + 0.2 * completeness + 0.2 * frequency, 6) AS score FROM q""")
def source_quality(spark: SparkSession, base: str) -> DataFrame:
    """Component scores of each source: quality and authority from their parts (no figure tells trust), updates since the last one."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    filled = lambda c: F.coalesce(F.btrim(c), F.lit("")) != ""
    meta = T(spark, base, "document_metadata").where("source is not null").groupBy("source").agg(
        (sum((share(filled(c)) for c in ("author", "path", "language")), share(filled("title"))) / 4).alias("completeness"),
        share(F.lower(F.btrim("language")).isin("en", "de", "fr")).alias("consistency"),
        share(filled("author")).alias("reputation"),
        share(F.size("tags") > 0).alias("expertise"),
        F.count("*").alias("updates"),
    )
    body = T(spark, base, "index_documents").where("source is not null").groupBy("source").agg(share(F.length(F.btrim("content_body")) >= 10).alias("readability"))
    done = steps.facts(T(spark, base, "processing_steps")).where("source is not null").groupBy("source").agg(
        (1 - share(F.col("status").isin(*steps.BAD))).alias("accuracy"), share(F.col("status").isin(*steps.DONE)).alias("verification"), F.max(F.unix_micros("ts")).alias("us")
    )
    now = done.agg(F.max("us").alias("now_us"))
    c = F.col
    rows = meta.join(body, "source").join(done, "source").crossJoin(F.broadcast(now)).select(  # one row
        "source",
        "completeness",
        appends.quality_score(c("completeness"), c("consistency"), c("readability"), c("accuracy")).alias("quality"),
        appends.authority_score(c("reputation"), c("verification"), c("expertise"), F.lit(None).cast("double")).alias("authority"),
        appends.update_frequency(c("updates"), (c("now_us") - c("us")) / 1e6).alias("frequency"),
    )
    score = appends.reliability_score(c("authority"), c("quality"), c("completeness"), c("frequency"))
    return rows.select("source", *[F.round(n, 6).alias(n) for n in ("quality", "authority", "frequency")], F.round(score, 6).alias("score"))


@query("""SELECT record_id, CASE WHEN metadata IS NULL THEN 1 ELSE 2 END AS depth, 2 + coalesce(len(map_keys(metadata)), 0) AS fields FROM lineage""")
def nested_shape(spark: SparkSession, base: str) -> DataFrame:
    """Nesting and number of fields of lineage metadata written as JSON."""
    json = F.to_json(F.struct("record_id", "metadata"), {"ignoreNullFields": "false"})
    depth, fields = appends.json_shape(json)
    return T(spark, base, "lineage").select("record_id", depth.cast("int").alias("depth"), fields.cast("long").alias("fields"))


@query(f"""WITH {reference._EDGES}, p AS (SELECT parent IN (SELECT id FROM known) AS hp, child IN (SELECT id FROM known) AS hc, parent = child AS own, told_by <> 'both' AS one FROM edges)
 SELECT count(*) AS edges, count(*) FILTER (NOT hp) AS parent_missing, count(*) FILTER (NOT hc) AS child_missing, count(*) FILTER (own) AS self_links, count(*) FILTER (one) AS one_sided FROM p""")
def reference_health(spark: SparkSession, base: str) -> DataFrame:
    """Counts of links and of each kind of broken link."""
    rows = T(spark, base, "lineage")
    edges = Scratch(spark, "health").save(references.lineage_edges(rows))
    problems = references.integrity(edges, rows, "doc_id").agg(
        *[F.count_if(F.col("problem") == p).alias(n) for p, n in (("parent_missing",) * 2, ("child_missing",) * 2, ("self_link", "self_links"), ("one_sided",) * 2)]
    )
    return edges.agg(F.count("*").alias("edges")).crossJoin(problems)  # one row each


@query(f"""WITH RECURSIVE {reference._TREE}, top AS (SELECT doc, anc AS thread FROM reach WHERE anc NOT IN (SELECT child FROM tree)), dep AS (SELECT doc, count(*) AS depth FROM reach GROUP BY doc),
 seen AS (SELECT {reference._key_sql('doc_id')} AS doc, max(last_modified) AS newest FROM lineage GROUP BY 1)
 SELECT thread, count(*) AS messages, CAST(max(depth) AS INTEGER) AS deepest, max(newest) AS newest FROM top JOIN dep USING (doc) JOIN seen USING (doc) WHERE depth <= 50 GROUP BY thread""")
def threads(spark: SparkSession, base: str) -> DataFrame:
    """Each hierarchy as a thread of replies: those up to fifty deep, and the newest of them."""
    found = general.p1_found(spark, base).where(F.col("depth").between(1, 50))
    seen = T(spark, base, "lineage").groupBy(hierarchy.uuid_key(F.col("doc_id")).alias("doc_id")).agg(F.max("last_modified").alias("newest"))
    return found.join(seen, "doc_id").groupBy(F.col("root_id").alias("thread")).agg(F.count("*").alias("messages"), F.max("depth").alias("deepest"), F.max("newest").alias("newest"))


@query(f"""WITH {FACTS} SELECT DISTINCT source, epoch_us(date_trunc('month', ts)) AS us FROM facts WHERE source IS NOT NULL AND epoch_us(date_trunc('month', ts)) BETWEEN 1640995200000000 AND 1672531200000000""")
def tags_between(spark: SparkSession, base: str) -> DataFrame:
    """Monthly tags of each source in a time range, both ends included."""
    us = F.unix_micros(F.date_trunc("month", "ts"))
    rows = T(spark, base, "processing_steps").where("source is not null").select("source", us.alias("us"))
    return rows.where(F.col("us").between(1640995200000000, 1672531200000000)).distinct()


@query("SELECT record_id, doc_id, content_title, md5(content_body) AS body_hash FROM index_documents WHERE doc_id = (SELECT min(doc_id) FROM lineage) OR record_id = 7")
def point_lookup(spark: SparkSession, base: str) -> DataFrame:
    """The records of one document, and one record, by their ids."""
    asked = T(spark, base, "lineage").agg(F.min("doc_id")).first()[0]
    rows = T(spark, base, "index_documents").where((F.col("doc_id") == F.lit(asked)) | (F.col("record_id") == 7))
    return rows.select("record_id", "doc_id", "content_title", F.md5("content_body").alias("body_hash"))


@query("""SELECT record_id, item, last_modified FROM (SELECT record_id, last_modified, metadata['type'] AS type, unnest(derived_documents) AS item FROM lineage)
 WHERE type = 'docx' AND last_modified < '2023-01-01T00:00:00Z' AND item IS NOT NULL""")
def nested_items(spark: SparkSession, base: str) -> DataFrame:
    """Entries of a nested list of the rows of one type that are older than a day."""
    rows = T(spark, base, "lineage").where((F.col("metadata")["type"] == "docx") & (F.col("last_modified") < "2023-01-01T00:00:00Z"))
    return rows.select("record_id", F.explode("derived_documents").alias("item"), "last_modified").where("item is not null")


@query()
def topic_elbow(spark: SparkSession, base: str) -> DataFrame:
    """The number of topics before the largest fall of the spread, and the spread of each number tried."""
    return search.elbow(T(spark, base, "embeddings"), "embedding", 8, 50)
