"""Registered queries against their SQL on the smallest tables, and the shared helpers."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.functions import text
from quirework.plans import general, pipeline, records, reference, retrieval
from quirework.session import Scratch, running_total

CORE = {**general.QUERIES, **reference.QUERIES, **retrieval.QUERIES, **records.QUERIES}
SQL = {**reference.SQL, **retrieval.SQL, **records.SQL}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n not in ("p1_paths", "p1_descendants")))
def test_query_equals_sql(spark, data, duck, name):
    got = CORE[name](spark, data)
    cols = sorted(got.columns)
    result = duck.execute(SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in CORE if n not in SQL))
def test_query_runs(spark, data, name):
    assert CORE[name](spark, data).count() > 0


def test_running_total_over_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, i % 7) for i in range(3000)] + [(None, -1, 2)]
    df = spark.createDataFrame(rows, "k string, n long, __x long")
    got = running_total(df, ["k", "n"], F.col("__x"), "before", Scratch(spark, "t")).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.k is not None, r.k or "", r.n)):
        assert r.before == total
        total += r["__x"]
    assert len(got) == len(rows)
    assert running_total(df.limit(0), ["k", "n"], F.lit(1), "before", Scratch(spark, "t")).count() == 0


def test_scratch_drops_files(spark):
    scratch = Scratch(spark, "t")
    kept, gone = scratch.save(spark.range(3)), scratch.save(spark.range(4))
    scratch.drop(gone, None)
    assert kept.count() == 3 and not os.path.exists(gone._scratch_path.removeprefix("file://"))


def test_pipeline_steps(spark):
    df = spark.createDataFrame([(1, " Mail a@b.org today. "), (2, "Mail a@b.org today."), (3, None), (4, "  ")], "id long, body string")
    assert pipeline.run(df, ("load",)).count() == 2
    out = pipeline.run(df, ("load", "deduplicate", "pii", "summarize")).collect()
    assert [(r.id, r.summary) for r in out] == [(1, "Mail [EMAIL] today.")]
    assert pipeline.run(df, ("load", "embed", "cluster"), {"cluster": lambda d: d.limit(1)}).count() == 1
    with pytest.raises(ValueError):
        pipeline.run(df, ("fly",))


def test_pipeline_keeps_whole_bodies(spark):
    long = "plain words " * 1000
    df = spark.createDataFrame([(1, long + "first"), (2, long + "Mail a@b.org")], "id long, body string")
    out = {r.id: r.body for r in pipeline.run(df, ("load", "deduplicate", "pii")).collect()}
    assert out == {1: long + "first", 2: long + "Mail [EMAIL]"}


def test_latest_record_keeps_untitled(spark, tmp_path):
    rows = [("a", 1, "old"), ("a", 2, None), ("b", 3, None), (None, 4, "x")]
    spark.createDataFrame(rows, "doc_id string, record_id long, content_title string").write.parquet(f"{tmp_path}/index_documents.parquet")
    got = {tuple(r) for r in CORE["latest_record"](spark, str(tmp_path)).collect()}
    assert got == {("a", 2, None), ("b", 3, None)}


def test_all_patterns_are_counted(spark, tmp_path):
    body = 'Call +44 20 7946 0958, card 4111-1111-1111-1111. See section "Limits", [3] and {^4}; \u201cquoted\u201d (Kim, 2020) www.a.org'
    spark.createDataFrame([(1, body), (2, None)], "record_id long, content_body string").write.parquet(f"{tmp_path}/index_documents.parquet")
    pii = {r.record_id: r.asDict() for r in CORE["pii_all_counts"](spark, str(tmp_path)).collect()}
    assert set(pii[1]) == {"record_id", *text.PII_PATTERNS} and pii[1]["phone"] > 0 and pii[1]["credit_card"] == 1
    cited = {r.record_id: r.asDict() for r in CORE["citation_all_counts"](spark, str(tmp_path)).collect()}
    families = {"direct_quote": 2, "inline_reference": 1, "numbered_reference": 1, "author_year": 1, "footnote": 2, "url": 1}
    assert cited[1] == {"record_id": 1, **families} and cited[2] == {"record_id": 2, **dict.fromkeys(families, 0)}


def test_time_range_reads_all_notations(spark, tmp_path):
    rows = [(1, "a", "2022-05-01T00:00:00Z", "s"), (2, "b", "01/05/2022 10:00", "s"), (3, "c", "1651363200", None), (4, "d", "2024-05-01", "s"), (5, "e", None, "s")]
    spark.createDataFrame(rows, "record_id long, doc_id string, timestamp_utc string, source string").write.parquet(f"{tmp_path}/index_documents.parquet")
    spark.createDataFrame([("s", "Europe/Paris", True)], "source string, default_zone string, day_first boolean").write.parquet(f"{tmp_path}/source_systems.parquet")
    got = {r.record_id: r.utc_micros for r in CORE["time_range_any_notation"](spark, str(tmp_path)).collect()}
    assert got == {1: 1651363200000000, 2: 1651392000000000, 3: 1651363200000000}
