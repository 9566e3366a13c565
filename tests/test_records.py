"""User rules, overlays, exact percentiles, histories and the stream join on small rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.operators import rules, search, steps
from quirework.session import Scratch
from quirework.sources import files
from quirework.streaming import streams


def test_rules(spark):
    df = spark.createDataFrame([(1, " A b "), (2, ""), (3, None), (4, "HTTP x")], "id int, t string")
    r = rules.Rules().add_transformer(F.btrim).add_transformer(F.lower).add_filter(lambda c: F.length(c) > 0).add_filter(lambda c: ~c.contains("http"))
    assert [tuple(x) for x in r.applied(df, "t").collect()] == [(1, "a b")]
    r.add_check(F.length("t") > 2, "short").add_check(F.col("id") < 4, "late")
    assert {x.id: x.v for x in df.select("id", r.violated().alias("v")).collect()} == {1: [], 2: ["short"], 3: ["short"], 4: ["late"]}
    empty = rules.Rules()
    assert empty.applied(df, "t").collect() == df.collect() and df.select(empty.violated().alias("v")).first().v == []


def test_field_status(spark):
    df = spark.createDataFrame([("4", "x", "ok"), ("4.5.1", "x", "type:n"), (None, "x", "missing:n"), ("a", None, "missing:s")], "n string, s string, want string")
    got = df.withColumn("got", rules.field_status({"n": (F.col("n"), "int"), "s": (F.col("s"), "string")})).collect()
    assert all(r.got == r.want for r in got)
    assert df.select(rules.field_status({}).alias("g")).distinct().first().g == "ok"


def test_overlays(spark):
    base = T.StructType.fromDDL("id long, body string")
    merged = rules.overlay(base, {"BODY": "int", "rank": "double"}, "tenant_id")
    assert [(f.name, f.dataType.simpleString()) for f in merged] == [("id", "bigint"), ("body", "int"), ("rank", "double"), ("tenant_id", "string")]
    assert rules.schema_problems(merged, {"Id": "long", "body": "string", "gone": "int"}) == ["type: body is int, not string", "missing: gone"]
    df = spark.createDataFrame([(1, "7", "t"), (2, "x", None)], "id long, body string, tenant_id string")
    assert [tuple(r) for r in rules.conformed(df, merged).orderBy("id").collect()] == [(1, 7, None, "t"), (2, None, None, None)]
    assert rules.conformed(df.limit(0), merged).columns == merged.names


def test_column_stats(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", None), (2, None, None)], "value int, column string, n string")
    got = {r["column"]: tuple(r)[1:] for r in rules.column_stats(df, ["value", "column", "n"]).collect()}
    assert got == {"value": (3, 0, 2, "1", "2"), "column": (2, 1, 2, "a", "b"), "n": (1, 2, 1, "x", "x")}
    assert {tuple(r) for r in rules.column_stats(df.limit(0), ["n"]).collect()} == {("n", 0, 0, 0, None, None)}


def test_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice((1, 1, 1, 2, 50)))) for _ in range(900)] + [("b", rng.random()) for _ in range(57)] + [(None, 5.0), ("one", -2.0), ("none", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in steps.performance(df, "g", "v", Scratch(spark, "t")).collect()}
    assert set(got) == {"hot", "b", None, "one"}
    for g, r in got.items():
        x = np.array([v for k, v in rows if k == g and v is not None and v == v])
        want = [len(x), x.min(), x.max(), x.mean(), x.std(), *np.percentile(x, [50, 95, 99])]
        assert list(r)[1:] == pytest.approx(want, abs=1e-4), g
    assert steps.performance(df.limit(0), "g", "v", Scratch(spark, "t")).count() == 0


def test_change_log(spark):
    changes = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("a", 30, "z"), ("b", 5, "w"), (None, 6, "v")], "k string, us long, change string")
    tags = spark.createDataFrame([("a", 25), ("a", 29), ("a", 9), ("b", 5)], "k string, us long")
    assert {tuple(r) for r in steps.change_log(changes, "k", tags=tags).collect()} == {("a", 20, "y"), ("b", 5, "w")}
    assert {r.change for r in steps.change_log(changes, "k", 10, 20).collect()} == {"x", "y"}
    assert steps.change_log(changes.limit(0), "k", tags=tags).count() == 0


def test_empty_steps(spark):
    none = spark.createDataFrame([], "doc_id string, seq int, step_name string, status string, ts timestamp, source string, duration_ms double")
    assert list(steps.recent_status(none, 60).first()) == [0] * 8
    assert steps.error_summary(none).count() == 0
    assert steps.progress(none.withColumn("us", F.lit(1)), "source", "ts", "us").count() == 0


def test_stored_histories(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text('{"id": "a", "parents": ["b"]}\n{bad\n{"id": "c"}\n')
    got = files.read_json_lines(spark, str(lines), "id string, parents array<string>").collect()
    assert {(r.id, tuple(r.parents or ()), r.corrupt) for r in got} == {("a", ("b",), None), (None, (), "{bad"), ("c", (), None)}
    rows = spark.createDataFrame([("git", "r1", 1), ("git", "r2", 2), ("wiki", "r1", 3)], "source_type string, source_id string, n int")
    files.save_history(rows, str(tmp_path / "h"))
    files.save_history(rows.limit(1), str(tmp_path / "h"))
    assert sorted(r.n for r in files.read_history(spark, str(tmp_path / "h"), "git").collect()) == [1, 1, 2]
    assert [r.n for r in files.read_history(spark, str(tmp_path / "h"), "wiki", "r1").collect()] == [3]


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.c.txt").write_bytes(b"\xe9")
    (tmp_path / "empty.txt").write_bytes(b"")
    assert {(r.title, r.body) for r in files.text_documents(spark, str(tmp_path)).collect()} == {("a", "é"), ("b.c", "é")}


def test_stream_join_equals_batch(spark, tmp_path):
    def rows(name, column, times):
        df = spark.createDataFrame([(k, s) for k, s in times], "k string, s long").select("k", F.timestamp_seconds(F.col("s") + 86400).alias(column), F.col("s").alias(name))
        df.coalesce(1).write.parquet(str(tmp_path / name))
        return df, streams.event_stream(spark, str(tmp_path / name), f"k string, {column} timestamp, {name} long")

    (a, left), (b, right) = rows("x", "ts", [("a", 0), ("a", 100), ("b", 0), (None, 0)]), rows("y", "other_ts", [("a", 0), ("a", 3600), ("a", 3701), ("b", -1), ("c", 5), (None, 0)])
    streams.run_once(streams.matched(left, right, "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.k, r.x, r.y) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, 0), ("a", 0, 3600), ("a", 100, 3600)}
    assert {(r.k, r.x, r.y) for r in streams.matched(a, b, "k").collect()} == got


def test_alert_state_ends(spark, tmp_path):
    def send(name, seconds):
        spark.createDataFrame([("k", s, str(s)) for s in seconds], "key string, seconds long, message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.event_stream(spark, str(tmp_path / "in"), "key string, seconds long, message string")
        streams.run_once(streams.cooled(stream, 300), str(tmp_path / "out"), str(tmp_path / "cp"))
        return sorted(r.seconds for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert send("a", [1000, 1100]) == [1000]
    assert send("b", [1200, 1300, 1500]) == [1000, 1300]  # state lives on across batches
    assert send("c", [90000, 90100]) == [1000, 1300, 90000]
    assert send("d", [90200, 90300]) == [1000, 1300, 90000, 90300]


def test_cooldown_of_a_key_without_gaps(spark, monkeypatch):
    """Alerts that never pause for a cooldown, over many spans, equal a plain fold."""
    monkeypatch.setattr(steps, "LONGEST_SPAN", 500)
    rng = random.Random(5)
    rows = [("hot", rng.randrange(-4000, 9000), i, "x") for i in range(2500)] + [("rare", rng.randrange(10**6), i, None) for i in range(40)]
    rows += [(k, s, i, "again") for k, s, i, _ in rows[:50]] + [(None, 1, 1, "x"), ("hot", None, 1, "x"), ("edge", 0, 1, "x"), ("edge", 100, 2, "x"), ("edge", 199, 3, "x")]
    df = spark.createDataFrame(rows, "k string, t long, __nth int, b string")
    want, last = set(), {}
    for k, s, i in sorted((k, s, i) for k, s, i, _ in rows if k and s is not None):
        if k not in last or s - last[k] >= 100:
            last[k] = s
            want.add((k, s, i))
    got = [(r.k, r.t) for r in steps.cooled(df.withColumnRenamed("__nth", "n"), "k", "t", "n", 100).collect()]
    assert sorted(got) == sorted((k, s) for k, s, _ in want)
    short = {(r.k, r.t, r.n) for r in steps.cooled(df.withColumnRenamed("__nth", "n"), "k", "t", "n", 100).collect()}
    assert short == want


def test_counter_increase(spark):
    rows = [("a", 1, 1, 5.0), ("a", 2, 1, 9.0), ("a", 12, 1, 10.0), ("a", 12, 2, 3.0), ("a", 41, 1, 4.5), ("b", 5, 1, 7.0), (None, 1, 1, 1.0), ("a", None, 1, 1.0), ("a", 13, 1, None)]
    df = spark.createDataFrame(rows, "k string, s long, n int, v double").withColumn("us", F.col("s") * 1000000)
    got = {(r.k, r.start_us // 1000000): r.increase for r in steps.increase(df, "k", "us", "n", "v", 10).collect()}
    assert got == {("a", 0): 4.0, ("a", 10): 4.0, ("a", 40): 1.5, ("b", 0): 0.0}
    assert steps.increase(df.limit(0), "k", "us", "n", "v", 10).count() == 0


def test_nearest_topic(spark):
    made = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.2]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (None, [5.0, 5.0])], "label int, e array<double>")
    df = spark.createDataFrame([("a", [2.0, 0.1]), ("b", [0.0, 1.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [1.0, float("nan")])], "id string, e array<double>")
    means = search.centroids(made, "label", "e")
    assert {(r.id, r.topic) for r in search.nearest_topic(df, "id", "e", means).collect()} == {("a", 1), ("b", 2)}
    assert search.nearest_topic(df, "id", "e", search.centroids(made.limit(0), "label", "e")).count() == 0
    with pytest.raises(ValueError):
        search.nearest_topic(df, "id", "e", means, most=1)
