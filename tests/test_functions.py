import hashlib
import math
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions import text, vector
from quirework.operators import chunking, documents, references, search, steps


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()[0]


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, " a \n\t b ", "string", text.clean(v)) == "a b" and one(spark, None, "string", text.clean(v)) == ""
    assert one(spark, None, "string", text.word_count(v)) == 0 and one(spark, "  ", "string", text.word_count(v)) == 0
    assert one(spark, "HTTPS://Ex.Org/A/b/?q=1#x", "string", text.normalise_url(v)) == "https://ex.org/A/b"
    assert one(spark, "http://a.b/c", "string", text.valid_url(v)) and not one(spark, "http://a.b//c", "string", text.valid_url(v))
    assert not one(spark, None, "string", text.valid_url(v)) and not one(spark, "ftp://a.b", "string", text.valid_url(v))
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, "häuser/x.md", "string", text.uuid5(ns, v)) == str(uuid.uuid5(uuid.UUID(ns), "häuser/x.md"))
    assert one(spark, " 3.9", "string", text.to_int(v)) == 3 and one(spark, "x", "string", text.to_int(v)) is None
    assert [one(spark, s, "double", text.duration(v)) for s in (3723.0, 62.0, 5.0, 0.0, None)] == ["1h 2m 3s", "1m 2s", "5s", "unknown", "unknown"]
    assert one(spark, "One two. Three four five! Six.", "string", text.leading_summary(v, 5)) == "One two. Three four five!"
    assert one(spark, "A single very long sentence.", "string", text.leading_summary(v, 2)) == "A single very long sentence."


def test_each_pattern_finds_its_case(spark):
    cases = {
        "email": "write to a.b@c.org", "phone": "+1 555 123 4567", "ssn": "123-45-6789", "credit_card": "4111 1111 1111 1111", "ip_address": "10.0.0.1",
        "date": "on 12/31/2024", "passport": "AB1234567", "bitcoin_address": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "ethereum_address": "0x" + "aF" * 20,
    }
    for name, value in cases.items():
        assert one(spark, value, "string", text.pattern_counts(F.col("v"))[name]) >= 1
        assert one(spark, None, "string", text.pattern_counts(F.col("v"))[name]) == 0


@settings(max_examples=8, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(1, 12), st.integers(0, 11))
def test_chunks_cover_the_text(spark, body, size, overlap):
    overlap = min(overlap, size - 1)
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id long, t string")
    got = [r.chunk for r in text.chunks_by_chars(df, "id", "t", size, overlap).orderBy("pos").collect()]
    assert got == [body[i : i + size] for i in range(0, len(body), size - overlap)]
    words = body.split()
    got = [r.chunk.split(" ") for r in text.chunks_by_words(df, "id", "t", size, overlap).orderBy("pos").collect()]
    want, at = [], 0
    while words:
        want.append(words[at : at + size])
        if at + size >= len(words):
            break
        at += size - overlap
    assert got == want


def test_vectors(spark):
    v = F.col("v")
    assert one(spark, [3.0, 4.0], "array<float>", vector.norm(v)) == 5.0
    assert one(spark, [0.0, 0.0], "array<double>", vector.cosine(v, F.array(F.lit(1.0), F.lit(0.0)))) is None
    assert one(spark, [0.0, 0.0], "array<double>", vector.l2_normalise(v)) == [0.0, 0.0]
    cases = [(None, "missing"), ([1.0], "dimension"), ([math.nan, 1.0], "not_finite"), ([math.inf, 1.0], "not_finite"), ([None, 1.0], "not_finite"), ([0.0, 0.0], "zero"), ([0.0, 1.0], "ok")]
    assert [one(spark, x, "array<float>", vector.check(v, 2)) for x, _ in cases] == [y for _, y in cases]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a", " x "), (2, "a", "x"), (3, "b", None), (4, None, "  "), (5, "b", "y")], "n long, id string, body string")
    assert {tuple(r) for r in documents.dedup_exact(df, "body", "n").collect()} == {(hashlib.sha256(b"x").hexdigest(), 1, 2), (hashlib.sha256(b"y").hexdigest(), 5, 1)}
    assert {tuple(r) for r in documents.latest(df, "id", "n").collect()} == {(2, "a", "x"), (5, "b", "y")}
    changes = documents.version_changes(df, "id", "n", F.col("body")).orderBy("n").collect()
    assert [r.change_type for r in changes] == ["created", "updated", "created", "updated"]
    new = spark.createDataFrame([("a", "z"), ("q", "w")], "id string, body string")
    assert [r.body for r in documents.updated(df, new, "id").orderBy("n").collect()] == ["z", "z", None, "  ", "y"]
    assert documents.deleted(df, new, "id").count() == 3
    page = documents.page(df, F.col("n") > 1, [F.col("n")], 2, 1).collect()
    assert [(r.n, r.total) for r in page] == [(3, 4), (4, 4)]
    assert documents.page(df, F.lit(False), [F.col("n")], 2).count() == 0


def test_search_and_references(spark):
    df = spark.createDataFrame([(1, "deep learning networks"), (2, "machine learning"), (3, None), (4, "the cats")], "id long, t string")
    scores = {r.id: r.bm25 for r in search.bm25(df, "id", "t", ["Learning", "deep", "the"]).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2]
    assert search.bm25(df, "id", "t", ["the"]).count() == 0
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [0.0, 0.0]), (10, None)], "id long, e array<float>")
    near = search.nearest_to(vec.where("id = 5"), vec, "id", "e", 2, 0.0).orderBy("similarity", ascending=False).collect()
    assert [(r.src, r.dst) for r in near] == [(5, 4), (5, 3)]
    edges = spark.createDataFrame([("a", "b", "parent", None, None), ("a", "c", "similar", 0.9, None), ("a", "q", "citation", None, True)], "src string, dst string, ref_type string, similarity double, quoted boolean")
    got = {r.dst: (r.category, round(r.confidence, 3)) for r in references.classified(edges).collect()}
    assert got == {"b": ("structural", 0.75), "c": ("indirect", 0.7), "q": ("direct", 0.9)}
    both = references.with_reverse(edges)
    assert both.count() == 6 and references.missing_reverse(both).count() == 0 and references.missing_reverse(edges.select("src", "dst", "ref_type")).count() == 3


def test_cooldown_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(3000), f"m{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, seconds long, message string, seq int")
    got = {r.message for r in steps.cooled(df, "key", "seconds", "message", 100).collect()}
    want, last = set(), {}
    for key, t, m, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or t - last[key] >= 100:
            want.add(m)
            last[key] = t
    assert got == want
    assert steps.cooled(df.limit(0), "key", "seconds", "message").count() == 0


def test_block_chunks(spark):
    body = "Intro text here.\n\n```\ncode | a\n\nmore\n```\n| a | b |\n|---|---|\n\n- one\n- two\n\n" + "word " * 230
    kinds = [k for k, _ in chunking.blocks(body)]
    assert kinds == ["prose", "code", "table", "list", "prose"]
    made = chunking.block_chunks(body)
    assert all(len(c.split()) <= chunking.MOST + chunking.LEAST for k, c in made if k == "prose")
    assert sum(c.count("word") for _, c in made) >= 230
    assert "".join(c for _, c in chunking.paragraph_chunks(body)).replace("\n", "").count("code | a") == 1
    df = spark.createDataFrame([(1, body), (2, None), (3, " ")], "id long, t string")
    assert chunking.chunks(df, "id", "t").count() == len(made)
    assert chunking.chunks(df, "id", "t", "paragraph").where("id <> 1").count() == 0
