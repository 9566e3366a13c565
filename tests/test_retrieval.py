"""Citations against plain search, guarded appends, and the component scores."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.operators import appends, citations, hierarchy, search
from quirework.session import Scratch


def edges_of(spark, rows):
    df = spark.createDataFrame(rows, "id long, body string, dst string")
    found = citations.detected(df, "id", "body")
    return {(r.src, r.dst, r.citation_type, r.cited) for r in citations.edges(found, df.drop("dst"), "id", "body", Scratch(spark, "t")).collect()}


def test_citations_with_places(spark):
    body = 'He wrote "first" and “second”. See section "Limits", [3] and 4[5] {^6}; (Kim, 2020) www.a.org/x'
    df = spark.createDataFrame([(1, body), (1, body), (2, None), (3, "")], "id long, body string")
    got = citations.detected(df, "id", "body").collect()
    assert {r.id for r in got} == {1} and len(got) == 2 * len(set(got))
    assert {(r.citation_type, r.nth, r.cited) for r in got} == {
        ("direct_quote", 1, "first"), ("direct_quote", 2, "second"), ("direct_quote", 3, "Limits"), ("inline_reference", 1, "Limits"),
        ("numbered_reference", 1, "3"), ("numbered_reference", 2, "5"), ("author_year", 1, "Kim, 2020"), ("footnote", 1, "3"), ("footnote", 2, "6"), ("url", 1, "www.a.org/x"),
    }
    for r in got:
        assert r.cited in body[r.start_pos : r.end_pos]


def test_edges_equal_plain_search(spark):
    """Cited texts of every length, in copies, across word borders, in long bodies and only in their own."""
    rng = random.Random(7)
    plain = ["".join(rng.choice("abc dé ") for _ in range(rng.choice((30, 400, 5000)))) for _ in range(40)]
    rows = [(i, t, None) for i, t in enumerate(plain)]
    for n in (1, 2, 3, 4, 7, 8, 23, 24, 25, 29):
        at = plain[rng.randrange(40)]
        start = rng.randrange(len(at) - n)
        rows.append((100 + n, f'x "{at[start : start + n]}" y', None))
    rows += [(200, '"held by nobody else at all, whatever its length"', None), (201, "see section ABC. and https://a.org/b", None), (202, "abc https://a.org/b", None)]
    rows += [(300, None, None), (301, "", None), (302, '"  "', None)]
    texts = {i: t for i, t, _ in rows if t}
    want = set()
    for i, t in texts.items():
        for name in citations.RESOLVED:
            for m in __import__("re").finditer(citations.CITATION_FAMILIES[name], t):
                cited = next((g for g in m.groups() if g is not None), m.group())
                low = name == "inline_reference"
                needle = cited.strip().lower() if low else cited
                held = [j for j, b in texts.items() if j != i and needle and needle in (b.lower() if low else b)]
                if held:
                    want.add((i, min(held), name, cited))
    got = edges_of(spark, rows)
    assert got == want and len(want) > 8
    assert edges_of(spark, [(1, "no citation", None)]) == set()


def test_guarded_appends(spark):
    names = "abcdefgh"
    ids = {c: f"0000000{i}-0000-0000-0000-000000000000" for i, c in enumerate(names)}
    up = {"b": "a", "c": "b", "d": "c", "f": "g", "g": "h", "h": "f", "e": "f"}  # a chain, and a document below a circle
    rows = [(ids[c], None, [ids[up[c]]] if c in up else None, None) for c in names]
    snapshots = spark.createDataFrame(rows, "doc_id string, derived_from string, parents array<string>, children array<string>")
    scratch = Scratch(spark, "t")
    nodes, edges = hierarchy.links(snapshots, scratch)
    labels = hierarchy.label(nodes, edges, scratch)
    pairs = [(p, c) for p in names for c in names] + [("a", "a")]
    asked = spark.createDataFrame([(ids[p], ids[c]) for p, c in pairs] + [("x", ids["a"]), (ids["a"], "x"), (None, ids["a"])], "parent string, child string")
    stored = spark.createDataFrame([(ids[p], ids[c]) for c, p in up.items()], "parent string, child string")
    got = {(r.parent, r.child): r.status for r in appends.guarded(asked, stored, hierarchy.intervals(nodes, labels), hierarchy.circles(nodes, edges, labels)).collect()}
    assert got.pop(("x", ids["a"])) == "unknown_parent" and got.pop((ids["a"], "x")) == "unknown_child" and len(got) == 64
    for p, c in set(pairs):
        above, at = {p}, p
        while at in up and up[at] not in above:
            at = up[at]
            above.add(at)
        want = "exists" if up.get(c) == p else "circle" if c in above else "ok"
        assert got[ids[p], ids[c]] == want, (p, c)


def test_component_scores(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    row = spark.range(1).select(
        appends.quality_score(*lit(0.8, 0.7, 0.9, 0.85)).alias("quality"),
        appends.authority_score(*lit(0.9, 0.8, 0.85, 0.95)).alias("authority"),
        appends.authority_score(F.lit(0.5), *[F.lit(None).cast("double")] * 3).alias("part"),
        appends.update_frequency(*lit(3, 60)).alias("seldom"),
        appends.update_frequency(*lit(30, 0)).alias("often"),
    ).first()
    assert [round(x, 6) for x in row] == [0.815, 0.87, 0.15, 0.05, 1.0]


def test_removed_and_checked_edges(spark):
    edges = spark.createDataFrame([("a", "b", "parent"), ("b", "a", "child"), ("a", "c", "next"), ("c", "a", "previous"), ("a", "d", "similar")], "src string, dst string, ref_type string")
    gone = spark.createDataFrame([("a", "b", "parent"), ("d", "a", None), ("z", "z", "next")], edges.schema)
    assert {tuple(r) for r in appends.removed(edges, gone).collect()} == {("a", "c", "next"), ("c", "a", "previous")}
    assert {tuple(r) for r in appends.of_type(edges, None).where("src = 'a'").collect()} == {("a", t, 1) for t in ("parent", "next", "similar")}
    rows = [("similar", 0.5, None, "ok"), ("similar", 1.5, None, "similarity"), ("similar", float("nan"), None, "similarity"), ("similar", None, None, "similarity"), ("citation", None, "url", "ok"), ("citation", None, None, "citation_type"), ("next", None, None, "ok")]
    df = spark.createDataFrame(rows, "t string, s double, c string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", appends.edge_status("t", "s", "c")).collect())


def test_traversal_and_statements(spark):
    ring = [("a", "b", "x", 0.9), ("b", "c", "x", 0.9), ("c", "a", "x", 0.9), ("c", "d", "x", 0.1), ("a", "e", "y", 0.9), (None, "f", "x", 0.9)]
    edges = spark.createDataFrame(ring, "src string, dst string, ref_type string, weight double")
    start = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert {tuple(r) for r in appends.traversed(edges, start, 5, ["x"], 0.5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.id for r in appends.traversed(edges, start, 1).collect()} == {"a", "b", "e"}
    sql = spark.createDataFrame([(" SELECT 1",), ("Delete from t",), ("with x as",), (None,)], "s string")
    assert [r[0] for r in sql.select(appends.statement_kind(F.col("s"))).collect()] == ["select", "delete", "other", "other"]


def _depth(v):
    return 1 + max([_depth(x) for x in v.values()] or [0]) if isinstance(v, dict) else max([_depth(x) for x in v] or [0]) if isinstance(v, list) else 0


def _fields(v):
    return len(v) + sum(map(_fields, v.values())) if isinstance(v, dict) else sum(map(_fields, v)) if isinstance(v, list) else 0


NESTED = st.recursive(st.none() | st.booleans() | st.text('ab"{}:\\ ,', max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text('a"{}:\\', max_size=4), c, max_size=3), max_leaves=12)


@settings(max_examples=10, deadline=None)
@given(st.lists(NESTED, min_size=20, max_size=40))
def test_json_shape(spark, values):
    df = spark.createDataFrame([(json.dumps(v), _depth(v), _fields(v)) for v in values], "j string, d int, f int")
    depth, fields = appends.json_shape(F.col("j"))
    assert all((r.depth, r.fields) == (r.d, r.f) for r in df.select("d", "f", depth.alias("depth"), fields.alias("fields")).collect())


def test_merges_bounds_and_labels(spark):
    df = spark.createDataFrame([("a", 1, {"x": "1", "y": "1"}), ("a", 2, {"x": "2", "y": None}), ("a", 3, None), (None, 4, {"x": "9"})], "k string, n long, m map<string,string>")
    assert {tuple(r) for r in appends.merged(df, "k", "m", "n").collect()} == {("a", "x", "2"), ("a", "y", "1")}
    assert [r.n for r in appends.bounded(df.where("k = 'a'"), "k", [F.col("n").desc()], 2).orderBy("nth").collect()] == [3, 2]
    texts = spark.createDataFrame([("s", 1, "apple apple shared"), ("t", 2, "pear shared"), (None, 3, "nothing"), ("u", 4, None)], "source string, id long, body string")
    got = {(r.source, r.term) for r in search.topic_terms(texts, "source", "id", "body", 1, Scratch(spark, "t")).collect()}
    assert got == {("s", "apple"), ("t", "pear")}
    assert search.topic_terms(texts.limit(0), "source", "id", "body", 1, Scratch(spark, "t")).count() == 0


def test_elbow(spark):
    rng = random.Random(3)
    rows = [([c * 10 + rng.random(), rng.random()],) for c in (0, 1) for _ in range(60)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<float>")
    got = search.elbow(df, "v", 4, 20).orderBy("k").collect()
    assert [r.k for r in got] == [1, 2, 3, 4] and [r.k for r in got if r.chosen] == [1] and got[0].cost > 10 * got[1].cost
    assert search.elbow(df.limit(0), "v", 4, 20).count() == 0
