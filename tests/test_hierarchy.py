"""Hierarchies against plain recursion over small random forests with circles."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quirework.operators import hierarchy
from quirework.session import Scratch

SCHEMA = "doc_id string, derived_from string, parents array<string>, children array<string>, extra string"


def name(i):
    return f"{i:08x}-0000-4000-8000-{i:012x}"


def run(spark, rows):
    scratch = Scratch(spark, "test")
    nodes, edges = hierarchy.links(spark.createDataFrame(rows, SCHEMA), scratch)
    labels = hierarchy.label(nodes, edges, scratch)
    return nodes, edges, labels


def brute(parent):
    """doc -> (root, depth), and doc -> way up."""
    out, ways = {}, {}
    for v in parent:
        way, seen = [v], {v}
        while way[-1] in parent and parent[way[-1]] not in seen:
            way.append(parent[way[-1]])
            seen.add(way[-1])
        if way[-1] in parent:  # ran into a circle
            ring = way[way.index(parent[way[-1]]) :]
            out[v] = (min(ring), -1)
        else:
            out[v] = (way[-1], len(way) - 1)
        ways[v] = way
    return out, ways


def check(spark, parent, everyone):
    rows = [(d, parent.get(d), None, None, "x") for d in everyone]
    nodes, edges, labels = run(spark, rows)
    want, ways = brute(parent)
    got = {r.doc_id: (r.root_id, r.depth) for r in hierarchy.found(nodes, edges, labels).collect()}
    assert got == want
    tree = {d for d in parent if want[d][1] >= 0}
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in hierarchy.descendants(nodes, labels).collect() if r.descendant_id in tree}
    assert pairs == {(a, d, i) for d in tree for i, a in enumerate(ways[d]) if i}
    for r in hierarchy.paths(nodes, labels).collect():
        if r.doc_id in tree:
            assert list(r.path) == ways[r.doc_id][::-1]
        assert r.path[-1] == r.doc_id
    rings = {}
    for r in hierarchy.circles(nodes, edges, labels).collect():
        rings.setdefault(r.circle_id, {})[r.step] = r.doc_id
    for first, members in rings.items():
        ring = [members[i] for i in range(len(members))]
        assert ring[0] == first == min(ring) and parent[first] == ring[-1]
        assert all(parent[b] == a for a, b in zip(ring, ring[1:]))
    assert set(rings) == {root for root, depth in want.values() if depth < 0}
    # intervals: descendants are exactly the rows whose first lies inside
    rows = labels.where("circle is null").collect()
    ids = {r.nid: r.doc_id for r in nodes.collect()}
    for r in rows:
        inside = {ids[o.id] for o in rows if o.root == r.root and r.first < o.first <= r.last}
        assert inside == {d for d in tree if ids[r.id] in ways[d][1:]}


def test_deep_wide_and_circular(spark):
    parent = {name(i): name(i - 1) for i in range(1, 40)}  # a chain
    parent |= {name(i): name(3) for i in range(100, 160)}  # a hot parent
    parent |= {name(200): name(202), name(201): name(200), name(202): name(201), name(203): name(201), name(204): name(203)}  # a circle with a tail
    parent |= {name(300): name(300), name(301): name(300)}  # a self link
    check(spark, parent, sorted(set(parent) | set(parent.values()) | {name(999)}))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    n = 30
    parent = {name(i): name(rng.randrange(n)) for i in range(n) if rng.random() < 0.8}
    check(spark, parent, [name(i) for i in range(n)])


def test_links_from_any_end_and_spelling(spark):
    a, b, c, gone = name(1), name(2), name(3), name(77)
    rows = [
        (a, None, [], ["{" + b.upper() + "}", "n/a", None, ""], None),
        (a, None, None, [gone], None),
        (b, "null", None, None, None),
        (c, " urn:uuid:" + b + " ", [b.replace("-", "")], None, None),
        (c, None, [gone], [], None),
        (None, a, None, None, None),
    ]
    nodes, edges, labels = run(spark, rows)
    assert {(r.doc_id, r.root_id, r.depth) for r in hierarchy.found(nodes, edges, labels).collect()} == {(b, a, 1), (c, a, 2)}
    assert nodes.count() == 3


def test_empty_and_conflicts(spark):
    nodes, edges, labels = run(spark, [])
    assert hierarchy.found(nodes, edges, labels).count() == 0 and hierarchy.paths(nodes, labels).count() == 0
    rows = [(name(3), name(2), [name(1)], None, None), (name(1), None, None, None, None), (name(2), None, None, None, None)]
    nodes, edges, labels = run(spark, rows)
    assert hierarchy.conflicts(edges).count() == 1
    assert [(r.root_id, r.depth) for r in hierarchy.found(nodes, edges, labels).collect()] == [(name(1), 1)]


def test_deep_chain_and_wide_star(spark, monkeypatch):
    """Segments and intervals of a chain of 3,000 and a star of 20,000; paths and descendants of asked documents only."""
    monkeypatch.setattr(hierarchy, "PATH_BLOCK", 100)
    monkeypatch.setattr(hierarchy, "RANGE_BLOCK", 64)
    chain, star = 3000, 20000
    rows = [(name(i), name(i - 1), None, None, "x") for i in range(1, chain)] + [(name(0), None, None, None, "x")]
    rows += [(name(100000), None, None, None, "x")] + [(name(100001 + i), name(100000), None, None, "x") for i in range(star)]
    nodes, edges, labels = run(spark, rows)
    ends = {r.doc_id: r for r in hierarchy.intervals(nodes, labels).collect()}
    assert ends[name(0)].n_descendants == chain - 1 and ends[name(100000)].n_descendants == star
    ways = hierarchy.segments(nodes, labels).where(f"doc_id = '{name(chain - 1)}'").collect()
    assert [(r.chain_id, r.upto, r.depth) for r in ways] == [(name(0), chain - 1, chain - 1)]
    asked = nodes.where(f"doc_id in ('{name(chain - 1)}', '{name(250)}', '{name(100007)}')").selectExpr("nid AS id")
    spelled = {r.doc_id: list(r.path) for r in hierarchy.paths(nodes, labels, asked).collect()}
    assert spelled == {name(chain - 1): [name(i) for i in range(chain)], name(250): [name(i) for i in range(251)], name(100007): [name(100000), name(100007)]}
    below = hierarchy.descendants(nodes, labels, asked).collect()
    assert len(below) == chain - 1 - 250 and {(r.ancestor_id, r.distance) for r in below} == {(name(250), d) for d in range(1, chain - 250)}


def test_second_parents_are_listed(spark):
    nodes, edges, _ = run(spark, [(name(1), name(2), [name(3), name(4)], None, "x"), *[(name(i), None, None, None, "x") for i in (2, 3, 4)]])
    got = {tuple(r) for r in hierarchy.named_conflicts(nodes, edges).collect()}
    assert got == {(name(1), name(2), name(3)), (name(1), name(2), name(4))}
