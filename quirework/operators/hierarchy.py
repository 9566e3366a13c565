"""Parent-child links to full hierarchies by heavy-path decomposition.

The work is a fixed number of joins per round and about ``log2(depth)`` rounds,
whatever the shape of the trees:

1. ``links`` reads every snapshot's link fields into distinct (child, parent)
   pairs and numbers the documents in the order of their ids.
2. ``separate_cycles`` doubles ancestor pointers.  A document whose smallest
   ancestor is itself lies on a circle and is its smallest member; cutting the
   link above it leaves a forest.
3. The same doubling sums subtree sizes: the documents below ``v`` at distance
   under ``2^(k+1)`` are those under ``2^k`` and those below each document at
   exactly ``2^k``.
4. The largest child of each document continues its chain; every other child
   heads a new one.  A way to the root crosses at most ``log2(n)`` chains, so
   chains are placed top-down in that many joins.
5. Paths are chain segments put end to end, and the descendants of a document
   are an interval of its root's numbering.

Joins on a parent or chain that a third of all rows may share are the last step
before a table is saved, many rows against one per key, which Spark's adaptive
execution splits by size.

Edge cases.  Null, empty and filler ids and links to ids without a record are
no links.  Ids are compared as UUIDs where they are UUIDs (case, braces, dashes,
``urn:uuid:`` and blanks do not matter) and as trimmed lower-case text otherwise.
Rows may repeat.  A document named by several parents keeps the smallest, and
the others are listed by ``named_conflicts``.  If the way up enters a circle, ``depth``
is -1, ``root_id`` the circle's smallest id and the path starts there.  Empty
tables give empty results.  Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.session import Scratch, running_total

PATH_BLOCK = 512  # members of a chain in one row
RANGE_BLOCK = 1024  # places of a root's numbering that share a key
FILLERS = ("", "n/a", "na", "none", "null", "nan", "nil", "-", "--", "?", "unknown")


def uuid_key(value: Column) -> Column:
    """The canonical spelling of an id, or null for fillers."""
    text = F.lower(F.btrim(value, F.lit(" \t\r\n\u00a0")))
    digits = F.translate(F.replace(text, F.lit("urn:uuid:"), F.lit("")), "-{}", "")
    spelled = F.regexp_replace(digits, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.length(digits) == 32, spelled).when(~text.isin(*FILLERS), text)


def links(snapshots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents ``(nid, doc_id)`` and links ``(child, parent)`` between their numbers.

    ``nid`` grows with ``doc_id``, so the smallest number is the smallest id.
    ``snapshots`` has ``doc_id``, ``derived_from``, ``parents`` and ``children``.
    """
    rows = snapshots.select(uuid_key(F.col("doc_id")).alias("doc"), "derived_from", "parents", "children")
    docs = rows.where("doc is not null").select(F.col("doc").alias("doc_id")).distinct()
    nodes = scratch.save(running_total(docs, ["doc_id"], F.lit(1), "nid", scratch).select("nid", "doc_id"))
    named = (
        F.concat(F.coalesce("parents", F.array().cast("array<string>")), F.array("derived_from")),
        F.coalesce("children", F.array().cast("array<string>")),
    )
    up = rows.select(F.col("doc").alias("c"), F.explode(named[0]).alias("p")).select("c", uuid_key(F.col("p")).alias("p"))
    down = rows.select(F.explode(named[1]).alias("c"), F.col("doc").alias("p")).select(uuid_key(F.col("c")).alias("c"), "p")
    pairs = up.union(down).where("c is not null and p is not null").distinct()
    child = nodes.select(F.col("nid").alias("child"), F.col("doc_id").alias("c"))
    parent = nodes.select(F.col("nid").alias("parent"), F.col("doc_id").alias("p"))
    return nodes, scratch.save(pairs.join(child, "c").join(parent, "p").select("child", "parent"))


def conflicts(edges: DataFrame) -> DataFrame:
    """Links to a second or later parent: ``(child, kept, other)``."""
    kept = edges.groupBy("child").agg(F.min("parent").alias("kept"))
    return edges.join(kept, "child").where("parent > kept").select("child", "kept", F.col("parent").alias("other"))


def _double(open_: DataFrame) -> DataFrame:
    """One round over the open rows: pointers to the 2^(k+1)-th ancestor, the least ancestor on the way, subtree sizes.

    Rows that come out without ``ptr`` are closed: their way up ends within the
    next 2^k links.  What lies below a row that closed in an earlier round comes
    out as a further row of its id without ``parent``, to be added to it.
    """
    below = open_.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
    ahead = open_.select(F.col("id").alias("way"), F.col("ptr").alias("ptr2"), F.col("least").alias("least2"))
    # rows of closed ids have no pointer; each gets a key of its own that meets nothing
    sized = open_.join(below, "id", "full").withColumn("way", F.coalesce("ptr", -1 - F.col("id")))
    return sized.join(ahead, "way", "left").select(
        "id",
        "parent",
        F.col("ptr2").alias("ptr"),
        F.least("least", "least2").alias("least"),
        (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"),
    )


def _start(tree: DataFrame) -> DataFrame:
    return tree.select(
        "id", "parent", F.col("parent").alias("ptr"), F.col("parent").alias("least"), F.lit(1).cast("long").alias("size")
    )


def _sizes(tree: DataFrame, scratch: Scratch, stop_when_stalled: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, parent, size)`` whose way up ends, and the rows left open when their number stops falling.

    A round reads and shuffles only the rows that are still open.
    """
    state, active, closed = scratch.save(_start(tree)), None, []
    while True:
        closed.append(state.where("ptr is null").select("id", "parent", "size"))
        open_ = state.where("ptr is not null")
        now = open_.count()
        if now == 0 or (stop_when_stalled and now == active):
            break
        state, active = scratch.save(_double(open_)), now
    parts = closed[0]
    for more in closed[1:]:
        parts = parts.unionByName(more)
    return parts.groupBy("id").agg(F.max("parent").alias("parent"), F.sum("size").alias("size")), open_


def separate_cycles(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, parent, size, circle)``: a forest with subtree sizes.

    ``circle`` is the smallest id of the circle that the way up enters, else
    null; the link above that document is cut, so it is the root here.
    """
    one = edges.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    tree = scratch.save(nodes.select(F.col("nid").alias("id")).join(one, "id", "left"))
    # ways that end do so within 2^k links once the number of open ways stops falling:
    # a longer one would have an open ancestor that closed in between
    ended, left = _sizes(tree, scratch, stop_when_stalled=True)
    closed = ended.withColumn("circle", F.lit(None).cast("long"))
    ring = scratch.save(left)
    total = ring.count()
    if not total:
        return closed
    while True:
        heads = ring.where("least = id").select(F.col("id").alias("least"), F.lit(True).alias("known"))
        ahead = ring.join(heads, "least", "left").select(F.col("id").alias("ptr"), F.col("least").alias("least2"), F.col("known").alias("known2"))
        found = (
            ring.join(heads, "least", "left")
            .join(ahead, "ptr", "left")
            .select("id", "parent", F.when(F.col("known"), F.col("least")).when(F.col("known2"), F.col("least2")).alias("circle"))
        )
        found = scratch.save(found)
        if found.where("circle is null").isEmpty():
            break
        ring, old = scratch.save(_double(ring)), ring
        scratch.drop(old, found)
    cut = found.select("id", F.when(F.col("id") != F.col("circle"), F.col("parent")).alias("parent"))
    sized, _ = _sizes(cut, scratch, stop_when_stalled=False)
    return closed.unionByName(sized.join(found.select("id", "circle"), "id").select("id", "parent", "size", "circle"))


def _chains(forest: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, parent, size, circle, head, pos, heavy)``: each document's chain and its place on it."""
    heavy = (
        forest.where("parent is not null")
        .groupBy("parent")
        .agg(F.max_by("id", F.struct(F.col("size"), -F.col("id"))).alias("id"))
        .select("id", F.lit(True).alias("heavy"))
    )
    state = scratch.save(
        forest.join(heavy, "id", "left").select(
            "id",
            "parent",
            "size",
            "circle",
            F.coalesce("heavy", F.lit(False)).alias("heavy"),
            F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("id")).alias("jump"),
            F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("pos"),
            (~F.coalesce("heavy", F.lit(False))).alias("done"),
        )
    )
    while not state.where("not done").isEmpty():
        # an open row is 2^k places from its target, so no target has two open rows
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(ahead, "jump").select(
            "id", "parent", "size", "circle", "heavy", F.col("jump2").alias("jump"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done")
        )
        state, old = scratch.save(state.where("done").unionByName(moved)), state
        scratch.drop(old)
    return state.select("id", "parent", "size", "circle", "heavy", F.col("jump").alias("head"), "pos")


def label(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document number ``id``.

    ``root`` and its id ``root_id``, ``level`` (links up to the root), ``depth``
    (the same, but -1 if the way up enters a circle), ``chain`` and ``pos`` (place
    on the chain), ``segments`` (chains above, with the last place used on each),
    ``first`` and ``last`` (the document and its descendants are the rows of the
    same root whose ``first`` lies in this interval), ``size``.
    """
    forest = scratch.save(separate_cycles(nodes, edges, scratch))
    state = scratch.save(_chains(forest, scratch))
    place = state.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("up_pos"))
    light = state.where("parent is not null and not heavy").select(F.col("id").alias("head"), "parent", "size")
    # light siblings lie one after the other below the heavy one
    ordered = scratch.save(running_total(light, ["parent", "head"], F.col("size"), "before", scratch))
    first = ordered.groupBy("parent").agg(F.min("before").alias("at"))
    inner = state.where("heavy").select("parent", F.col("size").alias("heavy_size"))
    # a row per parent first, so that a parent of many children meets them in one join alone
    parents = scratch.save(first.join(inner, "parent").join(place, "parent"))
    chains = scratch.save(
        ordered.join(parents, "parent").select(
            "head", "up", "up_pos", (F.col("up_pos") + 1 + F.col("heavy_size") + F.col("before") - F.col("at")).alias("shift")
        )
    )
    segment = "array<struct<chain:long,upto:long>>"
    roots = state.where("parent is null").join(nodes.select(F.col("nid").alias("id"), F.col("doc_id").alias("root_id")), "id")
    level = scratch.save(
        roots.select(
            "head",
            F.col("id").alias("root"),
            "root_id",
            F.lit(0).cast("long").alias("base"),
            F.lit(0).cast("long").alias("at"),
            F.array().cast(segment).alias("segments"),
        )
    )
    levels = [level]
    while True:
        above = level.select(F.col("head").alias("up"), "root", "root_id", "base", F.col("at").alias("at0"), "segments")
        level = scratch.save(
            chains.join(above, "up").select(
                "head",
                "root",
                "root_id",
                (F.col("base") + F.col("up_pos") + 1).alias("base"),
                (F.col("at0") + F.col("shift")).alias("at"),
                F.concat("segments", F.array(F.struct(F.col("up").alias("chain"), F.col("up_pos").alias("upto")))).cast(segment).alias("segments"),
            )
        )
        if level.isEmpty():
            break
        levels.append(level)
    placed = levels[0]
    for more in levels[1:]:
        placed = placed.unionByName(more)
    return scratch.save(
        state.join(placed, "head").select(
            "id",
            "parent",
            "root",
            "root_id",
            (F.col("base") + F.col("pos")).alias("level"),
            F.when(F.col("circle").isNull(), F.col("base") + F.col("pos")).otherwise(F.lit(-1).cast("long")).cast("int").alias("depth"),
            F.col("head").alias("chain"),
            "pos",
            "segments",
            (F.col("at") + F.col("pos")).alias("first"),
            (F.col("at") + F.col("pos") + F.col("size") - 1).alias("last"),
            "size",
            "circle",
        )
    )


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(nodes.select(F.col("nid").alias("id"), "doc_id"), "id")


def found(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, root_id, depth)`` of each document that has a parent."""
    child = edges.select(F.col("child").alias("id")).distinct()
    return _named(nodes, labels.join(child, "id")).select("doc_id", "root_id", "depth")


def named_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, kept_parent, other_parent)``: links that the results leave out because a smaller parent is kept."""
    out = conflicts(edges)
    for column, new in (("child", "doc_id"), ("kept", "kept_parent"), ("other", "other_parent")):
        out = out.join(nodes.select(F.col("nid").alias(column), F.col("doc_id").alias(new)), column)
    return out.select("doc_id", "kept_parent", "other_parent")


def intervals(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, root_id, first, last, n_descendants)``: the descendants of a document are the documents of
    its root with ``first`` above its own and up to its ``last``."""
    return _named(nodes, labels).select("doc_id", "root_id", "first", "last", (F.col("size") - 1).alias("n_descendants"))


def segments(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, root_id, depth, nth, chain_id, upto)``: the way from the root as stretches of chains.

    The way takes the places 0 to ``upto`` of each chain in turn; there are at
    most ``log2(n)`` of them, however deep the document lies.
    """
    own = F.array(F.struct(F.col("chain"), F.col("pos").alias("upto")))
    ways = _named(nodes, labels).select("doc_id", "root_id", "depth", F.posexplode(F.concat("segments", own)).alias("nth", "s"))
    head = nodes.select(F.col("nid").alias("chain"), F.col("doc_id").alias("chain_id"))
    flat = ways.select("doc_id", "root_id", "depth", "nth", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
    return flat.join(head, "chain").select("doc_id", "root_id", "depth", "nth", "chain_id", "upto")


def paths(nodes: DataFrame, labels: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``(doc_id, root_id, depth, path, n_descendants)``; ``path`` lists the ids from the root to the document.

    With ``asked(id)`` only for those document numbers; the paths of a deep tree
    together are as long as its depths summed, so there ``segments`` is the form
    for all documents.  Chains are spelled in blocks of ``PATH_BLOCK`` members, and
    a block's members share the way up to the block; no row holds more than one
    path and no key more members than a block.
    """
    named = _named(nodes, labels).withColumn("block", F.floor(F.col("pos") / PATH_BLOCK))
    listed = lambda order: F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x[order[-1]])
    members = named.groupBy("chain", "block").agg(listed(["pos", "doc_id"]).alias("members"))
    wanted = named if asked is None else named.join(asked.select("id"), "id", "left_semi")
    places = wanted.select("chain", "block").distinct()
    heads = labels.where("pos = 0").join(wanted.select("chain").distinct(), "chain", "left_semi")
    way = heads.select(F.col("chain").alias("own"), F.posexplode("segments").alias("nth", "seg"))
    way = way.select("own", "nth", F.col("seg.chain").alias("chain"), F.col("seg.upto").alias("upto"))
    way = way.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("upto") / PATH_BLOCK))))
    length = F.least(F.lit(PATH_BLOCK).cast("long"), F.col("upto") - F.col("block") * PATH_BLOCK + 1).cast("int")
    above = (
        way.join(members, ["chain", "block"])
        .select(F.col("own").alias("chain"), "nth", "block", F.slice("members", F.lit(1), length).alias("part"))
        .groupBy("chain")
        .agg(F.flatten(listed(["nth", "block", "part"])).alias("above"))
    )
    earlier = places.where("block > 0").select("chain", F.col("block").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("block"))
    before = earlier.join(members, ["chain", "block"]).groupBy("chain", F.col("at").alias("block")).agg(F.flatten(listed(["block", "members"])).alias("before"))
    none = F.array().cast("array<string>")
    stretch = places.join(members, ["chain", "block"]).join(before, ["chain", "block"], "left").join(above, "chain", "left")
    stretch = stretch.select("chain", "block", "members", F.concat(F.coalesce("above", none), F.coalesce("before", none)).alias("start"))
    path = F.concat("start", F.slice("members", F.lit(1), (F.col("pos") - F.col("block") * PATH_BLOCK + 1).cast("int")))
    return wanted.join(stretch, ["chain", "block"]).select("doc_id", "root_id", "depth", path.alias("path"), (F.col("size") - 1).alias("n_descendants"))


def descendants(nodes: DataFrame, labels: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``(ancestor_id, descendant_id, distance)``, with ``asked(id)`` only for those ancestors.

    A document's interval is cut at multiples of ``RANGE_BLOCK`` and meets the
    documents of its root that lie in the same blocks, of which there are at most
    that many per key; nearly all pairs met are results.  Below a circle the
    ancestors start with the circle's cut document.
    """
    named = _named(nodes, labels)
    below = named.select("root", F.floor(F.col("first") / RANGE_BLOCK).alias("block"), F.col("first").alias("at"), F.col("level").alias("deep"), F.col("doc_id").alias("descendant_id"))
    wanted = named.where("last > first") if asked is None else named.where("last > first").join(asked.select("id"), "id", "left_semi")
    spread = F.sequence(F.floor((F.col("first") + 1) / RANGE_BLOCK), F.floor(F.col("last") / RANGE_BLOCK))
    above = wanted.select("root", F.explode(spread).alias("block"), "first", "last", "level", F.col("doc_id").alias("ancestor_id"))
    met = above.join(below, ["root", "block"]).where("at > first and at <= last")
    return met.select("ancestor_id", "descendant_id", (F.col("deep") - F.col("level")).cast("int").alias("distance"))


def circles(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(circle_id, doc_id, step)``: the members of each circle, ``step`` 0 being its smallest id.

    A circle is the way down from its cut document to the document which that one
    names as its parent: the documents of that root whose interval holds it.
    """
    cut = labels.where("circle = id").select(F.col("id").alias("child"))
    above = edges.groupBy("child").agg(F.min("parent").alias("id"))
    end = cut.join(above, "child").join(labels.select("id", F.col("first").alias("at")), "id").select(F.col("child").alias("root"), "at")
    ring = labels.join(end, "root").where("first <= at and at <= last").select("id", "root_id", "level")
    return _named(nodes, ring).select(F.col("root_id").alias("circle_id"), "doc_id", F.col("level").cast("int").alias("step"))
