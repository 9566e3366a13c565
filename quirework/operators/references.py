"""Typed edges between documents: creation, algebra, classification, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.hierarchy import uuid_key

# Categories of the edge types, and the type of an edge read backwards.
CATEGORIES = {
    "citation": "direct",
    "link": "direct",
    "continuation": "direct",
    "related": "indirect",
    "similar": "indirect",
    "context": "indirect",
    "parent": "structural",
    "child": "structural",
    "next": "structural",
    "previous": "structural",
    "toc": "structural",
}
REVERSE = {"parent": "child", "child": "parent", "next": "previous", "previous": "next"}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lineage_edges(snapshots: DataFrame) -> DataFrame:
    """``(parent, child, told_by)``: each link as told by its child, its parent, or both.

    Ids are brought to one spelling; fillers are no links.  Repeated tellings
    count once.
    """
    rows = snapshots.select(uuid_key(F.col("doc_id")).alias("doc"), "derived_from", "parents", "children")
    none = F.array().cast("array<string>")
    up = rows.select(F.col("doc").alias("child"), F.explode(F.concat(F.coalesce("parents", none), F.array("derived_from"))).alias("p"))
    up = up.select(uuid_key(F.col("p")).alias("parent"), "child", F.lit("child").alias("told"))
    down = rows.select(F.col("doc").alias("parent"), F.explode(F.coalesce("children", none)).alias("c"))
    down = down.select("parent", uuid_key(F.col("c")).alias("child"), F.lit("parent").alias("told"))
    told = up.unionByName(down).where("parent is not null and child is not null")
    both = told.groupBy("parent", "child").agg(F.min("told").alias("lo"), F.max("told").alias("hi"))
    return both.select("parent", "child", F.when(F.col("lo") != F.col("hi"), "both").otherwise(F.col("lo")).alias("told_by"))


def integrity(edges: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """``(parent, child, problem)``: ends without a record, self links, links told by one end."""
    known = documents.select(uuid_key(F.col(key)).alias("id")).where("id is not null").distinct()
    have_p = known.select(F.col("id").alias("parent"), F.lit(True).alias("has_parent"))
    have_c = known.select(F.col("id").alias("child"), F.lit(True).alias("has_child"))
    marked = edges.join(have_p, "parent", "left").join(have_c, "child", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("has_parent").isNull(), "parent_missing"),
            F.when(F.col("has_child").isNull(), "child_missing"),
            F.when(F.col("parent") == F.col("child"), "self_link"),
            F.when(F.col("told_by") != "both", "one_sided"),
        )
    )
    return marked.select("parent", "child", F.explode(problems).alias("problem"))


def sequential(df: DataFrame, group: str, order: str) -> DataFrame:
    """``(group, src, dst, ref_type)``: each row of a group to the next and back, in the order of distinct ``order``."""
    w = Window.partitionBy(group).orderBy(order)
    pairs = df.select(group, order).distinct().withColumn("nxt", F.lead(order).over(w)).where("nxt is not null")
    ahead = pairs.select(group, F.col(order).alias("src"), F.col("nxt").alias("dst"), F.lit("next").alias("ref_type"))
    back = pairs.select(group, F.col("nxt").alias("src"), F.col(order).alias("dst"), F.lit("previous").alias("ref_type"))
    return ahead.unionByName(back)


def topic_links(df: DataFrame, key: str, topic: str) -> DataFrame:
    """``(topic, src, dst, size)``: each member of a topic to the topic's smallest member.

    The pairs of a topic are those of its members; they are not written out.
    """
    head = df.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.min(key).alias("dst"), F.count("*").alias("size"))
    return df.join(head, topic).where(F.col(key) != F.col("dst")).select(topic, F.col(key).alias("src"), "dst", "size")


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst, ref_type)`` and their reverses, each once."""
    kind = F.coalesce(F.try_element_at(_literal_map(REVERSE), F.col("ref_type")), F.col("ref_type"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), kind.alias("ref_type"))
    return edges.select("src", "dst", "ref_type").union(back).distinct()


def missing_reverse(edges: DataFrame) -> DataFrame:
    """Edges whose reverse, of the reversed type, is not among them."""
    kind = F.coalesce(F.try_element_at(_literal_map(REVERSE), F.col("ref_type")), F.col("ref_type"))
    wanted = edges.select("src", "dst", "ref_type", kind.alias("back"))
    have = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ref_type").alias("back"))
    return wanted.join(have, ["src", "dst", "back"], "left_anti").select("src", "dst", "ref_type")


def classified(edges: DataFrame) -> DataFrame:
    """``edges`` with ``category`` and ``confidence``.

    Half a point to begin with, .3 for a citation and .1 more for a quotation,
    .25 for a structural edge, and up to .2 for similarity; at most 1.  Columns
    ``quoted`` and ``similarity`` are used where they exist.
    """
    quoted = F.coalesce(F.col("quoted"), F.lit(False)) if "quoted" in edges.columns else F.lit(False)
    similar = F.col("similarity") if "similarity" in edges.columns else F.lit(None).cast("double")
    category = F.try_element_at(_literal_map(CATEGORIES), F.col("ref_type"))
    score = (
        F.lit(0.5)
        + F.when(F.col("ref_type") == "citation", F.lit(0.3) + F.when(quoted, 0.1).otherwise(0.0)).otherwise(0.0)
        + F.when(category == "structural", 0.25).otherwise(0.0)
        + F.when(similar.isNotNull(), F.least(F.lit(0.2), similar * 0.25)).otherwise(0.0)
    )
    return edges.withColumn("category", category).withColumn("confidence", F.least(F.lit(1.0), score))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, outgoing, incoming)`` of distinct edges ``(src, dst)``."""
    once = edges.select("src", "dst").distinct()
    ends = once.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(once.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
