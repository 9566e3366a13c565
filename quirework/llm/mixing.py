"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the training time ``t`` from 0 to 1 whose
integral is its target share: ``w(t) = share * (1 + tilt * (2t - 1))``.  Tilts
may be given, a row per mix and source; without, the tilt grows with the
source's mean document size, so that short documents come early, long ones late.
Tilts are centred and scaled so that the weights of a mix sum to one and none is
negative at any time.  The
integral times the total size is the source's cumulative token demand.  A
source's documents stand in a hashed order, again for each repetition, and the
middle of a document's tokens in that stream, put into the inverse of the demand,
gives its position ``t``.  Sorting by position (a range sort) interleaves the
sources so that every stretch of the training holds them in their scheduled
weights.

The total size of a mix is the wanted one, or less where a source with its cap
of repetitions cannot fill its share: shares are kept, the total gives way.

Edge cases.  A given tilt that is missing or null counts as 0.  Sources are compared without case and outer blanks.  Targets whose
source has no tokens, or whose share is null or not positive, take no part, and
the shares of the others are scaled to sum to one.  Targets named twice in a mix
are added, with the smaller cap.  A null cap is none; a cap of 1.5 lets a source
supply its tokens one and a half times.  Texts of size 0 are not chosen.  Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import Scratch, running_total

TILT = 0.5


def _key(source):
    return F.lower(F.btrim(source, F.lit(" \t\r\n ")))


def plan(sized: DataFrame, targets: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """A row per target: ``mix_name, source, target_share, share, available, cap, wanted, total, demand, tilt``.

    ``sized`` has ``source`` and ``tokens``, ``schedule`` has ``mix_name``, ``source`` and
    ``tilt``.  Targets that take no part have share 0.
    """
    have = sized.groupBy(_key("source").alias("source")).agg(F.sum("tokens").alias("available"), F.avg("tokens").alias("mean"))
    corpus = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", _key("source").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("cap"), F.max("corpus_fraction").alias("fraction")
    )
    mix = Window.partitionBy("mix_name")
    # the targets of a mix are a handful of rows, the windows run over those alone
    rows = wanted.join(have, "source", "left").crossJoin(F.broadcast(corpus))
    usable = (F.col("target_share") > 0) & (F.coalesce("available", F.lit(0)) > 0) & (F.coalesce("cap", F.lit(1.0)) > 0)
    rows = rows.withColumn("part", F.when(F.coalesce(usable, F.lit(False)), F.col("target_share")).otherwise(0.0))
    rows = rows.withColumn("share", F.coalesce(F.try_divide("part", F.sum("part").over(mix)), F.lit(0.0)))
    wished = F.max("fraction").over(mix) * F.col("corpus")
    limit = F.min(F.when(F.col("share") > 0, F.col("cap") * F.col("available") / F.col("share"))).over(mix)
    rows = rows.withColumn("wanted", wished).withColumn("total", F.least(F.col("wanted"), limit))
    if schedule is None:
        low, high = F.min(F.when(F.col("share") > 0, F.col("mean"))).over(mix), F.max(F.when(F.col("share") > 0, F.col("mean"))).over(mix)
        rows = rows.withColumn("given", F.lit(TILT) * F.coalesce(F.try_divide(F.col("mean") - low, high - low), F.lit(0.0)))
    else:
        asked = schedule.groupBy("mix_name", _key("source").alias("source")).agg(F.max("tilt").cast("double").alias("given"))
        rows = rows.join(asked, ["mix_name", "source"], "left").withColumn("given", F.coalesce("given", F.lit(0.0)))
    rows = rows.withColumn("centred", F.col("given") - F.sum(F.col("share") * F.col("given")).over(mix))
    steepest = F.max(F.when(F.col("share") > 0, F.abs("centred"))).over(mix)
    return rows.withColumn("tilt", F.col("centred") / F.greatest(F.lit(1.0), steepest)).select(
        "mix_name",
        "source",
        "target_share",
        "share",
        F.coalesce("available", F.lit(0)).alias("available"),
        "cap",
        F.coalesce("wanted", F.lit(0.0)).alias("wanted"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        (F.col("share") * F.coalesce("total", F.lit(0.0))).alias("demand"),
        "tilt",
    )


def mix(sized: DataFrame, targets: DataFrame, scratch: Scratch, schedule: DataFrame | None = None) -> DataFrame:
    """``(mix_name, position, source, doc_id, repetition, tokens, t)`` for ``sized(doc_id, source, tokens)``."""
    rows = sized.where("tokens > 0").withColumn("source", _key("source"))
    goal = scratch.save(plan(rows, targets, schedule).where("demand > 0"))
    wanted = goal.select("source").distinct()
    # as many rows as the target table has
    used = rows.join(F.broadcast(wanted), "source").select("doc_id", "source", "tokens", F.xxhash64("doc_id").alias("lot"))
    stream = scratch.save(running_total(used, ["source", "lot", "doc_id"], F.col("tokens"), "before", scratch))
    first = stream.groupBy("source").agg(F.min("before").alias("first"))
    stream = stream.join(F.broadcast(first), "source").withColumn("start", F.col("before") - F.col("first")).drop("before", "first")
    ask = F.broadcast(goal.select("mix_name", "source", "available", "demand", "tilt", "share"))
    rounds = F.ceil(F.col("demand") / F.col("available")).cast("int")
    copies = stream.join(ask, "source").withColumn("repetition", F.explode(F.sequence(F.lit(0), rounds - 1)))
    copies = copies.withColumn("middle", F.col("repetition") * F.col("available") + F.col("start") + F.col("tokens") / 2)
    end = F.col("middle") + F.col("tokens") / 2
    # the last document may pass the demand by less than half its size, but a cap is never passed
    capped = goal.select(F.col("mix_name"), "source", (F.col("cap") * F.col("available")).alias("most"))
    copies = copies.join(F.broadcast(capped), ["mix_name", "source"]).where((F.col("middle") < F.col("demand")) & (F.col("most").isNull() | (end <= F.col("most") + 0.5)))
    # demand * (t + tilt * (t^2 - t)) = middle, solved for t
    share, a = F.col("middle") / F.col("demand"), F.col("tilt")
    root = 2 * share / ((1 - a) + F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * share, F.lit(0.0))))
    placed = copies.withColumn("t", root).select("mix_name", "t", "source", "doc_id", "repetition", "tokens")
    ordered = scratch.save(running_total(placed, ["mix_name", "t", "source", "doc_id", "repetition"], F.lit(1), "nth", scratch))
    base = ordered.groupBy("mix_name").agg(F.min("nth").alias("base"))
    return ordered.join(F.broadcast(base), "mix_name").select(
        "mix_name", (F.col("nth") - F.col("base")).alias("position"), "source", "doc_id", "repetition", "tokens", F.round("t", 9).alias("t")
    )


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: wanted and actual tokens and shares, and the repetitions used."""
    goal = plan(sized.where("tokens > 0"), targets)
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), (F.max("repetition") + 1).alias("most_repeats")
    )
    mix_ = Window.partitionBy("mix_name")
    out = goal.join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return out.withColumn("actual_share", F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(mix_)), F.lit(0.0)), 6)).select(
        "mix_name",
        "source",
        "target_share",
        F.round("share", 6).alias("scaled_share"),
        "actual_share",
        F.round("wanted", 0).cast("long").alias("wanted_total"),
        F.sum("tokens").over(mix_).alias("actual_total"),
        "tokens",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "cap",
        F.round(F.coalesce(F.try_divide("tokens", "available"), F.lit(0.0)), 6).alias("mean_repeats"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
