"""Filling containers of fixed capacity: shortest-pack-first over the length histogram.

Only the histogram of lengths is packed, not the items: lengths are placed
longest first, each length's whole count at a time into the open pattern with
the most room that still takes it (the shortest pack), which splits that
pattern's count where they differ.  The work depends on the capacity, not on the
number of items.  Items then find their container by rank: all items are numbered
in the order of their lengths, each pattern place takes a run of these numbers,
and both meet in blocks of ``RANK_BLOCK`` numbers, so neither a frequent length nor
a place that takes many items gathers in one task.

An item longer than the capacity is cut into full containers and a rest; the
rest is packed like any other item.  Between two items of a container lie
``separator`` tokens.

Edge cases.  Items of size 0 (null or empty texts) take no container.  Repeated
texts are separate items.  A capacity below 1 or null is no profile; a negative
or null separator counts as 0.  Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import Scratch, running_total

RANK_BLOCK = 512  # numbers of items that share a key


def patterns(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, count)`` of packs whose lengths sum to at most ``room``."""
    # open patterns by their room, and the rooms as a heap with the largest first
    open_, largest, done = defaultdict(list), [], []

    def put(lengths: tuple[int, ...], count: int, left: int, least: int) -> None:
        if left < least:
            done.append((lengths, count))
            return
        if not open_[left]:
            heapq.heappush(largest, -left)
        open_[left].append((lengths, count))

    order = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    least = order[-1] if order else 0
    for length in order:
        rest = histogram[length]
        moved = []  # packs changed by this length wait until it is placed or no other takes it
        while rest:
            while largest and not open_[-largest[0]]:
                heapq.heappop(largest)
            left = -largest[0] if largest else -1
            if left < length:
                if not moved:
                    each = room // length  # a new pack is the shortest until it takes no more
                    if rest >= each:
                        put((length,) * each, rest // each, room - each * length, least)
                    if rest % each:
                        put((length,) * (rest % each), 1, room - rest % each * length, least)
                    break
                for pack in moved:
                    put(*pack, least)
                moved = []
                continue
            lengths, count = open_[left].pop()
            taken = min(count, rest)
            if count > taken:
                open_[left].append((lengths, count - taken))
            moved.append(((*lengths, length), taken, left - length))
            rest -= taken
        for pack in moved:
            put(*pack, least)
    for packs in open_.values():
        done.extend(packs)
    return sorted(done, key=lambda p: (-len(p[0]), p[0], p[1]))


def places(histogram: dict[int, int], capacity: int, separator: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows ``(length, low, high, each, base, offset, step)``: which ranks of a length go where.

    Rank ``r`` of ``low`` to before ``high`` lies in container
    ``base + (r - low) // each`` at ``offset + (r - low) % each * step``.  There are
    at most two patterns per length, so the rows are bounded by the capacity.
    """
    # a pack of k items needs k - 1 separators: give each item one and the container one more
    packed = patterns({n + separator: c for n, c in histogram.items()}, capacity + separator)
    rows, used, container = [], defaultdict(int), 0
    for lengths, count in packed:
        offset = 0
        for padded, run in groupby(lengths):
            each, length = len(list(run)), padded - separator
            rows.append((length, used[length], used[length] + count * each, each, container, offset, padded))
            used[length] += count * each
            offset += padded * each
        container += count
    return rows


def pack(items: DataFrame, profiles: DataFrame, scratch: Scratch) -> DataFrame:
    """``(profile, doc_id, piece, container, start_token, tokens, offset)`` for ``items(doc_id, tokens)``.

    ``container`` is ``c<n>`` for packed containers and ``s<doc_id>-<piece>`` for
    the full ones of a cut item; ``start_token`` counts in the item, ``offset`` in
    the container.
    """
    rules = profiles.where("profile is not null and capacity_tokens >= 1").groupBy("profile").agg(
        F.max("capacity_tokens").cast("long").alias("capacity"), F.greatest(F.coalesce(F.max("separator_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("separator")
    )
    whole = items.where("tokens > 0").select("doc_id", F.col("tokens").cast("long").alias("tokens"))
    # ranks among the items of a length are the same for every profile that does not cut them
    ranked = scratch.save(running_total(whole, ["tokens", "doc_id"], F.lit(1), "nth", scratch))
    starts = scratch.save(ranked.groupBy("tokens").agg(F.min("nth").alias("first"), F.count("*").alias("n")))
    table = F.broadcast(rules)  # a row per profile
    fits = ranked.join(table, ranked["tokens"] <= rules["capacity"])
    long_ = whole.join(table, whole["tokens"] > rules["capacity"])
    rests = (
        long_.withColumn("piece", F.floor(F.col("tokens") / F.col("capacity")))
        .withColumn("start_token", F.col("piece") * F.col("capacity"))
        .withColumn("rest", F.col("tokens") - F.col("start_token"))
        .where("rest > 0")
        .select("profile", "doc_id", "piece", "start_token", "rest")
    )
    rested = scratch.save(running_total(rests, ["profile", "rest", "doc_id"], F.lit(1), "nth", scratch))
    rest_starts = scratch.save(rested.groupBy("profile", "rest").agg(F.min("nth").alias("first"), F.count("*").alias("n")))
    full = long_.select(
        "profile",
        "doc_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / F.col("capacity")) - 1)).alias("piece"),
        "capacity",
    ).select(
        "profile",
        "doc_id",
        "piece",
        F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"),
        (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.col("capacity").alias("tokens"),
        F.lit(0).cast("long").alias("offset"),
    )
    # the histogram of a profile has at most `capacity` rows
    lengths = starts.join(table, starts["tokens"] <= rules["capacity"]).select("profile", F.col("tokens").alias("length"), "n")
    lengths = lengths.union(rest_starts.select("profile", F.col("rest").alias("length"), "n")).groupBy("profile", "length").agg(F.sum("n").alias("n"))

    def plan(rows):
        import pandas as pd

        rows = rows.sort_values("length")
        made = places(dict(zip(rows["length"].tolist(), rows["n"].tolist())), int(rows["capacity"].iloc[0]), int(rows["separator"].iloc[0]))
        out = pd.DataFrame(made, columns=["length", "low", "high", "each", "base", "offset", "step"], dtype="int64")
        out.insert(0, "profile", rows["profile"].iloc[0])
        return out

    slots = scratch.save(
        lengths.join(table, "profile").groupBy("profile").applyInPandas(plan, "profile string, length long, low long, high long, each long, base long, offset long, step long")
    )
    # ranks in a length count its whole items first, then its rests; each part of a place gets the numbers of its items
    parts = slots.join(starts.select(F.col("tokens").alias("length"), F.col("first").alias("first_whole"), F.col("n").alias("whole")).hint("merge"), "length", "left")
    parts = parts.join(rest_starts.select("profile", F.col("rest").alias("length"), F.col("first").alias("first_rest")).hint("merge"), ["profile", "length"], "left")
    parts = scratch.save(parts.withColumn("whole", F.coalesce("whole", F.lit(0))))

    def met(rows: DataFrame, low, high, shift) -> DataFrame:
        """Rows of ``(profile, nth)`` with the place that takes them; a place's rank is ``nth`` less ``shift``."""
        runs = parts.select("profile", "low", "each", "base", "offset", "step", low.alias("from"), high.alias("to"), shift.alias("shift")).where("from < to")
        runs = runs.withColumn("from", F.col("from") + F.col("shift")).withColumn("to", F.col("to") + F.col("shift"))
        blocks = F.sequence(F.floor(F.col("from") / RANK_BLOCK), F.floor((F.col("to") - 1) / RANK_BLOCK))
        runs = runs.withColumn("block", F.explode(blocks))
        joined = rows.withColumn("block", F.floor(F.col("nth") / RANK_BLOCK)).join(runs.hint("merge"), ["profile", "block"])
        at = F.col("nth") - F.col("shift") - F.col("low")
        return joined.where("nth >= from and nth < to").select(
            "profile",
            "doc_id",
            "piece",
            F.concat(F.lit("c"), (F.col("base") + F.floor(at / F.col("each"))).cast("string")).alias("container"),
            "start_token",
            F.col("length").alias("tokens"),
            (F.col("offset") + at % F.col("each") * F.col("step")).alias("offset"),
        )

    none = F.lit(0).cast("long")
    head = fits.select("profile", "doc_id", none.alias("piece"), none.alias("start_token"), F.col("tokens").alias("length"), "nth")
    tail = rested.select("profile", "doc_id", "piece", "start_token", F.col("rest").alias("length"), "nth")
    placed = met(head, F.col("low"), F.least("high", "whole"), F.col("first_whole")).unionByName(
        met(tail, F.greatest("low", "whole"), F.col("high"), F.col("first_rest") - F.col("whole"))
    )
    return placed.unionByName(full)


def report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(profile, containers, items, cut_items, tokens, used_share)``."""
    rules = profiles.groupBy("profile").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    # the first item of a container stands for it
    return (
        packed.groupBy("profile")
        .agg(
            F.count_if(F.col("offset") == 0).alias("containers"),
            F.count_if(F.col("piece") == 0).alias("items"),
            F.count_if((F.col("piece") == 0) & F.col("container").startswith("s")).alias("cut_items"),
            F.sum("tokens").alias("tokens"),
        )
        .join(rules, "profile")
        .select("profile", "containers", "items", "cut_items", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used_share"))
    )
