"""Processing steps: status, metrics, health, reliability, history.

Steps are facts ``(doc_id, seq, step_name, status, ts, source, duration_ms)``.
Exact repetitions of a row count once (``facts``).  The latest step of a document
is that of the greatest ``seq``; of equal ones the greatest time, then name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import Scratch, running_total, small

DONE = ("success", "completed")
BAD = ("failed", "error")
ACTIVE = ("in_progress", "running")
# Shares of failed documents from which health is critical or a warning.
CRITICAL_SHARE, WARNING_SHARE = 0.1, 0.05
COOLDOWN = 300
LONGEST_SPAN = 1 << 20  # seconds whose alerts one task takes in order


def facts(steps: DataFrame) -> DataFrame:
    """Each step once: a row that arrives again is the same fact."""
    return steps.select("doc_id", "seq", "step_name", "status", "ts", "source", "duration_ms").distinct()


def _micros() -> Column:
    return F.unix_micros("ts")


def latest(steps: DataFrame) -> DataFrame:
    """``(doc_id, status, step_name, ts_micros, first_micros, steps)``."""
    order = F.struct("seq", _micros().alias("us"), "step_name", "status")
    return facts(steps).where("doc_id is not null").groupBy("doc_id").agg(
        F.max(order).alias("m"), F.min(_micros()).alias("first_micros"), F.count("*").alias("steps"), F.max(_micros()).alias("last_micros")
    ).select("doc_id", "m.status", "m.step_name", F.col("m.us").alias("ts_micros"), "first_micros", "last_micros", "steps")


def status_counts(steps: DataFrame) -> DataFrame:
    """Documents by the status of their latest step."""
    return latest(steps).groupBy("status").agg(F.count("*").alias("documents"))


def pipeline_metrics(steps: DataFrame, group: str) -> DataFrame:
    """Per group: documents by outcome, steps, errors, warnings, durations and rates in percent."""
    last = latest(steps).select("doc_id", F.col("status").alias("last_status"))
    rows = facts(steps).join(last, "doc_id")
    per_doc = rows.groupBy(group, "doc_id").agg(
        F.max("last_status").alias("last_status"),
        F.count("*").alias("steps"),
        F.count_if(F.col("status").isin(*BAD)).alias("errors"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.sum("duration_ms").alias("ms"),
        F.count("duration_ms").alias("timed"),
        F.max("duration_ms").alias("slowest"),
        F.min(_micros()).alias("lo"),
        F.max(_micros()).alias("hi"),
    )
    out = per_doc.groupBy(group).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("last_status").isin(*DONE)).alias("completed"),
        F.count_if(F.col("last_status").isin(*BAD)).alias("failed"),
        F.count_if(F.col("last_status").isin(*ACTIVE)).alias("active"),
        F.sum("steps").alias("steps"),
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"),
        F.sum("ms").alias("ms"),
        F.sum("timed").alias("timed"),
        F.max("slowest").alias("slowest_ms"),
        F.min("lo").alias("first_micros"),
        F.max("hi").alias("last_micros"),
    )
    ended = F.greatest(F.col("completed") + F.col("failed"), F.lit(1))
    return out.select(
        group,
        "documents",
        "completed",
        "failed",
        "active",
        "steps",
        "errors",
        "warnings",
        F.round(F.try_divide("ms", "timed"), 6).alias("avg_ms"),
        "slowest_ms",
        F.round(100 * F.col("failed") / ended, 2).alias("error_rate"),
        F.round(100 * F.col("completed") / ended, 2).alias("success_rate"),
        "first_micros",
        "last_micros",
    )


def spans(steps: DataFrame) -> DataFrame:
    """``(doc_id, steps, seconds)`` from the first to the last step of documents with more than one."""
    return latest(steps).where("steps > 1").select("doc_id", "steps", F.round((F.col("last_micros") - F.col("first_micros")) / 1e6, 3).alias("seconds"))


def health(steps: DataFrame, group: str) -> DataFrame:
    """``(group, documents, failed, failed_share, status, severity)`` by the share of failed documents."""
    m = pipeline_metrics(steps, group).withColumn("failed_share", F.col("failed") / F.col("documents"))
    severity = F.when(F.col("failed_share") >= CRITICAL_SHARE, 2).when((F.col("failed_share") >= WARNING_SHARE) | (F.col("errors") > 0), 1).otherwise(0)
    m = m.withColumn("severity", severity)
    name = F.element_at(F.array(F.lit("healthy"), F.lit("warning"), F.lit("critical")), F.col("severity") + 1)
    return m.select(group, "documents", "failed", F.round("failed_share", 6).alias("failed_share"), name.alias("status"), "severity")


def performance(df: DataFrame, group: str, value: str, scratch: Scratch) -> DataFrame:
    """Count, least, greatest, mean, population deviation and interpolated percentiles per group.

    Percentiles are exact: equal values are counted first, a running total over
    the sorted values gives their ranks, and each percentile lies between the
    values of two ranks.  So no task holds the values of a group, whatever their
    number.  Null values do not count, null groups are a group.
    """
    given = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = scratch.save(given.groupBy(group, value).agg(F.count("*").alias("__n")))
    x, n = F.col(value).cast("double"), F.col("__n")
    total = counts.groupBy(F.col(group).alias("__g")).agg(F.sum("__n").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.sum(x * n) / F.sum("__n")).alias("mean"))
    ranked = scratch.save(running_total(counts, [group, value], n, "__rank", scratch))
    start = ranked.groupBy(F.col(group).alias("__s")).agg(F.min("__rank").alias("__start"))
    total = scratch.save(total.join(start, F.col("__g").eqNullSafe(F.col("__s"))).drop("__s"))
    rows = ranked.join(small(total), F.col(group).eqNullSafe(F.col("__g")))
    first = F.col("__rank") - F.col("__start")
    at = lambda rank: F.max(F.when((first <= rank) & (rank < first + n), x))

    def percentile(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(q)
        below, above = at(F.floor(place)), at(F.ceil(place))
        return below + (above - below) * (F.max(place) - F.floor(F.max(place)))

    out = rows.groupBy("__g").agg(
        *[F.max(c).alias(c) for c in ("n", "lo", "hi", "mean")],
        F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * n) / F.max("n")).alias("deviation"),
        *[percentile(q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)],
    )
    return out.select(F.col("__g").alias(group), "n", *[F.round(c, 4).alias(c) for c in ("lo", "hi", "mean", "deviation", "p50", "p95", "p99")])


def recent_status(steps: DataFrame, seconds: int) -> DataFrame:
    """One row: documents, steps, failed and active ones, of all times and (``recent_``) of the last ``seconds`` before the last step.

    Steps without a time are left out.  Documents are counted from one row per document.
    """
    rows = facts(steps.where("ts is not null")).withColumn("us", _micros())
    end = steps.agg(F.max(_micros()).alias("end"))
    late = F.col("us") >= F.col("end") - seconds * 1000000
    bad, active = F.col("status").isin(*BAD), F.col("status").isin(*ACTIVE)
    kinds = {"steps": F.lit(True), "failed": bad, "active": active}
    per = rows.crossJoin(F.broadcast(end)).groupBy("doc_id").agg(  # one row
        *[F.count_if(c).alias(n) for n, c in kinds.items()], *[F.count_if(c & late).alias(f"recent_{n}") for n, c in kinds.items()]
    )
    known = F.col("doc_id").isNotNull()
    sums = [F.coalesce(F.sum(p + n), F.lit(0)).alias(p + n) for p in ("", "recent_") for n in kinds]
    return per.agg(F.count_if(known).alias("documents"), F.count_if(known & (F.col("recent_steps") > 0)).alias("recent_documents"), *sums)


def progress(df: DataFrame, group: str, batch: str, us: str) -> DataFrame:
    """Per group: batches, items, failed ones, percent done, microseconds of a batch (mean rounded down) and items a second of timed batches.

    ``us`` is a whole number; a batch without any is not timed.
    """
    per = df.groupBy(group, batch).agg(F.count("*").alias("items"), F.count_if(F.col("status").isin(*BAD)).alias("failed"), F.sum(us).alias("us"))
    timed = F.sum(F.when(F.col("us").isNotNull(), F.col("items")))
    out = per.groupBy(group).agg(
        F.count("*").alias("batches"), F.sum("items").alias("items"), F.sum("failed").alias("failed"), F.min("us").alias("fastest_us"),
        F.max("us").alias("slowest_us"), F.sum("us").alias("us"), F.count("us").alias("timed"), timed.alias("timed_items"),
    )
    return out.select(
        group,
        "batches",
        "items",
        "failed",
        F.round(100 * (F.col("items") - F.col("failed")) / F.col("items"), 2).alias("percent_done"),
        "fastest_us",
        "slowest_us",
        F.floor(F.try_divide("us", "timed")).alias("mean_us"),
        F.round(F.try_divide(F.col("timed_items") * 1000000.0, "us"), 6).alias("items_per_second"),
    )


def error_summary(steps: DataFrame) -> DataFrame:
    """``(step_name, report)``: failures of a kind of step and of its states, as text."""
    kinds = facts(steps).where(F.col("status").isin(*BAD) & F.col("step_name").isNotNull()).groupBy("step_name", "status").agg(F.count("*").alias("n"))
    part = F.concat_ws(" ", "status", F.col("n").cast("string"))
    parts = F.array_join(F.sort_array(F.collect_list(part)), ", ")  # as many as there are states
    return kinds.groupBy("step_name").agg(F.format_string("%s: %d (%s)", F.col("step_name"), F.sum("n"), parts).alias("report"))


def operation_times(df: DataFrame, group: str, value: str) -> DataFrame:
    """Running totals of an operation: count, total, mean, least and greatest.  Null times count as calls only."""
    return df.groupBy(group).agg(
        F.count("*").alias("calls"),
        F.round(F.sum(value), 4).alias("total"),
        F.round(F.avg(value), 4).alias("mean"),
        F.max(value).alias("slowest"),
        F.min(value).alias("fastest"),
    )


def frequent_errors(steps: DataFrame, limit: int) -> DataFrame:
    """The most frequent kinds of failing step: ``(step_name, status, n)``."""
    kinds = facts(steps).where(F.col("status").isin(*BAD)).groupBy("step_name", "status").agg(F.count("*").alias("n"))
    return kinds.orderBy(F.col("n").desc(), "step_name", "status").limit(limit)


def recent_errors(steps: DataFrame, since_micros: int) -> DataFrame:
    rows = facts(steps).where(F.col("status").isin(*BAD)).withColumn("ts_micros", _micros())
    return rows.where(F.col("ts_micros") >= since_micros).select("doc_id", "seq", "step_name", "status", "ts_micros")


def retry_delays(steps: DataFrame, delay: float = 1.0, most: float = 60.0) -> DataFrame:
    """``(doc_id, attempt, linear, exponential, fibonacci)``: the delay after each failed step of a document.

    The n-th failure waits ``delay``, ``delay * 2^n`` or ``delay * F(n + 1)``, never above ``most``.
    """
    w = Window.partitionBy("doc_id").orderBy("seq", _micros(), "step_name", "status")
    tries = facts(steps).where(F.col("status").isin(*BAD)).withColumn("attempt", F.row_number().over(w))
    root5 = 5.0**0.5
    nth = F.least(F.col("attempt"), F.lit(60))  # beyond that every delay is at its most
    fib = F.round((F.pow(F.lit((1 + root5) / 2), nth + 1)) / root5)
    cap = lambda c: F.least(F.lit(most), c)
    return tries.select(
        "doc_id", "attempt", F.lit(min(delay, most)).alias("linear"), cap(delay * F.pow(F.lit(2.0), nth)).alias("exponential"), cap(delay * fib).alias("fibonacci")
    )


def error_trend(steps: DataFrame, periods: int, seconds: int) -> DataFrame:
    """``(step_name, period, n)``: failures in periods counted back from the last step; empty periods are 0."""
    bad = facts(steps).where(F.col("status").isin(*BAD)).withColumn("us", _micros())
    end = facts(steps).agg(F.max(_micros()).alias("end"))
    back = F.floor((F.col("end") - F.col("us")) / (seconds * 1000000))
    counted = bad.crossJoin(F.broadcast(end)).withColumn("period", back.cast("int")).where(F.col("period") < periods)
    counted = counted.groupBy("step_name", "period").agg(F.count("*").alias("n"))
    grid = bad.select("step_name").distinct().withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    return grid.join(counted, ["step_name", "period"], "left").select("step_name", "period", F.coalesce("n", F.lit(0)).alias("n"))


def reliability(documents: DataFrame, steps: DataFrame, source: str, required: list[str]) -> DataFrame:
    """``(source, completeness, quality, authority, frequency, score)``.

    Completeness is the mean share of required fields that are filled; quality
    and authority stand for the share of documents and of steps that ended well;
    frequency is updates over seconds since the last one, at most one.  The score
    weighs them .2, .3, .3 and .2.
    """
    filled = sum((F.when(F.coalesce(F.btrim(F.col(f).cast("string")), F.lit("")) != "", 1.0).otherwise(0.0) for f in required[1:]),
                 F.when(F.coalesce(F.btrim(F.col(required[0]).cast("string")), F.lit("")) != "", 1.0).otherwise(0.0))
    complete = documents.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.avg(filled / len(required)).alias("completeness"))
    m = pipeline_metrics(steps, "source").where("source is not null")
    gap = F.greatest((F.col("last_micros") - F.col("first_micros")) / 1e6 / F.greatest(F.col("steps") - 1, F.lit(1)), F.lit(1.0))
    m = m.select(
        "source",
        (F.col("success_rate") / 100).alias("quality"),
        (1 - F.col("errors") / F.col("steps")).alias("authority"),
        F.least(F.lit(1.0), F.col("steps") / gap).alias("frequency"),
    )
    both = complete.join(m, "source")
    score = 0.3 * F.col("authority") + 0.3 * F.col("quality") + 0.2 * F.col("completeness") + 0.2 * F.least("frequency", F.lit(1.0))
    return both.select("source", *[F.round(c, 6).alias(c) for c in ("completeness", "quality", "authority", "frequency")], F.round(score, 5).alias("score"))


def carried(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` of the key up to and including each row and its equals in ``order``.

    ``bucket`` rises with the order.  Rows are sorted within (key, bucket) only,
    and what earlier buckets leave comes from one row per bucket, so the rows of
    a key that holds a third of the table spread over as many tasks as it has
    buckets.
    """
    rows = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(key, "__bucket").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    given = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = rows.groupBy(key, "__bucket").agg(F.max_by(value, given).alias("__end"))
    past = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "__bucket", F.last("__end", ignorenulls=True).over(past).alias("__before"))
    out_rows = rows.withColumn("__inside", F.last(value, ignorenulls=True).over(inside)).join(before, [key, "__bucket"])
    return out_rows.withColumn(out, F.coalesce("__inside", "__before")).drop("__bucket", "__inside", "__before")


def increase(samples: DataFrame, key: str, us: str, order: str, value: str, window: int = 300) -> DataFrame:
    """``(key, start_us, increase)``: how much a counter grows in each window of ``window`` seconds.

    A sample below the one before means that the counter began anew, so it counts
    whole; the first sample of a key counts nothing.  Equal times go by ``order``.
    Rows are sorted within (key, window) only; the last sample of the window
    before comes from one row per window.  Null keys, times and values are no samples.
    """
    size = window * 1000000
    rows = samples.where(F.col(key).isNotNull() & F.col(us).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(key, F.col(us).alias("__us"), F.col(order).alias("__order"), F.col(value).alias("__value")).withColumn("start_us", F.floor(F.col("__us") / size) * size)
    ends = rows.groupBy(key, "start_us").agg(F.max_by("__value", F.struct("__us", "__order")).alias("__end"))
    before = ends.select(key, "start_us", F.lag("__end").over(Window.partitionBy(key).orderBy("start_us")).alias("__before"))
    inside = F.lag("__value").over(Window.partitionBy(key, "start_us").orderBy("__us", "__order"))
    last = F.coalesce("__inside", "__before")
    grown = F.when(last.isNull(), 0.0).when(F.col("__value") >= last, F.col("__value") - last).otherwise(F.col("__value"))
    joined = rows.withColumn("__inside", inside).join(before, [key, "start_us"])
    return joined.groupBy(key, "start_us").agg(F.round(F.sum(grown), 4).alias("increase"))


def as_of(events: DataFrame, changes: DataFrame, key: str, ts: str, bucket: int = 30 * 86400 * 1000000) -> DataFrame:
    """Each event with the last change of its key at or before it: ``(key, event columns, change)``.

    Both are put into one ordered run per key and the last change is carried
    forward, so no event meets all changes of its key.  ``changes`` has ``key``,
    ``ts`` (a number) and ``change``; rows of a key are sorted per ``bucket`` of it.
    Null keys have no change.
    """
    cols = [c for c in events.columns if c not in (key, ts)]
    left = events.select(key, ts, *cols, F.lit(None).cast(changes.schema["change"].dataType).alias("change"), F.lit(1).alias("kind"))
    right = changes.select(key, ts, *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in cols], "change", F.lit(0).alias("kind"))
    both = left.unionByName(right).where(F.col(key).isNotNull())
    out = carried(both, key, F.floor(F.col(ts) / bucket), [ts, "kind", "change"], "change", "last")
    return out.where("kind = 1").select(key, ts, *cols, F.col("last").alias("change"))


def change_log(changes: DataFrame, key: str, start: int | None = None, end: int | None = None, tags: DataFrame | None = None) -> DataFrame:
    """``changes(key, us, change)`` from ``start`` to ``end``, both included; with ``tags(key, us)`` only those that a tag points to.

    A tag points to the last change at or before it.
    """
    out = changes
    if tags is not None:
        named = changes.withColumn("change", F.struct("us", "change"))
        out = as_of(tags, named, key, "us").where("change is not null").select(key, "change.us", "change.change").distinct()
    out = out if start is None else out.where(F.col("us") >= start)
    return out if end is None else out.where(F.col("us") <= end)


def cooled(alerts: DataFrame, key: str, seconds: str, order: str, cooldown: int = COOLDOWN) -> DataFrame:
    """Alerts that are sent: none within ``cooldown`` (above 0) seconds of the last sent one of the same key.

    Suppressed alerts do not extend the cooldown; of alerts of one second the
    least ``order`` is sent.  The distinct seconds of a key are cut into spans of
    several cooldowns, and each is a task's work of its own: the alert sent first
    in a span decides all others in it, and it lies within the first cooldown of
    the span or is the next one after it.  So a span is first reduced to the last
    sent alert for each of these; these few rows are chained along the spans of a
    key; then each span gives the alerts sent from its first one on.  Null keys
    and times are no alerts.
    """
    rows = alerts.where(F.col(key).isNotNull() & F.col(seconds).isNotNull())
    span = max(cooldown, min(64 * cooldown, LONGEST_SPAN))
    times = rows.select(F.col(key).alias("k"), F.floor(F.col(seconds) / span).alias("b"), F.col(seconds).alias("t")).distinct()
    kinds = {c: times.schema[c].dataType.simpleString() for c in ("k", "b", "t")}

    def ends(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("t")
        t = table.column("t").to_numpy()
        nxt = np.searchsorted(t, t + cooldown)
        end = np.where(nxt < len(t), nxt, np.arange(len(t)))
        while (end[end] != end).any():
            end = end[end]
        n = min(len(t), int(np.searchsorted(t, table.column("b")[0].as_py() * span + cooldown)) + 1)
        return table.slice(0, n).select(["k", "b", "t"]).append_column("end", pa.array(t[end[:n]]))

    def chain(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current = done = last = None
        for batch in batches:
            kept = []
            for i, (k, b, t, end) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("k", "b", "t", "end")])):
                if k != current:
                    current, done, last = k, None, None
                if b != done and (last is None or t - last >= cooldown):
                    done, last = b, end
                    kept.append(i)
            yield batch.select(["k", "b", "t"]).take(pa.array(kept, pa.int64()))

    def follow(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("t")
        t = table.column("t").to_numpy()
        sent, i = [], int(np.searchsorted(t, table.column("first")[0].as_py()))
        while i < len(t):
            sent.append(i)
            i = int(np.searchsorted(t, t[i] + cooldown))
        return table.select(["k", "t"]).take(pa.array(sent, pa.int64()))

    named = lambda *cs: ", ".join(f"{c} {kinds[c]}" for c in cs)
    spans = times.groupBy("k", "b").applyInArrow(ends, named("k", "b", "t") + f", end {kinds['t']}")
    firsts = spans.repartition("k").sortWithinPartitions("k", "b", "t").mapInArrow(chain, named("k", "b", "t"))
    within = times.join(firsts.withColumnRenamed("t", "first"), ["k", "b"]).groupBy("k", "b").applyInArrow(follow, named("k", "t"))
    sent = rows.join(within.select(F.col("k").alias(key), F.col("t").alias(seconds)), [key, seconds], "left_semi")
    nth = F.row_number().over(Window.partitionBy(key, seconds).orderBy(order))
    return sent.withColumn("__nth", nth).where(F.col("__nth") == 1).select(*[F.col(f"`{c}`") for c in alerts.columns])
