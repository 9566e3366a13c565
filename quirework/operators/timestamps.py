"""Timestamps in mixed notations and zones to one UTC instant.

``parse`` brings each notation to the same parts (year, month, ... zone) by one
regular expression, so a value passes one match and one rewrite and everything
after that is arithmetic on integers.  Where a value has more than one valid
reading, ``format_mixture`` estimates, per source, how often each format occurs:
expectation-maximisation over the counts of equal candidate sets, in which a
value gives each of its valid readings a share in proportion to the source's
current format weight.  ``normalise`` joins the winning format back.

Readings that compete: day or month first in ``a/b/yyyy``; a date run together
or a count since 1970 in digits only; the offsets of a zone abbreviation that
several regions use.  A source's setting decides the first kind
(``declared="binding"``, null meaning month first), or is only a prior of
``PRIOR_COUNT`` values (``declared="prior"``), so that the data may overrule it.
Where a source has no setting, day first has a prior of a fifth of that, so values
that show nothing stay ambiguous.
For abbreviations the mixture (``zone_mixture``) counts the offsets that a source
writes or implies elsewhere; the usual offset has a prior of ``PRIOR_COUNT``
values, and with ``declared="binding"`` it holds.

Edge cases.  Null, blank, filler and impossible values (day 31 of November,
hour 25, 13 PM, unknown zone names) come out with a null instant and status
``unreadable``; values whose best reading has a posterior under
``AMBIGUOUS_BELOW`` keep it and have status ``ambiguous``.  Blanks around a value
are ignored, runs of blanks inside count as one, and a value may be as long as
it likes.  Digits beyond microseconds are cut, two-digit years are 1970 to 2069,
a date alone is midnight, and a leap second is the next second; clocks run from
00:00 to 23:59, so 24:00 is unreadable.  A count may be negative and of any number of digits up to 19.  A
wall-clock time that occurs twice is the earlier instant (and ``ambiguous`` with
``declared="prior"``), one that is skipped is read with the offset before the
change.  A row without
source, or of a source without settings, is read as UTC, month first.  Rows may
repeat; an empty table gives an empty result.  The input's columns are kept;
those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.session import small

PRIOR_COUNT = 20.0
AMBIGUOUS_BELOW = 0.9
EM_ROUNDS = 25
ADDED = ("utc_micros", "status", "format", "posterior")

# Month names and their usual short forms in English, German and French.
MONTHS = {
    1: "january jan januar jänner janvier janv",
    2: "february feb februar février févr fév fevrier",
    3: "march mar märz mär mrz mars",
    4: "april apr avril avr",
    5: "may mai",
    6: "june jun juni juin",
    7: "july jul juli juillet juil",
    8: "august aug août aout",
    9: "september sep sept septembre",
    10: "october oct oktober okt octobre",
    11: "november nov novembre",
    12: "december dec dezember dez décembre déc decembre",
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540, "kst": 540, "npt": 345, "ist": 330,
    "sgt": 480, "hkt": 480, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}

# Abbreviations that several regions use, and their offsets in minutes, the usual one first.
SHARED = {"ist": (330, 120, 60), "cst": (-360, 480), "bst": (60, 360), "mst": (-420, 480)}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"\s*\[?(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}|(?:gmt|utc)[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+-]+){1,2})?\]?(?:\s*\([^)]*\))?"
_NAME = r"([a-zäöüéèêûôà]{3,10})\.?"
# (name, pattern over the lower-cased value, rewrite to y|mo|d|h|mi|s|fraction|am-pm|zone)
NOTATIONS = [
    ("ymd", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:\s*t|\s)\s*{_TIME}\s*([ap]m\b)?{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("abY", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:,?\s+{_TIME}\s*([ap]m\b)?{_ZONE})?$", "$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    ("run", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,12}}))?)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (
        "dMy",
        rf"^(?:[a-zä-ü]+\.?,?\s+)?(\d{{1,2}})(?:\.|st|nd|rd|th|er)?[\s-]+{_NAME}[\s,-]+(\d{{4}}|\d{{2}})"
        rf"(?:(?:,|\s|à|um|at){{1,6}}(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,12}}))?)?\s*(?:uhr)?\s*([ap]m\b)?{_ZONE})?$",
        "$3|$2|$1|$4|$5|$6|$7|$8|$9",
    ),
    ("Mdy", rf"^(?:[a-z]{{3,9}}\.?,?\s+)?{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:(?:,|\s|at){{1,6}}{_TIME}\s*([ap]m\b)?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
COUNT_END = 7258118400000000
COUNT = r"^-?\d{1,19}(\.\d{1,9})?$"


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date in the Gregorian calendar."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(shifted / 400)
    yoe = shifted - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _valid_date(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest), F.lit(False))


def zone_names(df: DataFrame) -> list[str]:
    """The zone names that the cluster's JVM knows."""
    return sorted(str(z) for z in df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def parse(df: DataFrame, value: str) -> DataFrame:
    """Adds ``_parts`` (the common parts), ``_formats`` (names of its valid readings) and ``_micros`` (of a count)."""
    text = F.lower(F.btrim(F.regexp_replace(F.col(value), r"[\s\u00a0]+", " ")))
    spelled = F.lit(None).cast("string")
    for name, pattern, rewrite in reversed(NOTATIONS):
        spelled = F.when(F.col("_text").rlike(pattern), F.concat(F.lit(f"{name}|"), F.regexp_replace("_text", pattern, rewrite))).otherwise(spelled)
    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for w in names.split() for x in (w, n)])
    df = df.withColumn("_text", text).withColumn("_split", F.split(spelled, r"\|"))
    part = lambda i: F.nullif(F.get("_split", F.lit(i)), F.lit(""))
    num = lambda i: part(i).try_cast("int")
    named = lambda i: F.coalesce(num(i), F.try_element_at(months, F.coalesce(part(i), F.lit(""))))
    year = F.when(F.length(part(1)) == 2, num(1) + F.when(num(1) < 70, 2000).otherwise(1900)).otherwise(num(1))
    hour = F.coalesce(num(4), F.lit(0))
    half = part(8)
    hour24 = F.when(half.isNull(), hour).when(hour.between(0, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(99)
    df = df.withColumn(
        "_parts",
        F.when(
            F.col("_split").isNotNull(),
            F.struct(
                part(0).alias("notation"),
                year.alias("y"),
                named(2).alias("a"),
                named(3).alias("b"),
                hour24.alias("h"),
                F.coalesce(num(5), F.lit(0)).alias("mi"),
                F.coalesce(num(6), F.lit(0)).alias("s"),
                F.rpad(F.substring(F.coalesce(part(7), F.lit("0")), 1, 6), 6, "0").cast("long").alias("us"),
                part(9).alias("zone"),
            ),
        ),
    )
    p = lambda n: F.col(f"_parts.{n}")
    clock = (p("h") <= 23) & (p("mi") <= 59) & ((p("s") <= 59) | ((p("s") == 60) & (p("mi") == 59)))
    clock = F.coalesce(clock, F.lit(False))
    month_first = p("notation").isin("ymd", "run")
    fits = clock & _valid_date(p("y"), p("a"), p("b"))
    turned = clock & _valid_date(p("y"), p("b"), p("a"))
    in_range = p("y").between(1900, 2199)
    counted = F.col("_text").rlike(COUNT)
    sign = F.when(F.col("_text").startswith("-"), -1).otherwise(1)
    whole = F.ltrim(F.substring_index("_text", ".", 1), F.lit("-"))
    digits = F.length(whole)
    scale = F.when(digits <= 11, 1000000).when(digits <= 14, 1000).when(digits <= 17, 1).otherwise(0).cast("long")
    rest = F.rpad(F.substring(F.concat(F.substring_index(F.concat("_text", F.lit(".")), ".", -2), F.lit("")), 1, 9), 9, "0")
    rest = F.when(F.instr("_text", ".") > 0, rest).otherwise("000000000")
    rest = F.regexp_replace(rest, r"\D", "0").cast("long")
    n = whole.try_cast("long")
    size = F.when(scale > 0, n * scale + F.floor(rest * scale / 1000000000)).otherwise(F.floor(n / 1000)).cast("long")
    micros = sign * size
    # the unit follows from the size, and a count that lands beyond the year 2199 has no likelihood
    # and eight digits that spell a date are one
    spelled_date = (p("notation") == "run") & (digits == 8) & fits & in_range
    counted = counted & (size < COUNT_END) & ~F.coalesce(spelled_date, F.lit(False))
    formats = F.array_compact(
        F.array(
            F.when(month_first & fits & (in_range | (p("notation") == "ymd")), p("notation")),
            F.when((p("notation") == "abY") & fits, F.lit("mdy")),
            F.when((p("notation") == "abY") & turned, F.lit("dmy")),
            F.when((p("notation") == "dMy") & fits, F.lit("dMy")),
            F.when((p("notation") == "Mdy") & fits, F.lit("Mdy")),
            F.when(F.coalesce(counted, F.lit(False)), F.lit("count")),
        )
    )
    return df.withColumn("_formats", F.when(F.col("_text").isNotNull(), formats).otherwise(F.array().cast("array<string>"))).withColumn(
        "_micros", F.when(counted, micros)
    )


def _em(counts: dict[str, float], prior: dict[str, float], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], dict[str, tuple[str, float]]]:
    """Format weights and, for each candidate set, the best format and its posterior."""
    sets = {k: k.split(",") for k in counts}
    names = sorted({f for fs in sets.values() for f in fs})
    # the order named first by the rules below wins a draw
    weight = {f: 1.0 / len(names) for f in names}
    total = sum(counts.values()) + sum(prior.get(f, 0.0) for f in names)
    for _ in range(rounds):
        sums = {f: prior.get(f, 0.0) for f in names}
        for k, fs in sets.items():
            z = sum(weight[f] for f in fs)
            for f in fs:
                sums[f] += counts[k] * (weight[f] / z if z > 0 else 1.0 / len(fs))
        weight = {f: v / total for f, v in sums.items()}
    best = {}
    for k, fs in sets.items():
        z = sum(weight[f] for f in fs)
        share = {f: (weight[f] / z if z > 0 else 1.0 / len(fs)) for f in fs}
        first = max(fs, key=lambda f: (share[f], f != "count", f == "mdy"))
        best[k] = (first, share[first])
    return weight, best


def format_mixture(parsed: DataFrame, source: str, day_first: str, declared: str = "binding") -> DataFrame:
    """``(source, candidates, n, format, posterior, weight)``, a row per source and set of valid readings.

    The groups handed to Python hold one row per candidate set, of which there
    are fewer than twenty, however many values a source has.
    """
    bound = F.when(F.coalesce(F.col(day_first), F.lit(False)), F.lit("dmy")).otherwise("mdy")
    open_sets = F.filter("_formats", lambda f: (~f.isin("dmy", "mdy")) | (f == bound)) if declared == "binding" else F.col("_formats")
    counts = (
        parsed.select(F.col(source).alias("source"), bound.alias("bound"), F.col(day_first).isNotNull().alias("said"), F.concat_ws(",", open_sets).alias("candidates"))
        .groupBy("source", "bound", "said", "candidates")
        .agg(F.count("*").alias("n"))
    )

    def fit(key, rows):
        import pandas as pd

        rows = rows[rows["candidates"] != ""]
        if not len(rows):
            return pd.DataFrame(columns=["source", "candidates", "n", "format", "posterior", "weight"])
        prior = {rows["bound"].iloc[0]: PRIOR_COUNT} if declared == "prior" else {}
        if prior and not rows["said"].iloc[0]:
            prior["dmy"] = PRIOR_COUNT / 5  # no setting: values that show nothing stay open
        if any("run" in c and "count" in c for c in rows["candidates"]):
            prior["run"] = PRIOR_COUNT  # digits that spell a date are one unless the source only counts
        weight, best = _em(dict(zip(rows["candidates"], rows["n"].astype(float))), prior)
        return pd.DataFrame(
            {
                "source": rows["source"],
                "candidates": rows["candidates"],
                "n": rows["n"],
                "format": [best[c][0] for c in rows["candidates"]],
                "posterior": [best[c][1] for c in rows["candidates"]],
                "weight": [weight[best[c][0]] for c in rows["candidates"]],
            }
        )

    return counts.groupBy("source").applyInPandas(fit, "source string, candidates string, n long, format string, posterior double, weight double")


def zone_mixture(parsed: DataFrame, source: str, offsets: Column) -> DataFrame:
    """``(source, offsets, offset, posterior)``: the offset of each set that a source's shared abbreviation may mean.

    ``offsets`` lists the offsets in minutes that a value's zone may mean; a value
    that names one speaks for it alone.  The first of a shared set is the usual
    one.  As for formats, a group has a row per set, not per value.
    """
    counts = (
        parsed.select(F.col(source).alias("source"), F.array_join(offsets.cast("array<string>"), ",").alias("offsets"))
        .where("offsets != ''")
        .groupBy("source", "offsets")
        .agg(F.count("*").alias("n"))
    )
    shared = [",".join(map(str, o)) for o in SHARED.values()]

    def fit(key, rows):
        import pandas as pd

        asked = [o for o in rows["offsets"] if "," in o]
        if not asked:
            return pd.DataFrame(columns=["source", "offsets", "offset", "posterior"])
        prior = {x: PRIOR_COUNT / 5 for o in asked for x in o.split(",")[1:]} | {o.split(",")[0]: PRIOR_COUNT for o in asked}
        _, best = _em(dict(zip(rows["offsets"], rows["n"].astype(float))), prior)
        return pd.DataFrame({"source": key[0], "offsets": asked, "offset": [int(best[o][0]) for o in asked], "posterior": [best[o][1] for o in asked]})

    # sources without a shared abbreviation have nothing to settle
    open_ = counts.where(F.col("offsets").isin(shared)).select("source").distinct()
    return counts.join(open_, "source", "left_semi").groupBy("source").applyInPandas(fit, "source string, offsets string, offset int, posterior double")


def normalise(df: DataFrame, value: str, source: str, settings: DataFrame, declared: str = "binding") -> DataFrame:
    """``df`` with ``utc_micros``, ``status`` (``ok``, ``ambiguous`` or ``unreadable``), ``format`` and ``posterior``.

    ``settings`` has ``source``, ``default_zone`` and ``day_first``, a row per source.
    """
    names = zone_names(df)
    rules = settings.groupBy(F.col("source").alias("_source")).agg(F.max("default_zone").alias("_zone"), F.max("day_first").alias("_day_first"))
    # the caller's columns travel as one, so none of their names can meet those used here
    kept = [c for c in df.columns if c not in ADDED]
    packed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.coalesce(F.col(source), F.lit("")).alias("_source"), F.col(value).alias("_value"))
    parsed = parse(packed, "_value").join(rules, "_source", "left")
    bound = F.when(F.coalesce("_day_first", F.lit(False)), F.lit("dmy")).otherwise("mdy")
    usable = F.filter("_formats", lambda f: (~f.isin("dmy", "mdy")) | (f == bound)) if declared == "binding" else F.col("_formats")
    parsed = parsed.withColumn("_candidates", F.concat_ws(",", usable))
    mixture = format_mixture(parsed, "_source", "_day_first", declared)
    # only sets of two or more readings need the mixture; the rest are their own answer
    several = mixture.where(F.instr("candidates", ",") > 0).select(
        F.col("source").alias("_source"), F.col("candidates").alias("_candidates"), "format", "posterior"
    )
    several = several.persist()  # fewer than twenty rows a source: looked at for its size, then joined
    rows = parsed.join(small(several), ["_source", "_candidates"], "left")
    single = F.when((F.col("_candidates") != "") & (F.instr("_candidates", ",") == 0), F.col("_candidates"))
    rows = rows.withColumn("format", F.coalesce("format", single)).withColumn("posterior", F.coalesce("posterior", F.when(single.isNotNull(), 1.0)))
    p = lambda n: F.col(f"_parts.{n}")
    turned = F.col("format") == "dmy"
    month, day = F.when(turned, p("b")).otherwise(p("a")), F.when(turned, p("a")).otherwise(p("b"))
    wall = ((_days(p("y").cast("long"), month, day) * 86400 + p("h").cast("long") * 3600 + p("mi") * 60 + p("s")) * 1000000 + p("us")).cast("long")
    zone = F.regexp_replace(p("zone"), r"^(gmt|utc)(?=[+-])", "")
    shift = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    hours = F.regexp_extract(zone, r"^[+-](\d{1,2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, r"^[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    written = F.when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))
    offset = F.when(zone.rlike("^[+-]"), written).otherwise(F.try_element_at(shift, F.coalesce(zone, F.lit("?"))))
    certain = F.lit(1.0)
    if declared != "binding":
        shared = F.create_map(*[x for k, v in SHARED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        rows = rows.withColumn("_offsets", F.coalesce(F.try_element_at(shared, F.coalesce(zone, F.lit("?"))), F.array_compact(F.array(offset))))
        settled = zone_mixture(rows, "_source", F.col("_offsets")).select(
            F.col("source").alias("_source"), F.col("offsets").alias("_set"), F.col("offset").alias("_offset"), F.col("posterior").alias("_offset_posterior")
        )
        rows = rows.withColumn("_set", F.array_join(F.col("_offsets").cast("array<string>"), ",")).join(small(settled.persist()), ["_source", "_set"], "left")
        offset, certain = F.coalesce("_offset", offset), F.coalesce("_offset_posterior", F.lit(1.0))
    proper = F.create_map(*[F.lit(x) for z in names if "/" in z for x in (z.lower(), z)])
    region = F.when(zone.isNull(), F.when(F.col("_zone").isin(names), F.col("_zone")).otherwise("UTC"))
    region = region.when(zone.contains("/"), F.try_element_at(proper, zone))
    local = F.to_utc_timestamp(F.timestamp_micros(wall), region)
    instant = (
        F.when(F.col("format") == "count", F.col("_micros"))
        .when(offset.isNotNull(), wall - offset.cast("long") * 60000000)
        .when(region.isNotNull(), F.unix_micros(local))
    )
    # the same wall-clock time half an hour or an hour later: it occurs twice
    again = [F.from_utc_timestamp(local + F.expr(f"INTERVAL {m} MINUTES"), region) == F.timestamp_micros(wall) for m in (30, 60)]
    twice = (F.col("format") != "count") & offset.isNull() & region.isNotNull() & (again[0] | again[1])
    rows = rows.withColumn("posterior", F.col("posterior") * certain).withColumn("utc_micros", F.when(F.col("format").isNotNull(), instant).cast("long"))
    unsure = F.col("posterior") < AMBIGUOUS_BELOW
    if declared != "binding":
        unsure = unsure | F.coalesce(twice, F.lit(False))
    status = F.when(F.col("utc_micros").isNull(), "unreadable").when(unsure, "ambiguous").otherwise("ok")
    return rows.withColumn("status", status).select(*[F.col(f"_row.{c}").alias(c) for c in kept], *ADDED)
