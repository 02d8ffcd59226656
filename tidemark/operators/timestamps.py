"""Times written in many ways, brought to one instant each.

Every value is read under all formats that fit it. Where more than one does, an expectation-maximisation over the
mixture of formats of its source decides: the share of each format in the source is estimated from all values of the
source, the posterior of a value chooses its reading, and a value whose best posterior stays under a threshold is
marked as ambiguous instead of being guessed.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

# Month names and zone abbreviations (minutes east of UTC).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
OFFSETS = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "IST": 330}
REGIONS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm](?![A-Za-z])\.?)?"
_ZONE = r"\s*((?:UTC|GMT)?[+-]\d{2}:?(?:\d{2})?(?:\s*\[[A-Za-z_/+\-0-9]+\])?|[A-Z]{1,4}|[A-Za-z]+/[A-Za-z_/\-]+)?"
_NAME = r"(jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec)[a-z]*\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_REST = rf"(?:[T ]|,)\s*(?:at\s+)?{_TIME}{_HALF}{_ZONE}"

#: name -> (pattern, order of year, month, day, hour, minute, second, fraction, half, zone among its groups).
CALENDAR = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_REST}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "ymd_slash": (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_REST}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?()" + _ZONE + "$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "mdy_slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_REST}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "dmy_slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_REST}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "dmy_dot": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_REST}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "name_first": (rf"(?i)^{_DAY}{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_REST}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "day_name": (rf"(?i)^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s\-]+{_NAME}[\s\-]+(\d{{4}}){_REST}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
}
#: name -> (pattern whose first group is a whole number of the unit and the second a fraction of it, milliseconds a unit).
EPOCHS = {"epoch_s": (r"^(\d{9,11})(?:\.(\d{1,9}))?$", 1000), "epoch_ms": (r"^(\d{12,14})()$", 1), "epoch_us": (r"^(\d{12,14})\d{3}()$", 1), "epoch_ns": (r"^(\d{12,13})\d{6}()$", 1)}
FORMATS = [*CALENDAR, *EPOCHS]


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _let(values: Column, step) -> Column:
    """values with step applied to each: what step is given is computed once, however often step uses it."""
    return F.transform(values, step)


def _instants(parts: Column, zone: str) -> Column:
    """array<struct<format, epoch_ms>> from array<struct<format, parts>>, where parts are the nine texts of a format;
    epoch_ms is null if the day, the time or the zone doesn't exist."""
    months = F.array(*map(F.lit, MONTHS))
    offsets = F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in kv])
    regions = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    names = sorted(x for x in zoneinfo.available_timezones() if "/" in x and not x.startswith(("posix/", "right/", "Etc/")))

    def numbers(c: Column) -> Column:
        year, month, day, hour, minute, second, fraction, half, stated = (F.get(c["parts"], F.lit(i)) for i in range(9))
        name = F.array_position(months, F.lower(F.substring(month, 1, 3)))
        shown = F.when(month.rlike(r"^\d"), F.lpad(month, 2, "0")).otherwise(F.lpad(name.cast("string"), 2, "0"))
        return F.struct(
            c["format"].alias("format"), F.unix_date(F.concat_ws("-", year, shown, F.lpad(day, 2, "0")).try_cast("date")).cast("long").alias("day"), _number(hour).alias("h"), _number(minute).alias("m"), F.coalesce(_number(second), F.lit(0)).alias("s"),
            F.coalesce(_number(F.substring(F.rpad(fraction, 3, "0"), 1, 3)), F.lit(0)).alias("ms"), F.lower(half).alias("half"), F.regexp_extract(stated, r"([+-]\d{2}:?(?:\d{2})?)", 1).alias("shift"), F.regexp_replace(stated, r"\s*\[.*", "").alias("zone"),
        )

    def local(c: Column) -> Column:
        h24 = F.when(c["half"] == "", F.when(c["h"] < 24, c["h"])).when((c["h"] >= 1) & (c["h"] <= 12), c["h"] % 12 + F.when(c["half"] == "p", 12).otherwise(0))
        ms = F.when((c["m"] < 60) & (c["s"] < 60) & (c["day"] > -719162), c["day"] * 86400000 + (h24 * 3600 + c["m"] * 60 + c["s"]) * 1000 + c["ms"])
        digits = F.regexp_replace(c["shift"], ":", "")
        minutes = _number(F.substring(digits, 2, 2)) * 60 + F.coalesce(_number(F.substring(digits, 4, 2)), F.lit(0))
        signed = F.when(c["shift"].startswith("-"), -minutes).otherwise(minutes)
        region = F.when(c["zone"] == "", F.lit(zone)).otherwise(F.coalesce(F.try_element_at(regions, F.upper(c["zone"])), F.when(c["zone"].isin(names), c["zone"])))
        fixed = F.when(c["shift"] != "", F.when(F.abs(signed) <= 18 * 60, signed)).otherwise(F.try_element_at(offsets, F.upper(c["zone"])))
        return F.struct(c["format"].alias("format"), ms.alias("local"), fixed.alias("minutes"), F.when(c["shift"] == "", region).alias("region"))

    def instant(c: Column) -> Column:
        # to_utc_timestamp takes the first of a local hour that occurs twice and moves a skipped time forward by the gap.
        zoned = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(c["local"]), c["region"]))
        ms = F.when(c["minutes"].isNotNull(), c["local"] - c["minutes"] * 60000).when(c["region"].isNotNull(), zoned)
        return F.struct(c["format"].alias("format"), ms.alias("epoch_ms"))

    return _let(_let(_let(parts, numbers), local), instant)


def readings(value: Column, zone: str = "UTC", formats: Sequence[str] = tuple(FORMATS)) -> Column:
    """array<struct<format, epoch_ms>>: each format under which value states a real day and a time; null gives an empty array.

    zone holds for values that state none. The formats stand in the order given.
    """
    v = F.regexp_replace(value, r"^[\s ]+|[\s ]+$", "")
    split = [F.when(v.rlike(CALENDAR[f][0]), F.struct(F.lit(f).alias("format"), F.split(F.regexp_replace(v, CALENDAR[f][0], "|".join(f"${g}" for g in CALENDAR[f][1])), r"\|", -1).alias("parts"))) for f in formats if f in CALENDAR]
    parts = F.filter(F.array(*split), lambda x: x.isNotNull()) if split else F.array().cast("array<struct<format:string,parts:array<string>>>")
    dated = _instants(parts, zone)
    counted = []
    for f in formats:
        if f in EPOCHS:
            pattern, unit = EPOCHS[f]
            rest = F.coalesce(_number(F.substring(F.rpad(F.regexp_extract(v, pattern, 2), 3, "0"), 1, 3)), F.lit(0))
            ms = F.regexp_extract(v, pattern, 1).try_cast("long") * unit + rest
            counted.append(F.when(v.rlike(pattern), F.struct(F.lit(f).alias("format"), ms.alias("epoch_ms"))))
    every = F.concat(dated, F.array(*counted)) if counted else dated
    return F.when(value.isNull(), F.array().cast("array<struct<format:string,epoch_ms:bigint>>")).otherwise(F.filter(every, lambda x: x["epoch_ms"].isNotNull()))


def mixture(signatures: Iterable[tuple[tuple[tuple[str, bool], ...], int]], rounds: int = 50, far: float = 1e-4) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Shares of the formats and the posterior of each signature, by expectation-maximisation.

    A signature lists the formats that fit a value, each with whether the instant read lies in the plausible years;
    a reading outside them has the likelihood far instead of 1. The start is uniform, so ties stay ties.
    """
    signatures = list(signatures)
    names = sorted({f for s, _ in signatures for f, _ in s})
    share = {f: 1 / len(names) for f in names} if names else {}
    total = sum(n for s, n in signatures if s)
    posteriors: list[dict[str, float]] = [{} for _ in signatures]
    for _ in range(rounds):
        weight = dict.fromkeys(names, 0.0)
        for i, (s, n) in enumerate(signatures):
            joint = {f: share[f] * (1.0 if near else far) for f, near in s}
            whole = sum(joint.values())
            posteriors[i] = {f: (x / whole if whole else 1 / len(joint)) for f, x in joint.items()}
            for f, x in posteriors[i].items():
                weight[f] += n * x
        new = {f: w / total for f, w in weight.items()} if total else share
        moved = max((abs(new[f] - share[f]) for f in names), default=0.0)
        share = new
        if moved < 1e-9:
            break
    return share, posteriors


def normalise_times(df: DataFrame, *, source: str, value: str, zones: dict[str, str] | None = None, formats: Sequence[str] = tuple(FORMATS), years: tuple[int, int] = (1990, 2100), threshold: float = 0.9) -> DataFrame:
    """df with epoch_ms, time_format, posterior and time_status behind its columns.

    source names the column with a value's source, value the text column; zones gives the zone of a source's values
    that state none (UTC where it has no entry). time_status is 'resolved', 'ambiguous' (no reading reaches the
    threshold; epoch_ms null), 'unreadable' (no real day and time) or 'missing' (null). Columns of df with one of the
    new names are replaced. An empty df gives an empty result.

    The readings are written once to the shared folder. The shares are estimated from counts of signatures (at most two to the number of formats, times two for each, in
    practice some dozens a source), which one aggregation with partial sums forms from all rows.
    """
    new = ["epoch_ms", "time_format", "posterior", "time_status"]
    kept = df.drop(*new)
    lo, hi = (int(pd.Timestamp(f"{y}-01-01", tz="UTC").value // 10**6) for y in years)
    read = F.lit(None)
    for name, zone in (zones or {}).items():
        read = F.when(F.col(source) == name, readings(F.col(value), zone, formats)).otherwise(read) if zone != "UTC" else read
    others = readings(F.col(value), "UTC", formats)
    special = [n for n, z in (zones or {}).items() if z != "UTC"]
    read = F.when(F.col(source).isin(special), read).otherwise(others) if special else others
    # The generator keeps the optimiser from copying the reading into each place that uses it; the table written here
    # keeps the counts and the result from reading each value twice.
    data = kept.select("*", F.explode(F.array(F.struct(read.alias("r")))).alias("__x")).withColumn("__read", F.col("__x.r")).drop("__x").withColumn("__sig", F.concat_ws(",", F.transform("__read", lambda x: F.concat(x["format"], F.when((x["epoch_ms"] >= lo) & (x["epoch_ms"] < hi), "+").otherwise("-")))))
    data = cut(data)
    counts = data.where("__sig <> ''").groupBy(F.col(source).alias("__src"), "__sig").agg(F.count("*").alias("__n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = [(tuple((x[:-1], x[-1] == "+") for x in s.split(",")), int(n)) for s, n in zip(pdf["__sig"], pdf["__n"])]
        _, posts = mixture(sigs)
        best = [max(p, key=lambda f: (p[f], f)) for p in posts]
        return pd.DataFrame({"__src": pdf["__src"], "__sig": pdf["__sig"], "__best": best, "__post": [p[b] for p, b in zip(posts, best)]})

    chosen = counts.groupBy("__src").applyInPandas(solve, f"__src {df.schema[source].dataType.simpleString()}, __sig string, __best string, __post double")
    out = data.join(chosen, F.col(source).eqNullSafe(F.col("__src")) & (data["__sig"] == chosen["__sig"]), "left").drop("__src").drop(chosen["__sig"])
    sure = F.col("__post") >= threshold
    return out.select(
        *kept.columns,
        F.when(sure, F.get(F.filter("__read", lambda x: x["format"] == F.col("__best")), F.lit(0))["epoch_ms"]).alias("epoch_ms"),
        F.col("__best").alias("time_format"),
        F.col("__post").alias("posterior"),
        F.when(F.col(value).isNull(), "missing").when(F.col("__best").isNull(), "unreadable").when(sure, "resolved").otherwise("ambiguous").alias("time_status"),
    )
