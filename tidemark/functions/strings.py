"""Text, date and formatting rules as column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(c: Column, width: int = 10) -> Column:
    """A numeric id as digits with leading zeros; ids that are already longer stay whole."""
    digits = F.trim(c.cast("string"))
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def slug(c: Column) -> Column:
    """Runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def url_part(c: Column) -> Column:
    """Percent-encoded for a query: a space as %20 and a plus as %2B."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def has_code(codes: Column, code: str) -> Column:
    """Whether a comma-separated list holds the code, white space aside; false for null."""
    return F.coalesce(F.array_contains(F.transform(F.split(codes, ","), lambda x: F.trim(x)), code), F.lit(False))


def quarter_label(day: Column) -> Column:
    """Such as Q2'26."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit("'"), F.date_format(day, "yy"))


def day_millis(day: Column) -> Column:
    """Milliseconds since 1970 at midnight UTC of a date."""
    return F.unix_date(day).cast("bigint") * 86_400_000


def years_on(day: Column, years: int) -> Column:
    """The same day so many years on; 29 February becomes the 28th."""
    return F.add_months(day, 12 * years)


def axis_kind(value: Column) -> Column:
    """'datetime' if the first ten characters are a date, else 'category'."""
    return F.when(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull(), "datetime").otherwise("category")


def version_key(c: Column) -> Column:
    """Numbers of a dotted version as an array that sorts like the version; other parts count as 0."""
    return F.transform(F.split(F.regexp_replace(c, "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def money(c: Column, sign: str = "$") -> Column:
    """Such as $1.2B, $3.4M or $56, by size; for reports, not for further computing."""
    a = F.abs(c)
    text = F.when(a >= 1e9, F.concat(F.format_number(a / 1e9, 1), F.lit("B"))).when(a >= 1e6, F.concat(F.format_number(a / 1e6, 1), F.lit("M"))).otherwise(F.format_number(a, 0))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit(sign), text)


def fiscal_year(day: Column, end_mmdd: str) -> Column:
    """The fiscal year a day lies in, for years that end on MMDD (0229 counts as the last of February) and are named
    by the calendar year of their end."""
    month, d = int(end_mmdd[:2]), int(end_mmdd[2:])
    last = F.least(F.lit(d), F.dayofmonth(F.last_day(F.make_date(F.year(day), F.lit(month), F.lit(1)))))
    return F.year(day) + F.when(F.month(day) * 100 + F.dayofmonth(day) > month * 100 + last, 1).otherwise(0)


def ratio_text(c: Column, kind: str = "ratio") -> Column:
    """A ratio for reading: percentage, times, days, currency or plain, with two decimals (days with one)."""
    form = {"percentage": "%.2f%%", "times": "%.2fx", "days": "%.1f days", "currency": "$%.2f"}.get(kind, "%.2f")
    return F.when(c.isNotNull(), F.format_string(form, (c * 100 if kind == "percentage" else c).cast("double")))


def axis_text(c: Column, *, percent: bool = False, currency: str = "", unit: str = "", decimals: int | None = None) -> Column:
    """A number as an axis shows it: a percent sign behind it, or a currency before and a unit behind, negative amounts
    in parentheses; a dash for null and NaN. One decimal by default for percents and with a unit, else none."""
    d = decimals if decimals is not None else (1 if percent or unit else 0)
    v = c.cast("double")
    if percent:
        text = F.format_string(f"%.{d}f%%", v)
    else:
        body = F.concat(F.lit(currency), F.format_string(f"%.{d}f", F.abs(v)), F.lit(unit))
        text = F.when(v == 0, F.lit(currency + "0")).when(v < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)
    return F.when(v.isNull() | F.isnan(v), "—").otherwise(text)


def money_text(c: Column, sign: str = "$") -> Column:
    """Money with two decimals; a dash for null."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit(sign), F.format_number(c, 2)))


def iso_week(day: Column) -> Column:
    """Such as 2025-W01: the ISO week, which belongs to the year of its Thursday."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def truthy(c: Column) -> Column:
    """A flag that comes as boolean, number or text of any case: true for true, 1, yes; false for false, 0, no, blank; else null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "1.0", "yes", "y"), True).when(t.isin("false", "0", "0.0", "no", "n", ""), False)


# Fixed value: what makes a note look like an instruction to its reader.
SUSPICIOUS = r"(?i)ignore (all |any )?previous instructions|you are now|system:|do not (report|flag|mention)"


def suspicious(c: Column) -> Column:
    """Whether a note should go to quarantine; false for null."""
    return F.coalesce(c.rlike(SUSPICIOUS), F.lit(False))


def keyword_terms(c: Column) -> Column:
    """array<struct<series, term, excluded>> of a keyword text: ',' parts series, '+' unites terms within one, quotes
    keep a term whole, a leading '-' excludes it. White space at the ends and empty terms don't count."""
    token = r'(-?"[^"]*"|[^,+]+)|([,+])'
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(token), 0)
    start = F.struct(F.lit(0).alias("series"), F.array().cast("array<struct<series:int,term:string,excluded:boolean>>").alias("terms"))

    def step(acc: Column, t: Column) -> Column:
        text = F.trim(t)
        bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^-\s*", ""), r'^"|"$', ""))
        more = F.when(t.isin(",", "+") | (bare == ""), acc["terms"]).otherwise(F.concat(acc["terms"], F.array(F.struct(acc["series"].alias("series"), bare.alias("term"), text.startswith("-").alias("excluded")))))
        return F.struct((acc["series"] + F.when(t == ",", 1).otherwise(0)).alias("series"), more.alias("terms"))

    return F.aggregate(tokens, start, step, lambda acc: acc["terms"])


def html_escaped(c: Column) -> Column:
    """Text that is safe inside HTML: & < > and both quotes are written as entities."""
    out = c
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def light_markup(c: Column) -> Column:
    """Escaped text in which **bold**, *italic* and `code` become tags."""
    out = F.regexp_replace(html_escaped(c), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(F.regexp_replace(out, r"\*([^*]+)\*", "<em>$1</em>"), r"`([^`]+)`", "<code>$1</code>")
