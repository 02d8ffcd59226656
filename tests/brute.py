"""Plain versions of the problems, row by row, written apart from the library."""

import json
import re
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from math import floor, log10
from zoneinfo import ZoneInfo

MON = "jan feb mar apr may jun jul aug sep oct nov dec".split()
FIXED = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "CST": -6, "CDT": -5}


def once(rows, key):
    return list({r[key]: r for r in rows}.values())


def sym(s):
    return s.strip().upper().replace(".", "-") if s and s.strip() else None


def day(s):
    m = re.fullmatch(r"(\d{4})([-/]?)(\d\d)\2(\d\d)([T ]\d.*)?", (s or "").strip())
    try:
        return date(int(m[1]), int(m[3]), int(m[4])) if m else None
    except ValueError:
        return None


def quarter(p):
    m = re.search(r"(?i)\bq(?:uarter)?\s*([1-4])\b|\b([1-4])q\b", (p or "").replace("_", " "))
    return m is not None


def epoch_ms(v, zone):
    v = (v or "").strip()
    if re.fullmatch(r"\d{10}", v):
        return int(v) * 1000
    if re.fullmatch(r"\d{13}", v):
        return int(v)
    tail = r"[T ](\d{1,2}):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(?: ([AP]M))?\s?(.*)"
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)" + tail, v):
        y, mo, d, rest = m[1], m[2], m[3], m.groups()[3:]
    elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)(Z?)", v):
        y, mo, d, rest = m[1], m[2], m[3], (m[4], m[5], m[6], None, None, m[7])
    elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4})" + tail, v):
        y, mo, d, rest = m[3], m[1], m[2], m.groups()[3:]
    elif m := re.fullmatch(r"([A-Z][a-z]{2}) (\d{1,2}), (\d{4})" + tail, v):
        y, mo, d, rest = m[3], MON.index(m[1].lower()) + 1, m[2], m.groups()[3:]
    elif m := re.fullmatch(r"(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2})[a-z]* (\d{4})" + tail, v):
        y, mo, d, rest = m[3], MON.index(m[2].lower()) + 1, m[1], m.groups()[3:]
    else:
        return None
    h, mi, s, frac, half, z = rest
    h = int(h)
    if half:
        h = h % 12 + (12 if half == "PM" else 0)
    try:
        t = datetime(int(y), int(mo), int(d), h, int(mi), int(s or 0))
    except ValueError:
        return None
    ms = int(((frac or "") + "000")[:3])
    if m := re.match(r"([+-])(\d\d):?(\d\d)", z):
        off = (int(m[2]) * 60 + int(m[3])) * (1 if m[1] == "+" else -1)
    elif z in FIXED:
        off = FIXED[z] * 60
    else:
        name = {"": zone, "ET": "America/New_York"}.get(z, z)
        # fold=0: the first of two; in a gap the offset before it, which moves the time forward.
        off = t.replace(tzinfo=ZoneInfo(name)).utcoffset().total_seconds() / 60
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1000 - off * 60000) + ms


def p5(inc, env):
    out = set()
    for r in env:
        for src, v in (("fetched_at", r["fetched_at"]), ("created_at", ((r["raw_response"] or {}).get("search_metadata") or {}).get("created_at"))):
            if (x := epoch_ms(v, "UTC")) is not None:
                out.add((src, r["env_id"], x))
    for r in inc:
        if (x := epoch_ms(r["acceptedDate"], "America/New_York")) is not None:
            out.add(("acceptedDate", r["inc_id"], x))
    return out


def p6(events, inc):
    by = defaultdict(list)
    for r in inc:
        if r["date"] is None or not quarter(r["period"]):
            continue
        k = epoch_ms(r["acceptedDate"], "America/New_York")
        if k is None and r["filingDate"]:
            k = int((datetime.combine(day(r["filingDate"]) + timedelta(1), datetime.min.time(), timezone.utc)).timestamp() * 1000)
        if k is not None:
            by[sym(r["symbol"])].append((day(r["date"]), k, r["inc_id"]))
    out = set()
    for r in events:
        if r["fetched_at"]:
            t = int(datetime.strptime(r["fetched_at"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp() * 1000)
            if known := [x for x in by[sym(r["ticker"])] if x[1] <= t]:
                out.add((r["event_id"], max(known)[2]))
    return out


CUR = {"US$": "USD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "C$": "CAD", "R$": "BRL", "Fr.": "CHF", "₹": "INR", "NT$": "TWD"}
POW = {"k": 3, "thousand": 3, "thousands": 3, "tsd": 3, "'000": 3, "000s": 3, "m": 6, "mm": 6, "mn": 6, "mio": 6, "million": 6, "millions": 6, "b": 9, "bn": 9, "billion": 9, "billions": 9, "mrd": 9, "lakh": 5, "crore": 7, "cr": 7, "units": 0}


def words(text):
    """(currency, power) by splitting the text at its currency."""
    t = text or ""
    if re.search(r"GBX|GBp\b|pence", t):
        return "GBP", -2
    m = re.search(r"US\$|NT\$|C\$|R\$|Fr\.|[$€£¥₹]|(?i:USD|EUR|GBP|JPY|CAD|BRL|CHF|INR|TWD|SEK)", t)
    if not m:
        return None, None
    cur = CUR.get(m[0], m[0].upper())
    near = [re.match(r"[\s,/(]*([\w']+)", t[m.end() :]), re.search(r"([\w']+)\.?(?: of)? ?$", t[: m.start()])]
    return cur, next((POW[w[1].lower()] for w in near if w and w[1].lower() in POW), None)


def p2(inc, points, rates):
    fx = {(r["currency"], r["fiscal_year"]): r["usd_micros"] for r in rates}
    rows, named = [], defaultdict(Counter)
    for r in inc:
        if r["revenue"] is None:
            continue
        cur, power = words(r["reportedCurrency"])
        if power is None:
            power = round(log10(abs(r["eps"] * r["weightedAverageShsOut"] / r["bottomLineNetIncome"])))
        rows.append(("aapl_income_quarter", r["inc_id"], sym(r["symbol"]), int(r["fiscalYear"]), cur, power, Decimal(r["revenue"])))
    for r in points:
        if r["name"] != "Revenue" or r["data"] is None:
            continue
        unit = (r["unit"] or "").strip().rstrip(".").lower()
        power = POW.get(unit)
        for t in (r["axis_name"], r["title"]):
            power = words(t)[1] if power is None else power
        cur = next((c for c in (words(t)[0] for t in (r["currency"], r["axis_name"], r["title"])) if c), None)
        rows.append(("revenue_margins", r["point_id"], sym(r["symbol"]), int(re.search(r"\d{4}", r["category"])[0]), cur, power or 0, Decimal(str(r["data"]))))
    for x in rows:
        if x[4]:
            named[x[2]][x[4]] += 1
    out = set()
    for src, i, s, y, cur, power, amount in rows:
        cur = cur or named[s].most_common(1)[0][0]
        if (cur, power) != ("USD", 0):
            out.add((src, i, floor(amount * Decimal(10) ** power * fx.get((cur, y), 10**6) / 10**6)))
    return out


def number(v):
    if isinstance(v, dict):
        v = v.get("amount")
    if isinstance(v, str):
        v = v.replace(",", "")
    return None if v is None else Decimal(str(v)).normalize()


def p4(rows):
    files = defaultdict(dict)
    for r in rows:
        files[r["symbol"], r["file_date"], r["file_name"]][r["fiscalYear"]] = json.loads(r["data"]) if r["data"] else {}
    out, last = set(), {}
    for (s, _, name), years in sorted(files.items()):
        if s in last:
            old = last[s]
            fields = lambda f: {k for d in f.values() for k in d}
            kind = lambda f, k: {("object" if isinstance(d[k], dict) else "text" if isinstance(d[k], str) else "number") for d in f.values() if d.get(k) is not None}
            new, gone = fields(years) - fields(old), fields(old) - fields(years)
            both = years.keys() & old.keys()
            renamed = {}
            for n in sorted(new):
                for g in sorted(gone):
                    pairs = [(number(years[y].get(n)), number(old[y].get(g))) for y in both]
                    pairs = [p for p in pairs if None not in p]
                    if pairs and all(a == b for a, b in pairs) and g not in renamed.values() and n not in renamed:
                        renamed[n] = g
            out |= {(name, "renamed", n, g) for n, g in renamed.items()} | {(name, "added", n, "") for n in new - renamed.keys()} | {(name, "removed", g, "") for g in gone - set(renamed.values())}
            out |= {(name, "retyped", k, "") for k in fields(years) & fields(old) if kind(years, k) and kind(old, k) and kind(years, k) != kind(old, k)}
        last[s] = years
    return out
