"""Amounts recorded in unlike units, brought to one.

The unit of a record (a power of ten) is the hidden state of a Markov model that runs over the records of one series
in order of time. Words beside the amount, an independent estimate from the record itself, and the jump of the
log-amount against the record before, all count as observations; Viterbi decoding gives the likeliest sequence of units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

# Words for scales, by their power of ten.
SCALES = {
    0: ["units", "unit", "ones", "einheiten", "unidades", "unités"],
    3: ["k", "th", "thou", "thousand", "thousands", "tsd", "tausend", "teur", "000", "000s", "'000", "'000s", "000's", "millier", "milliers", "miles", "mil", "mila", "千"],
    4: ["万", "萬"],
    5: ["lakh", "lakhs", "lac", "lacs"],
    6: ["m", "mm", "mn", "mln", "mio", "mill", "million", "millions", "millionen", "millón", "millones", "milhão", "milhões", "milioni", "miljoner", "百万"],
    7: ["cr", "crs", "crore", "crores", "千万"],
    8: ["億", "亿"],
    9: ["b", "bn", "bln", "bil", "billion", "billions", "mrd", "mld", "md", "milliard", "milliards", "milliarde", "milliarden", "miliardi", "miljarder", "bi"],
    12: ["t", "tn", "trn", "trillion", "trillions", "bio", "billionen", "兆"],
}
# Ways to write a currency besides its code. Longer ones are tried first.
CURRENCIES = {
    "USD": ["US$", "$", "U.S. dollars", "dollars", "dollar"], "EUR": ["€", "euros", "euro"], "GBP": ["£", "pounds sterling", "pounds", "sterling", "STG"], "JPY": ["¥", "円", "yen"], "CAD": ["C$", "CA$", "CDN$"],
    "BRL": ["R$", "reais"], "CHF": ["Fr.", "SFr.", "SFr", "francs"], "INR": ["₹", "Rs.", "Rs", "rupees"], "TWD": ["NT$", "NTD"], "SEK": ["kronor", "kr"], "CNY": ["RMB", "CN¥", "元"], "HKD": ["HK$"], "AUD": ["A$", "AU$"], "KRW": ["₩"],
    "SGD": ["S$"], "MXN": ["MX$"], "DKK": [], "NOK": [], "NZD": ["NZ$"], "PLN": ["zł"], "ZAR": [],
}
# Minor units by name, matched in exactly this case: currency and power of ten.
MINOR = {"GBX": ("GBP", -2), "GBp": ("GBP", -2), "pence": ("GBP", -2), "Pence": ("GBP", -2), "PENCE": ("GBP", -2), "p.": ("GBP", -2), "ZAc": ("ZAR", -2), "US cents": ("USD", -2), "cents": ("USD", -2)}

STATES = (-2, 0, 3, 4, 5, 6, 7, 8, 9, 12)
_WORDS = {w: p for p, words in SCALES.items() for w in words}
_QUOTE = str.maketrans({c: "\\" + c for c in "$.'^|()[]{}*+?\\"})


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(w.translate(_QUOTE) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


_LETTER = r"\p{L}\p{N}"
_NAMES = {n.lower(): c for c, names in CURRENCIES.items() for n in [c, *names]}
_MONEY = rf"(?:(?<![{_LETTER}$])(?i:{_any(list(_NAMES))})|{_any(list(MINOR))})"
_SCALE = rf"(?i:{_any(list(_WORDS))})\.?"
_AFTER = rf"{_MONEY}[\s,/(\[]*({_SCALE})(?![{_LETTER}'])"
_BEFORE = rf"(?<![{_LETTER}'])({_SCALE})\s*(?:(?i:of|in|de|d')\s*)?[(\[]?{_MONEY}"
_ALONE = rf"^[\s(\[]*(?:in\s+)?({_SCALE})[\s)\]]*$"


def _power(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])
    plain = F.lower(word)
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_replace(plain, r"\.$", "")))


def stated_power(text: Column, alone: bool = False) -> Column:
    """The power of ten that a text states beside a currency, null if it states none.

    A scale word counts only next to a currency name ('in k of USD', 'US$ (Tsd.)', 'USDm'), so that 'per thousand
    visits' or 'K-class' state nothing; with alone a text that is nothing but a scale word counts too.
    """
    t = F.coalesce(text, F.lit(""))
    words = [F.regexp_extract(t, _AFTER, 1), F.regexp_extract(t, _BEFORE, 1)]
    if alone:
        words.insert(0, F.regexp_extract(t, _ALONE, 1))
    minor = F.when(t.rlike(rf"(?<![{_LETTER}]){_any(list(MINOR))}(?![{_LETTER}])"), -2)
    large = F.coalesce(*[_power(F.nullif(w, F.lit(""))) for w in words])
    return F.when(minor.isNotNull() & large.isNotNull(), minor + large).otherwise(F.coalesce(minor, large))


def stated_currency(text: Column) -> Column:
    """The code of the currency that a text names, null if none. '$' alone is the US dollar."""
    t = F.coalesce(text, F.lit(""))
    minor = F.regexp_extract(t, rf"(?<![{_LETTER}])({_any(list(MINOR))})(?![{_LETTER}])", 1)
    sign = [n for n in _NAMES if not n[-1].isalnum() or not n.isascii()]
    word = [n for n in _NAMES if n not in sign]
    scale = _any(list(_WORDS))
    found = F.regexp_extract(t, rf"(?i)(?<![{_LETTER}$])({_any(word)})(?=$|[^{_LETTER}]|{scale}\.?(?![{_LETTER}]))|(?<![{_LETTER}$])({_any(sign)})", 0)
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (c, _) in MINOR.items() for x in (k, c)]), F.nullif(minor, F.lit(""))), F.try_element_at(names, F.lower(found)))


class Chain:
    """The scores of a batch of rows: of each state at a row, and of going from the state of one row to that of the next.

    level is the log10 of the amount (nan if unknown, zero or negative), stated a power that the text names and
    estimate one that the record suggests (both nan if none).
    """

    def __init__(self, level: np.ndarray, stated: np.ndarray, estimate: np.ndarray, states: np.ndarray, *, stay: float = 0.98, sigma: float = 0.35, noise: float = 0.12, cap: float = 12.0, firm: float = 60.0) -> None:
        k = len(states)
        self.level, self.states, self.sigma, self.cap = level, states, sigma, cap
        self.emit = np.where(states == 0, 0.0, -0.5)[None, :].repeat(len(level), 0)
        known = ~np.isnan(stated)
        self.emit[known] += np.where(np.isclose(states[None, :], stated[known, None]), 0.0, -firm)
        est = ~np.isnan(estimate)
        self.emit[est] += -np.minimum((estimate[est, None] - states[None, :]) ** 2 / (2 * noise**2), firm / 2)
        self.change = np.where(np.eye(k, dtype=bool), np.log(stay), np.log((1 - stay) / (k - 1)))

    def step(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(rows, state before, state after): the score of a step between rows of these log-amounts."""
        jump = (after[:, None, None] + self.states[None, None, :]) - (before[:, None, None] + self.states[None, :, None])
        return self.change[None] + np.where(np.isnan(jump), 0.0, -np.minimum(jump**2 / (2 * self.sigma**2), self.cap))


def _sequences(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the sequences, the longest first."""
    first = np.flatnonzero(starts)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def viterbi(starts: np.ndarray, chain: Chain, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """The likeliest state of each row; rows of a sequence stand together, starts marks their first rows.

    All sequences advance together, so the loop is as long as the longest of them. A sequence that is a block of a
    longer one is given enter, the score with which each state is reached at its first row, and leave, the number of
    the state at its last row (one of each per sequence, in order of rows).
    """
    n, k = chain.emit.shape
    if n == 0:
        return np.zeros(0)
    first, length = _sequences(starts, n)
    number = np.searchsorted(np.flatnonzero(starts), first)
    score, back = np.empty((n, k)), np.zeros((n, k), dtype=np.int16)
    score[first] = chain.emit[first] + (0.0 if enter is None else enter[number])
    for t in range(1, int(length[0])):
        rows = first[: np.searchsorted(-length, -t)] + t
        total = score[rows - 1][:, :, None] + chain.step(chain.level[rows - 1], chain.level[rows])
        back[rows] = total.argmax(1)
        score[rows] = total.max(1) + chain.emit[rows]
    out = np.zeros(n, dtype=np.int64)
    last = first + length - 1
    out[last] = score[last].argmax(1) if leave is None else leave[number]
    for t in range(int(length[0]) - 1, 0, -1):
        rows = first[: np.searchsorted(-length, -t)] + t
        out[rows - 1] = back[rows, out[rows]]
    return chain.states[out]


def through(starts: np.ndarray, chain: Chain) -> np.ndarray:
    """(sequences, state at the first row, state at the last row): the best score of a way through each sequence.

    Such tables join like matrices, with + for the product and the maximum for the sum, so blocks of a long sequence
    can be worked on apart without changing its best path.
    """
    n, k = chain.emit.shape
    first, length = _sequences(starts, n)
    best = np.where(np.eye(k, dtype=bool)[None], chain.emit[first][:, None, :], -np.inf)
    for t in range(1, int(length[0]) if n else 0):
        here = int(np.searchsorted(-length, -t))
        rows = first[:here] + t
        step = chain.step(chain.level[rows - 1], chain.level[rows])
        best[:here] = (best[:here, :, :, None] + step[:, None]).max(2) + chain.emit[rows][:, None, :]
    return best[np.argsort(first)]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """work on whole sequences (rows alike in keys stand together), as the batches come; it is given their first rows too."""

    def starts(b: pd.DataFrame) -> np.ndarray:
        key = b[keys]
        return (key != key.shift()).any(axis=1).to_numpy()

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        edge = np.flatnonzero(starts(b))
        new = bool(held) and (held[-1][keys].iloc[-1] != b[keys].iloc[0]).any()
        cut = int(edge[-1]) if len(edge) > 1 or new else 0
        # The sequence in which the batch ends may go on in the next one.
        if cut or new:
            done = pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            yield work(done, starts(done))
            held = []
        held.append(b.iloc[cut:])
    if held:
        done = pd.concat(held, ignore_index=True)
        yield work(done, starts(done))


def decode_powers(df: DataFrame, *, record: str, series: str, day: str, level: str, stated: str, estimate: str, most: int = 200_000) -> DataFrame:
    """(record, power): the power of ten by which each record's amount must be multiplied.

    df has one row per record. series names the key of the sequence (the device), day the date column that orders it,
    level the amount (double, log-scale jumps are taken from its absolute value), stated a power named by text and
    estimate a power suggested by other fields of the record; the last three may be null. Rows with a null series are
    sequences of their own, a null day counts as 1970-01-01. Ties in day follow a hash of record. Empty input gives an
    empty result.

    The path found is the best one over the whole series, however long it is. A series of more than most rows is cut
    into blocks of at most about that many: each block yields the best scores between its first and its last states,
    a pass over these small tables finds the states at which the blocks meet, and then each block is decoded by
    itself. The rows are counted by series and day first, which runs a job.
    """
    day0 = F.unix_date(F.coalesce(F.col(day), F.lit("1970-01-01").cast("date")))
    key = F.coalesce(F.col(series).cast("string"), F.concat(F.lit("\x00"), F.col(record).cast("string")))
    base = df.select(F.col(record).alias("id"), key.alias("s"), day0.alias("d"), F.shiftrightunsigned(F.xxhash64(record), 1).alias("h"), F.col(level).cast("double").alias("v"), F.col(stated).cast("double").alias("w"), F.col(estimate).cast("double").alias("e"))
    states = np.array(STATES, dtype=float)
    k, kind = len(states), dict(df.dtypes)[record]

    def chain(pdf: pd.DataFrame) -> Chain:
        v = pdf["v"].abs().to_numpy(dtype=float, na_value=np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            lv = np.where(v > 0, np.log10(v), np.nan)
        return Chain(lv, pdf["w"].to_numpy(dtype=float, na_value=np.nan), pdf["e"].to_numpy(dtype=float, na_value=np.nan), states)

    def decode(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({record: pdf["id"], "power": viterbi(starts, chain(pdf)).astype("int32")})

    def short(rows: DataFrame) -> DataFrame:
        sorted_ = rows.select("s", "d", "h", "id", "v", "w", "e").repartition("s").sortWithinPartitions("s", "d", "h", "id")
        return sorted_.mapInPandas(lambda batches: _runs(batches, ["s"], decode), f"`{record}` {kind}, power int")

    # Days of long series with the rows before them: the days of a series are few, however many rows they hold.
    whole = Window.partitionBy("s")
    days = base.groupBy("s", "d").agg(F.count("*").alias("n"))
    days = days.withColumns({"total": F.sum("n").over(whole), "before": F.coalesce(F.sum("n").over(whole.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).where(F.col("total") > most)
    layout = cut(days.select("s", "d", F.floor(F.col("before") / most).alias("b"), F.ceil(F.col("n") / most).cast("int").alias("k")))
    if layout.isEmpty():
        return short(base)
    base = cut(base)
    # Days of more rows than a block are cut further, by ranges of the hash that orders their rows.
    hot = F.col("k") > 1
    part = F.when(hot, F.least(F.floor(F.col("h") / F.lit(2.0**63) * F.col("k")).cast("int"), F.col("k") - 1)).otherwise(0)
    keys = ["s", "b", "hot", "p"]
    rows = base.join(layout, ["s", "d"]).select("s", "b", hot.cast("int").alias("hot"), part.alias("p"), "d", "h", "id", "v", "w", "e")
    place = ["d", "h", "id"]

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = chain(pdf.sort_values(place, ignore_index=True))
        m = through(np.arange(len(pdf)) == 0, c)[0]
        return pd.DataFrame({**{n: [x] for n, x in zip(keys, key)}, "first": [c.level[0]], "last": [c.level[-1]], "m": [m.ravel()]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, ignore_index=True)
        m = np.stack(pdf["m"].to_numpy()).reshape(len(pdf), k, k)
        c = chain(pd.DataFrame({"v": [1.0], "w": [np.nan], "e": [np.nan]}))
        steps = c.step(np.append(np.nan, pdf["last"].to_numpy(float)[:-1]), pdf["first"].to_numpy(float))
        enter, at, leave = np.zeros((len(pdf), k)), np.zeros((len(pdf), k)), np.zeros(len(pdf), dtype=int)
        for i in range(len(pdf)):
            if i:
                enter[i] = (at[i - 1][:, None] + steps[i]).max(0)
            at[i] = (enter[i][:, None] + m[i]).max(0)
        for i in range(len(pdf) - 1, -1, -1):
            leave[i] = at[i].argmax() if i + 1 == len(pdf) else (at[i] + steps[i + 1][:, begin]).argmax()
            begin = int((enter[i] + m[i][:, leave[i]]).argmax())
        return pdf[keys].assign(enter=list(enter), leave=leave.astype("int32"))

    def decode_block(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place, ignore_index=True)
        found = viterbi(np.arange(len(pdf)) == 0, chain(pdf), np.stack(ends["enter"].to_numpy()), ends["leave"].to_numpy())
        return pd.DataFrame({record: pdf["id"], "power": found.astype("int32")})

    names = "s string, b bigint, hot int, p int"
    blocks = rows.groupBy(*keys).applyInPandas(summary, f"{names}, first double, last double, m array<double>")
    ends = blocks.groupBy("s").applyInPandas(meet, f"{names}, enter array<double>, leave int")
    long = rows.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInPandas(decode_block, f"`{record}` {kind}, power int")
    return short(base.join(layout.select("s").distinct(), "s", "left_anti")).unionByName(long)


def currency_of(df: DataFrame, *, key: str, currency: str) -> DataFrame:
    """(key, main_currency): the currency that a key's rows name most often, the first by name among equals."""
    counts = df.where(F.col(currency).isNotNull() & F.col(key).isNotNull()).groupBy(key, currency).count()
    return counts.groupBy(key).agg(F.min_by(F.col(currency), F.struct(-F.col("count"), F.col(currency))).alias("main_currency"))


def scaled_down(amount_milli: Column, power: Column, rate_micros: Column) -> Column:
    """floor(amount x 10**power x rate): amount in thousandths and rate in millionths, all in exact decimal arithmetic."""
    up = F.call_function("power", F.lit(10.0), F.greatest(power, F.lit(0))).cast("decimal(13,0)")
    down = F.when(power < 0, F.call_function("power", F.lit(10.0), -power)).otherwise(F.lit(1.0)).cast("decimal(13,0)")
    n = (amount_milli.cast("decimal(19,0)") * rate_micros.cast("decimal(12,0)")).cast("decimal(31,0)") * up
    m = (down * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(23,0)")
    n, m = n.cast("decimal(38,0)"), m.cast("decimal(38,0)")
    return ((n - F.pmod(n, m)) / m).cast("bigint")
