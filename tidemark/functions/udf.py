"""Functions of the caller's own, in Arrow batches: scalar maps, aggregates over a group's values, and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped(f: Callable, kind: str, skip_nulls: bool = True) -> Callable[[Column], Column]:
    """A column function that applies f to each value; nulls stay null without asking f, unless skip_nulls is off."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if skip_nulls and pd.isna(x) else f(x)).astype(object)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


def vectorised(f: Callable[[pd.Series], pd.Series], kind: str) -> Callable[[Column], Column]:
    """A column function that applies f to whole batches of values."""

    def run(values: pd.Series) -> pd.Series:
        return f(values)

    g = F.pandas_udf(run, kind)
    return lambda c: g(F.col(c) if isinstance(c, str) else c)


def folded(df: DataFrame, by: list[str], value: str, *, part: Callable[[pd.Series], tuple], merge: Callable[[list[tuple]], float], state: str, name: str, kind: str = "double") -> DataFrame:
    """(by, name): an aggregate in two steps, so that no task holds a group: part gives the state of the values of a
    batch (a tuple in the form of the schema state), merge the result from a group's states, of which there's one for
    each batch and group."""
    types = dict(df.dtypes)
    fields = [x.split(":")[0].strip() for x in state.split(",")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), *part(g["v"])) for k, g in b.groupby(by, dropna=False)]
            yield pd.DataFrame(rows, columns=[*by, *fields])

    def last(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, merge([tuple(r) for r in g[fields].itertuples(index=False)]))], columns=[*by, name])

    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    states = df.select(*by, F.col(value).alias("v")).mapInPandas(partial, f"{keys}, {state.replace(':', ' ')}")
    return states.groupBy(*by).applyInPandas(last, f"{keys}, {name} {kind}")


def table_function(f: Callable[..., Iterator[tuple]], schema: str):
    """A table function: f gives the rows of one call. To be called with lateralJoin or in SQL after registration."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    return F.udtf(Rows, returnType=schema)
