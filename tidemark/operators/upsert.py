"""Changes to tables: merge, insert, delete, flags and incremental synchronisation.

All functions are set-based and return the new state of the table; the caller writes it. A batch may hold several
rows per key: the one that comes last by its order wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(parts: Sequence[DataFrame], keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The union of parts with one row per key: of the latest part, within it the greatest order.

    Columns missing in a part are null. The choice is an aggregation with partial results, not a sort. Null keys
    count as keys.
    """
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        both = p if both is None else both.unionByName(p, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "__part"]
    rank = F.struct("__part", *([F.col(order)] if order else []), F.xxhash64(*rest) if rest else F.lit(0))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """stored with batch merged in: fields that a batch row has replace those stored, null fields keep them."""
    b = keep_last([batch], keys, order)
    fields = [c for c in stored.columns if c not in keys]
    new = b.select(*keys, *[(F.col(c) if c in b.columns else F.lit(None)).alias(f"__n_{c}") for c in fields])
    both = stored.join(new, list(keys), "full")
    return both.select(*keys, *[F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c) for c in fields])


def insert_missing(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """stored and those rows of batch whose key it lacks."""
    fresh = keep_last([batch], keys, order).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def delete(stored: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(keys_table.select(*keys).distinct(), list(keys), "left_anti")


def set_flag(stored: DataFrame, keys_table: DataFrame, keys: Sequence[str], flag: str, value, stamp: tuple[str, str] | None = None) -> DataFrame:
    """stored with flag set where the key is listed (soft delete, reactivation), and a stamp column set beside it."""
    hit = keys_table.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = stored.join(hit, list(keys), "left")
    out = out.withColumn(flag, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(flag)))
    if stamp:
        out = out.withColumn(stamp[0], F.when(F.col("__hit"), F.lit(stamp[1])).otherwise(F.col(stamp[0])))
    return out.drop("__hit").select(*stored.columns)


def active(df: DataFrame, flag: str = "active", strict: bool = False) -> DataFrame:
    """Rows not marked 'false' (in any case); a blank or null flag counts as active. With strict only rows marked 'true'."""
    said = F.lower(F.trim(F.col(flag).cast("string")))
    return df.where(F.coalesce(said, F.lit("")) == "true") if strict else df.where(F.coalesce(said, F.lit("")) != "false")


# The columns by which rows of a data set are the same, besides their entity.
DATASETS = {
    "TaiwanStockPrice": ["date"], "TaiwanStockPER": ["date"], "TaiwanStockMonthRevenue": ["date", "revenue_month"], "TaiwanStockShareholding": ["date"], "TaiwanStockFinancialStatements": ["date", "type"], "TaiwanStockBalanceSheet": ["date", "type"],
    "TaiwanStockCashFlowsStatement": ["date", "type"], "TaiwanStockDividend": ["date"], "TaiwanStockDividendResult": ["date"], "TaiwanStockInstitutionalInvestorsBuySell": ["date", "name"], "TaiwanStockMarginPurchaseShortSale": ["date"],
}


def merge_datasets(stored: DataFrame, new: DataFrame, *, dataset: str = "dataset", entity: str = "entity", order: str | None = None, registry: dict[str, list[str]] = DATASETS) -> DataFrame:
    """stored with new merged in, both with rows of many data sets: of rows that are the same by their data set's columns
    (those present) the latest counts, new before stored, then by order. Data sets that aren't registered raise nothing:
    their rows are the same only if all columns are."""
    columns = list(dict.fromkeys([*stored.columns, *new.columns]))
    case = F.to_json(F.struct(*[F.col(c) for c in columns if c != order]))
    for name, keys in registry.items():
        present = [c for c in keys if c in columns]
        case = F.when(F.col(dataset) == name, F.to_json(F.struct(*[F.col(c) for c in present]), {"ignoreNullFields": "false"})).otherwise(case)
    wide = [p.select(*[F.col(c) if c in p.columns else F.lit(None).alias(c) for c in columns]).withColumn("__same", case) for p in (stored, new)]
    return keep_last(wide, [dataset, entity, "__same"], order).select(*columns)


def sync(stored: DataFrame, source: DataFrame, keys: Sequence[str], day: str, entity: Sequence[str] | None = None) -> DataFrame:
    """stored brought up to date: of each entity (by default the keys but the day) the source rows from its own last
    stored day on replace and extend it, so that the last day's corrections are taken over and an entity that lags
    loses no days. Entities not stored yet come whole. Applying the same source again changes nothing."""
    by = list(entity if entity is not None else [k for k in keys if k != day])
    if by:
        since = stored.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max(day).alias("__since"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        late = source.join(since, same, "left")
    else:
        late = source.join(F.broadcast(stored.agg(F.max(day).alias("__since"))), F.lit(True), "left")
    late = late.where(F.col("__since").isNull() | (F.col(day) >= F.col("__since"))).select(*source.columns)
    return keep_last([stored, late], keys, None)


def metadata(df: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, first_day, last_day)."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
