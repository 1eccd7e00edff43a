"""What comes before a row in the order of its key, for keys of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import Scratch

#: Rows of a key from which its order is cut into slices, and the most slices there are.
HOT_ROWS, MOST_SLICES = 1_000_000, 4096


def sliced(df: DataFrame, key: str, order: str, hot: int = HOT_ROWS, total: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``__at``, and whether any key is hot: 0 for keys of up to ``hot`` rows, which are ordered as
    they are; the order of larger ones is cut at approximate quantiles into slices of about that size.

    A table of up to ``hot`` rows costs a count (none, if ``total`` says that it has no more than so many);
    larger ones a count by key, combined before its shuffle.
    The quantiles, ``MOST_SLICES`` numbers at most, are all that the driver gets."""
    if (df.count() if total is None else total) <= hot:
        return df.withColumn("__at", F.lit(0)), False
    large = df.groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > hot)
    most = large.agg(F.max("count")).first()[0]
    if not most:
        return df.withColumn("__at", F.lit(0)), False
    slices = min(MOST_SLICES, 2 * math.ceil(most / hot))
    df = df.join(large.select("__hot", F.lit(True).alias("__large")), F.col(key).eqNullSafe(F.col("__hot")), "left").drop("__hot")
    bounds = df.where("__large").select(F.percentile_approx(order, [i / slices for i in range(1, slices)], 20 * slices).alias("q")).first()["q"]
    at = F.when(F.col("__large"), place(sorted(set(bounds)), F.col(order))).otherwise(0)
    return df.withColumn("__at", at).drop("__large"), True


def place(bounds: list, value: Column) -> Column:
    """How many of the sorted ``bounds`` lie below a value, by two steps of about a root of them each."""
    step = max(1, math.isqrt(len(bounds)))
    some = lambda xs: F.size(F.filter(xs, lambda b: b < value))
    block = some(F.array(*map(F.lit, bounds[step - 1 :: step])))
    return block * step + some(F.slice(F.array(*map(F.lit, bounds)), block * step + 1, F.lit(step)))


def handed_on(rows: DataFrame, key: str, facts: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """``rows`` (sliced) with what the earlier slices of their key hand over: ``facts`` are aggregated for each
    slice, ``carried`` taken from them over the slices of a key, a row each."""
    parts = rows.groupBy(key, "__at").agg(*[v.alias(n) for n, v in facts.items()]).withColumns(carried)
    parts = parts.select(F.col(key).alias("__k"), F.col("__at").alias("__s"), *carried)
    return rows.join(parts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__at") == F.col("__s")), "left").drop("__k", "__s")


def slices_before(key: str):
    return Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)


def last_before(wanted: DataFrame, events: DataFrame, key: str, order: str, value: str, hot: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """``wanted`` with ``value`` of the last row of ``events`` (key, order, value) that has the same key and a
    smaller order; null if there is none or the key is null."""
    names = wanted.columns
    rows = wanted.where(F.col(key).isNotNull()).withColumns({"__event": F.lit(0), value: F.lit(None).cast(events.schema[value].dataType)})
    rows = rows.unionByName(events.where(F.col(key).isNotNull()).select(key, order, value, F.lit(1).alias("__event")), allowMissingColumns=True)
    rows, hot_keys = sliced(rows, key, order, hot, total)
    if hot_keys:
        last = F.max_by(value, F.when(F.col("__event") == 1, F.col(order)))
        rows = handed_on(rows, key, {"__last": last}, {"__earlier": F.last("__last", ignorenulls=True).over(slices_before(key))})
    w = Window.partitionBy(key, "__at").orderBy(order, "__event").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(value, ignorenulls=True).over(w)
    rows = rows.withColumn(value, F.coalesce(found, F.col("__earlier")) if hot_keys else found)
    return rows.where("__event = 0").select(*names, value).unionByName(wanted.where(F.col(key).isNull()), allowMissingColumns=True)


def numbered(df: DataFrame, key: str, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with each row's place (from 1) among its key's in the given order.  Rows are dealt by ranges of key
    and order, so a key of any size is spread; a task numbers its own, and counts of the ranges before are added."""
    rows = scratch.put(df.repartitionByRange(key, *order).withColumn("__at", F.spark_partition_id()))
    rows = handed_on(rows, key, {"__n": F.count(F.lit(1))}, {"__before": F.sum("__n").over(slices_before(key))})
    place = F.row_number().over(Window.partitionBy(key, "__at").orderBy(*order))
    return rows.withColumn(name, (place + F.coalesce("__before", F.lit(0))).cast("int")).drop("__at", "__before")
