"""Ordered operators that never put a whole key into one window: slices first, then one row per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: list[str], slices: Column, order: list, out: str) -> DataFrame:
    """df with ``out``: 1, 2, 3 … within keys by (slices, order). slices must not fall along order."""
    df = df.withColumn("__slice", slices)
    v = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    base = df.groupBy(*keys, "__slice").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(v), F.lit(0))).drop("__n")
    local = df.withColumn("__k", F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(*order)))
    return local.join(base, [*keys, "__slice"]).withColumn(out, (F.col("__base") + F.col("__k")).cast("long")).drop("__slice", "__k", "__base")


def last_before(df: DataFrame, keys: list[str], slices: Column, order: list, value: Column, out: str) -> DataFrame:
    """df with ``out``: the last non-null value at or before each row within keys."""
    df = df.withColumn("__slice", slices).withColumn("__v", value)
    w = W.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn("__here", F.last("__v", ignorenulls=True).over(w))
    ends = df.groupBy(*keys, "__slice").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__end"))
    v = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(v)).drop("__end")
    return local.join(ends, [*keys, "__slice"]).withColumn(out, F.coalesce("__here", "__before")).drop("__slice", "__v", "__here", "__before")


def islands(df: DataFrame, keys: list[str], slices: Column, order: list, label: Column, out: str) -> DataFrame:
    """df with ``out``: the number, from 1 within keys, of the run of equal labels a row is in."""
    df = df.withColumn("__slice", slices).withColumn("__label", label)
    w = W.partitionBy(*keys, "__slice").orderBy(*order)
    fresh = (~F.col("__label").eqNullSafe(F.lag("__label").over(w)) | (F.row_number().over(w) == 1)).cast("long")
    local = df.withColumn("__new", fresh).withColumn("__k", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "__slice").agg(F.max("__k").alias("__n"), F.min_by("__label", F.struct(*order)).alias("__first"), F.max_by("__label", F.struct(*order)).alias("__last"))
    v = W.partitionBy(*keys).orderBy("__slice")
    joins = (F.col("__first").eqNullSafe(F.lag("__last").over(v)) & (F.row_number().over(v) > 1)).cast("long")
    ends = ends.withColumn("__joins", joins)
    base = F.coalesce(F.sum(F.col("__n") - F.col("__joins")).over(v.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("__joins")
    ends = ends.withColumn("__base", base).select(*keys, "__slice", "__base")
    return local.join(ends, [*keys, "__slice"]).withColumn(out, (F.col("__base") + F.col("__k")).cast("long")).drop("__slice", "__label", "__new", "__k", "__base")


def changes(df: DataFrame, keys: list[str], slices: Column, order: list, value: Column, out: str) -> DataFrame:
    """df with ``out``: true where value differs from the row before, and on the first row."""
    df = df.withColumn("__slice", slices).withColumn("__v", value)
    w = W.partitionBy(*keys, "__slice").orderBy(*order)
    local = df.withColumn("__lag", F.lag("__v").over(w)).withColumn("__top", F.row_number().over(w) == 1)
    v = W.partitionBy(*keys).orderBy("__slice")
    ends = df.groupBy(*keys, "__slice").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(v)).withColumn("__head", F.row_number().over(v) == 1).drop("__end")
    joined = local.join(ends, [*keys, "__slice"])
    before = F.when(F.col("__top"), F.col("__before")).otherwise(F.col("__lag"))
    return joined.withColumn(out, (F.col("__top") & F.col("__head")) | ~F.col("__v").eqNullSafe(before)).drop("__slice", "__v", "__lag", "__top", "__before", "__head")
