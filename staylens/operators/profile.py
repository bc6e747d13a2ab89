"""Profiling (P1-P6): one aggregate pass each, reshaped to long form."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.columns import round_half_up
from staylens.operators.evaluation import counted_values, quantiles_of_counts

NUMERIC_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)


def preview(df: DataFrame, n: int = 5, key: str = "booking_id") -> DataFrame:
    """First n rows by key (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(key).limit(n)


def column_info(df: DataFrame) -> DataFrame:
    """Non-null count and type of every column, in one aggregate."""
    cols = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column_name", "non_null_count")
    types = F.create_map(*chain.from_iterable(
        (F.lit(f.name), F.lit(f.dataType.simpleString())) for f in df.schema.fields))
    return long.select("column_name", "non_null_count",
                       F.element_at(types, F.col("column_name")).alias("data_type"))


def null_counts(df: DataFrame, stage: str | None = None) -> DataFrame:
    """Nulls per column (NaN is not null here), in one aggregate."""
    cols = df.columns
    sums = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in cols])
    long = sums.unpivot([], cols, "column_name", "null_count")
    return long if stage is None else long.select(F.lit(stage).alias("stage"), "*")


def numeric_columns(df: DataFrame, exclude=("booking_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def describe(df: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per numeric column.

    The columns are laid out as (column_name, value) rows and equal values counted, in one pass over the
    table; moments and quartiles come from the stored counts.
    """
    cols = cols or numeric_columns(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("r")) \
        .select("r.column_name", "r.x")
    counts = counted_values(long, "column_name", "x")
    c, v = F.col("c").cast("double"), F.col("v")
    n = F.sum(F.when(v.isNotNull(), F.col("c")).otherwise(0))
    mean = F.try_divide(F.sum(v * c), F.sum(F.when(v.isNotNull(), c)))
    base = counts.groupBy("k").agg(n.alias("count"), mean.alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    spread = counts.join(base.select("k", "mean"), "k").groupBy("k").agg(
        F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"))
    rows = base.join(spread, "k").select(
        F.col("k").alias("column_name"), "count", "mean",
        F.sqrt(F.try_divide(F.col("squares"), F.when(F.col("count") > 1, F.col("count") - 1))).alias("std"), "min", "max")
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75]).groupBy(F.col("k").alias("column_name")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
    rows = rows.join(q, "column_name", "left")
    return rows.select("column_name", "count",
                       *[round_half_up(F.col(c), digits).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """P5: count per value, most frequent first."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), col))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame (no driver round trip)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
