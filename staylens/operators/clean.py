"""Cleaning (C1-C10): one narrow projection, no shuffle.

Rule order matters: imputation runs before the empty-booking filter, so a
missing ``children`` counts as 0 in the guest test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.columns import coerce_numeric, count_if, month_number

IMPUTE_DEFAULTS = {"country": "Unknown", "agent": 0.0, "company": 0.0, "children": 0.0}

CLEAN_COLUMNS = [
    "booking_id", "hotel", "is_canceled", "lead_time", "arrival_date_year",
    "arrival_date_month", "arrival_date_day_of_month", "stays_in_weekend_nights",
    "stays_in_week_nights", "adults", "children", "babies", "meal", "country",
    "market_segment", "reserved_room_type", "agent", "company", "adr",
    "arrival_date_month_num", "arrival_date", "total_stay_duration", "revenue",
]


def impute(df: DataFrame) -> DataFrame:
    """Country -> 'Unknown'; agent, company, children -> 0."""
    return df.fillna(IMPUTE_DEFAULTS)


def empty_booking(adults: Column, children: Column, babies: Column) -> Column:
    """True when all three guest counts are known and zero (null is not zero)."""
    zero = F.lit(0)
    return adults.eqNullSafe(zero) & children.eqNullSafe(zero) & babies.eqNullSafe(zero)


def drop_empty_bookings(df: DataFrame) -> DataFrame:
    """Drop bookings with 0 adults, 0 children and 0 babies."""
    return df.where(~empty_booking(F.col("adults"), F.col("children"), F.col("babies")))


def replace_meal(df: DataFrame, old: str = "Undefined", new: str = "SC") -> DataFrame:
    """C3."""
    return df.withColumn("meal", F.when(F.col("meal") == old, F.lit(new)).otherwise(F.col("meal")))


def arrival_date(year: Column, month_num: Column, day: Column) -> Column:
    """A date, or null for an impossible one (other rows keep theirs)."""
    return F.try_make_timestamp(year, month_num, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def derive(df: DataFrame) -> DataFrame:
    """Month number, arrival date, numeric adr, stay length, revenue."""
    month_num = month_number(F.col("arrival_date_month"))
    adr = coerce_numeric(F.col("adr"))
    stay = (F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")).cast("int")
    return (df
            .withColumn("arrival_date_month_num", month_num)
            .withColumn("arrival_date", arrival_date(F.col("arrival_date_year"),
                                                     F.col("arrival_date_month_num"),
                                                     F.col("arrival_date_day_of_month")))
            .withColumn("adr", adr)
            .withColumn("total_stay_duration", stay)
            .withColumn("revenue", F.col("adr") * F.col("total_stay_duration")))


def clean_bookings(raw: DataFrame, drop_duplicates: bool = False) -> DataFrame:
    """C1-C8 as one narrow plan (Catalyst collapses it into one Project+Filter)."""
    df = derive(replace_meal(drop_empty_bookings(impute(raw))))
    if drop_duplicates:  # off by default, as in the original
        df = df.dropDuplicates([c for c in df.columns if c != "booking_id"])
    return df.select(*CLEAN_COLUMNS)


def quality_report(raw: DataFrame) -> DataFrame:
    """The before/after counts of cleaning, in one pass over the raw rows."""
    children0 = F.coalesce(F.col("children"), F.lit(0.0))
    dropped = empty_booking(F.col("adults"), children0, F.col("babies"))
    kept = ~dropped
    adr_num = F.trim(F.col("adr")).rlike(
        r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$")
    adr_val = F.when(adr_num, F.trim(F.col("adr")).try_cast("double"))
    adr_defaulted = adr_val.isNull() | F.isnan(adr_val)
    month_ok = month_number(F.col("arrival_date_month")).isNotNull()
    date_null = arrival_date(F.col("arrival_date_year"),
                             month_number(F.col("arrival_date_month")),
                             F.col("arrival_date_day_of_month")).isNull()
    return raw.agg(
        F.count(F.lit(1)).alias("rows_in"),
        count_if(dropped).alias("rows_dropped"),
        count_if(kept).alias("rows_out"),
        count_if(kept & F.col("country").isNull()).alias("country_imputed"),
        count_if(kept & F.col("agent").isNull()).alias("agent_imputed"),
        count_if(kept & F.col("company").isNull()).alias("company_imputed"),
        count_if(kept & F.col("children").isNull()).alias("children_imputed"),
        count_if(kept & (F.col("meal") == "Undefined")).alias("meal_replaced"),
        count_if(kept & adr_defaulted).alias("adr_defaulted"),
        count_if(kept & ~month_ok).alias("month_unknown"),
        count_if(kept & date_null).alias("arrival_date_null"),
    )
