"""File sources and sinks for bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw bookings as text-first CSV: ``adr`` stays text so the cleaning rules
# decide what counts as a number; nullable ids are doubles.
RAW_SCHEMA = T.StructType([
    T.StructField("booking_id", T.LongType()),
    T.StructField("hotel", T.StringType()),
    T.StructField("is_canceled", T.IntegerType()),
    T.StructField("lead_time", T.IntegerType()),
    T.StructField("arrival_date_year", T.IntegerType()),
    T.StructField("arrival_date_month", T.StringType()),
    T.StructField("arrival_date_day_of_month", T.IntegerType()),
    T.StructField("stays_in_weekend_nights", T.IntegerType()),
    T.StructField("stays_in_week_nights", T.IntegerType()),
    T.StructField("adults", T.IntegerType()),
    T.StructField("children", T.DoubleType()),
    T.StructField("babies", T.IntegerType()),
    T.StructField("meal", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("market_segment", T.StringType()),
    T.StructField("reserved_room_type", T.StringType()),
    T.StructField("agent", T.DoubleType()),
    T.StructField("company", T.DoubleType()),
    T.StructField("adr", T.StringType()),
])

PARTITION_COLUMNS = ["arrival_date_year", "arrival_date_month_num"]
SORT_COLUMNS = ["hotel", "country"]


def read_raw_bookings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Header CSV (or Parquet) with a declared schema, no inference pass."""
    if fmt == "csv":
        return spark.read.schema(RAW_SCHEMA).option("header", True).csv(path)
    return spark.read.parquet(path).select(*[f.name for f in RAW_SCHEMA.fields])


def write_clean_csv(df: DataFrame, path: str) -> None:
    """Header CSV; the folder is created by the writer."""
    df.write.mode("overwrite").option("header", True).csv(path)


ROWS_PER_FILE = 1_000_000


def write_clean_table(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE,
                      table: str | None = None) -> None:
    """S3 + S4: full replace, partitioned by arrival year/month.

    A first pass counts the rows of each month (one row a month, broadcast);
    a month gets a writer task and a file for each ``rows_per_file`` of its
    rows (a hash of the booking id deals them), so a month holding a third of
    all bookings is still written in parallel.  Inside each file rows are sorted by hotel and
    country, which gives Parquet row-group min/max statistics that skip data
    for the lookups the original served with B-tree indexes.
    """
    months = df.groupBy(*PARTITION_COLUMNS).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_files"))
    months = months.select(*[F.col(c).alias(f"_{c}") for c in PARTITION_COLUMNS], "_files")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTITION_COLUMNS]
    dealt = df.join(F.broadcast(months), same[0] & same[1])
    salt = F.pmod(F.xxhash64("booking_id"), F.col("_files"))
    out = (dealt.repartition(*[F.col(c) for c in PARTITION_COLUMNS], salt)
           .sortWithinPartitions(*PARTITION_COLUMNS, *SORT_COLUMNS).select(*df.columns))
    # adaptive execution may join small writer tasks again; the bound on rows still holds for their files
    writer = out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*PARTITION_COLUMNS)
    if table:
        writer.option("path", path).saveAsTable(table)
    else:
        writer.parquet(path)
