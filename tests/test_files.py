"""File sources and sinks: CSV round trip, partitioned table layout."""

from staylens.operators.clean import clean_bookings
from staylens.sources.files import read_raw_bookings, write_clean_csv, write_clean_table
from staylens.sources.tables import raw_bookings


def test_csv_round_trip(spark, sf_small, scratch):
    raw = raw_bookings(spark, sf_small)
    write_clean_csv(raw, f"{scratch}/raw_csv")
    back = read_raw_bookings(spark, f"{scratch}/raw_csv")
    assert back.count() == raw.count()
    assert back.exceptAll(raw).count() == 0


def test_partitioned_table(spark, sf_small, scratch):
    clean = clean_bookings(raw_bookings(spark, sf_small))
    write_clean_table(clean, f"{scratch}/tbl", rows_per_file=1000)
    back = spark.read.parquet(f"{scratch}/tbl")
    assert back.count() == clean.count()
    assert back.select(*clean.columns).exceptAll(clean).count() == 0


def test_heavy_month_has_several_files(spark, sf_small, scratch):
    """A month gets a file for each thousand of its rows, a light month one."""
    import glob

    from pyspark.sql import functions as F

    clean = clean_bookings(raw_bookings(spark, sf_small))
    heavy = clean.where("arrival_date_year = 2017 and arrival_date_month_num = 7").limit(20) \
        .withColumn("booking_id", F.explode(F.sequence(F.lit(10 ** 6), F.lit(10 ** 6 + 299))))
    write_clean_table(clean.unionByName(heavy), f"{scratch}/t", rows_per_file=1000)
    files = [len(glob.glob(f"{m}/*.parquet")) for m in glob.glob(f"{scratch}/t/*/*")]
    july = glob.glob(f"{scratch}/t/arrival_date_year=2017/arrival_date_month_num=7/*.parquet")
    assert len(july) > 1 and sorted(files)[-2] == 1
    assert spark.read.parquet(f"{scratch}/t").count() == clean.count() + heavy.count()
