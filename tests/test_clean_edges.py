"""Hand-written edge rows for cleaning."""

import datetime as dt

from pyspark.sql import functions as F

from staylens.operators import clean as C
from staylens.sources.files import RAW_SCHEMA

BASE = dict(booking_id=1, hotel="City Hotel", is_canceled=0, lead_time=10, arrival_date_year=2017,
            arrival_date_month="July", arrival_date_day_of_month=1, stays_in_weekend_nights=1,
            stays_in_week_nights=2, adults=2, children=0.0, babies=0, meal="BB", country="PRT",
            market_segment="Direct", reserved_room_type="A", agent=1.0, company=1.0, adr="100.0")


def frame(spark, rows):
    data = [tuple({**BASE, **r}[f.name] for f in RAW_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_guest_filter_uses_imputed_children(spark):
    df = frame(spark, [dict(booking_id=1, adults=0, children=None, babies=0),
                       dict(booking_id=2, adults=None, children=0.0, babies=0),
                       dict(booking_id=3, adults=0, children=0.0, babies=0),
                       dict(booking_id=4, adults=0, children=1.0, babies=0)])
    kept = sorted(r.booking_id for r in C.clean_bookings(df).collect())
    assert kept == [2, 4]


def test_impute_and_meal(spark):
    df = frame(spark, [dict(country=None, meal="Undefined", agent=None, company=None)])
    r = C.clean_bookings(df).first()
    assert (r.country, r.meal, r.agent, r.company) == ("Unknown", "SC", 0.0, 0.0)


def test_unknown_month_and_impossible_date(spark):
    df = frame(spark, [dict(booking_id=1, arrival_date_month="Foo"),
                       dict(booking_id=2, arrival_date_month="February", arrival_date_day_of_month=30),
                       dict(booking_id=3)])
    got = {r.booking_id: (r.arrival_date_month_num, r.arrival_date)
           for r in C.clean_bookings(df).collect()}
    assert got[1] == (None, None)
    assert got[2] == (2, None)
    assert got[3] == (7, dt.date(2017, 7, 1))


def test_adr_coercion(spark):
    cases = {"abc": 0.0, "1,000": 0.0, "": 0.0, "nan": 0.0, "1d": 0.0,
             " 12.5 ": 12.5, "1e3": 1000.0, "-6.38": -6.38}
    df = frame(spark, [dict(booking_id=i, adr=a) for i, a in enumerate(cases)])
    got = {r.booking_id: r.adr for r in C.clean_bookings(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_revenue_keeps_negative_rate(spark):
    df = frame(spark, [dict(adr="-6.38", stays_in_weekend_nights=1, stays_in_week_nights=1)])
    r = C.clean_bookings(df).first()
    assert r.total_stay_duration == 2 and abs(r.revenue + 12.76) < 1e-9


def test_quality_report_counts(spark):
    df = frame(spark, [dict(booking_id=1, adults=0, children=None, babies=0),
                       dict(booking_id=2, country=None, adr="n/a"),
                       dict(booking_id=3, arrival_date_month="Foo")])
    r = C.quality_report(df).first()
    assert (r.rows_in, r.rows_dropped, r.rows_out) == (3, 1, 2)
    assert (r.country_imputed, r.adr_defaulted, r.month_unknown, r.arrival_date_null) == (1, 1, 1, 1)


def test_empty_input(spark):
    df = frame(spark, [dict()]).where(F.lit(False))
    assert C.clean_bookings(df).count() == 0
    assert C.quality_report(df).first().rows_in == 0


def test_duplicates_flag_off_by_default(spark):
    df = frame(spark, [dict(booking_id=1), dict(booking_id=2)])
    assert C.clean_bookings(df).count() == 2
    assert C.clean_bookings(df, drop_duplicates=True).count() == 1
