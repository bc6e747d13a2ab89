"""Router golden test: the 23 questions and their expected routes."""

from staylens.functions.constants import QUESTIONS
from staylens.operators.routing import route_questions

# (route, month, year, hotel) per question, in question order
EXPECTED = [
    ("revenue", 7, 2017, None), (None, None, None, None), (None, None, None, None),
    ("cancellation", None, None, None), (None, None, None, None), (None, None, None, None),
    ("average", None, None, None), ("average", None, None, None), (None, None, None, None),
    ("lead", None, None, None), (None, None, None, None), ("lead", None, None, None),
    ("room", None, None, None), ("average", None, None, None), (None, None, None, None),
    ("revenue", 7, 2017, None), ("cancellation", None, None, None), ("average", None, None, None),
    ("lead", None, None, "Resort Hotel"), (None, None, None, None),
    ("distribution", None, None, None), ("stay", None, None, None), ("room", None, None, None),
]


def test_routes(spark):
    q = spark.createDataFrame([(i + 1, t) for i, t in enumerate(QUESTIONS)], "question_id long, text string")
    got = {r.question_id: (r.route, r.month, r.year, r.hotel) for r in route_questions(q).collect()}
    assert [got[i + 1] for i in range(len(QUESTIONS))] == EXPECTED


def test_month_in_calendar_order_and_maybe(spark):
    q = spark.createDataFrame([(1, "revenue maybe in march or january 2016 and 2015?")],
                              "question_id long, text string")
    r = route_questions(q).first()
    assert (r.route, r.month, r.year) == ("revenue", 1, 2015)


def test_empty_period_gives_nulls(spark, sf_small):
    from staylens.operators.routing import revenue_for_period
    from staylens.plans.context import bookings

    q = spark.createDataFrame([(1, "revenue for june 2022")], "question_id long, text string")
    r = revenue_for_period(route_questions(q), bookings(spark, sf_small)).first()
    assert r.booking_count == 0 and r.total_revenue is None and r.avg_daily_rate is None
