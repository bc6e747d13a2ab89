"""Registered queries: answer scoring and latency reports."""

from __future__ import annotations

from staylens.functions.constants import COUNTRY_WORDS, CURRENCY_WORDS, GROUND_TRUTH, NUMBER_PATTERN
from staylens.operators import evaluation as V
from staylens.plans.registry import register
from staylens.plans.sql_text import ANSWERS_CTE, REQUEST_LOG_CTE, q, sql_list
from staylens.sources.tables import answers, request_log


def _b(x: bool) -> str:
    return "TRUE" if x else "FALSE"


GT_CTE = "gt(question, keywords, contains_number, contains_currency, contains_country) AS (VALUES " + ", ".join(
    f"({q(qq)}, {sql_list(k)}, {_b(n)}, {_b(c)}, {_b(t)})" for qq, k, n, c, t in GROUND_TRUTH) + ")"


def _any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"strpos({text}, {q(w)}) > 0" for w in words) + ")"


_LOW = "lower(a.answer)"
_EVAL_CTE = f"""
ev AS (
  SELECT a.question_id, a.question, a.answer, a.execution_time, a.context_count,
         length(a.answer) > 10 AS has_answer,
         CASE WHEN g.keywords IS NOT NULL THEN
           CAST(len(list_filter(g.keywords, lambda k: strpos({_LOW}, lower(k)) > 0)) AS DOUBLE)
           / CAST(len(g.keywords) AS DOUBLE) END AS keyword_score,
         CASE WHEN g.keywords IS NOT NULL THEN CASE WHEN g.contains_number THEN
           CASE WHEN regexp_matches({_LOW}, '{NUMBER_PATTERN}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE END END AS number_score,
         CASE WHEN g.keywords IS NOT NULL THEN CASE WHEN g.contains_currency THEN
           CASE WHEN {_any_sql(_LOW, CURRENCY_WORDS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE END END AS currency_score,
         CASE WHEN g.keywords IS NOT NULL THEN CASE WHEN g.contains_country THEN
           CASE WHEN {_any_sql(_LOW, COUNTRY_WORDS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE END END AS country_score
  FROM answers a LEFT JOIN gt g ON a.question = g.question),
ev2 AS (SELECT *, (keyword_score + number_score + currency_score + country_score) / 4.0 AS accuracy_score FROM ev)"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def _ev(body: str) -> str:
    return _with(body, ANSWERS_CTE, GT_CTE, _EVAL_CTE)


def _evaluated(spark, sf_dir):
    return V.evaluate_answers(answers(spark, sf_dir))


for _name, _col in [("v1_has_answer", "has_answer"), ("v2_keyword_score", "keyword_score"),
                    ("v3_number_score", "number_score"), ("v4_currency_score", "currency_score"),
                    ("v5_country_score", "country_score"), ("v6_accuracy_score", "accuracy_score")]:
    def _make(col):
        def fn(spark, sf_dir):
            return _evaluated(spark, sf_dir).select("question_id", col)
        return fn
    register(_name, _ev(f"SELECT question_id, {_col} FROM ev2"))(_make(_col))


_EVAL_COLS = ("question_id, question, answer, execution_time, context_count, has_answer, keyword_score, "
              "number_score, currency_score, country_score, accuracy_score")


@register("v7_evaluate_answers", _ev(f"SELECT {_EVAL_COLS} FROM ev2"))
def v7_evaluate_answers(spark, sf_dir):
    return _evaluated(spark, sf_dir)


def _tavg(x: str) -> str:
    return f"(ROUND(FSUM(CAST({x} AS DOUBLE)), 6) / CAST(COUNT({x}) AS DOUBLE))"


@register("v8_accuracy_summary", _ev(f"""
SELECT COUNT(*) AS questions_tested, COUNT(accuracy_score) AS questions_with_accuracy_score,
       AVG(accuracy_score) AS average_accuracy, {_tavg('execution_time')} AS average_response_time,
       MIN(execution_time) AS min_response_time, MAX(execution_time) AS max_response_time FROM ev2"""))
def v8_accuracy_summary(spark, sf_dir):
    return V.accuracy_summary(_evaluated(spark, sf_dir))


@register("v9_endpoint_summary", _with(f"""
SELECT endpoint, COUNT(*) AS requests, AVG(CAST(success AS DOUBLE)) AS success_rate,
       {_tavg('CASE WHEN success THEN execution_time END')} AS average_response_time
FROM request_log GROUP BY endpoint""", REQUEST_LOG_CTE))
def v9_endpoint_summary(spark, sf_dir):
    return V.endpoint_summary(request_log(spark, sf_dir))


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
SELECT CAST(t.i AS INTEGER) AS bin, b.lo + t.i * ((b.hi - b.lo) / {float(bins)}) AS lower,
       b.lo + (t.i + 1) * ((b.hi - b.lo) / {float(bins)}) AS upper,
       CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
FROM range({bins}) t(i)
CROSS JOIN (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                   CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
            FROM (SELECT MIN(CAST({col} AS DOUBLE)) AS mn, MAX(CAST({col} AS DOUBLE)) AS mx FROM {src}) r
            WHERE mn IS NOT NULL) b
LEFT JOIN (SELECT CAST(LEAST(floor((CAST({col} AS DOUBLE) - b2.lo) * {float(bins)} / (b2.hi - b2.lo)),
                             {bins - 1}) AS INTEGER) AS bin, COUNT(*) AS cnt
           FROM {src}, (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                               CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
                        FROM (SELECT MIN(CAST({col} AS DOUBLE)) AS mn, MAX(CAST({col} AS DOUBLE)) AS mx
                              FROM {src}) r) b2
           WHERE {col} IS NOT NULL GROUP BY 1) c ON c.bin = t.i"""


@register("v10_histogram_accuracy", _ev(_hist_sql("ev2", "accuracy_score", 10)))
def v10_histogram_accuracy(spark, sf_dir):
    return V.histogram(_evaluated(spark, sf_dir), "accuracy_score", 10)


@register("v10_histogram_response_times", _ev(_hist_sql("answers", "execution_time", 15)))
def v10_histogram_response_times(spark, sf_dir):
    return V.histogram(answers(spark, sf_dir), "execution_time", 15)


@register("v11_box_stats", _with("""
SELECT endpoint, COUNT(*) AS successes, MIN(execution_time) AS min,
       floor(quantile_cont(execution_time, 0.25) * 1000000.0 + 0.5) / 1000000.0 AS q1,
       floor(quantile_cont(execution_time, 0.5) * 1000000.0 + 0.5) / 1000000.0 AS median,
       floor(quantile_cont(execution_time, 0.75) * 1000000.0 + 0.5) / 1000000.0 AS q3,
       MAX(execution_time) AS max
FROM request_log WHERE success GROUP BY endpoint""", REQUEST_LOG_CTE))
def v11_box_stats(spark, sf_dir):
    return V.box_stats(request_log(spark, sf_dir))
