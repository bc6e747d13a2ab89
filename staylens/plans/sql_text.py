"""SQL (DuckDB) forms of the derived inputs and keyword expressions."""

from __future__ import annotations

from staylens.functions.constants import (
    ANSWER_TEXTS, EVENT_ENDPOINTS, LEAD_CONTEXT, LEAD_PHRASE, LEAD_WORDS, MONTH_WORDS,
    QUESTION_YEARS, QUESTIONS, ROUTE_RULES,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def _has(col: str, word: str) -> str:
    return f"(strpos({col}, {q(word)}) > 0)"


def _any(col: str, words) -> str:
    return "(" + " OR ".join(_has(col, w) for w in words) + ")"


def route_sql(text: str) -> str:
    low = f"lower({text})"
    whens = []
    for name, groups in ROUTE_RULES:
        cond = " AND ".join(_any(low, g) for g in groups)
        whens.append(f"WHEN {cond} THEN {q(name)}")
    lead = f"{_has(low, LEAD_PHRASE)} OR ({_any(low, LEAD_WORDS)} AND {_has(low, LEAD_CONTEXT)})"
    whens.append(f"WHEN {lead} THEN 'lead'")
    return "CASE " + " ".join(whens) + " END"


def month_sql(text: str) -> str:
    low = f"lower({text})"
    return ("CAST(CASE " + " ".join(f"WHEN {_has(low, m)} THEN {i + 1}" for i, m in enumerate(MONTH_WORDS))
            + " END AS INTEGER)")


def year_sql(text: str) -> str:
    return ("CAST(CASE " + " ".join(f"WHEN {_has(text, str(y))} THEN {y}" for y in QUESTION_YEARS)
            + " END AS INTEGER)")


def hotel_sql(text: str) -> str:
    low = f"lower({text})"
    return (f"CASE WHEN {_has(low, 'resort')} THEN 'Resort Hotel' "
            f"WHEN {_has(low, 'city')} THEN 'City Hotel' END")


def question_text_sql(event_id: str) -> str:
    return f"list_extract({sql_list(QUESTIONS)}, CAST({event_id} % {len(QUESTIONS)} + 1 AS INTEGER))"


QUESTIONS_CTE = f"""
questions AS (SELECT event_id AS question_id, {question_text_sql('event_id')} AS text FROM events)"""

ROUTED_CTE = f"""
routed0 AS (SELECT question_id, text, {route_sql('text')} AS route FROM questions),
routed AS (
  SELECT question_id, text, route,
         CASE WHEN route = 'revenue' THEN {month_sql('text')} END AS month,
         CASE WHEN route = 'revenue' THEN {year_sql('text')} END AS year,
         CASE WHEN route = 'lead' THEN {hotel_sql('text')} END AS hotel
  FROM routed0)"""

QUERY_LOG_CTE = f"""
query_log AS (SELECT event_id + 1 AS query_id, {question_text_sql('event_id')} AS query_text,
                     CAST(ts AS TIMESTAMP) AS timestamp, value AS execution_time FROM events)"""

_ENDPOINT_CASE = "CASE event_type " + " ".join(
    f"WHEN {q(e)} THEN {q(p)}" for e, p in EVENT_ENDPOINTS) + " END"

REQUEST_LOG_CTE = f"""
request_log AS (
  SELECT {_ENDPOINT_CASE} AS endpoint,
         CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status_code,
         value AS execution_time, event_type <> 'error' AS success,
         CASE WHEN event_type IN ('click', 'purchase') THEN {question_text_sql('event_id')} END AS question
  FROM events)"""

ANSWERS_CTE = f"""
answers AS (
  SELECT event_id AS question_id, {question_text_sql('event_id')} AS question,
         list_extract({sql_list(ANSWER_TEXTS)}, CAST(event_id % {len(ANSWER_TEXTS)} + 1 AS INTEGER)) AS answer,
         value AS execution_time, CAST(event_id % 10 AS INTEGER) AS context_count
  FROM events)"""
