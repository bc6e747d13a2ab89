"""Fixed values that must equal the behaviour being matched.

Everything in this module is data, not logic: word lists, labels and
question texts that decide routing, binning and scoring results.
"""

# --- fixed values: calendar month names, in calendar order -------------
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# --- fixed values: years searched for in a question, first match wins ---
QUESTION_YEARS = list(range(2015, 2023))

# --- fixed values: lead-time bins (right-closed edges and labels) -------
LEAD_TIME_EDGES = [0, 7, 30, 90, 180, 365]  # last bin is (365, inf)
LEAD_TIME_LABELS = [
    "0-7 days", "8-30 days", "31-90 days", "91-180 days", "181-365 days", "365+ days",
]

# --- fixed values: keyword rules of the question router, in rule order --
# Each rule is (route, all-of groups); a group matches when any word in it
# is a substring of the lower-cased question.
MONTH_WORDS = [m.lower() for m in MONTH_NAMES]
ROUTE_RULES = [
    ("revenue", [["revenue"], MONTH_WORDS]),
    ("cancellation", [["cancellation"], ["location", "country", "where", "place"]]),
    ("average", [["average"], ["price", "rate", "cost", "adr"]]),
    ("room", [["room", "type", "accommodation"],
              ["common", "most", "popular", "frequently", "booked"]]),
    ("distribution", [["distribution", "breakdown"],
                      ["country", "countries", "geographic", "location", "region"]]),
    ("stay", [["stay"], ["hotel"], ["long", "duration", "length"]]),
]
# The lead-time rule is an OR: "lead time", or ("lead" or "advance") and "booking".
LEAD_PHRASE = "lead time"
LEAD_WORDS = ["lead", "advance"]
LEAD_CONTEXT = "booking"

# --- fixed values: question set (15 evaluation + 8 sample questions) ----
QUESTIONS = [
    "What was the total revenue for July 2017?",
    "Which month had the highest revenue in 2016?",
    "What is the average revenue per booking for Resort Hotels?",
    "Which country has the highest cancellation rate?",
    "What is the overall cancellation rate for all bookings?",
    "Does the City Hotel or Resort Hotel have a higher cancellation rate?",
    "What is the average daily rate for a booking?",
    "Which room type has the highest average price?",
    "How does the price vary between weekdays and weekends?",
    "What is the average lead time for bookings?",
    "Do customers who book far in advance tend to pay more or less?",
    "Is there a correlation between lead time and cancellation rate?",
    "What is the most popular time of year for bookings, and does it differ between hotel types?",
    "Which market segment has the lowest cancellation rate but highest average daily rate?",
    "How do booking patterns differ between repeat and non-repeat guests?",
    "Show me total revenue for July 2017.",
    "Which locations had the highest booking cancellations?",
    "What is the average price of a hotel booking?",
    "What is the average lead time for Resort Hotel bookings?",
    "Which market segment has the highest cancellation rate?",
    "What is the distribution of bookings across different countries?",
    "How long do guests typically stay in City Hotels vs Resort Hotels?",
    "What is the most common room type booked?",
]

# --- fixed values: keyword ground truth for three evaluation questions --
# (question, keywords, contains_number, contains_currency, contains_country)
GROUND_TRUTH = [
    ("What was the total revenue for July 2017?",
     ["revenue", "july", "2017"], True, False, False),
    ("Which country has the highest cancellation rate?",
     ["country", "cancellation", "rate", "highest"], False, False, True),
    ("What is the average daily rate for a booking?",
     ["average", "daily", "rate", "price"], True, True, False),
]
COUNTRY_WORDS = ["usa", "uk", "portugal", "spain", "france", "germany", "italy"]
CURRENCY_WORDS = ["$", "usd", "dollars"]
NUMBER_PATTERN = r"\d+(\.\d+)?"

# --- fixed values: stored insight ids and their types -------------------
INSIGHT_TYPES = [
    ("revenue_trends", "time_series"),
    ("cancellation_rate", "statistics"),
    ("geographical_distribution", "geographic"),
    ("lead_time_distribution", "distribution"),
    ("additional_insights", "composite"),
]
INSIGHT_DESCRIPTIONS = {
    "revenue_trends": "Monthly revenue trends over time",
    "cancellation_rate": "Cancellation rates overall and by hotel type",
    "geographical_distribution": "Geographical distribution of bookings by country",
    "lead_time_distribution": "Distribution of booking lead times",
    "additional_insights": "Additional booking insights and patterns",
}

# --- fixed values: prompt wording -----------------------------------------
NO_CONTEXT_TEXT = "No specific context found in the database."
PROMPT_HEAD = (
    "You are a hotel booking analytics assistant. Answer the following question "
    "based on the provided context.\n"
    "Only use information from the context provided. If you can't answer based on "
    "the context, acknowledge that."
)

# --- fixed values: fixture derivations from the driver tables ------------
# answers text picked by event_id % 5
ANSWER_TEXTS = [
    "Total revenue for July 2017 was $100.50",
    "Portugal has the highest cancellation rate of any country",
    "The average daily rate (price) is 80 USD",
    "No data",
    "Error generating response: timeout",
]
# request endpoint per event type
EVENT_ENDPOINTS = [
    ("view", "/analytics"),
    ("click", "/ask"),
    ("purchase", "/ask"),
    ("signup", "/health"),
    ("error", "/analytics"),
]
# meal code per order priority (anything else -> SC)
PRIORITY_MEALS = [
    ("1-URGENT", "BB"),
    ("2-HIGH", "HB"),
    ("3-MEDIUM", "FB"),
    ("4-NOT SPECIFIED", "Undefined"),
]
