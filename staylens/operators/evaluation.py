"""Answer scoring and latency reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions.columns import exact_avg, round_half_up
from staylens.functions.constants import COUNTRY_WORDS, CURRENCY_WORDS, GROUND_TRUTH, NUMBER_PATTERN
from staylens.plans.session import checkpoint_path


def ground_truth(spark: SparkSession) -> DataFrame:
    """The fixed keyword rules (three questions)."""
    return spark.createDataFrame(
        [(q, kws, num, cur, cty) for q, kws, num, cur, cty in GROUND_TRUTH],
        "question string, keywords array<string>, contains_number boolean, "
        "contains_currency boolean, contains_country boolean")


def _any_contains(text, words):
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(text, w) > 0)


def evaluate_answers(answers: DataFrame) -> DataFrame:
    """V1-V7: per answer, the keyword scores against the ground truth.

    ``answers``: question_id, question, answer, execution_time, context_count.
    The rule table has three rows, so it is broadcast.
    """
    gt = F.broadcast(ground_truth(answers.sparkSession))
    j = answers.join(gt, "question", "left")
    low = F.lower(F.col("answer"))
    scored = F.col("keywords").isNotNull()
    kw_hits = F.size(F.filter(F.col("keywords"), lambda k: F.instr(low, F.lower(k)) > 0))
    keyword = F.when(scored, kw_hits.cast("double") / F.size("keywords").cast("double"))
    one, zero = F.lit(1.0), F.lit(0.0)
    number = F.when(scored, F.when(F.col("contains_number"),
                                   F.when(low.rlike(NUMBER_PATTERN), one).otherwise(zero)).otherwise(one))
    currency = F.when(scored, F.when(F.col("contains_currency"),
                                     F.when(_any_contains(low, CURRENCY_WORDS), one).otherwise(zero))
                      .otherwise(one))
    country = F.when(scored, F.when(F.col("contains_country"),
                                    F.when(_any_contains(low, COUNTRY_WORDS), one).otherwise(zero))
                     .otherwise(one))
    out = j.select(
        "question_id", "question", "answer", "execution_time", "context_count",
        (F.length("answer") > 10).alias("has_answer"),
        keyword.alias("keyword_score"), number.alias("number_score"),
        currency.alias("currency_score"), country.alias("country_score"))
    return out.withColumn(
        "accuracy_score",
        (F.col("keyword_score") + F.col("number_score") + F.col("currency_score")
         + F.col("country_score")) / F.lit(4.0))


def accuracy_summary(evaluated: DataFrame) -> DataFrame:
    """V8: one row; mean accuracy over scored answers only."""
    return evaluated.agg(
        F.count(F.lit(1)).alias("questions_tested"),
        F.count("accuracy_score").alias("questions_with_accuracy_score"),
        F.avg("accuracy_score").alias("average_accuracy"),
        exact_avg("execution_time").alias("average_response_time"),
        F.min("execution_time").alias("min_response_time"),
        F.max("execution_time").alias("max_response_time"))


def endpoint_summary(requests: DataFrame) -> DataFrame:
    """V9: per endpoint: requests, success rate, mean time of successes only."""
    return requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        exact_avg(F.when(F.col("success"), F.col("execution_time"))).alias("average_response_time"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins 0.

    min/max is one global aggregate whose two numbers go to the driver;
    each value's bin is then computed in place and counted with a partial
    aggregation.  The bin frame (``bins`` rows) keeps empty bins.
    """
    spark = df.sparkSession
    x = F.col(col).cast("double")
    mn, mx = df.agg(F.min(x), F.max(x)).first()
    if mn is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    lo, hi = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    idx = F.least(F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)),
                  F.lit(bins - 1)).cast("int")
    counts = (df.where(x.isNotNull()).select(idx.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    width = F.lit(hi - lo) / F.lit(float(bins))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(frame).join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))


QUANTILE_BUCKETS = 256
QUANTILE_ROWS = 100_000                # distinct values that may be ranked in one task


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float],
                    partitions: int = QUANTILE_BUCKETS, rows: int = QUANTILE_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles per key without holding a group in one task.

    Equal values are counted first and stored, so that one value repeated without end is one row.
    While a range of values has more than ``rows`` distinct ones, the ranges are split: an approximate
    percentile sketch (bounded in size) gives each ``partitions`` - 1 splitters, bucket counts tell which
    buckets hold wanted ranks, and only their rows stay.  A round divides a range by about ``partitions``.
    The last ranges are ranked value by value.  Only the largest range's size reaches the driver.
    Result: key, p, q; nulls are left out.
    """
    return quantiles_of_counts(counted_values(df, key, value), probs, partitions, rows).withColumnRenamed("k", key)


def _held(frame: DataFrame) -> DataFrame:
    path = checkpoint_path(frame.sparkSession, f"quantiles_{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def counted_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v, c): how often each value, null among them, stands with each key; stored, so the input is read once."""
    return _held(df.groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))


def quantiles_of_counts(counted: DataFrame, probs: list[float], partitions: int = QUANTILE_BUCKETS,
                        rows: int = QUANTILE_ROWS) -> DataFrame:
    """``exact_quantiles`` of stored ``counted_values``: k, p, q."""

    def wanted(n):
        at = [F.lit(float(p)) * (n - 1) for p in probs]
        return F.array_distinct(F.array(*[f(h).cast("long") for h in at for f in (F.floor, F.ceil)]))

    left = counted.where(F.col("v").isNotNull())
    # a range: its key's rows n, the rows before it, the ranks wanted in it, its distinct values
    ranges = left.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")) \
        .select("k", F.lit("").alias("g"), "n", F.lit(0).cast("long").alias("start"), "d", wanted(F.col("n")).alias("ranks"))
    left = left.select("k", F.lit("").alias("g"), "v", "c")
    marks = F.array(*[F.lit(i / partitions) for i in range(1, partitions)]) if partitions > 2 else F.array(F.lit(0.5))
    while (ranges.agg(F.max("d")).first()[0] or 0) > rows:
        split = left.groupBy("k", "g").agg(F.percentile_approx("v", marks, 20 * partitions).alias("s"), F.count(F.lit(1)).alias("d")) \
            .select("k", "g", F.when(F.col("d") > rows, F.col("s")).otherwise(F.array().cast("array<double>")).alias("s"))
        dealt = _same(left, split, ("k", "g")).select(
            "k", "g", "v", "c", F.size(F.filter("s", lambda x: x < F.col("v"))).alias("b"))
        before = Window.partitionBy("k", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counts = dealt.groupBy("k", "g", "b").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d")) \
            .withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        kept = _same(counts, ranges.drop("d"), ("k", "g")).withColumn("start", F.col("start") + F.col("before")) \
            .withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("c")))) \
            .where(F.size("ranks") > 0)
        name = F.concat("g", F.lit("."), F.col("b").cast("string"))
        kept = _held(kept.select("k", "g", "b", name.alias("to"), "n", "start", "d", "ranks"))
        left = _held(_same(dealt, kept.select("k", "g", "b", "to"), ("k", "g", "b")).select("k", F.col("to").alias("g"), "v", "c"))
        ranges = kept.select("k", F.col("to").alias("g"), "n", "start", "d", "ranks")
    inside = Window.partitionBy("k", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = left.withColumn("end", F.sum("c").over(inside))
    picked = _same(ranked, ranges.drop("d"), ("k", "g")).withColumn("end", F.col("end") + F.col("start")) \
        .withColumn("rank", F.explode("ranks")) \
        .where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c"))) \
        .groupBy("k").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    placed = picked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))) \
        .withColumn("h", F.col("p") * (F.col("n") - 1)).withColumn("part", F.col("h") - F.floor("h"))
    lo, hi = (F.element_at("at", f("h").cast("long")) for f in (F.floor, F.ceil))
    return placed.select("k", "p", F.when(F.col("part") == 0, lo)
                         .otherwise(lo * (1.0 - F.col("part")) + hi * F.col("part")).alias("q"))


def _same(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Inner join in which null keys equal each other; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def box_stats(requests: DataFrame) -> DataFrame:
    """Per endpoint, successes only: min, quartiles, max of the time."""
    ok = requests.where(F.col("success"))
    counts = counted_values(ok, "endpoint", "execution_time")
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75])
    wide = q.groupBy(F.col("k").alias("endpoint")).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
    # interpolated doubles are rounded to 6 decimals: engines differ in the last bit
    r6 = lambda c: round_half_up(F.col(c), 6)
    wide = wide.select("endpoint", r6("`0.25`").alias("q1"), r6("`0.5`").alias("median"),
                       r6("`0.75`").alias("q3"))
    kind = dict(ok.dtypes)["execution_time"]
    mm = counts.groupBy(F.col("k").alias("endpoint")).agg(
        F.min("v").cast(kind).alias("min"), F.max("v").cast(kind).alias("max"), F.sum("c").alias("successes"))
    return mm.join(wide, "endpoint").select("endpoint", "successes", "min", "q1", "median", "q3", "max")
