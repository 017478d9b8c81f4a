"""Rating impact, monthly rates, trends and priorities, from one pass over the reviews.

All of them are projections of two small tables. ``daily_facts`` is the only step
that touches reviews: it counts and sums per (hotel, day), inside the map tasks
first. Whatever comes later works on days, months and topics, whose number does
not depend on how many reviews a hotel has, so hot hotels need no special care.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.fixed_values import TOPICS
from reviewops.functions import dates, numbers
from reviewops.functions.numbers import half_even, percent, share
from reviewops.operators.groups import first_n, ranked
from reviewops.operators.topics import flag, unpivot_topics

_HOTEL = ("Hotel_Name",)


def daily_facts(df: DataFrame, by: Sequence[str] = _HOTEL) -> DataFrame:
    """Per (hotel, day): reviews, rated reviews, rating sum, and the same per topic."""
    per_topic = [c for t in TOPICS for c in (numbers.rows_in(df, flag(t)).alias(f"n_{t}"), numbers.rated_in(df, flag(t)).alias(f"rated_{t}"),
                                             numbers.stars_in(df, flag(t)).alias(f"stars_{t}"))]
    return df.groupBy(*by, "date").agg(
        numbers.rows_in(df).alias("reviews"), numbers.rated_in(df).alias("rated"), numbers.stars_in(df).alias("stars"), *per_topic)


def hotel_topics(df: DataFrame, by: Sequence[str] = _HOTEL, months: int = 12) -> DataFrame:
    """Everything known about each (hotel, topic): counts, ratings with and without, recent monthly rates.

    ``monthly`` holds (month, rate) of the months within ``months`` of the hotel's
    latest review, oldest first; undated reviews count in the totals only.
    """
    latest = F.max("date").over(Window.partitionBy(*by))
    recent = F.col("date") >= dates.months_before(latest, months)
    days = daily_facts(df, by).withColumn("month", F.when(recent, dates.year_month(F.col("date"))))
    totals = ["reviews", "rated", "stars"]
    sums = totals + [f"{m}_{t}" for m in ("n", "rated", "stars") for t in TOPICS]
    per_month = days.groupBy(*by, "month").agg(*[F.expr(f"sum({c}) AS {c}") for c in sums])
    rows = unpivot_topics(per_month, [*by, "month", *totals], {"n": "n", "n_rated": "rated", "n_stars": "stars"})
    month_rate = F.struct("month", percent(F.col("n"), F.col("reviews")).alias("rate"))
    return rows.groupBy(*by, "topic", "topic_order").agg(
        F.sum("n").alias("complaint_count"), F.sum("reviews").alias("total_reviews"),
        F.sum("n_rated").alias("rated_with"), F.sum("n_stars").alias("stars_with"),
        F.sum("rated").alias("rated"), F.sum("stars").alias("stars"),
        F.array_sort(F.collect_list(F.when(F.col("month").isNotNull(), month_rate))).alias("monthly"))


def _avg_with() -> Column:
    return share(F.col("stars_with"), F.col("rated_with"))


def _avg_without() -> Column:
    stars = F.coalesce(F.col("stars"), F.lit(0)) - F.coalesce(F.col("stars_with"), F.lit(0))
    return share(stars, F.col("rated") - F.col("rated_with"))


def impact_column() -> Column:
    """Mean rating without the topic minus mean with it, at least 0, and 0 if either side is empty."""
    return F.coalesce(half_even(numbers.at_least(_avg_without() - _avg_with(), 0.0), 2), F.lit(0.0))


def impact_rows(facts: DataFrame, by: Sequence[str] = _HOTEL) -> DataFrame:
    return facts.select(
        *by, "topic", "topic_order", "complaint_count",
        percent(F.col("complaint_count"), F.col("total_reviews")).alias("complaint_rate"),
        half_even(_avg_with(), 2).alias("avg_rating_with"),
        half_even(_avg_without(), 2).alias("avg_rating_without"),
        impact_column().alias("impact"))


def impact_table(df: DataFrame, by: Sequence[str] = _HOTEL) -> DataFrame:
    """Per (hotel, topic): complaints, rate, mean rating with and without, impact."""
    return impact_rows(hotel_topics(df, by), by)


def rank_topics_by_impact(table: DataFrame, by: Sequence[str] = _HOTEL) -> DataFrame:
    return ranked(table, by, [F.desc("impact"), F.asc("topic_order")]).select(*by, "topic", "impact", "rank")


# --- trends -----------------------------------------------------------------

def _mean(rates: Column) -> Column:
    return F.aggregate(rates, F.lit(0.0), lambda acc, m: acc + m.rate) / F.size(rates)


def with_trend(facts: DataFrame) -> DataFrame:
    """Add recent and previous three-month rates, their difference and the trend.

    The months are those with reviews; with fewer than six the previous rate is
    taken as the recent one, so the trend is stable.
    """
    n = F.size("monthly")
    last = F.slice("monthly", F.greatest(n - 2, F.lit(1)), F.lit(3))
    before = F.slice("monthly", F.greatest(n - 5, F.lit(1)), F.lit(3))
    recent = F.when(n > 0, _mean(last))
    previous = F.when(n >= 6, _mean(before)).otherwise(recent)
    change = recent - previous
    return facts.withColumns({
        "recent_rate": half_even(recent, 1), "previous_rate": half_even(previous, 1), "delta": half_even(change, 1),
        "trend": F.when(change > 3, "INCREASING").when(change < -3, "DECREASING").otherwise("STABLE")})


def trends(df: DataFrame, by: Sequence[str] = _HOTEL, months: int = 12) -> DataFrame:
    """Per (hotel, topic): trend, icon, current rate, rates before and after, and the monthly rates as a map."""
    dated = hotel_topics(df, by, months).filter(F.size("monthly") > 0)
    return with_trend(dated).select(
        *by, "topic", "trend", numbers.trend_icon(F.col("trend")).alias("trend_icon"),
        F.col("recent_rate").alias("current_rate"), "recent_rate", "previous_rate", "delta",
        numbers.trend_word(F.col("trend")).alias("direction"),
        F.map_from_entries("monthly").alias("monthly_data"))


def monthly_complaint_rate(df: DataFrame, by: Sequence[str] = _HOTEL) -> DataFrame:
    """Per (hotel, month, topic): share of reviews with the topic, over all dated months."""
    dated = df.filter(F.col("date").isNotNull())
    wide = dated.groupBy(*by, dates.year_month(F.col("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("reviews"), *[F.expr(f"count_if({flag(t)}) AS n_{t}") for t in TOPICS])
    rows = unpivot_topics(wide, [*by, "month", "reviews"], {"n": "n"})
    return rows.select(*by, "month", "topic", percent(F.col("n"), F.col("reviews")).alias("complaint_rate"))


# --- priorities -------------------------------------------------------------

def with_priority(df: DataFrame, frequency: str = "frequency", impact: str = "impact", trend: str = "trend") -> DataFrame:
    score = numbers.priority_score(F.col(frequency), F.col(impact), F.col(trend))
    return (df.withColumn("priority_score", score)
            .withColumn("priority_category", numbers.priority_category(F.col("priority_score"))))


def all_issues(df: DataFrame, by: Sequence[str] = _HOTEL) -> DataFrame:
    """Every (hotel, topic) with frequency, impact, trend and priority."""
    rows = with_trend(hotel_topics(df, by)).select(
        *by, "topic", "topic_order", percent(F.col("complaint_count"), F.col("total_reviews")).alias("frequency"),
        impact_column().alias("impact"), "trend", numbers.trend_icon(F.col("trend")).alias("trend_icon"))
    return with_priority(rows)


def ranked_issues(df: DataFrame, by: Sequence[str] = _HOTEL, min_frequency: float = 5.0, shown: int = 6) -> DataFrame:
    """The leading issues of every hotel by priority score; rare topics are left out."""
    frequent = all_issues(df, by).filter(F.col("frequency") >= min_frequency)
    return first_n(frequent, list(by), [F.desc("priority_score"), F.asc("topic_order")], shown, "rank").drop("topic_order")
