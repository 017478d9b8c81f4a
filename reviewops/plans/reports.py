"""The hotel report: five sections for all hotels, or for the most reviewed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewops.functions import numbers
from reviewops.operators import causes, impact, planning, profiles, sentiment, topics
from reviewops.operators.groups import rows_of_top
from reviewops.session import kept


def leading_topics(df: DataFrame) -> DataFrame:
    """The most frequent topic of every hotel."""
    return topics.top_topic(topics.topic_stats(df)).select("Hotel_Name", "topic")


def hotel_plans(df: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """Costed actions for the most frequent topic of every hotel."""
    found = causes.root_causes(df).join(leading_topics(df), ["Hotel_Name", "topic"], "left_semi")
    return planning.action_plans(found, rooms)


def compact(df: DataFrame, with_sentiment: bool = True) -> DataFrame:
    """Tagged reviews counted by hotel, day, topics and causes, with their rating and sentiment sums.

    One pass over the texts, combined inside the map tasks. All sections read this
    aggregate instead of the reviews; Spark reuses its exchange where a plan reads it twice.
    """
    searched = causes.add_causes(df)
    moods = []
    if with_sentiment:
        searched = sentiment.with_sentiment(searched)
        moods = [numbers.exact_sum(F.col("sentiment_score")).alias("sentiment")]
    counted = searched.groupBy("Hotel_Name", "date", "topics", "causes").agg(
        F.count(F.lit(1)).alias(numbers.WEIGHT), F.count("rating").alias("rated"), numbers.exact_sum(F.col("rating")).alias("stars"), *moods)
    return topics.add_topic_flags(counted)


def plan_returns(df: DataFrame, rooms: DataFrame | None = None, **options) -> DataFrame:
    """Return on investment of the plan of every (hotel, topic), from tagged reviews."""
    facts = compact(df, with_sentiment=False)
    costs = planning.plan_costs(planning.action_plans(causes.root_causes(facts), rooms))
    return planning.roi(facts, costs, rooms, **options)


def report_tables(df: DataFrame, top: int | None = None, rooms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Report sections by name. ``top`` limits them to the hotels with the most reviews.

    The compact form of the reviews is stored, and all sections read it from there.
    """
    chosen = kept(compact(rows_of_top(df, "Hotel_Name", top) if top else df), "report-facts")
    plan = hotel_plans(chosen, rooms)
    return {
        "summary": profiles.hotel_summary(chosen),
        "topic_stats": topics.topic_stats(chosen).select("Hotel_Name", "topic", "count", "percentage"),
        "impact_table": impact.impact_table(chosen).drop("topic_order"),
        "action_plan": plan.select("Hotel_Name", "topic", "step", F.initcap(F.replace("timeframe", F.lit("_"), F.lit(" "))).alias("timeframe"),
                                   "action", "cost_text", "timeline", "expected_impact", "root_cause"),
        "roi": planning.roi(chosen, planning.plan_costs(plan), rooms).join(leading_topics(chosen), ["Hotel_Name", "topic"], "left_semi"),
    }


def hotel_report(df: DataFrame, top: int | None = None, rooms: DataFrame | None = None) -> DataFrame:
    """One line per hotel: summary, leading topic with its impact, plan cost and return.

    A hotel without complaints is there too: its leading topic is the first one, with a rate of 0, no actions and no cost.
    """
    tables = report_tables(df, top, rooms)
    projection = tables["roi"].select("Hotel_Name", "topic", "total_investment", "rating_improvement", "expected_rating",
                                      "net_profit_3_months", "roi_percentage", "payback_months")
    leading_impact = tables["impact_table"].select("Hotel_Name", "topic", "complaint_rate", "impact")
    steps = tables["action_plan"].groupBy("Hotel_Name", "topic").agg(F.count(F.lit(1)).alias("actions"))
    return (tables["summary"].join(projection, "Hotel_Name", "left").join(leading_impact, ["Hotel_Name", "topic"], "left")
            .join(steps, ["Hotel_Name", "topic"], "left").fillna(0, ["actions"])
            .withColumn("investment_text", numbers.compact_money(F.col("total_investment"))))
