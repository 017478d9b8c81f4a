"""Action plans, their cost and their return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.fixed_values import (COMPLAINT_REDUCTION, DAYS_PER_MONTH, DEFAULT_COMPLAINT_RATE, DEFAULT_RATING,
                                    OCCUPANCY_CAP, PLAN_CONFIDENCE_MIN, RATING_TO_OCCUPANCY)
from reviewops.functions import numbers
from reviewops.functions.numbers import half_even, share
from reviewops.operators.groups import ranked
from reviewops.operators.impact import hotel_topics, impact_column
from reviewops.sources.templates import action_templates, cost_by_formula, template_rows

_BY = ("Hotel_Name",)


def with_rooms(df: DataFrame, rooms: DataFrame | None = None, default: int = 100, by: Sequence[str] = _BY) -> DataFrame:
    """Add ``rooms`` from a table (hotel, rooms); hotels without an entry get the default."""
    if rooms is None:
        return df.withColumn("rooms", F.lit(default))
    return df.join(rooms.select(*by, "rooms"), list(by), "left").fillna({"rooms": default})


def active_causes(causes: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Causes of at least 60 confidence; where there are none, the first three."""
    best = F.max("confidence").over(Window.partitionBy(*by, "topic"))
    return (causes.withColumn("_best", best)
            .filter((F.col("confidence") >= PLAN_CONFIDENCE_MIN) | ((F.col("_best") < PLAN_CONFIDENCE_MIN) & (F.col("rank") <= 3)))
            .drop("_best"))


def action_plans(causes: DataFrame, rooms: DataFrame | None = None, default_rooms: int = 100,
                 templates: list[tuple] | None = None, by: Sequence[str] = _BY) -> DataFrame:
    """Costed actions per (hotel, topic), ordered by cause rank, timeframe and position in ``step``.

    The template table is a constant of known size and is broadcast. Causes without
    a template drop out.
    """
    rows = templates if templates is not None else template_rows()
    table = F.broadcast(action_templates(causes.sparkSession, rows))
    chosen = with_rooms(active_causes(causes, by), rooms, default_rooms, by).select(
        *by, "topic", "cause", "confidence", F.col("rank").alias("cause_rank"), "rooms")
    planned = chosen.join(table, "cause").withColumn("cost", cost_by_formula([r[3] for r in rows]))
    step = Window.partitionBy(*by, "topic").orderBy("timeframe_order", "cause_rank", "action_order")
    return planned.select(*by, "topic", F.row_number().over(step).alias("step"), "timeframe", "action", "cost",
                          numbers.money(F.col("cost")).alias("cost_text"), "timeline", "expected_impact",
                          F.col("cause").alias("root_cause"), "confidence", "rooms")


def rank_actions_by_confidence(plans: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Number the actions of each plan by confidence, strongest first; equal ones keep the plan's order."""
    return ranked(plans, [*by, "topic"], [F.desc("confidence"), F.asc("step")], "confidence_rank")


def plan_costs(plans: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """One-time, monthly and three-month cost per (hotel, topic)."""
    monthly = F.col("timeframe") == "long_term"
    sums = plans.groupBy(*by, "topic").agg(
        F.coalesce(F.sum(F.when(~monthly, F.col("cost"))), F.lit(0.0)).alias("one_time"),
        F.coalesce(F.sum(F.when(monthly, F.col("cost"))), F.lit(0.0)).alias("monthly"),
        F.count(F.lit(1)).alias("actions"))
    return sums.select(*by, "topic", half_even(F.col("one_time"), 2).alias("one_time"),
                       half_even(F.col("monthly"), 2).alias("monthly"),
                       half_even(F.col("one_time") + F.col("monthly") * 3, 2).alias("three_month_total"), "actions")


def roi_inputs(df: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Mean rating, complaint rate (0-1) and impact per (hotel, topic)."""
    return hotel_topics(df, by).select(
        *by, "topic", F.coalesce(share(F.col("stars"), F.col("rated")), F.lit(DEFAULT_RATING)).alias("rating"),
        share(F.col("complaint_count"), F.col("total_reviews")).alias("complaint_rate"), impact_column().alias("impact"))


def with_roi(df: DataFrame, room_rate: float = 150.0, occupancy: float = 0.65, default_inputs: bool = False) -> DataFrame:
    """Add the projection columns to rows of (rating, complaint_rate, impact, rooms, three_month_total).

    ``default_inputs`` projects from the default complaint rate and no impact instead
    of the measured ones.
    """
    rate = F.lit(DEFAULT_COMPLAINT_RATE) if default_inputs else F.col("complaint_rate")
    impact = F.lit(0.0) if default_inputs else F.col("impact")
    investment, increase = F.col("three_month_total"), F.col("monthly_increase")
    monthly_unit = F.col("rooms") * room_rate * float(DAYS_PER_MONTH)
    return (df.withColumn("rating_improvement", half_even(rate * COMPLAINT_REDUCTION * impact, 2))
            .withColumn("expected_rating", half_even(numbers.at_most(F.col("rating") + F.col("rating_improvement"), 5.0), 2))
            .withColumn("expected_occupancy", numbers.at_most(
                F.lit(occupancy) + F.col("rating_improvement") * 10.0 * RATING_TO_OCCUPANCY, OCCUPANCY_CAP))
            .withColumn("current_revenue", monthly_unit * occupancy)
            .withColumn("improved_revenue", monthly_unit * F.col("expected_occupancy"))
            .withColumn("monthly_increase", F.col("improved_revenue") - F.col("current_revenue"))
            .withColumn("returns_3_months", increase * 3)
            .withColumn("net_profit_3_months", F.col("returns_3_months") - investment)
            .withColumn("roi_percentage", F.when(investment > 0, F.try_divide(F.col("net_profit_3_months"), investment) * 100).otherwise(0.0))
            .withColumn("pays_back", increase > 0)
            .withColumn("payback_months", F.when(increase > 0, half_even(F.try_divide(investment, increase), 1))))


def roi(df: DataFrame, costs: DataFrame, rooms: DataFrame | None = None, default_rooms: int = 100,
        room_rate: float = 150.0, occupancy: float = 0.65, default_inputs: bool = False, by: Sequence[str] = _BY) -> DataFrame:
    """Return on investment of the plan of every (hotel, topic); one without a plan costs nothing."""
    costed = roi_inputs(df, by).join(costs, [*by, "topic"], "left").fillna(0.0, ["three_month_total"])
    joined = with_rooms(costed, rooms, default_rooms, by)
    out = with_roi(joined, room_rate, occupancy, default_inputs)

    def cents(c: str) -> Column:
        return half_even(F.col(c), 2).alias(c)

    return out.select(
        *by, "topic", "rooms", half_even(F.col("rating"), 2).alias("current_rating"), "expected_rating", "rating_improvement",
        F.lit(occupancy).alias("current_occupancy"), half_even(F.col("expected_occupancy"), 4).alias("expected_occupancy"),
        cents("current_revenue"), cents("improved_revenue"), cents("monthly_increase"),
        F.col("three_month_total").alias("total_investment"), cents("returns_3_months"), cents("net_profit_3_months"),
        half_even(F.col("roi_percentage"), 1).alias("roi_percentage"), "pays_back", "payback_months")


def roi_text(projection: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """The projection as formatted text."""
    def pct(c: str, scale: float = 1.0) -> Column:
        return F.format_string("%.1f%%", half_even(F.col(c) * scale, 1)).alias(c)

    return projection.select(
        *by, "topic", "current_rating", "expected_rating", "rating_improvement", pct("current_occupancy", 100.0),
        pct("expected_occupancy", 100.0), *[numbers.money(F.col(c)).alias(c) for c in (
            "current_revenue", "improved_revenue", "monthly_increase", "total_investment", "returns_3_months",
            "net_profit_3_months")], pct("roi_percentage"),
        F.coalesce(F.col("payback_months").cast("string"), F.lit("never")).alias("payback_months"))


def roi_breakdown(projection: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Investment, revenue uplift and net profit as three rows, with their signs."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("item"), amount.alias("amount")) for i, (name, amount) in
                     enumerate([("Investment", 0.0 - F.col("total_investment")), ("Revenue Uplift (3M)", F.col("returns_3_months")),
                                ("Net Profit", F.col("net_profit_3_months"))])])
    return projection.select(*by, "topic", F.inline(rows))
