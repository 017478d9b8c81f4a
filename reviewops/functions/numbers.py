"""Rounding, percentages, money and band columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewops.fixed_values import PRIORITY_BANDS, TREND_ICONS, TREND_POINTS, TREND_WORDS


def half_even(value: Column, digits: int) -> Column:
    """Round half to even, as array libraries do, without leaving double arithmetic."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale + F.lit(0.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


EXACT = "decimal(28,5)"


def exact_sum(value: Column) -> Column:
    """Sum of values with up to five decimals, as a decimal.

    Scores and ratings have one or two decimals, sentiment scores four. Decimal sums
    do not depend on the order of the rows, so neither layout nor retries can move a
    mean across a rounding edge.
    """
    return F.sum(value.try_cast(EXACT))


def exact_mean(value: Column) -> Column:
    """Mean of the values that ``exact_sum`` adds up; those beyond 28 digits count in neither."""
    return F.try_divide(exact_sum(value).cast("double"), F.count(value.try_cast(EXACT)).cast("double"))


#: Column of a frame whose rows stand for several equal reviews: how many. Then ``rated``, ``stars``
#: and ``sentiment`` hold their rated ones and the sums of their ratings and sentiment scores.
WEIGHT = "_reviews"


def rows_in(df: DataFrame, condition: str = "true") -> Column:
    """Number of reviews that meet the condition."""
    return F.expr(f"sum(CASE WHEN {condition} THEN {WEIGHT} ELSE 0L END)" if WEIGHT in df.columns else f"count_if({condition})")


def rated_in(df: DataFrame, condition: str = "true") -> Column:
    """Number of rated reviews that meet the condition."""
    return F.expr(f"sum(CASE WHEN {condition} THEN rated ELSE 0L END)" if WEIGHT in df.columns else f"count(CASE WHEN {condition} THEN rating END)")


def stars_in(df: DataFrame, condition: str = "true") -> Column:
    """Sum of the ratings of reviews that meet the condition."""
    return F.expr(f"sum(CASE WHEN {condition} THEN {'stars' if WEIGHT in df.columns else f'try_cast(rating AS {EXACT})'} END)")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return half_even(share(part, whole) * 100.0, digits)


def at_most(value: Column, cap: float) -> Column:
    """Cap that keeps NULL as NULL (``least`` would skip it)."""
    return F.when(value > cap, F.lit(cap)).otherwise(value)


def at_least(value: Column, floor: float) -> Column:
    return F.when(value < floor, F.lit(floor)).otherwise(value)


def star_rating(score: Column) -> Column:
    """Ten-point score to a 1-5 rating; missing stays missing."""
    return at_most(at_least(score / 2.0, 1.0), 5.0)


def star_text(rating: Column) -> Column:
    return F.repeat(F.lit("⭐"), at_most(at_least(F.rint(rating), 1.0), 5.0).cast("int"))


def health_score(rating: Column) -> Column:
    return F.floor(at_most(rating / 5.0 * 100.0, 100.0))


def band(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound the value reaches."""
    out = None
    for bound, label in bands:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(otherwise)


def health_band(score: Column) -> Column:
    return band(score, [(80, "good"), (60, "fair")], "poor")


def stat_label(avg_score: Column) -> Column:
    return band(avg_score, [(8, "Good"), (6, "Average")], "Poor")


def frequency_band(pct: Column) -> Column:
    return band(pct, [(30, "high"), (15, "medium")], "low")


def impact_band(impact: Column) -> Column:
    return band(impact, [(1.0, "high"), (0.5, "medium")], "low")


def confidence_band(confidence: Column) -> Column:
    return band(confidence, [(60, "high"), (30, "medium")], "low")


def trend_points(trend: Column) -> Column:
    return (F.when(trend == "INCREASING", TREND_POINTS["INCREASING"])
            .when(trend == "DECREASING", TREND_POINTS["DECREASING"])
            .otherwise(TREND_POINTS["STABLE"]))


def _per_trend(trend: Column, words: dict[str, str]) -> Column:
    return (F.when(trend == "INCREASING", words["INCREASING"])
            .when(trend == "DECREASING", words["DECREASING"])
            .when(trend == "STABLE", words["STABLE"]))


def trend_icon(trend: Column) -> Column:
    return _per_trend(trend, TREND_ICONS)


def trend_word(trend: Column) -> Column:
    return F.coalesce(_per_trend(trend, TREND_WORDS), F.lit("—"))


def priority_score(frequency: Column, impact: Column, trend: Column) -> Column:
    """Weighted 0-100 score of an issue: frequency, rating impact and trend."""
    raw = frequency * 0.4 + impact * 20.0 * 0.4 + trend_points(trend) * 0.2
    return at_most(half_even(raw, 1), 100.0)


def priority_category(score: Column) -> Column:
    return band(score, PRIORITY_BANDS, "LOW")


def money(amount: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(amount, 0))


def compact_money(amount: Column) -> Column:
    return (F.when(amount >= 1_000_000, F.format_string("£%.1fM", half_even(amount / 1e6, 1)))
            .when(amount >= 1_000, F.format_string("£%.1fK", half_even(amount / 1e3, 1)))
            .otherwise(F.format_string("£%.0f", F.rint(amount))))


def signed_change(now: Column, before: Column) -> Column:
    change = half_even(now - before, 2)
    return F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("string"))
