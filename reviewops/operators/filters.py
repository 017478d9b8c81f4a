"""Filters over clean reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from reviewops.functions import dates, text
from reviewops.operators.groups import first_n
from reviewops.operators.topics import add_topics
from reviewops.session import kept


def for_hotel(df: DataFrame, name: str) -> DataFrame:
    """Reviews of one hotel; names are compared without surrounding space."""
    return df.filter(text.strip(F.col("Hotel_Name")) == name.strip())


#: Groups whose bounds are sent to every task; more of them are met by group and day.
MOST_GROUPS = 200_000


def _within(df: DataFrame, bounds: DataFrame, by: Sequence[str], date: str, stays: Column) -> DataFrame:
    """Rows for which ``stays`` holds of their date and the bounds of their group.

    Bounds are one row a group; they are stored and counted. Few are broadcast, and rows stay where they
    are. Of more, it is worked out by (group, day) which days stay, and rows are matched by group
    and day: a group with a third of all rows is spread over its days.
    """
    bounds = kept(bounds, "group-bounds")
    if bounds.count() <= MOST_GROUPS:
        return df.join(F.broadcast(bounds), list(by)).filter(stays).select(*df.columns)
    day = F.coalesce(F.col(date), F.lit("0001-01-01").cast("date")).alias("_day")
    days = df.select(*by, date).distinct().join(bounds, list(by)).filter(stays).select(*by, day)
    return df.withColumn("_day", day).join(days, [*by, "_day"], "left_semi").select(*df.columns)


def filter_recent(df: DataFrame, date: str = "date", months: int = 12, by: Sequence[str] = ("Hotel_Name",)) -> DataFrame:
    """Rows within ``months`` calendar months of the group's latest date, inclusive.

    A group without any date is kept whole.
    """
    latest = df.groupBy(*by).agg(F.max(date).alias("_latest"))
    recent = F.col("_latest").isNull() | (F.col(date) >= dates.months_before(F.col("_latest"), months))
    return _within(df, latest, by, date, recent)


def date_between(df: DataFrame, first=None, last=None, date: str = "date", default_days: int = 365,
                 by: Sequence[str] = ("Hotel_Name",)) -> DataFrame:
    """Rows between two days, inclusive.

    Without bounds each group shows its last ``default_days`` days.
    """
    if first is not None and last is not None:
        return df.filter(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    span = df.groupBy(*by).agg(F.min(date).alias("_min"), F.max(date).alias("_max"))
    start = F.greatest(F.col("_min"), F.date_sub("_max", default_days)) if first is None else F.lit(first).cast("date")
    end = F.col("_max") if last is None else F.lit(last).cast("date")
    return _within(df, span, by, date, F.col(date).between(start, end))


def rating_between(df: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    return df.filter(F.col("rating").between(low, high))


def with_any_topic(df: DataFrame, topics: Sequence[str] = ()) -> DataFrame:
    """Rows of any chosen topic; no choice keeps all rows."""
    return df.filter(reduce(or_, [F.col(f"has_{t}") for t in topics])) if topics else df


def apply_filters(df: DataFrame, first=None, last=None, low: float = 1.0, high: float = 5.0,
                  topics: Sequence[str] = ()) -> DataFrame:
    """All filters. Reviews without topic flags are tagged here, once dates and ratings have thinned them out."""
    rows = df.transform(date_between, first, last).transform(rating_between, low, high)
    if topics and f"has_{topics[0]}" not in rows.columns:
        rows = add_topics(rows)
    return rows.transform(with_any_topic, topics)


def search_hotels(df: DataFrame, query: str = "") -> DataFrame:
    """Hotel names that contain the query, ignoring case, or all names; how many are shown is up to the caller."""
    names = df.select(text.strip(F.col("Hotel_Name")).alias("Hotel_Name")).distinct()
    return names.filter(F.lower("Hotel_Name").contains(query.lower())) if query else names


def topic_samples(topic_rows: DataFrame, n: int = 5, max_chars: int = 350, worst_only: bool = False) -> DataFrame:
    """First ``n`` reviews of each (hotel, topic), cut for display.

    ``topic_rows`` has one row per review and topic (see ``topics.long_topics``).
    """
    rows = topic_rows.filter(F.col("rating") <= 3) if worst_only else topic_rows
    shown = rows.select("Hotel_Name", "topic", "review_id", "rating",
                        F.substring("review_text", 1, max_chars).alias("excerpt"))
    return first_n(shown, ["Hotel_Name", "topic"], [F.col("review_id")], n)
