"""Complaint topics: tagging reviews and counting tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from reviewops.fixed_values import TOPIC_KEYWORDS, TOPICS
from reviewops.functions import text
from reviewops.functions.numbers import exact_mean, half_even, percent, rows_in
from reviewops.operators.groups import exploded, first_n, rows_of_top


def flag(topic: str) -> str:
    return f"has_{topic}"


def topics_in(lower_text: Column, keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS, word_boundary: bool = False) -> Column:
    """Array of the topics whose words occur in lower-cased text, in dictionary order."""
    return F.array_compact(F.array(*[F.when(text.mentions_any(lower_text, words, word_boundary), F.lit(t))
                                     for t, words in keywords.items()]))


def add_topics(df: DataFrame, column: str = "review_text", keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS,
               word_boundary: bool = False) -> DataFrame:
    """Tag each review: the ``topics`` array and eight ``has_<topic>`` flags read off it.

    Words match anywhere in the lower-cased text, inside other words too, unless
    ``word_boundary`` is set. The text is lower-cased and searched once.
    """
    tagged = df.withColumn("_lower", F.lower(column)).withColumn("topics", topics_in(F.col("_lower"), keywords, word_boundary))
    return tagged.drop("_lower").transform(add_topic_flags, "topics", list(keywords))


def add_topic_flags(df: DataFrame, topic_column: str = "topics", topics: Sequence[str] = TOPICS) -> DataFrame:
    """``has_<topic>`` flags from a topics array, from text if there is none, else all false."""
    if topic_column in df.columns:
        return df.withColumns({flag(t): F.expr(f"coalesce(array_contains({topic_column}, '{t}'), false)") for t in topics})
    if "review_text" in df.columns:
        return add_topics(df)
    return df.withColumns({flag(t): F.lit(False) for t in topics})


def long_topics(df: DataFrame) -> DataFrame:
    """One row per review and topic it carries."""
    return exploded(df, "topic", "topics")


def unpivot_topics(wide: DataFrame, keys: Sequence[str], measures: Mapping[str, str], topics: Sequence[str] = TOPICS) -> DataFrame:
    """Turn per-topic columns ``<prefix>_<topic>`` of an aggregate into rows.

    ``measures`` maps the new column name to the prefix. Aggregates are narrow, so
    the rows that multiply are few.
    """
    rows = ", ".join(f"named_struct('topic', '{t}', 'topic_order', {i}, " +
                     ", ".join(f"'{name}', {prefix}_{t}" for name, prefix in measures.items()) + ")" for i, t in enumerate(topics))
    return wide.select(*keys, F.expr(f"inline(array({rows}))"))


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        rows_in(df).alias("total"), *[rows_in(df, flag(t)).alias(f"n_{t}") for t in TOPICS])


def topic_stats(df: DataFrame, by: Sequence[str] = ("Hotel_Name",)) -> DataFrame:
    """Reviews per (hotel, topic) and their share in percent."""
    rows = unpivot_topics(_counts(df, by), [*by, "total"], {"count": "n"})
    return rows.select(*by, "topic", "topic_order", "count", "total",
                       percent(F.col("count"), F.col("total")).alias("percentage"))


def topic_prevalence(df: DataFrame) -> DataFrame:
    """Share of all reviews per topic, in percent."""
    rows = unpivot_topics(_counts(df, []), ["total"], {"count": "n"})
    return rows.select("topic", percent(F.col("count"), F.col("total"), 4).alias("complaint_rate"))


def topic_cooccurrence(df: DataFrame) -> DataFrame:
    """How many reviews carry both topics, for every ordered pair; 0 on the diagonal.

    One pass with a conditional count per unordered pair; no self-join.
    """
    pairs = list(combinations(TOPICS, 2))
    counts = df.agg(*[F.expr(f"count_if({flag(a)} AND {flag(b)}) AS {a}_{b}") for a, b in pairs])
    cells = [(x, y, f"{a}_{b}") for a, b in pairs for x, y in ((a, b), (b, a))] + [(t, t, "0L") for t in TOPICS]
    rows = ", ".join(f"named_struct('topic_a', '{x}', 'topic_b', '{y}', 'reviews', {n})" for x, y, n in cells)
    return counts.select(F.expr(f"inline(array({rows}))"))


def topic_breakdown(df: DataFrame, top: int = 5) -> DataFrame:
    """Topic shares of the most reviewed hotels, one column per topic."""
    return rows_of_top(df, "Hotel_Name", top).groupBy("Hotel_Name").agg(
        *[percent(F.count_if(flag(t)), F.count(F.lit(1))).alias(t) for t in TOPICS])


def top_topic(stats: DataFrame) -> DataFrame:
    """Most frequent topic per hotel; ties go to the earlier topic."""
    return first_n(stats, ["Hotel_Name"], [F.desc("percentage"), F.asc("topic_order")], 1).drop("rn")


def union_labels(a: Column, b: Column) -> Column:
    """Union of two label arrays, sorted; "none" only survives alone."""
    both = F.filter(F.array_union(a, b), lambda t: t != "none")
    return F.when(F.size(both) == 0, F.array(F.lit("none"))).otherwise(F.array_sort(both))


def corpus_rating_drop(df: DataFrame) -> DataFrame:
    """Overall mean rating minus the mean of reviews with the topic."""
    wide = df.agg(exact_mean(F.col("rating")).alias("overall"),
                  *[exact_mean(F.when(F.col(flag(t)), F.col("rating"))).alias(f"avg_{t}") for t in TOPICS])
    rows = unpivot_topics(wide, ["overall"], {"avg_with": "avg"})
    return rows.select("topic", half_even(F.col("overall") - F.col("avg_with"), 4).alias("rating_drop"))
