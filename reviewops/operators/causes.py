"""Root causes of complaints: how often their words occur, with evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.fixed_values import (CAUSE_CONFIDENCE_MIN, CAUSE_DESCRIPTIONS, CAUSE_KEYWORDS, CAUSE_PRIORS, CAUSES,
                                    DEFAULT_CAUSE_PRIORS, SPARSE_EVIDENCE)
from reviewops.functions import text
from reviewops.functions.numbers import WEIGHT, at_least, at_most, half_even, percent, rows_in, share
from reviewops.operators.groups import exploded, first_n, ranked

_BY = ("Hotel_Name",)


def _lookup(key: Column, values: Mapping[str, object], otherwise: Column | None = None) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, v if isinstance(v, Column) else F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def cause_order(cause: Column) -> Column:
    return _lookup(cause, {c: i for i, c in enumerate(CAUSES)})


def add_causes(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Add ``causes``, the array of causes whose words occur in the text.

    Causes are only asked for within topics: reviews known to have none are not searched.
    """
    lower = F.col("_lower")
    found = F.array_compact(F.array(*[F.when(text.mentions_any(lower, words), F.lit(c)) for c, words in CAUSE_KEYWORDS.items()]))
    if "topics" in df.columns:
        found = F.when(F.size("topics") > 0, found).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_lower", F.lower(column)).withColumn("causes", found).drop("_lower")


def cause_counts(df: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Reviews per (hotel, topic, cause); the row without a cause counts all reviews of the topic."""
    marked = df if "causes" in df.columns else add_causes(df)
    marks = F.concat(F.array(F.lit(None).cast("string")), F.col("causes"))
    weight = [WEIGHT] if WEIGHT in marked.columns else []
    rows = exploded(marked.select(*by, *weight, "topics", marks.alias("_marks")), "topic", "topics")
    rows = rows.select(*by, *weight, "topic", F.explode_outer("_marks").alias("cause"))
    return rows.groupBy(*by, "topic", "cause").agg(rows_in(rows).alias("hits"))


def _prior_rows(topic: Column, total: Column) -> Column:
    """Up to three cautious causes for a topic without evidence, weaker for larger samples."""
    base = F.when(total <= 2, 35.0).when(total <= 5, 30.0).otherwise(25.0)

    def rows(causes: Sequence[str]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("cause"), at_least(base - 5.0 * i, 15.0).alias("confidence"),
                                  F.lit(True).alias("fallback")) for i, c in enumerate(causes[:3])])

    return _lookup(topic, {t: rows(c) for t, c in CAUSE_PRIORS.items()}, rows(DEFAULT_CAUSE_PRIORS))


def root_causes(df: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Causes of each (hotel, topic) with confidence, strongest first.

    Confidence is the share of the topic's reviews that hold a word of the cause.
    Causes below 10 % are dropped; a topic left with none gets its prior causes.
    """
    topic = Window.partitionBy(*by, "topic")
    confidence = at_most(percent(F.col("hits"), F.col("total")), 100.0)
    counted = (cause_counts(df, by)
               .withColumn("total", F.max(F.when(F.col("cause").isNull(), F.col("hits"))).over(topic))
               .withColumn("confidence", confidence)
               .withColumn("_kept", F.col("cause").isNotNull() & (F.col("confidence") >= CAUSE_CONFIDENCE_MIN))
               .withColumn("_any", F.max("_kept").over(topic)))
    found = F.array(F.struct("cause", "confidence", F.lit(False).alias("fallback")))
    rows = (F.when(F.col("_kept"), found)
            .when(F.col("cause").isNull() & ~F.col("_any"), _prior_rows(F.col("topic"), F.col("total"))))
    flat = counted.select(*by, "topic", "total", F.when(F.col("_kept"), F.col("hits")).alias("hits"), F.inline(rows))
    return ranked(flat, [*by, "topic"], [F.desc("confidence"), cause_order(F.col("cause"))]).withColumn(
        "description", _lookup(F.col("cause"), CAUSE_DESCRIPTIONS, F.col("cause")))


def evidence_snippets(df: DataFrame, by: Sequence[str] = _BY, n: int = 3) -> DataFrame:
    """The first ``n`` reviews per (hotel, topic, cause), cut around the first keyword found.

    Where ``add_causes`` has told the causes, texts are only searched for the words of their own.
    """
    lower = F.col("_lower")

    def quote(cause: str, words: Sequence[str]) -> Column:
        found = text.let(text.first_keyword(lower, words), lambda kw: F.when(kw.isNotNull(), F.struct(
            F.lit(cause).alias("cause"), text.snippet_around(lower, kw).alias("snippet"))))
        return F.when(F.array_contains("causes", cause), found) if "causes" in df.columns else found

    quotes = F.array_compact(F.array(*[quote(c, words) for c, words in CAUSE_KEYWORDS.items()]))
    lowered = df.withColumn("_lower", F.lower("review_text"))
    quoted = exploded(lowered.select(*by, "review_id", "topics", quotes.alias("_quotes")), "topic", "topics")
    rows = quoted.select(*by, "review_id", "topic", F.inline_outer("_quotes")).filter(F.col("cause").isNotNull())
    return first_n(rows, [*by, "topic", "cause"], [F.col("review_id")], n)


def with_evidence(causes: DataFrame, df: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Add the ``evidence`` array: one counting sentence and up to three quotes, or the two fallback notes."""
    keys = [*by, "topic", "cause"]
    quotes = evidence_snippets(df, by).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", "snippet"))).alias("_quotes"))
    quoted = F.transform(F.coalesce("_quotes", F.array().cast("array<struct<rn:int,snippet:string>>")),
                         lambda q: F.concat(F.lit('Guest wrote: "…'), q.snippet, F.lit('…"')))
    counted = F.concat(F.col("hits").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" reviews ("),
                       half_even(share(F.col("hits"), F.col("total")) * 100.0, 1).cast("string"), F.lit("%) contain '"),
                       F.lower(F.replace(F.col("cause"), F.lit("_"), F.lit(" "))), F.lit("' indicators."))
    notes = F.array(F.format_string(SPARSE_EVIDENCE[0], F.col("total")), F.lit(SPARSE_EVIDENCE[1]))
    return causes.join(quotes, keys, "left").withColumn(
        "evidence", F.when(F.col("fallback"), notes).otherwise(F.concat(F.array(counted), quoted))).drop("_quotes")


def strongest_fallback(causes: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Where causes are only priors, keep the strongest one."""
    return causes.filter(~F.col("fallback") | (F.col("rank") == 1))


def display_causes(causes: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """Causes as a table for readers: titled name, whole percent, description."""
    return causes.select(*by, "topic", F.initcap(F.replace(F.col("cause"), F.lit("_"), F.lit(" "))).alias("root_cause"),
                         F.format_string("%.0f%%", F.rint("confidence")).alias("confidence"), "description", "rank")
