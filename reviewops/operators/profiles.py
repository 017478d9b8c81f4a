"""Hotel and corpus profiles.

Group aggregates are combined inside the map tasks before they shuffle, so hot
hotels cost no more than others. Percentiles and histograms work on (value, count)
pairs: their cost follows the number of distinct values, not the number of reviews.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.fixed_values import TOPICS
from reviewops.functions import dates, lexicon, numbers, text
from reviewops.functions.numbers import exact_mean, half_even, percent, share
from reviewops.operators.groups import rows_of_top
from reviewops.operators.topics import flag, unpivot_topics
from reviewops.session import kept

LABELS = ["positive", "neutral", "negative"]


# --- hotels -----------------------------------------------------------------

def hotel_list(reviews: DataFrame) -> DataFrame:
    return reviews.select(text.strip(F.col("Hotel_Name")).alias("Hotel_Name")).distinct().orderBy("Hotel_Name")


def hotel_stats(reviews: DataFrame, hotels: DataFrame | None = None) -> DataFrame:
    """Reviews, mean raw score and date range per hotel, over loaded (not yet cleaned) reviews.

    With ``hotels`` the result has one row per name asked for; a hotel without
    reviews shows 0, 0.0 and "N/A".
    """
    stats = reviews.groupBy(text.strip(F.col("Hotel_Name")).alias("Hotel_Name")).agg(
        F.count(F.lit(1)).alias("total_reviews"), half_even(exact_mean(F.col("Reviewer_Score")), 2).alias("avg_rating"),
        F.min("Review_Date").alias("first"), F.max("Review_Date").alias("last"))
    if hotels is not None:
        names = hotels.select(text.strip(F.col("Hotel_Name")).alias("Hotel_Name")).distinct()
        stats = names.join(stats, "Hotel_Name", "left").fillna({"total_reviews": 0, "avg_rating": 0.0})

    def day(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("N/A"))

    return stats.select("Hotel_Name", "total_reviews", "avg_rating", day("first").alias("start_date"),
                        day("last").alias("end_date"), numbers.stat_label(F.col("avg_rating")).alias("label"))


def hotel_summary(df: DataFrame) -> DataFrame:
    """Reviews, mean rating, mean sentiment and health score per hotel.

    Sentiment is ``sentiment_score`` where present, else scored from the text.
    """
    if numbers.WEIGHT in df.columns:
        rating, mood = share(numbers.stars_in(df), numbers.rated_in(df)), share(F.sum("sentiment"), numbers.rows_in(df))
    else:
        score = F.col("sentiment_score") if "sentiment_score" in df.columns else lexicon.sentiment_score(F.col("review_text"))
        rating, mood = exact_mean(F.col("rating")), exact_mean(score)
    out = df.groupBy("Hotel_Name").agg(numbers.rows_in(df).alias("total_reviews"), half_even(rating, 2).alias("avg_rating"),
                                       half_even(mood, 3).alias("avg_sentiment"))
    health = numbers.health_score(F.col("avg_rating"))
    return out.withColumn("health_score", health).withColumn("health_band", numbers.health_band(F.col("health_score")))


def top_hotels(df: DataFrame, n: int = 20) -> DataFrame:
    return (df.groupBy("Hotel_Name").agg(F.count("rating").alias("reviews"), half_even(exact_mean(F.col("rating")), 2).alias("avg_rating"))
            .orderBy(F.desc("reviews"), "Hotel_Name").limit(n))


def date_ranges(df: DataFrame) -> DataFrame:
    """First and last review of each hotel, the label of that range and its length in months."""
    return df.groupBy("Hotel_Name").agg(F.min("date").alias("first"), F.max("date").alias("last")).select(
        "Hotel_Name", dates.range_label(F.col("first"), F.col("last")).alias("date_range"),
        dates.calendar_months_between(F.col("first"), F.col("last")).alias("months"))


# --- time -------------------------------------------------------------------

def monthly_rating(df: DataFrame) -> DataFrame:
    """Mean rating per (hotel, month), with the hotel's mean over its months."""
    months = (df.filter(F.col("date").isNotNull())
              .groupBy("Hotel_Name", dates.year_month(F.col("date")).alias("month")).agg(exact_mean(F.col("rating")).alias("avg")))
    over_months = F.avg("avg").over(Window.partitionBy("Hotel_Name"))
    return months.select("Hotel_Name", "month", half_even(F.col("avg"), 4).alias("avg_rating"),
                         half_even(over_months, 4).alias("avg_line"))


def monthly_volume(df: DataFrame) -> DataFrame:
    """Rated reviews per calendar month; months without reviews show 0."""
    months = (df.filter(F.col("date").isNotNull()).groupBy(F.trunc("date", "month").alias("month"))
              .agg(F.count("rating").alias("reviews")))
    # One row with one entry per month: a calendar, whatever the number of reviews.
    series = months.agg(F.min("month").alias("first"), F.max("month").alias("last"),
                        F.map_from_entries(F.collect_list(F.struct("month", "reviews"))).alias("counts"))
    calendar = F.explode(F.sequence("first", "last", F.expr("interval 1 month")))
    return series.select("counts", calendar.alias("month")).select(
        dates.year_month(F.col("month")).alias("month"),
        F.coalesce(F.try_element_at("counts", F.col("month")), F.lit(0)).alias("reviews"))


def _recent_days(days: DataFrame, months: int) -> DataFrame:
    """Days within ``months`` calendar months of their hotel's latest; a hotel without dates keeps all rows."""
    latest = F.max("date").over(Window.partitionBy("Hotel_Name"))
    return days.withColumn("_latest", latest).filter(
        F.col("_latest").isNull() | (F.col("date") >= dates.months_before(F.col("_latest"), months))).drop("_latest")


def recent_snapshot(df: DataFrame, months: int = 1) -> DataFrame:
    """The last month of every hotel: reviews, mean rating, mean sentiment, share of positive reviews.

    Reviews are summed by day first; only days meet to find the last month.
    """
    scored = df if "sentiment_score" in df.columns else df.withColumn(
        "sentiment_score", lexicon.sentiment_score(F.col("review_text")))
    days = scored.groupBy("Hotel_Name", "date").agg(
        F.count(F.lit(1)).alias("reviews"), F.count("rating").alias("rated"), numbers.exact_sum(F.col("rating")).alias("stars"),
        F.count("sentiment_score").alias("scored"), numbers.exact_sum(F.col("sentiment_score")).alias("mood"),
        F.count_if(F.col("sentiment_score") > 0.3).alias("positive"))
    return _recent_days(days, months).groupBy("Hotel_Name").agg(
        F.sum("reviews").alias("reviews"), half_even(share(F.sum("stars"), F.sum("rated")), 2).alias("avg_rating"),
        half_even(share(F.sum("mood"), F.sum("scored")), 2).alias("avg_sentiment"),
        F.rint(share(F.sum("positive"), F.sum("scored")) * 100).alias("positive_pct"))


def rating_change(df: DataFrame) -> DataFrame:
    """Mean rating of each hotel's last month against its mean over all reviews, with the signed change as text."""
    days = df.groupBy("Hotel_Name", "date").agg(F.count("rating").alias("rated"), numbers.exact_sum(F.col("rating")).alias("stars"))

    def mean(name: str) -> Column:
        return half_even(share(F.sum("stars"), F.sum("rated")), 2).alias(name)

    overall = days.groupBy("Hotel_Name").agg(mean("overall_rating"))
    recent = _recent_days(days, 1).groupBy("Hotel_Name").agg(mean("recent_rating"))
    return overall.join(recent, "Hotel_Name").withColumn("change", numbers.signed_change(F.col("recent_rating"), F.col("overall_rating")))


# --- distributions ----------------------------------------------------------

def column_profile(df: DataFrame) -> DataFrame:
    """Type and missing values of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                      F.col(f.name).alias("missing"), percent(F.col(f.name), F.col("_rows"), 2).alias("missing_pct"))
             for f in df.schema.fields]
    return counts.select(F.inline(F.array(*cells)))


#: Distinct values of one part of a column in ``order_statistics``.
VALUES_A_PART = 500_000


def order_statistics(counted: DataFrame, ranks: DataFrame, values_a_part: int = VALUES_A_PART) -> DataFrame:
    """Rows (column, rank, found): the value at each rank, counted from 0, among the sorted values of its column.

    ``counted``: distinct rows (column, value, n); ``ranks``: a few rows (column, rank). Values are dealt to parts by ranges and
    the parts counted; running totals tell which part holds a rank, and only there values are
    added up one by one. No task sees more values than one part has, and the longest running total
    is as long as there are parts.
    """
    parts = max(1, -(-counted.count() // values_a_part))
    dealt = kept(counted.select("column", "value", "n").repartitionByRange(parts, "column", "value").withColumn("_part", F.spark_partition_id()), "quantile-parts")
    by_column = Window.partitionBy("column")
    totals = dealt.groupBy("column", "_part").agg(F.sum("n").alias("_in"))
    totals = totals.withColumn("_before", F.sum("_in").over(by_column.orderBy("_part")) - F.col("_in"))
    where = totals.join(ranks, "column").where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_in")))
    # one row a rank asked for; the parts it names are all that is read again
    near = dealt.join(F.broadcast(where.select("column", "_part", "rank", "_before")), ["column", "_part"])
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("column", "rank").orderBy("value"))
    return near.withColumn("_upto", upto).where(F.col("_upto") > F.col("rank")).groupBy("column", "rank").agg(F.min("value").alias("found"))


def describe(df: DataFrame, columns: Mapping[str, int], values_a_part: int = VALUES_A_PART) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of numeric columns.

    ``columns`` maps each column to the digits kept. Quartiles interpolate linearly
    and are exact: values are first reduced to (value, count), which are stored, and the six values
    that the quartiles lie between are found by ``order_statistics``. Any number of distinct values will do.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("digits"), F.col(c).cast("double").alias("value"))
                        for c, d in columns.items()])
    counted = kept(df.select(F.inline(entries)).filter(F.col("value").isNotNull())
                   .groupBy("column", "digits", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    total = F.sum("n")
    means = counted.groupBy("column").agg((F.sum(F.col("value") * F.col("n")) / total).alias("mean"), (total - 1).alias("last"))
    # One row a column asked for. Distances are taken from the mean, so that large values don't cancel.
    centred = counted.join(F.broadcast(means), "column")
    spread = F.sqrt(F.try_divide(F.sum(F.pow(F.col("value") - F.col("mean"), 2) * F.col("n")), total - 1))
    quartiles = [0.25, 0.5, 0.75]
    places = F.transform(F.array(*(F.lit(q) for q in quartiles)), lambda q: q * F.col("last"))
    ranks = means.select("column", F.explode(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))).alias("rank"))
    found = order_statistics(counted, ranks, values_a_part).groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("at"))

    def quartile(q: float) -> Column:
        place = F.col("last") * q
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    stats = centred.groupBy("column", "digits").agg(
        total.alias("count"), F.first("mean").alias("mean"), F.first("last").alias("last"), spread.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    scale = F.pow(F.lit(10.0), F.col("digits"))

    def rounded(c: Column, name: str) -> Column:
        return (F.rint(c * scale) / scale + 0.0).alias(name)

    return stats.join(F.broadcast(found), "column").select(
        "column", "count", rounded(F.col("mean"), "mean"), rounded(F.col("std"), "std"), rounded(F.col("min"), "min"),
        *(rounded(quartile(q), f"p{int(q * 100)}") for q in quartiles), rounded(F.col("max"), "max"))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal-width bin; the last bin includes its upper edge."""
    width = high - low
    at = F.floor((value - low) * float(bins) / F.when(width == 0, 1.0).otherwise(width))
    return F.least(at, F.lit(bins - 1))


def histogram(df: DataFrame, column: str, bins: int, clip: float | None = None) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value, empty bins included."""
    value = F.col(column).cast("double")
    value = numbers.at_most(value, clip) if clip is not None else value
    counted = df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    edges = counted.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    placed = counted.withColumn("e", edges).select("n", "e", bin_of(F.col("value"), F.col("e.low"), F.col("e.high"), bins).alias("bin"))
    binned = placed.groupBy("bin").agg(F.sum("n").alias("n"), F.first("e").alias("e"))
    # One row with one entry per bin.
    row = binned.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"), F.first("e").alias("e"))
    step, low = (F.col("e.high") - F.col("e.low")) / float(bins), F.col("e.low")
    return row.select("counts", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).select(
        "bin", half_even(low + step * F.col("bin"), 4).alias("lower"), half_even(low + step * (F.col("bin") + 1), 4).alias("upper"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("count"))


def topic_rating_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Rating histogram over the 1-5 scale per (hotel, topic), with and without the topic."""
    at = bin_of(F.col("rating"), F.lit(1.0), F.lit(5.0), bins).alias("bin")
    wide = df.filter(F.col("rating").isNotNull()).groupBy("Hotel_Name", at).agg(
        F.count(F.lit(1)).alias("all"), *[F.expr(f"count_if({flag(t)}) AS n_{t}") for t in TOPICS])
    rows = unpivot_topics(wide, ["Hotel_Name", "bin", "all"], {"with_topic": "n"})
    return rows.select("Hotel_Name", "topic", "bin", "with_topic", (F.col("all") - F.col("with_topic")).alias("without_topic"))


# --- sentiment profiles -----------------------------------------------------

def label_distribution(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Reviews per sentiment label, zeros included."""
    counts = df.agg(*[F.count_if(F.col(label) == l).alias(l) for l in LABELS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).alias("reviews")) for l in LABELS])))


def sentiment_by_rating(df: DataFrame, score: str = "sentiment_score") -> DataFrame:
    return (df.filter(F.col("rating").isNotNull()).groupBy(F.rint("rating").cast("int").alias("stars"))
            .agg(half_even(exact_mean(F.col(score)), 4).alias("avg_score"), F.count(F.lit(1)).alias("reviews")))


def label_share_by(df: DataFrame, column: str, label: str = "sentiment_label", top: int = 10) -> DataFrame:
    """Share of each label in percent, for the most frequent values of a column."""
    return rows_of_top(df.filter(F.col(column).isNotNull()), column, top).groupBy(column).agg(
        *[percent(F.count_if(F.col(label) == l), F.count(F.lit(1)), 4).alias(l) for l in LABELS])


def agreement_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(half_even(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")), 4).alias("agreement_rate"),
                  F.count(F.lit(1)).alias("reviews"))


def opinion_statistics(df: DataFrame) -> DataFrame:
    """Range of polarity, mean subjectivity, and how many reviews are objective or subjective."""
    return df.agg(half_even(F.min("polarity"), 3).alias("min_polarity"), half_even(F.max("polarity"), 3).alias("max_polarity"),
                  half_even(exact_mean(F.col("polarity")), 3).alias("avg_polarity"),
                  half_even(exact_mean(F.col("subjectivity")), 3).alias("avg_subjectivity"),
                  F.count_if(F.col("subjectivity") < 0.5).alias("objective"),
                  F.count_if(F.col("subjectivity") >= 0.5).alias("subjective"))
