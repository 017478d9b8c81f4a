"""Reviews made from the order tables: one review per order, one hotel per nation.

The benchmark tables hold no reviews. This view derives them from whole tables with
nothing but arithmetic on keys, so that its size follows the data. It contains what
real reviews contain: unreadable dates, missing scores, placeholders, blank fields and
exact copies (every fiftieth review occurs twice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewops.functions.text import words_in

NEGATIVE = [
    "Room was dirty and smelly, rushed quick clean", "No Negative", "Staff were rude and clueless at reception",
    "The shower was broken and not working", "Very noisy street noise all night",
    "wifi was slow and no internet, no response", "Breakfast was cold food, ran out of eggs",
    "Overpriced for what it was", "Far from the metro", "Nothing",
    "They were understaffed, not enough staff, waited ages", "Booking error and wrong room, chaotic",
    "Nobody told us about the broken lift", "No towels and dust everywhere", "N/A",
    "Loud party next door, no idea who to call", "Price too expensive, mistake on the fee",
    "Dirty bathroom, out of order shower, new staff", "", "Nothing negative",
]
POSITIVE = ["Great location", "No Positive", "Lovely view", "Helpful staff", "Nothing", "Comfortable bed", "Good breakfast buffet", ""]
COUNTRIES = ["United Kingdom", "France", "Germany", "Spain", "Italy", "Ireland", "Norway", "Poland", "Greece", "Japan", "Brazil", "Kenya"]


# Columns read of each table. A given schema saves the job that would look it up.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "labels": "doc_id bigint, quality int, toxic int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "benchmark": "item_id bigint, text string",
    "documents": "doc_id bigint, text string, source string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(words_in(values), (index + 1).cast("int"))


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews, as they would come out of a CSV file: text dates, ten-point scores."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    key, guest = F.col("o_orderkey"), F.col("o_custkey")
    score = (40 + (key * 37) % 61 - 5 * ((key * 7 + guest) % 4)).cast("double") / 10.0
    copies = F.when(key % 50 == 0, 2).otherwise(1)
    return orders.join(customers, "o_custkey").join(nations, "c_nationkey").select(
        key.alias("review_id"), F.col("n_name").alias("Hotel_Name"), F.concat(F.lit("Street "), "n_name").alias("Hotel_Address"),
        F.when(key % 97 == 0, "not a date").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("Review_Date"),
        F.when(key % 101 == 0, None).otherwise(score).alias("Reviewer_Score"),
        _pick(NEGATIVE, (key * 7 + guest) % 20).alias("Negative_Review"),
        _pick(POSITIVE, (key * 5 + guest) % 8).alias("Positive_Review"),
        _pick(COUNTRIES, (key * 3 + guest) % 12).alias("Reviewer_Nationality"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop("_copy")


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as reviews of their sources: text only, no score and no date."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("Hotel_Name"), F.col("text").alias("review_text"))


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as dated and scored reviews: document i is what the guest of order i wrote.

    Hotel, date and score come from the order as in ``order_reviews``. A document without an order is a review
    of its source, without date and score.
    """
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    score = (40 + (F.col("o_orderkey") * 37) % 61 - 5 * ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 4)).cast("double") / 10.0
    ordered = orders.select(F.col("o_orderkey").alias("doc_id"), "n_name", "o_orderdate", score.alias("Reviewer_Score"))
    return table(spark, sf_dir, "documents").join(ordered, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"), F.coalesce("n_name", "source").alias("Hotel_Name"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Review_Date"),
        "Reviewer_Score", F.col("text").alias("review_text"))


def praise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean reviews without any complaint: suppliers praise the hotel of their region."""
    rows = (table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return rows.select((-1 - F.col("s_suppkey")).alias("review_id"), F.col("r_name").alias("Hotel_Name"), F.lit("1998-01-01").cast("date").alias("date"),
                       F.lit(4.0).alias("rating"), F.lit("Lovely view").alias("review_text"))


def hotel_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms per hotel: 20 per supplier of the nation; nations without suppliers are left out."""
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return suppliers.join(table(spark, sf_dir, "nation"), "n_nationkey").select(
        F.col("n_name").alias("Hotel_Name"), (F.col("n") * 20).cast("int").alias("rooms"))
