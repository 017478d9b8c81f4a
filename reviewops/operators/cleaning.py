"""From raw reviews to clean reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from reviewops.functions import dates, numbers, text


def with_review_id(df: DataFrame) -> DataFrame:
    """Add ``review_id`` if there is none: 128 bits of hash of the row, the same on every run and layout.

    The row is written as JSON with its nulls, so a null in one column is not one in another.
    """
    if "review_id" in df.columns:
        return df
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    return df.withColumn("review_id", F.md5(whole.cast("binary")))


def with_review_text(df: DataFrame) -> DataFrame:
    if {"Negative_Review", "Positive_Review"} <= set(df.columns):
        return df.withColumn("review_text", text.combined_review(F.col("Negative_Review"), F.col("Positive_Review")))
    return df if "review_text" in df.columns else df.withColumn("review_text", F.lit(""))


def with_dates(df: DataFrame) -> DataFrame:
    """``Review_Date`` as DATE (unreadable ones NULL) and its short name ``date``."""
    if "Review_Date" not in df.columns:
        return df
    given = F.col("Review_Date")
    is_text = isinstance(df.schema["Review_Date"].dataType, T.StringType)
    df = df.withColumn("Review_Date", dates.load_date(given) if is_text else given.cast("date"))
    return df if "date" in df.columns else df.withColumn("date", F.col("Review_Date"))


def with_rating(df: DataFrame) -> DataFrame:
    if "Reviewer_Score" in df.columns:
        score = F.nanvl(F.col("Reviewer_Score").cast("double"), F.lit(None).cast("double"))
        return df.withColumn("rating", numbers.star_rating(score))
    return df if "rating" in df.columns else df.withColumn("rating", F.lit(None).cast("double"))


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter(~text.is_blank(F.col("review_text")))


#: Bits that mark hashes of rows that may have a copy: a table of at most BITS / 64 words of 16 bytes, sent to every task.
BITS = 1 << 25
#: Bytes of input whose rows are simply moved to meet their copies: below, reading them twice more costs more than moving them.
MOVED_BYTES = 1 << 30


def input_bytes(df: DataFrame) -> int:
    """What Spark knows of the size of the tables that a frame is made of."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def distinct_rows(df: DataFrame, bits: int = BITS, moved_bytes: int = MOVED_BYTES) -> DataFrame:
    """The rows without exact copies; nulls are equal, as in ``dropDuplicates``.

    Of large inputs the texts stay where they are. Hashes of rows are counted first, eight bytes each, and those
    that occur again are marked in a bit table of fixed size. A row whose bit isn't set has no copy
    and stays in place. The others meet and are compared whole: copies collapse inside each
    map task, and rows that only share a bit are told apart there. The more copies
    there are, the fuller the table and the more rows meet, up to all of them; the answer is the same, and so it is
    for inputs of up to ``moved_bytes``, whose rows all meet.
    """
    if input_bytes(df) <= moved_bytes:
        return df.dropDuplicates()
    names = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_hash", F.xxhash64(*names)) if names else df.withColumn("_hash", F.lit(0).cast("bigint"))
    place = F.pmod(F.col("_hash"), F.lit(bits))
    again = hashed.select("_hash").groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marks = again.groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("_mask"))
    marked = hashed.withColumns({"_word": F.shiftright(place, 6), "_bit": (place % 64).cast("int")}).join(F.broadcast(marks), "_word", "left")
    seen = F.coalesce(F.getbit("_mask", F.col("_bit")) == 1, F.lit(False))
    alone, several = marked.where(~seen).select(*names), marked.where(seen).select(*names)
    return alone.unionAll(several.dropDuplicates())


def clean_reviews(df: DataFrame) -> DataFrame:
    """Deduplicate, combine the review fields, drop empty reviews, parse dates, add length, words and rating."""
    return (df.transform(distinct_rows)
            .transform(with_review_id)
            .transform(with_review_text)
            .transform(drop_empty)
            .transform(with_dates)
            .withColumn("review_length", F.length("review_text"))
            .withColumn("word_count", text.word_count(F.col("review_text")))
            .transform(with_rating))
