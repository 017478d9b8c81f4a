"""Reading, mapping and checking review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reviewops.fixed_values import COLUMN_ALIASES, FALLBACK_HOTEL
from reviewops.functions.dates import load_date
from reviewops.functions.numbers import percent

TEXT_COLUMNS = ["Hotel_Name", "Negative_Review", "Positive_Review", "Hotel_Address"]
REQUIRED_COLUMNS = ["Hotel_Name", "Negative_Review", "Positive_Review", "Reviewer_Score"]


def _as_date(df: DataFrame, column: str) -> Column:
    text = isinstance(df.schema[column].dataType, T.StringType)
    return load_date(F.col(column)) if text else F.col(column).cast("date")


def _as_score(df: DataFrame, column: str) -> Column:
    value = F.col(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def canonical_reviews(df: DataFrame) -> DataFrame:
    """Guarantee the six review columns with their types; other columns pass through."""
    columns = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in TEXT_COLUMNS}
    columns["Review_Date"] = _as_date(df, "Review_Date") if "Review_Date" in df.columns else F.lit(None).cast("date")
    columns["Reviewer_Score"] = (_as_score(df, "Reviewer_Score") if "Reviewer_Score" in df.columns
                                 else F.lit(None).cast("double"))
    return df.withColumns(columns)


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Read CSV (with header), JSON or Parquet. CSV columns stay text; nothing is sampled for types.

    ``multi_line`` allows line breaks in quoted CSV fields. Spark then reads each file in one
    task, however large, so give such tables as many files.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
    return reader.load(path)


def read_reviews(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Reviews with the canonical columns."""
    return canonical_reviews(read_table(spark, path, fmt, multi_line=multi_line))


def _first_column(columns: list[str], aliases: list[str]) -> str | None:
    known = {c.lower().strip(): c for c in columns}
    return next((known[a] for a in aliases if a in known), None)


def normalise_columns(df: DataFrame, fallback_hotel: str = FALLBACK_HOTEL) -> DataFrame:
    """Map the columns of an uploaded table to the canonical ones.

    Scores of a table whose best score is at most 5 are doubled to the ten-point
    scale. That best score is a scalar subquery: one row computed once, no join.
    """
    found = {name: _first_column(df.columns, aliases) for name, aliases in COLUMN_ALIASES.items()}

    def text_of(column: str | None, otherwise: str = "") -> Column:
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(otherwise)) if column else F.lit(otherwise)

    score = F.lit(None).cast("double")
    if found["Reviewer_Score"]:
        given = df.select(F.col(f"`{found['Reviewer_Score']}`").alias("_score"))
        best = given.agg(F.max(_as_score(given, "_score"))).scalar()
        value = F.col(f"`{found['Reviewer_Score']}`").try_cast("double")
        value = F.when(~F.isnan(value), value)
        score = F.when(best <= 5, value * 2).otherwise(value)
    day = F.lit(None).cast("date")
    if found["Review_Date"]:
        column = F.col(f"`{found['Review_Date']}`")
        is_text = isinstance(df.schema[found["Review_Date"]].dataType, T.StringType)
        day = load_date(column) if is_text else column.cast("date")
    return df.select(
        text_of(found["Hotel_Name"], fallback_hotel).alias("Hotel_Name"), day.alias("Review_Date"),
        score.alias("Reviewer_Score"), text_of(found["Negative_Review"]).alias("Negative_Review"),
        text_of(found["Positive_Review"] or found["review_text"]).alias("Positive_Review"),
        text_of(found["Hotel_Address"]).alias("Hotel_Address"))


def validate_reviews(df: DataFrame) -> DataFrame:
    """Per required column: whether it is there, rows and missing values."""
    here = [c for c in REQUIRED_COLUMNS if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in here])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(c in here).alias("present"), F.col("_rows").alias("rows"),
                      (F.col(c) if c in here else F.col("_rows")).alias("missing")) for c in REQUIRED_COLUMNS]
    return counts.select(F.inline(F.array(*cells))).withColumn("missing_pct", percent(F.col("missing"), F.col("rows"), 2))
