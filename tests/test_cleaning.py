import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewops.functions import dates, numbers, text
from reviewops.operators import cleaning, filters
from reviewops.sources import reviews

RAW = [("Hotel A", "1 Road", "8/3/2017", 4.0, "Room was dirty", "Great staff"),
       ("Hotel A", "1 Road", "8/4/2017", 8.0, "No Negative", "Nice breakfast"),
       ("Hotel B", "2 Road", "bad", 6.0, "Noisy corridors", "")]
COLUMNS = "Hotel_Name string, Hotel_Address string, Review_Date string, Reviewer_Score double, Negative_Review string, Positive_Review string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, COLUMNS)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_clean_reviews(raw):
    rows = {r.review_text: r for r in cleaning.clean_reviews(raw.unionAll(raw)).collect()}
    assert set(rows) == {"Room was dirty Great staff", "Nice breakfast", "Noisy corridors"}
    first = rows["Room was dirty Great staff"]
    assert (first.date, first.rating, first.word_count, first.review_length) == (dt.date(2017, 8, 3), 2.0, 5, 26)
    assert rows["Noisy corridors"].date is None and rows["Nice breakfast"].rating == 4.0


def test_review_id_does_not_depend_on_layout(raw):
    ids = [sorted(r.review_id for r in cleaning.clean_reviews(raw.repartition(n)).collect()) for n in (1, 3)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3


def test_missing_scores_and_clipping(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (11.0,), (7.0,)], "Reviewer_Score double")
    assert [r.rating for r in cleaning.with_rating(df).collect()] == [None, None, 1.0, 5.0, 3.5]


@pytest.mark.parametrize("negative, positive, expected", [
    ("Room was dirty", "Great staff", "Room was dirty Great staff"), ("No Negative", " Nice ", "Nice"), ("bad\n", "N/A", "bad"),
    ("nothing", "No Positive", ""), (None, "ok", "ok"), ("", None, ""), ("Nothing negative", "", "Nothing negative")])
def test_combined_review(spark, negative, positive, expected):
    df = spark.createDataFrame([(negative, positive)], "n string, p string")
    assert df.select(text.combined_review(F.col("n"), F.col("p")).alias("t")).first().t == expected


@pytest.mark.parametrize("given, expected", [
    ("Hello, WORLD!!", "hello world"), ("see http://a.b?d now", "see d now"), ("  don't\n stop ", "don't stop"), (None, ""), ("", "")])
def test_clean_text(spark, given, expected):
    assert one(spark, text.clean_text, given) == expected


def test_words_negation_truncation(spark):
    assert one(spark, text.word_count, " a\tb c ") == 3 and one(spark, text.word_count, "  ") == 0
    assert one(spark, text.tokenize, "A b") == ["a", "b"] and one(spark, text.tokenize, "") == []
    assert one(spark, text.has_negation, "It WASN'T good") and not one(spark, text.has_negation, "nothing noted")
    assert one(spark, lambda c: text.truncate_words(c, 2), "a b  c") == "a b..." and one(spark, lambda c: text.truncate_words(c, 3), "a b  c") == "a b  c"
    assert one(spark, lambda c: text.remove_words(text.tokenize(c), ["the"]), "the cat the cat") == ["cat", "cat"]
    assert one(spark, text.is_placeholder, " Nothing Negative ") and not one(spark, text.is_placeholder, "dirty")
    assert one(spark, text.adjacent_pairs, ["a", "b", "c"], "array<string>") == ["a b", "b c"]
    assert one(spark, text.adjacent_pairs, ["a"], "array<string>") == []
    assert one(spark, text.term_tokens, "Café wi-fi a1 x ÜBER") == ["cafe", "wi", "fi", "uber"]
    assert one(spark, text.sentences, "Good. Bad!! so") == ["Good.", "Bad!!", "so"]


@pytest.mark.parametrize("given, expected", [
    ("08/03/2017", dt.date(2017, 8, 3)), ("2017-8-3", dt.date(2017, 8, 3)), ("31/12/2016", dt.date(2016, 12, 31)),
    ("August 3, 2017", dt.date(2017, 8, 3)), (" 3 August 2017 ", dt.date(2017, 8, 3)), ("soon", None), ("", None), (None, None)])
def test_parse_date(spark, given, expected):
    assert one(spark, dates.parse_date, given) == expected


@pytest.mark.parametrize("given, expected", [
    ("2017-08-03 10:15:00", dt.date(2017, 8, 3)), ("2017-08-03T10:15:00Z", dt.date(2017, 8, 3)), ("Aug 3, 2017", dt.date(2017, 8, 3)),
    ("3 Aug 2017", dt.date(2017, 8, 3)), ("2017/08/03", dt.date(2017, 8, 3)), ("20170803", dt.date(2017, 8, 3)), ("AUGUST 3 2017", dt.date(2017, 8, 3)),
    ("8/3/2017 9:05", dt.date(2017, 8, 3)), ("31.12.2016", dt.date(2016, 12, 31)), ("2017-08-03T10:15:00.123+02:00", dt.date(2017, 8, 3)),
    ("08/03/2017", dt.date(2017, 8, 3)), ("31/12/2016", dt.date(2016, 12, 31)), ("3 August 2017", dt.date(2017, 8, 3)),
    ("2017-13-45", None), ("99999999", None), ("soon", None), ("", None), (None, None)])
def test_load_date(spark, given, expected):
    assert one(spark, dates.load_date, given) == expected


def test_row_hash_sees_nulls(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), ("x", "")], "a string, b string")
    assert cleaning.with_review_id(rows).select("review_id").distinct().count() == 3


def test_means_of_large_values(spark):
    df = spark.createDataFrame([(1500.0,), (4.0,), (None,)], "v double")
    assert df.agg(numbers.exact_mean(F.col("v"))).first()[0] == 752.0


def test_date_helpers(spark):
    df = spark.createDataFrame([(dt.date(2015, 1, 31), dt.date(2017, 12, 1))], "a date, b date")
    row = df.select(dates.range_label(F.col("a"), F.col("b")), dates.calendar_months_between(F.col("a"), F.col("b")),
                    dates.calendar_months_between(F.col("b"), F.col("a")), dates.months_before(F.lit(dt.date(2017, 3, 31)), 1)).first()
    assert tuple(row) == ("Jan 2015 – Dec 2017", 35, 0, dt.date(2017, 2, 28))


def test_numbers(spark):
    assert one(spark, lambda c: numbers.half_even(c, 1), 12.25, "double") == 12.2
    assert str(one(spark, lambda c: numbers.half_even(c, 2), -0.001, "double")) == "0.0"
    assert one(spark, numbers.money, 1250.0, "double") == "£1,250" and one(spark, numbers.money, 0.0, "double") == "£0"
    assert [one(spark, numbers.compact_money, v, "double") for v in (2_500_000.0, 1_500.0, 12.0)] == ["£2.5M", "£1.5K", "£12"]
    assert one(spark, numbers.star_text, 2.5, "double") == "⭐⭐" and one(spark, numbers.star_text, 0.2, "double") == "⭐"
    assert one(spark, lambda c: numbers.signed_change(c, F.lit(3.0)), 3.5, "double") == "+0.5"
    assert [one(spark, numbers.stat_label, v, "double") for v in (8.0, 6.0, 5.9)] == ["Good", "Average", "Poor"]


def test_filter_recent_is_inclusive_and_keeps_undated_groups(spark):
    days = [("a", dt.date(2020, 3, 31)), ("a", dt.date(2020, 2, 29)), ("a", dt.date(2020, 2, 28)), ("b", None)]
    df = spark.createDataFrame(days, "Hotel_Name string, date date")
    kept = filters.filter_recent(df, "date", 1).collect()
    assert sorted((r.Hotel_Name, str(r.date)) for r in kept) == [("a", "2020-02-29"), ("a", "2020-03-31"), ("b", "None")]


def test_hotel_filter_and_search(raw):
    assert filters.for_hotel(raw, " Hotel A ").count() == 2 and filters.for_hotel(raw, "none").count() == 0
    assert [r.Hotel_Name for r in filters.search_hotels(raw, "TEL B").collect()] == ["Hotel B"]
    assert [r.Hotel_Name for r in filters.search_hotels(raw).collect()] and "Hotel A" in {r.Hotel_Name for r in filters.search_hotels(raw).collect()}


def test_read_csv_fills_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Hotel_Name,Review_Date,Reviewer_Score,Negative_Review,Tags\nA,8/3/2017,x,"line one\nline ""two""",t\nB,,7.5,,u\n')
    rows = reviews.read_reviews(spark, str(tmp_path / "r.csv"), multi_line=True).orderBy("Hotel_Name").collect()
    assert rows[0].Negative_Review == 'line one\nline "two"' and rows[0].Reviewer_Score is None and rows[0].Review_Date == dt.date(2017, 8, 3)
    assert (rows[1].Negative_Review, rows[1].Positive_Review, rows[1].Hotel_Address, rows[1].Reviewer_Score, rows[1].Tags) == ("", "", "", 7.5, "u")


@pytest.mark.parametrize("scores, expected", [([4.0, 5.0, None], [8.0, 10.0, None]), ([4.0, 9.0, None], [4.0, 9.0, None])])
def test_upload_mapping_scales_stars(spark, scores, expected):
    upload = spark.createDataFrame([(s, "fine", str(i)) for i, s in enumerate(scores)], "Stars double, `Review Body` string, Cons string")
    rows = sorted(reviews.normalise_columns(upload).collect(), key=lambda r: r.Negative_Review)
    assert [r.Reviewer_Score for r in rows] == expected
    assert rows[0].Hotel_Name == "Uploaded Hotel" and rows[0].Positive_Review == "fine" and rows[0].Review_Date is None


def test_validate_reviews(raw):
    rows = {r.column: r for r in reviews.validate_reviews(raw.drop("Positive_Review")).collect()}
    assert not rows["Positive_Review"].present and rows["Positive_Review"].missing == 3 and rows["Hotel_Name"].missing == 0


@pytest.mark.parametrize("bits", [1 << 25, 64, 1 << 12])
def test_distinct_rows(spark, bits):
    """As ``dropDuplicates``, however many rows share a bit; only rows with a marked bit are exchanged."""
    rows = [(i % 700, None if i % 5 == 0 else f"text {i % 700}", float("nan") if i % 7 == 0 else i % 3 / 2) for i in range(1000)] + [(None, None, None)] * 3 + [(1, "a", -0.0), (1, "a", 0.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    got, want = (sorted(str(tuple(r)) for r in d.collect()) for d in (cleaning.distinct_rows(df, bits, 0), df.dropDuplicates()))
    assert got == want
    assert cleaning.distinct_rows(df.limit(0), bits, 0).count() == 0


def test_distinct_rows_leaves_texts_in_place(spark, tmp_path):
    spark.range(1000).selectExpr("id", "repeat(cast(id as string), 50) as body").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < cleaning.input_bytes(table) < cleaning.MOVED_BYTES
    plan = cleaning.distinct_rows(table, moved_bytes=0)._jdf.queryExecution().sparkPlan().toString()
    alone = plan.split("HashAggregate(keys=[id", 1)[0]  # what comes before is the branch of rows without a copy
    assert "Union" in plan and "BroadcastHashJoin" in alone and "hashpartitioning(body" not in plan and alone.count("SortMergeJoin") == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_date_filters_with_few_and_many_groups(spark, monkeypatch, most):
    """Bounds broadcast, or matched by group and day: the same rows; a group without dates stays whole."""
    monkeypatch.setattr(filters, "MOST_GROUPS", most)
    rows = [(i, f"h{i % 7}", dt.date(2017, 1, 1) + dt.timedelta(days=i % 900) if i % 11 else None) for i in range(3000)] + [(9999, "undated", None), (9998, "undated", None)]
    df = spark.createDataFrame(rows, "review_id int, Hotel_Name string, date date")
    last = {h: max((d for _, x, d in rows if x == h and d), default=None) for h in {r[1] for r in rows}}
    first = {h: min((d for _, x, d in rows if x == h and d), default=None) for h in last}
    recent = filters.filter_recent(df, months=3)
    plan = recent._jdf.queryExecution().sparkPlan().toString()
    assert ("BroadcastHashJoin [Hotel_Name" in plan and "LeftSemi" not in plan) if most else "LeftSemi" in plan
    start = {h: dt.date(d.year + (d.month - 4) // 12, (d.month - 4) % 12 + 1, min(d.day, 28)) if d else None for h, d in last.items()}
    got = {r.review_id for r in recent.collect()}
    certain = {i for i, h, d in rows if last[h] is None or (d and d >= start[h] + dt.timedelta(days=3))}
    assert certain <= got <= {i for i, h, d in rows if last[h] is None or (d and d >= start[h])}
    year = {i for i, h, d in rows if d and max(first[h], last[h] - dt.timedelta(days=365)) <= d <= last[h]}
    assert {r.review_id for r in filters.date_between(df).collect()} == year
