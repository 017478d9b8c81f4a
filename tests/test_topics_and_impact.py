import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from reviewops.fixed_values import TOPIC_KEYWORDS, TOPICS
from reviewops.functions import numbers, text
from reviewops.operators import groups, impact, keywords, profiles, topics


def topics_of(spark, *texts):
    df = topics.add_topics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, review_text string"))
    return [r.topics for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("sentence, topic", [
    ("The room was filthy and dirty with stains", "cleanliness"), ("The receptionist was rude and unhelpful", "staff"),
    ("It was extremely loud all night, very noisy", "noise"), ("The internet connection was slow and kept dropping", "wifi"),
    ("The breakfast buffet had limited food choices", "breakfast"), ("The price was too expensive for what was offered", "value"),
    ("The air conditioning was broken and the lift was out of order", "maintenance"), ("Far from the city centre", "location")])
def test_topic_sentences(spark, sentence, topic):
    assert topic in topics_of(spark, sentence)[0]


def test_topics_match_inside_words_in_dictionary_order(spark):
    assert topics_of(spark, "nice place", "Wi-Fi and DUST", "", None) == [["maintenance"], ["cleanliness", "wifi"], [], []]


def test_minimal_keywords_give_the_same_answer():
    samples = [" ".join(ws) for words in TOPIC_KEYWORDS.values() for ws in zip(words, words[1:])] + ["nothing to see", "tea", "centr"]
    for words in TOPIC_KEYWORDS.values():
        small = text.minimal_keywords(words)
        assert all(any(k in s for k in words) == any(k in s for k in small) for s in samples)


def test_word_boundary(spark):
    df = spark.createDataFrame([("nice place",), ("the ac failed",)], "review_text string")
    assert [r.topics for r in topics.add_topics(df, word_boundary=True).collect()] == [[], ["maintenance"]]


def test_flags_from_given_topics_or_nothing(spark):
    given = topics.add_topic_flags(spark.createDataFrame([(["staff"],), (None,)], "topics array<string>")).collect()
    assert given[0].has_staff and not given[0].has_wifi and given[1].has_staff is False
    assert topics.add_topic_flags(spark.createDataFrame([(1,)], "x int")).first().has_noise is False


def rated(spark, rows):
    """rows: (hotel, date, rating, has_noise)"""
    df = spark.createDataFrame(rows, "Hotel_Name string, date date, rating double, noisy boolean")
    flags = {topics.flag(t): F.lit(False) for t in TOPICS} | {"has_noise": F.col("noisy")}
    return df.withColumns(flags).withColumn("review_id", F.xxhash64("Hotel_Name", "date", "rating", "noisy"))


def noise(df):
    return df.filter("topic = 'noise'").first()


def test_impact_one_side_empty_negative_and_null(spark):
    day = dt.date(2020, 1, 1)
    assert noise(impact.impact_table(rated(spark, [("a", day, 2.0, True), ("a", day, 4.5, False)]))).impact == 2.5
    assert noise(impact.impact_table(rated(spark, [("a", day, 2.0, False)]))).impact == 0.0
    assert noise(impact.impact_table(rated(spark, [("a", day, 2.0, True)]))).impact == 0.0
    assert noise(impact.impact_table(rated(spark, [("a", day, 4.0, True), ("a", day, 2.0, False)]))).impact == 0.0
    row = noise(impact.impact_table(rated(spark, [("a", None, None, True), ("a", day, 2.0, False)])))
    assert (row.complaint_count, row.complaint_rate, row.avg_rating_with, row.avg_rating_without, row.impact) == (1, 50.0, None, 2.0, 0.0)


def months(rates, start=1):
    """Ten reviews per month; rate = noisy ones in tenths. None leaves the month out."""
    return [("a", dt.date(2020, start + m, 1 + i), 3.0, i < r) for m, r in enumerate(rates) if r is not None for i in range(10)]


@pytest.mark.parametrize("rates, trend, recent, previous", [
    ([1, 1, 1, 9, 9], "STABLE", 63.3, 63.3),              # five months: nothing to compare with
    ([1, 1, 1, 3, 3, 3], "INCREASING", 30.0, 10.0),
    ([3, 3, 3, 1, 1, 1], "DECREASING", 10.0, 30.0),
    ([1, None, 1, 1, None, 3, 3, 3], "INCREASING", 30.0, 10.0),  # months without reviews do not count
    ([2, 2, 2, 2, 2, 2], "STABLE", 20.0, 20.0)])
def test_trends(spark, rates, trend, recent, previous):
    row = noise(impact.trends(rated(spark, months(rates))))
    assert (row.trend, row.recent_rate, row.previous_rate) == (trend, recent, previous)
    assert len(row.monthly_data) == sum(r is not None for r in rates)


@pytest.mark.parametrize("noisy, trend", [(3, "STABLE"), (4, "INCREASING")])
def test_trend_threshold_is_strict(spark, noisy, trend):
    rows = [("a", dt.date(2020, 1 + m, 1 + i % 25), 3.0 + i / 1000, i < (noisy if m >= 3 else 0)) for m in range(6) for i in range(100)]
    assert noise(impact.trends(rated(spark, rows))).trend == trend


def test_undated_hotels_have_no_trend_but_are_ranked(spark):
    df = rated(spark, [("a", None, 2.0, True), ("a", None, 4.0, False)])
    assert impact.trends(df).count() == 0
    row = impact.ranked_issues(df).first()
    assert (row.topic, row.frequency, row.impact, row.trend, row.rank) == ("noise", 50.0, 2.0, "STABLE", 1)


@pytest.mark.parametrize("frequency, imp, trend, score, category", [
    (100.0, 5.0, "INCREASING", 82.0, "CRITICAL"), (50.0, 0.0, "DECREASING", 20.0, "MEDIUM"), (49.7, 0.0, "DECREASING", 19.9, "LOW"),
    (100.0, 0.0, "DECREASING", 40.0, "HIGH"), (100.0, 2.5, "DECREASING", 60.0, "CRITICAL"), (10.0, 0.0, "other", 5.0, "LOW"),
    (200.0, 5.0, "STABLE", 100.0, "CRITICAL")])
def test_priority(spark, frequency, imp, trend, score, category):
    df = impact.with_priority(spark.createDataFrame([(frequency, imp, trend)], "frequency double, impact double, trend string")).first()
    assert (df.priority_score, df.priority_category) == (score, category)


def test_results_do_not_depend_on_layout(spark):
    df = rated(spark, months([1, 4, 2, 8, 3, 3, 7]) + [("b", dt.date(2020, 5, 5), 1.1 + i / 7, i % 3 == 0) for i in range(50)])
    seen = [sorted(map(str, impact.all_issues(df.repartition(n)).collect())) for n in (1, 5, 13)]
    assert seen[0] == seen[1] == seen[2]


def test_first_n_with_one_hot_group(spark):
    df = spark.range(0, 30_000, numPartitions=16).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1))
    got = {(r.k, r.rn): r.id for r in groups.first_n(df, ["k"], [F.desc("id")], 3).collect()}
    best = {}
    for i in range(29_999, -1, -1):
        best.setdefault(i % 50 if i % 3 == 0 else -1, []).append(i)
    assert got == {(k, n + 1): v for k, ids in best.items() for n, v in enumerate(ids[:3])}


def test_cooccurrence_matches_brute_force(spark):
    sets = [["staff", "wifi"], ["staff", "wifi", "noise"], ["noise"], []]
    df = topics.add_topic_flags(spark.createDataFrame([(s,) for s in sets], "topics array<string>"))
    got = {(r.topic_a, r.topic_b): r.reviews for r in topics.topic_cooccurrence(df).collect()}
    assert len(got) == 64
    assert all(n == (0 if a == b else sum(a in s and b in s for s in sets)) for (a, b), n in got.items())


def test_profiles(spark):
    df = rated(spark, [("a", dt.date(2020, 1, 31), 1.0, True), ("a", dt.date(2020, 4, 1), 2.0, False), ("a", None, 5.0, False), ("b", dt.date(2020, 4, 2), None, False)])
    assert [(r.month, r.reviews) for r in profiles.monthly_volume(df).orderBy("month").collect()] == [("2020-01", 1), ("2020-02", 0), ("2020-03", 0), ("2020-04", 1)]
    row = profiles.describe(df, {"rating": 3}).first()
    assert (row["count"], row["mean"], row["std"], row["p25"], row["p50"], row["p75"]) == (3, 2.667, 2.082, 1.5, 2.0, 3.5)
    assert [r["count"] for r in profiles.histogram(df, "rating", 4).orderBy("bin").collect()] == [1, 1, 0, 1]
    raw = spark.createDataFrame([("a ", 7.0, dt.date(2020, 1, 1))], "Hotel_Name string, Reviewer_Score double, Review_Date date")
    names = spark.createDataFrame([("a",), ("z",)], "Hotel_Name string")
    got = {r.Hotel_Name: tuple(r)[1:] for r in profiles.hotel_stats(raw, names).collect()}
    assert got == {"a": (1, 7.0, "2020-01-01", "2020-01-01", "Average"), "z": (0, 0.0, "N/A", "N/A", "Poor")}


def test_health_bands(spark):
    df = spark.createDataFrame([(4.0,), (3.0,), (2.99,), (5.0,)], "r double").select(numbers.health_score(F.col("r")).alias("h"))
    assert [(r.h, r.b) for r in df.withColumn("b", numbers.health_band(F.col("h"))).collect()] == [(80, "good"), (60, "fair"), (59, "poor"), (100, "good")]


def test_order_statistics_of_ten_million_values(spark):
    """Distinct doubles: each part holds a fraction of them, and the values are exact."""
    n = 10_000_000
    counted = spark.range(n).select(F.lit("x").alias("column"), (F.col("id") * 7919 % n / 3).cast("double").alias("value"), F.lit(1).cast("bigint").alias("n"))
    ranks = [0, 1, n // 4, n // 2, n - 2, n - 1]
    got = profiles.order_statistics(counted, spark.createDataFrame([("x", r) for r in ranks], "column string, rank bigint")).collect()
    assert {r["rank"]: r.found for r in got} == {r: r / 3 for r in ranks}


def test_describe_over_many_parts(spark):
    values = [None, 2.5, 2.5, 2.5, -1.0, 0.0, 1e300, 7.25, 3.0, 1e-9]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, w int")
    got = {r["column"]: r for r in profiles.describe(df, {"v": 3, "w": 2}, values_a_part=2).collect()}
    assert [got["v"][c] for c in ("count", "min", "p25", "p50", "p75", "max")] == [9, -1.0, 0.0, 2.5, 3.0, 1e300]
    assert [got["w"][c] for c in ("count", "mean", "p25", "p50", "p75")] == [10, 4.5, 2.25, 4.5, 6.75]


@pytest.mark.parametrize("whole", [False, True])
def test_keyword_tables(spark, whole):
    """Against a search of every text for every keyword: short and long ones, signs, capitals, overlaps at the end of a slice."""
    texts = ["The WIFI is slow, c++ too", None, "", "a", "ab", "éclair Éclair", "x" * (1 << 16) + "needle in hay", "y" * ((1 << 16) - 3) + "needle", "wifi" * 3, "no match at all", "a.b (c) [d]"] + ["common words here"] * 30
    words = ["wifi", "slow", "a", "ab", "ÉCLAIR", "needle", "needle in hay", "common words", "c++", "(c) [d]", "", None, "absent keyword", "words here", "is", "i"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, review_text string").withColumn("run", F.lit(1))
    table = spark.createDataFrame([(w, f"t{i % 4}") for i, w in enumerate(words)] + [("wifi", "t9")], "keyword string, topic string")
    got = sorted((r.review_id, r.keyword, r.topic) for r in keywords.keyword_matches(df, table, word_boundary=whole).collect())

    def holds(text, word):
        return re.search(rf"\b{re.escape(word.lower())}\b", text.lower()) if whole else word.lower() in text.lower()

    want = sorted((i, w, t) for i, x in enumerate(texts) if x for w, t in [tuple(r) for r in table.collect()] if w and holds(x, w))
    assert got == want and len(want) > 40
    plan = keywords.keyword_matches(df, table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_dictionary_topics_equal_fixed_lists(spark):
    texts = ["The wifi was slow", "Rude staff and dirty room", "lovely", None, "WiFi, noise; price"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, review_text string")
    fixed = {r.review_id: sorted(r.topics) for r in topics.add_topics(df).collect()}
    table = keywords.keyword_table(TOPIC_KEYWORDS, spark)
    assert {r.review_id: r.topics for r in keywords.dictionary_topics(df, table).collect()} == fixed
    none = keywords.dictionary_topics(df, table.limit(0))
    assert {tuple(r.topics) for r in none.collect()} == {()}


def test_runs_no_chosen_keyword_has_are_no_rows(spark):
    """Of all runs of a text only the rarest of each keyword becomes a row: here one row for one text."""
    rows = spark.createDataFrame([(i, "common words are here") for i in range(50)] + [(99, "common words and a zebrafish")], "_key long, _text string")
    table = spark.createDataFrame([("common words and a zebrafish",)], "keyword string")
    found = keywords.keyword_matches(rows.withColumnsRenamed({"_key": "review_id", "_text": "review_text"}), table)
    assert [(r.review_id, r.keyword) for r in found.collect()] == [(99, "common words and a zebrafish")]
    index = keywords._placed(spark.createDataFrame([("a zebr",)], "run string"))
    assert [tuple(r) for r in keywords._text_runs(rows, index, [6]).collect()] == [(99, "a zebr")]
    assert sum(r.n for r in keywords._spread(rows, keywords._placed(spark.createDataFrame([("common",)], "run string")), [6]).collect()) == 51


def test_whole_words_with_signs_at_their_ends(spark):
    words, texts = ["wi-fi", "[x]", "^y", "é", "]z", "-a"], ["a wi-fi b", "wi-fix", "[x]", "b[x]c", "^y", "b^y", "é", "éa", "b]z", "]z", "b-a", "-a", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(F.col("t").rlike(rf"\b(?:{'|'.join(map(re.escape, words))})\b"), F.lit(False))
    rows = df.select(text.mentions_any(F.col("t"), words, True).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(r.got for r in rows) > 3
