import math
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, connect
from reviewops.functions import lexicon, text
from reviewops.operators import features, forests, metrics, models, sentiment, textstats, topics
from reviewops.plans import catalog, reports
from reviewops.session import kept


def score(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(lexicon.sentiment_score(F.col("t")).alias("s")).first().s


def test_sentiment_signs_and_range(spark):
    assert score(spark, "The hotel was absolutely fantastic and wonderful!") > 0
    assert score(spark, "The room was filthy and the staff were rude and unhelpful.") < 0
    assert score(spark, "The hotel had a reception desk.") == 0.0 and score(spark, "") == 0.0 and score(spark, None) == 0.0
    assert score(spark, "Great hotel") > score(spark, "Average experience") > score(spark, "Terrible service")
    assert -1 <= score(spark, "terrible " * 500) < -0.99


def test_negation_reaches_three_words(spark):
    good = score(spark, "good")
    assert score(spark, "not good") < 0 < good and score(spark, "never a really good") < 0
    assert score(spark, "not in any way good") == good
    v = -0.74 * 1.9
    assert score(spark, "isn't good") == round(v / math.sqrt(v * v + 15), 4)


def test_labels(spark):
    rows = spark.createDataFrame([(0.5,), (0.3,), (0.0,), (-0.3,), (-0.5,)], "s double").select(lexicon.sentiment_label(F.col("s")).alias("l"))
    assert [r.l for r in rows.collect()] == ["positive", "neutral", "neutral", "neutral", "negative"]
    stars = spark.createDataFrame([("1 star",), ("4 stars",), ("?",)], "l string").select(lexicon.star_label_to_score(F.col("l")).alias("s"))
    assert [r.s for r in stars.collect()] == [-1.0, 0.5, 0.0]


def test_opinion_and_sentences(spark):
    df = spark.createDataFrame([(1, "Great room. Terrible noise! Table."), (2, "")], "review_id long, review_text string")
    rows = sentiment.sentence_sentiment(sentiment.with_opinion(df)).orderBy("review_id").collect()
    assert (rows[0].sentence_count, rows[0].positive_sentences, rows[0].negative_sentences, rows[0].neutral_sentences) == (3, 1, 1, 1)
    assert (rows[1].polarity, rows[1].subjectivity, rows[1].sentence_count, rows[1].avg_polarity) == (0.0, 0.0, 0, 0.0)


def test_ensemble(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, -1.0, 0.0)], "sentiment_score double, star_score double, polarity double")
    same, apart = sentiment.with_ensemble(df).collect()
    assert (same.ensemble_score, same.agreement, same.consensus_label) == (1.0, 1.0, "positive")
    assert (apart.ensemble_score, apart.agreement, apart.consensus_label) == (0.0, round(1 - math.sqrt(2 / 3), 4), "neutral")


def test_word_frequency_and_pairs(spark):
    df = spark.createDataFrame([("h", "Clean room, clean bed and the clean bed"), ("h", "bed")], "Hotel_Name string, review_text string")
    assert [(r.word, r.frequency) for r in textstats.word_frequency(df, ["Hotel_Name"], 2).orderBy("rank").collect()] == [("bed", 3), ("clean", 3)]
    assert textstats.collocations(df, n=1).first().pair == "clean bed"
    assert textstats.keywords(df, ["Hotel_Name"]).first().keywords == ["bed", "clean", "room"]


def test_tfidf_by_hand(spark):
    texts = ["red blue", "red red green", "green"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    got = {(r.doc, r.term): r.weight for r in features.tfidf(df, "id", ngrams=1, min_df=1, max_df=1.0).collect()}
    idf = {t: math.log(4 / (1 + d)) + 1 for t, d in {"red": 2, "blue": 1, "green": 2}.items()}
    raw = {(0, "red"): idf["red"], (0, "blue"): idf["blue"], (1, "red"): (1 + math.log(2)) * idf["red"], (1, "green"): idf["green"], (2, "green"): idf["green"]}
    norm = {d: math.sqrt(sum(w * w for (x, _), w in raw.items() if x == d)) for d in range(3)}
    assert got.keys() == raw.keys() and all(math.isclose(got[k], raw[k] / norm[k[0]]) for k in raw)
    assert {r.term for r in features.tfidf(df, "id", ngrams=1, min_df=2, max_df=0.7).collect()} == {"red", "green"}


def test_split_is_exact_stratified_and_stable(spark):
    df = spark.range(0, 5003, numPartitions=5).select(F.col("id").alias("review_id"), (1 + F.col("id") % 3 % 2).cast("double").alias("rating"))
    split = features.split_train_test(df)
    counts = {(r.stratum, r.is_test): r["count"] for r in split.groupBy("stratum", "is_test").count().collect()}
    sizes = {s: sum(n for (t, _), n in counts.items() if t == s) for s, _ in counts}
    assert all(counts[(s, True)] == round(0.2 * n) for s, n in sizes.items()) and sum(sizes.values()) == 5003
    ids = [{r.review_id for r in features.split_train_test(df.repartition(n)).filter("is_test").collect()} for n in (2, 7)]
    assert ids[0] == ids[1]
    train, test = split.filter("not is_test").select("review_id"), split.filter("is_test").select("review_id")
    assert train.intersect(test).count() == 0 and df.select("review_id").exceptAll(train.unionAll(test)).count() == 0


def test_split_falls_back_to_one_stratum(spark):
    rows = [(i, 3.0) for i in range(10)] + [(10, 5.0)]
    df = spark.createDataFrame(rows, "review_id long, rating double")
    assert {r.stratum for r in features.split_train_test(df).collect()} == {0}
    assert features.sample_rows(df, 4).count() == 4


def test_metrics_by_hand(spark):
    pairs = [("positive", "positive")] * 3 + [("positive", "negative")] + [("negative", "negative")] * 2 + [("neutral", "positive")] * 2
    df = spark.createDataFrame(pairs, "y string, p string")
    rows = {r.label: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert (rows["positive"].precision, rows["positive"].recall, rows["positive"].support) == (0.6, 0.75, 4)
    assert (rows["neutral"].precision, rows["neutral"].recall, rows["neutral"].f1) == (0.0, 0.0, 0.0)
    f = {"positive": 2 * 0.6 * 0.75 / 1.35, "negative": 0.8}
    assert rows["Macro Avg"].f1 == round(sum(f.values()) / 3, 4) and rows["Weighted Avg"].f1 == round((f["positive"] * 4 + f["negative"] * 2) / 8, 4)
    assert metrics.accuracy(df, "y", "p").first().accuracy == 0.625
    cells = {(r.actual, r.predicted): (r.n, r.share) for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 9 and cells[("positive", "negative")] == (1, 0.25) and cells[("neutral", "positive")] == (2, 1.0)


def test_union_labels(spark):
    df = spark.createDataFrame([(["wifi"], ["none"]), ([], ["none"]), (["b"], ["a", "b"])], "x array<string>, y array<string>")
    assert [r.u for r in df.select(topics.union_labels(F.col("x"), F.col("y")).alias("u")).collect()] == [["wifi"], ["none"], ["a", "b"]]


def test_model_round_trip(spark, tmp_path):
    texts = ["the wifi was slow", "wifi never worked", "lovely quiet room", "great view and bed"] * 10
    df = topics.add_topics(spark.createDataFrame(list(enumerate(texts)), "review_id long, review_text string"))
    model = models.train_forest(df, trees=5, depth=4, topics=["wifi", "noise"])
    assert set(model.classifiers) == {"wifi"}  # no review is about noise
    model.save(str(tmp_path / "m"))
    again = models.TopicModel.load(spark, str(tmp_path / "m"))
    a, b = (m.with_labels(df).orderBy("review_id").collect() for m in (model, again))
    assert [r.predicted_topics for r in a] == [r.predicted_topics for r in b]
    assert a[0].predicted_topics == ["wifi"] and a[2].predicted_topics == ["none"]
    assert model.feature_importance(spark, "wifi", 3).first().importance > 0


def test_model_store_keeps_the_last_version(spark, tmp_path):
    """A model without any trained topic is stored and loaded too, and a version that was never finished isn't seen."""
    df = topics.add_topics(spark.createDataFrame([(i, t) for i, t in enumerate(["lovely quiet room", "great view and bed"] * 5)], "review_id long, review_text string"))
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        models.TopicModel.load(spark, path)
    none = models.train_forest(df, trees=2, depth=2)
    none.save(path)
    assert models.TopicModel.load(spark, path).classifiers == {}
    assert {tuple(r.predicted_topics) for r in models.TopicModel.load(spark, path).with_labels(df).collect()} == {("none",)}
    more = topics.add_topics(spark.createDataFrame([(i, t) for i, t in enumerate(["the wifi was slow", "great view"] * 5)], "review_id long, review_text string"))
    second = models.train_forest(more, trees=2, depth=2, topics=["wifi"])
    second.save(path)
    again = models.TopicModel.load(spark, path)
    assert set(again.classifiers) == {"wifi"} and again.training == second.training == {"wifi": 1.0}
    (tmp_path / "m" / "unfinished").mkdir()
    assert set(models.TopicModel.load(spark, path).classifiers) == {"wifi"}


def test_rare_topic_among_many_rows(spark):
    """Twenty examples in a hundred thousand rows, a bound of two thousand: all twenty are used, none of the words is lost."""
    n = 100_000
    texts = F.when(F.col("id") % (n // 20) == 7, "the wifi was slow").when(F.col("id") % 2 == 0, "rude staff at the desk").otherwise("lovely view of a harbour")
    df = topics.add_topics(spark.range(n).select(F.col("id").alias("review_id"), texts.alias("review_text")))
    model = models.train_boosted(df, rounds=3, depth=2, max_rows=2000)
    assert set(model.classifiers) == {"wifi", "staff"} and model.training["wifi"] > 0.999
    assert {"wifi", "slow", "harbour"} <= set(model.vocabulary)
    marked = model.with_probabilities(df.select("review_id", "review_text"))
    assert marked.filter("pred_wifi").count() == 20 and marked.filter("pred_staff").count() == df.filter("has_staff").count()
    shares = models.training_shares({"n": n, "wifi": 20, "staff": 50_000, "noise": 0}, ["wifi", "staff", "noise"], 2000)
    assert shares == {"wifi": (1.0, 1000 / (n - 20)), "staff": (0.02, 0.02)}


def test_trees_grow_on_all_rows(spark, monkeypatch):
    """Without a bound that the caller asks for, every row is fitted, and twenty examples in a hundred thousand rows are told by their words."""
    n, seen, fit = 110_000, [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, rows: seen.append(rows.agg(F.count("*"), F.sum("weight")).first()) or fit(self, rows))
    texts = F.when(F.col("id") % (n // 20) == 7, "the wifi was slow").when(F.col("id") % 2 == 0, "rude staff at the desk").otherwise("lovely view of a harbour")
    df = topics.add_topics(spark.range(n).select(F.col("id").alias("review_id"), texts.alias("review_text")))
    model = models.train_forest(df, trees=5, depth=4, topics=["staff"])
    assert seen[0][0] == n and math.isclose(seen[0][1], n)
    model = models.train_forest(df, trees=5, depth=4, topics=["wifi"])
    assert seen[1][0] >= n and math.isclose(seen[1][1], n) and model.training == {"wifi": 1.0}
    assert model.with_probabilities(df.select("review_id", "review_text")).filter("pred_wifi").count() == 20
    assert models._copies(20, n - 20) == (550, 1) and models._copies(n - 20, 20) == (1, 550) and models._copies(20, 5000) == (1, 1)


def test_training_vectors_by_hand(spark):
    """(1 + ln tf) * idf, scaled to length 1, without a row-at-a-time function in the plan."""
    df = spark.createDataFrame([(0, "red red blue"), (1, "red green"), (2, ""), (3, None)], "id int, review_text string")
    words = models.word_pipeline(min_df=1, max_df=0.99).fit(df)
    out = models.weighted(df, words)
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString() and "BatchEvalPython" not in out._jdf.queryExecution().toString()
    got = {r.id: dict(zip((words.stages[4].vocabulary[i] for i in r.features.indices), r.features.values)) for r in out.collect()}
    idf = {t: math.log(5 / (1 + d)) + 1 for t, d in {"red": 2, "blue": 1, "green": 1, "red red": 1, "red blue": 1, "red green": 1}.items()}
    raw = {"red": (1 + math.log(2)) * idf["red"], "blue": idf["blue"], "red red": idf["red red"], "red blue": idf["red blue"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got[2] == got[3] == {} and got[0].keys() == raw.keys() and all(math.isclose(got[0][k], raw[k] / norm) for k in raw)


def test_quality_of_models_on_the_test_part(spark, sf_dir):
    """Labels are keyword rules, so trees must find them again: macro F1 over topics with examples."""
    rows = entry.queries()["forest_report"](spark, sf_dir).collect()
    judged = [r for r in rows if r.trained and r.support]
    assert len(judged) == 8 and sum(r.f1 for r in judged) / len(judged) > 0.8 and min(r.train_accuracy for r in judged) > 0.9
    labels = entry.queries()["model_labels"](spark, sf_dir).collect()
    same = sum(r.predicted_topics == (r.topics or "none") for r in labels)
    assert same / len(labels) > 0.9 and all(0 <= r.confidence <= 1 for r in labels)
    terms = entry.queries()["boosted_feature_importance"](spark, sf_dir).collect()
    first = {r.topic: r for r in terms if r["rank"] == 1}
    assert len(first) == 8 and all(r.importance > 0.05 for r in first.values())
    assert set(first["wifi"].term.split()) <= set("wifi was slow and no internet no response".split())  # the one complaint about it: its words always come together


def test_forests_vote_as_the_library_does(spark, monkeypatch):
    """The same votes to the last bit, of batches cut into blocks too, and no walk of every tree for each row."""
    words = ["wifi", "slow", "staff", "rude", "noise", "loud", "view", "bed", "harbour", "dirty", "caf\u00e9", "Night"]
    rows = [(i, " ".join(words[(i * k * k + k) % 12] for k in range(1, 2 + i % 6))) for i in range(400)]
    df = topics.add_topics(spark.createDataFrame(rows, "review_id long, review_text string"))
    model = models.train_forest(df, trees=9, depth=7, topics=["wifi", "staff", "noise", "cleanliness"])
    more = [(-1, ""), (-2, None), (-3, "nothing known"), (-4, "WIFI wifi wifi slow caf\u00e9")]
    texts = spark.createDataFrame(rows + more, "review_id long, review_text string")
    ready = models.weighted(texts, model.features)
    library = ready
    for t, forest in model.classifiers.items():
        forest.setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_y")
        library = forest.transform(library).withColumn(f"p_{t}", vector_to_array("_p")[1]).withColumn(f"pred_{t}", F.col("_y") > 0).drop("_raw", "_p", "_y")
    names = ["review_id", *[f"{c}_{t}" for t in model.classifiers for c in ("p", "pred")]]
    expected = library.select(names).orderBy("review_id").collect()
    assert len(expected) == 404 and len({r[c] for r in expected for c in names[1::2]}) > 10
    for paths in (forests.BLOCK_PATHS, 9 * 50, 1):  # one block, blocks of fifty rows, blocks of one
        monkeypatch.setattr(forests, "BLOCK_PATHS", paths)
        found = model.with_probabilities(texts)
        assert found.select(names).orderBy("review_id").collect() == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("[vote(") == 1 and "UDF(features" not in plan


def test_words_without_accents_are_not_translated(spark):
    """Texts of ASCII alone pass by the table of accents, and words are the same."""
    rows = [("Wifi slow",), ("Caf\u00e9 \u00dcber \u0130stanbul \u212aelvin",), ("\u00e9",), ("",), (None,)]
    df = spark.createDataFrame(rows, "review_text string")
    plain = models.word_pipeline().getStages()[0].transform(df)
    old = F.translate(F.lower(F.coalesce("review_text", F.lit(""))), text.ACCENTED, text.UNACCENTED)
    assert all(r.a == r.b for r in plain.select(F.col("_plain").alias("a"), old.alias("b")).collect())
    assert "octet_length" in plain._jdf.queryExecution().optimizedPlan().toString()


def test_models_split_what_they_need(spark, sf_dir, monkeypatch):
    """Reviews are cleaned and tagged for one table; the split is made of that, and dates, hotels and addresses aren't stored with it."""
    stored, real = [], catalog.kept
    monkeypatch.setattr(catalog, "kept", lambda df, name: stored.append((name, df)) or real(df, name))
    split = catalog._split_rows(spark, sf_dir)
    needed = {"review_id", "review_text", "rating", *[topics.flag(t) for t in topics.TOPICS]}
    assert [(name, set(df.columns)) for name, df in stored] == [("rated-reviews", needed), ("model-split", needed | {"stratum", "is_test"})]
    whole = features.split_train_test(catalog.tagged(spark, sf_dir).filter("rating IS NOT NULL")).select(split.columns)
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty() and split.count() > 0


def test_checkpoint_goes_to_a_folder(spark):
    assert kept(spark.range(5), "test").count() == 5


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["Hotel_Name", "topic"] and df.count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 90


CORE = ["clean_reviews", "topic_stats", "impact_table", "trends", "ranked_issues", "root_causes", "root_cause_evidence", "roi", "sentiment_score",
        "ensemble_score", "text_analysis", "tfidf_top_terms", "train_test_split", "evaluation_report", "hotel_report"]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) == ""


def test_report_sections(spark, sf_dir):
    sections = reports.report_tables(catalog.tagged(spark, sf_dir), top=2)
    assert set(sections) == {"summary", "topic_stats", "impact_table", "action_plan", "roi"}
    assert sections["summary"].count() == 2 and sections["topic_stats"].count() == 16


def _brute_counts(rows):
    found = {}
    for key, text in rows:
        found.setdefault(key, Counter()).update(w for w in re.findall(r"[a-z]+", (text or "").lower()) if w not in textstats.STOP_WORDS)
    return found


#: Repeated keys, repeated rows, a null key, null and empty texts.
_REPEATS = [(1, "bed bed pool"), (1, "pool pool bar"), (2, "pool"), (2, "pool"), (None, "bar bed"), (None, "bar"), (3, None), (4, ""), (5, "zeta alpha alpha")]


def test_words_are_counted_in_their_row_and_texts_of_a_key_together(spark):
    df = spark.createDataFrame(_REPEATS, "review_id long, review_text string")
    got = textstats.review_word_frequency(df, n=2)
    expected = {(k, w, n, i + 1) for k, c in _brute_counts(_REPEATS).items() for i, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:2])}
    assert {(r.review_id, r.word, r.frequency, r["rank"]) for r in got.collect()} == expected and got.count() == len(expected)
    counts = features.term_counts(df, "review_id", "review_text", ngrams=1)
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(((k, w, n) for k, c in _brute_counts(_REPEATS).items() for w, n in c.items()), key=repr)
    words = sorted((r.review_id or 0, r.keywords) for r in textstats.text_analysis(df).collect())
    assert words == [(0, []), (0, []), (1, ["pool", "bed", "bar"]), (1, ["pool", "bed", "bar"]), (2, ["pool"]), (2, ["pool"]), (3, []), (4, []), (5, ["alpha", "zeta"])]


def test_words_of_a_text_are_not_grouped_as_rows(spark):
    """Of texts that don't share a key no row of a word goes through an aggregate or a sort, which held all words of a task."""
    df = spark.range(20_000).selectExpr("id AS review_id", "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', chr(97 + i % 26), chr(97 + id % 26)))) AS review_text")
    for found in (textstats.review_word_frequency(df), features.term_counts(df, "review_id", "review_text")):
        assert found.count() > 0
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        aggregates = re.findall(r"Aggregate \[.*", plan)
        assert len(aggregates) == 1  # of keys that texts share
        assert plan.index("_rows", plan.index("Aggregate [")) and "> 1" in plan


def test_training_does_not_store_the_words_of_all_texts(spark, monkeypatch):
    """A share as ``maxDF`` makes the library persist all words to count the texts; a number doesn't, and gives the same words."""
    given, real = [], models.word_pipeline
    monkeypatch.setattr(models, "word_pipeline", lambda **options: given.append(options["max_df"]) or real(**options))
    rows = [(i, "wifi slow " + ("room" if i % 20 else "lobby"), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "review_id long, review_text string, has_wifi boolean")
    model = models.train_forest(df, trees=1, depth=1, topics=["wifi"])
    assert given == [0.95 * 40]
    assert sorted(model.vocabulary) == sorted(real(max_df=0.95).fit(df).stages[4].vocabulary) == ["lobby", "room", "slow lobby", "slow room"]


def test_tokens_are_made_once(spark, sf_dir):
    plan = entry.queries()["document_tokens"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9']+") == 1
    rows = spark.createDataFrame([("a  b c ",), (" ",), (None,), ("",)], "t string").select(text.split_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["a", "b", "c"], [], [], []]
