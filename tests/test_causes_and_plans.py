import pytest
from pyspark.sql import functions as F

from reviewops.fixed_values import ACTION_TEMPLATES
from reviewops.operators import causes, planning, topics
from reviewops.sources import report, templates


def reviews_of(spark, texts, topic="cleanliness"):
    rows = [(i, "h", t, [topic]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "review_id long, Hotel_Name string, review_text string, topics array<string>")


def found(spark, texts, topic="cleanliness"):
    return [(r.cause, r.confidence, r.fallback) for r in causes.root_causes(reviews_of(spark, texts, topic)).orderBy("rank").collect()]


def test_causes_ordered_with_threshold_of_ten_percent(spark):
    texts = ["they were Understaffed and rushed"] + ["the item was broken"] * 2 + ["fine"] * 7
    assert found(spark, texts) == [("EQUIPMENT_ISSUES", 20.0, False), ("UNDERSTAFFING", 10.0, False), ("TIME_PRESSURE", 10.0, False)]
    assert found(spark, texts + ["fine"]) == [("EQUIPMENT_ISSUES", 18.2, False)]


@pytest.mark.parametrize("n, confidences", [(1, [35.0, 30.0, 25.0]), (3, [30.0, 25.0, 20.0]), (6, [25.0, 20.0, 15.0])])
def test_sparse_topics_use_priors(spark, n, confidences):
    got = found(spark, ["meh"] * n, "wifi")
    assert [c for c, _, _ in got] == ["EQUIPMENT_ISSUES", "SUPPLY_CHAIN_ISSUES", "PROCESS_INEFFICIENCY"]
    assert [c for _, c, _ in got] == confidences and all(f for _, _, f in got)
    assert found(spark, ["meh"], "parking")[0][0] == "PROCESS_INEFFICIENCY" and len(found(spark, ["meh"], "parking")) == 2


def test_no_topic_reviews_no_causes(spark):
    df = reviews_of(spark, ["broken"]).withColumn("topics", F.array().cast("array<string>"))
    assert causes.root_causes(df).count() == 0


def test_evidence(spark):
    long = "x" * 60 + " room was broken and then " + "y" * 80
    df = reviews_of(spark, ["Broken lamp", long, "not working", "broken tv"])
    row = causes.with_evidence(causes.root_causes(df), df).filter("cause = 'EQUIPMENT_ISSUES'").first()
    assert row.evidence[0] == "4 of 4 reviews (100.0%) contain 'equipment issues' indicators."
    assert row.evidence[1] == 'Guest wrote: "…broken lamp…"' and row.evidence[3] == 'Guest wrote: "…not working…"' and len(row.evidence) == 4
    i = long.index("broken")
    assert row.evidence[2] == f'Guest wrote: "…{long[max(0, i - 40):i + 6 + 60].strip()}…"'


def test_fallback_evidence_and_strongest(spark):
    df = reviews_of(spark, ["meh", "meh"], "value")
    rows = causes.with_evidence(causes.root_causes(df), df)
    assert rows.first().evidence[0] == "Sparse evidence mode: only 2 complaint review(s) available for this topic."
    assert [r.cause for r in causes.strongest_fallback(rows).collect()] == ["PROCESS_INEFFICIENCY"]
    shown = causes.display_causes(causes.strongest_fallback(rows)).first()
    assert (shown.root_cause, shown.confidence) == ("Process Inefficiency", "35%")


def test_evidence_agrees_with_brute_force_on_a_hot_hotel(spark):
    df = reviews_of(spark, [("broken " if i % 2 else "no towels ") + str(i) for i in range(2000)]).repartition(9)
    rows = causes.evidence_snippets(df).filter("cause = 'EQUIPMENT_ISSUES'").orderBy("rn").collect()
    assert [r.snippet for r in rows] == ["broken 1", "broken 3", "broken 5"]


@pytest.mark.parametrize("formula, rooms, cost", [
    ("rooms * 30", 50, 1500.0), ("TRAINING_COST_BASE * 2", 100, 2400.0), ("EQUIPMENT_COST_PER_ROOM * rooms", 10, 1000.0),
    ("TRAINING_COST_BASE + STAFF_COST_PER_ROOM * rooms", 100, 4200.0), ("1200", 50, 1200.0), ("", 10, 0.0), (None, 10, 0.0),
    ("500 + (rooms * 0.5)", 7, 503.5), ("rooms / 0", 7, 0.0), ("rooms / 4", 10, 2.5), ("3 +", 7, 0.0)])
def test_cost_formula(spark, formula, rooms, cost):
    assert spark.createDataFrame([(rooms,)], "rooms int").select(templates.cost_formula(formula).alias("c")).first().c == cost


@pytest.mark.parametrize("formula", ["__import__('os')", "rooms; drop", "rooms + beds", "uuid()"])
def test_cost_formula_rejects_anything_else(spark, formula):
    with pytest.raises(ValueError):
        templates.cost_formula(formula)


def cause_rows(spark, *rows):
    return spark.createDataFrame([("h", "staff", c, conf, i + 1) for i, (c, conf) in enumerate(rows)],
                                 "Hotel_Name string, topic string, cause string, confidence double, rank int")


def test_plan_of_confident_causes_only(spark):
    plan = planning.action_plans(cause_rows(spark, ("UNDERSTAFFING", 75.0), ("TRAINING_ISSUES", 55.0)))
    assert {r.root_cause for r in plan.collect()} == {"UNDERSTAFFING"} and plan.count() == 6
    cost = planning.plan_costs(plan).first()
    assert (cost.one_time, cost.monthly, cost.three_month_total) == (5650.0, 2200.0, 12250.0)
    assert [r.timeframe for r in plan.orderBy("step").collect()] == ["immediate"] * 2 + ["short_term"] * 2 + ["long_term"] * 2


def test_plan_edges(spark):
    assert {r.root_cause for r in planning.action_plans(cause_rows(spark, ("UNDERSTAFFING", 60.0), ("TRAINING_ISSUES", 59.9))).collect()} == {"UNDERSTAFFING"}
    weak = cause_rows(spark, ("UNDERSTAFFING", 40.0), ("TRAINING_ISSUES", 30.0), ("TIME_PRESSURE", 20.0), ("EQUIPMENT_ISSUES", 15.0))
    assert len({r.root_cause for r in planning.action_plans(weak).collect()}) == 3
    assert planning.action_plans(cause_rows(spark, ("UNKNOWN", 90.0))).count() == 0
    assert planning.action_plans(weak.limit(0)).count() == 0


def test_cost_grows_with_rooms(spark):
    rows = cause_rows(spark, ("UNDERSTAFFING", 75.0))
    totals = [planning.plan_costs(planning.action_plans(rows, default_rooms=n)).first().three_month_total for n in (50, 100, 200)]
    assert totals == sorted(totals) and totals[0] < totals[2]
    rooms = spark.createDataFrame([("h", 200)], "Hotel_Name string, rooms int")
    assert planning.plan_costs(planning.action_plans(rows, rooms)).first().three_month_total == totals[2]


def test_templates_from_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"X": {"immediate": [{"action": "a", "cost_formula": "rooms * 2", "timeline": "now", "impact": "big"}]}}')
    plan = planning.action_plans(cause_rows(spark, ("X", 90.0)), templates=templates.template_rows(str(tmp_path / "t.json"))).first()
    assert (plan.action, plan.cost, plan.cost_text) == ("a", 200.0, "£200") and len(ACTION_TEMPLATES) == 42


def test_roi_limits(spark):
    rows = spark.createDataFrame([(4.9, 1.0, 4.0, 100, 1000.0), (3.0, 0.5, 0.0, 100, 0.0)],
                                 "rating double, complaint_rate double, impact double, rooms int, three_month_total double")
    capped, idle = planning.with_roi(rows).collect()
    assert capped.expected_rating == 5.0 and capped.expected_occupancy == 0.95 and capped.pays_back
    assert idle.monthly_increase == 0 and idle.roi_percentage == 0.0 and idle.payback_months is None and not idle.pays_back


def test_report_is_written_per_hotel(spark, tmp_path):
    table = spark.createDataFrame([("A/B", 1), ("C", 2)], "Hotel_Name string, n int")
    folder, = report.write_report({"summary": table}, str(tmp_path))
    report.write_report({"summary": table.filter("n = 2").withColumn("n", F.lit(3))}, str(tmp_path))
    report.write_report({"summary": spark.createDataFrame([("A_B", 9)], table.schema)}, str(tmp_path))
    assert {tuple(r) for r in report.read_report(spark, folder).collect()} == {("A/B", 1), ("A_B", 9), ("C", 3)}
    assert [tuple(r) for r in report.read_report(spark, folder, "A/B").collect()] == [("A/B", 1)]
    report.write_metrics(table, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_report_update_leaves_other_buckets_alone(spark, tmp_path):
    """Files of other hotels stay, an unfinished version isn't seen, and old versions can be cleared."""
    table = spark.createDataFrame([(f"hotel {i}", i) for i in range(60)] + [(None, -1)], "Hotel_Name string, n int")
    folder, = report.write_report({"summary": table}, str(tmp_path))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    report.write_report({"summary": table.filter("n = 5").withColumn("n", F.lit(500))}, str(tmp_path))
    report.write_report({"summary": table.filter("n = -1").withColumn("n", F.lit(-2))}, str(tmp_path))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 2
    want = {(f"hotel {i}", 500 if i == 5 else i) for i in range(60)} | {(None, -2)}
    assert {tuple(r) for r in report.read_report(spark, folder).collect()} == want
    unfinished = tmp_path / "summary" / "version=x" / f"bucket={'h00'}"
    unfinished.mkdir(parents=True)
    assert report.clear_report(spark, folder) == 3
    assert {tuple(r) for r in report.read_report(spark, folder).collect()} == want
    assert not list(p for p in tmp_path.rglob("version=x/bucket=*"))
    empty, = report.write_report({"none": table.limit(0)}, str(tmp_path), fmt="csv")
    assert report.read_report(spark, empty, fmt="csv").columns == ["Hotel_Name", "n"] and report.read_report(spark, empty, fmt="csv").count() == 0
    with pytest.raises(FileNotFoundError):
        report.read_report(spark, str(tmp_path / "nowhere"))


def test_quotes_are_searched_for_told_causes_only(spark):
    rows = [(1, "h", "The shower was broken, understaffed and dirty", ["room"]), (2, "h", "lovely", ["room"]), (3, "h", "not enough staff", ["staff"]),
            (4, "h", "broken", []), (5, "h", None, ["staff"])]
    df = spark.createDataFrame(rows, "review_id long, Hotel_Name string, review_text string, topics array<string>")
    told = causes.add_causes(df)
    plain = sorted(map(tuple, causes.evidence_snippets(df).collect()))
    assert sorted(map(tuple, causes.evidence_snippets(told).select(*causes.evidence_snippets(df).columns).collect())) == plain and plain
    nothing = df.withColumn("causes", F.array().cast("array<string>"))
    assert causes.evidence_snippets(nothing).count() == 0
