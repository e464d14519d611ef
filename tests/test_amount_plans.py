from pyspark.sql import functions as F

from spanloom.operators import amounts as A

PLAN = "case string, currency string, value double, new_value double"


def test_warnings_of_each_kind(spark):
    plan = spark.createDataFrame([("x", "HUF", 100.0, 90.0), ("x", "HUF", 101.0, 90.0), ("x", "HUF", 201.0, 181.0), ("x", "HUF", 5.0, 5.0), ("y", "HUF", 5.0, 5.0), ("x", "EUR", 12.0, 10.75)], PLAN)
    relations = spark.createDataFrame([("x", "HUF", 100.0, 101.0, 201.0), ("y", "HUF", 5.0, 7.0, 12.0)], "case string, currency string, a double, b double, c double")
    here = plan.where("case = 'x'")
    spelled = spark.createDataFrame([("x", "EUR", 12.0, "tizenkettő"), ("x", "HUF", 5.0, "öt")], "case string, currency string, value double, words string")
    rows = {(r.case, r.kind): r for r in A.plan_warnings(plan, relations, "case", here, spelled).collect()}
    assert set(rows) == {("x", k) for k in ("broken", "merged", "unchanged", "unspellable")}
    assert "100 + 101 = 201 HUF, a csere után 90 + 90 = 180, de a végösszeg helyén 181 áll" in rows["x", "broken"].message
    assert rows["x", "merged"].message.startswith("Összeolvadt összegek: 100 és 101 egyaránt 90 lett")
    assert "a 5 HUF összeg" in rows["x", "unchanged"].message and "(10.75)" in rows["x", "unspellable"].message
    assert A.plan_warnings(plan.limit(0), relations, "case", here.limit(0), spelled).collect() == []
    assert A.plan_warnings(plan, relations.limit(0), "case").where("kind = 'unchanged'").count() == 2


def test_a_plan_keeps_its_sums_and_says_so(spark):
    texts = spark.createDataFrame([("c", 1, "Tőke 1 250 000 Ft, azaz Egymillió-kétszázötvenezer forint, díj 250 000 Ft, összesen 1 500 000 Ft."), ("c", 2, None)], "case string, id int, text string")
    found = A.scan(texts, ["case", "id"])
    values = A.distinct_values(found, "case")
    plan = A.rescale(values.withColumn("factor", F.lit(0.93)), "case", "factor")
    relations = A.sums(values, "case")
    assert [r.kept for r in A.relation_report(plan, relations, "case").collect()] == [True]
    text, new = texts.first().text, {r.value: r.new_value for r in plan.collect()}
    for r in sorted(A.plan_edits(found, plan, "case").collect(), key=lambda r: -r.edit_start):
        text = text[: r.edit_start] + r.replacement + text[r.edit_end :]
    again = [(a[6], a[2]) for a in A.find_amounts(text)]
    assert [v for v, _ in again] == [new[1250000.0], new[250000.0], new[1500000.0]] and "azaz Egymillió-" in again[0][1]


def test_words_of_a_broken_value_stay(spark):
    found = A.scan(spark.createDataFrame([("c", "12 (tizenkettő) EUR")], "case string, text string"), ["case"])
    plan = spark.createDataFrame([("c", "EUR", 12.0, 10.5)], PLAN)
    assert [(r.edit_start, r.edit_end) for r in A.plan_edits(found, plan, "case").collect()] == [(0, 2)]
