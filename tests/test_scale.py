"""What keeps work in many tasks and batches few."""

import pyarrow as pa

from spanloom.functions import batches
from spanloom.operators import amounts, names, parties, registry, spans, verify
from spanloom.plans import carrier, catalog
from spanloom.plans.cases import THEMES
from spanloom.sources import pdf

DATA = "/root/testdata/sf0.1"


def test_rows_of_many_files_share_batches():
    made = list(batches.batched(((str(i), i) for i in range(12_000)), ["a", "b"], [pa.string(), pa.int32()]))
    assert [b.num_rows for b in made] == [5_000, 5_000, 2_000]
    assert [r for r in batches.each(made)][11_999] == ("11999", 11_999)
    # Large values end a batch early; no rows make no batch.
    assert [b.num_rows for b in batches.batched([(b"x" * 3_000_000,)] * 3, ["a"], [pa.binary()])] == [2, 1]
    assert list(batches.batched([], ["a"], [pa.string()])) == []


def test_a_small_file_is_read_by_many_tasks(spark):
    assert carrier.people(spark, DATA).rdd.getNumPartitions() == 6
    assert carrier.claims(spark, DATA).rdd.getNumPartitions() == 8
    spread = carrier.spread(spark.range(100), "id", 30)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 100


def test_a_text_costs_no_constant_forms(monkeypatch):
    made = []
    monkeypatch.setattr(verify, "paradigm", lambda w, f=verify.paradigm: made.append(w) or f(w))
    verify.verify("Egy Bazalt.", [])
    made.clear()
    assert verify.verify("A Bazalt és a Bíróságnak januárban Ft.", [])["residual"] == [("Bazalt", "", 2)] and made == []


def test_words_are_found_as_by_trying_all():
    words, after = ["a", "ab", "abc", "abcd ef", "abd", "bc"], names._AFTER
    sought = names.Words(words)
    for text in ("abcd ef", "abcd eg ab", "abc", "ab", "a", "x abd.", "bc", ""):
        for at in range(len(text) + 1):
            fits = [w for w in words if text.startswith(w, at) and not after.match(text, at + len(w))]
            assert sought.longest(text, at, after) == max(fits, key=len, default=None)


def test_equal_entities_share_a_matcher():
    built = []
    first, again = names.Entity("p", "person", surname="Kiss", given="Anna"), names.Entity("p", "person", surname="Kiss", given="Anna")
    make = lambda cast: built.append(cast) or names.Matcher([names.Entity(**dict(zip(names.ENTITY_COLUMNS, e, strict=True))) for e in cast])
    held = names.Held(make)
    cast = lambda e: (tuple(getattr(e, c) for c in names.ENTITY_COLUMNS),)
    assert held[cast(first)] is held[cast(again)] and len(built) == 1


def test_faults_of_packages_pass_nothing_through_the_driver(spark):
    plan = catalog.QUERIES["package_faults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") >= 5 and "Broadcast" not in plan


def test_a_case_of_many_units_is_matched_in_many_tasks(spark):
    units = spark.range(400).selectExpr("CAST(id % 1 AS INT) AS case_id", "id", "'Kiss Anna ' || id AS text")
    persons = spark.createDataFrame([(0, "p", "person", "Kiss", "Anna")], "case_id int, id string, kind string, surname string, given string")
    found = names.match(units, persons, "case_id", ["id"]).selectExpr("id", "spark_partition_id() AS task").collect()
    assert sorted(r["id"] for r in found) == list(range(400)) and len({r["task"] for r in found}) > 1


def test_names_that_recur_are_unfolded_and_bent_once(monkeypatch):
    made = []
    monkeypatch.setattr(names, "forms", lambda *a, f=names.forms: made.append(a) or f(*a))
    monkeypatch.setattr(parties, "paradigm", lambda n, f=parties.paradigm: made.append(n) or f(n))
    for i in "ab":
        matcher = names.Matcher([names.Entity(i, "person", surname="Recze", given="Ibolya")])
        assert [h["entity_id"] for h in matcher.find("Recze Ibolyának")] == [i]
        assert parties.merge_inflected(["Recze Tihamér", "Recze Tihamérnak"]) == {"Recze Tihamér": "Recze Tihamér", "Recze Tihamérnak": "Recze Tihamér"}
    assert len(made) == 2


def test_grouped_steps_take_a_batch_of_groups(spark):
    values = spark.range(50).selectExpr("id AS c", "'Ft' AS currency", "100.0D AS value", "10.0D AS step", "2.0D AS factor")
    lines = spark.range(50).selectExpr("id AS k", "0 AS no", "1.0D AS x", "2.0D AS y", "3.0D AS width", "4.0D AS size", "'s' AS stream")
    for df in (amounts.rescale(values, "c", "factor"), pdf.paragraphs(lines, ["k"]), parties.detect(lines.selectExpr("k", "'Felperes: Kiss Anna' AS text"), "k")[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "FlatMapGroupsInPandas" not in plan
    assert {tuple(r) for r in amounts.rescale(values, "c", "factor").collect()} == {(i, "Ft", 100.0, 200.0) for i in range(50)}


def test_cases_of_a_registry_share_batches_and_are_named_in_many_tasks(spark):
    cases = spark.range(40).selectExpr("id AS case_id", "'s' AS secret", "'stones' AS theme_id")
    persons = spark.range(40).selectExpr("id AS case_id", "'p' AS id", "'person' AS kind", "'Kiss' AS surname", "'Anna' AS given", "1 AS no")
    made = registry.advance(persons, cases, THEMES, 1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    found = made.selectExpr("case_id", "replacement", "spark_partition_id() AS task").collect()
    assert sorted(r["case_id"] for r in found) == list(range(40)) and len({r["task"] for r in found}) == 4


def test_an_edit_meets_its_documents_spans_as_one_row(spark):
    edits = spark.createDataFrame([("d", 5, 7), ("d", 0, 30), ("d", None, 7), ("e", 1, 2), (None, 1, 2)], "doc string, start int, end int")
    held = spark.createDataFrame([("d", 4, 9, 3), ("d", 2, 9, 2), ("d", 2, 9, 1), ("d", 2, 6, 0), ("d", 6, 8, 4), (None, 0, 9, 5)], "doc string, start int, end int, span_id int")
    made = spans.first_container(edits, held, ["doc"])
    assert sorted(map(tuple, made.collect()), key=str) == sorted([("d", 5, 7, 1), ("d", 0, 30, None), ("d", None, 7, None), ("e", 1, 2, None), (None, 1, 2, None)], key=str)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") and "Aggregate" not in plan[: plan.index("Join")]
    assert catalog.span_rows(spark, DATA).rdd.getNumPartitions() == 3


def test_packages_are_rewritten_once_for_all_their_readers(spark):
    plan = catalog.QUERIES["package_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
