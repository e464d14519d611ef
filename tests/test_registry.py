"""The registry of a case over documents, runs and versions."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import registry
from spanloom.plans.cases import THEMES

CASES = "case_id long, secret string, theme_id string"
PEOPLE = "case_id long, id string, kind string, name string, surname string, given string, gender string, wife_of string, no long, key string"


def people(spark, *rows):
    """(case, id, surname, given[, kind, gender, wife_of]) in order."""
    full = []
    for n, (case, i, surname, given, *more) in enumerate(rows):
        kind, gender, wife_of = [*more, *("person", "N", "")[len(more) :]]
        person = kind == "person"
        full.append((case, i, kind, "" if person else f"{surname} {given}", surname if person else "", given if person else "", gender, wife_of, n, "extra"))
    return spark.createDataFrame(full, PEOPLE)


def names(rows):
    return {(r.case_id, r.entity_id): r.replacement for r in rows.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return registry.Store(spark, f"file://{tmp_path}/registry")


def test_a_second_run_keeps_every_name(spark, store):
    cases = spark.createDataFrame([(1, "s", "stones"), (2, "t", "stones")], CASES)
    first = people(spark, (1, "a", "Kovács", "János", "person", "M"), (1, "b", "Kovács", "Jánosné", "person", "F", "Kovács János"), (1, "c", "Kalász", "Kft.", "org"), (2, "a", "Nagy", "Anna"))
    assert store.state() is None and store.commit(registry.advance(first, cases, THEMES, 1), 1)
    before = names(store.state())
    more = people(spark, *((1, f"n{i}", f"Új{i}", "Péter") for i in range(25)), (1, "a", "Kovács", "János", "person", "M"), (1, "b", "Kovács", "Jánosné", "person", "F", "Kovács János"), (1, "c", "Kalász", "Kft.", "org"))
    assert store.commit(registry.advance(more, cases.where("case_id = 1"), THEMES, 2, store.state()), 2)
    after = names(store.state())
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 25
    assert len({v for (case, _), v in after.items() if case == 1}) == 28
    # Numbered names stay taken, too, and an older version can still be read.
    assert store.commit(registry.advance(people(spark, *((1, f"m{i}", f"Más{i}", "Éva") for i in range(9))), cases.where("case_id = 1"), THEMES, 3, store.state()), 3)
    last = names(store.state())
    assert {k: last[k] for k in after} == after and len({v for (case, _), v in last.items() if case == 1}) == 37
    assert names(store.state(as_of=1)) == before


def test_a_changed_name_kind_key_or_theme_gets_a_new_name(spark):
    cases = spark.createDataFrame([(1, "s", "stones")], CASES)
    first = registry.advance(people(spark, (1, "a", "Kovács", "János"), (1, "b", "Nagy", "Anna"), (1, "c", "Kis", "Pál")), cases, THEMES, 1)
    state = spark.createDataFrame(first.collect(), first.schema)
    changed = people(spark, (1, "a", "Kovács", "János"), (1, "b", "Nagy", "Éva"), (1, "c", "Kis", "Pál", "org"))
    since = lambda rows: {r.entity_id: r.since for r in rows.collect()}
    assert since(registry.advance(changed, cases, THEMES, 2, state)) == {"a": 1, "b": 2, "c": 2}
    for other in (("s", "trees"), ("other", "stones")):
        new = registry.advance(changed, spark.createDataFrame([(1, *other)], CASES), THEMES, 2, state)
        assert since(new) == {"a": 2, "b": 2, "c": 2} and {r.key for r in new.collect()}.isdisjoint({r.key for r in state.collect()})


def test_the_first_documents_order_heads_the_list(spark):
    hits = spark.createDataFrame(
        [(1, 2, 0, 0, "c", "auto"), (1, 1, 1, 5, "a", "auto"), (1, 1, 0, 9, "b", "review"), (1, 1, 0, 2, "a", "reject"), (2, 2, 0, 0, "a", "auto")],
        "case_id long, document_no int, unit_no int, start int, entity_id string, disposition string",
    )
    documents = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "case_id long, document_no int")
    order = registry.first_document_order(hits, documents)
    assert sorted(map(tuple, order.collect())) == [(1, "a", 2), (1, "b", 1)]
    cases = spark.createDataFrame([(1, "s", "stones")], CASES)
    made = {r.entity_id: (r.surname, r.given) for r in registry.advance(people(spark, (1, "a", "A", "x"), (1, "c", "C", "x"), (1, "b", "B", "x")), cases, THEMES, 1, order=order).collect()}
    assert made["b"] == ("Gránit", "Ottó") and made["a"] == ("Bazalt", "Frida") and len({*made.values()}) == 3
    # Who is not in the first document is drawn by key: alike without the others' order.
    alone = registry.advance(people(spark, (1, "c", "C", "x")), cases, THEMES, 1)
    assert alone.first().replacement == registry.advance(people(spark, (1, "c", "C", "x")), cases, THEMES, 1, order=order).first().replacement


def test_nulls_repeats_and_nothing(spark):
    cases = spark.createDataFrame([(1, "s", "stones"), (2, None, "stones"), (3, "s", "stones")], CASES)
    rows = people(spark, (1, "a", "A", "x"), (1, "a", "A", "x"), (1, None, "B", "x"), (2, "a", "A", "x"), (4, "a", "A", "x"))
    rows = rows.unionByName(rows.limit(1).withColumn("surname", F.lit(None).cast("string")).withColumn("id", F.lit("z")))
    assert {(r.case_id, r.entity_id, r.original) for r in registry.advance(rows, cases, THEMES, 1).collect()} == {(1, "a", "A x"), (1, "z", "x")}
    assert registry.advance(rows.limit(0), cases, THEMES, 1).count() == 0


def test_a_version_is_written_once(spark, store):
    cases = spark.createDataFrame([(1, "s", "stones")], CASES)
    rows = registry.advance(people(spark, (1, "a", "A", "x")), cases, THEMES, 1)
    assert store.commit(rows, 1) and not store.commit(rows.where("false"), 1)
    assert store.versions() == [1] and store.state().count() == 1
    broken = rows.withColumn("since", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit(broken, 2)
    assert store.versions() == [1] and store.state().count() == 1


def test_a_stream_of_entities(spark, store, tmp_path):
    cases = spark.createDataFrame([(1, "s", "stones"), (2, "t", "stones")], CASES)
    for n, rows in enumerate((((1, "a", "A", "x"), (2, "a", "N", "x")), ((1, "b", "B", "x"),), ((1, "a", "A", "x"), (1, "c", "C", "x")))):
        people(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    step = registry.follow(store, cases, THEMES)
    stream = spark.readStream.schema(PEOPLE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert store.versions() == [1, 2, 3]
    got = names(store.state())
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "a")} and len({v for (c, _), v in got.items() if c == 1}) == 3
    step(people(spark, (1, "d", "D", "x")), 1)  # a batch that comes again
    assert names(store.state()) == got
