"""Gated export: all or nothing, names that step aside, certificates."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.sources import export, keyfile

DOCS = "case_id long, document_no long, path string, format string, pages int, chars int, mode string, keep_key boolean, model string, warnings array<string>, content string, leaks array<string>, residual_total long, checked_chars long"
HITS = "case_id long, document_no long, entity_id string, kind string, unit_no int, start int, surface string, replacement string, reason string, context string, common_word boolean, disposition string, decision string, by_program boolean"
PARTIES = "case_id long, id string, kind string, identifier_kind string, skipped boolean"


def made():
    return F.expr("TIMESTAMP '2026-01-02 03:04:05'")


def ledger(spark, docs, hits=(), parties=()):
    rows = spark.createDataFrame([(c, n, path, "txt", 1, 9, "theme", True, "m", [], "text", leaks, 0, 9) for c, n, path, leaks in docs], DOCS)
    reports = rows.select("case_id", "document_no", "leaks", "residual_total", "checked_chars").where("size(leaks) > 0 OR document_no > 1")
    return export.ledger(rows.drop("leaks", "residual_total", "checked_chars"), spark.createDataFrame([*hits], HITS), spark.createDataFrame([*parties], PARTIES), reports)


@pytest.fixture
def mapping(spark):
    return spark.createDataFrame([(1, "a", "Kovács János", "Gránit Ottó"), (2, "b", "Nagy Anna", "Kavics Frida")], "case_id long, entity_id string, original string, replacement string")


def test_leaks_are_held_back_and_the_rest_goes(spark, tmp_path, mapping):
    store = export.Exports(spark, f"file://{tmp_path}/out")
    docs = ledger(spark, [(1, 1, "/x/a.txt", []), (1, 2, "/x/b.txt", ["Kovács"]), (2, 1, "/x/c.txt", ["Nagy"])])
    assert store.export(docs, 1, made(), mapping, "egy jó jelszó")
    assert [(r.case_id, r.file_name) for r in store.read("documents").collect()] == [(1, "a-alnevesitett.txt")]
    assert {(r.case_id, r.source, tuple(r.leaks)) for r in store.read("held_back").collect()} == {(1, "b.txt", ("Kovács",)), (2, "c.txt", ("Nagy",))}
    # A case none of whose documents went has no key; certificates name nobody.
    assert [tuple(r) for r in keyfile.unseal(store.read("keys"), "egy jó jelszó").collect()] == [("a", "Kovács János", "Gránit Ottó")]
    (text,) = [r.content for r in store.read("certificates").collect()]
    assert text.startswith(export.HEADER) and "Kovács" not in text and text.endswith("Készült: 2026-01-02 03:04:05")
    assert not store.export(docs, 1, made(), mapping, "egy jó jelszó")


@pytest.mark.parametrize("fault", ["passphrase", "content"])
def test_nothing_appears_if_anything_fails(spark, tmp_path, mapping, fault):
    store = export.Exports(spark, f"file://{tmp_path}/out")
    docs = ledger(spark, [(1, 1, "/x/a.txt", [])])
    if fault == "content":
        docs = docs.withColumn("warnings", F.array(F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost|characters"):
        store.export(docs, 1, made(), mapping, "rövid" if fault == "passphrase" else "egy jó jelszó")
    assert store.read("documents") is None and store.latest() is None
    assert not (tmp_path / "out").exists() or [p.name for p in (tmp_path / "out").iterdir()] == []


def test_certificates_step_aside(spark):
    rows = spark.createDataFrame([(1, 1, "a-x.txt", "a.txt"), (1, 2, "a-x.pdf", "a.pdf"), (1, 3, "a-x.docx", "a.docx"), (1, 4, "b-x.txt", "b.txt"), (2, 5, "a-x.txt", "a.txt"), (2, 6, "noext", None)], "case_id long, document_no long, file_name string, source_name string")
    there = spark.createDataFrame([(1, "a-x-jegyzokonyv.txt", "a.pdf"), (1, "a-x-jegyzokonyv-3.txt", None), (1, "a-x-jegyzokonyv-2.pdf", None), (1, "b-x-jegyzokonyv.txt", "b.txt"), (2, "other.txt", None)], "case_id long, file_name string, source string")
    got = {r.document_no: r.certificate_name for r in export.certificate_names(rows, there).collect()}
    assert got == {1: "a-x-jegyzokonyv-2.txt", 2: "a-x-jegyzokonyv.txt", 3: "a-x-jegyzokonyv-4.txt", 4: "b-x-jegyzokonyv.txt", 5: "a-x-jegyzokonyv.txt", 6: "noext-jegyzokonyv.txt"}
    assert export.certificate_names(rows.limit(0)).count() == 0
    many = spark.createDataFrame([(1, f"s-jegyzokonyv{'' if n == 1 else f'-{n}'}.txt", "x") for n in range(1, 1000)], "case_id long, file_name string, source string")
    with pytest.raises(Exception, match="no free name"):
        export.certificate_names(spark.createDataFrame([(1, 1, "s.txt", "s.txt")], "case_id long, document_no long, file_name string, source_name string"), many).collect()


def test_a_later_run_replaces_its_own_files(spark, tmp_path):
    store = export.Exports(spark, f"file://{tmp_path}/out")
    assert store.export(ledger(spark, [(1, 1, "/x/a.txt", []), (1, 2, "/x/b.txt", [])]), 1, made())
    again = ledger(spark, [(1, 1, "/y/a.txt", []), (1, 2, "/y/a.pdf", [])]).withColumn("content", F.lit("new"))
    assert store.export(again, 2, made())
    assert {(r.file_name, r.content, r.run) for r in store.latest().collect()} == {("a-alnevesitett.txt", "new", 2), ("a-alnevesitett.pdf", "new", 2), ("b-alnevesitett.txt", "text", 1)}
    assert {(r.file_name, r.source) for r in store.latest("certificates").collect()} == {("a-alnevesitett-jegyzokonyv.txt", "a.txt"), ("a-alnevesitett-jegyzokonyv-2.txt", "a.pdf"), ("b-alnevesitett-jegyzokonyv.txt", "b.txt")}


def test_the_ledger_counts_decisions(spark):
    hit = lambda n, entity, kind, disposition, decision, program, start=0: (1, n, entity, kind, 0, start, "f", None, None, None, None, disposition, decision, program)
    hits = [hit(1, "p", "person", "auto", None, False), hit(1, "p", "person", "review", "accept", True, 9), hit(1, "p", "person", "review", "accept", True, 3), hit(1, "i", "identifier", "reject", "skip", True), hit(1, "q", "person", "review", None, False), hit(1, "#", "date", "auto", None, False)]
    parties = [(1, "p", "person", None, None), (1, "q", "person", None, False), (1, "i", "identifier", "taj", False), (1, "o", "org", None, True)]
    rows = {r.document_no: r for r in ledger(spark, [(1, 1, "/x/a.txt", []), (1, 2, "/x/b.txt", [])], hits, parties).collect()}
    one, two = rows[1], rows[2]
    assert (one.replaced, one.pending, one.kept_by_program, [a.start for a in one.automatic]) == (4, 1, 1, [3, 9])
    assert one.lines == [f"{'személy':34} 2 fél, 3 előfordulás", f"{'azonosító — TAJ-szám':34} 1 fél, 0 előfordulás", f"{'dátum':34} 1 előfordulás eltolva"]
    assert (two.replaced, two.pending, two.automatic) == (0, 0, None) and two.lines == [f"{'azonosító — TAJ-szám':34} 1 fél, 0 előfordulás", f"{'személy':34} 2 fél, 0 előfordulás"]


def test_a_ledger_is_worked_out_once_and_not_left_behind(spark, tmp_path, mapping):
    seen = spark.sparkContext.accumulator(0)
    leaks = F.udf(lambda path: seen.add(1) or [], "array<string>")
    docs = ledger(spark, [(1, 1, "/x/a.txt", []), (1, 2, "/x/b.txt", [])]).withColumn("leaks", leaks("path"))
    store = export.Exports(spark, f"file://{tmp_path}/out")
    assert store.export(docs, 1, made(), mapping, "egy jó jelszó") and store.read("documents").count() == 2
    assert seen.value == 2
    place = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not list(Path("/" + place.lstrip("/")).glob("**/ledger-*"))
