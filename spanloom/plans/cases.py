"""Queries over whole cases: several documents, several runs; each case's content follows from its customers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import decisions, registry, verify
from spanloom.plans.carrier import GIVEN, people, people_sql
from spanloom.sources import export, keyfile
from spanloom.sources.staged import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Customers of a case.
SIZE = 20
STONES = {
    "surnames": [{"form": f} for f in ("Gránit", "Bazalt", "Kavics", "Márvány", "Opál", "Jáspis", "Kvarc", "Agát", "Topáz", "Berill")],
    "given_names": [{"form": f, "gender": g} for f, g in (("Ottó", "M"), ("Frida", "F"), ("Alfréd", "M"), ("Zita", "F"), ("Edvin", "M"), ("Lenke", "F"))],
}
TREES = {
    "surnames": [{"form": f} for f in ("Tölgy", "Bükk", "Nyír", "Juhar", "Kőris", "Hárs", "Fűz", "Éger")],
    "given_names": [{"form": f, "gender": g} for f, g in (("Vilmos", "M"), ("Dóra", "F"), ("Kelemen", "M"), ("Panna", "F"))],
}
THEMES = {"stones": STONES, "trees": TREES}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, id, k, kind, surname, given, gender, no, female): one person for each customer."""
    rows = people(spark, sf_dir)
    female = (F.col("k") * 7 % len(GIVEN) % 2).cast("int")
    gender = F.when(female == 1, "F").otherwise("M")
    return rows.select(F.floor(F.col("k") / SIZE).cast("long").alias("case_id"), F.col("k").cast("string").alias("id"), "k", F.lit("person").alias("kind"), "surname", "given", gender.alias("gender"), F.col("k").alias("no"), female.alias("female"))


def hits(persons: DataFrame) -> DataFrame:
    """Two documents a case, each naming everybody: the second one in another order, and before anybody a name that was rejected."""
    start = {1: F.col("k") * 7 % SIZE * 100, 2: F.col("k") * 11 % SIZE * 100}
    seen = [persons.select("case_id", F.lit(n).alias("document_no"), F.lit(0).alias("unit_no"), at.alias("start"), F.col("id").alias("entity_id"), F.lit("auto").alias("disposition")) for n, at in start.items()]
    refused = persons.where("k % 4 = 1").select("case_id", F.lit(1).alias("document_no"), F.lit(0).alias("unit_no"), F.lit(-1).cast("long").alias("start"), F.col("id").alias("entity_id"), F.lit("reject").alias("disposition"))
    return seen[0].unionByName(seen[1]).unionByName(refused)


def runs(spark: SparkSession, sf_dir: str) -> registry.Store:
    """Two runs over every case: two thirds of its persons, then all; every fifth case changes its theme in between, every seventh
    has no second run."""
    persons = written(cast(spark, sf_dir), "persons")
    cases = persons.select("case_id").distinct().withColumns({"secret": F.concat(F.lit("per-"), F.col("case_id")), "theme_id": F.lit("stones")})
    store = registry.Store(spark, shared_folder(spark, "registry"))
    early = persons.where("k % 3 <> 0")
    seen = hits(persons)
    documents = seen.select("case_id", "document_no").distinct()
    order = registry.first_document_order(seen, documents)
    store.commit(registry.advance(early, cases, THEMES, 1, order=order), 1)
    again = cases.where("case_id % 7 <> 3").withColumn("theme_id", F.when(F.col("case_id") % 5 == 0, "trees").otherwise("stones"))
    store.commit(registry.advance(persons, again, THEMES, 2, store.state(), order), 2)
    return store


def _name_sql(pool: list[str], n: str) -> str:
    """The n-th free name (from 1) of a pool that numbers its first one when it is used up."""
    return f"CASE WHEN {n} <= {len(pool)} THEN list_extract({pool!r}, CAST({n} AS INT)) ELSE '{pool[0]} ' || CAST({n} - {len(pool) - 1} AS VARCHAR) END"


def _person_sql(theme: dict) -> str:
    given = {g: [x["form"] for x in theme["given_names"] if x["gender"] == g] for g in "MF"}
    return f"({_name_sql([s['form'] for s in theme['surnames']], 'n')}) || ' ' || CASE WHEN female = 1 THEN {_name_sql(given['F'], 'g')} ELSE {_name_sql(given['M'], 'g')} END"


#: A person's place among a case's names, and among those of its gender: first run, then those that came with the second.
REGISTRY_SQL = f"""{people_sql()},
persons AS (SELECT k // {SIZE} AS case_id, k, surname || ' ' || given AS original, k * 7 % {len(GIVEN)} % 2 AS female, k % 3 = 0 AS late, k * 7 % {SIZE} * 1000000000 + k AS spot FROM people),
waves AS (SELECT *, case_id % 7 <> 3 AND case_id % 5 = 0 AS anew, CASE WHEN case_id % 7 <> 3 AND (case_id % 5 = 0 OR late) THEN 2 ELSE 1 END AS since FROM persons WHERE case_id % 7 <> 3 OR NOT late),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY since, spot) AS n, row_number() OVER (PARTITION BY case_id, female ORDER BY since, spot) AS g FROM waves),
registry AS (SELECT case_id, CAST(k AS VARCHAR) AS entity_id, original, CASE WHEN anew THEN {_person_sql(TREES)} ELSE {_person_sql(STONES)} END AS replacement, CAST(since AS BIGINT) AS since FROM placed)"""


@query(f"WITH {REGISTRY_SQL} SELECT * FROM registry")
def case_registry(spark, sf_dir):
    return runs(spark, sf_dir).state().select("case_id", "entity_id", "original", "replacement", "since")


@query(f"WITH {REGISTRY_SQL}, a AS (SELECT case_id, max(since) AS latest, CAST(count(*) AS BIGINT) AS names, CAST(count(*) FILTER (WHERE since = 2) AS BIGINT) AS given_in_second, CAST(count(DISTINCT replacement) AS BIGINT) AS distinct_names FROM registry GROUP BY case_id) SELECT * EXCLUDE (latest) FROM a")
def case_registry_growth(spark, sf_dir):
    """How each case's registry grew, and that no two of its entities share a name."""
    return runs(spark, sf_dir).state().groupBy("case_id").agg(F.count("*").alias("names"), F.count_if(F.col("since") == 2).alias("given_in_second"), F.countDistinct("replacement").alias("distinct_names"))


#: Of the tests' key files.
PASSPHRASE = "csak a próbához"


def out_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, hits, parties, reports): a document for each customer, whose number was replaced in five of six of them."""
    rows = people(spark, sf_dir).select("k", "surname", "given", "number", "kind", "text", F.floor(F.col("k") / SIZE).cast("long").alias("case_id"))
    # Ten readers: their texts are made once.
    rows = written(rows, "people")
    k = F.col("k")
    content = F.when(k % 6 == 0, F.col("text")).otherwise(F.replace(F.col("text"), F.col("number"), F.lit("[szám]")))
    state = F.when(k % 3 == 0, "ok").when(k % 3 == 1, "off").otherwise("failed")
    documents = rows.select(
        "case_id", k.alias("document_no"), F.concat(F.lit("/be/irat"), F.floor(k % SIZE / 2).cast("string"), F.when(k % 2 == 0, ".txt").otherwise(".pdf")).alias("path"), F.when(k % 2 == 0, "txt").otherwise("pdf").alias("format"),
        F.lit(1).alias("pages"), F.length("text").alias("chars"), F.when(F.col("case_id") % 3 == 0, "role").when(F.col("case_id") % 3 == 1, "theme").otherwise("numbered").alias("mode"), (F.col("case_id") % 2 == 0).alias("keep_key"),
        export.model_line(state, k % 5, k % 4, F.lit("nincs memória")).alias("model"), F.when(k % 11 == 0, F.array(F.concat(F.lit("lap "), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("warnings"), content.alias("content"),
    )
    found = F.expr("CASE WHEN sum(found) > 0 THEN array(any_value(literal)) ELSE array() END").alias("leaks")
    literals = rows.select("case_id", k.alias("document_no"), F.col("number").alias("literal"))
    leaks = verify.count_leaks(documents, literals, ["case_id", "document_no"], "content").groupBy("case_id", "document_no").agg(found)
    reports = documents.select("case_id", "document_no", (F.col("document_no") % 3).cast("long").alias("residual_total"), F.length("content").cast("long").alias("checked_chars")).join(leaks, ["case_id", "document_no"], "left")

    def hit(where: str, entity: str, kind: str, disposition: str, start: int, surface: str, replacement: str):
        return rows.where(where).selectExpr("case_id", "k AS document_no", f"{entity} AS entity_id", f"'{kind}' AS kind", f"'{disposition}' AS disposition", f"{start} AS start", f"{surface} AS surface", f"{replacement} AS replacement", "text AS context", "k")

    every = hit("true", "CAST(k AS STRING)", "person", "auto", 0, "surname", "'X'")
    for more in (hit("true", "'n' || k", "identifier", "review", 9, "number", "'[szám]'"), hit("k % 7 = 0", "'amount'", "amount", "auto", 1, "'1 Ft'", "'2 Ft'"), hit("k % 5 = 0", "'date'", "date", "auto", 2, "'ma'", "'tegnap'"), hit("k % 9 = 0", "CAST(k AS STRING)", "person", "reject", 3, "given", "'Y'")):
        every = every.unionByName(more)
    hits = decisions.with_outcomes(every.withColumns({"unit_no": F.lit(0), "user_decision": F.lit(None).cast("string"), "class_decision": F.lit(None).cast("string"), "automatic": (k % 4 < 2) | (F.col("disposition") == "reject"), "reason": F.lit("ellenőrzőszám"), "common_word": k % 8 == 0}))
    persons = rows.selectExpr("case_id", "CAST(k AS STRING) AS id", "'person' AS kind", "CAST(NULL AS STRING) AS identifier_kind", "k % 10 = 0 AS skipped")
    numbers = rows.selectExpr("case_id", "'n' || k AS id", "'identifier' AS kind", "kind AS identifier_kind", "k % 10 = 5 AS skipped")
    return documents, hits, persons.unionByName(numbers), reports


def exported(spark: SparkSession, sf_dir: str) -> export.Exports:
    documents, hits, parties, reports = out_documents(spark, sf_dir)
    store = export.Exports(spark, shared_folder(spark, "export"))
    there = documents.where("case_id % 4 = 0").select("case_id", F.lit("irat3-alnevesitett-jegyzokonyv.txt").alias("file_name"), F.lit(None).cast("string").alias("source")).distinct()
    mapping = people(spark, sf_dir).select(F.floor(F.col("k") / SIZE).cast("long").alias("case_id"), F.col("k").cast("string").alias("entity_id"), F.concat_ws(" ", "surname", "given").alias("original"), F.concat(F.lit("X"), F.col("k").cast("string")).alias("replacement"))
    store.export(export.ledger(documents, hits, parties, reports), 1, F.expr("TIMESTAMP '2026-01-02 03:04:05'"), mapping, PASSPHRASE, taken=there)
    return store


_END = "\n".join(("", *export.CLOSING, "", "Készült: 2026-01-02 03:04:05"))
_LABELS = "CASE kind WHEN 'adoszam' THEN 'adószám' WHEN 'bankszamlaszam' THEN 'bankszámlaszám' WHEN 'ado_azonosito_jel' THEN 'adóazonosító jel' ELSE 'TAJ-szám' END"
EXPORT_SQL = f"""{people_sql()},
d AS (SELECT *, k // {SIZE} AS case_id, 'irat' || CAST(k % {SIZE} // 2 AS VARCHAR) AS stem, CASE WHEN k % 2 = 0 THEN 'txt' ELSE 'pdf' END AS ext, CASE WHEN k % 6 = 0 THEN text ELSE replace(text, number, '[szám]') END AS content, CASE WHEN k // {SIZE} % 3 = 0 THEN '-obh' ELSE '-alnevesitett' END AS suffix FROM people),
parties AS (SELECT case_id, k, 'személy' AS label, k % 10 = 0 AS skipped, TRUE AS accepted FROM d UNION ALL SELECT case_id, k, 'azonosító — ' || {_LABELS}, k % 10 = 5, k % 4 < 2 FROM d),
sizes AS (SELECT case_id, label, count(*) AS parties FROM parties WHERE NOT skipped GROUP BY ALL),
seen AS (SELECT k, label, count(*) AS n FROM parties WHERE NOT skipped AND accepted GROUP BY ALL),
lines AS (SELECT d.k, string_agg('  ' || rpad(label, {export.WIDTH}, ' ') || ' ' || parties || ' fél, ' || coalesce(n, 0) || ' előfordulás' || chr(10), '' ORDER BY coalesce(n, 0) DESC, strip_accents(lower(label))) AS lines FROM (SELECT k, case_id FROM d) d JOIN sizes USING (case_id) LEFT JOIN seen USING (k, label) GROUP BY d.k),
certificates AS (SELECT case_id, d.k AS document_no, stem, ext, suffix, k % 6 <> 0 AS clean, '{export.HEADER}' || chr(10) || chr(10)
 || 'Forrásfájl:            ' || stem || '.' || ext || chr(10) || 'Formátum:              ' || upper(ext) || ', 1 oldal, ' || length(text) || ' karakter' || chr(10)
 || 'Csere módja:           ' || CASE case_id % 3 WHEN 0 THEN '{export.MODES["role"]}' WHEN 1 THEN '{export.MODES["theme"]}' ELSE '{export.MODES["numbered"]}' END || chr(10)
 || 'Kulcsfájl:             ' || CASE WHEN case_id % 2 = 0 THEN '{export.KEY_LINE[True]}' ELSE '{export.KEY_LINE[False]}' END || chr(10)
 || 'Nyelvi modell:         ' || CASE k % 3 WHEN 0 THEN 'futott (' || k % 5 || ' találat)' WHEN 1 THEN '{export.NO_RUN.format("kikapcsolva")}' ELSE '{export.NO_RUN.format("HIBA: nincs memória")}' END || CASE WHEN k % 4 > 0 THEN '; ' || k % 4 || ' találatát nem tudtuk értelmezni' ELSE '' END || chr(10) || chr(10)
 || 'Lecserélt előfordulás: ' || 1 + (k % 4 < 2)::INT + (k % 7 = 0)::INT + (k % 5 = 0)::INT || chr(10) || 'Eldöntetlen találat:   ' || (k % 4 >= 2)::INT || chr(10)
 || 'Program döntötte el:   ' || (k % 4 < 2)::INT || ' bizonytalan találat (ember helyett)' || chr(10) || 'Program bent hagyta:   ' || (k % 9 = 0)::INT || ' elutasított találat (a szövegkörnyezet szerint köznév)' || chr(10)
 || 'Ellenőrzött karakter:  ' || length(content) || chr(10) || 'Gyanús maradvány:      ' || k % 3 || ' (emberi átnézésre)' || chr(10) || 'Ellenőrző kör:         {export.CLEAN}' || chr(10) || chr(10) || '{export.TITLES["replaced"]}' || chr(10)
 || lines || CASE WHEN k % 7 = 0 THEN '  ' || rpad('pénzösszeg', {export.WIDTH}, ' ') || ' 1 előfordulás átírva' || chr(10) ELSE '' END || CASE WHEN k % 5 = 0 THEN '  ' || rpad('dátum', {export.WIDTH}, ' ') || ' 1 előfordulás eltolva' || chr(10) ELSE '' END
 || CASE WHEN k % 4 < 2 THEN chr(10) || '{export.TITLES["automatic"]}' || chr(10) || '  1 bizonytalan találatot a program fogadott el emberi döntés nélkül' || CASE WHEN k % 8 = 0 THEN ', ebből 1 köznévvel azonos alakú (valószínűleg fölösleges csere)' ELSE '' END || '.' || chr(10)
  || '  - "' || number || '" → [szám]' || CASE WHEN k % 8 = 0 THEN ' [köznév is]' ELSE '' END || ' — 1. oldal, ellenőrzőszám' || chr(10) || '      ' || text || chr(10) ELSE '' END
 || CASE WHEN k % 11 = 0 THEN chr(10) || '{export.TITLES["warnings"]}' || chr(10) || '  - lap ' || k || chr(10) ELSE '' END || '{_END}' AS content FROM d JOIN lines USING (k)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id, stem ORDER BY document_no) + (case_id % 4 = 0 AND stem = 'irat3' AND suffix = '-alnevesitett')::INT AS n FROM certificates WHERE clean)"""


@query(f"WITH {EXPORT_SQL} SELECT case_id, document_no, stem || suffix || '-jegyzokonyv' || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.txt' AS file_name, stem || '.' || ext AS source, content FROM numbered")
def export_certificates(spark, sf_dir):
    return exported(spark, sf_dir).read("certificates").drop("run")


@query(f"WITH {EXPORT_SQL} SELECT case_id, k AS document_no, stem || suffix || '.' || ext AS file_name, content FROM d WHERE k % 6 <> 0")
def export_clean_documents(spark, sf_dir):
    return exported(spark, sf_dir).read("documents").drop("run")


@query(f"WITH {people_sql()} SELECT k // {SIZE} AS case_id, k AS document_no, number AS leak FROM people WHERE k % 6 = 0")
def export_held_back(spark, sf_dir):
    return exported(spark, sf_dir).read("held_back").select("case_id", "document_no", F.explode("leaks").alias("leak"))


@query(f"WITH {people_sql()}, p AS (SELECT k // {SIZE} AS case_id, k, surname || ' ' || given AS original FROM people) SELECT CAST(k AS VARCHAR) AS entity_id, original, 'X' || k AS replacement FROM p WHERE case_id % 2 = 0 AND case_id IN (SELECT case_id FROM p WHERE k % 6 <> 0)")
def export_keys(spark, sf_dir):
    """The sealed mapping, opened again."""
    return keyfile.unseal(exported(spark, sf_dir).read("keys"), PASSPHRASE)
