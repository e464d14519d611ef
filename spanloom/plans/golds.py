"""Queries over gold cases: a table's rows take their input from a small list in turn, and SQL knows the answer of each case.

The answers are fixed values: they follow from the rules of Hungarian and of the formats, not from this library.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import hungarian
from spanloom.operators import amounts, dates, identifiers, labels, merging, names, ner, parties, render, shaping, themes, verify
from spanloom.plans.carrier import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def inputs(spark: SparkSession, sf_dir: str, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """(k, case_no, columns): customer ``k`` has case ``k`` modulo their number. The list is short, so it is broadcast."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_no int, {columns}")
    keys = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")), "k").withColumn("case_no", (F.col("k") % len(rows)).cast("int"))
    return keys.join(F.broadcast(cases), "case_no")


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def answers(n: int, columns: Sequence[str], rows: Sequence[tuple]) -> str:
    """SQL for (k, columns) where ``rows`` has (case_no, values...), any number of them for a case; ``columns`` are "name TYPE"."""
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    pairs = [c.split(" ", 1) for c in columns]
    listed = ", ".join(f'CAST(g."{c}" AS {t}) AS "{c}"' for c, t in pairs)
    quoted = ", ".join(f'"{c}"' for c, _ in pairs)
    return f"WITH g(case_no, {quoted}) AS (VALUES {values}) SELECT CAST(c_custkey AS BIGINT) AS k, {listed} FROM customer JOIN g ON c_custkey % {n} = g.case_no"


def gold(name: str, n: int, columns: Sequence[str], rows: Sequence[tuple]):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = answers(n, columns, rows)
        return fn

    return add


#: (name, case, form)
FORMS = (
    ("Kovács", "DAT", "Kovácsnak"), ("Németh", "DAT", "Némethnek"), ("Ödön", "ALL", "Ödönhöz"), ("Gránit", "DAT", "Gránitnak"), ("Kis", "DAT", "Kisnek"),
    ("Kovács", "INS", "Kováccsal"), ("Nagy", "INS", "Naggyal"), ("Kiss", "INS", "Kiss-sel"), ("Papp", "INS", "Papp-pal"), ("Anna", "INS", "Annával"),
    ("Szabó", "INS", "Szabóval"), ("Anna", "ACC", "Annát"), ("Tünde", "ALL", "Tündéhez"), ("Anna", "FOR", "Annaként"), ("Farkas", "ACC", "Farkast"),
    ("Nagy", "ACC", "Nagyot"), ("Kovács", "SUP", "Kovácson"), ("Kovács", "FAM", "Kovácsék"), ("Kovács", "PL", "Kovácsok"),
    ("Kovács János", "WIFE", "Kovács Jánosné"), ("Kovács Jánosné", "INS", "Kovács Jánosnéval"), ("Tóth", "TRANS", "Tóthtá"), ("Anna", "TRANS", "Annává"),
)
ORGANISATIONS = (("Aranykalász Kft.", "DAT", "Aranykalász Kft.-nek"), ("Kovakő Zrt.", "ACC", "Kovakő Zrt.-t"), ("Gránit Bt.", "INS", "Gránit Bt.-vel"))
NUMERALS = ((0, "nulla"), (22, "huszonkettő"), (200, "kétszáz"), (1999, "ezerkilencszázkilencvenkilenc"), (2000, "kétezer"), (2001, "kétezer-egy"), (-5, "mínusz öt"), (4800000, "négymillió-nyolcszázezer"), (13, "tizenhárom"), (1000000, "egymillió"))


@gold("inflected_names", len(FORMS), ["name VARCHAR", "tag VARCHAR", "form VARCHAR"], [(i, *r) for i, r in enumerate(FORMS)])
def inflected_names(spark, sf_dir):
    rows = inputs(spark, sf_dir, "name string, tag string", [r[:2] for r in FORMS])
    forms = hungarian.paradigms(rows)
    return rows.join(forms.withColumnRenamed("case", "tag"), ["name", "tag"]).select("k", "name", "tag", "form")


@gold("inflected_organisations", len(ORGANISATIONS), ["name VARCHAR", "tag VARCHAR", "form VARCHAR"], [(i, *r) for i, r in enumerate(ORGANISATIONS)])
def inflected_organisations(spark, sf_dir):
    rows = inputs(spark, sf_dir, "name string, tag string", [r[:2] for r in ORGANISATIONS]).withColumn("org", F.lit(True))
    forms = hungarian.paradigms(rows, organisation="org")
    return rows.join(forms.withColumnRenamed("case", "tag"), ["name", "tag"]).select("k", "name", "tag", "form")


@gold("numerals", len(NUMERALS), ["n BIGINT", "in_words VARCHAR", "read_to INT"], [(i, n, w, len(w)) for i, (n, w) in enumerate(NUMERALS)])
def numerals(spark, sf_dir):
    """Written and read back: how far the words of the number reach in a text that begins with them."""
    said = hungarian.numerals(inputs(spark, sf_dir, "n long", [r[:1] for r in NUMERALS]), "n", " forint")
    return said.select("k", "n", "in_words", F.when(F.col("n") < 0, F.length("in_words")).otherwise(F.col("read_to")).cast("int").alias("read_to"))


#: (text, kind, surface, label, confidence, disposition)
IDENTIFIERS = (
    ("A cég száma 01-09-123456 volt.", "cegjegyzekszam", "01-09-123456", None, 60, "review"),
    ("A cégjegyzékszáma: 01-09-123456 volt.", "cegjegyzekszam", "01-09-123456", "cégjegyzékszáma", 85, "auto"),
    ("A cégjegyzékszáma: 25-09-123456 volt.", "cegjegyzekszam", "25-09-123456", "cégjegyzékszáma", 70, "review"),
    ("Az ingatlan hrsz.: 1234/5 alatt.", "helyrajzi_szam", "hrsz.: 1234/5", "hrsz.", 85, "auto"),
    ("Az ingatlan 1234/5 hrsz. alatt.", "helyrajzi_szam", "1234/5 hrsz.", "hrsz.", 85, "auto"),
    ("Lakik: 1051 Budapest, Kossuth Lajos utca 12.", "cim", "1051 Budapest, Kossuth Lajos utca 12.", None, 70, "review"),
    ("Lakcíme: 6720 Szeged, Tisza Lajos körút 3/A. II. emelet 5. ajtó", "cim", "6720 Szeged, Tisza Lajos körút 3/A. II. emelet 5. ajtó", "Lakcíme", 95, "auto"),
    ("Postája 6720 Szeged volt.", "iranyitoszam", "6720 Szeged", None, 35, "review"),
    ("Hívható: +36 30 123 4567 este.", "telefonszam", "+36 30 123 4567", None, 75, "review"),
    ("Telefon: 06-1-123-45-67 este.", "telefonszam", "06-1-123-45-67", "Telefon", 100, "auto"),
    ("Okmánya 123456AB volt.", "szemelyazonosito_igazolvany", "123456AB", None, 55, "review"),
    ("Személyi igazolvány: AB123456 volt.", "szemelyazonosito_igazolvany", "AB123456", "Személyi igazolvány", 80, "auto"),
    ("A 12.P.20.845/2026 alatt.", "birosagi_ugyszam", "12.P.20.845/2026", None, 80, "auto"),
    ("Autója ABC-123 volt.", "rendszam", "ABC-123", None, 55, "review"),
    ("Rendszáma: AA-BB-123 volt.", "rendszam", "AA-BB-123", "Rendszáma", 80, "auto"),
    ("Ír ide: kiss.anna@pelda.hu este.", "email", "kiss.anna@pelda.hu", None, 85, "auto"),
)


def _reason(kind: str, label: str | None, structure: bool) -> str:
    parts = [f"{identifiers.NAMES[kind]} mintája illeszkedik", label and f"címke a szövegben: „{label}”", None if structure else "a megyekód a szokásos tartományon kívül esik"]
    return "; ".join(p for p in parts if p)


@gold(
    "identifier_kinds",
    len(IDENTIFIERS),
    ["kind VARCHAR", "surface VARCHAR", "label VARCHAR", "confidence INT", "disposition VARCHAR", "reason VARCHAR", "start INT", "place_first INT", "guess VARCHAR"],
    [(i, r[1], r[2], r[3], r[4], r[5], _reason(r[1], r[3], not r[2].startswith("25-")), r[0].index(r[2]), 0 if r[1] in ("helyrajzi_szam", "cim", "iranyitoszam") else 1, r[1]) for i, r in enumerate(IDENTIFIERS)],
)
def identifier_kinds(spark, sf_dir):
    rows = inputs(spark, sf_dir, "text string", [r[:1] for r in IDENTIFIERS])
    found = identifiers.resolved(rows, ["k"])
    whole = identifiers.guess_kind(found, ["k"]).withColumnRenamed("kind", "guess")
    return found.join(whole, "k").select("k", "kind", "surface", "label", "confidence", "disposition", "reason", "start", identifiers.coverage_priority(F.col("kind")).alias("place_first"), "guess")


#: (text, surface, year, month, day, thirty days later)
DATES = (
    ("Kelt 2026. június 24. napján.", "2026. június 24.", 2026, 6, 24, "2026. július 24."),
    ("Kelt 2026.06.24. napján.", "2026.06.24.", 2026, 6, 24, "2026.07.24."),
    ("Kelt 2026-06-24 napján.", "2026-06-24", 2026, 6, 24, "2026-07-24"),
    ("Kelt 2026. VI. 24. napján.", "2026. VI. 24.", 2026, 6, 24, "2026. VII. 24."),
    ("A 2026. június 24-i szerződés.", "2026. június 24-i", 2026, 6, 24, "2026. július 24-i"),
    ("Még június 24-én kelt.", "június 24-én", None, 6, 24, "július 24-én"),
    ("Csak 2025 februárjában kelt.", "2025 februárjában", 2025, 2, None, "2025 márciusában"),
    ("Volt 2026. június hónapban.", "2026. június", 2026, 6, None, "2026. július"),
    ("Az nem 2026. február 30. napján.", "2026. február 30.", 2026, 2, 30, "2026. március 30."),
    ("A 2016. évi CXXX. törvény 170. §-a.", None, None, None, None, None),
)


@gold("date_shapes", len(DATES), ["surface VARCHAR", "start INT", "year INT", "month INT", "day INT", "replacement VARCHAR"], [(i, r[1], r[0].index(r[1]), *r[2:]) for i, r in enumerate(DATES) if r[1]])
def date_shapes(spark, sf_dir):
    return dates.scan(inputs(spark, sf_dir, "text string", [r[:1] for r in DATES]), ["k"], days=30).select("k", "surface", "start", "year", "month", "day", "replacement")


#: (text, surface, value, currency)
AMOUNTS = (
    ("Fizet 1 250 000 Ft összeget.", "1 250 000 Ft", 1250000.0, "HUF"),
    ("Fizet 1.250.000,- Ft összeget.", "1.250.000,- Ft", 1250000.0, "HUF"),
    ("Fizet 1250000 forint összeget.", "1250000 forint", 1250000.0, "HUF"),
    ("Fizet 12 500 EUR összeget.", "12 500 EUR", 12500.0, "EUR"),
    ("Fizet 12,50 EUR összeget.", "12,50 EUR", 12.5, "EUR"),
    ("Fizet 1 250 000 (egymillió-kétszázötvenezer) forint összeget.", "1 250 000 (egymillió-kétszázötvenezer) forint", 1250000.0, "HUF"),
    ("Fizet 4 800 000 Ft, azaz négymillió-nyolcszázezer forint összeget.", "4 800 000 Ft, azaz négymillió-nyolcszázezer forint", 4800000.0, "HUF"),
    ("Fizet 300 USD összeget.", "300 USD", 300.0, "USD"),
    ("A Ptk. 6:383. §-a és 15 nap.", None, None, None),
)


@gold("amount_shapes", len(AMOUNTS), ["surface VARCHAR", "start INT", "value DOUBLE", "currency VARCHAR"], [(i, r[1], r[0].index(r[1]), *r[2:]) for i, r in enumerate(AMOUNTS) if r[1]])
def amount_shapes(spark, sf_dir):
    return amounts.scan(inputs(spark, sf_dir, "text string", [r[:1] for r in AMOUNTS]), ["k"]).select("k", "surface", "start", "value", "currency")


#: text, then (name, kind, role, gender, confidence) of its parties, then (name, why) of those who stay named.
PARTIES = (
    ("Felperes: Kovács János\nvalahol.", [("Kovács János", "person", "felperes", "M", 97)], []),
    ("A bíróság Nagy Anna tanú vallomását hallgatta.", [("Nagy Anna", "person", "tanú", "F", 93)], []),
    ("Szabó Péter mint alperes jelent meg.", [("Szabó Péter", "person", "alperes", "M", 96)], []),
    ("Született, anyja neve: Tóth Mária volt.", [("Tóth Mária", "person", "anyja neve", "F", 95)], []),
    ("Az Aranykalász Agrár Kft. fizet.", [("Aranykalász Agrár Kft.", "org", "szervezet", "N", 96)], []),
    ("Özvegye dr. Kiss Balázs volt, a Kiss úr.", [("dr. Kiss Balázs", "person", "egyéb", "M", 82)], []),
    ("Eljárt dr. Vasvári Anikó bíró ma.", [], [("dr. Vasvári Anikó", "bíró")]),
    ("A tanács elnöke: Molnár Gábor", [], [("Molnár Gábor", "tanács elnöke")]),
    ("Eljár a Szentendrei Járásbíróság ma.", [], [("Szentendrei Járásbíróság", "hatóság")]),
    ("Képviseli a Balogh Ügyvédi Iroda ma.", [], [("Balogh Ügyvédi Iroda", "iroda")]),
    ("Felperes: Farkas Ilona\nés Farkas Ilonának írt a Papp Gergő tanú.", [("Farkas Ilona", "person", "felperes", "F", 97), ("Papp Gergő", "person", "tanú", "N", 93)], []),
)
_ROWS = [(r[0],) for r in PARTIES]


@gold("party_rules", len(PARTIES), ["name VARCHAR", "kind VARCHAR", "role VARCHAR", "gender VARCHAR", "confidence INT"], [(i, *p) for i, r in enumerate(PARTIES) for p in r[1]])
def party_rules(spark, sf_dir):
    return parties.detect(inputs(spark, sf_dir, "text string", _ROWS), "k")[0].select("k", "name", "kind", "role", "gender", "confidence")


@gold("kept_names", len(PARTIES), ["name VARCHAR", "why VARCHAR"], [(i, *p) for i, r in enumerate(PARTIES) for p in r[2]])
def kept_names(spark, sf_dir):
    return parties.detect(inputs(spark, sf_dir, "text string", _ROWS), "k")[1].select("k", "name", "why")


#: (text, surface, entity, core, case, disposition)
CAST = (("p", "person", "Kovács", "János", "M", None, None), ("o", "org", None, None, "N", "Aranykalász Agrár Kft.", "AA"))
MENTIONS = (
    ("Szólt Kovács János ma.", "Kovács János", "p", "full", "NOM", "auto"),
    ("Szólt Kovácsnak ma.", "Kovácsnak", "p", "surname", "DAT", "auto"),
    ("Az Aranykalász Kft.-vel volt pere.", "Aranykalász Kft.-vel", "o", "org_short", "INS", "auto"),
    ("Írt: kovacs.janos@x.hu címre.", "kovacs.janos@x.hu", "p", "identifier", "NOM", "auto"),
    ("Jött Kovácsostul ma.", "Kovácsostul", "p", None, None, "review"),
    ("Szólt kovacs janosnak ma.", "kovacs janosnak", "p", "full", "DAT", "review"),
    ("Szólt KOVÁCS JÁNOSSAL ma.", "KOVÁCS JÁNOSSAL", "p", "full", "INS", "auto"),
    ("Nincs itt senki.", None, None, None, None, None),
)


@gold("name_mentions", len(MENTIONS), ["surface VARCHAR", "start INT", "entity_id VARCHAR", "core VARCHAR", "case_tag VARCHAR", "disposition VARCHAR"], [(i, r[1], r[0].index(r[1]), *r[2:]) for i, r in enumerate(MENTIONS) if r[1]])
def name_mentions(spark, sf_dir):
    rows = inputs(spark, sf_dir, "text string", [r[:1] for r in MENTIONS]).withColumn("case_id", F.pmod("k", F.lit(64)))
    cast = spark.createDataFrame(list(CAST), "id string, kind string, surname string, given string, gender string, name string, abbreviation string")
    cases = rows.select("case_id").distinct().join(F.broadcast(cast))
    return names.match(rows, cases, "case_id", ["k"]).select("k", "surface", "start", "entity_id", "core", "case_tag", "disposition")


#: (text, known literals, ok, first residue, residue in all)
OUTPUTS = (
    ("A felperes adóazonosító jele: 8442130976, igen.", None, True, "8442130976", 1),
    ("A kártya száma 4263982640269299, ez nem azonosító jel.", None, True, None, 0),
    ("A kártérítés összege 123 456 789 Ft, amit meg kell fizetni.", None, True, None, 0),
    ("a nyilvántartott adóazonosító: 8442 130 976.", "8442130976", False, None, 0),
    ("A felperes lakcíme [lakcím], a neve [NÉV-1] a szerződésben.", None, True, None, 0),
    ("A tanú ifj. Zsombor nevű személy volt.", None, True, "Zsombor", 1),
    ("Elutasította. Zsombor tanú volt.", None, True, None, 0),
)


@gold("gate_reports", len(OUTPUTS), ["ok BOOLEAN", "residue VARCHAR", "residual_total INT"], [(i, *r[2:]) for i, r in enumerate(OUTPUTS)])
def gate_reports(spark, sf_dir):
    rows = inputs(spark, sf_dir, "text string, literal string", [r[:2] for r in OUTPUTS]).withColumn("known", F.when(F.col("literal").isNotNull(), F.array("literal")))
    return verify.report(rows, ["k"], literals="known").select("k", "ok", F.get("residual", F.lit(0)).alias("residue"), F.col("residual_total").cast("int").alias("residual_total"))


ROLES = (("felperes", "DAT", "felperesnek"), ("alperes", "INS", "alperessel"), ("tanú", "ACC", "tanút"), ("vádlott", "SUP", "vádlotton"), ("II. rendű alperes", "DAT", "II. rendű alperesnek"))


@gold("role_forms", len(ROLES), ["role VARCHAR", "tag VARCHAR", "form VARCHAR"], [(i, *r) for i, r in enumerate(ROLES)])
def role_forms(spark, sf_dir):
    rows = inputs(spark, sf_dir, "role string, tag string", [r[:2] for r in ROLES])
    forms = spark.createDataFrame(render.role_table([r[0] for r in ROLES]), "role string, tag string, form string")
    return rows.join(F.broadcast(forms), ["role", "tag"]).select("k", "role", "tag", "form")


#: (mode, language, kind, identifier kind, role, number, case, replacement)
LABELS = (
    ("type", "hu", "person", None, None, 1, "DAT", "[név]-nek"), ("type", "hu", "place", None, None, 1, "NOM", "[helység]"),
    ("type", "hu", "identifier", "cim", None, 1, "DAT", "[lakcím]-nak"), ("type", "hu", "identifier", "iban", None, 2, "NOM", "[bankszámlaszám]"),
    ("numbered", "hu", "person", None, None, 1, "ALL", "[NÉV-1]-hez"), ("numbered", "hu", "identifier", "adoszam", None, 2, "NOM", "[ADÓSZÁM-2]"),
    ("numbered", "en", "org", None, None, 3, "NOM", "[ORG-3]"), ("type", "en", "person", None, None, 1, "DAT", "[name]-nek"),
    ("type", "en", "identifier", "taj", None, 1, "DAT", "[social security number]-nak"),
    ("role", "hu", "person", None, "Felperes", 1, "DAT", "felperesnek"), ("role", "hu", "person", None, "ii. rendű alperes", 1, "INS", "II. r. alperessel"),
    ("role", "hu", "person", None, "tanú (az Aranykalász Kft. ügyvezetője)", 1, "ACC", "tanút"), ("role", "hu", "person", None, "a malom ügyvezetője", 1, "NOM", "[név]"),
    ("role", "hu", "org", None, "egyéb", 1, "NOM", "[szervezet]"), ("role", "en", "person", None, "felperes", 1, "DAT", "the plaintiff-nek"),
    ("role", "en", "person", None, "I. r. alperes", 1, "NOM", "the 1st defendant"), ("role", "hu", "place", None, "felperes", 1, "NOM", "[helység]"),
)


@gold("mode_labels", len(LABELS), ["mode VARCHAR", "language VARCHAR", "replacement VARCHAR"], [(i, r[0], r[1], r[7]) for i, r in enumerate(LABELS)])
def mode_labels(spark, sf_dir):
    rows = inputs(spark, sf_dir, "mode string, language string, kind string, identifier_kind string, role string, number int, case_tag string", [r[:7] for r in LABELS])
    rows = rows.withColumns({"upper": F.lit(False), "manual": F.lit(None).cast("string")})
    parts = [labels.render(rows.where((F.col("mode") == m) & (F.col("language") == lang)), m, lang) for m in labels.MODES for lang in ("hu", "en")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("k", "mode", "language", "replacement")


#: (role, usable, warning)
SAID = (("Felperes", "felperes", None), ("II. rendű  alperes:", "II. r. alperes", None), ("tanú (a Kft. ügyvezetője)", "tanú", "shortened"), ("ügyvezető", None, "unknown"), ("egyéb", None, None), ("", None, None))


@gold("usable_roles", len(SAID), ["role VARCHAR", "usable VARCHAR", "warning VARCHAR"], [(i, *r) for i, r in enumerate(SAID)])
def usable_roles(spark, sf_dir):
    rows = inputs(spark, sf_dir, "role string", [r[:1] for r in SAID])
    return rows.select("k", "role", labels.sanitize_role(F.col("role")).alias("usable"), labels.role_warning(F.col("role")).alias("warning"))


#: text, hits as (surface, disposition, approved, replacement), then text, replaced, pending and articles
SUBSTITUTED = (
    ("Az Aranykalász és a Nagy pere.", [("Aranykalász", "auto", None, "Tűzkő"), ("Nagy", "auto", None, "Obszidián")], "A Tűzkő és az Obszidián pere.", 2, 0, 2),
    ("Szólt Kovács és Nagy.", [("Kovács", "auto", None, "Gránit"), ("Nagy", "review", None, "Opál")], "Szólt Gránit és Nagy.", 1, 1, 0),
    ("Szólt Kovács és Nagy.", [("Kovács", "reject", None, "Gránit"), ("Nagy", "review", True, "Opál")], "Szólt Kovács és Opál.", 1, 1, 0),
    ("Szólt Kovács.", [("Kovács", "auto", None, None)], "Szólt Kovács.", 0, 1, 0),
    ("Senki sem szólt.", [], "Senki sem szólt.", 0, 0, 0),
)


@gold("substitution", len(SUBSTITUTED), ["text VARCHAR", "replaced INT", "pending INT", "articles_fixed INT"], [(i, *r[2:]) for i, r in enumerate(SUBSTITUTED)])
def substitution(spark, sf_dir):
    units = inputs(spark, sf_dir, "text string", [r[:1] for r in SUBSTITUTED])
    listed = [(i, r[0].index(h[0]), r[0].index(h[0]) + len(h[0]), *h[1:]) for i, r in enumerate(SUBSTITUTED) for h in r[1]]
    hits = units.select("k", "case_no").join(F.broadcast(spark.createDataFrame(listed, "case_no int, start int, end int, disposition string, approved boolean, replacement string")), "case_no")
    return labels.substitute(units.select("k", "text"), hits.drop("case_no"), ["k"])


#: (form, group, fault)
PROPOSALS = (("Gránit", "surname", None), ("", "surname", "empty"), ("granit", "surname", "letters"), ("Gr4nit", "surname", "letters"), ("Krszt", "surname", "no vowel"), ("Ab", "given", "short"), ("Abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", "surname", "long"), (None, "place", "empty"))


@gold("proposal_faults", len(PROPOSALS), ["form VARCHAR", "fault VARCHAR"], [(i, r[0], r[2]) for i, r in enumerate(PROPOSALS)])
def proposal_faults(spark, sf_dir):
    rows = inputs(spark, sf_dir, "form string, `group` string", [r[:2] for r in PROPOSALS])
    return rows.select("k", "form", themes.shape_fault(F.col("form"), F.col("group")).alias("fault"))


#: (text, its pieces with their places)
PIECES = (
    ("kovács.", [("ko", 0, 2), ("##vács", 2, 6), (".", 6, 7)]),
    ("Ko ko", [("[UNK]", 0, 2), ("ko", 3, 5)]),
    ("kox ko", [("[UNK]", 0, 3), ("ko", 4, 6)]),
    ("ko\tko.ko", [("ko", 0, 2), ("ko", 3, 5), (".", 5, 6), ("ko", 6, 8)]),
    ("", []),
)


@gold("wordpieces", len(PIECES), ["no INT", "piece VARCHAR", "start INT", "end INT"], [(i, no, *p) for i, r in enumerate(PIECES) for no, p in enumerate(r[1])])
def wordpieces(spark, sf_dir):
    tokenizer = ner.WordPiece({"[UNK]": 0, "ko": 1, "##vács": 2, ".": 3})
    return ner.tokenize(inputs(spark, sf_dir, "text string", [r[:1] for r in PIECES]), ["k"], tokenizer).select("k", F.col("token_no").alias("no"), "piece", "start", "end")


#: (text, start, end, trimmed start, trimmed end)
SPANS = (("a „Kovács János”, b", 2, 18, 3, 15), ("Kovács", 0, 6, 0, 6), ("( - )", 0, 5, 5, 5), ("x Nagy. ", 1, 8, 2, 6))


@gold("trimmed_spans", len(SPANS), ["start INT", "end INT"], [(i, *r[3:]) for i, r in enumerate(SPANS)])
def trimmed_spans(spark, sf_dir):
    rows = inputs(spark, sf_dir, "text string, start int, end int", [r[:3] for r in SPANS])
    return rows.select("k", shaping.trim_span(F.col("text"), F.col("start"), F.col("end")).alias("s")).select("k", "s.start", "s.end")


#: tokens (label, score, start, end), groups (label, start, end, score, kind)
BIO = (
    ([("B-PER", 0.75, 0, 6), ("I-PER", 0.25, 7, 12), ("O", 0.9, 13, 15), ("B-ORG", 0.5, 16, 20)], [("PER", 0, 12, 0.5, "person"), ("ORG", 16, 20, 0.5, "org")]),
    ([("B-PER", 0.5, 0, 3), ("B-PER", 1.0, 4, 9), ("B-PER", 0.5, 12, 15)], [("PER", 0, 9, 0.75, "person"), ("PER", 12, 15, 0.5, "person")]),
    ([("I-XX", 0.5, 0, 3), ("", 1.0, 4, 9), ("I-LOC", 0.25, 12, 15)], [("XX", 0, 3, 0.5, None), ("LOC", 12, 15, 0.25, "place")]),
)


@gold("bio_averages", len(BIO), ["label VARCHAR", "start INT", "end INT", "score DOUBLE", "kind VARCHAR"], [(i, *g) for i, r in enumerate(BIO) for g in r[1]])
def bio_averages(spark, sf_dir):
    rows = inputs(spark, sf_dir, "n int", [(len(r[0]),) for r in BIO]).select("k", "case_no")
    tokens = spark.createDataFrame([(i, no, *t) for i, r in enumerate(BIO) for no, t in enumerate(r[0])], "case_no int, no int, label string, score double, start int, end int")
    return shaping.map_labels(shaping.group_bio(rows.join(F.broadcast(tokens), "case_no"), ["k"])).select("k", "label", "start", "end", "score", "kind")


#: (logits, label, score)
LOGITS = (((0.0, 0.0), "O", 0.5), ((-5.0, 0.0, 0.0), "B-PER", 0.4983212), ((1.0,), "O", 1.0))


@gold("likeliest_labels", len(LOGITS), ["label VARCHAR", "score DOUBLE"], [(i, *r[1:]) for i, r in enumerate(LOGITS)])
def likeliest_labels(spark, sf_dir):
    rows = inputs(spark, sf_dir, "logits array<double>", [(list(r[0]),) for r in LOGITS])
    best = rows.select("k", shaping.softmax_best(F.col("logits"), ["O", "B-PER", "I-PER"]).alias("b"))
    return best.select("k", "b.label", F.round("b.score", 7).alias("score"))


#: (text, cleaned, places)
CLEANED = ((" a  b ,c ( d )", "a b,c (d)", "0,0,1,1,2,3,3,4,5,6,7,7,8,8,9"), ("ab", "ab", "0,1,2"), ("", "", "0"))


@gold("cleaned_texts", len(CLEANED), ["cleaned VARCHAR", "places VARCHAR"], [(i, *r[1:]) for i, r in enumerate(CLEANED)])
def cleaned_texts(spark, sf_dir):
    rows = inputs(spark, sf_dir, "text string", [r[:1] for r in CLEANED])
    places = F.array_join(F.transform(shaping.cleaned_places(F.col("text")), lambda x: x.cast("string")), ",")
    return rows.select("k", shaping.clean_spaces(F.col("text")).alias("cleaned"), places.alias("places"))


#: (name, gender, surname, given, maiden, wife_of)
FULL_NAMES = (
    ("dr. Kovács János", "M", "Kovács", "János", None, None), ("Kovács Jánosné", "F", "Kovács", "János", None, "Kovács János"),
    ("Baloghné Fehér Ilona", "F", "Balogh", "Ilona", "Fehér", "Balogh"), ("Nagy Anna Mária", "F", "Nagy", "Anna Mária", None, None), ("Kovács Jánosné", "N", "Kovács", "Jánosné", None, None),
)


@gold("names_read", len(FULL_NAMES), ["name VARCHAR", "surname VARCHAR", "given VARCHAR", "maiden VARCHAR", "wife_of VARCHAR"], [(i, r[0], *r[2:]) for i, r in enumerate(FULL_NAMES)])
def names_read(spark, sf_dir):
    rows = inputs(spark, sf_dir, "name string, gender string", [r[:2] for r in FULL_NAMES])
    return rows.select("k", "name", shaping.read_name(F.col("name"), F.col("gender")).alias("n")).select("k", "name", "n.surname", "n.given", "n.maiden", "n.wife_of")


#: (core, case, locative of the new name, case)
PLACES = (("place", "SUP", "ine", "INE"), ("place", "INE", "sup", "SUP"), ("place", "ELA", None, "DEL"), ("place", "ILL", "ine", "ILL"), ("place", "DAT", "ine", "DAT"), ("surname", "SUP", "ine", "SUP"))


@gold("locatives", len(PLACES), ["tag VARCHAR", "adjusted VARCHAR"], [(i, r[1], r[3]) for i, r in enumerate(PLACES)])
def locatives(spark, sf_dir):
    rows = inputs(spark, sf_dir, "core string, tag string, locative string", [r[:3] for r in PLACES])
    return rows.select("k", "tag", shaping.locative_case(F.col("core"), F.col("tag"), F.col("locative")).alias("adjusted"))


#: (path, name by roles, name by a theme)
FILES = (("/a/b.c/itelet.docx", "itelet-obh.docx", "itelet-alnevesitett.docx"), ("kereset.tar.txt", "kereset.tar-obh.txt", "kereset.tar-alnevesitett.txt"), ("nincs", "nincs-obh", "nincs-alnevesitett"))


@gold("export_names", len(FILES), ["by_role VARCHAR", "by_theme VARCHAR"], [(i, *r[1:]) for i, r in enumerate(FILES)])
def export_names(spark, sf_dir):
    rows = inputs(spark, sf_dir, "path string", [r[:1] for r in FILES])
    return rows.select("k", shaping.export_name(F.col("path"), "role").alias("by_role"), shaping.export_name(F.col("path"), "theme").alias("by_theme"))


#: hits (kind, surface), known (id, kind, name), matched entity of each hit, new ones (id, name, role)
HELD = (
    ([("adoszam", "12345678-1-42"), ("taj", "123 456 789"), ("taj", "123-456-789")], [("e1", "adoszam", "12345678 1 42")], ["e1", None, None], [("#az1", "123 456 789", "TAJ-szám")]),
    ([("email", "A@b.hu"), ("adoszam", "12345678-1-42")], [("e2", "email", "a@B.hu"), ("e3", "taj", "12345678142")], ["e2", None], [("#az1", "12345678-1-42", "adószám")]),
    ([("rendszam", "ABC-123")], [], [None], [("#az1", "ABC-123", "rendszám")]),
)


def _held(spark, sf_dir):
    rows = inputs(spark, sf_dir, "n int", [(len(r[0]),) for r in HELD]).select("k", "case_no")
    hits = spark.createDataFrame([(i, no, *h) for i, r in enumerate(HELD) for no, h in enumerate(r[0])], "case_no int, no int, kind string, surface string")
    known = spark.createDataFrame([(i, e[0], "identifier", e[1], e[2]) for i, r in enumerate(HELD) for e in r[1]], "case_no int, id string, kind string, identifier_kind string, name string")
    return rows.join(F.broadcast(hits), "case_no"), rows.join(F.broadcast(known), "case_no")


@gold("identifier_entities", len(HELD), ["no INT", "entity_id VARCHAR"], [(i, no, e) for i, r in enumerate(HELD) for no, e in enumerate(r[2])])
def identifier_entities(spark, sf_dir):
    return shaping.matched_identifiers(*_held(spark, sf_dir), "k").select("k", "no", "entity_id")


@gold("identifier_parties", len(HELD), ["id VARCHAR", "name VARCHAR", "role VARCHAR"], [(i, *p) for i, r in enumerate(HELD) for p in r[3]])
def identifier_parties(spark, sf_dir):
    return shaping.found_identifiers(*_held(spark, sf_dir), "k", ["no"]).select("k", "id", "name", "role")


#: mentions (name, kind, score, at a sentence's head), rule parties, names kept, then (name, kind, role, gender, confidence, mentions, origin)
MODEL = (
    ([("Kovács János", "person", 0.9, False), ("Kovács Jánosnak", "person", 0.8, False), ("Kovácsnak", "person", 0.7, False)], [], [], [("Kovács János", "person", "egyéb", "N", 80, 3, "model")]),
    ([("Kovács János", "person", 0.9, False)], [("Kovács János", "person", "felperes", "M", 97)], [], [("Kovács János", "person", "felperes", "M", 100, 1, "both")]),
    ([("Nagy", "person", 0.95, True)], [("Tóth Mária", "person", "tanú", "F", 93)], [], [("Nagy", "person", "egyéb", "N", 30, 1, "model"), ("Tóth Mária", "person", "tanú", "F", 93, 0, "rule")]),
    ([("Szabó Péter", "person", 0.9, False), ("Szegedi Törvényszék", "org", 0.9, False)], [], ["Szegedi Törvényszék"], [("Szabó Péter", "person", "egyéb", "N", 90, 1, "model")]),
    ([("Kiss Anna", "person", 0.5, False), ("Kiss Béla", "person", 0.5, False), ("Kiss Béla", "person", 0.5, False), ("Kissnek", "person", 0.5, False), ("Gránit Kft.", "org", 0.75, False), ("X-1", "other", 0.9, False)], [], [], [("Kiss Anna", "person", "egyéb", "N", 50, 1, "model"), ("Kiss Béla", "person", "egyéb", "N", 50, 3, "model"), ("Gránit Kft.", "org", "szervezet", "N", 75, 1, "model")]),
    ([("Kovács Jánosné", "person", 0.5, False), ("Kovács János", "person", 0.5, False)], [], [], [("Kovács János", "person", "egyéb", "N", 50, 1, "model"), ("Kovács Jánosné", "person", "egyéb", "N", 50, 1, "model")]),
)


@gold("model_merge", len(MODEL), ["name VARCHAR", "kind VARCHAR", "role VARCHAR", "gender VARCHAR", "confidence INT", "mentions BIGINT", "origin VARCHAR", "no INT"], [(i, *p, 1 + sorted(r[3], key=lambda x: (-x[5], -x[4], x[0])).index(p)) for i, r in enumerate(MODEL) for p in r[3]])
def model_merge(spark, sf_dir):
    rows = inputs(spark, sf_dir, "n int", [(len(r[0]),) for r in MODEL]).select("k", "case_no")
    each = lambda at, columns: rows.join(F.broadcast(spark.createDataFrame([(i, *(m if isinstance(m, tuple) else (m,))) for i, r in enumerate(MODEL) for m in r[at]], f"case_no int, {columns}")), "case_no").drop("case_no")
    found = merging.merge(each(0, "name string, kind string, score double, initial boolean"), each(1, "name string, kind string, role string, gender string, confidence int"), each(2, "name string"), "k", ["nagy"])
    return merging.ranked(found, "k")


@gold("model_dropped", len(MODEL), ["raw_label VARCHAR", "n BIGINT"], [(4, "KOD", 1)])
def model_dropped(spark, sf_dir):
    rows = inputs(spark, sf_dir, "n int", [(len(r[0]),) for r in MODEL]).select("k", "case_no")
    mentions = spark.createDataFrame([(i, m[1], "KOD" if m[1] == "other" else "PER") for i, r in enumerate(MODEL) for m in r[0]], "case_no int, kind string, raw_label string")
    return merging.dropped(rows.join(F.broadcast(mentions), "case_no"), "k")


#: text, then (warning, n) at a shift of thirty days
WARNED = (
    ("Kelt 2026. június 24. napján, hétfőn.", [("shifted", 1), ("weekday", 1)]),
    ("Csak 2025 februárjában és június 3-án, 2019 óta.", [("shifted", 3), ("unchanged", 1), ("coarse", 2), ("inherited", 1), ("review", 1)]),
    ("Május 5-én kelt.", [("shifted", 1), ("no_year", 1)]),
    ("Nincs benne.", []),
)


@gold("date_warnings", len(WARNED), ["warning VARCHAR", "n BIGINT"], [(i, *w) for i, r in enumerate(WARNED) for w in r[1]])
def date_warnings(spark, sf_dir):
    units = inputs(spark, sf_dir, "text string", [r[:1] for r in WARNED])
    return dates.warnings(dates.scan(units, ["k"], days=30), units, ["k"], 30)


#: (address, rewritten)
ADDRESSES = (
    ("kovacs.janos@aranykalasz.hu", "granit.otto@tuzko.hu"), ("kovacs58@freemail.hu", "granit58@freemail.hu"), ("www.aranykalasz.hu", "www.tuzko.hu"), ("senki@x.hu", None),
)
FRAGMENTS = (("kovacs", "Gránit"), ("janos", "Ottó"), ("aranykalasz", "Tűzkő"))


@gold("rewritten_addresses", len(ADDRESSES), ["surface VARCHAR", "replacement VARCHAR"], [(i, *r) for i, r in enumerate(ADDRESSES)])
def rewritten_addresses(spark, sf_dir):
    hits = inputs(spark, sf_dir, "surface string", [r[:1] for r in ADDRESSES]).withColumn("case_id", F.pmod("k", F.lit(16)))
    cases = hits.select("case_id").distinct().join(F.broadcast(spark.createDataFrame(list(FRAGMENTS), "fragment string, replacement string")))
    return names.rewrite_addresses(hits, cases, "case_id").select("k", "surface", "replacement")
