"""Stable replacement names: keyed picks from a theme's ordered pools, one case at a time.

Picks depend on what a case has used before, so each case is one group of ``applyInPandas``; it holds a few dozen entities.
Assignments of an earlier run are kept as long as the entity's name and kind are unchanged.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.hungarian import harmony, inflect, inflect_name, number_words
from spanloom.functions.keyed import index_of
from spanloom.operators.names import Entity, company_form, strip_company_form

#: Endings that hide a common root, and places for a theme without any.
_DERIVED = re.compile("(os|es|ös|ás|és|i|ó|ő|s|a|e)$")
SPARE_PLACES = ("Kavicsfalva", "Kőhalom", "Sziklakövesd")


@lru_cache(1 << 16)
def root(word: str) -> str:
    """Each pick compares all names of a pool with all used ones: they recur."""
    return _DERIVED.sub("", word.lower())


def same_root(a: str, b: str) -> bool:
    short, long = sorted((root(a), root(b)), key=len)
    return bool(short) and long.startswith(short) and len(long) - len(short) <= 2


class Registry:
    """A case's used names and its picks. Surnames and organisations share one set of used words; places have their own.

    ``by_appearance`` holds for the entity that is picked for: names then come from the head of the pool."""

    def __init__(self, theme: dict, secret: str, by_appearance: bool = False):
        self.theme, self.secret, self.by_appearance = theme, secret, by_appearance
        self.words: set[str] = set()
        self.given: set[str] = set()
        self.places: set[str] = set()

    def pick(self, pool: list[str], used: set[str], key: str) -> str:
        """A free name whose root no used name shares; the keyed one, or the first where appearance sets the order. An exhausted pool numbers its names."""
        fresh = [p for p in pool if not any(same_root(u, p) for u in used)] or pool
        free = [p for p in fresh if p.lower() not in used]
        if free:
            name = free[0] if self.by_appearance else free[index_of(self.secret, key, len(free))]
        else:
            base = fresh[0] if self.by_appearance else fresh[index_of(self.secret, key, len(fresh))]
            n = 2
            while f"{base} {n}".lower() in used:
                n += 1
            name = f"{base} {n}"
        used.add(name.lower())
        return name

    def probe(self, pool: list[str], used: set[str], key: str) -> str:
        """From the keyed place on, the first free name; the keyed one again if all are used."""
        at = 0 if self.by_appearance else index_of(self.secret, key, len(pool))
        name = next((p for i in range(len(pool)) if (p := pool[(at + i) % len(pool)]).lower() not in used), pool[at])
        used.add(name.lower())
        return name

    def reserve(self, kind: str, shown: str, surname: str = "", given: str = "") -> None:
        """Take a name out of the pools; a person's two parts are told apart at the first blank if they are not given."""
        parts = shown.split()
        if kind == "place":
            self.places.add(shown.lower())
        elif kind == "person" and parts:
            self.words.add((surname or parts[0]).lower())
            self.given.add((given or " ".join(parts[1:])).lower())
        elif parts:
            self.words.add((strip_company_form(shown).split() or parts)[0].lower())

    def exceptions(self, pool: str, form: str) -> dict:
        """What a theme says of how a name bends; a numbered name takes its endings behind a hyphen, as the number is read."""
        if number := re.search(" ([0-9]+)$", form):
            return {"hyphenate": True, "harmony": harmony(number_words(int(number[1])))}
        entry = next((n for n in self.theme[pool] if n["form"] == form), {})
        return {**(entry.get("overrides") or {}), **({"harmony": entry["harmony"]} if entry.get("harmony") else {})}

    def person(self, e: Entity, husband: dict | None) -> dict:
        surname = husband["surname"] if husband else self.pick([s["form"] for s in self.theme["surnames"]], self.words, f"{e.surname}|surname")
        names = [g for g in self.theme["given_names"] if e.gender == "N" or g.get("gender", "N") in (e.gender, "N")] or self.theme["given_names"]
        apart = [g["form"] for g in names if not same_root(surname, g["form"])] or [g["form"] for g in self.theme["given_names"]]
        given = self.pick(apart, self.given, f"{e.surname} {e.given}|given")
        out = {"surname": surname, "given": given, "wife_of": "", "maiden": "", "shown": f"{surname} {given}"}
        said = husband.get("overrides", {}) if husband else {}
        out["overrides"] = {"surname": said.get("surname", {}) if husband else self.exceptions("surnames", surname), "given": self.exceptions("given_names", given), "husband": said.get("given", {})}
        if e.wife_of:
            out["wife_of"] = f"{husband['surname']} {husband['given']}" if husband else out["shown"]
            out["shown"] = inflect_name(out["wife_of"], "WIFE")
            if e.maiden:
                out["maiden"] = self.pick([s["form"] for s in self.theme["surnames"]], self.words, f"{e.maiden}|maiden")
                out["shown"] = f"{inflect(surname, 'WIFE')} {out['maiden']} {given}"
                out["overrides"]["maiden"] = self.exceptions("surnames", out["maiden"])
        return out

    def organisation(self, e: Entity) -> dict:
        pool = self.theme.get("org_parts") or [s["form"] for s in self.theme["surnames"]]
        first = self.probe(pool, self.words, f"{e.name}|org")
        shown = " ".join([first, *strip_company_form(e.name).split()[1:], *company_form(e.name).split()])
        return {"shown": shown, "abbreviation": "".join(w[0].upper() for w in strip_company_form(shown).split()) if e.abbreviation else ""}

    def place(self, e: Entity) -> dict:
        pool = [p["form"] for p in self.theme.get("place_names") or ()] or [*SPARE_PLACES]
        shown = self.probe(pool, self.places, f"{e.name}|place")
        entry = next((p for p in self.theme.get("place_names") or () if p["form"] == shown), {})
        return {"shown": shown, "locative": entry.get("locative") or "sup", "overrides": {"place": entry.get("overrides") or {}}}


def original(e: Entity) -> str:
    return f"{e.surname} {e.given}".strip() if e.kind == "person" else e.name


def assign_case(entities: list[Entity], theme: dict, secret: str, kept: dict[str, tuple[str, ...]] | None = None, by_appearance: bool = False, ranked: set[str] | None = None) -> dict[str, dict]:
    """Entity id -> its replacement. Husbands come before wives, then organisations and places.

    ``kept``: id -> (kind, original, replacement[, surname, given]) of the run before; it stays while kind and original are the
    same, and the names of those that are not among the entities stay taken. ``ranked``: ids whose names come from the head of
    the pools in the entities' order, by default all or none.
    """
    registry, out = Registry(theme, secret), {}
    listed = {e.id for e in entities}
    for i, old in (kept or {}).items():
        if i not in listed:
            registry.reserve(old[0], *old[2:])
    for e in entities:
        if (old := (kept or {}).get(e.id)) and tuple(old[:2]) == (e.kind, original(e)):
            shown, *parts = old[2:]
            surname, given = parts if parts else (shown.partition(" ")[0], shown.partition(" ")[2])
            out[e.id] = {"shown": shown, "surname": surname, "given": given, "sticky": True}
            registry.reserve(e.kind, shown, surname, given)
    husbands = {original(e): e.id for e in entities if e.kind == "person" and not e.wife_of}
    for e in sorted((e for e in entities if e.id not in out), key=lambda e: (e.kind != "person", bool(e.wife_of))):
        registry.by_appearance = by_appearance if ranked is None else e.id in ranked
        if e.kind == "person":
            out[e.id] = registry.person(e, out.get(husbands.get(e.wife_of, "")))
        elif e.kind == "org":
            out[e.id] = registry.organisation(e)
        else:
            out[e.id] = registry.place(e)
    return out


def apart(e: Entity, made: dict) -> tuple[str, str, str, str]:
    """Surname, given name, husband and maiden name of a person's new name; a kept wife's are read from what was shown."""
    if not (made.get("sticky") and e.wife_of):
        return made["surname"], made["given"], made.get("wife_of", ""), made.get("maiden", "")
    if e.maiden:
        first, *maiden, given = made["shown"].split()
        return re.sub("né$", "", first), given, re.sub("né$", "", first), " ".join(maiden)
    husband = re.sub("né$", "", made["shown"])
    surname, _, given = husband.partition(" ")
    return surname, given, husband, ""


#: A new name as an entity (what its forms are made of), the old one's parts, and its place among its case's.
REPLACEMENT = (
    "id string, no int, kind string, name string, surname string, given string, wife_of string, maiden string, abbreviation string, overrides string, locative string, "
    "original string, replacement string, sticky boolean, was struct<name:string,surname:string,given:string,maiden:string>"
)


def replacements(entities: DataFrame, case: str, theme: dict, secret: str, order: str = "no", kept: DataFrame | None = None, by_appearance: bool = False) -> DataFrame:
    """(case, REPLACEMENT): one row for each entity; ``order`` is the order of appearance. ``overrides`` is JSON: what the theme says of how each part of a name bends."""
    kind = entities.schema[case].dataType.simpleString()
    columns = ["id", "kind", "name", "surname", "given", "gender", "wife_of", "maiden", "abbreviation"]
    rows = entities.select(case, F.col(order).alias("_order"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in entities.columns else F.lit("").alias(c) for c in columns))
    if kept is not None:
        rows = rows.join(kept.select(case, F.col("entity_id").alias("id"), F.col("kind").alias("_kind"), F.col("original").alias("_original"), F.col("replacement").alias("_kept")), [case, "id"], "left")
    else:
        rows = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("_kind", "_original", "_kept")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_order", kind="stable")
        found = [Entity(**{c: r[c] for c in columns}) for r in group.to_dict("records")]
        old = {r["id"]: (r["_kind"], r["_original"], r["_kept"]) for r in group.to_dict("records") if isinstance(r["_kept"], str)}
        made = assign_case(found, theme, secret, old, by_appearance)
        place = {i: n for n, i in enumerate(made)}
        named = []
        for e in found:
            m = made[e.id]
            parts = ("", *apart(e, m)) if e.kind == "person" else (m["shown"], "", "", "", "")
            was = {"name": e.name, "surname": e.surname, "given": e.given, "maiden": e.maiden}
            named.append((group[case].iloc[0], e.id, place[e.id], e.kind, *parts, m.get("abbreviation", ""), json.dumps({part: o for part, o in m.get("overrides", {}).items() if o}), m.get("locative", "sup"), original(e), m["shown"], bool(m.get("sticky")), was))
        return pd.DataFrame(named, columns=[case, *(c.split()[0] for c in REPLACEMENT.split(", "))])

    return rows.groupBy(case).applyInPandas(run, f"`{case}` {kind}, {REPLACEMENT}")


def assign(entities: DataFrame, case: str, theme: dict, secret: str, order: str = "no", kept: DataFrame | None = None, by_appearance: bool = False) -> DataFrame:
    """(case, entity_id, original, replacement, sticky): one row for each entity; ``order`` is the order of appearance."""
    return replacements(entities, case, theme, secret, order, kept, by_appearance).select(case, F.col("id").alias("entity_id"), "original", "replacement", "sticky")


def appearance_order(hits: DataFrame, by: list[str], unit: str, entity: str = "entity_id") -> DataFrame:
    """(*by, entity, no): entities numbered by their first hit that is not rejected."""
    first = hits.where("disposition <> 'reject'").groupBy(*by, entity).agg(F.min(F.struct(unit, "start")).alias("_first"))
    return first.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("_first", entity))).drop("_first")


def numbering(entities: DataFrame, case: str, order: str, kind: str = "kind") -> DataFrame:
    """Entities with their number within their kind, in input order."""
    return entities.withColumn("number", F.row_number().over(Window.partitionBy(case, kind).orderBy(order)))
