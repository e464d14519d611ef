"""Replacements for hits by a theme's names; joins on small dimensions. Labels are in ``labels``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hungarian import CASES, inflect_name
from spanloom.functions.text import fold, strip_company_form
from spanloom.operators.names import Entity, cores, rewrite_addresses

#: Cases that are rendered.
RENDERED = tuple(c for c in CASES if c not in ("TRANS", "FAM", "WIFE"))


#: A place's cases by how its new name is said: on it or in it.
ON_TO_IN = {"SUP": "INE", "SUB": "ILL", "DEL": "ELA"}
IN_TO_ON = {within: on for on, within in ON_TO_IN.items()}


#: The part of a name at a core's end, where it is not the given name.
END = {"reversed": "surname", "surname": "surname", "family": "surname", "maiden_surname": "maiden", "wife_full": "husband", "wife_surname": "surname", "place": "place"}


def bent(e: Entity, exceptions: dict[str, dict]) -> dict[str, Callable[[str], str]]:
    """Core -> (case -> form): each core bends with the exceptions of the part of the name at its end."""
    made = {part: {core: form for core, form, *_ in cores(replace(e, overrides=exceptions.get(part, {})))} for part in ("", *exceptions)}
    return {core: made.get(END.get(core, "given"), made[""])[core] for core in made[""]}


def core_table(entities: DataFrame, case: str) -> DataFrame:
    """(case, entity_id, core, case_tag, form): every core of each replacement entity (``assign.replacements``) in every rendered
    case; a place's cases are those that its ``locative`` asks for. A dimension as large as the cases' casts."""
    kind = entities.schema[case].dataType.simpleString()
    columns = ["id", "kind", "name", "surname", "given", "gender", "wife_of", "maiden", "abbreviation"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                e = Entity(**{c: r[c] for c in columns})
                said = (ON_TO_IN if r["locative"] == "ine" else IN_TO_ON) if e.kind == "place" else {}
                rows += [(r[case], e.id, core, c, form(said.get(c, c))) for core, form in bent(e, json.loads(r["overrides"] or "{}")).items() for c in RENDERED]
            yield pd.DataFrame(rows, columns=[case, "entity_id", "core", "case_tag", "form"])

    picked = entities.select(case, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in entities.columns else F.lit("").alias(c) for c in (*columns, "overrides", "locative")))
    return picked.mapInPandas(run, f"`{case}` {kind}, entity_id string, core string, case_tag string, form string")


def with_manual(replacements: DataFrame, manual: DataFrame, case: str) -> DataFrame:
    """Replacement entities with the names that a person wrote (case, entity_id, replacement): they bend like any other, without the theme's exceptions."""
    written = manual.select(case, F.col("entity_id").alias("id"), F.nullif(F.trim("replacement"), F.lit("")).alias("_manual"))
    rows = replacements.join(written, [case, "id"], "left")
    person, parts, ours = F.col("kind") == "person", F.split("_manual", r"\s+"), F.col("_manual").isNotNull()
    chosen = {
        "surname": F.when(ours & person, parts[0]),
        "given": F.when(ours & person, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")),
        "wife_of": F.when(ours & (F.col("wife_of") != ""), F.regexp_replace("_manual", "né$", "")),
        "name": F.when(ours & ~person, F.col("_manual")),
        "overrides": F.when(ours, F.lit("{}")),
        "replacement": F.col("_manual"),
    }
    return rows.withColumns({c: F.coalesce(new, F.col(c)) for c, new in chosen.items()}).select(*replacements.columns)


def fragments(replacements: DataFrame, case: str) -> DataFrame:
    """(case, fragment, no, replacement): words of three letters or more of an entity's old name, as addresses have them, and the first word of the same part of its new name."""
    stem = lambda c: F.when(F.col("kind") == "org", strip_company_form(F.col(c))).otherwise(F.col(c))
    pairs = [(stem("was.name"), stem("name")), *((F.col(f"was.{c}"), F.col(c)) for c in ("surname", "given", "maiden"))]
    part = F.explode(F.array(*(F.struct(old.alias("old"), F.split_part(F.trim(new), F.lit(" "), F.lit(1)).alias("replacement")) for old, new in pairs)))
    words = replacements.select(case, "no", part.alias("_part")).select(case, "no", "_part.replacement", F.explode(F.split(fold(F.col("_part.old")), r"\s+")).alias("fragment"))
    return words.where((F.length("fragment") >= 3) & (F.col("replacement") != "")).select(case, "fragment", "no", "replacement")


def render_theme(hits: DataFrame, replacements: DataFrame, case: str, manual: DataFrame | None = None) -> DataFrame:
    """Hits (``names.match``) with their replacement (``assign.replacements``): the same core in the same case, the title before it
    and the honorific behind it kept, all in capitals where the text has them so. Before an honorific, which takes the ending, a
    name is bare. A place is said on or in as its new name asks for; addresses get the case's new names for the old.

    ``manual`` (case, entity_id, replacement): names that a person wrote. Hits without a core (unknown suffixes) and cases that
    are matched but not rendered give none, so the gate sees them.
    """
    new = replacements if manual is None else with_manual(replacements, manual, case)
    tag = F.when(F.coalesce("tail", F.lit("")) != "", "NOM").otherwise(F.coalesce("case_tag", F.lit("NOM")))
    joined = hits.withColumn("_tag", tag).join(core_table(new, case).withColumnRenamed("case_tag", "_tag"), [case, "entity_id", "core", "_tag"], "left")
    name = F.concat(F.coalesce("prefix", F.lit("")), "form", F.coalesce("tail", F.lit("")))
    rows = rewrite_addresses(joined, fragments(new, case), case)
    return rows.withColumn("replacement", F.when(F.col("core") == "identifier", F.col("replacement")).otherwise(F.when(F.col("upper"), F.upper(name)).otherwise(name))).select(*hits.columns, "replacement")


def role_table(roles: list[str]) -> list[tuple[str, str, str]]:
    """(role, case, form): role words in all rendered cases."""
    return [(r, c, inflect_name(r, c)) for r in roles for c in RENDERED]
