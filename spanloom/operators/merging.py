"""A model's mentions clustered, merged by the language's own inflection, and joined with what the structure of texts says.

Everything is joins within documents on forms of names: paradigms are a dimension of the distinct names, built once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.hungarian import paradigms

#: Hundredths that a rule's agreement adds, and the most that a capitalised adjective gets.
AGREED, TRAP = 3, 30


def dropped(mentions: DataFrame, by: str) -> DataFrame:
    """(by, raw_label, n): mentions that no kind of entity stands for."""
    return mentions.where("kind = 'other'").groupBy(by, "raw_label").agg(F.count("*").alias("n"))


def clusters(mentions: DataFrame, by: str) -> DataFrame:
    """(by, kind, name, key, mentions, score, forms, single, initial) from mentions (name, kind, score, initial).

    Persons, organisations and places only. The usual form is the longest in words, then the shortest, then the commonest.
    ``single`` and ``initial`` say that all mentions are one word, or begin a sentence.
    """
    named = mentions.where(F.col("kind").isin("person", "org", "place")).withColumn("key", T.cluster_key(F.col("name"), F.col("kind") == "person"))
    forms = named.groupBy(by, "kind", "key", "name").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.bool_and("initial").alias("initial"))
    words = F.size(T.split_words(F.col("name")))
    usual = F.struct(words.alias("w"), (-F.length("name")).alias("l"), F.col("n"), F.col("name").alias("t"))
    return forms.groupBy(by, "kind", "key").agg(F.max_by("name", usual).alias("name"), F.sum("n").alias("mentions"), F.sum("s").alias("score"), F.collect_set(F.lower("name")).alias("forms"), (F.max(words) == 1).alias("single"), F.bool_and("initial").alias("initial"))


def _into_hosts(found: DataFrame, hosts: DataFrame, by: str) -> DataFrame:
    """Clusters with those named in ``hosts`` (by, name, host) added to their host."""
    moved = found.join(hosts, [by, "name"], "left").withColumn("_to", F.coalesce("host", "name"))
    own = F.col("host").isNull()
    added = moved.groupBy(by, "kind", F.col("_to").alias("name")).agg(
        F.max(F.when(own, F.col("key"))).alias("key"), F.sum("mentions").alias("mentions"), F.sum("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"), F.bool_and("single").alias("single"), F.bool_and("initial").alias("initial")
    )
    return added.select(by, "kind", "name", "key", "mentions", "score", "forms", "single", "initial")


def merge_forms(found: DataFrame, by: str) -> DataFrame:
    """Person clusters whose name is a case form of a shorter one's go into it; a wife's name is another person's.

    A name that has a host is no host itself; of several the shortest counts.
    """
    persons = found.where("kind = 'person'").select(by, "name")
    forms = paradigms(persons).where("case <> 'WIFE'").select(F.col("name").alias("host"), T.normalise_name(F.col("form")).alias("form")).distinct()
    said = persons.join(forms, F.col("name") == F.col("host")).select(by, "host", "form")
    pairs = persons.withColumn("form", T.normalise_name(F.col("name"))).join(said, [by, "form"]).where(F.struct(F.length("host"), "host") < F.struct(F.length("name"), "name")).select(by, "name", "host")
    free = pairs.join(pairs.select(by, F.col("name").alias("host")).distinct(), [by, "host"], "left_anti")
    hosts = free.groupBy(by, "name").agg(F.min(F.struct(F.length("host"), "host"))["host"].alias("host"))
    return _into_hosts(found, hosts, by)


def attach_surnames(found: DataFrame, by: str) -> DataFrame:
    """One-word person clusters go into the full name whose surname they inflect, the commonest of several; not if full names of different surnames could be meant."""
    persons = found.where("kind = 'person'")
    bare = F.trim(F.regexp_replace("name", T.TITLE_RUN, ""))
    full = persons.where(F.instr("key", " ") > 0).select(by, F.col("name").alias("host"), "mentions", F.get(T.split_words(bare), F.lit(0)).alias("surname")).where(F.length("surname") >= 3)
    forms = paradigms(full.select(F.col("surname").alias("name"))).select(F.col("name").alias("surname"), F.lower("form").alias("form"))
    forms = forms.union(full.select("surname", F.lower("surname"))).distinct()
    single = persons.where(F.instr("key", " ") == 0).select(by, "name", F.size("forms").alias("of"), F.explode("forms").alias("form"))
    met = single.join(full.join(forms, "surname"), [by, "form"]).groupBy(by, "name", "of", "host", "mentions", "surname").agg(F.count_distinct("form").alias("n")).where("n = of")
    best = met.groupBy(by, "name").agg(F.count_distinct(F.lower("surname")).alias("surnames"), F.min(F.struct((-F.col("mentions")).alias("m"), "host"))["host"].alias("host")).where("surnames = 1")
    return _into_hosts(found, best.select(by, "name", "host"), by)


def merge(mentions: DataFrame, parties: DataFrame, keep: DataFrame, by: str, homonyms: list[str] | None = None) -> DataFrame:
    """(by, name, kind, role, gender, confidence, mentions, origin): the parties that model and structure find together.

    ``parties`` has (name, kind, role, gender, confidence), ``keep`` (name) of those who stay named. A rule that agrees raises
    the confidence and lends role and gender; a lone word that is a common noun, always at a sentence's head and known to no
    rule gets ``TRAP`` at most. Parties that only the structure finds are added.
    """
    found = attach_surnames(merge_forms(clusters(mentions, by), by), by)
    kept = keep.select(by, F.explode(F.array(T.normalise_name(F.col("name")), T.cluster_key(F.col("name"), F.lit(True)), T.cluster_key(F.col("name"), F.lit(False)))).alias("_name")).distinct()
    named = found.withColumn("_name", T.normalise_name(F.col("name")))
    named = named.join(kept, [by, "_name"], "left_anti").join(kept.withColumnRenamed("_name", "key"), [by, "key"], "left_anti")
    rules = parties.withColumn("_name", T.normalise_name(F.col("name"))).groupBy(by, "_name").agg(*(F.max_by(c, F.col("confidence")).alias(f"r_{c}") for c in ("name", "kind", "role", "gender", "confidence")))
    joined = named.join(rules, [by, "_name"], "left")
    average = (F.col("score") / F.col("mentions") * 100).cast("int")
    trap = (F.col("kind") == "person") & F.col("single") & F.col("initial") & F.lower("name").isin(*(homonyms or [""]))
    confidence = F.when(F.col("r_name").isNotNull(), F.least(F.lit(100), F.greatest(average, F.col("r_confidence")) + AGREED)).when(trap, F.least(average, F.lit(TRAP))).otherwise(average)
    role = F.coalesce("r_role", F.when(F.col("kind") == "org", "szervezet").otherwise("egyéb"))
    both = joined.select(by, "_name", "name", "kind", role.alias("role"), F.coalesce("r_gender", F.lit("N")).alias("gender"), confidence.alias("confidence"), F.col("mentions").cast("long").alias("mentions"), F.when(F.col("r_name").isNotNull(), "both").otherwise("model").alias("origin"))
    alone = rules.join(both.where("origin = 'both'").select(by, "_name"), [by, "_name"], "left_anti").join(kept, [by, "_name"], "left_anti")
    added = alone.select(by, "_name", F.col("r_name").alias("name"), F.col("r_kind").alias("kind"), F.col("r_role").alias("role"), F.col("r_gender").alias("gender"), F.col("r_confidence").alias("confidence"), F.lit(0).cast("long").alias("mentions"), F.lit("rule").alias("origin"))
    return both.unionByName(added).drop("_name")


def ranked(parties: DataFrame, by: str, officials: DataFrame | None = None) -> DataFrame:
    """Parties in order (``no``): the commonest first, then the surest. Officials (name, why) come in as parties only if they are given."""
    rows = parties if officials is None else parties.unionByName(officials.select(by, "name", F.lit("person").alias("kind"), F.col("why").alias("role"), F.lit("N").alias("gender"), F.lit(100).alias("confidence"), F.lit(0).cast("long").alias("mentions"), F.lit("official").alias("origin")))
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mentions"), F.desc("confidence"), "name")))
