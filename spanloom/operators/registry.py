"""A case's registry of replacement names: it lasts over the documents of a case and over runs.

A case has one key, the digest of its secret and its theme. As long as the key stays, a run adds names for new entities and
keeps all earlier ones; if it changes, old names would mislead and the case starts anew. All documents of a case share the
order in which its first document names the entities: those come to the head of the theme's lists in that order, entities
that only later documents name are drawn by key, alike in every run.

The state is a table of versions. A version holds whole cases, and only those that its run touched; a case's state is its rows
in the latest version that has it. A version is written aside and appears by one rename, so a run that fails or is repeated
leaves nothing half-done. The secret itself is never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.operators.assign import assign_case, original
from spanloom.operators.names import Entity
from spanloom.sources.staged import Staged

#: What of an entity decides about its name.
COLUMNS = ["id", "kind", "name", "surname", "given", "gender", "wife_of", "maiden", "abbreviation"]
ROW = "key string, entity_id string, kind string, original string, replacement string, surname string, given string, since long"


def case_key(secret: Column, theme: Column) -> Column:
    return F.sha2(F.concat_ws("\0", secret, theme), 256)


def first_document_order(hits: DataFrame, documents: DataFrame, case: str = "case_id", document: str = "document_no", place: tuple[str, ...] = ("unit_no", "start"), entity: str = "entity_id") -> DataFrame:
    """(case, entity_id, place): entities numbered by their first hit, not rejected, in the case's first document.

    ``documents`` (case, document) has documents without hits, too: where the first one is such, nobody has a place.
    """
    first = documents.groupBy(case).agg(F.min(document).alias(document))
    at = hits.join(first, [case, document], "left_semi").where("disposition <> 'reject'").groupBy(case, entity).agg(F.min(F.struct(*place)).alias("_at"))
    return at.select(case, F.col(entity).alias("entity_id"), F.row_number().over(Window.partitionBy(case).orderBy("_at", entity)).alias("place"))


def advance(entities: DataFrame, cases: DataFrame, themes: dict[str, dict], version: int, state: DataFrame | None = None, order: DataFrame | None = None, case: str = "case_id", listed: str = "no") -> DataFrame:
    """(case, ROW): the next version's rows of all cases in ``cases`` (case, secret, theme_id); ``since`` is the version that gave a name.

    ``entities``: (case, id, kind, ...) in the order ``listed``; repeated ids count once, null ids and cases without a secret not
    at all. ``state``: the rows so far (``Store.state``). Names of entities that are not listed any more stay, and stay taken.
    A case is one row: its cast, some dozens of entities, not its documents. So cases share Arrow batches.
    """
    kind = cases.schema[case].dataType.simpleString()
    keyed = cases.where("secret IS NOT NULL AND theme_id IS NOT NULL").select(case, "secret", "theme_id", case_key(F.col("secret"), F.col("theme_id")).alias("key"))
    named = entities.where("id IS NOT NULL").select(case, F.col(listed).cast("long").alias("_listed"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in entities.columns else F.lit("").alias(c) for c in COLUMNS))
    named = named.groupBy(case, "id").agg(F.min(F.struct("_listed", *COLUMNS[1:])).alias("e")).select(case, "id", "e.*")
    if order is None:
        placed = named.withColumn("_place", F.lit(None).cast("long"))
    else:
        placed = named.join(order.select(case, F.col("entity_id").alias("id"), F.col("place").cast("long").alias("_place")), [case, "id"], "left")
    new = placed.join(keyed, case).select(case, "key", "secret", "theme_id", F.struct("_place", "_listed", *COLUMNS).alias("new"), F.lit(None).cast("struct<entity_id:string,kind:string,original:string,replacement:string,surname:string,given:string,since:bigint>").alias("old"))
    rows = new
    if state is not None:
        old = state.join(keyed, [case, "key"])
        rows = new.unionByName(old.select(case, "key", "secret", "theme_id", F.lit(None).cast(new.schema["new"].dataType).alias("new"), F.struct("entity_id", "kind", "original", "replacement", "surname", "given", "since").alias("old")))

    def made(of, records: list[dict]) -> Iterator[tuple]:
        key, theme = records[0]["key"], themes[records[0]["theme_id"]]
        kept = {o["entity_id"]: o for r in records if (o := r["old"]) is not None}
        fresh = [r["new"] for r in records if r["new"] is not None]
        late = float("inf")
        fresh.sort(key=lambda n: (late if n["_place"] is None else n["_place"], late if n["_listed"] is None else n["_listed"], n["id"]))
        found = [Entity(**{c: n[c] for c in COLUMNS}) for n in fresh]
        known = {i: (o["kind"], o["original"], o["replacement"], o["surname"], o["given"]) for i, o in kept.items()}
        names = assign_case(found, theme, records[0]["secret"], known, ranked={n["id"] for n in fresh if n["_place"] is not None})
        out = {i: (of, key, i, o["kind"], o["original"], o["replacement"], o["surname"], o["given"], int(o["since"])) for i, o in kept.items()}
        for e in found:
            m = names[e.id]
            since = int(kept[e.id]["since"]) if m.get("sticky") else version
            out[e.id] = (of, key, e.id, e.kind, original(e), m["shown"], m.get("surname", ""), m.get("given", ""), since)
        yield from out.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.column(0).type, *[pa.string()] * 7, pa.int64()]
            yield from batched((r for row in each([batch]) for r in made(*row)), [case, "key", "entity_id", "kind", "original", "replacement", "surname", "given", "since"], types)

    # A number that is said outright keeps small shuffles in many tasks: names cost far more than their bytes tell.
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    casts = rows.repartition(tasks, case).groupBy(case).agg(F.collect_list(F.struct("key", "secret", "theme_id", "new", "old")).alias("cast"))
    return casts.mapInArrow(run, f"`{case}` {kind}, {ROW}")


class Store:
    """Versions of a registry in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, case: str = "case_id"):
        self.spark, self.folders, self.case = spark, Staged(spark, path, "version"), case

    def versions(self) -> list[int]:
        return self.folders.numbers()

    def state(self, as_of: int | None = None) -> DataFrame | None:
        """Each case's rows in its latest version (up to ``as_of``); none if there is no version."""
        chosen = [v for v in self.versions() if as_of is None or v <= as_of]
        if not chosen:
            return None
        rows = self.spark.read.option("basePath", self.folders.root).parquet(*map(self.folders.path, chosen))
        latest = rows.groupBy(self.case).agg(F.max("version").alias("version"))
        return rows.join(latest, [self.case, "version"]).drop("version")

    def commit(self, rows: DataFrame, version: int) -> bool:
        """Write a version; false, with nothing changed, if it is there already (a repeated run)."""
        return self.folders.commit(version, rows.write.parquet)


def follow(store: Store, cases: DataFrame, themes: dict[str, dict], case: str = "case_id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of entities: batch n becomes version n + 1, once, however often it is repeated."""

    def run(batch: DataFrame, n: int) -> None:
        if n + 1 in store.versions():
            return
        touched = cases.join(batch.select(case).distinct(), case, "left_semi")
        store.commit(advance(batch, touched, themes, n + 1, store.state(n), case=case), n + 1)

    return run
