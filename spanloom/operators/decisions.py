"""Decisions about hits, outcomes, and reports over them; Columns and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(disposition: Column, user: Column, of_class: Column, automatic: Column) -> Column:
    """``accept``, ``skip`` or null: the user's word, then the switch for the hit's kind, then automatic mode (doubtful in, unlikely out)."""
    by_program = F.when(automatic & (disposition == "review"), "accept").when(automatic & (disposition == "reject"), "skip")
    return F.coalesce(user, of_class, by_program)


def by_program(disposition: Column, user: Column, of_class: Column, automatic: Column) -> Column:
    return user.isNull() & of_class.isNull() & automatic & (disposition != "auto")


def accepted(decision: Column, disposition: Column) -> Column:
    return F.coalesce(decision == "accept", disposition == "auto")


def undecided(decision: Column, disposition: Column) -> Column:
    return decision.isNull() & (disposition != "auto")


def outcome(decision: Column, disposition: Column) -> Column:
    """``csere`` (replaced), ``bizonytalan`` (open) or ``nincs`` (left)."""
    return F.when(accepted(decision, disposition), "csere").when(decision.isNull() & (disposition == "review"), "bizonytalan").otherwise("nincs")


def with_outcomes(hits: DataFrame) -> DataFrame:
    """Hits (disposition, user_decision, class_decision, automatic) with decision, by_program and outcome."""
    cols = [F.col(c) for c in ("disposition", "user_decision", "class_decision", "automatic")]
    out = hits.withColumns({"decision": decide(*cols), "by_program": by_program(*cols)})
    return out.withColumn("outcome", outcome(F.col("decision"), F.col("disposition")))


def counts(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits of each disposition and outcome, one row a document."""
    sums = [F.count_if(F.col(c) == v).alias(f"n_{v}") for c, vs in (("disposition", ("auto", "review", "reject")), ("outcome", ("csere", "bizonytalan", "nincs"))) for v in vs]
    return hits.groupBy(*by).agg(*sums, F.count("*").alias("n_hits"))


def cast(hits: DataFrame, by: list[str], entity: str = "entity_id") -> DataFrame:
    """Each entity's occurrences and how many of them are open."""
    return hits.groupBy(*by, entity).agg(F.count("*").alias("occurrences"), F.count_if(undecided(F.col("decision"), F.col("disposition"))).alias("pending"))


def case_ids(hits: DataFrame, document_no: str, order: list[str]) -> DataFrame:
    """Hits numbered through a case: a million for each document before, then the place in the document."""
    place = F.row_number().over(Window.partitionBy(document_no).orderBy(*order))
    return hits.withColumn("match_id", F.col(document_no).cast("long") * 1_000_000 + place)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """The first ``k`` rows of each group (all of them, ranked, by default), with the group's whole size."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    total = F.count("*").over(Window.partitionBy(*by))
    whole = ranked.withColumn("total", total)
    return whole if k is None else whole.where(F.col("rank") <= k)


def audit(hits: DataFrame, by: list[str]) -> DataFrame:
    """Counts by kind and outcome with subtotals for each document."""
    return hits.rollup(*by, "kind", "outcome").agg(F.count("*").alias("n"))
