"""Queries over planned amounts: what a plan breaks, merges or leaves as it was, and its edits in texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import amounts
from spanloom.plans.carrier import claims, claims_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


#: Each order claims a debt, a fee and their sum; every fourth in euros, which are rounded to quarters, others to thousands.
BILLS = ("o_custkey AS case_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'EUR' ELSE 'HUF' END AS currency", "CAST(floor(o_totalprice / 10) AS DOUBLE) AS a", "CAST((o_orderkey % 20 + 1) * 1000 AS DOUBLE) AS b")
_NEW = "floor(value * 0.9 / step + 0.5) * step"
_STEP = "CASE WHEN currency = 'EUR' THEN CAST(0.25 AS DOUBLE) ELSE CAST(1000 AS DOUBLE) END"


def bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(plan, relations)."""
    relations = table(spark, sf_dir, "orders").selectExpr(*BILLS).selectExpr("*", "a + b AS c")
    values = relations.select("case_id", "currency", F.explode(F.array("a", "b", "c")).alias("value")).distinct()
    return values.selectExpr("*", f"{_STEP} AS step").selectExpr("case_id", "currency", "value", f"{_NEW.replace('0.9', 'CAST(0.9 AS DOUBLE)')} AS new_value"), relations.where("a <> b").distinct()


_n = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.6f', {x}), '0') END"
_said = lambda kind, *parts: " || ".join(f"'{text}'" + (f" || {part}" if part else "") for text, part in zip(amounts.WARNINGS[kind].split("%s"), (*parts, None), strict=True))
_PLAN = f"""r AS (SELECT DISTINCT *, a + b AS c FROM (SELECT {', '.join(BILLS)} FROM orders)),
p AS (SELECT *, {_NEW.replace('0.9', 'CAST(0.9 AS DOUBLE)')} AS new_value FROM (SELECT *, {_STEP} AS step FROM (SELECT case_id, currency, a AS value FROM r UNION SELECT case_id, currency, b FROM r UNION SELECT case_id, currency, c FROM r)))"""
_BILLED = f"""o AS (SELECT r.*, x.new_value AS new_a, y.new_value AS new_b, z.new_value AS new_c FROM r
  JOIN p x ON x.case_id = r.case_id AND x.currency = r.currency AND x.value = a JOIN p y ON y.case_id = r.case_id AND y.currency = r.currency AND y.value = b
  JOIN p z ON z.case_id = r.case_id AND z.currency = r.currency AND z.value = c WHERE a <> b),
m AS (SELECT case_id, currency, new_value, list_sort(list(value)) AS old FROM p GROUP BY ALL HAVING count(*) > 1)"""


@query(f"""WITH {_PLAN}, {_BILLED}
SELECT case_id, 'broken' AS kind, currency, c AS value, {_said("broken", _n("a"), _n("b"), _n("c"), "currency", _n("new_a"), _n("new_b"), _n("(new_a + new_b)"), _n("new_c"))} AS message FROM o WHERE new_a + new_b <> new_c
UNION SELECT case_id, 'merged', currency, new_value, {_said("merged", f"array_to_string([{_n('x')} for x in old], ' és ')", _n("new_value"))} FROM m
UNION SELECT case_id, 'unchanged', currency, value, {_said("unchanged", _n("value"), "currency")} FROM p WHERE value = new_value AND value < 10000
UNION SELECT p.case_id, 'unspellable', p.currency, p.value, {_said("unspellable", "('szó ' || " + _n("p.value") + ")", _n("p.new_value"))} FROM p JOIN r ON r.case_id = p.case_id AND r.currency = p.currency AND r.a = p.value WHERE p.new_value <> floor(p.new_value)""")
def amount_plan_warnings(spark, sf_dir):
    plan, relations = bills(spark, sf_dir)
    spelled = table(spark, sf_dir, "orders").selectExpr(*BILLS).select("case_id", "currency", F.col("a").alias("value"), F.concat(F.lit("szó "), amounts.number_text(F.col("a"))).alias("words"))
    return amounts.plan_warnings(plan, relations, "case_id", here=plan.where("value < 10000"), spelled=spelled)


@query(f"WITH {_PLAN}, {_BILLED} SELECT case_id, currency, a, b, c, new_a, new_b, new_c, new_a + new_b = new_c AS kept FROM o")
def amount_plan_relations(spark, sf_dir):
    return amounts.relation_report(*bills(spark, sf_dir), "case_id")


@query(f"""WITH {claims_sql()}, n AS (SELECT *, CAST(floor(CAST(amount AS DOUBLE) * CAST(0.9 AS DOUBLE) / 1000 + 0.5) * 1000 AS BIGINT) AS new_value, strpos(text, grouped || ' Ft') - 1 AS place FROM claims)
SELECT k, CAST(place AS INT) AS edit_start, CAST(place + length(grouped) AS INT) AS edit_end, CASE WHEN contains(grouped, ' ') THEN replace(format('{{:,}}', new_value), ',', ' ') ELSE CAST(new_value AS VARCHAR) END AS replacement FROM n""")
def amount_plan_edits(spark, sf_dir):
    found = amounts.scan(claims(spark, sf_dir), ["case_id", "k"])
    plan = found.select("case_id", "currency", "value").distinct().withColumn("new_value", amounts.round_to(F.col("value") * F.lit(0.9), F.lit(1000.0)))
    return amounts.plan_edits(found, plan, "case_id").select("k", "edit_start", "edit_end", "replacement")
