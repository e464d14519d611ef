"""The library's queries over the driver's tables, each with SQL for a second engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import checksums, hungarian, keyed, text
from spanloom.operators import amounts, assign, dates, decisions, identifiers, names, ner, parties, render, spans, verify
from spanloom.plans import cases, golds_files, packages, rescaled, searches
from spanloom.plans.carrier import SPREAD, claims, claims_sql, digits, people, people_sql, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SECRET = "per-2024/17"
THEME = {
    "surnames": [{"form": f} for f in ("Gránit", "Bazalt", "Kavics", "Márvány", "Opál", "Jáspis", "Kvarc", "Agát", "Topáz", "Berill")],
    "given_names": [{"form": f, "gender": g} for f, g in (("Ottó", "M"), ("Frida", "F"), ("Alfréd", "M"), ("Zita", "F"), ("Edvin", "M"), ("Lenke", "F"))],
    "org_parts": ["Hegyi", "Völgyi", "Parti"], "place_names": [{"form": "Kővár"}, {"form": "Hegyalja"}],
}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def hmac_sql(message: str, secret: str = SECRET) -> str:
    inner, outer = keyed.pads(secret)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def number_sql(hexed: str) -> str:
    return f"CAST('0x' || substr({hexed}, 1, 12) AS BIGINT)"


def digit_sum(c: str, weights: list[int]) -> str:
    return digits(c, weights)


def block_sql(c: str) -> str:
    return f"(CAST(substr({c}, 8, 1) AS INT) + {digits(c, [9, 7, 3, 1, 9, 7, 3])}) % 10 = 0"


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that overlap, a few for each order; dealt out by order, so that what folds them has no more rows in a task on more data."""
    return spread(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "CAST(l_partkey * 7 % 60 AS INT) AS start", "CAST(l_partkey * 7 % 60 + 1 + l_quantity % 25 AS INT) AS `end`", "CAST(50 + l_linenumber AS INT) AS confidence", "l_returnflag AS label", "CAST(l_suppkey % 3 AS INT) AS priority"), "doc", 80 * SPREAD).distinct()


SPANS_SQL = "spans AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_partkey * 7 % 60 AS INT) AS s, CAST(l_partkey * 7 % 60 + 1 + l_quantity % 25 AS INT) AS e, CAST(50 + l_linenumber AS INT) AS confidence, l_returnflag AS label, CAST(l_suppkey % 3 AS INT) AS priority FROM lineitem)"


def fold_sql(order: str, columns: str) -> str:
    return f"""WITH RECURSIVE {SPANS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {order}) AS rn FROM spans),
f AS (SELECT doc, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s INT, e INT)[]) AS kept, CAST(NULL AS BIGINT) AS took FROM (SELECT DISTINCT doc FROM r)
 UNION ALL SELECT f.doc, r.rn, CASE WHEN len(list_filter(f.kept, lambda x: r.s < x.e AND x.s < r.e)) = 0 THEN list_append(f.kept, struct_pack(s := r.s, e := r.e)) ELSE f.kept END,
  CASE WHEN len(list_filter(f.kept, lambda x: r.s < x.e AND x.s < r.e)) = 0 THEN r.rn END FROM f JOIN r ON r.doc = f.doc AND r.rn = f.rn + 1)
SELECT {columns} FROM r JOIN f ON f.doc = r.doc AND f.took = r.rn"""


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split_regex(lower(translate(text, '{text.ACCENTED}', '{text.PLAIN}')), '[^a-z]+')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def accent_fold_terms(spark, sf_dir):
    words = F.explode(F.split(text.fold(F.col("text")), "[^a-z]+"))
    return table(spark, sf_dir, "documents").select(words.alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, token, CASE WHEN contains(token, '@') THEN 'email' ELSE 'url' END AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{identifiers.TOKEN_SQL}')) AS token FROM documents) GROUP BY ALL")
def email_tokens(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit(identifiers.TOKEN_SQL), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.contains("token", F.lit("@")), "email").otherwise("url"))


@query(f"WITH {people_sql()} SELECT k, tax_number, {block_sql('substr(tax_number, 1, 8)')} AS valid FROM people")
def tax_number_checksum(spark, sf_dir):
    return people(spark, sf_dir).select("k", "tax_number", checksums.block_ok(F.substring("tax_number", 1, 8)).alias("valid"))


@query(f"WITH {people_sql()} SELECT k, taj, ({digit_sum('taj', [3, 7, 3, 7, 3, 7, 3, 7, 9])}) % 10 = 0 AS valid FROM people")
def social_number_checksum(spark, sf_dir):
    return people(spark, sf_dir).select("k", "taj", checksums.social_ok(F.col("taj")).alias("valid"))


@query(f"WITH {people_sql()} SELECT k, tax_id, ({digit_sum('tax_id', [*range(1, 10)])}) % 11 = CAST(substr(tax_id, 10, 1) AS INT) AS valid FROM people")
def tax_id_checksum(spark, sf_dir):
    return people(spark, sf_dir).select("k", "tax_id", checksums.tax_id_ok(F.col("tax_id")).alias("valid"))


@query(f"WITH {people_sql()} SELECT k, account, {block_sql('substr(account, 1, 8)')} AND {block_sql('substr(account, 10, 8)')} AS valid FROM people")
def bank_account_checksum(spark, sf_dir):
    return people(spark, sf_dir).select("k", "account", checksums.blocks_ok(F.col("account")).alias("valid"))


@query(f"WITH {people_sql()} SELECT k, iban, CAST(substr(iban, 5, 24) || '1730' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM people")
def iban_checksum(spark, sf_dir):
    return people(spark, sf_dir).select("k", "iban", checksums.iban_ok(F.col("iban")).alias("valid"))


_SCORED = f"""scored AS (SELECT *, CASE kind WHEN 'adoszam' THEN {block_sql('substr(number, 1, 8)')} WHEN 'bankszamlaszam' THEN {block_sql('substr(number, 1, 8)')} AND {block_sql('substr(number, 10, 8)')}
 WHEN 'taj' THEN ({digit_sum('taj', [3, 7, 3, 7, 3, 7, 3, 7, 9])}) % 10 = 0 ELSE ({digit_sum('tax_id', [*range(1, 10)])}) % 11 = CAST(substr(tax_id, 10, 1) AS INT) END AS ok,
 kind <> 'adoszam' OR k % 60 BETWEEN 1 AND 51 AS fits, k % 4 IN (0, 3) AS named FROM people),
rated AS (SELECT *, CAST(55 + CASE WHEN named THEN 25 ELSE 0 END + CASE WHEN ok THEN 20 ELSE -15 END - CASE WHEN fits THEN 0 ELSE 15 END AS INT) AS confidence FROM scored)"""


@query(f"WITH {people_sql()}, {_SCORED} SELECT k, kind, number AS surface, CAST(strpos(text, number) - 1 AS INT) AS start, CAST(strpos(text, number) - 1 + length(number) AS INT) AS \"end\", CASE WHEN ok THEN 'valid' ELSE 'invalid' END AS checksum, least(100, confidence) AS confidence, CASE WHEN confidence >= 80 THEN 'auto' ELSE 'review' END AS disposition FROM rated")
def identifier_scan(spark, sf_dir):
    return identifiers.resolved(people(spark, sf_dir), ["k"]).select("k", "kind", "surface", "start", "end", "checksum", "confidence", "disposition")


@query(f"WITH {people_sql()}, {_SCORED} SELECT kind, CASE WHEN ok THEN 'valid' ELSE 'invalid' END AS checksum, CASE WHEN confidence >= 80 THEN 'auto' ELSE 'review' END AS disposition, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(100, confidence)) AS BIGINT) AS total FROM rated GROUP BY ALL")
def identifier_summary(spark, sf_dir):
    return identifiers.resolved(people(spark, sf_dir), ["k"]).groupBy("kind", "checksum", "disposition").agg(F.count("*").alias("n"), F.sum("confidence").cast("long").alias("total"))


@query(f"WITH {people_sql()}, {_SCORED}, h AS (SELECT c_nationkey, kind, lower(number) AS key, number, least(100, confidence) AS confidence FROM rated UNION ALL SELECT c_nationkey, kind, lower(number), number, least(100, confidence) FROM rated WHERE k % 2 = 0) SELECT c_nationkey, kind, key, arg_max(number, confidence) AS surface, CAST(max(confidence) AS INT) AS confidence, CAST(count(*) AS BIGINT) AS occurrences FROM h GROUP BY ALL")
def identifier_rollup(spark, sf_dir):
    every = people(spark, sf_dir)
    hits = identifiers.resolved(every.unionByName(every.where("k % 2 = 0").withColumn("k", -F.col("k") - 1)), ["c_nationkey", "k"])
    return identifiers.rollup(hits, ["c_nationkey"])


@query(fold_sql("s - e, -confidence, s, e, label, priority", "r.doc, r.s AS start, r.e AS \"end\", r.confidence, r.label"))
def overlap_resolve(spark, sf_dir):
    return spans.resolve_overlaps(span_rows(spark, sf_dir).select("doc", "start", "end", "confidence", "label", "priority"), ["doc"]).drop("priority")


@query("SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY start, \"end\") AS INT) AS no FROM (" + fold_sql("priority, s, -e, confidence, label", "r.doc, r.s AS start, r.e AS \"end\", r.confidence, r.label, r.priority") + ")")
def coverage_claim(spark, sf_dir):
    return spans.claim_coverage(span_rows(spark, sf_dir), ["doc"])


@query(f"""WITH {SPANS_SQL}, u AS (SELECT doc, s, min(e) AS e, min(label) AS label, min(confidence) AS confidence FROM spans GROUP BY doc, s),
g AS (SELECT *, sum(CASE WHEN label = pl AND s - pe <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(label) OVER (PARTITION BY doc ORDER BY s, e) AS pl, lag(e) OVER (PARTITION BY doc ORDER BY s, e) AS pe FROM u))
SELECT doc, min(label) AS label, min(s) AS start, max(e) AS "end", min(confidence) AS confidence FROM g GROUP BY doc, i""")
def merge_adjacent(spark, sf_dir):
    unique = span_rows(spark, sf_dir).groupBy("doc", "start").agg(F.min("end").alias("end"), F.min("label").alias("label"), F.min("confidence").alias("confidence"))
    return spans.merge_adjacent(unique, ["doc"], score="confidence")


@query(f"""WITH {SPANS_SQL}, b AS (SELECT doc, s, e, label, max(confidence) AS confidence FROM spans GROUP BY doc, s, e, label)
SELECT doc, s AS start, e AS "end", label, confidence FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS o WHERE o.doc = b.doc AND o.label = b.label AND o.s <= b.s AND o.e >= b.e AND (o.s < b.s OR o.e > b.e))""")
def dedupe_windows(spark, sf_dir):
    return spans.dedupe_windows(span_rows(spark, sf_dir).select("doc", "start", "end", "label", F.col("label").alias("kind"), "confidence"), ["doc", "kind"], score="confidence").drop("kind")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def unit_offsets(spark, sf_dir):
    return spans.unit_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "offset")


@query("SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def full_text(spark, sf_dir):
    return spans.full_text(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.sha2("text", 256).alias("digest"))


@query("""WITH h AS (SELECT user_id AS doc, event_id AS s, event_type AS entity_id, CAST(40 + event_id % 61 AS INT) AS confidence, event_id % 5 = 0 AS introduces, event_id % 5 <> 0 AS shorthand, event_id % 7 = 0 AS ambiguous FROM events),
k AS (SELECT *, coalesce(max(CASE WHEN introduces AND confidence >= 80 THEN 1 END) OVER (PARTITION BY doc, entity_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND shorthand AND NOT ambiguous AS gains FROM h)
SELECT doc, s AS start, entity_id, CASE WHEN gains THEN least(100, confidence + 35) ELSE confidence END AS confidence, gains AND confidence < 100 AS boosted FROM k""")
def discourse_boost(spark, sf_dir):
    hits = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS start", "event_type AS entity_id", "CAST(40 + event_id % 61 AS INT) AS confidence", "event_id % 5 = 0 AS introduces", "event_id % 5 <> 0 AS shorthand", "event_id % 7 = 0 AS ambiguous")
    return spans.discourse_boost(hits, ["doc"]).select("doc", "start", "entity_id", "confidence", "boosted")


@query("""WITH h AS (SELECT o_custkey AS doc, o_orderkey AS s, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS INT) END AS y FROM orders)
SELECT doc, s AS start, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY doc ORDER BY s ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY doc ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS year,
 y IS NULL AND max(y) OVER (PARTITION BY doc) IS NOT NULL AS inherited FROM h""")
def year_inheritance(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS start", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS INT) END AS year")
    return dates.inherit_years(hits, ["doc"]).select("doc", "start", "year", "inherited")


@query("""WITH e AS (SELECT user_id AS doc, event_id * 3 AS s, event_id * 3 + 2 AS e, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 12 + 1 AS INT) END AS m FROM events),
d AS (SELECT * FROM e WHERE m IS NULL), k AS (SELECT * FROM e WHERE m IS NOT NULL)
SELECT d.doc, d.s AS start, CASE WHEN d.s - k.e <= 60 THEN k.m END AS month, CASE WHEN d.s - k.e <= 60 THEN 2000 + k.m END AS year FROM d ASOF LEFT JOIN k ON d.doc = k.doc AND d.s >= k.e""")
def contextual_day(spark, sf_dir):
    marks = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id * 3 AS start", "event_id * 3 + 2 AS `end`", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 12 + 1 AS INT) END AS month").withColumn("year", 2000 + F.col("month"))
    return dates.contextual_days(marks, ["doc"]).select("doc", "start", "month", "year")


_SHIFT = f"(SELECT CASE WHEN CAST('0x' || substr(h, 14, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END * (30 + {number_sql('h')} % 371) FROM (SELECT {hmac_sql(chr(39) + keyed.SHIFT_TEXT + chr(39))} AS h))"
_MONTH = "CASE CAST(month(nd) AS INT) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(dates.MONTHS)) + " END"


@query(f"WITH {claims_sql()} SELECT k, CAST(make_date(y, m, d) + CAST({_SHIFT} AS INT) AS DATE) AS shifted FROM claims")
def date_shift(spark, sf_dir):
    return claims(spark, sf_dir).select("k", dates.shift_column(F.make_date("y", "m", "d"), keyed.date_shift(SECRET)).alias("shifted"))


@query(f"WITH {claims_sql()} SELECT k, CAST(5 AS INT) AS start, date_text AS surface, 'teljes_datum' AS kind, CAST(92 AS INT) AS confidence, y AS year, m AS month, d AS day, CAST(year(nd) AS VARCHAR) || '. ' || {_MONTH} || ' ' || CAST(day(nd) AS VARCHAR) || '.' AS replacement FROM (SELECT *, make_date(y, m, d) + CAST({_SHIFT} AS INT) AS nd FROM claims)")
def date_scan(spark, sf_dir):
    return dates.scan(claims(spark, sf_dir), ["k"], days=keyed.date_shift(SECRET)).select("k", "start", "surface", "kind", "confidence", "year", "month", "day", "replacement")


_FACTOR = f"(SELECT round(CASE WHEN t * 0.39 < 0.17 THEN 0.8 + t * 0.39 ELSE 1.03 + (t * 0.39 - 0.17) END, 4) FROM (SELECT ({number_sql('h')} % 1000000) / 1e6 AS t FROM (SELECT {hmac_sql(chr(39) + keyed.FACTOR_TEXT + chr(39))} AS h)))"


@query(f"WITH {claims_sql()} SELECT k, CAST(amount AS DOUBLE) AS value, floor(CAST(amount AS DOUBLE) * f / step + 0.5) * step AS new_value FROM (SELECT *, {_FACTOR} AS f, CAST(power(10, least(length(plain) - length(rtrim(plain, '0')), greatest(0, length(plain) - 2))) AS DOUBLE) AS step FROM claims)")
def amount_scale_round(spark, sf_dir):
    step = amounts.rounding_step(F.col("value"), F.lit(0))
    return claims(spark, sf_dir).select("k", F.col("amount").cast("double").alias("value")).select("k", "value", amounts.round_to(F.col("value") * keyed.amount_factor(SECRET), step).alias("new_value"))


@query(f"WITH {claims_sql()} SELECT k, grouped || ' Ft' AS surface, CAST(amount AS DOUBLE) AS value, 'HUF' AS currency, CAST(CASE WHEN amount < 1000 THEN 85 ELSE 85 END AS INT) AS confidence, CAST(strpos(text, grouped || ' Ft') - 1 AS INT) AS start, grouped AS again FROM claims")
def amount_scan(spark, sf_dir):
    found = amounts.scan(claims(spark, sf_dir), ["k"])
    again = amounts.format_number(F.col("value"), F.col("separator"), F.col("decimals"), F.col("dash"))
    return found.select("k", "surface", "value", "currency", "confidence", "start", again.alias("again"))


@query("""WITH v AS (SELECT DISTINCT o_custkey AS case_id, 'HUF' AS currency, floor(o_totalprice / 2500) AS value FROM orders),
n AS (SELECT case_id FROM v GROUP BY case_id HAVING count(*) <= 200), w AS (SELECT v.* FROM v JOIN n USING (case_id))
SELECT a.case_id, a.currency, a.value AS a, b.value AS b, c.value AS c FROM w AS a JOIN w AS b ON a.case_id = b.case_id AND a.value <= b.value AND a.value > 0 JOIN w AS c ON c.case_id = a.case_id AND c.value = a.value + b.value AND c.value <> a.value AND c.value <> b.value""")
def sum_relations(spark, sf_dir):
    values = table(spark, sf_dir, "orders").selectExpr("o_custkey AS case_id", "'HUF' AS currency", "CAST(floor(o_totalprice / 2500) AS DOUBLE) AS value").distinct()
    return amounts.sums(values, "case_id")


@query()
def amount_rescale(spark, sf_dir):
    found = amounts.scan(claims(spark, sf_dir), ["case_id", "k"])
    values = amounts.distinct_values(found, "case_id").withColumn("factor", F.lit(keyed.amount_factor(SECRET)))
    return amounts.rescale(values, "case_id", "factor")


_NAMES = f"WITH {people_sql()}, c AS (SELECT c_nationkey AS doc, CASE WHEN k % 3 = 0 THEN 'dr. ' ELSE '' END || surname || ' ' || given || CASE WHEN k % 5 = 0 THEN ',' ELSE '' END AS name, CAST(80 + k % 20 AS INT) AS confidence, k FROM people)"


@query(_NAMES + ", n AS (SELECT *, lower(surname_given) AS key FROM (SELECT *, rtrim(regexp_replace(name, '^dr\\. ', ''), ',') AS surname_given FROM c)) SELECT doc, key, arg_max(name, confidence * 100000 - k) AS name, CAST(max(confidence) AS INT) AS confidence FROM n WHERE key NOT IN (SELECT DISTINCT key FROM n WHERE k % 97 = 0) GROUP BY doc, key")
def name_candidates_reduce(spark, sf_dir):
    c = people(spark, sf_dir).select(F.col("c_nationkey").alias("doc"), F.concat(F.when(F.col("k") % 3 == 0, "dr. ").otherwise(""), "surname", F.lit(" "), "given", F.when(F.col("k") % 5 == 0, ",").otherwise("")).alias("name"), (80 + F.col("k") % 20).cast("int").alias("confidence"), "k")
    keyed_names = c.withColumn("key", text.normalise_name(F.col("name")))
    kept = keyed_names.where("k % 97 = 0").select("key").distinct()
    return keyed_names.join(kept, "key", "left_anti").groupBy("doc", "key").agg(F.max_by("name", F.struct("confidence", -F.col("k"))).alias("name"), F.max("confidence").alias("confidence"))


@query(_NAMES.replace(", k FROM people)", ", k, surname, given FROM people)") + ", g AS (SELECT lower(left(surname, 6)) || ' ' || lower(left(given, 6)) AS key, surname || ' ' || given AS form, count(*) AS n FROM c GROUP BY ALL) SELECT key, form, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY key ORDER BY length(form), n DESC, form) AS INT) AS rank FROM g")
def cluster_surface_forms(spark, sf_dir):
    full = people(spark, sf_dir).select(F.concat_ws(" ", "surname", "given").alias("form"))
    grouped = full.groupBy(text.cluster_key(F.col("form"), F.lit(True)).alias("key"), "form").agg(F.count("*").alias("n"))
    return decisions.top_k(grouped, ["key"], [F.length("form").asc(), F.desc("n"), F.asc("form")]).select("key", "form", "n", "rank")


@query(f"SELECT c_custkey, {number_sql(hmac_sql('lower(c_name)'))} % 97 AS idx FROM customer")
def pseudonym_index(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", keyed.keyed_index(SECRET, F.col("c_name"), 97).alias("idx"))


@query("WITH f AS (SELECT user_id, event_type, min(CAST(event_id AS BIGINT)) AS first FROM events WHERE event_id % 4 <> 0 GROUP BY ALL) SELECT user_id, event_type AS entity_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS INT) AS no FROM f")
def appearance_order(spark, sf_dir):
    hits = table(spark, sf_dir, "events").selectExpr("user_id", "event_type AS entity_id", "1 AS unit", "event_id AS start", "CASE WHEN event_id % 4 = 0 THEN 'reject' ELSE 'auto' END AS disposition")
    return assign.appearance_order(hits, ["user_id"], "unit")


_HITS = "h AS (SELECT event_id, user_id, event_type AS entity_id, CASE event_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'reject' END AS disposition, CASE WHEN event_id % 10 = 0 THEN 'accept' WHEN event_id % 10 = 1 THEN 'skip' END AS u, CASE WHEN event_id % 7 = 0 THEN 'skip' END AS c, user_id % 2 = 0 AS automatic FROM events), o AS (SELECT *, coalesce(u, c, CASE WHEN automatic AND disposition = 'review' THEN 'accept' WHEN automatic AND disposition = 'reject' THEN 'skip' END) AS decision FROM h), p AS (SELECT *, CASE WHEN decision = 'accept' OR (decision IS NULL AND disposition = 'auto') THEN 'csere' WHEN decision IS NULL AND disposition = 'review' THEN 'bizonytalan' ELSE 'nincs' END AS outcome FROM o)"


def _hits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type AS entity_id", "event_type AS kind", "CASE event_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'reject' END AS disposition", "CASE WHEN event_id % 10 = 0 THEN 'accept' WHEN event_id % 10 = 1 THEN 'skip' END AS user_decision", "CASE WHEN event_id % 7 = 0 THEN 'skip' END AS class_decision", "user_id % 2 = 0 AS automatic")
    return decisions.with_outcomes(rows)


@query(f"WITH {_HITS} SELECT event_id, decision, outcome, u IS NULL AND c IS NULL AND automatic AND disposition <> 'auto' AS by_program FROM p")
def decision_outcomes(spark, sf_dir):
    return _hits(spark, sf_dir).select("event_id", "decision", "outcome", "by_program")


@query(f"WITH {_HITS} SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE {c} = '{v}') AS BIGINT) AS n_{v}" for c, vs in (("disposition", ("auto", "review", "reject")), ("outcome", ("csere", "bizonytalan", "nincs"))) for v in vs) + ", CAST(count(*) AS BIGINT) AS n_hits FROM p GROUP BY user_id")
def outcome_counts(spark, sf_dir):
    return decisions.counts(_hits(spark, sf_dir), ["user_id"])


@query(f"WITH {_HITS} SELECT user_id, entity_id, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(*) FILTER (WHERE decision IS NULL AND disposition <> 'auto') AS BIGINT) AS pending FROM p GROUP BY ALL")
def case_cast(spark, sf_dir):
    return decisions.cast(_hits(spark, sf_dir), ["user_id"])


@query(f"WITH {_HITS} SELECT user_id, entity_id AS kind, outcome, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ROLLUP (user_id, entity_id, outcome)")
def audit_rollup(spark, sf_dir):
    return decisions.audit(_hits(spark, sf_dir), ["user_id"])


@query("SELECT user_id, event_id, CAST(rank AS INT) AS rank, CAST(total AS BIGINT) AS total FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE rank <= 40")
def residual_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return decisions.top_k(rows, ["user_id"], [F.desc("value"), F.asc("event_id")], 40).select("user_id", "event_id", "rank", "total")


@query("SELECT user_id, event_id, CAST(user_id * 1000000 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS match_id FROM events")
def case_match_ids(spark, sf_dir):
    return decisions.case_ids(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "match_id")


@query(f"WITH {people_sql()} SELECT k, CASE WHEN lower(left(given, 1)) IN ('a','á','e','é','i','í','o','ó','ö','ő','u','ú','ü','ű') THEN 'Itt van az ' ELSE 'Itt van a ' END || given AS fixed FROM people")
def article_fix(spark, sf_dir):
    return people(spark, sf_dir).select("k", F.concat(text.fix_article(F.when(F.col("k") % 2 == 0, "Itt van a ").otherwise("Itt van az "), F.col("given")), "given").alias("fixed"))


@query(f"WITH {people_sql()} SELECT k, CASE WHEN lower(role) LIKE 'i. r.%' THEN 'I. r. alperes' WHEN lower(role) LIKE 'ii. rend%' THEN 'II. r. alperes' ELSE rtrim(lower(role), ':') END AS role FROM people")
def role_normalise(spark, sf_dir):
    return people(spark, sf_dir).select("k", text.normalise_role(F.col("role")).alias("role"))


@query("SELECT s_suppkey, s_name || ' Nonprofit Kft.' AS name, s_name AS stem, 'Nonprofit Kft.' AS form, left(upper(s_name), 1) AS initials FROM supplier")
def company_form_split(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" Nonprofit Kft.")).alias("name"), "s_name")
    return named.select("s_suppkey", "name", text.strip_company_form(F.col("name")).alias("stem"), text.company_form(F.col("name")).alias("form"), text.initials(F.col("s_name")).alias("initials"))


@query(f"WITH {people_sql()} SELECT k, regexp_replace(CASE WHEN strpos(text, number) - 1 > 45 THEN '…' ELSE '' END || substr(text, greatest(strpos(text, number) - 45, 1), least(strpos(text, number) - 1, 45)) || '⟦' || number || '⟧' || substr(text, strpos(text, number) + length(number), 45) || CASE WHEN length(text) > strpos(text, number) - 1 + length(number) + 45 THEN '…' ELSE '' END, '\\s+', ' ', 'g') AS shown FROM people")
def context_window(spark, sf_dir):
    at = F.instr("text", F.col("number")) - 1
    return people(spark, sf_dir).select("k", text.context_around(F.col("text"), at, at + F.length("number")).alias("shown"))


@query(f"WITH {people_sql()} SELECT k, substr(text, 1, strpos(text, number) - 1) || '[' || kind || ']' || substr(text, strpos(text, number) + length(number)) AS text FROM people")
def splice_labels(spark, sf_dir):
    rows = people(spark, sf_dir)
    edits = identifiers.resolved(rows, ["k"]).select("k", "start", "end", F.concat(F.lit("["), "kind", F.lit("]")).alias("replacement"))
    return spans.apply_edits(rows.select("k", "text"), edits, ["k"])


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(CAST(greatest(ceil((len(w) - 126) / 94.0), 0) AS BIGINT) + 1)) AS i FROM t WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INT) AS window_no, CAST(i * 94 AS INT) AS "first", CAST(len(list_slice(w, i * 94 + 1, i * 94 + 126)) AS INT) AS n FROM s""")
def token_windows(spark, sf_dir):
    words = F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    return ner.token_windows(docs, "words", ["doc_id"], size=128, overlap=32).select("doc_id", "window_no", "first", F.size("tokens").alias("n"))


_TAGS = "CASE event_id % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' WHEN 3 THEN 'I-ORG' ELSE 'I-ORG' END"


@query(f"""WITH w AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_TAGS} AS label, event_id * 4 AS s, event_id * 4 + 3 AS e, CAST(1 + event_id % 100 AS DOUBLE) / 100 AS score FROM events),
t AS (SELECT *, substr(label, 3) AS type, label LIKE 'B-%' AS b, lag(substr(label, 3)) OVER o AS pt, lag(n) OVER o AS pn FROM w WHERE label <> 'O' WINDOW o AS (PARTITION BY doc ORDER BY n)),
g AS (SELECT *, sum(CASE WHEN type = pt AND NOT b AND pn = n - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS i FROM t)
SELECT doc, min(type) AS type, min(s) AS start, max(e) AS "end", min(score) AS score, CAST(count(*) AS BIGINT) AS n_words FROM g GROUP BY doc, i HAVING min(score) >= 0.5""")
def bio_grouping(spark, sf_dir):
    words = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS word_no", f"{_TAGS} AS label", "event_id * 4 AS start", "event_id * 4 + 3 AS `end`", "CAST(1 + event_id % 100 AS DOUBLE) / 100 AS score")
    return ner.group_spans(words, ["doc"])


@query("""WITH v AS (SELECT l_orderkey AS doc, l_partkey % 5 AS word_no, l_linenumber AS w, min(l_returnflag) AS label, max(l_quantity) AS score FROM lineitem GROUP BY ALL)
SELECT doc, word_no, label, score FROM (SELECT *, row_number() OVER (PARTITION BY doc, word_no ORDER BY score DESC, w) AS r FROM v) WHERE r = 1""")
def best_votes(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_partkey % 5 AS word_no", "l_returnflag AS label", "l_quantity AS score", "l_linenumber AS window_no")
    votes = votes.groupBy("doc", "word_no", "window_no").agg(F.min("label").alias("label"), F.max("score").alias("score"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    return ner.best_votes(votes, ["doc"]).select("doc", "word_no", "label", "score")


@query(f"""WITH {people_sql()}, t AS (SELECT k, number, regexp_replace(number, '[ .-]', '', 'g') AS bare, string_split(text || CASE WHEN k % 4 = 1 THEN ' / ' || number WHEN k % 4 = 2 THEN ' / 7' || number ELSE '' END, ' / ') AS parts FROM people)
SELECT k, number AS literal, CAST(1 + len(list_filter(parts[2:], lambda x: regexp_replace(x, '[ .-]', '', 'g') = bare)) AS BIGINT) AS found FROM t""")
def leak_counts(spark, sf_dir):
    rows = people(spark, sf_dir)
    return verify.count_leaks(rows.select("k", F.concat("text", F.when(F.col("k") % 4 == 1, F.concat(F.lit(" / "), "number")).when(F.col("k") % 4 == 2, F.concat(F.lit(" / 7"), "number")).otherwise("")).alias("text")), rows.select("k", F.col("number").alias("literal")), ["k"])


@query()
def inflect_paradigms(spark, sf_dir):
    full = people(spark, sf_dir).select(F.concat_ws(" ", "surname", "given").alias("name"))
    return hungarian.paradigms(full)


def _case(spark, sf_dir):
    rows = people(spark, sf_dir)
    return rows.select(F.col("c_nationkey").alias("case_id"), F.lit("person").alias("kind"), "surname", "given", F.lit("N").alias("gender"), "k").groupBy("case_id", "kind", "surname", "given", "gender").agg(F.min("k").alias("k")).withColumn("id", F.col("k").cast("string"))


def _mentions(spark, sf_dir):
    units = people(spark, sf_dir).select(F.col("c_nationkey").alias("case_id"), "k", "text")
    return names.match(units, _case(spark, sf_dir), "case_id", ["k"])


@query(f"""WITH {people_sql()} SELECT c_nationkey AS case_id, k, CAST(0 AS INT) AS start, CAST(length(surname || ' ' || given) AS INT) AS "end", surname || ' ' || given AS surface,
CAST(min(k) OVER (PARTITION BY c_nationkey, surname, given) AS VARCHAR) AS entity_id, 'full' AS core, 'NOM' AS case_tag, CAST(100 AS INT) AS confidence, FALSE AS ambiguous, 'auto' AS disposition FROM people""")
def variant_match(spark, sf_dir):
    return _mentions(spark, sf_dir).drop("upper", "candidates", "prefix", "tail")


@query()
def assign_pseudonyms(spark, sf_dir):
    return assign.assign(_case(spark, sf_dir), "case_id", THEME, SECRET, order="k")


@query(f"WITH {people_sql()} SELECT k, k % 2 = 1 AS ok, CASE WHEN k % 2 = 0 THEN number ELSE '' END AS leaks, CASE WHEN k % 2 = 1 THEN number || '|' ELSE '' END || given AS residual, CAST(1 + k % 2 AS INT) AS residual_total FROM people")
def verification_report(spark, sf_dir):
    rows = people(spark, sf_dir).withColumn("known", F.when(F.col("k") % 2 == 0, F.array("number")))
    return verify.report(rows, ["k"], literals="known").withColumns({"leaks": F.array_join("leaks", "|"), "residual": F.array_join("residual", "|"), "residual_total": F.col("residual_total").cast("int")})


def three_digits_sql(n: str) -> str:
    """Words of a number below a thousand."""
    pick = lambda words, i: f"CASE {i} " + " ".join(f"WHEN {j} THEN '{w}'" for j, w in enumerate(words)) + " END"
    ones = ("", "egy", "kettő", "három", "négy", "öt", "hat", "hét", "nyolc", "kilenc")
    whole = ("", "tíz", "húsz", "harminc", "negyven", "ötven", "hatvan", "hetven", "nyolcvan", "kilencven")
    before = ("", "tizen", "huszon", *whole[3:])
    hundreds = ("", "száz", "kétszáz", *(f"{w}száz" for w in ones[3:]))
    t, o = f"({n} // 10 % 10)", f"({n} % 10)"
    return f"({pick(hundreds, f'({n} // 100)')} || CASE WHEN {t} = 0 THEN {pick(ones, o)} WHEN {o} = 0 THEN {pick(whole, t)} ELSE {pick(before, t)} || {pick(ones, o)} END)"


def _numbers_sql() -> str:
    low = lambda n: f"regexp_replace({three_digits_sql(n)}, 'kettő$', 'két')"
    return f"""WITH {claims_sql()}, g AS (SELECT k, amount, amount // 1000000000 AS b, amount // 1000000 % 1000 AS m, amount // 1000 % 1000 AS t, amount % 1000 AS r FROM claims)
SELECT k, amount, CASE WHEN amount = 0 THEN 'nulla' ELSE replace(array_to_string(list_filter([CASE WHEN b > 0 THEN {low('b')} || 'milliárd' END, CASE WHEN m > 0 THEN {low('m')} || 'millió' END,
CASE WHEN t = 1 THEN 'ezer' WHEN t > 1 THEN {low('t')} || 'ezer' END, CASE WHEN r > 0 THEN {three_digits_sql('r')} END], lambda x: x IS NOT NULL), '-'), CASE WHEN amount > 2000 THEN '*' ELSE '-' END, '') END AS in_words FROM g"""


@query(_numbers_sql())
def number_words(spark, sf_dir):
    return claims(spark, sf_dir).select("k", "amount", hungarian.words_of(F.col("amount")).alias("in_words"))


@query(f"""WITH {people_sql()}, t AS (SELECT *, 'Felperes: ' || surname || ' ' || given || chr(10) || 'A ' || surname || ' Agrár Kft. képviseletében dr. ' || given || ' ' || surname || ' ügyvéd járt el. ' || surname || ' úr.' AS said FROM people),
n AS (SELECT *, CAST((length(said) - length(replace(said, surname, ''))) / length(surname) AS INT) AS occurrences FROM t)
SELECT k, surname || ' ' || given AS name, 'person' AS kind, 'felperes' AS role, CASE WHEN given IN ('Anna', 'Tünde', 'Mária', 'Erzsébet', 'Ilona') THEN 'F' WHEN given = 'Ödön' THEN 'N' ELSE 'M' END AS gender, CAST(99 AS INT) AS confidence, occurrences FROM n
UNION ALL SELECT k, surname || ' Agrár Kft.', 'org', 'szervezet', 'N', CAST(98 AS INT), occurrences FROM n""")
def detect_parties(spark, sf_dir):
    rows = people(spark, sf_dir).select("k", F.concat(F.lit("Felperes: "), "surname", F.lit(" "), "given", F.lit("\nA "), "surname", F.lit(" Agrár Kft. képviseletében dr. "), "given", F.lit(" "), "surname", F.lit(" ügyvéd járt el. "), "surname", F.lit(" úr.")).alias("text"))
    return parties.detect(rows, "k")[0]


@query()
def render_theme(spark, sf_dir):
    new = assign.replacements(_case(spark, sf_dir), "case_id", THEME, SECRET, order="k")
    return render.render_theme(_mentions(spark, sf_dir), new, "case_id").select("case_id", "k", "start", "end", "surface", "entity_id", "core", "case_tag", "replacement")


@query(f"WITH {SPANS_SQL}, e AS (SELECT DISTINCT doc, s + 2 AS s, s + 4 AS e FROM spans), w AS (SELECT DISTINCT doc, s, e, s * 1000 + e AS id FROM spans) SELECT e.doc, e.s AS start, e.e AS \"end\", arg_min(w.id, w.s * 100000 + w.e) FILTER (WHERE w.s <= e.s AND e.e <= w.e) AS span_id FROM e LEFT JOIN w ON w.doc = e.doc GROUP BY ALL")
def edit_containment(spark, sf_dir):
    rows = span_rows(spark, sf_dir)
    edits = rows.select("doc", (F.col("start") + 2).alias("start"), (F.col("start") + 4).alias("end")).distinct()
    return spans.first_container(edits, rows.select("doc", "start", "end", (F.col("start") * 1000 + F.col("end")).alias("span_id")).distinct(), ["doc"])


@query("WITH l AS (SELECT user_id, event_type AS literal, count(*) AS found FROM events GROUP BY ALL), k AS (SELECT user_id, event_type AS literal, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) SELECT user_id, literal, CAST(found AS BIGINT) AS found, CAST(found - coalesce(n, 0) AS BIGINT) AS excess FROM l LEFT JOIN k USING (user_id, literal) WHERE found > coalesce(n, 0)")
def leak_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("literal"), "event_id")
    kept = rows.where("event_id % 3 <> 0").groupBy("user_id", "literal").agg(F.count("*").alias("n"))
    return verify.within_budget(rows.groupBy("user_id", "literal").agg(F.count("*").alias("found")), kept, ["user_id", "literal"])


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS INT) AS number FROM customer")
def entity_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("kind"))
    return assign.numbering(rows, "c_nationkey", "c_custkey").select("c_custkey", "number")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand || 'x') ELSE p_brand || 'x' END AS cased FROM part")
def case_matching(spark, sf_dir):
    source = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.match_case(source, F.concat("p_brand", F.lit("x"))).alias("cased"))


@query("SELECT conv_id, turn, n, n = 1 OR regexp_matches(substr(text, greatest(n - 4, 1), least(n - 1, 4)), '[.!?:;]\\s*$|\\n\\s*$|^\\s*$') AS starts FROM (SELECT conv_id, turn, text, CAST(1 + turn * 7 AS INT) AS n FROM conversations)")
def sentence_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n", (1 + F.col("turn") * 7).cast("int"))
    return rows.select("conv_id", "turn", "n", text.sentence_initial(F.col("text"), F.col("n") - 1).alias("starts"))


_ROOT = "regexp_replace(lower({}), '(os|es|ös|ás|és|i|ó|ő|s|a|e)$', '')"


@query(f"WITH p AS (SELECT p_partkey, p_name AS a, p_name || CASE p_partkey % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'os' WHEN 2 THEN 'xyz' ELSE '' END AS b FROM part), r AS (SELECT *, {_ROOT.format('a')} AS x, {_ROOT.format('b')} AS y FROM p) SELECT p_partkey, x = y OR (x <> '' AND starts_with(y, x) AND length(y) - length(x) <= 2) OR (y <> '' AND starts_with(x, y) AND length(x) - length(y) <= 2) AS related FROM r")
def shared_roots(spark, sf_dir):
    end = F.when(F.col("p_partkey") % 4 == 0, "i").when(F.col("p_partkey") % 4 == 1, "os").when(F.col("p_partkey") % 4 == 2, "xyz").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.same_root(F.col("p_name"), F.concat("p_name", end)).alias("related"))


@query(f"WITH {people_sql()} SELECT k, kind, CASE WHEN kind IN ('helyrajzi_szam', 'cim', 'iranyitoszam') THEN 'place' ELSE 'other' END AS label, 'AZONOSITO:' || kind AS raw_label FROM people")
def entity_shapes(spark, sf_dir):
    return identifiers.as_entities(identifiers.resolved(people(spark, sf_dir), ["k"])).select("k", "kind", "label", "raw_label")


# The other modules add theirs.
QUERIES |= golds_files.QUERIES | cases.QUERIES | packages.QUERIES | rescaled.QUERIES | searches.QUERIES
SQL |= golds_files.SQL | cases.SQL | packages.SQL | rescaled.SQL | searches.SQL
