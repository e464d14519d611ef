"""Hungarian test texts made from the star-schema tables by plain SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SURNAMES = ("Kovács", "Szabó", "Nagy", "Tóth", "Kiss", "Németh", "Farkas", "Balogh", "Papp", "Molnár")
GIVEN = ("János", "Anna", "Péter", "Tünde", "József", "Mária", "Ödön", "Erzsébet", "Balázs", "Ilona", "Gábor")
ROLES = ("felperes", "II. rendű alperes", "tanú", "i. r.  alperes", "kezes:", "Vevő")
MONTHS = ("január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where what follows is Python: some seconds' work. A small file is read by one task, whatever its rows cost.
SPREAD = 2_500


def spread(rows: DataFrame, key: str, size: int = SPREAD) -> DataFrame:
    """``rows`` of a table dealt out by key to as many tasks as their number asks for (a count reads the files' footers only)."""
    tasks = -(-rows.count() // size)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def pick(words: tuple[str, ...], n: str) -> str:
    """The n-th word (from 0, modulo their number)."""
    return f"CASE {n} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def digits(text: str, weights: list[int]) -> str:
    return " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


def block(seed: str) -> str:
    return f"lpad(CAST({seed} % 9000000 + 1000000 AS STRING), 7, '0')"


def check8(seven: str) -> str:
    return f"CAST((10 - ({digits(seven, [9, 7, 3, 1, 9, 7, 3])}) % 10) % 10 AS STRING)"


#: Levels of columns over ``customer``: every third key has wrong check digits.
PEOPLE = (
    {
        "k": "CAST(c_custkey AS BIGINT)",
        "bad": "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END",
        "seven": block("(c_custkey * 7919 + 1234567)"),
        "other": block("(c_custkey * 104729 + 7654321)"),
        "eight": "lpad(CAST((c_custkey * 15485863 + 32452843) % 90000000 + 10000000 AS STRING), 8, '0')",
        "surname": pick(SURNAMES, "c_custkey"),
        "given": pick(GIVEN, "(c_custkey * 7)"),
        "role": pick(ROLES, "c_custkey"),
    },
    {
        "block_a": f"seven || CAST((CAST({check8('seven')} AS INT) + bad) % 10 AS STRING)",
        "block_b": f"other || {check8('other')}",
        "taj": f"eight || CAST((({digits('eight', [3, 7] * 4)}) + bad) % 10 AS STRING)",
        "tax_id": f"'8' || eight || CAST(((8 + {digits('eight', [*range(2, 10)])}) % 11 + bad) % 10 AS STRING)",
    },
    {
        "tax_number": "block_a || '-' || CAST(1 + k % 5 AS STRING) || '-' || lpad(CAST(k % 60 AS STRING), 2, '0')",
        "company": "lpad(CAST(k % 25 AS STRING), 2, '0') || '-09-' || substr(eight, 1, 6)",
        "account": "block_a || '-' || block_b",
        "bban": "block_a || block_b || '00000000'",
    },
    {
        "rest15": "CAST(substr(bban || '173000', 1, 15) AS BIGINT) % 97",
    },
    {
        "iban": "'HU' || lpad(CAST((98 - CAST(CAST(rest15 AS STRING) || substr(bban || '173000', 16, 15) AS BIGINT) % 97 + bad) % 100 AS STRING), 2, '0') || bban",
    },
    {
        "label": "CASE k % 4 WHEN 0 THEN 'adószáma: ' WHEN 1 THEN 'száma ' WHEN 2 THEN 'az ' ELSE 'TAJ száma ' END",
        "number": "CASE k % 4 WHEN 0 THEN tax_number WHEN 1 THEN account WHEN 2 THEN tax_id ELSE substr(taj, 1, 3) || ' ' || substr(taj, 4, 3) || ' ' || substr(taj, 7, 3) END",
        "kind": "CASE k % 4 WHEN 0 THEN 'adoszam' WHEN 1 THEN 'bankszamlaszam' WHEN 2 THEN 'ado_azonosito_jel' ELSE 'taj' END",
    },
    {
        "text": "surname || ' ' || given || ' ' || label || number || ' a nyilvántartás szerint.'",
    },
)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    for level in PEOPLE:
        out = out.selectExpr("*", *(f"{e} AS {n}" for n, e in level.items()))
    return out


def people_sql() -> str:
    """The same as a common table expression ``people``."""
    source = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
    for level in PEOPLE:
        source = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in level.items()) + f" FROM ({source})"
    return f"people AS ({source})"


#: Dates and amounts over ``orders``.
CLAIMS = (
    {
        "k": "CAST(o_orderkey AS BIGINT)",
        "case_id": "CAST(o_custkey AS BIGINT)",
        "y": "CAST(year(o_orderdate) AS INT) + 20",
        "m": "CAST(month(o_orderdate) AS INT)",
        "d": "CAST(day(o_orderdate) AS INT)",
        "amount": "CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 1000 END",
    },
    {
        "month_name": "CASE m " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(MONTHS)) + " END",
        "plain": "CAST(amount AS STRING)",
    },
    {
        "grouped": "CASE WHEN length(plain) > 9 THEN substr(plain, 1, length(plain) - 9) || ' ' || substr(plain, length(plain) - 8, 3) || ' ' || substr(plain, length(plain) - 5, 3) || ' ' || substr(plain, length(plain) - 2, 3)"
        " WHEN length(plain) > 6 THEN substr(plain, 1, length(plain) - 6) || ' ' || substr(plain, length(plain) - 5, 3) || ' ' || substr(plain, length(plain) - 2, 3)"
        " WHEN length(plain) > 3 THEN substr(plain, 1, length(plain) - 3) || ' ' || substr(plain, length(plain) - 2, 3) ELSE plain END",
        "date_text": "CAST(y AS STRING) || '. ' || month_name || ' ' || CAST(d AS STRING) || '.'",
    },
    {
        "text": "'Kelt ' || date_text || ' napján, a követelés ' || grouped || ' Ft és járulékai.'",
    },
)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"), "o_orderkey", 8 * SPREAD)
    for level in CLAIMS:
        out = out.selectExpr("*", *(f"{e} AS {n}" for n, e in level.items()))
    return out


def claims_sql() -> str:
    source = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus FROM orders"
    for level in CLAIMS:
        source = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in level.items()) + f" FROM ({source})"
    return f"claims AS ({source})"
