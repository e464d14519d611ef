"""The audit of sources against a brute-force version in plain Python, and against SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from spanloom.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, most_terms):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    of = lambda t: TERM.findall((t or "").translate(lower))
    out = set()
    for lang in {r[1] or "" for r in rows}:
        own = [(r[2] or "", of(r[0])) for r in rows if (r[1] or "") == lang]
        df = Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t in df if df[t] >= least_docs)
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if t in set(kept))
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most_terms])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")


def rows(n=150, seed=2):
    r = random.Random(seed)
    words = ["THE", "the", "b", "é", "É", "straße", "İ", "a1b", "c-d", "\x1f", "zz_top", "\U0001f600", "ß", "x" * 300, "K", "İx"]
    out = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s2", "s3", "", None, "Ä", "ü", "s10"])
        out.append((" ".join(r.choice(words) for _ in range(r.randint(0, 12))), lang, source))
    return [*out, (None, "en", "only null"), ("", "fr", "s"), ("1 2 3", "fr", "t"), ("word " * 20_000, "en", "s1"), ("the the", "en", "s1"), ("the the", "en", "s1")]


@pytest.mark.parametrize("sizes", [{}, {"SOURCES": 2, "TERMS": 3, "AUTOMATON": 6, "HELD": 5}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    """With one block of everything, and with many blocks, automata and hand-overs."""
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    given = rows()
    got = [tuple(r) for r in divergence.audit(table(spark, given).repartition(3), least_docs=5, most_terms=4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(given, 5, 4)


def test_no_terms_one_source_and_nothing(spark):
    given = [("few words", "en", "a"), ("other words", "en", "b"), ("x", "de", "a")]
    assert {tuple(r) for r in divergence.audit(table(spark, given)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.audit(table(spark, given).limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    row = spark.range(1).select(divergence.share(*(divergence.F.lit(x).cast("long") for x in (9 * 10**17, 9 * 10**18, 10**9))).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**17 + 5) // (9 * 10**18 + 5 * 10**9)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES["op11_divergence"](spark, sf)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(queries.SQL["op11_divergence"]).fetchall())
