"""How far the sources of a language differ in what they say: a two-pass audit of word counts.

The first pass gives the exact number of documents of each term in each language; terms in at least ``least_docs`` of them are
kept. The second pass counts the kept terms' occurrences with an automaton (pyahocorasick) of all of them, each between two
delimiters, over texts in which whatever is no part of a term has become a delimiter. Kept terms reach the tasks as a
broadcast; beyond ``AUTOMATON`` terms they go in several parts, and the texts are passed once for each, so an automaton's size
does not grow with the vocabulary.

What comes out are sparse postings: (language, source, term, occurrences) where there are any. A group's smoothed share of a
term it does not have is one number of the group, so two sources differ by the number of kept terms times the difference of
those two numbers, and by corrections for the terms that at least one of them has. Corrections are added up in blocks: sources
of a language in blocks of ``SOURCES``, terms in blocks of about ``TERMS``; each pair of source blocks and block of terms is a
group of its own, of bounded size, whose task gives partial sums for its pairs of sources. All shares are whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, materialize

#: Terms of an automaton; entries that a task holds before it hands them on; sources and terms of a block.
AUTOMATON, HELD, SOURCES, TERMS = 400_000, 400_000, 128, 4096
UNIT = 1_000_000_000
#: Bytes of terms, A-Z lower-cased; every other byte is a delimiter. All bytes of characters beyond ASCII belong to terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _flat(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Nulls are empty; the text is bytes."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(of(lang).alias("lang"), of(source).alias("source"), of(text).cast("binary").alias("text"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term binary, n): in how many rows each term is; summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[lang].update(set(text.as_py().translate(_TERM).split()))
                if sum(map(len, seen.values())) > HELD:
                    yield from _counts(seen)
        yield from _counts(seen)

    return map_rows(docs.select("lang", "text"), run, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _counts(seen: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
    for lang, counter in seen.items():
        if counter:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array([*counter.keys()], pa.binary()), pa.array([*counter.values()], pa.int64())], names=["lang", "term", "n"])
    seen.clear()


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term string, part, id): terms in enough documents, dealt to automata of ``AUTOMATON`` terms at most, nearly always
    fewer, with a number each."""
    kept = materialize(document_frequencies(docs).where(F.col("n") >= least_docs).select("lang", F.col("term").cast("string").alias("term")), "frequent")
    n = kept.count()
    parts = 1 if n <= AUTOMATON else -(-2 * n // AUTOMATON)
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int"))
    return materialize(dealt.withColumn("id", F.monotonically_increasing_id()), "terms")


def automata(terms: dict[str, list[tuple[str, int]]]) -> dict[str, ahocorasick.Automaton]:
    """For each language one that finds its terms between delimiters and gives their numbers."""
    out = {}
    for lang, own in terms.items():
        out[lang] = automaton = ahocorasick.Automaton()
        for term, i in own:
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
    return out


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of kept terms with n > 0 occurrences."""
    spark, out = docs.sparkSession, None
    for part in sorted(r.part for r in kept.select("part").distinct().collect()):
        listed: dict[str, list[tuple[str, int]]] = defaultdict(list)
        own = kept.where(F.col("part") == part).toArrow()
        for lang, term, i in zip(*(own[c].to_pylist() for c in ("lang", "term", "id")), strict=True):
            listed[lang].append((term, i))
        sent = spark.sparkContext.broadcast(dict(listed))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found, seen, value = automata(sent.value), defaultdict(Counter), itemgetter(1)
            for batch in batches:
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if lang in found:
                        plain = b" ".join([b"", text.as_py().translate(_TERM), b""]).decode("utf-8", "replace")
                        seen[lang, source].update(map(value, found[lang].iter(plain)))
                        if sum(map(len, seen.values())) > HELD:
                            yield from _postings(seen)
            yield from _postings(seen)

        counted = map_rows(docs, run, "lang string, source string, id long, n long").groupBy("lang", "source", "id").agg(F.sum("n").alias("n")).withColumn("part", F.lit(part))
        out = counted if out is None else out.unionByName(counted)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    return materialize(out.join(kept, ["lang", "part", "id"]).select("lang", "source", "term", "n"), "postings")


def _postings(seen: dict[tuple[str, str], Counter[int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), counter in seen.items():
        n = len(counter)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(np.fromiter(counter.keys(), np.int64, n)), pa.array(np.fromiter(counter.values(), np.int64, n))], names=["lang", "source", "id", "n"])
    seen.clear()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * terms)), in decimals: no count of any corpus overflows."""
    wide = lambda c: c.cast("decimal(26,0)")
    return F.lit(1).cast("long") + F.call_function("div", (wide(n) + F.lit(5)) * F.lit(UNIT), wide(total) + wide(terms) * F.lit(5))


def _sums(keys: tuple, rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial sums for the pairs of one pair of source blocks over one block of terms.

    A pair's sum over all kept terms as if neither source had any (given once, with the first block of terms), and for each
    term that either has |p - q| - |p0 - q0|.
    """
    left, right = (groups[groups.of_block == b].sort_values("of_sid") for b in (keys[1], keys[2]))
    p0, q0 = left.p0.to_numpy(), right.p0.to_numpy()
    base = np.abs(p0[:, None] - q0)
    total = base * left.terms.to_numpy()[:, None] if keys[3] == 0 else np.zeros(base.shape, np.int64)
    if len(rows):
        term, _ = pd.factorize(rows.term)
        n, block, p = int(term.max()) + 1, rows.block.to_numpy(), rows.p.to_numpy()
        sid = rows.sid.to_numpy() - np.where(block == keys[1], left.of_sid.min(), right.of_sid.min())
        # Each source's share of each term of the block, and which sources of the left have a term.
        pm, qm, has = np.tile(p0, (n, 1)), np.tile(q0, (n, 1)), np.zeros((n, len(p0)), bool)
        ours, theirs = np.flatnonzero(block == keys[1]), np.flatnonzero(block == keys[2])
        pm[term[ours], sid[ours]], qm[term[theirs], sid[theirs]], has[term[ours], sid[ours]] = p[ours], p[theirs], True
        for a in range(len(p0)):
            # A left source's postings against all sources of the right, then the right's postings of terms that it has not.
            own = np.flatnonzero(has[:, a])
            total[a] += np.abs(pm[own, a, None] - qm[own]).sum(axis=0) - len(own) * base[a]
            rest = theirs[~has[term[theirs], a]]
            np.add.at(total[a], sid[rest], np.abs(p0[a] - p[rest]) - base[a, sid[rest]])
    a, b = np.indices(total.shape).reshape(2, -1)
    out = pd.DataFrame({"lang": keys[0], "a": left.of_sid.to_numpy()[a], "b": right.of_sid.to_numpy()[b], "value": total.reshape(-1)})
    return out[out.a < out.b] if keys[1] == keys[2] else out


def differences(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each pair of a language's sources, a before b: the sum over all kept terms of what their shares
    differ by. ``groups`` has each group's number within its language, ``found`` each posting's share."""
    terms = max(1, -(-found.select("lang", "term").distinct().count() // TERMS))
    numbered = groups.withColumn("block", F.floor(F.col("sid") / SOURCES).cast("int"))
    blocks = numbered.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    # A source's rows go to each pair of blocks that its own is in.
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))))
    sent = materialize(numbered.join(blocks, "lang").withColumn("to", pairs), "blocks")
    rows = found.join(sent.select("lang", "source", "sid", "block", "to"), ["lang", "source"]).select("lang", "to.i", "to.j", F.pmod(F.xxhash64("term"), F.lit(terms)).cast("int").alias("part"), "block", "sid", "term", "p")
    every = sent.select(F.col("lang").alias("of_lang"), F.col("to.i").alias("of_i"), F.col("to.j").alias("of_j"), F.explode(F.sequence(F.lit(0), F.lit(terms - 1))).alias("of_part"), F.col("block").alias("of_block"), F.col("sid").alias("of_sid"), "p0", "terms")
    both = rows.groupBy("lang", "i", "j", "part").cogroup(every.groupBy("of_lang", "of_i", "of_j", "of_part"))
    return both.applyInPandas(_sums, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group of rows of one language and source.

    Part ``pair`` ranks the language's other sources by how much their shares of the kept terms differ from the group's, all of
    them; part ``term`` the kept terms whose share in the group is above that in the language, the first ``most_terms``. Higher
    values come first, ties by the item's bytes. Nulls are empty texts, languages and sources. A language without kept terms
    has pairs of value 0 and no terms; one with a single source has no pairs; an empty table gives an empty one. Repeated rows
    are documents of their own.
    """
    flat = _flat(docs, lang, source, text)
    kept = kept_terms(flat, least_docs)
    found = postings(flat, kept)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = flat.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("terms", zero).alias("terms"), F.coalesce("total", zero).alias("total"), number.alias("sid"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)), "groups")
    by_term = found.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    shared = materialize(found.join(groups.select("lang", "source", "terms", "total"), ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")
    apart = differences(shared, groups)
    names = groups.select("lang", "sid", "source")
    named = apart.join(names.select("lang", F.col("sid").alias("a"), F.col("source").alias("one")), ["lang", "a"]).join(names.select("lang", F.col("sid").alias("b"), F.col("source").alias("two")), ["lang", "b"])
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = named.withColumn("of", both).select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value").withColumn("rank", F.row_number().over(order))
    usual = by_term.join(langs, "lang").join(sizes, "lang").select("lang", "term", share(F.col("all_n"), F.col("all_total"), F.col("terms")).alias("q"))
    above = shared.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms))


def oracle() -> str:
    """SQL of ``audit`` over ``documents``."""
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) w JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(n.total, 0) + 5 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)) AS q
  FROM s JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM s GROUP BY lang) USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS two, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.one = a.source AND x.two = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
