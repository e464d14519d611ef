"""Hard negatives against brute force in whole numbers: varied and equal norms, ties, odd and huge components, many buckets."""

import math
import random

import duckdb
import numpy as np
import pytest

from spanloom.llm import negatives, queries
from spanloom.llm.negatives import F

SCHEMA = "vec_id long, embedding array<float>, label int, key string, norm double"


def brute(rows, every=5):
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[i] = (label, [math.floor(256 * float(np.float32(x))) for x in v])
    clip = lambda x, n: max(-n, min(n, x))
    out = set()
    for a in (i for i in whole if i % every == 0):
        score = lambda i: clip(sum(x * y for x, y in zip(whole[a][1], whole[i][1], strict=False)), 10**30)  # noqa: E731, B023
        scores = {i: score(i) for i in whole if i != a}
        best = sorted((-s, i) for i, s in scores.items() if whole[i][0] == whole[a][0])[:5]
        for minus, p in best:
            fit = sorted((-s, i) for i, s in scores.items() if whole[i][0] != whole[a][0] and -50 * minus <= 100 * s <= -95 * minus)[:3]
            out |= {(a, p, k, i, clip(-minus, 2**63 - 1), clip(-s, 2**63 - 1)) for k, (s, i) in enumerate(fit, 1)}
    return out


def mined(spark, rows, every=5, parts=3):
    table = spark.createDataFrame([(*r, "k", 0.5) for r in rows], SCHEMA).repartition(parts)
    return [tuple(r) for r in negatives.mine(negatives.usable(table), F.col("key") % every == 0).collect()]


def vectors(n, seed, spread, grid=None):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = [r.gauss(0, 1) for _ in range(6)]
        size = math.exp(r.uniform(-spread, spread)) / math.sqrt(sum(x * x for x in v))
        v = [x * size for x in v]
        out.append((i, [round(x * grid) / grid for x in v] if grid else v, r.choice([0, 0, 0, 1, 2])))
    return out


ODD = [
    (1000, None, 1), (1005, [1.0, None], 1), (1010, [float("nan")], 1), (1015, [float("inf")], 0), (1020, [], 0), (1025, [1.0], 0), (1030, [0.0] * 6, 1), (1035, [2.0] * 9, 0),
    (1040, [1.0] * 6, None), (None, [1.0] * 6, 0), (-5, [0.5] * 6, 0), (1045, [-1.0] * 6, 77),
]


@pytest.mark.parametrize(("spread", "grid"), [(0, None), (2, None), (0.5, 2)])
def test_equals_brute_force(spark, monkeypatch, spread, grid):
    """Norms all alike, far apart, and on a grid so that many scores tie."""
    monkeypatch.setattr(negatives, "BUCKET", 7)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    rows = [*vectors(80, 3, spread, grid), *ODD]
    got = mined(spark, [*rows, rows[0], rows[11], rows[11]])
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_huge_components(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 4, 9, 30]) for _ in range(3)], r.randint(0, 1)) for i in range(60)]
    assert set(mined(spark, rows)) == brute(rows)


def test_one_vector_many_times(spark, monkeypatch):
    """A third of all rows hold one vector: they are parted over buckets, and ties go to smaller keys."""
    monkeypatch.setattr(negatives, "BUCKET", 16)
    base = vectors(60, 4, 0.3)
    rows = [*base, *((1000 + i, base[1][1], i % 2) for i in range(150))]
    assert set(mined(spark, rows, every=100)) == brute(rows, every=100)
    table = spark.createDataFrame([(*r, "k", 0.5) for r in rows], SCHEMA)
    assert max(len(b["keys"]) // 8 for b in negatives.buckets(negatives.usable(table)).collect()) <= 16


def test_buckets_out_of_reach_are_never_met(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 8)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    rows = negatives.usable(spark.createDataFrame([(*r, "k", 0.5) for r in vectors(200, 6, 3)], SCHEMA))
    index = negatives.Index(rows)
    anchors = rows.where("key % 50 = 0")
    least = {r.key: 0.5 * r.norm * max(index.tops.values()) for r in anchors.collect()}
    lo = F.coalesce(*(F.when(F.col("key") == k, F.array(F.lit(int(x)).cast("decimal(38,0)"))) for k, x in least.items()))
    search = negatives.Search(1, 3, False)
    blocks = search.blocks(anchors.withColumns({"lo": lo, "hi": negatives._limits(1, negatives.ENDLESS), "kth": negatives._limits(1, -negatives.ENDLESS)}))
    (block, *_) = blocks.collect()
    met = [k for k, top in index.tops.items() if top * negatives.SLACK >= block.reach]
    assert 0 < len(met) < len(index.tops) / 2


def test_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(5, None, 1)]) == [] and mined(spark, [(5, [1.0], 1)]) == []


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = queries.QUERIES["op13_negatives"](spark, sf)
    got = sorted(map(tuple, df.collect()))
    assert got and got == sorted(con.execute(queries.SQL["op13_negatives"]).fetchall())
