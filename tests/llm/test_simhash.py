"""What keeps groups of near copies from costing the square of their size."""

import random

import numpy as np

from spanloom.llm import simhash
from spanloom.llm.common import words


def test_no_more_parities_differ_than_hashes():
    r = np.random.default_rng(5)
    for size in (1, 40, 400, 4000):
        base = np.unique(r.integers(0, 1 << 64, size, dtype=np.uint64))
        for share in (0.0, 0.05, 0.5, 1.0):
            other = np.unique(np.concatenate([base[r.random(len(base)) >= share], r.integers(0, 1 << 64, int(size * share), dtype=np.uint64)]))
            differ = int(np.bitwise_count(simhash.parities(base).view(np.uint64) ^ simhash.parities(other).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(base, other))
            assert share or not differ


def test_edited_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    """300 copies with none to six words changed, most without a link: few of their pairs are made, and no link is lost."""
    r = random.Random(41)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        text = [*base]
        for at in r.sample(range(len(base)), r.choice([0, 1, 2, 3, 3, 3, 4, 5, 6])):
            text[at] = f"x{r.randint(0, 10**6)}"
        texts.append(" ".join(text))
    made, write = [], simhash.materialize

    def counted(df, name="step"):
        out = write(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id for x in simhash.deduplicate(rows).collect()}
    sets = [set(simhash.shingle_hashes(words(t.encode()), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == set(root) and len(got) > 50
    assert made[-1] < 3 * len(texts), made
