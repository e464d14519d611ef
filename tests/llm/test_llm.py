"""The training-data operators against brute force on small tables: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from spanloom.llm import bpe, chat, decontaminate, graph, html, mixing, quality, queries, sharding, simhash, tokencount, toxicity
from spanloom.llm.common import words

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, node long, kept boolean"


def docs(spark, texts, start=0):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i + start, t, "en", "s", None, "w", "k", 1, True) for i, t in enumerate(texts)], DOC)


def sample(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["th", "er", "on", "é", "ra", "li"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(n)]


ODD = [None, "", " \n\t", "A", "ab " * 3000, "x" * 50_000, "É b\x1cc", "<|endoftext|> a", "same text here", "same text here"]


# 1


def test_scores_have_exact_bases(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COMMON", 50)
    texts = [*sample(80), *ODD]
    rows = mixing.score(docs(spark, texts)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    of = lambda t: [*words((t or "").encode()), b""]
    counts = Counter(w for i, t in enumerate(texts) if not held(i) for w in of(t))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        ws = of(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_word_model_is_a_distribution():
    """The bytes that may follow a prefix have probabilities that sum to one, before and beyond the dense tables' reach."""
    import numpy as np

    bits = mixing.table_bits(4)
    tables = mixing.new_tables(bits)
    batch, classes, n = [b"the", b"thence", b"thenceforth", b""], np.zeros(4, int), np.array([9.0, 3.0, 2.0, 4.0])
    mixing.add_counts(tables, bits, batch, classes, n)
    learner, prefixes = mixing.Learner(tables, bits), mixing.Prefixes(batch, classes, n)
    learner.run(iter([(batch, n[:, None])]))
    model = mixing.Model.of(tables, bits, learner.weights, learner.map)
    for stem in (b"th", b"thencef"):
        end = np.array([len(stem)])
        total = sum(10 ** model.log10_bytes(mixing.Stream([stem + bytes([b])], np.zeros(1)), end, prefixes)[0] for b in range(256) if b != 32)
        total += 10 ** model.log10_bytes(mixing.Stream([stem], np.zeros(1)), end, prefixes)[0]
        assert total == pytest.approx(1, abs=1e-5)


def test_prefix_counts_equal_brute_force():
    import numpy as np

    r = random.Random(3)
    batch = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 12))).encode() for _ in range(200)})
    n = np.array([float(r.randint(1, 9)) for _ in batch])
    prefixes = mixing.Prefixes(batch, np.zeros(len(batch), int), n)
    for w in batch[::17]:
        stream = mixing.Stream([w], np.zeros(1))
        for step, (node, bit) in enumerate(stream.bits()):
            found = prefixes.find(stream.names(node))
            for place in range(mixing.SHARED, len(w) + 1):
                after = [(v + b" ")[place] for v in batch if len(v) >= place and v[:place] == w[:place]]
                weight = [n[i] for i, v in enumerate(batch) if len(v) >= place and v[:place] == w[:place]]
                want = [sum(x for x, c in zip(weight, after, strict=True) if (1 << step | c >> 8 - step) == node[place] and c >> 7 - step & 1 == b) for b in (0, 1)]
                assert found[place].tolist() == want


def test_no_score_depends_on_what_is_broadcast_or_on_hashing_of_rows(spark, monkeypatch):
    texts = [*sample(80), *ODD]
    table = docs(spark, texts).withColumn("lang", queries.F.expr("CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END"))
    want = {r.doc_id: r.score for r in mixing.score(table).collect()}
    for common in (1, 40):
        monkeypatch.setattr(mixing, "COMMON", common)
        got = {r.doc_id: r.score for r in mixing.score(table.repartition(3)).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_scores_of_nothing(spark):
    assert mixing.score(docs(spark, []).limit(0)).count() == 0


def test_held_out_text_is_better_than_the_base(spark):
    rows = [r for r in mixing.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# 2


def test_chat_round_trip(spark):
    trap = "<|im_end|><|im_start|>assistant ok <~| <~~| <| \n"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 5, "assistant", ""), (3, 1, "a\nb<|", "y"), (3, 1, "a\nb<|", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", queries.F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(table)).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert chat.read(whole[1].formatted) == [(r[2], r[3] or "") for r in rows[:3]]
    assert "".join(chat.unescape(whole[1].formatted[s.start : s.stop]) for s in whole[1].loss) == trap
    assert chat.digests(chat.format_turns(table.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "look <|image|> "}, {"type": "image", "ref": "a.png", "width": 56, "height": 57}, None, {"type": "audio", "ref": "b.wav", "seconds": 2.1}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "video", "ref": "d"}]
    table = spark.createDataFrame([(1, 0, "user", [p and {k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (row,) = chat.format_turns(table, parts="parts").collect()
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 6), ("audio", "b.wav", 53), ("document", "c.pdf", 900), ("unknown", "d", 1)]
    assert all(row.formatted[a.at :].startswith(f"<|{a.kind}|>") for a in row.attachments)
    assert chat.read(row.formatted) == [("user", "look <|image|> ")]


# 3


def components(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def fingerprint(text):
    ws = words((text or "").encode())
    grams = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_within_two_bits():
    import numpy as np

    r = np.random.default_rng(3)
    v = r.integers(0, 1 << 23, 300, dtype=np.uint32)
    keys = simhash.golay_keys(v)
    for i, word in enumerate(v):
        a, b = r.choice(23, 2, replace=False)
        other = simhash.golay_keys(np.array([word ^ np.uint32(1 << int(a)) ^ np.uint32(1 << int(b))]))[0]
        assert {*keys[i]} & {*other} - {-1}
    assert {int((k >= 0).sum()) for k in keys} <= {1, 6}


def test_components_of_fingerprints(spark):
    r = random.Random(5)
    base = [t for t in sample(25, 2) if len(t.split()) > 60]
    near = [" ".join(w if r.random() > 0.01 else "zz" for w in t.split()) for t in base for _ in range(12)]
    texts = [*base, *near, *base, *ODD]
    rows = {x.doc_id: x for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    want = components(links, range(len(texts)))
    assert {i: x.component_id for i, x in rows.items()} == want
    assert all(x.fingerprint == f"{prints[i]:016x}" for i, x in rows.items())
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in graph.components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


def test_one_of_each_group_stays(spark):
    r = random.Random(9)
    base = [t for t in sample(40, 4) if len(t.split()) > 80]
    near = [" ".join([*t.split()[:-1], f"end{k}"]) for t in base for k in range(r.randint(0, 30))]
    texts = [*base, *near, *base, None, "", " "]
    sets = [set(simhash.shingle_hashes(words((t or "").encode()), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(components(links, range(len(texts))).values())
    out = simhash.deduplicate(docs(spark, texts))
    assert out.columns == docs(spark, ["a"]).columns and {x.doc_id for x in out.collect()} == want
    twice = docs(spark, ["one two three", "one two three"]).withColumn("doc_id", queries.F.lit(1).cast("long"))
    assert simhash.deduplicate(twice).count() == 1


@pytest.mark.parametrize("earlier", [simhash.EARLIER, 1])
def test_copies_with_added_and_removed_passages_are_found(spark, monkeypatch, earlier):
    monkeypatch.setattr(simhash, "EARLIER", earlier)
    r = random.Random(21)
    word = lambda tag: f"{tag}{r.randint(0, 999)}"
    texts = []
    for k in range(60):
        base = [word("w") for _ in range(r.randint(60, 200))]
        more = [word(f"new{k}x") for _ in range(len(base) * r.randint(2, 22) // 100)]
        cut = r.randint(0, len(base))
        texts += [base, [*base, *more], [*base[:cut], *more, *base[cut:]], base[len(more) :]]
    texts = [" ".join(t) for t in texts]
    sets = [set(simhash.shingle_hashes(words(t.encode()), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 60
    assert {x.doc_id for x in simhash.deduplicate(docs(spark, texts)).collect()} == set(components(links, range(len(texts))).values())


def test_very_long_texts_with_a_shingle_in_all_texts(spark):
    """Two texts of 100,000 words with a tenth of it apart, one with half, and 300 texts that share one passage but nothing else."""
    r = random.Random(31)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(100_000)]
    passage = "this very passage stands in each of the texts"
    long = [base, [*base[:95_000], *(f"x{i}" for i in range(5_000))], [*base[:50_000], *(f"y{i}" for i in range(50_000))]]
    texts = [" ".join([*t, passage]) for t in long] + [" ".join([f"t{i}w{k}" for k in range(40)] + [passage]) for i in range(300)]
    assert {x.doc_id for x in simhash.deduplicate(docs(spark, texts)).collect()} == {*range(len(texts))} - {1}


def test_repeated_rows_do_not_cost_other_rows_of_their_key(spark):
    texts = ["one two three four five six", "a b c d e f g", "red green blue black white grey", "red green blue black white grey"]
    keys = [None, None, 7, 7]
    rows = spark.createDataFrame([*zip(keys, texts, strict=True), (7, "sun moon star sky sea land")], "doc_id long, text string")
    got = [(x.doc_id, x.text) for x in simhash.deduplicate(rows).collect()]
    assert sorted(got, key=repr) == sorted({*zip(keys, texts, strict=True), (7, "sun moon star sky sea land")}, key=repr)


# 4


def test_columns_may_have_any_name(spark):
    table = docs(spark, ["one two three four five six", "one two three four five six", None]).selectExpr("*", "1 AS _kept_node", "2 AS kept_key", "3 AS hit_key", "4 AS mark", "5 AS row", "6 AS _row")
    items = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (simhash.deduplicate(table), decontaminate.accept(table, items), quality.accept(table), toxicity.accept(table, labels)):
        assert out.columns == table.columns and out.count() <= 3


def test_measures(spark):
    texts = [*sample(40, 6), *ODD, "a b c a b c", "a a a a a", "x\nx\n \n \ny\nx", "# * $ <b>", "one two three four one two three"]
    got = {x.doc_id: x for x in quality.judged(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k for j in range(len(w) - 2) if runs[w[j], w[j + 1], w[j + 2]] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)), i
        assert x.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (x.kept and x.base_failed)
    assert quality.judged(docs(spark, []).limit(0)).count() == 0


def test_adaptive_limits_keep_the_clean_and_drop_the_odd(spark):
    r = random.Random(8)
    clean = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 999)) for _ in range(90)) for _ in range(400)]
    odd = [" ".join(w + "%%%" for w in t.split()) for t in clean[:60]]
    out = {x.doc_id: x.kept for x in quality.judged(docs(spark, [*clean, *odd])).collect()}
    assert all(out[i] for i in range(400)) and not any(out[i] for i in range(400, 460))
    assert quality.accept(docs(spark, [*clean, *odd])).columns == docs(spark, ["a"]).columns


def test_limits_equal_those_of_exact_quantiles(spark):
    r = random.Random(10)
    rows = []
    for i in range(240):
        lang = r.choice(["en", "de", None])
        ws = [r.choice("abcdefg") * r.randint(1, 9) + (r.choice(["", "", "#"])) for _ in range(r.randint(55, 160))]
        rows.append((i, "\n".join(" ".join(ws[k : k + 9]) for k in range(0, len(ws), 9)), lang, r.choice(["s", "t", None])))
    table = spark.createDataFrame([*rows, (900, None, "en", "s"), (901, "too short", "xx", "s"), rows[0]], "doc_id long, text string, lang string, source string")
    got = [x.asDict() for x in quality.judged(table, keep=("doc_id", "lang", "source")).collect()]
    good = [x | {"n_lines": len(dict((w[0], w[1]) for w in rows)[x["doc_id"]].split("\n"))} for x in got if not x["base_failed"]]
    at = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]

    def limits(part):
        out = {}
        for ratio, (size, events) in quality.CHANCE.items():
            v = [x[ratio] for x in part]
            room = 8 * min(at(v, 0.5) - at(v, 0.05), at(v, 0.95) - at(v, 0.5)) + events / max(1, at([x[size] for x in part], 0.25))
            out[f"{ratio}_max"], out[f"{ratio}_min"] = at(v, 0.5) + room, at(v, 0.5) - room
        return out

    for x in got:
        language = [y for y in good if y["lang"] == x["lang"]]
        want = limits(good)
        for part in (language, [y for y in language if y["source"] == x["source"]]):
            if part:
                own = limits(part)
                want = {c: (len(part) * own[c] + quality.PSEUDO * want[c]) / (len(part) + quality.PSEUDO) for c in want}
        for c in quality.LIMITS:
            assert x[c] == pytest.approx(want[c], rel=1e-9), c
        bad = any(x[c] > want[f"{c}_max"] for c in quality.CHANCE) or x["word_length"] < want["word_length_min"]
        assert x["kept"] == (not x["base_failed"] and not bad)
    assert len({x["symbol_ratio_max"] for x in got}) > 6


# 5


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST, 0])
def test_windows_are_found_whole(spark, most):
    r = random.Random(11)
    items = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(n)) for n in (3, 9, 10, 11, 25, 40, 40)] + [None, "", "...", "Éa b É"]
    texts = [*sample(10), *ODD, items[5], "x " + items[4] + " y " + items[5][40:], items[0].upper(), items[6] * 2, "éa b é", "Éa B É", items[5]]
    table = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, texts), table, max_broadcast=most).collect()
    low = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low)) if w]
    assert len(got) == len(texts)
    for x in got:
        w, hit, ids = split(texts[x.doc_id]), set(), set()
        for item, t in enumerate(items):
            v = split(t)
            for win in [v[i : i + 10] for i in range(max(1, len(v) - 9))] if v else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= {*range(s, s + len(win))}
                        ids.add(str(item))
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    left = decontaminate.accept(docs(spark, texts), table)
    assert {x.doc_id for x in left.collect()} == {x.doc_id for x in got if not x.contaminated} and left.columns == docs(spark, ["a"]).columns


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.n_hit for x in decontaminate.contamination(docs(spark, ["a b", None]), none).collect()] == [0, 0]
    assert decontaminate.contamination(docs(spark, []).limit(0), none).count() == 0


def test_sql_says_the_same(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        assert sorted(map(tuple, df.collect())) == sorted(c.execute(sql).fetchall())


# 6


def test_token_counts(spark):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    scores = tokencount.zipf_scores(tokencount.read_ranks(path))
    texts = [*sample(10), *ODD]
    find = tokencount._FIND

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            paths = [(best[b][0] + scores[word[b:end]], best[b][1] + 1) for b in range(max(0, end - 128), end) if word[b:end] in scores]
            top = max(p[0] for p in paths)
            best.append((top, min(p[1] for p in paths if p[0] > top - 1e-12)))
        return best[-1][1]

    for x in tokencount.token_counts(docs(spark, texts), path).collect():
        t = texts[x.doc_id] or ""
        if len(t) < 20_000:
            assert (x.n_pretokens, x.n_tokens, x.n_bytes) == (len(find(t)), sum(brute(w.encode()) for w in find(t)), len(t.encode()))
    assert tokencount.token_counts(docs(spark, []).limit(0), path).count() == 0


# 7


def test_shards(spark):
    table = docs(spark, [*sample(300), *ODD])
    mapped = sharding.slot_map(sharding.slot_sizes(table), 24)
    rows = sharding.assign(table, mapped).collect()
    load, places = Counter(), {}
    for x in rows:
        load[x.shard] += x["size"]
        places.setdefault(x.shard, []).append(x.slot)
    assert len(rows) == 310 and set(load) == set(range(24))
    assert all(sorted(p) == [*range(len(p))] for p in places.values())
    big = max(x["size"] for x in rows)
    assert max(load.values()) <= max(big, sum(load.values()) / 24 * 1.05 + 200)
    texts = {i: t or "" for i, t in enumerate([*sample(300), *ODD])}
    assert all(x["size"] == len(texts[x.doc_id].encode()) + 8 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) for x in rows)


def test_maps_are_kept_and_edited(spark, tmp_path):
    table = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 97 AS INT)) AS text")
    sizes = sharding.slot_sizes(table)
    first = sharding.slot_map(sizes, 24)
    sharding.store(first, str(tmp_path / "m"))
    second = sharding.slot_map(sizes, 25, sharding.load(spark, str(tmp_path / "m")))
    sharding.store(second, str(tmp_path / "m"))
    a, b = ({x.vslot: (x.shard, x.bytes) for x in sharding.load(spark, str(tmp_path / "m"), v).collect()} for v in (1, 2))
    moved = {v for v in a if a[v][0] != b[v][0]}
    assert 0 < sum(b[v][1] for v in moved) < 0.06 * sum(x for _, x in b.values()) and {b[v][0] for v in moved} >= {24}
    assert sharding.assign(table.limit(0), first).count() == 0


# 8


def test_structure_of_pages():
    page = '<html><body class="nav-open"><header><h1>Site</h1></header><div class="cookie-notice">We use <b>cookies</b></div><div id=content><p>Hello &lt;b&gt; <a href="x">world</a> &amp; co<p class="ad">Buy<p>Second</div><aside>side</aside><form>q</form><div class=comments><article class="comment">c1</article></div><footer>f'
    assert html.parse(page).texts("open") == ["Hello <b> world & co", "Second"]
    page = '<main><article><header><div>By X</div><h1>Title</h1></header><p>One<!-- no --><nav>n</nav><div class="comment">r</div><p>Two <span class="ad">AD</span> end<br>line</p><script>var t="</p>";</script></article></main><div>out</div><p>x &am'
    assert html.parse(page).texts("main") == ["Title", "One", "Two end line"]
    assert html.parse("").blocks == [] and html.parse('a <p title="unbal>text</p> b').texts("open") == ["a", "text", "b"]


def test_hidden_text_goes_and_subjects_stay():
    assert html.parse("<p>one <span hidden>secret</span> two</p>").texts("open") == ["one two"]
    page = '<article><p>A</p><div class="related work"><p>B</p></div><section id="social-effects">C</section><p class="share-price">D</p><div class="notice-board">E</div><div class="ad">F</div></article>'
    assert html.parse(page).blocks == [("main", "A"), ("doubt", "B"), ("doubt", "C"), ("doubt", "D"), ("doubt", "E"), ("chrome", "F")]


def test_parsing_takes_linear_time():
    import time

    for make in (lambda n: "<div>" * n + "x", lambda n: "<div>" * n + "</p></i></section>" * n, lambda n: "<p title=\"x> y " * n, lambda n: "<b class=x>" * n + "x"):
        took = []
        for n in (4_000, 32_000):
            start = time.perf_counter()
            html.parse(make(n))
            took.append(time.perf_counter() - start)
        assert took[1] < 24 * took[0] + 0.5


def test_repeated_runs_equal_brute_force(spark):
    r = random.Random(41)
    phrase = [[f"p{k}t{i}" for i in range(r.randint(4, 14))] for k in range(6)]
    own = [[f"u{r.randint(0, 10**6)}" for _ in range(r.randint(2, 9))] for _ in range(60)]
    pages = []
    for i in range(30):
        parts = [r.choice(phrase) if r.random() < 0.5 else r.choice(own) for _ in range(r.randint(1, 6))]
        pages.append((i, f"http://h{i % 3}.example/{i}", parts))
    rows = [(i, u, "<body>" + "".join(f"<p>{' '.join(x)}</p>" for x in parts) + "</body>") for i, u, parts in pages]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    flat = {i: [t for x in parts for t in x] for i, _, parts in pages}
    for i, _, parts in pages:
        tokens, covered = flat[i], set()
        for a in range(max(1, len(tokens) - html.REPEAT + 1)):
            window = tokens[a : a + html.REPEAT]
            for j in range(i % 3, 30, 3):
                v = flat[j]
                windows = [v[b : b + html.REPEAT] for b in range(max(1, len(v) - html.REPEAT + 1))]
                if v != tokens and window in windows:
                    covered |= {*range(a, a + len(window))}
        left, at = [], 0
        for x in parts:
            left.append(" ".join(t for k, t in enumerate(x, at) if k not in covered))
            at += len(x)
        assert got[i] == "\n".join(t for t in left if t)


def test_doubtful_blocks_of_articles_go_if_the_host_repeats_them(spark):
    page = lambda i: f'<article><p>Body {i}</p><div class="share">Share this on every network</div><div class="social-effects">Effect number {i} of many</div></article>'
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(3)]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Body {i}\nEffect number {i} of many" for i in range(3)}


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    boiler = "Please subscribe to our weekly letter and get news about everything that matters"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>{boiler}</p><p>{body(i)}</p></div></body>") for i in range(3)]
    rows += [(7, "http://h.example/7", f"<article><p>A {boiler}</p></article>"), (8, None, None), (9, "http://x/", ""), (10, "http://other.example/", f"<p>{boiler}</p>"), (2, "http://h.example/2", rows[2][2])]
    got = sorted(map(tuple, html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert [(r[0], r[2]) for r in got] == [(0, body(0)), (1, body(1)), (2, body(2)), (2, body(2)), (7, f"A {boiler}"), (8, ""), (9, ""), (10, boiler)]
    assert all(r[3] == len(r[2]) for r in got)


# 9


def test_toxic_words_and_roots(spark):
    r = random.Random(13)
    plain = sample(400, 21)
    texts, marks = [], []
    for i, t in enumerate(plain):
        toxic = i % 5 == 0
        ws = t.split() or ["a"]
        for _ in range(3 if toxic else 0):
            ws.insert(r.randint(0, len(ws)), r.choice(["moron", "lowei" + r.choice(["ra", "li", "on"])]))
        texts.append(" ".join(ws))
        marks.append(int(toxic))
    table = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(0, 1, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in toxicity.toxicity(table, labels).collect()}
    held = [i for i in range(400) if rows[i].held_out]
    assert len(rows) == 402 and all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    right = sum((rows[i].score >= 0.7) == bool(marks[i]) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows.values())
    kept = toxicity.accept(table, labels)
    assert {x.doc_id for x in kept.collect()} == {i for i, x in rows.items() if not x.predicted} and kept.columns == table.columns


def test_no_ngram_is_dropped_beyond_the_broadcast_size(spark, monkeypatch):
    plain = sample(120, 23)
    texts = [*(t + " moron" * (i % 4 == 0) for i, t in enumerate(plain)), *ODD]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    table = docs(spark, texts)
    want = {x.doc_id: x.score for x in toxicity.toxicity(table, labels).collect()}
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 50)
    monkeypatch.setattr(toxicity, "COMMON", 20)
    got = {x.doc_id: x.score for x in toxicity.toxicity(table, labels).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)
    kept = toxicity.accept(table, labels)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == {i for i, x in want.items() if x < 0.7}


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in toxicity.toxicity(docs(spark, ["a", None]), none).collect()] == [0.0, 0.0]
    assert toxicity.accept(docs(spark, ["a"]), none).count() == 1


# 10


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library = Tokenizer.from_file(path)
    texts = [*sample(20), *ODD, "it's 12,5%\r\n  漢字🙂 ​", "=-" * 9000]
    for x in bpe.round_trip(docs(spark, texts), path).collect():
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    back = {x.doc_id: x.text for x in bpe.decode(bpe.encode(docs(spark, texts), path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(docs(spark, []).limit(0), path).count() == 0


def test_streams_equal_whole_pieces():
    merges = bpe.Merges.from_json(queries.vocabulary())
    r = random.Random(17)
    for letters in ("etaoin", "=-_*", "ab", " "):
        raw = "".join(r.choice(letters) for _ in range(12_000)).encode()
        assert [*merges.stream(raw[i : i + 11] for i in range(0, len(raw), 11))] == merges.merge(raw) == merges._merge_short(raw[:0]) + merges._merge_long(raw)
    for _ in range(500):
        raw = "".join(r.choice("ethrion s") for _ in range(r.randint(0, 40))).encode()
        assert merges._merge_short(raw) == merges._merge_long(raw)


def test_chunks_of_any_size_give_the_library_ids():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.Merges.from_json(path))
    r = random.Random(31)
    bits = ["we're", "they'll", "'v", "'", "e", "l", "  ", "\n\n", " ", "\t", "12", "é", "漢", "!?", "<|endoftext|>", "<|end", "\u3000", "word"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        for chunk in (1, 2, 5, 17):
            assert [i for part in encoder.ids(text, chunk) for i in part] == ids, text


def test_long_runs_pass_through_the_transducer_in_chunks(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LONG", 300)
    path = queries.vocabulary()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.Merges.from_json(path))
    r = random.Random(32)
    for letters in ("etaoin", "=-_*'", "12", " ", " \n\t"):
        for tail in ("", "x", " x", "!", "<|endoftext|>y", "\nz"):
            text = "a'" + "".join(r.choice(letters) for _ in range(4000)) + tail
            parts = [*encoder.ids(text, 512)]
            assert [i for part in parts for i in part] == library.encode(text, add_special_tokens=False).ids
            assert max(map(len, parts)) < 3000


def test_bad_bytes_become_replacement_marks():
    merges = bpe.Merges({bytes([b]): b for b in range(256)}, [], {})
    assert "".join(bpe.Decoder(merges).decode([[0xC3], [0x41, 0xE2], [0x82]])) == b"\xc3A\xe2\x82".decode("utf-8", "replace")


# pipeline


def test_pipeline_takes_nulls_repeats_and_nothing(spark, tmp_path):
    import corpus_pipeline

    real = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, " ".join(f"w{i}" for i in range(80)), None, "s", 1), (7, " ".join(f"v{i}" for i in range(80)), None, "s", 1), (7, " ".join(f"w{i}" for i in range(80)), None, "s", 1)], real.schema)
    for no, table in enumerate((odd.union(odd), real.limit(0))):
        at = tmp_path / str(no)
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
        table.write.parquet(f"{at}/documents.parquet")
        rows = corpus_pipeline.run(spark, str(at)).collect()
        assert len(rows) == (2 if no == 0 else 0) and all(r.n_tokens > 80 for r in rows)


def test_pipeline_runs_and_its_decisions_hold(spark):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = queries.table(spark, DATA, "documents") if before is None else stage(spark, before, DATA)
        after = corpus_pipeline.materialize(after, name)
        assert after.columns == docs_.columns and after.count() <= before.count()
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
        before = after
    hit = decontaminate.contamination(before, queries.table(spark, DATA, "benchmark")).where("contaminated").count()
    assert hit == 0
    final = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert final.count() == before.count() and corpus_pipeline.run(spark, DATA).columns == final.columns
