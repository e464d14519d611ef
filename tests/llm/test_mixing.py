"""What keeps learning cheap."""

import numpy as np

from spanloom.llm import mixing


def test_pairs_are_fetched_whole_and_apart_from_their_table():
    table = np.arange(20, dtype=np.float32).reshape(10, 2)
    table.flags.writeable = False
    at = np.array([3, 0, 9, 3])
    got = mixing._pairs(table, at)
    assert (got == table[at]).all() and got.dtype == np.float32 and mixing._pairs(table, at[:0]).shape == (0, 2)
    got.reshape(-1)[0] = 99
    assert table[3, 0] == 6


def test_words_of_a_stretch_have_their_bytes_and_counts_at_hand():
    """What learning reads without hashing or a lookup is what a stream made of those words would find."""
    batch, classes, n = [b"", b"the", b"thenceforth", b"thenceforward", b"thence", b"\xc3\xa9t\xc3\xa9s", b"thence"], np.array([0, 0, 0, 1, 1, 0, 0]), np.array([4.0, 9.0, 2.0, 3.0, 1.0, 5.0, 7.0])
    prefixes = mixing.Prefixes(batch, classes, n)
    for part in (np.array([5, 2, 6, 0, 3]), np.array([1, 0])):
        stream, times, rows = prefixes.words(part)
        want = mixing.Stream([batch[i] for i in part], classes[part])
        assert bytes(stream.bytes) == bytes(want.bytes) and all((a == b).all() for a, b in zip(stream.contexts, want.contexts, strict=True))
        assert (times == n[part][want.owner]).all()
        far = want.place >= mixing.SHARED
        for (node, _), row in zip(want.bits(), rows, strict=True):
            assert (prefixes.counts[row] == prefixes.find(want.names(node))[far]).all() and (prefixes.counts[row].sum(axis=1) > 0).all()


def test_prefixes_not_seen_are_looked_up_once():
    bits = mixing.table_bits(4)
    tables, batch, n = mixing.new_tables(bits), [b"the", b"thenceforth", b""], np.array([9.0, 2.0, 4.0])
    mixing.add_counts(tables, bits, batch, np.zeros(3, int), n)
    prefixes = mixing.Prefixes(batch, np.zeros(3, int), n)
    model = mixing.Model.of(tables, bits, mixing.start_weights(), np.zeros((256, mixing.BUCKETS, 2)))
    asked, find = [], prefixes.index.find
    prefixes.index.find = lambda names: asked.append(len(names)) or find(names)
    stream = mixing.Stream([b"thenceforth", b"unheard-of"], np.zeros(2))
    model.log10_bytes(stream, np.arange(len(stream.bytes)), prefixes)
    far = len(b"thenceforth ") + len(b"unheard-of ") - 2 * mixing.SHARED
    assert asked == [far] + 7 * [len(b"thenceforth ") - mixing.SHARED]
