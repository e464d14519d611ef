"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens; a pre-token's count is the number of tokens on its best path. A task inserts each distinct
pre-token it meets into its trie. A node is a prefix and holds that prefix's best forward score and count, worked out once
from its ancestors' when the node is made; a pre-token's count is stored at its terminal. The trie is emptied when it has
``MAX_NODES``; that changes no count.

The vocabulary is a public one and is not trained here, nor are its scores: they follow Zipf's law over its ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import log

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import PATTERN
from spanloom.llm.common import map_rows

MAX_NODES = 400_000
#: Flattens the rank-frequency curve at its head.
ZIPF_SHIFT = 2.7


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of a ranked vocabulary, by Zipf's law with a shift."""
    total = log(sum(1 / (r + ZIPF_SHIFT) for r in ranks.values()))
    return {t: -log(r + ZIPF_SHIFT) - total for t, r in ranks.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TrieCounter:
    """``scores`` must hold all single bytes. Ties go to the path with fewer tokens, then to the longer last token."""

    def __init__(self, scores: dict[bytes, float]):
        self.backward: dict = {}
        for token, score in scores.items():
            node = self.backward
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = score
        self.clear()

    def clear(self) -> None:
        """The trie: children of each node by (node, byte), and forward scores and counts of nodes; 0 is the root."""
        self.children: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminals: dict[str, int] = {}

    def _forward(self, word: bytes, path: list[int]) -> None:
        """A node for the prefix of ``word`` one byte longer than the path, from the scores of its ancestors."""
        end = len(path)
        node, at, top, n = self.backward, end - 1, None, 0
        while at >= 0 and (node := node.get(word[at])) is not None:
            if (score := node.get(-1)) is not None:
                s, k = self.best[path[at]] + score, self.count[path[at]] + 1
                if top is None or s > top + 1e-12 or (s > top - 1e-12 and k <= n):
                    top, n = s, k
            at -= 1
        self.best.append(top)
        self.count.append(n)

    def insert(self, word: str) -> int:
        """The count of a pre-token, stored at its terminal."""
        raw, path = word.encode(), [0]
        for byte in raw:
            step = path[-1] << 8 | byte
            node = self.children.get(step)
            if node is None:
                node = self.children[step] = len(self.best)
                self._forward(raw, path)
            path.append(node)
        n = self.terminals[word] = self.count[path[-1]]
        return n

    def counts(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        found = _FIND(text)
        if len(self.best) > MAX_NODES:
            self.clear()
        known = [*map(self.terminals.get, found)]
        if None in known:
            known = [self.terminals.get(w) or self.insert(w) if n is None else n for w, n in zip(found, known, strict=True)]
        return len(found), sum(known)


_FIND = regex.compile(PATTERN).findall


def _counter(path: str) -> TrieCounter:
    return TrieCounter(zipf_scores(read_ranks(path)))


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens, n_bytes) of each whole text; null and empty texts count zero. Repeated rows give repeated rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pairs = [*map(counter.counts, texts)]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in ([p[0] for p in pairs], [p[1] for p in pairs], size))], names=["key", "n_pretokens", "n_tokens", "n_bytes"])

    return map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n_pretokens long, n_tokens long, n_bytes long").withColumnRenamed("key", key)
