"""Plumbing around a token classifier: sub-word tokens, windows, votes, spans. The model itself is a function that is passed in."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the usual encoder inputs.
WINDOW, OVERLAP, SPECIALS, LONGEST_WORD = 512, 128, 2, 100


def basic_tokens(text: str) -> list[tuple[int, int]]:
    """Word spans: blanks and control characters part, each punctuation mark or symbol stands alone."""
    out, start = [], None
    for i, c in enumerate(text):
        blank = c.isspace() or unicodedata.category(c) == "Cc" or c == "�"
        mark = not blank and (33 <= ord(c) < 127 and not c.isalnum() or unicodedata.category(c)[0] in "PS")
        if (blank or mark) and start is not None:
            out.append((start, i))
            start = None
        if mark:
            out.append((i, i + 1))
        elif not blank and start is None:
            start = i
    return out + ([(start, len(text))] if start is not None else [])


class WordPiece:
    """Greedy longest-match sub-words; a word with no full cover is unknown as a whole."""

    def __init__(self, vocabulary: dict[str, int], lowercase: bool = False, unknown: str = "[UNK]", prefix: str = "##"):
        self.ids, self.lowercase, self.unknown, self.prefix = vocabulary, lowercase, unknown, prefix

    @classmethod
    def from_json(cls, text: str) -> WordPiece:
        """A tokenizer file; one that strips accents cannot serve accented languages and is refused."""
        file = json.loads(text)
        rules = file.get("normalizer") or {}
        lowercase = bool(rules.get("lowercase"))
        if rules.get("strip_accents") if rules.get("strip_accents") is not None else lowercase:
            raise ValueError("this vocabulary was made without accents")
        return cls(file["model"]["vocab"], lowercase, file["model"].get("unk_token", "[UNK]"), file["model"].get("continuing_subword_prefix", "##"))

    def pieces(self, word: str) -> list[tuple[str, int, int]]:
        """(piece, start, end) within the word."""
        raw, out, at = word.lower() if self.lowercase else word, [], 0
        if len(raw) > LONGEST_WORD:
            return [(self.unknown, 0, len(word))]
        while at < len(raw):
            end = next((e for e in range(len(raw), at, -1) if (self.prefix if at else "") + raw[at:e] in self.ids), None)
            if end is None:
                return [(self.unknown, 0, len(word))]
            out.append(((self.prefix if at else "") + raw[at:end], at, end))
            at = end
        return out

    def tokenize(self, text: str) -> list[tuple[int, int, str, int, int, bool]]:
        """(word_no, id, piece, start, end, first of its word)."""
        return [(w, self.ids.get(p, 0), p, a + s, a + e, i == 0) for w, (a, b) in enumerate(basic_tokens(text)) for i, (p, s, e) in enumerate(self.pieces(text[a:b]))]


def tokenize(units: DataFrame, by: list[str], tokenizer: WordPiece, text: str = "text") -> DataFrame:
    kinds = [(c, units.schema[c].dataType.simpleString()) for c in by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*keys, n, *t) for *keys, value in frame.itertuples(index=False) for n, t in enumerate(tokenizer.tokenize(value or ""))]
            yield pd.DataFrame(rows, columns=[*by, "token_no", "word_no", "id", "piece", "start", "end", "first"])

    return units.select(*by, text).mapInPandas(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), "token_no int, word_no int, id int, piece string, start int, end int, first boolean"]))


def token_windows(docs: DataFrame, tokens: str, keep: list[str], size: int = WINDOW, overlap: int = OVERLAP, specials: int = SPECIALS) -> DataFrame:
    """(*keep, window_no, first, tokens): overlapping slices of a token array that cover it; empty arrays have none."""
    body = size - specials
    step = body - overlap if body > overlap else body
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - body) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    each = docs.select(*keep, F.col(tokens).alias("_tokens"), F.posexplode(starts).alias("window_no", "first"))
    return each.select(*keep, "window_no", "first", F.slice("_tokens", F.col("first") + 1, F.lit(body)).alias("tokens"))


def best_votes(votes: DataFrame, by: list[str], word: str = "word_no") -> DataFrame:
    """Of a word's votes over several windows the most certain one; the earliest window breaks ties."""
    certainty = F.struct(F.col("score"), (-F.col("window_no")).alias("w"))
    return votes.groupBy(*by, word).agg(*(F.max_by(c, certainty).alias(c) for c in ("label", "score", "start", "end")))


def group_spans(words: DataFrame, by: list[str], word: str = "word_no", line: str | None = None, least: float = 0.5) -> DataFrame:
    """(*by, type, start, end, score, n_words): runs of neighbouring words of one type; ``B-`` begins anew, a line's end closes. The lowest score counts and must reach ``least``."""
    order = Window.partitionBy(*by).orderBy(word)
    tagged = words.where("label <> 'O'").withColumns({"type": F.regexp_replace("label", "^[BI]-", ""), "_begin": F.startswith(F.col("label"), F.lit("B-"))})
    follows = (F.lag("type").over(order) == F.col("type")) & ~F.col("_begin") & (F.lag(word).over(order) == F.col(word) - 1)
    if line:
        follows = follows & (F.lag(line).over(order) == F.col(line))
    island = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = tagged.withColumn("_island", island).groupBy(*by, "_island").agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"), F.count("*").alias("n_words"))
    return spans.where(F.col("score") >= least).drop("_island")


def unmapped(spans: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Counts of types that no label stands for."""
    return spans.where(~F.col("type").isin(*mapping)).groupBy("type").count()


def chunks(text: str, size: int = 700, overlap: int = 150, back: int = 220) -> list[tuple[int, int]]:
    """Text spans of about ``size`` that end with a sentence where one ends near."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            stop = max(text.rfind(c, max(at + 1, end - back), end) for c in ".!?\n")
            end = stop + 1 if stop > at else end
        out.append((at, end))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def align(pieces: list[str], text: str, ahead: int = 40) -> list[tuple[int, int] | None]:
    """Places of pieces in a text, looking a little ahead; None where one is not found."""
    out, at = [], 0
    for p in pieces:
        found = text.find(p, at, at + ahead + len(p)) if p else -1
        out.append((found, found + len(p)) if found >= 0 else None)
        at = found + len(p) if found >= 0 else at
    return out
