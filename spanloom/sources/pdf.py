"""PDF text level: content-stream operations, character maps, page text, and paragraphs from placed lines.

Opening files and drawing are left to a PDF library; what it yields (streams, maps, placed lines) is worked on here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How close lines of a paragraph stand (points), and the escapes of literal strings.
LEFT, SIZE, PITCH, FIRST_PITCH, RIGHT = 1.0, 0.6, 1.5, 2.0, 4.0
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
_BLANK = rb"[\x00\t\n\f\r ]"
_TOKEN = re.compile(rb"(?P<skip>(?:[\x00\t\n\f\r ]+|%[^\r\n]*)+)|(?P<number>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)|(?P<name>/[^\x00\t\n\f\r ()<>\[\]{}/%]*)|(?P<dict><<)|(?P<hex><[0-9A-Fa-f\x00\t\n\f\r ]*>)|(?P<literal>\()|(?P<open>\[)|(?P<close>\])|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)|(?P<other>.)", re.S)
_IMAGE_END = re.compile(_BLANK + rb"EI(?=" + _BLANK + rb"|\Z)")


@dataclass
class Operation:
    operator: str
    operands: list
    start: int
    end: int


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A bracketed string from just behind its opening bracket: nesting, escapes, octal codes, continued lines."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            if line := re.compile(rb"\r\n|\r|\n").match(data, at):
                at = line.end()
                continue
            out.append(ESCAPES.get(data[at], data[at]))
            at += 1
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def _hex(raw: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def operations(data: bytes) -> list[Operation]:
    """The operations of a content stream with their operands and byte ranges; dictionaries and inline images are passed over."""
    out, stack, at, start = [], [[]], 0, None
    while at < len(data) and (m := _TOKEN.match(data, at)):
        kind, begin, at = m.lastgroup, at, m.end()
        if kind in ("skip", "other"):
            continue
        start = begin if start is None else start
        if kind == "word":
            word = m[0].decode("latin-1")
            if word in ("true", "false", "null"):
                stack[-1].append({"true": True, "false": False}.get(word))
                continue
            if word == "ID" and (end := _IMAGE_END.search(data, at)):
                at, word = end.end(), "EI"
            out.append(Operation(word, stack[0], start, at))
            stack, start = [[]], None
        elif kind == "open":
            stack.append([])
        elif kind == "close":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        elif kind == "dict":
            depth = 1
            for mark in re.compile(rb"<<|>>").finditer(data, at):
                depth += 1 if mark[0] == b"<<" else -1
                at = mark.end()
                if not depth:
                    break
            stack[-1].append({})
        elif kind == "literal":
            value, at = _literal(data, at)
            stack[-1].append(value)
        else:
            stack[-1].append(float(m[0]) if kind == "number" else m[0][1:].decode("latin-1") if kind == "name" else _hex(m[0]))
    return out


@dataclass
class CharacterMap:
    """Codes to text, with the number of bytes a code takes."""

    text: dict[int, str]
    width: int = 2

    @classmethod
    def parse(cls, data: bytes) -> CharacterMap:
        source, out = data.decode("latin-1"), {}
        said = lambda h: bytes.fromhex(h[: len(h) // 4 * 4]).decode("utf-16-be", "replace")
        spaces = re.search(r"begincodespacerange\s*<([0-9A-Fa-f]+)>", source)
        code, target = r"<([0-9A-Fa-f]+)>\s*", r"<([0-9A-Fa-f]*)>"
        for body in re.findall(r"beginbfchar(.*?)endbfchar", source, re.S):
            out |= {int(c, 16): said(t) for c, t in re.findall(code + target, body)}
        for body in re.findall(r"beginbfrange(.*?)endbfrange", source, re.S):
            for lo, hi, t in re.findall(code + code + target, body):
                first = said(t)
                if first:
                    out |= {int(lo, 16) + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(min(65536, int(hi, 16) - int(lo, 16) + 1))}
            for lo, _, items in re.findall(code + code + r"\[(.*?)\]", body, re.S):
                out |= {int(lo, 16) + i: said(t) for i, t in enumerate(re.findall(target, items))}
        return cls(out, max(1, -(-len(spaces[1]) // 2)) if spaces else 2)

    def decode(self, raw: bytes) -> str:
        w = self.width
        return "".join(self.text.get(int.from_bytes(raw[i : i + w]), "") for i in range(0, len(raw) - w + 1, w))


def shown_text(data: bytes, maps: dict[str, CharacterMap]) -> str:
    """Text that a stream shows in order, by the map of the font in force; fonts without a map show nothing."""
    out, font = [], None
    for op in operations(data):
        if op.operator == "Tf" and op.operands:
            font = op.operands[0]
        elif op.operator in ("Tj", "'", '"', "TJ"):
            pieces = [p for x in op.operands for p in (x if isinstance(x, list) else [x]) if isinstance(p, bytes)]
            out.append("".join(maps[font].decode(p) for p in pieces) if font in maps else "")
    return " ".join(t for t in out if t)


def page_text(segments: DataFrame, by: list[str], no: str = "no", text: str = "text") -> DataFrame:
    """Segments with their place in the page's text, segments being joined by one blank."""
    before = Window.partitionBy(*by).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length(text))


def group_lines(lines: list[tuple[float, float, float, float, str]]) -> list[list[int]]:
    """Indices of lines (x, y, width, size, stream) by paragraph: same stream, edge and size, at the pitch its first two lines set."""
    out: list[list[int]] = []
    pitch: float | None = None
    for i, (x, y, _, size, stream) in enumerate(lines):
        if out:
            px, py, _, psize, pstream = lines[out[-1][-1]]
            down = py - y
            fits = down < size * FIRST_PITCH if pitch is None else abs(down - pitch) <= PITCH
            if stream == pstream and abs(x - px) <= LEFT and abs(size - psize) <= SIZE and down > 0 and fits:
                pitch = down if pitch is None else pitch
                out[-1].append(i)
                continue
        out.append([i])
        pitch = None
    return out


def justified(lines: list[tuple[float, float, float, float, str]]) -> bool:
    """Do all lines but the last end at one edge?"""
    ends = [x + w for x, _, w, _, _ in lines[:-1]]
    return len(ends) > 1 and max(ends) - min(ends) <= RIGHT


def paragraphs(lines: DataFrame, by: list[str], no: str = "no") -> DataFrame:
    """(*by, no, paragraph, justified) for placed lines (x, y, width, size, stream) of each page."""
    placed = ["x", "y", "width", "size", "stream"]

    @F.pandas_udf("array<struct<paragraph:int,justified:boolean>>")
    def grouped(pages: pd.Series) -> pd.Series:
        made = []
        for page in pages:
            rows = [tuple(line[c] for c in placed) for line in page]
            found = [None] * len(rows)
            for k, members in enumerate(group_lines(rows)):
                even = justified([rows[j] for j in members])
                for i in members:
                    found[i] = {"paragraph": k, "justified": even}
            made.append(found)
        return pd.Series(made)

    # A page's lines travel in one row, so thousands of pages share a batch.
    packed = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), *placed))).alias("_lines"))
    each = packed.withColumn("_found", grouped("_lines")).select(*by, F.explode(F.arrays_zip("_lines", "_found")).alias("_l"))
    return each.select(*by, F.col("_l._lines.no").alias(no), "_l._found.paragraph", "_l._found.justified")


def segment_edits(segments: list[tuple[int, int]], edits: list[tuple[int, int, str]]) -> dict[int, list[tuple[int, int, str]]]:
    """Edits of a page's text by segment, in the segment's own places: the replacement goes where the edit starts, the other segments lose their part."""
    out: dict[int, list[tuple[int, int, str]]] = {}
    for start, end, new in sorted(edits):
        first = True
        for i, (a, b) in enumerate(segments):
            lo, hi = max(a, start), min(b, end)
            if lo < hi:
                out.setdefault(i, []).append((lo - a, hi - a, new if first else ""))
                first = False
    return out


def streams(pages: DataFrame, by: list[str], maps: dict[str, CharacterMap], content: str = "content") -> DataFrame:
    """(*by, text): what each page's content stream shows."""
    kinds = [(c, pages.schema[c].dataType.simpleString()) for c in by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(*keys, shown_text(bytes(raw or b""), maps)) for *keys, raw in frame.itertuples(index=False)], columns=[*by, "text"])

    return pages.select(*by, content).mapInPandas(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), "text string"]))
