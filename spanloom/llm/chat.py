"""Chat formatting with typed content parts.

A visitor flattens a turn's parts (text, image, audio, document) in order: text is escaped, anything else becomes a
placeholder whose attachment reference and expanded token count are recorded. Turns are written as

    <|im_start|>role \\n content <|im_end|> \\n

Control strings all begin with ``<|``. In texts, any ``<``, tildes, ``|`` gets one tilde more, so no text holds a control
string and taking one tilde away restores it. Only placeholders and turn marks hold ``<|``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows

#: The template's control strings.
TURN, STOP, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(~*)\|"), re.compile(r"<~(~*)\|")
_MARK = re.compile(r"<\|(\w+)\|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SPAN = "struct<start:long,stop:long>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,at:long,tokens:long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<~\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


@dataclass
class Flat:
    """A turn under construction: ``at`` counts code points from the turn's start."""

    pieces: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, piece: str, learned: bool = False) -> None:
        if learned and piece:
            self.loss.append((self.at, self.at + len(piece)))
        self.pieces.append(piece)
        self.at += len(piece)


class Visitor:
    """Flattens the parts of one turn. Token counts: an image costs one token a 28-pixel tile, audio 25 a second, a document 300 a page."""

    tile, per_second, per_page = 28, 25, 300

    def turn(self, role: str | None, parts: list[dict]) -> Flat:
        flat = Flat()
        flat.put(TURN + escape(role or "").replace("\n", LINE) + "\n")
        for i, part in enumerate(parts):
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(flat, part, i, role == "assistant")
        flat.put(STOP + "\n")
        return flat

    def visit_text(self, flat: Flat, part: dict, i: int, learned: bool) -> None:
        flat.put(escape(part.get("text") or ""), learned)

    def visit_image(self, flat: Flat, part: dict, i: int, learned: bool) -> None:
        self.attach(flat, part, i, ceil((part.get("width") or 0) / self.tile) * ceil((part.get("height") or 0) / self.tile))

    def visit_audio(self, flat: Flat, part: dict, i: int, learned: bool) -> None:
        self.attach(flat, part, i, ceil((part.get("seconds") or 0) * self.per_second))

    def visit_document(self, flat: Flat, part: dict, i: int, learned: bool) -> None:
        self.attach(flat, part, i, (part.get("pages") or 0) * self.per_page)

    def visit_unknown(self, flat: Flat, part: dict, i: int, learned: bool) -> None:
        self.attach(flat, part | {"type": "unknown"}, i, 0)

    def attach(self, flat: Flat, part: dict, i: int, tokens: int) -> None:
        """A placeholder stands for at least one token."""
        flat.attachments.append({"part": i, "kind": part["type"], "ref": part.get("ref"), "at": flat.at, "tokens": max(1, tokens)})
        flat.put(f"<|{part['type']}|>")


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text; placeholders are left out of the texts."""
    out = []
    for chunk in formatted.split(TURN)[1:]:
        head, _, rest = chunk.partition("\n")
        content = rest[: rest.rindex(STOP)]
        out.append((unescape(head.replace(LINE, "\n")), unescape(_MARK.sub("", content))))
    return out


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """(conv, turn, formatted, loss, attachments): each row formatted by itself, so a conversation of any length costs no group.

    ``parts`` names an array of ``PART`` structs; without it ``text`` is the only part. Null roles and texts count as empty,
    null parts as none. Loss spans and attachment places count code points from the turn's start.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (conv, turn)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor()
        for batch in batches:
            flats = [visitor.turn(r, [p for p in ps or [] if p] if parts else [{"type": "text", "text": ps}]) for r, ps in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts = pa.array(["".join(f.pieces) for f in flats], pa.string())
            loss = pa.array([[{"start": a, "stop": b} for a, b in f.loss] for f in flats], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            found = pa.array([f.attachments for f in flats], pa.list_(pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, loss, found], names=["conv", "turn", "formatted", "loss", "attachments"])

    content = F.col(parts).cast(f"array<{PART}>") if parts else F.col(text)
    picked = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), content.alias("content"))
    out = map_rows(picked, run, f"conv {kinds[conv]}, turn {kinds[turn]}, formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>")
    return out.withColumnsRenamed({"conv": conv, "turn": turn})


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", **columns) -> DataFrame:
    """(conv, formatted, loss, attachments): whole conversations in turn order, places counted from the conversation's start.

    For conversations that fit a row; ``digests`` reads conversations of any length.
    """
    turns = format_turns(rows, conv, turn, **columns)
    one = F.struct(F.col(turn).alias("turn"), "formatted", "loss", "attachments")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("loss"), F.array().cast(f"array<{ATTACHMENT}>").alias("attachments"))

    def step(a, t):
        loss = F.transform(t["loss"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["stop"] + a["at"]).alias("stop")))
        found = F.transform(t["attachments"], lambda x: F.struct(x["part"].alias("part"), x["kind"].alias("kind"), x["ref"].alias("ref"), (x["at"] + a["at"]).alias("at"), x["tokens"].alias("tokens")))
        return F.struct((a["at"] + F.length(t["formatted"])).alias("at"), F.concat(a["loss"], loss).alias("loss"), F.concat(a["attachments"], found).alias("attachments"))

    grouped = turns.groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    summed = grouped.select(conv, F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"), F.aggregate("turns", zero, step).alias("sums"))
    return summed.select(conv, "formatted", "sums.loss", "sums.attachments")


class _Fold:
    def __init__(self, conv: object):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss, self.attached, self.tokens = hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, formatted: str, loss: list[dict], attachments: list[dict]) -> None:
        for role, text in read(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in loss:
            learned = unescape(formatted[s["start"] : s["stop"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(formatted)
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens)


def digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens), read back from formatted turns.

    Turns of a conversation meet by shuffle, are sorted there (on disk if need be) and pass one by one through running
    digests: memory is constant however long a conversation is. Equal turn numbers are taken in the order of their output.
    Null conversation ids form one conversation.
    """
    kind = turns.schema[conv].dataType.simpleString()
    arrow = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv_type = None, None

        def out(folds: list[_Fold]) -> pa.RecordBatch:
            cols = list(zip(*(f.row() for f in folds), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], conv_type), *(pa.array(c, f.type) for c, f in zip(cols[1:], arrow, strict=True))], names=["conv", *arrow.names])

        for batch in batches:
            done, conv_type = [], batch.schema.field(0).type
            for c, formatted, loss, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if fold is None or c != fold.conv:
                    done += [fold] if fold else []
                    fold = _Fold(c)
                fold.add(formatted, loss, found)
            if done:
                yield out(done)
        if fold:
            yield out([fold])

    met = turns.repartition(F.col(conv)).sortWithinPartitions(conv, turn, "formatted").select(F.col(conv).alias("conv"), "formatted", "loss", "attachments")
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"
    return map_rows(met, run, schema).withColumnRenamed("conv", conv)
