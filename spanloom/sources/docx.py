"""Office packages written back: edits put into a part's runs, revisions settled, traces of authors removed, residue looked for."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.sources.documents import TEXT_PARTS, PARTS, W

#: Package parts that only say who worked on it, and chunk and marker names of image metadata.
TRACES = re.compile(r"^(docProps/custom\.xml|docProps/thumbnail.*|word/people\.xml|word/comments(Extended|Ids|Extensible)?\.xml)$")
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
PNG_TEXT, JPEG_META = {b"tEXt", b"iTXt", b"zTXt", b"eXIf", b"tIME"}, {0xE1, 0xED}
SHORTEST_NEEDLE = 4
_IN_RUN = {W + tag for tag in ("rPr", "t", "tab", "br", "cr")}
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"


class Overlap(ValueError):
    pass


def _parse(xml: bytes) -> ElementTree.Element:
    for prefix, uri in re.findall(rb'xmlns:([A-Za-z][\w.-]*)="([^"]+)"', xml):
        if not re.fullmatch(rb"ns\d+", prefix):
            ElementTree.register_namespace(prefix.decode(), uri.decode())
    return ElementTree.fromstring(xml)


def _write(root: ElementTree.Element) -> bytes:
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def flat(root: ElementTree.Element) -> tuple[str, list[tuple[int, int, ElementTree.Element]]]:
    """A part's text and where each text element stands in it; deleted text and fallbacks are left out, as in reading."""
    out, places, at = [], [], 0

    def put(text: str, node: ElementTree.Element | None = None) -> None:
        nonlocal at
        if node is not None:
            places.append((at, at + len(text), node))
        out.append(text)
        at += len(text)

    def walk(node: ElementTree.Element, deleted: bool) -> None:
        tag = node.tag.removeprefix(W)
        if tag == "t" and not deleted:
            put(node.text or "", node)
        elif tag in ("tab", "br", "cr"):
            put("\t" if tag == "tab" else "\n")
        for child in node:
            if child.tag != _FALLBACK:
                walk(child, deleted or tag in ("del", "moveFrom"))
        if tag == "p":
            put("\n")

    walk(root, False)
    return "".join(out), places


def apply_edits(xml: bytes, edits: list[tuple[int, int, str]]) -> tuple[bytes, list[tuple[int, int, str]]]:
    """(xml, edits that met no text element): the first element an edit touches takes the replacement, the others lose their part."""
    root = _parse(xml)
    _, places = flat(root)
    ordered = sorted(edits)
    for (_, end, _), (start, _, _) in zip(ordered, ordered[1:], strict=False):
        if start < end:
            raise Overlap(f"edits overlap at {start}")
    missed = []
    for start, end, new in reversed(ordered):
        touched = [(a, b, n) for a, b, n in places if a < end and start < b]
        if not touched:
            missed.append((start, end, new))
        for i, (a, b, node) in enumerate(touched):
            text = node.text or ""
            node.text = text[: max(0, start - a)] + (new if i == 0 else "") + text[min(b, end) - a :]
            node.set(XML_SPACE, "preserve")
    return _write(root), missed


def settle_revisions(xml: bytes, accept: bool = True) -> bytes:
    """Tracked changes taken in or back: what stays loses its frame, what goes loses its content."""
    root = _parse(xml)
    gone, framed = (("del", "moveFrom"), ("ins", "moveTo")) if accept else (("ins", "moveTo"), ("del", "moveFrom"))

    def walk(node: ElementTree.Element) -> None:
        children = []
        for child in list(node):
            walk(child)
            tag = child.tag.removeprefix(W)
            if tag in framed:
                children += list(child)
            elif tag not in gone and not tag.endswith("Change"):
                children.append(child)
        node[:] = children
        if not accept and node.tag == W + "delText":
            node.tag = W + "t"

    walk(root)
    return _write(root)


def strip_editing_marks(xml: bytes) -> bytes:
    """Revision ids and proofing marks say who edited when; text does not change."""
    xml = re.sub(rb'\s+w:rsid\w*="[^"]*"', b"", xml)
    return re.sub(rb"<w:proofErr\b[^>]*/>|<w:rsids>.*?</w:rsids>", b"", xml, flags=re.S)


def merge_runs(xml: bytes) -> bytes:
    """Neighbouring runs of equal properties made one, so that a name is in one text element; the part as it was if its text would
    change. Only runs of properties, texts, tabs and breaks are merged: fields, notes and pictures stay where they are."""
    root = _parse(xml)
    before = flat(root)[0]
    look = lambda run: b"".join(ElementTree.tostring(c) for c in run if c.tag == W + "rPr")
    for parent in list(root.iter()):
        kept: list[ElementTree.Element] = []
        for child in list(parent):
            plain = child.tag == W + "r" and all(c.tag in _IN_RUN for c in child)
            if plain and kept and kept[-1].get("_plain") and look(kept[-1]) == look(child):
                into = kept[-1]
                for piece in (c for c in child if c.tag != W + "rPr"):
                    if piece.tag == W + "t" and len(into) and into[-1].tag == W + "t":
                        into[-1].text = (into[-1].text or "") + (piece.text or "")
                        into[-1].set(XML_SPACE, "preserve")
                    else:
                        into.append(piece)
            else:
                if plain:
                    child.set("_plain", "1")
                kept.append(child)
        parent[:] = kept
    for node in root.iter():
        node.attrib.pop("_plain", None)
    return _write(root) if flat(root)[0] == before else xml


def strip_png(data: bytes) -> bytes:
    out, at = [data[:8]], 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        if data[at + 4 : at + 8] not in PNG_TEXT:
            out.append(data[at : at + 12 + size])
        at += 12 + size
    return b"".join(out)


def strip_jpeg(data: bytes) -> bytes:
    out, at = [data[:2]], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = 2 + int.from_bytes(data[at + 2 : at + 4])
        if data[at + 1] not in JPEG_META:
            out.append(data[at : at + size])
        at += size
    return b"".join([*out, data[at:]])


def strip_image(name: str, data: bytes) -> bytes:
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return strip_png(data)
    return strip_jpeg(data) if data.startswith(b"\xff\xd8") else data


def _properties(name: str, xml: bytes) -> bytes:
    root = _parse(xml)
    for node in root.iter():
        if node is not root and len(node) == 0 and re.search(r"\}(creator|lastModifiedBy|title|subject|description|keywords|category|Company|Manager|revision|created|modified|lastPrinted)$", node.tag):
            node.text = "2000-01-01T00:00:00Z" if node.tag.endswith(("created", "modified", "lastPrinted")) else ""
    return _write(root)


def rewrite(content: bytes, edits: dict[str, list[tuple[int, int, str]]], revisions: str | None = None) -> bytes:
    """A package with its parts edited and its traces gone: entries in order, without dates, parts that only name people left out.

    Open revisions must be settled (``accept`` or ``reject``) or the package is refused.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        dropped = {n for n in source.namelist() if TRACES.search(n)}
        for name in source.namelist():
            if name in dropped:
                continue
            data = source.read(name)
            kind = next((k for k, p in PARTS if re.search(p, name)), "other")
            if kind in TEXT_PARTS:
                if re.search(rb"<w:(ins|del|moveFrom|moveTo)\b", data):
                    if revisions is None:
                        raise ValueError("revisions are open")
                    data = settle_revisions(data, revisions == "accept")
                data = strip_editing_marks(apply_edits(data, edits.get(name, []))[0])
            elif kind in ("core_properties", "app_properties"):
                data = _properties(name, data)
            elif kind == "media":
                data = strip_image(name, data)
            elif kind == "settings":
                data = strip_editing_marks(data)
            elif kind in ("relationships", "content_types"):
                for gone in dropped:
                    base = re.escape(gone.rsplit("/", 1)[-1].encode())
                    data = re.sub(rb"<(?:Relationship|Override)\b[^>]*" + base + rb'"[^>]*/>', b"", data)
            target.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def automaton(needles: Iterable[str]) -> ahocorasick.Automaton | None:
    """One that finds all needles of ``SHORTEST_NEEDLE`` characters or more, in UTF-8 and UTF-16, in bytes read as Latin-1; None if there are none."""
    out = ahocorasick.Automaton()
    for needle in set(needles):
        for encoding in ("utf-8", "utf-16-le") if len(needle) >= SHORTEST_NEEDLE else ():
            key = needle.encode(encoding, "surrogatepass").decode("latin-1")
            out.add_word(key, (*out.get(key, ()), (needle, encoding, len(key))))
    if not len(out):
        return None
    out.make_automaton()
    return out


def count_needles(data: bytes, sought: ahocorasick.Automaton | None) -> Counter[str]:
    """How often each needle is in ``data``; its own occurrences don't overlap, each encoding counts for itself."""
    out: Counter[str] = Counter()
    free: dict[tuple[str, str], int] = {}
    for last, hits in sought.iter(data.decode("latin-1")) if sought else ():
        for needle, encoding, size in hits:
            if last - size + 1 >= free.get((needle, encoding), 0):
                free[needle, encoding] = last + 1
                out[needle] += 1
    return out


def residue(content: bytes, needles: list[str], allowed: dict[str, int] | None = None) -> list[tuple[str, str, int]]:
    """(part, needle, times) of originals left in any part's bytes, UTF-8 or UTF-16, beyond what a reviewer allowed in each part.
    Each part is passed once, whatever the number of needles."""
    found, sought = [], automaton(needles)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            counts = count_needles(z.read(name), sought)
            found += [(name, x, n) for x in dict.fromkeys(needles) if (n := counts[x] - (allowed or {}).get(x, 0)) > 0]
    return found


def residues(files: DataFrame, needles: DataFrame) -> DataFrame:
    """(path, part, needle, excess) over packages (path, content), for needles (path, needle, allowed) of the same path.

    Needles shorter than ``SHORTEST_NEEDLE`` and null needles are not sought; a null ``allowed`` is 0; a needle given twice for a
    path is allowed the larger number. A package that can't be opened has one row with null part, needle and excess.
    """
    wanted = needles.where("needle IS NOT NULL").groupBy(F.col("path").alias("_path"), "needle").agg(F.max(F.coalesce(F.col("allowed").cast("long"), F.lit(0))).alias("allowed"))
    wanted = wanted.groupBy("_path").agg(F.map_from_entries(F.collect_list(F.struct("needle", "allowed"))).alias("wanted"))
    both = files.select("path", "content").join(wanted, F.col("path") == F.col("_path")).select("path", "content", "wanted")

    def left(path: str | int, content: bytes | None, pairs: list[tuple[str, int]]) -> Iterator[tuple]:
        allowed = dict(pairs)
        try:
            rows = residue(content or b"", list(allowed), allowed)
        except zipfile.BadZipFile:
            rows = [(None, None, None)]
        for row in rows:
            yield path, *row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched((r for row in each([batch]) for r in left(*row)), ["path", "part", "needle", "excess"], [batch.column(0).type, pa.string(), pa.string(), pa.int64()])

    return both.mapInArrow(run, f"path {files.schema['path'].dataType.simpleString()}, part string, needle string, excess long")


def residue_count(content: Column, needle: Column) -> Column:
    """How often an original is left in any part of a package, as ``residue`` counts."""

    @F.pandas_udf("long")
    def count(contents: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([sum(n for _, _, n in residue(bytes(c), [x])) for c, x in zip(contents, needles, strict=True)])

    return count(content, needle)


def rewrite_all(files: DataFrame, plan: Callable[[str, bytes], dict[str, list[tuple[int, int, str]]]], revisions: str | None = None) -> DataFrame:
    """(path, content, error): every package of (path, content) rewritten by ``plan``; one that fails has a null content and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    made.append(rewrite(content, plan(path, content), revisions))
                    errors.append(None)
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


def merged(files: DataFrame) -> DataFrame:
    """(path, part, runs_before, runs_after, text, xml) of each part with text of packages (path, content), its runs merged. Parts
    that are no XML and packages that can't be opened have no rows; ``structure.faults`` names them."""

    def found(path: str | int, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                texts = [(n, z.read(n)) for n in dict.fromkeys(z.namelist()) if any(k in TEXT_PARTS and re.search(p, n) for k, p in PARTS)]
        except zipfile.BadZipFile:
            return
        for part, xml in texts:
            try:
                made = merge_runs(xml)
            except ElementTree.ParseError:
                continue
            old, new = ElementTree.fromstring(xml), ElementTree.fromstring(made)
            yield path, part, *(sum(1 for _ in x.iter(W + "r")) for x in (old, new)), flat(new)[0].rstrip("\n"), made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield from batched((r for row in each([batch]) for r in found(*row)), ["path", "part", "runs_before", "runs_after", "text", "xml"], types)

    return files.select("path", "content").mapInArrow(run, f"path {files.schema['path'].dataType.simpleString()}, part string, runs_before int, runs_after int, text string, xml binary")
