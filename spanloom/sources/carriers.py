"""What carries text in the parts of Office packages: elements and attributes by the sort of part, as rows with their places.

A part's text is its text elements in order, with breaks; field codes and deleted text stand on lines of their own, attributes
on lines at the end, as an element with an attribute may stand in the middle of a word.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.sources.documents import PARTS
from spanloom.sources.docx import XML_SPACE, Overlap, _parse, _write


@dataclass(frozen=True)
class Profile:
    text: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()
    attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    breaks: dict[str, str] = field(default_factory=dict)
    ends: dict[str, str] = field(default_factory=dict)
    every: bool = False  # each element without children carries text, on a line of its own

    def kind(self, name: str) -> str | None:
        return "text" if name in self.text or self.every else "instr" if name in self.codes else "del" if name in self.deleted else None


#: The usual prefixes of the namespaces whose elements and attributes carry text; other names go without.
PREFIXES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/chart": "c",
    "http://schemas.openxmlformats.org/drawingml/2006/picture": "pic",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes": "vt",
    "http://schemas.openxmlformats.org/package/2006/metadata/core-properties": "cp",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://schemas.microsoft.com/office/word/2012/wordml": "w15",
    "urn:schemas-microsoft-com:vml": "v",
    "urn:schemas-microsoft-com:office:office": "o",
}
#: Carriers and breaks of each sort of part.
_DRAWN = ("descr", "title", "name")
_LINES = lambda *names: dict.fromkeys(names, "\n")
_PROPERTIES = ("dc:creator", "dc:title", "dc:subject", "dc:description", "cp:lastModifiedBy", "cp:keywords", "cp:category")
_APPLICATION = ("Company", "Manager", "Template")
PROFILES = {
    "words": Profile(
        text=("w:t", "a:t"),
        codes=("w:instrText", "w:delInstrText"),
        deleted=("w:delText",),
        attributes={
            "wp:docPr": _DRAWN, "pic:cNvPr": _DRAWN, "v:textpath": ("string",), "v:shape": ("alt", "o:title"), "w:comment": ("w:author", "w:initials"), "w:fldSimple": ("w:instr",),
            "w:bookmarkStart": ("w:name",), "w:hyperlink": ("w:tooltip", "w:anchor"), "w:tblCaption": ("w:val",), "w:tblDescription": ("w:val",),
        },
        breaks={"w:br": "\n", "w:cr": "\n", "a:br": "\n", "w:tab": "\t", "w:noBreakHyphen": "-"},
        ends={"w:p": "\n", "a:p": "\n", "w:tr": "\n", "w:tc": "\t"},
    ),
    "chart": Profile(text=("a:t", "c:v"), breaks=_LINES("a:br"), ends=_LINES("a:p", "c:pt", "c:tx")),
    "diagram": Profile(text=("a:t",), breaks=_LINES("a:br"), ends=_LINES("a:p")),
    "properties": Profile(text=(*_PROPERTIES, "cp:contentStatus", *_APPLICATION, "Application", "vt:lpstr", "vt:lpwstr"), attributes={"property": ("name",)}, ends=_LINES(*_PROPERTIES, *_APPLICATION, "vt:lpstr", "vt:lpwstr")),
    "links": Profile(attributes={"Relationship": ("Target",)}),
    "people": Profile(attributes={"w15:person": ("w15:author",), "w15:presenceInfo": ("w15:userId",)}),
    "data": Profile(every=True),
    "none": Profile(),
}
#: Profile of each kind of part; kinds that are not named carry nothing.
PROFILE_OF = {
    **dict.fromkeys(("document", "header", "footer", "footnotes", "endnotes", "comments", "glossary"), "words"), "chart": "chart", "diagram": "diagram",
    **dict.fromkeys(("core_properties", "app_properties", "custom_properties"), "properties"), "relationships": "links", "people": "people", "custom_xml": "data",
}
#: Names that a word processor gives by itself.
GENERATED = re.compile(r"_(GoBack|Toc[0-9]+|Hlk[0-9]+|Ref[0-9]+)")


def profile_of(part: str) -> str:
    """Relationship lists come first: they lie in the folders of the parts that they speak of."""
    kind = "relationships" if part.endswith(".rels") else next((k for k, p in PARTS if re.search(p, part)), "other")
    return PROFILE_OF.get(kind, "none")


def usual(tag: str) -> str:
    """A name with the usual prefix of its namespace."""
    uri, _, name = tag.removeprefix("{").rpartition("}")
    return f"{PREFIXES[uri]}:{name}" if uri in PREFIXES else name


@dataclass
class Carrier:
    kind: str
    element: str
    attribute: str | None
    node: ElementTree.Element
    key: str | None
    start: int = 0
    end: int = 0

    @property
    def content(self) -> str:
        return (self.node.get(self.key, "") if self.key else self.node.text) or ""

    def put(self, text: str) -> None:
        if self.key:
            self.node.set(self.key, text)
        else:
            self.node.text = text
            self.node.set(XML_SPACE, "preserve")


def carriers(root: ElementTree.Element, profile: Profile) -> tuple[str, list[Carrier]]:
    """A part's text and what carries it, in the text's order; carriers without content are left out."""
    out: list[str] = []
    found: list[Carrier] = []
    late: list[Carrier] = []
    size = 0

    def put(text: str) -> None:
        nonlocal size
        if text:
            out.append(text)
            size += len(text)

    def place(c: Carrier, own_line: bool) -> None:
        if own_line and out and not out[-1].endswith("\n"):
            put("\n")
        c.start, c.end = size, size + len(c.content)
        put(c.content)
        if own_line:
            put("\n")
        found.append(c)

    # A stack of (node, whether it is left), as parts may be nested deeper than calls may be.
    waiting = [(root, False)]
    while waiting:
        node, left = waiting.pop()
        name = usual(node.tag)
        if left:
            put(profile.ends.get(name, ""))
            continue
        for key, value in node.attrib.items():
            if usual(key) in profile.attributes.get(name, ()) and value and not GENERATED.fullmatch(value):
                late.append(Carrier("attr", name, usual(key), node, key))
        put(profile.breaks.get(name, ""))
        kind = profile.kind(name)
        if kind and not len(node) and node.text:
            place(Carrier(kind, name, None, node, None), kind != "text" or profile.every)
        waiting.append((node, True))
        waiting += [(child, False) for child in reversed(node)]
    for c in late:
        place(c, True)
    return "".join(out), found


def replaced(xml: bytes, profile: Profile, edits: list[tuple[int, int, str]]) -> bytes:
    """A part with spans of its text replaced: the first carrier that a span touches takes the replacement, the others lose their
    part. A span that touches no carrier changes nothing."""
    root = _parse(xml)
    found = carriers(root, profile)[1]
    ordered = sorted(edits)
    for (_, end, _), (start, _, _) in zip(ordered, ordered[1:], strict=False):
        if start < end:
            raise Overlap(f"edits overlap at {start}")
    for start, end, new in reversed(ordered):
        for i, c in enumerate(c for c in found if c.start < end and start < c.end):
            text = c.content
            c.put(text[: max(0, start - c.start)] + (new if i == 0 else "") + text[min(c.end, end) - c.start :])
    return _write(root)


def _parts(content: bytes | None) -> Iterator[tuple[str, str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            for part in dict.fromkeys(z.namelist()):
                if (profile := profile_of(part)) != "none":
                    yield part, profile, z.read(part)
    except zipfile.BadZipFile:
        return


ROW = (("part", pa.string()), ("profile", pa.string()), ("no", pa.int32()), ("kind", pa.string()), ("element", pa.string()), ("attribute", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("content", pa.string()))


def rows(files: DataFrame) -> DataFrame:
    """(path, part, profile, no, kind, element, attribute, start, end, content): each carrier of each part of packages (path,
    content). Packages that can't be opened and parts that are no XML have none; ``structure.faults`` names them."""

    names, kinds = zip(*ROW, strict=True)

    def found(path: str | int, content: bytes | None) -> Iterator[tuple]:
        for part, profile, xml in _parts(content):
            try:
                made = carriers(ElementTree.fromstring(xml), PROFILES[profile])[1]
            except ElementTree.ParseError:
                continue
            for i, c in enumerate(made):
                yield path, part, profile, i, c.kind, c.element, c.attribute, c.start, c.end, c.content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched((row for path, content in each([batch]) for row in found(path, content)), ["path", *names], [batch.column(0).type, *kinds])

    return files.select("path", "content").mapInArrow(run, f"path {files.schema['path'].dataType.simpleString()}, part string, profile string, no int, kind string, element string, attribute string, start int, end int, content string")


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, error): packages with ``edits`` (path, part, start, end, replacement) written into the carriers of their
    parts; content is null where the package can't be written, and the error says why. Packages without edits stay as they are.

    A package's edits travel with it in one row, so they are as many as one package has.
    """
    packed = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "start", "end", "replacement"))).alias("_edits"))

    def write(content: bytes | None, wanted: list[dict]) -> bytes:
        by_part: dict[str, list[tuple[int, int, str]]] = {}
        for e in wanted:
            by_part.setdefault(e["part"], []).append((e["start"], e["end"], e["replacement"] or ""))
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for info in z.infolist():
                data = z.read(info)
                if info.filename in by_part:
                    data = replaced(data, PROFILES[profile_of(info.filename)], by_part[info.filename])
                made.writestr(zipfile.ZipInfo(info.filename), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def changed(path: str | int, content: bytes | None, wanted: list[dict] | None) -> tuple:
        if not wanted:
            return path, content, None
        try:
            return path, write(content, wanted), None
        except (zipfile.BadZipFile, ElementTree.ParseError, Overlap) as e:
            return path, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched((changed(*row) for row in each([batch])), ["path", "content", "error"], [batch.column(0).type, pa.binary(), pa.string()])

    return files.select("path", "content").join(packed, "path", "left").mapInArrow(run, f"path {files.schema['path'].dataType.simpleString()}, content binary, error string")
