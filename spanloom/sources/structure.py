"""What Office packages are made of, as rows, and what is wrong with them.

One pass opens each package and gives its relation: its parts, the links between them, the content types they are given. A part
is reached if a chain of links between parts that are there leads to it from the package's own list; that walk is over one package's links, so it is
done where they are read. All faults are joins and aggregates over the relation, which is written once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.sources.documents import part_kind
from spanloom.sources.staged import written

#: The list of content types, the main part, a target that is an address.
TYPES, MAIN = "[Content_Types].xml", "word/document.xml"
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
SCHEMA = "entry string, part string, target string, size long, reached boolean"
_PAIR = re.compile(r"^(.*?)_rels/([^/]*)\.rels$")


def resolve(links: str, target: str) -> str:
    """The part that a target in the list ``links`` names: from the root after a slash, else from the folder of the list's owner."""
    if target.startswith("/"):
        return target[1:]
    out: list[str] = []
    for step in (re.sub(r"_rels/[^/]*$", "", links) + target).split("/"):
        if step == "..":
            out[-1:] = []
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


def opened(content: bytes) -> list[tuple]:
    """Rows of ``SCHEMA``. Entries: ``part``, ``link`` (from the list ``part`` to ``target``), ``default`` (an extension) and
    ``override`` (a part) of the content types, ``malformed`` (a part that is no XML), ``unreadable`` (no archive)."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = list(dict.fromkeys(archive.namelist()))
        data = {n: archive.read(n) for n in names if n.endswith((".xml", ".rels"))}
        sizes = {i.filename: i.file_size for i in archive.infolist()}
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError):
        return [("unreadable", None, None, None, None)]
    out: list[tuple] = []
    edges: dict[str, list[str]] = defaultdict(list)
    for name, xml in data.items():
        try:
            nodes = [(n.tag.rsplit("}", 1)[-1], n.attrib) for n in ElementTree.fromstring(xml).iter()] if name == TYPES or name.endswith(".rels") else ElementTree.fromstring(xml) and []
        except ElementTree.ParseError:
            out.append(("malformed", name, None, None, None))
            continue
        for tag, given in nodes:
            if name == TYPES and tag == "Default" and "Extension" in given:
                out.append(("default", given["Extension"].lower(), None, None, None))
            elif name == TYPES and tag == "Override" and "PartName" in given:
                out.append(("override", given["PartName"].removeprefix("/"), None, None, None))
            elif tag == "Relationship" and given.get("TargetMode") != "External" and "Target" in given and not _ADDRESS.match(given["Target"]):
                target = resolve(name, given["Target"])
                out.append(("link", name, target, None, None))
                owner = _PAIR.match(name)
                edges[owner[1] + owner[2] if owner else ""].append(target)
    reached, ahead = {""}, [""]
    while ahead:
        for target in edges.get(ahead.pop(), ()):
            if target in sizes and target not in reached:
                reached.add(target)
                ahead.append(target)
    for name in names:
        owner = _PAIR.match(name)
        out.append(("part", name, None, sizes[name], name == TYPES or (owner[1] + owner[2] if owner else name) in reached))
    return out


def relation(files: DataFrame) -> DataFrame:
    """(path, SCHEMA) of packages (path, content); a null content is unreadable. Folders are no parts. A name that is in an archive
    more than once is one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, *r) for path, content in each(batches) for r in opened(content or b"") if not (r[0] == "part" and r[1].endswith("/")))
        return batched(rows, ["path", "entry", "part", "target", "size", "reached"], [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, f"path string, {SCHEMA}")


def parts(found: DataFrame) -> DataFrame:
    """(path, part, kind, size, reached) of a relation."""
    return found.where("entry = 'part'").select("path", "part", part_kind(F.col("part")).alias("kind"), "size", "reached")


def _extension(part: Column) -> Column:
    return F.lower(F.regexp_extract(part, r"\.([^.]*)$", 1))


def faults(found: DataFrame) -> DataFrame:
    """(path, fault, part, target), each once.

    ``unreadable``; ``no types`` (then nothing else is looked for, as no part has a type); ``no document``; ``malformed``; ``dead
    type`` (a content type for a part that is not there); ``untyped``; ``dead link``; ``unreachable``; ``unclassified`` (a part
    that no rule knows, so nothing is looked for in it); ``embedded`` and ``image`` (they are not read, a person must look).
    Equal paths are one package.
    """
    found = written(found, "packages")
    none = F.lit(None).cast("string")
    has = lambda name: F.coalesce(F.bool_or((F.col("entry") == "part") & (F.col("part") == name)), F.lit(False))
    whole = found.groupBy("path").agg(F.bool_or(F.col("entry") == "unreadable").alias("shut"), has(TYPES).alias("typed"), has(MAIN).alias("main"))
    of_file = whole.select("path", F.explode(F.array_compact(F.array(F.when(F.col("shut"), "unreadable"), F.when(~F.col("shut") & ~F.col("typed"), "no types"), F.when(F.col("typed") & ~F.col("main"), "no document")))).alias("fault"), none.alias("part"), none.alias("target"))
    # Both sides of each join have rows for every package, and files of short strings are far smaller than what is in them: by
    # their size alone they would be broadcast, through the driver.
    met = lambda df: df.hint("merge")
    sound = found.join(met(whole.where("typed").select("path")), "path", "left_semi")
    there = parts(sound)
    named = there.select("path", "part").distinct()
    listed = lambda entry: sound.where(F.col("entry") == entry)
    row = lambda df, fault, target=none: df.select("path", F.lit(fault).alias("fault"), "part", target.alias("target"))
    untyped = named.where(F.col("part") != TYPES).join(met(listed("override").select("path", "part")), ["path", "part"], "left_anti").withColumn("extension", _extension(F.col("part")))
    untyped = untyped.join(met(listed("default").select("path", F.col("part").alias("extension"))), ["path", "extension"], "left_anti")
    dead = listed("link").select("path", "part", "target").join(met(named.withColumnRenamed("part", "target")), ["path", "target"], "left_anti")
    by_part = F.explode(F.array_compact(F.array(F.when(~F.col("reached"), "unreachable"), F.when(F.col("kind") == "other", "unclassified"), F.when(F.col("kind") == "embedding", "embedded"), F.when(F.col("kind") == "media", "image"))))
    out = of_file.unionByName(row(listed("malformed"), "malformed"))
    out = out.unionByName(row(listed("override").join(met(named), ["path", "part"], "left_anti"), "dead type"))
    out = out.unionByName(row(untyped, "untyped")).unionByName(row(dead, "dead link", F.col("target")))
    return out.unionByName(there.select("path", by_part.alias("fault"), "part", none.alias("target"))).distinct()
