"""Text of PDF pages with its place: streams are read once each, forms are placed by joins.

A content stream is a small program over a stack of matrices. Each distinct stream is interpreted once, whatever the number of
places it is drawn at, into what it shows and which objects it calls, with matrices relative to its own start. A page is then
a walk over the graph of forms: from the page's stream on, every call of a form places the form's stream under the matrix that
holds there, one join for each level. A form on its own path (a cycle), beyond ``DEPTH`` levels or beyond ``PLACES`` places on one
level of a page is passed over and reported. Placed text is decoded by its font's character map with Columns, and what could not
be read is counted by font.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.sources.pdf import operations
from spanloom.sources.staged import written

DEPTH, PLACES = 12, 1000
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: The sentences of the warnings.
BLIND = " betűkészlethez nincs használható ToUnicode tábla, ezért {} karaktert nem tudtunk elolvasni. Az ezekkel szedett szöveget a program NEM LÁTJA: ha név van benne, nem talál rá és nem is cseréli ki. Érintett betűkészlet: {}."
PARTIAL = " karakterkód hiányzik a betűkészlet ToUnicode táblájából; ezek a betűk kimaradtak a kiolvasott szövegből, így a rájuk eső nevekre a kereső nem illeszkedik."
SKIPPED = " beágyazott tartalomrészt (Form XObject) kihagytunk — körkörös vagy túl mély hivatkozás. Az ezekben lévő szöveget nem néztük át."
UNOPENED = " hivatkozott tartalomrészt nem sikerült megnyitni, ezért a tartalmát nem néztük át."
MOST_PAGES, MOST_FONTS, INDENT = 6, 4, 20
STREAM = "no int, kind string, name string, codes binary, size double, m array<double>, at int, end int"


def times(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def interpret(data: bytes) -> list[tuple]:
    """Rows of ``STREAM``: texts shown without a move between them are one row; calls are rows of their own.

    Operands that are missing or of the wrong kind make an operation do nothing; a stack that runs empty stays where it is.
    """
    out: list[list] = []
    held, now, font, size = [], IDENTITY, None, 0.0
    line = text = IDENTITY
    leading = rise = 0.0
    joined = False
    for op in operations(data):
        given = op.operands
        numbers = [x for x in given if isinstance(x, float)]
        word = op.operator
        if word in ("Tj", "TJ", "'", '"'):
            if word in ("'", '"'):
                line = text = times((1, 0, 0, 1, 0, -leading), line)
                joined = False
            codes = b"".join(p for x in given for p in (x if isinstance(x, list) else [x]) if isinstance(p, bytes))
            if joined:
                out[-1][3] += codes
                out[-1][7] = op.end
            else:
                m = times((1, 0, 0, 1, 0, rise), times(text, now))
                out.append([len(out), "show", font, codes, size, [float(x) for x in m], op.start, op.end])
                joined = True
            continue
        if word in ("Tc", "Tw", "Tz", "Tr", "rg", "RG", "g", "G", "k", "K", "cs", "CS", "sc", "SC", "scn", "SCN", "gs"):
            continue  # neither place nor font
        joined = False
        if word == "q":
            held.append((now, font, size, leading, rise))
        elif word == "Q" and held:
            now, font, size, leading, rise = held.pop()
        elif word == "cm" and len(numbers) == 6:
            now = times(tuple(numbers), now)
        elif word == "BT":
            line = text = IDENTITY
        elif word == "Tf" and given and isinstance(given[0], str):
            font, size = given[0], numbers[0] if numbers else size
        elif word == "TL" and numbers:
            leading = numbers[0]
        elif word == "Ts" and numbers:
            rise = numbers[0]
        elif word in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if word == "TD" else leading
            line = text = times((1, 0, 0, 1, *numbers), line)
        elif word == "Tm" and len(numbers) == 6:
            line = text = tuple(numbers)
        elif word == "T*":
            line = text = times((1, 0, 0, 1, 0, -leading), line)
        elif word == "Do" and given and isinstance(given[0], str):
            out.append([len(out), "call", given[0], b"", 0.0, [float(x) for x in now], op.start, op.end])
    return [tuple(r) for r in out]


def read_streams(streams: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """(*by, STREAM) of every stream; a null stream has no rows."""
    kinds = [(c, streams.schema[c].dataType.simpleString()) for c in by]
    types = (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((*keys, *row) for *keys, raw in each([batch]) for row in interpret(raw or b""))
            yield from batched(rows, [*by, *(f.split()[0] for f in STREAM.split(", "))], [*(c.type for c in batch.columns[: len(by)]), *types])

    return streams.select(*by, content).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), STREAM]))


def product(m: Column, n: Column) -> Column:
    """``times`` of two array columns."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    p, q, r, s, t, u = (n[i] for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def place_streams(pages: DataFrame, calls: DataFrame, forms: DataFrame, objects: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(placed, faults): where each page draws which stream.

    ``pages`` (file, page, stream_id), ``calls`` (file, stream_id, no, name, m), ``forms`` (file, stream_id, matrix),
    ``objects`` (file, stream_id, name, kind, target): what a stream's names stand for. Placed rows have the matrix, and in
    ``path`` the calls that lead there; faults are (file, page, kind, name) with kind ``skipped`` or ``unopened``.
    """
    same = [file, "stream_id"]
    start = pages.select(file, "page", "stream_id", F.array(*map(F.lit, IDENTITY)).alias("ctm"), F.array("stream_id").alias("seen"), F.array().cast("array<int>").alias("path"))
    named = objects.select(*same, "name", F.col("kind").alias("what"), "target").dropDuplicates([*same, "name"])
    shapes = forms.select(file, F.col("stream_id").alias("target"), F.coalesce("matrix", F.array(*map(F.lit, IDENTITY))).alias("matrix")).dropDuplicates([file, "target"])
    level, placed, faults = start, start, None
    for depth in range(1, DEPTH + 2):
        met = level.join(calls.select(*same, "no", "name", "m"), same).join(named, [*same, "name"], "left").join(shapes, [file, "target"], "left")
        rank = F.row_number().over(Window.partitionBy(file, "page").orderBy("path", "no"))
        form = (F.col("what") == "form") & F.col("matrix").isNotNull()
        told = met.withColumns({"form": F.coalesce(form, F.lit(False)), "loop": F.coalesce(F.array_contains("seen", F.col("target")), F.lit(False)) | F.lit(depth > DEPTH)})
        told = written(told.withColumn("rank", F.when(F.col("form") & ~F.col("loop"), rank)), "places")
        skipped = told.where(F.col("form") & (F.col("loop") | (F.col("rank") > PLACES))).select(file, "page", F.lit("skipped").alias("kind"), F.col("target").alias("name"))
        unopened = told.where("NOT form AND coalesce(what, '') <> 'image'").select(file, "page", F.lit("unopened").alias("kind"), "name")
        faults = skipped.unionByName(unopened) if faults is None else faults.unionByName(skipped).unionByName(unopened)
        level = told.where(F.col("form") & ~F.col("loop") & (F.col("rank") <= PLACES)).select(
            file, "page", F.col("target").alias("stream_id"), product(F.col("matrix"), product(F.col("m"), F.col("ctm"))).alias("ctm"), F.array_append("seen", F.col("target")).alias("seen"), F.array_append("path", F.col("no")).alias("path")
        )
        if level.isEmpty():
            break
        placed = placed.unionByName(level)
    return placed, faults


def extract(pages: DataFrame, streams: DataFrame, objects: DataFrame, fonts: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(segments, warnings) of all pages.

    ``pages`` (file, page, stream_id), ``streams`` (file, stream_id, content, matrix: null for a page's own), ``objects`` as
    above, ``fonts`` (file, stream_id, name, base_font, width: bytes of a code, chars: map of code to text, null without a table).
    Segments: (file, page, no in reading order, stream_id, x, y, size, text, at, end: bytes of the stream); such without
    readable text are left out. Warnings: (file, page, kind, name, n); kinds ``blind`` (no font or no table), ``partial`` (codes
    missing in a table), ``skipped`` and ``unopened`` objects.
    """
    own = streams.dropDuplicates([file, "stream_id"])
    ops = written(read_streams(own, [file, "stream_id"]), "operations")
    placed, faults = place_streams(pages, ops.where("kind = 'call'"), own.where("content IS NOT NULL"), objects, file)
    known = fonts.select(file, "stream_id", F.col("name").alias("font"), "base_font", "width", "chars", F.lit(True).alias("known")).dropDuplicates([file, "stream_id", "font"])
    shows = ops.where("kind = 'show'").withColumnRenamed("name", "font").drop("kind")
    there = placed.join(shows, [file, "stream_id"]).join(known, [file, "stream_id", "font"], "left")
    width = F.greatest(F.coalesce("width", F.lit(2)), F.lit(1))
    # Code i of a text is bytes i * width + 1 on; a rest shorter than a code is none.
    n = F.floor(F.length("codes") / width).cast("int")
    digits = F.hex("codes")
    code = lambda i: F.conv(F.substring(digits, (i * width * 2 + 1).cast("int"), (width * 2).cast("int")), 16, 10).cast("int")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), code)).otherwise(F.array().cast("array<int>"))
    chars = F.transform("_codes", lambda c: F.try_element_at("chars", c))
    decoded = there.withColumns({"_codes": codes, "m": product(F.col("m"), F.col("ctm"))}).withColumn("_chars", F.when(F.col("chars").isNotNull(), chars))
    read = decoded.withColumns({"text": F.coalesce(F.array_join("_chars", ""), F.lit("")), "lost": F.when(F.col("chars").isNull(), F.size("_codes")).otherwise(F.size(F.filter("_chars", lambda c: c.isNull())))})
    read = written(read.select(file, "page", "path", "no", "stream_id", "font", "base_font", F.col("chars").isNull().alias("blind"), F.col("m")[4].alias("x"), F.col("m")[5].alias("y"), (F.col("size") * F.sqrt(F.col("m")[2] ** 2 + F.col("m")[3] ** 2)).alias("size"), "text", F.col("lost").cast("long").alias("lost"), "at", "end"), "shown")
    order = F.row_number().over(Window.partitionBy(file, "page").orderBy(F.array_append("path", F.col("no"))))
    segments = read.where("text <> ''").withColumn("no", order).select(file, "page", "no", "stream_id", "x", "y", "size", "text", "at", "end")
    unread = read.where("lost > 0").groupBy(file, "page", F.when(F.col("blind"), "blind").otherwise("partial").alias("kind"), F.coalesce("base_font", "font", F.lit("")).alias("name")).agg(F.sum("lost").alias("n"))
    other = faults.groupBy(file, "page", "kind", "name").agg(F.count("*").alias("n"))
    return segments, unread.unionByName(other)


def page_list(pages: Column) -> Column:
    """``A 2., 5. és 9. oldalon``: pages counted from one, a mere number if they are many."""
    shown = F.transform(F.array_sort(pages), lambda p: F.concat((p + 1).cast("string"), F.lit(".")))
    n = F.size(pages)
    listed = F.concat(F.array_join(F.slice(shown, 1, F.greatest(n - 1, F.lit(1))), ", "), F.when(n > 1, F.concat(F.lit(" és "), F.element_at(shown, -1))).otherwise(""))
    return F.when(n > MOST_PAGES, F.concat(n.cast("string"), F.lit(" oldalon"))).when(n > 0, F.concat(F.lit("A "), listed, F.lit(" oldalon"))).otherwise("")


def messages(warnings: DataFrame, file: str = "file") -> DataFrame:
    """(file, messages): what a reader of the file has to know, one sentence for each kind of warning that there is."""
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    kinds = ("blind", "partial", "skipped", "unopened")
    sums = [F.sum(of(k, F.col("n"))).alias(f"n_{k}") for k in kinds] + [F.collect_set(of(k, F.col("page"))).alias(f"p_{k}") for k in kinds]
    first = F.array_sort(F.collect_set(of("blind", F.col("name")))).alias("fonts")
    rows = warnings.groupBy(file).agg(*sums, first)
    count = lambda k: F.col(f"n_{k}").cast("string")
    head, middle, tail = BLIND.split("{}")
    said = {
        "blind": F.concat(page_list(F.col("p_blind")), F.lit(" "), F.size("fonts").cast("string"), F.lit(head), count("blind"), F.lit(middle), F.array_join(F.slice("fonts", 1, MOST_FONTS), ", "), F.lit(tail)),
        **{k: F.concat(page_list(F.col(f"p_{k}")), F.lit(" "), count(k), F.lit(text)) for k, text in (("partial", PARTIAL), ("skipped", SKIPPED), ("unopened", UNOPENED))},
    }
    listed = F.filter(F.array(*(F.when(F.col(f"n_{k}") > 0, said[k]) for k in kinds)), lambda m: m.isNotNull())
    return rows.select(file, listed.alias("messages"))


def preview_paragraphs(lines: DataFrame, by: list[str], no: str = "no") -> DataFrame:
    """(*by, paragraph, start, center) from placed lines (paragraph, x, start).

    A page's margin is the whole x at which most lines' paragraphs begin, the first such; one line that begins more than
    ``INDENT`` right of it is centred.
    """
    whole = lambda c: F.floor(c + 0.5)
    rows = lines.groupBy(*by, "paragraph").agg(F.min_by("x", no).alias("x"), F.min_by("start", no).alias("start"), F.count("*").alias("n"), F.min(no).alias("_first"))
    rows = rows.withColumn("x", whole(F.col("x")))
    margins = rows.groupBy(*by, "x").agg(F.sum("n").alias("n"), F.min("_first").alias("_first")).groupBy(*by).agg(F.max_by("x", F.struct("n", -F.col("_first"))).alias("margin"))
    return rows.join(margins, by).select(*by, "paragraph", "start", ((F.col("n") == 1) & (F.col("x") - F.col("margin") > INDENT)).alias("center"))
