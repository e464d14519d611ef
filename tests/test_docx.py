import io
import zipfile

import pytest

from spanloom.sources import docx as X
from spanloom.sources.documents import docx_units

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, data in more.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def run(*texts):
    return "<w:p>" + "".join(f'<w:r w:rsidR="00A1"><w:t>{t}</w:t></w:r>' for t in texts) + "</w:p>"


def test_names_split_over_runs_are_replaced():
    made = X.rewrite(package(run("Ko", "vács Já", "nos úr") + run("vége")), {"word/document.xml": [(0, 12, "Gránit Ottó"), (16, 20, "kész")]})
    ((_, _, _, text),) = docx_units(made)
    assert text == "Gránit Ottó úr\nkész" and not X.residue(made, ["Kovács", "rsid"])


def test_overlaps_and_misses():
    xml = f"<w:document {NS}><w:body>{run('abc')}</w:body></w:document>".encode()
    with pytest.raises(X.Overlap):
        X.apply_edits(xml, [(0, 2, "x"), (1, 3, "y")])
    assert X.apply_edits(xml, [(3, 4, "x")])[1] == [(3, 4, "x")]


def test_revisions_and_traces():
    body = '<w:p><w:ins w:author="A"><w:r><w:t>új</w:t></w:r></w:ins><w:del w:author="A"><w:r><w:delText>régi</w:delText></w:r></w:del></w:p>'
    raw = package(body, word__people_xml="<p>Kovács</p>", docProps__core_xml='<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Kovács</dc:creator></c>')
    with pytest.raises(ValueError):
        X.rewrite(raw, {})
    for how, text in (("accept", "új"), ("reject", "régi")):
        made = X.rewrite(raw, {}, how)
        assert docx_units(made)[0][3] == text and not X.residue(made, ["Kovács"])


def test_image_metadata():
    chunk = lambda kind, data: len(data).to_bytes(4) + kind + data + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"h") + chunk(b"tEXt", b"Author") + chunk(b"IEND", b"")
    assert X.strip_image("a.png", png) == b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"h") + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x06Exif\xff\xda\x00\x02rest"
    assert X.strip_image("a.jpg", jpeg) == b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02rest"


def test_packages_as_rows(spark):
    files = spark.createDataFrame([("a", bytearray(package(run("Anna")))), ("b", bytearray(b"no"))], "path string, content binary")
    rows = {r.path: r for r in X.rewrite_all(files, lambda path, content: {"word/document.xml": [(0, 4, "Frida")]}).collect()}
    assert docx_units(bytes(rows["a"].content))[0][3] == "Frida" and rows["b"].content is None and "BadZipFile" in rows["b"].error
