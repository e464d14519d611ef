import io
import zipfile

import pytest

from spanloom.sources import documents as D
from spanloom.sources import keyfile

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}><w:p><w:r><w:t>fej</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {NS}><w:p/></w:ftr>")
    return out.getvalue()


def test_units_and_revisions():
    body = "<w:p><w:r><w:t>Ko</w:t></w:r><w:r><w:t>vács</w:t></w:r></w:p><w:p><w:del><w:r><w:t>régi</w:t></w:r></w:del><w:r><w:t>új</w:t></w:r></w:p>"
    assert [(k, t) for _, _, k, t in D.docx_units(package(body))] == [("document", "Kovács\núj"), ("header", "fej")]
    assert D.revisions(package(body)) == 1 and D.docx_units(b"junk") == []


def test_gate(spark, tmp_path):
    files = {"a.txt": "szöveg".encode(), "b.txt": b"", "c.pdf": b"%PDF-1.7", "d.txt": b"%PDF-1.7", "e.doc": bytes.fromhex("D0CF11E0A1B11AE1"), "f.txt": b"ab\0cd", "g.docx": package("<w:p/>"), "h.docx": b"no zip", "i.rtf": b"{\\rtf1"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.error for r in D.read(spark, str(tmp_path)).collect()}
    assert {k for k, e in got.items() if e is None} == {"a.txt", "c.pdf", "g.docx"}
    assert {r.text for r in D.units(D.read(spark, str(tmp_path))).collect()} == {"szöveg", "fej"}


def test_keyfile_round_trip(spark):
    rows = [("1", "Kovács János", "Gránit Ottó"), ("2", "Anna", "Frida")]
    sealed = keyfile.seal(spark.createDataFrame(rows, "entity_id string, original string, replacement string"), "nagyon titkos", b"0" * 16)
    assert sorted(map(tuple, keyfile.unseal(sealed, "nagyon titkos").collect())) == rows
    with pytest.raises(Exception):
        keyfile.unseal(sealed, "rossz jelszó").collect()
    with pytest.raises(ValueError):
        keyfile.key("short", b"0" * 16)


def test_stream(spark, tmp_path):
    from spanloom.streaming import stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "adószáma: 24817350-2-13")], "doc long, text string").write.mode("overwrite").parquet(str(tmp_path / "in/a"))
    source = spark.readStream.schema("doc long, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    stream.run_batches(stream.scan_identifiers(source, ["doc"]), lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.kind for r in seen] == ["adoszam"]
