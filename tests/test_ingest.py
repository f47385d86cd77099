"""Files made here, and what scan, detection, metadata and text find in them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import markup
from shelfspark.plans import search
from shelfspark.sources import files

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:opf="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title id="t1">Red Ring</dc:title><dc:title id="t2">A Tale</dc:title><meta refines="#t2" property="title-type">subtitle</meta><dc:creator>Ann Lee</dc:creator><dc:creator>Bob Kay</dc:creator>
<dc:language>en-US</dc:language><dc:publisher>Press</dc:publisher><dc:date>1999-05-01</dc:date><dc:subject>x</dc:subject><dc:identifier opf:scheme="ISBN">978-3-16-148410-0</dc:identifier>
<meta name="calibre:series" content="Rings"/><meta name="calibre:series_index" content="2.5"/></metadata>
<manifest>{items}</manifest><spine>{refs}</spine></package>"""


def epub(chapters=12):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", OPF.format(items="".join(f'<item id="i{i}" href="t/{i}.html"/>' for i in range(chapters)), refs="".join(f'<itemref idref="i{i}"/>' for i in range(chapters))))
        for i in range(chapters):
            z.writestr(f"OEBPS/t/{i}.html", f"<html><body><p>chapter{i}</p> end</body></html>")
    return out.getvalue()


def cbz():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/1.JPG", b"x")
    return out.getvalue()


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / ".hidden").mkdir()
    (root / "sub").mkdir()
    content = {
        "one.epub": epub(), "sub/two.EPUB": epub(3)[:-60], "c.cbz": cbz(), "d.pdf": b"%PDF-1.4 xyz", "e.djvu": b"AT&TFORM....", "f.mobi": b"\0" * 60 + b"BOOKMOBI rest", "g.fb2": "﻿<?xml?><FictionBook><section><p>one</p></section><section>two</section></FictionBook>".encode(),
        "h.txt": ("é" * 5000 + "z").encode(), "i.txt": b"short", "j.pdf": b"\x00\x01\x02\x03binary\xff", ".hidden/k.epub": epub(), ".l.epub": epub(), "m.doc": b"%PDF-1.4 xyz", "n.pdf": b"PK\x03\x04 no archive",
    }
    for name, data in content.items():
        (root / name).write_bytes(data)
    return files.detected(files.scan(spark, str(root))).withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()


def test_scan_and_detection(found):
    kinds = {r.name: r.format for r in found.collect()}
    assert kinds == {"one.epub": "epub", "two.EPUB": "epub", "c.cbz": "cbz", "d.pdf": "pdf", "e.djvu": "djvu", "f.mobi": "mobi", "g.fb2": "fb2", "h.txt": "txt", "i.txt": None, "j.pdf": "unknown", "n.pdf": "unknown"}
    assert {r.format: r.n for r in files.manifest(found).collect()}["epub"] == 2


def test_metadata_and_text(found):
    (m,) = files.epub_metadata(found.where("format = 'epub'")).collect()  # the one cut short can't be read
    assert (m.title, m.subtitle, m.authors, m.language, m.publisher, m.published, m.series, m.position) == ("Red Ring", "A Tale", ["Ann Lee", "Bob Kay"], "en-US", "Press", "1999-05-01", "Rings", 2.5)
    assert [(i.scheme, i.value) for i in m.identifiers] == [("ISBN", "978-3-16-148410-0")]
    text = {r.path.rsplit("/", 1)[-1]: r.text for r in files.content_text(found).collect()}
    assert text["one.epub"] == " ".join(f"chapter{i} end" for i in (0, 1, 2, 3, 4, 7, 8, 9, 10, 11)) and text["g.fb2"] == "one two"
    assert text["h.txt"] == "é" * 2000 + "\n�" + "é" * 1999 + "z" and set(text) == {"one.epub", "g.fb2", "h.txt"}


def test_front_back(spark):
    got = spark.range(0, 9).select("id", files.front_back(F.col("id").cast("int"), 2).alias("v")).collect()
    assert {r.id: r.v for r in got} == {n: [i for i in range(n) if n <= 4 or i < 2 or i >= n - 2] for n in range(9)}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>A</p><p>B</p>", "A\n\nB"), ("<script>x</script>", None), ("&amp;&#39;&#x41;", "&'A"), ("a<!-- b -->c", "ac"), ("<![CDATA[1 < 2]]>", "1 < 2"), ("", None), ("&amp;lt;&toolongentity;&#xZZ;", "&lt;&toolongentity;&#xZZ;"),
        ("a<br>b <br/> c", "a\nb\nc"), ("a \t b\n\n\n c", "a b\n\nc"), ("<style>p{}", "p{}"), ("<p>unclosed", "unclosed"),
    ],
)
def test_strip_html(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(markup.strip_html(F.col("h")).alias("v")).first().v == text


def test_requests_and_tokens():
    f = search.from_request({"language": " en ", "year_min": "1990", "year_max": "1960", "tags": "b, a,b", "tag_match": "all", "identifier": "isbn:978-0x", "locked": "false"})
    assert (f.language, f.year_min, f.year_max, f.tags, f.tags_all, f.identifier, f.locked) == ("en", 1960, 1990, ("a", "b"), True, ("isbn", "9780X"), False)
    for bad in ({"year_min": "x"}, {"locked": "maybe"}, {"format": "docx"}, {"nope": "1"}):
        with pytest.raises(ValueError):
            search.from_request(bad)
    key, f = b"k" * 32, search.BookFilter(text="x", columns=(("title", "y", True),), not_tags=("t",), identifier=(None, "z"))
    token = search.sign(f, key)
    assert search.verified(token, key) == f
    for bad in (token[:-2] + "AA", token[:20], "", search.sign(f, b"j" * 32)):
        with pytest.raises(ValueError):
            search.verified(bad, key)
    assert search.canonical_identifier("asin", " b00 1 ") == ("asin", "B001") and search.is_identifier_type("olid") and not search.is_identifier_type("x")


def test_storage_paths(spark):
    from shelfspark.functions.words import path_component, storage_path

    given = [("Frank Herbert", "Dune", "dune.epub", "F/Frank Herbert/Dune/dune.epub"), ("42 Authors", "Anthology", "a.epub", "_/42 Authors/Anthology/a.epub"), ("", "Some Title", "book.epub", "_/_unknown/Some Title/book.epub"), ("Author", "", "book.epub", "A/Author/_unknown/book.epub"), ("Харуки Мураками", "1Q84", "1q84.epub", "Х/Харуки Мураками/1Q84/1q84.epub"), ("  Author  ", "  Title  ", "  file.epub  ", "A/Author/Title/file.epub"), ("Con", "..", "my.book.name.epub", "C/Con_/_unknown/my.book.name.epub"), (None, None, None, "_/_unknown/_unknown/_unknown")]
    rows = spark.createDataFrame(given, "a string, t string, f string, want string").select("want", storage_path(F.col("a"), F.col("t"), F.col("f")).alias("got")).collect()
    assert [(r.want, r.got) for r in rows if r.want != r.got] == []
    names = [("CON", "CON_"), ("NUL", "NUL_"), ("aux.h", "aux_.h"), ("LPT1", "LPT1_"), ("com9", "com9_"), ("Author/Name", "Author_Name"), ("Back\\Slash", "Back_Slash"), ("Title: A Subtitle", "Title_ A Subtitle"), ("A///B", "A_B"), ("C:::D", "C_D"), ("hello\0world", "helloworld"), ("\0\0\0", "_unknown"), ("///", "_unknown"), ("hello\x01\x02world", "helloworld"), (".hidden", ".hidden"), ("..", "_unknown"), ("Title - Part (2024)", "Title - Part (2024)"), ("O'Brien", "O'Brien"), ("A" * 300, "A" * 255), ("é" * 200 + ".epub", "é" * 125 + ".epub"), ("end. .", "end"), ("a\u202eb \u00a0 c", "ab c")]
    rows = spark.createDataFrame(names, "c string, want string").select("want", path_component(F.col("c")).alias("got")).collect()
    assert [(r.want, r.got) for r in rows if r.want != r.got] == []


def test_scan_of_a_hidden_folder(spark, tmp_path):
    top = tmp_path / ".books"
    for name in ("a.epub", "sub/b.EPUB", "sub/.c.epub", ".hid/d.epub"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(top)).select("path").collect()) == ["a.epub", "b.EPUB"]
