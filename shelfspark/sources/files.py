"""Book files as a source: scan of folders, detection by bytes, metadata and text of the formats Spark can reach.

Spark lists and reads the files (``binaryFile``) and deals them to tasks; what
has to open an archive does so on batches inside a task.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are looked at, bytes that tell formats, image endings, units of text at either end.
EXTENSIONS = ("epub", "pdf", "mobi", "cbz", "fb2", "txt", "djvu", "azw3")
HEADER, SMALLEST = 8192, 8
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
EPUB_PARTS, FB2_SECTIONS, TXT_BYTES = 5, 3, 4000
METADATA = "path string, title string, subtitle string, authors array<string>, language string, publisher string, published string, description string, subjects array<string>, identifiers array<struct<scheme:string,value:string>>, series string, position double"


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, content) of book files below ``root``; hidden names and folders are out.

    The extension is part of the listing, in either case. Spark also leaves
    out names that begin with an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob(extensions)).load(root)
    return visible(files, spark, root).select("path", "length", "content")


def name_glob(extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """Names with one of the extensions, in either case."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(map(either, extensions)) + "}"


def visible(files: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """``files`` whose names and folders below ``root`` are not hidden; the folder itself may have a hidden name."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString()
    below = F.when(F.col("path").startswith(top), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.col("path"))
    return files.where(~below.rlike(r"/\.[^/]"))


def _zip_kind(data: bytes) -> str:
    """epub, cbz or unknown; an archive cut short is judged by its local headers."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if "mimetype" in names and z.read("mimetype").strip() == b"application/epub+zip":
                return "epub"
    except (zipfile.BadZipFile, KeyError, ValueError, NotImplementedError, RuntimeError, EOFError, OSError):
        names, at = [], 0
        while data[at : at + 4] == b"PK\x03\x04" and at + 30 <= len(data):
            size = int.from_bytes(data[at + 18 : at + 22], "little")
            n, extra = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (26, 28))
            name = data[at + 30 : at + 30 + n].decode("utf-8", "replace")
            body = data[at + 30 + n + extra :][:size]
            if name == "mimetype" and body.strip() == b"application/epub+zip":
                return "epub"
            names.append(name)
            at += 30 + n + extra + size
    real = [n.lower() for n in names if not n.endswith("/") and not n.lower().startswith(("__macosx", "."))]
    return "cbz" if any(n.endswith(IMAGES) for n in real) else "unknown"


def _zip_kinds(content: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    def run(x):
        return pd.Series([_zip_kind(b) if b is not None else None for b in x], dtype="object")

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return pandas_udf(run, "string")(content)


def detected(files: DataFrame) -> DataFrame:
    """``files`` with ``format`` by their bytes, never by their names; null for fewer than eight bytes."""
    head = F.substring("content", 1, HEADER)
    hexed = F.hex(head)
    starts = lambda b: hexed.startswith(b.hex().upper())
    readable = F.expr(f"is_valid_utf8(cast(substring(content, 1, {HEADER}) as string))")
    # a character may be cut at the end of the header
    whole = readable | F.expr("exists(sequence(1, 3), i -> is_valid_utf8(cast(substring(content, 1, least(length(content), " + str(HEADER) + ") - i) as string)))")
    plain = F.when(F.expr(f"contains(cast(substring(content, 1, {HEADER}) as string), '<FictionBook')"), "fb2").when(whole & ~hexed.rlike("^(..)*00"), "txt").otherwise("unknown")
    zipped = starts(b"PK\x03\x04")
    kind = F.when(starts(b"%PDF-"), "pdf").when(starts(b"AT&TFORM"), "djvu").when(F.substring(hexed, 121, 16) == b"BOOKMOBI".hex().upper(), "mobi").when(~zipped, plain)
    by_magic = files.withColumn("format", F.when(F.length("content") >= SMALLEST, kind))
    archive = F.when(zipped & (F.length("content") >= SMALLEST), F.col("content"))
    return by_magic.withColumn("format", F.coalesce("format", _zip_kinds(archive)))


def manifest(files: DataFrame) -> DataFrame:
    """(format, n, bytes) of detected files."""
    return files.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def front_back(n: Column, ends: int) -> Column:
    """Places 0.. of the first and last ``ends`` of ``n`` units, all of them if these meet."""
    every = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i - 1), lambda i: i < n)
    return F.filter(every, lambda i: (n <= 2 * ends) | (i < ends) | (i >= n - ends))


def text_ends(content: Column, ends: int = TXT_BYTES) -> Column:
    """Head and tail of a plain text, in bytes, a line break between; short texts whole."""
    cut = lambda start: F.make_valid_utf8(F.substring(content, start, ends).cast("string"))
    return F.when(F.length(content) <= 2 * ends, F.make_valid_utf8(content.cast("string"))).otherwise(F.concat_ws("\n", cut(1), cut(-ends)))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _package(z: zipfile.ZipFile) -> tuple[str, ElementTree.Element]:
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    path = next(e.attrib["full-path"] for e in container.iter() if _local(e) == "rootfile")
    return path, ElementTree.fromstring(z.read(path))


def _opened(data: bytes) -> tuple[zipfile.ZipFile, str, ElementTree.Element] | None:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        return z, *_package(z)
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, ValueError, RuntimeError, NotImplementedError, EOFError, OSError):
        return None


def _epub(data: bytes) -> dict | None:
    if (book := _opened(data)) is None:
        return None
    root = book[2]
    meta = [e for e in root.iter() if _local(e) in ("title", "creator", "language", "publisher", "date", "description", "subject", "identifier", "meta")]
    text = lambda e: (e.text or "").strip()
    every = lambda name: [text(e) for e in meta if _local(e) == name and text(e)]
    refined = {(e.attrib.get("refines", "").lstrip("#"), e.attrib["property"]): text(e) for e in meta if "property" in e.attrib}
    named = {e.attrib["name"]: e.attrib.get("content", "") for e in meta if "name" in e.attrib}
    titles = [(refined.get((e.attrib.get("id", ""), "title-type")), text(e)) for e in meta if _local(e) == "title" and text(e)]
    title = next((t for kind, t in titles if kind == "main"), next((t for kind, t in titles if kind != "subtitle"), None))
    collection = next((e for e in meta if e.attrib.get("property") == "belongs-to-collection"), None)
    series = named.get("calibre:series") or (text(collection) if collection is not None else None)
    place = named.get("calibre:series_index") or (refined.get((collection.attrib.get("id", ""), "group-position")) if collection is not None else None)
    try:
        position = float(place) if place else None
    except ValueError:
        position = None
    scheme = lambda e: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "scheme"), None)
    first = lambda name: next(iter(every(name)), None)
    return {
        "title": title, "subtitle": next((t for kind, t in titles if kind == "subtitle"), None), "authors": every("creator"), "language": first("language"), "publisher": first("publisher"), "published": first("date"),
        "description": first("description"), "subjects": every("subject"), "identifiers": [{"scheme": scheme(e), "value": text(e)} for e in meta if _local(e) == "identifier" and text(e)], "series": series or None, "position": position,
    }


def epub_metadata(files: DataFrame) -> DataFrame:
    """Metadata of EPUB files, a row for each that can be read: Dublin Core, title kinds, series, raw identifiers."""
    names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", METADATA)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p, **got} for p, c in zip(frame["path"], frame["content"], strict=True) if (got := _epub(c)) is not None]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, METADATA)


def _chosen(n: int, ends: int) -> list[int]:
    return [i for i in range(n) if n <= 2 * ends or i < ends or i >= n - ends]


def _plain(markup: str) -> str:
    return " ".join(re.sub(r"(?s)<[^>]*>", " ", markup).split())


def _epub_text(data: bytes, ends: int) -> str | None:
    if (book := _opened(data)) is None:
        return None
    z, path, root = book
    items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if _local(e) == "item" and {"id", "href"} <= e.attrib.keys()}
    spine = [items[e.attrib["idref"]] for e in root.iter() if _local(e) == "itemref" and e.attrib.get("idref") in items]
    there = set(z.namelist())
    paths = [posixpath.normpath(posixpath.join(posixpath.dirname(path), spine[i])) for i in _chosen(len(spine), ends)]
    return " ".join(_plain(z.read(p).decode("utf-8", "replace")) for p in paths if p in there)


def _fb2_text(data: bytes, ends: int) -> str | None:
    sections = re.findall(r"(?s)<section\b.*?</section>", data.decode("utf-8", "replace"))
    return " ".join(_plain(sections[i]) for i in _chosen(len(sections), ends))


def content_text(files: DataFrame) -> DataFrame:
    """(path, text) of the beginning and end of detected EPUB, FB2 and plain text files; other formats have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [_epub_text(c, EPUB_PARTS) if f == "epub" else _fb2_text(c, FB2_SECTIONS) for f, c in zip(frame["format"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "text": pd.Series(got, dtype="object")})

    marked = files.where("format in ('epub', 'fb2')").select("path", "format", "content").mapInPandas(run, "path string, text string")
    plain = files.where("format = 'txt'").select("path", text_ends(F.col("content")).alias("text"))
    return marked.unionByName(plain).where("text is not null")
