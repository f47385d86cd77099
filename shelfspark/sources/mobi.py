"""Metadata of MOBI and AZW3 files from their first record, in column functions on the files' bytes.

A file is a table of records; the first holds the format's header, its title
and, if a flag says so, typed entries (author, publisher and so on). Nothing
here leaves the JVM; of a file only this record is carried on.

Defined results: files without the marks of the format, cut before their
title, or null give no row; entries whose length is impossible end the walk,
those before them count; encrypted files give their metadata too, since it
isn't encrypted. Bytes that are no text of the stated encoding are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import METADATA

# Places in the file and its first record, the flag for entries, encodings, types of entries.
DATABASE_TYPE, FIRST_OFFSET, RECORDS = 60, 78, 76
MARK, HEADER_LENGTH, ENCODING, TITLE_OFFSET, TITLE_LENGTH, FLAGS = 16, 20, 28, 84, 88, 128
HAS_ENTRIES, LATIN = 0x40, 1252
AUTHOR, PUBLISHER, DESCRIPTION, ISBN, SUBJECT, PUBLISHED, ASIN, TITLE, LANGUAGE = 100, 101, 103, 104, 105, 106, 113, 503, 524


def _uint(data: Column, at: Column | int, size: int = 4) -> Column:
    """Big-endian number of ``size`` bytes at a place; null past the end."""
    piece = F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(size))
    return F.when(F.length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def _cut(data: Column, at: Column, size: Column) -> Column:
    return F.substring(data, (at + 1).cast("int"), size.cast("int"))


def _text(data: Column, encoding: Column) -> Column:
    """Bytes as text: Windows-1252 where stated, else UTF-8; nulls at the end and blanks around are off."""
    high = [(chr(b), bytes([b]).decode("cp1252", "ignore") or "�") for b in range(0x80, 0xA0)]
    latin = F.translate(F.decode(data, "ISO-8859-1"), "".join(a for a, _ in high), "".join(b for _, b in high))
    text = F.when(encoding == LATIN, latin).otherwise(F.make_valid_utf8(data.cast("string")))
    return F.trim(F.regexp_replace(text, "\\x00+$", ""))


def _entries(record: Column) -> Column:
    """Array of (kind, data) of the typed entries behind the header; empty without them."""
    start = _uint(record, HEADER_LENGTH) + MARK
    on = (_uint(record, FLAGS).bitwiseAND(HAS_ENTRIES) != 0) & (F.hex(_cut(record, start, F.lit(4))) == b"EXTH".hex().upper())
    kind = "array<struct<kind:int,data:binary>>"
    begin = F.struct((start + 12).alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, _: Column) -> Column:
        at, size = state["at"], _uint(record, (state["at"] + 4).cast("int"))
        good = (size >= 8) & (at + size <= F.length(record))
        entry = F.struct(_uint(record, at.cast("int")).cast("int").alias("kind"), _cut(record, at + 8, size - 8).alias("data"))
        # a place past the end keeps all later steps there
        after = F.struct((at + size).alias("at"), F.concat(state["found"], F.array(entry)).cast(kind).alias("found"))
        return F.when(good, after).otherwise(F.struct((F.length(record) + F.lit(1)).cast("long").alias("at"), state["found"].alias("found")))

    # an entry has eight bytes at least, whatever the count says
    most = F.least(_uint(record, (start + 8).cast("int")), (F.length(record) / 8).cast("long"))
    walked = F.aggregate(F.filter(F.sequence(F.lit(0), F.coalesce(most, F.lit(0))), lambda i: i > 0), begin, step, lambda s: s["found"])
    return F.when(on & (start + 12 <= F.length(record)), walked).otherwise(F.array().cast(kind))


def mobi_metadata(files: DataFrame) -> DataFrame:
    """Metadata of ``files(path, content)``, in the columns of ``files.epub_metadata``; published is as it stands in the file."""
    c = F.col("content")
    marked = F.hex(F.substring(c, DATABASE_TYPE + 1, 8)) == b"BOOKMOBI".hex().upper()
    first, second = _uint(c, FIRST_OFFSET), _uint(c, FIRST_OFFSET + 8)
    end = F.when((_uint(c, RECORDS, 2) > 1) & (second > first), second).otherwise(F.length(c))
    rows = files.where(marked).select("path", _cut(c, first, end - first).alias("r"))
    r = F.col("r")
    rows = rows.where(F.hex(F.substring(r, MARK + 1, 4)) == b"MOBI".hex().upper())
    name = F.when(_uint(r, TITLE_OFFSET) + _uint(r, TITLE_LENGTH) <= F.length(r), _cut(r, _uint(r, TITLE_OFFSET), _uint(r, TITLE_LENGTH)))
    rows = rows.select("path", _uint(r, ENCODING).alias("encoding"), name.alias("name"), _entries(r).alias("entries")).where("name is not null")
    rows = rows.withColumn("entries", F.transform("entries", lambda e: F.struct(e["kind"].alias("kind"), _text(e["data"], F.col("encoding")).alias("value"))))
    every = lambda kind: F.transform(F.filter("entries", lambda e: (e["kind"] == kind) & (e["value"] != "")), lambda e: e["value"])
    one = lambda kind: F.get(every(kind), 0)
    named = lambda kind, scheme: F.transform(every(kind), lambda v: F.struct(F.lit(scheme).alias("scheme"), v.alias("value")))
    values = {
        "title": F.coalesce(one(TITLE), F.nullif(_text(F.col("name"), F.col("encoding")), F.lit(""))), "authors": every(AUTHOR), "language": one(LANGUAGE), "publisher": one(PUBLISHER), "published": one(PUBLISHED),
        "description": one(DESCRIPTION), "subjects": every(SUBJECT), "identifiers": F.concat(named(ISBN, "ISBN"), named(ASIN, "ASIN")),
    }
    schema = files.sparkSession.createDataFrame([], METADATA).schema
    return rows.select(*[F.col("path") if f.name == "path" else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
