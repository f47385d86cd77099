"""MOBI headers: built files, cut files, wrong lengths, encodings."""

import random
import struct

from pyspark.sql import functions as F

from shelfspark.functions import words as W
from shelfspark.sources.mobi import mobi_metadata


def mobi(title, entries=(), encoding=65001, flags=0x40, count=None, records=2, tail=b"text" * 50):
    code = "cp1252" if encoding == 1252 else "utf-8"
    raw = title if isinstance(title, bytes) else title.encode(code)
    body = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in ((k, v if isinstance(v, bytes) else v.encode(code)) for k, v in entries))
    exth = b"EXTH" + struct.pack(">II", 12 + len(body), len(entries) if count is None else count) + body
    length = 232
    head = bytearray(16 + length)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 20, length)
    struct.pack_into(">I", head, 28, encoding)
    struct.pack_into(">II", head, 84, len(head) + len(exth), len(raw))
    struct.pack_into(">I", head, 128, flags)
    first = bytes(head) + exth + raw
    at = 78 + 8 * records + 2
    table = b"".join(struct.pack(">II", at + (len(first) if i else 0), i) for i in range(records))
    return b"name".ljust(60, b"\0") + b"BOOKMOBI" + bytes(8) + struct.pack(">H", records) + table + b"\0\0" + first + tail


ENTRIES = [(100, "Ann Ö"), (100, "Bo"), (101, "Press"), (103, "<p>About</p>"), (104, "978-3-16-148410-0"), (105, "One"), (105, "Two"), (106, "2009-05-01"), (113, "B00ABCDEFG"), (524, "de"), (999, b"\xff\xfe"), (503, "The Üpdated\0\0")]


def read(spark, *contents):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content binary")
    return {r.path: r for r in mobi_metadata(df).collect()}


def test_entries_and_title(spark):
    got = read(spark, mobi("Plain", ENTRIES), mobi("Nur Titel", flags=0), mobi("“Größe” €", [(100, "Zoë – X")], encoding=1252), mobi("one record", ENTRIES[:1], records=1, tail=b""))
    a = got["0"]
    assert (a.title, a.authors, a.publisher, a.description, a.subjects, a.published, a.language) == ("The Üpdated", ["Ann Ö", "Bo"], "Press", "<p>About</p>", ["One", "Two"], "2009-05-01", "de")
    assert [tuple(i) for i in a.identifiers] == [("ISBN", "978-3-16-148410-0"), ("ASIN", "B00ABCDEFG")] and a.subtitle is None and a.position is None
    assert (got["1"].title, got["1"].authors, got["1"].publisher) == ("Nur Titel", [], None)
    assert (got["2"].title, got["2"].authors) == ("“Größe” €", ["Zoë – X"])
    assert (got["3"].title, got["3"].authors) == ("one record", ["Ann Ö"])


def test_identifiers_are_classified_like_those_of_other_formats(spark):
    df = mobi_metadata(spark.createDataFrame([("a", mobi("T", ENTRIES))], "path string, content binary"))
    ids = df.select(F.explode("identifiers").alias("i")).select(W.parse_identifier(F.col("i.value"), F.col("i.scheme")).alias("p")).collect()
    assert [tuple(r.p) for r in ids] == [("isbn13", "9783161484100"), ("asin", "B00ABCDEFG")]


def test_damaged_files(spark):
    whole = mobi("Title", ENTRIES)
    wrong = bytearray(mobi("Title", [(100, "A"), (101, "P"), (105, "S")]))
    at = bytes(wrong).index(b"P") - 4
    struct.pack_into(">I", wrong, at, 1 << 31)  # the publisher's length
    short = bytearray(mobi("Title", [(100, "A"), (101, "P")]))
    struct.pack_into(">I", short, bytes(short).index(b"P") - 4, 3)  # less than its own head
    got = read(spark, None, b"", b"BOOKMOBI", whole[:70], bytes(wrong), bytes(short), mobi("Title", [(100, "A")], count=2**32 - 1), mobi(b"\xff bad", []), whole.replace(b"MOBI\0\0", b"XOBI\0\0"), whole.replace(b"EXTH", b"EXTX"))
    assert set(got) == {"4", "5", "6", "7", "9"}
    assert (got["4"].authors, got["4"].publisher, got["4"].subjects, got["4"].title) == (["A"], None, [], "Title")
    assert (got["5"].authors, got["5"].publisher) == (["A"], None)
    assert got["6"].authors[0] == "A" and got["7"].title == "� bad" and got["9"].authors == []


def test_cut_anywhere_never_fails(spark):
    rng, whole = random.Random(5), mobi("Title", ENTRIES, tail=b"")
    noise = []
    for _ in range(150):
        b = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.5 else whole)
        for _ in range(rng.randrange(4)):
            if len(b) > 68:
                b[rng.randrange(68, len(b))] = rng.randrange(256)
        noise.append(bytes(b))
    assert len(read(spark, *noise)) <= 150 and read(spark, whole)["0"].title == "The Üpdated"


def test_empty_table(spark):
    assert read(spark) == {}
