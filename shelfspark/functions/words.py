"""More scalar functions: titles for search, casing, identifiers, scans, languages, paths, provider strings, likeness."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

SEPARATORS = (": ", " - ", " — ")
# Words that title case keeps small unless they come first.
MINOR_WORDS = ("a", "an", "the", "and", "but", "or", "nor", "for", "yet", "so", "at", "by", "in", "of", "on", "to", "up", "as", "is", "if", "it", "vs", "via")
# Placeholders that are no title, no author and no ISBN.
GARBAGE_TITLES = ("unknown", "unknown title", "untitled", "title", "n/a", "na", "none", "calibre")
GARBAGE_AUTHORS = ("unknown", "unknown author", "various", "various authors", "author", "n/a", "na", "none", "calibre", "calibre ebook management")
PLACEHOLDER_ISBNS = ("0000000000", "0000000000000", "9780000000000", "1234567890", "1234567890123", "9781234567890")
# Physical formats that are no text.
UNSUPPORTED_FORMATS = ("audio", "sound recording", "videorecording", "mp3", "listened", "watched")
# Folders that name no author or title, and the extensions that titles made of file names end in.
INFRASTRUCTURE = ("books", "cache", "clean", "data", "downloads", "ebooks", "fresh", "import", "imports", "inbox", "ingestion", "library", "media", "staging", "storage", "tmp", "uploads")
KNOWN_EXTENSIONS = ("epub", "pdf", "mobi", "azw3", "cbz", "fb2", "txt", "djvu")
TITLE_EXTENSIONS = ("epub", "pdf", "mobi", "azw", "azw3", "fb2", "djvu", "cbr", "cbz", "txt")
# Relator codes and what they stand for.
RELATORS = {"aut": "author", "edt": "editor", "ed": "editor", "trl": "translator", "tr": "translator", "ill": "illustrator", "com": "compiler", "ctb": "contributor", "nrt": "narrator", "adp": "adapter", "ann": "annotator", "aui": "author of introduction", "cre": "creator", "pht": "photographer"}
# 639-1 code, 639-3 code, 639-2/B code where it differs, English name, native name.
LANGUAGES = (
    ("ar", "ara", "", "arabic", "العربية"), ("bg", "bul", "", "bulgarian", "български"), ("ca", "cat", "", "catalan", "català"), ("cs", "ces", "cze", "czech", "čeština"),
    ("cy", "cym", "wel", "welsh", "cymraeg"), ("da", "dan", "", "danish", "dansk"), ("de", "deu", "ger", "german", "deutsch"), ("el", "ell", "gre", "greek", "ελληνικά"),
    ("en", "eng", "", "english", "english"), ("es", "spa", "", "spanish", "español"), ("et", "est", "", "estonian", "eesti"), ("eu", "eus", "baq", "basque", "euskara"),
    ("fa", "fas", "per", "persian", "فارسی"), ("fi", "fin", "", "finnish", "suomi"), ("fr", "fra", "fre", "french", "français"), ("ga", "gle", "iri", "irish", "gaeilge"),
    ("he", "heb", "", "hebrew", "עברית"), ("hi", "hin", "", "hindi", "हिन्दी"), ("hr", "hrv", "", "croatian", "hrvatski"), ("hu", "hun", "", "hungarian", "magyar"),
    ("hy", "hye", "arm", "armenian", "հայերեն"), ("id", "ind", "", "indonesian", "bahasa indonesia"), ("is", "isl", "ice", "icelandic", "íslenska"), ("it", "ita", "", "italian", "italiano"),
    ("ja", "jpn", "", "japanese", "日本語"), ("ka", "kat", "geo", "georgian", "ქართული"), ("ko", "kor", "", "korean", "한국어"), ("lt", "lit", "", "lithuanian", "lietuvių"),
    ("lv", "lav", "", "latvian", "latviešu"), ("mi", "mri", "mao", "maori", "te reo māori"), ("mk", "mkd", "mac", "macedonian", "македонски"), ("ms", "msa", "may", "malay", "bahasa melayu"),
    ("my", "mya", "bur", "burmese", "မြန်မာဘာသာ"), ("nl", "nld", "dut", "dutch", "nederlands"), ("no", "nor", "", "norwegian", "norsk"), ("pl", "pol", "", "polish", "polski"),
    ("pt", "por", "", "portuguese", "português"), ("ro", "ron", "rum", "romanian", "română"), ("ru", "rus", "", "russian", "русский"), ("sk", "slk", "slo", "slovak", "slovenčina"),
    ("sl", "slv", "", "slovenian", "slovenščina"), ("sq", "sqi", "alb", "albanian", "shqip"), ("sr", "srp", "", "serbian", "srpski"), ("sv", "swe", "", "swedish", "svenska"),
    ("th", "tha", "", "thai", "ไทย"), ("bo", "bod", "tib", "tibetan", "བོད་སྐད"), ("tr", "tur", "", "turkish", "türkçe"), ("uk", "ukr", "", "ukrainian", "українська"),
    ("ur", "urd", "", "urdu", "اردو"), ("vi", "vie", "", "vietnamese", "tiếng việt"), ("zh", "zho", "chi", "chinese", "中文"),
)
_ALNUM = r"\p{IsAlphabetic}\p{N}"


def _null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


# --- titles and names ---------------------------------------------------------------------------------------


def title_for_search(c: Column) -> Column:
    """The part before the first separator that has two words or more before it."""
    cut = [F.when(c.contains(s) & (_n_words(F.substring_index(c, s, 1)) >= 2), F.substring_index(c, s, 1)) for s in SEPARATORS]
    return F.coalesce(*cut, c)


def comparison_form(c: Column) -> Column:
    """Lower case, other symbols to blanks, one leading English article off even if it is all."""
    t = F.trim(F.regexp_replace(F.lower(c), rf"[^{_ALNUM}]+", " "))
    return F.regexp_replace(t, r"^(the|an|a)( |$)", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"[^{_ALNUM}]", "")


def _shouted(c: Column) -> Column:
    return c.rlike(r"\p{IsAlphabetic}") & ~c.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def titlecase(c: Column) -> Column:
    """English title case that keeps white space; an all-capitals title is lowered first."""
    t = F.when(_shouted(c), F.lower(c)).otherwise(c)
    chunks = F.regexp_extract_all(t, F.lit(r"\s+|\S+"), F.lit(0))
    first = F.when(F.get(chunks, F.lit(0)).rlike(r"^\s"), 1).otherwise(0)
    word = lambda x, i: F.when((i != first) & F.lower(x).isin(*MINOR_WORDS), F.lower(x)).otherwise(_capital(x))
    return F.array_join(F.transform(chunks, word), "")


def author_casing(c: Column) -> Column:
    """Names of capitals, letters and blanks only, as ``First Last``; others stay."""
    chunks = F.regexp_extract_all(F.lower(c), F.lit(r"\s+|\S+"), F.lit(0))
    return F.when(c.rlike(r"^[\p{IsAlphabetic}\s]+$") & _shouted(c), F.array_join(F.transform(chunks, lambda x: _capital(x)), "")).otherwise(c)


def is_garbage_title(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*GARBAGE_TITLES)


def is_garbage_author(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*GARBAGE_AUTHORS)


def is_likely_filename(c: Column) -> Column:
    return F.lower(c).rlike(rf"\.({'|'.join(TITLE_EXTENSIONS)})$")


def titles_equivalent(a: Column, b: Column) -> Column:
    """Equal or one inside the other, after lowering and collapsing blanks."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return norm(a).contains(norm(b)) | norm(b).contains(norm(a))


def titles_contradict(current: Column, proposed: Column) -> Column:
    """Neither is empty, the current one is no file name, none contains the other and no word of over two bytes is shared."""
    a, b = F.lower(current), F.lower(proposed)
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.octet_length(w) > 2)
    return (a != "") & (b != "") & ~is_likely_filename(current) & ~a.contains(b) & ~b.contains(a) & ~F.coalesce(F.size(F.array_intersect(words(a), words(b))) > 0, F.lit(False))


def name_matches(a: Column, b: Column) -> Column:
    """Equal names, or the same last name and first names of one initial."""
    x, y = comparison_form(a), comparison_form(b)
    p, q = F.split(x, " "), F.split(y, " ")
    return (x == y) | ((F.size(p) >= 2) & (F.size(q) >= 2) & (F.element_at(p, -1) == F.element_at(q, -1)) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)))


# --- identifiers -----------------------------------------------------------------------------------------------


def to_isbn13(kind: Column, value: Column) -> Column:
    """ISBN-13 as it is, ISBN-10 converted if valid, other types null."""
    return F.when(kind == "isbn13", value).when(kind == "isbn10", T.isbn10_to_13(value))


def classify_isbn(normalized: Column) -> Column:
    """Struct (type, value) by shape alone, or null."""
    kind = F.when(normalized.rlike(r"^97[89][0-9]{10}$"), "isbn13").when(normalized.rlike(r"^[0-9]{9}[0-9Xx]$"), "isbn10")
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.upper(normalized).alias("value")))


def parse_identifier(raw: Column, scheme: Column) -> Column:
    """Struct (type, value) of a raw identifier: ISBN by shape, ASIN if the scheme says so or it begins with B."""
    v = F.regexp_replace(raw, "[- ]", "")
    asin = T.is_asin(v) & (F.coalesce(F.upper(scheme).contains("ASIN"), F.lit(False)) | v.startswith("B"))
    hinted = F.coalesce(F.upper(scheme).contains("ASIN") & ~F.upper(scheme).contains("ISBN"), F.lit(False)) & T.is_asin(v)
    as_asin = F.struct(F.lit("asin").alias("type"), v.alias("value"))
    return F.when(hinted, as_asin).otherwise(F.coalesce(classify_isbn(v), F.when(asin, as_asin)))


def is_valid_identifier(kind: Column, value: Column) -> Column:
    """ISBNs need a right checksum and no placeholder; other types count as valid."""
    real = ~value.isin(*PLACEHOLDER_ISBNS)
    return F.when(kind == "isbn13", real & T.isbn13_ok(value)).when(kind == "isbn10", real & T.isbn10_ok(value)).otherwise(F.lit(True))


def lccn_values(c: Column) -> Column:
    """Distinct control numbers of 8 to 12 digits: after their label first, then those of addresses."""
    label = F.regexp_extract_all(c, F.lit(r"(?i)\b(?:LCCN|Library\s+of\s+Congress\s+Control\s+Number)\b\s*:?\s*((?:\d[\s-]?){8,12})\b"), F.lit(1))
    url = F.regexp_extract_all(c, F.lit(r"(?i)\blccn\.loc\.gov/(\d{8,12})\b"), F.lit(1))
    digits = F.transform(F.concat(label, url), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.array_distinct(F.filter(digits, lambda x: F.length(x).between(8, 12)))


def scan_isbns(c: Column, checksum: bool = True) -> Column:
    """``type:value`` of distinct ISBNs of a text, ISBN-13 first, each in order of appearance.

    A candidate for ISBN-10 that overlaps a control number is none; that needs
    the places of matches, so batches of texts go to Python once.
    """
    import re

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    lccn = (re.compile(r"(?i)\b(?:LCCN|Library\s+of\s+Congress\s+Control\s+Number)\b\s*:?\s*((?:\d[\s-]?){8,12})\b"), re.compile(r"(?i)\blccn\.loc\.gov/(\d{8,12})\b"))
    thirteen, ten = re.compile(r"(97[89][\d\- ]{9,16}\d)\b"), re.compile(r"(\d[\d\- ]{8,12}[\dXx])\b")

    def valid(v: str) -> bool:
        if len(v) == 13:
            return sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(v)) % 10 == 0
        return sum((10 if d == "X" else int(d)) * (10 - i) for i, d in enumerate(v)) % 11 == 0

    def one(text: str) -> list[str]:
        out = {}
        for m in thirteen.finditer(text):
            v = re.sub("[^0-9]", "", m[1])
            if len(v) == 13 and (valid(v) or not checksum):
                out["isbn13:" + v] = None
        taken = [m.span(1) for p in lccn for m in p.finditer(text)]
        for m in ten.finditer(text):
            v = re.sub("[^0-9Xx]", "", m[1]).upper()
            free = not any(m.start(1) < b and a < m.end(1) for a, b in taken)
            if free and re.fullmatch(r"(?!97[89])[0-9]{9}[0-9X]", v) and (valid(v) or not checksum):
                out["isbn10:" + v] = None
        return list(out)

    def run(x):
        return pd.Series([one(t) if t else [] for t in x])

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return pandas_udf(run, "array<string>")(c)


def scan_confidence(base: Column, found: Column) -> Column:
    """Less for more ISBNs in a text: 1, 0.8, 0.6 of ``base``; none gives 0."""
    factor = F.when(found <= 0, 0.0).when(found == 1, 1.0).when(found == 2, 0.8).otherwise(0.6)
    return F.least(F.greatest(base * factor, F.lit(0.0)), F.lit(1.0))


# --- languages ---------------------------------------------------------------------------------------------------


@cache
def _languages() -> dict[str, tuple[str, str, str]]:
    """Two-letter code -> (three-letter code, English name, native name) of all languages that Java's ISO 639 tables know; ``LANGUAGES`` goes first."""
    from pyspark import SparkContext

    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    out = {row[0]: (row[1], row[3], row[4]) for row in LANGUAGES}
    for code in locale.getISOLanguages():
        own = locale(code)
        if len(code) == 2 and own.toLanguageTag() == code:  # three old codes have become others
            out.setdefault(str(code), (str(own.getISO3Language()), str(own.getDisplayLanguage(locale.ENGLISH)).lower(), str(own.getDisplayLanguage(own)).lower()))
    return out


@cache
def _language_keys() -> dict[str, str]:
    """Codes and names of every language, by the two-letter code each stands for; codes win over names."""
    names = {n: code for code, row in _languages().items() for n in row[1:]}
    return names | {row[2]: row[0] for row in LANGUAGES if row[2]} | {k: code for code, row in _languages().items() for k in (row[0], code)}


def language_code(value: str) -> str | None:
    """``normalize_language`` of one value."""
    first = value.strip().lower()
    return _language_keys().get(re.split("[-_]", first)[0].strip() if re.search("[-_]", first) else first)


def normalize_language(c: Column, more: dict[str, str] | None = None) -> Column:
    """Two-letter code of a code, tag or name of any ISO 639-1 language (and of ``more``); unknown and ``und`` give null."""
    table = _language_keys() | (more or {})
    first = F.lower(F.trim(c))
    key = F.when(first.rlike("[-_]"), F.trim(F.regexp_extract(first, "^([^-_]*)", 1))).otherwise(first)
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def language_label(code: Column) -> Column:
    """English name of a two-letter code."""
    return F.create_map(*[F.lit(x) for c, row in _languages().items() for x in (c, row[1].title())])[code]


def is_language_code(code: Column) -> Column:
    """Whether it is a two-letter code of ISO 639-1."""
    return F.coalesce(code.isin(*_languages()), F.lit(False))


# --- years, lists, provider strings ---------------------------------------------------------------------------------


def first_year(c: Column) -> Column:
    """A bare number, else the first four digits in a row."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")).otherwise(F.regexp_extract(t, r"([0-9]{4})", 1).try_cast("int"))


def pdf_year(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:D:)?([0-9]{4})", 1).try_cast("int")


def bare_date(c: Column) -> Column:
    """A catalogue date without copyright signs and brackets."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), "^c+", ""), "^©+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^\[+|\[+$", ""), r"^\]+|\]+$", ""))


def split_list(c: Column) -> Column:
    parts = F.split(c, F.when(c.contains(";"), ";").otherwise(","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def parse_series(c: Column) -> dict[str, Column]:
    """Name (in title case) and position of ``Name, #6`` and shorter forms."""
    t = F.trim(c)
    pattern = r"^(.*?[^,#\s])[,#\s]+(\d+(?:\.\d+)?)$"
    return {"name": titlecase(F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t)), "position": F.regexp_extract(t, pattern, 2).try_cast("double")}


def is_imprint(series: Column, publishers: Column) -> Column:
    """Whether a series shares a word with one of ``publishers`` (an array)."""
    words = lambda c: F.split(F.lower(F.trim(c)), r"\s+")
    return F.coalesce(F.exists(publishers, lambda p: F.arrays_overlap(words(series), words(p))), F.lit(False))


def clean_catalog_name(c: Column) -> Column:
    """``Last, First (Full), 1900-1980.`` as ``First Last``."""
    t = F.trim(F.regexp_replace(F.trim(c), r",?\s*\d{4}\s*-\s*\d{0,4}\s*$|,?\s*-\s*\d{4}\s*$|,?\s+\d{4}\s*$", ""))
    t = F.trim(F.regexp_replace(t, r"\s*\([^)]*\)\s*", " "))
    t = F.when(t.rlike(r"\.$") & ~t.rlike(r"(^|\s)\p{IsAlphabetic}\.$"), F.regexp_replace(t, r"\s*\.$", "")).otherwise(t)
    t = F.trim(F.regexp_replace(t, "[,;]+$", ""))
    last, first = F.trim(F.substring_index(t, ", ", 1)), F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, "^.*?, (.*)$", 1)), "[,;]+$", ""))
    return F.when((first != "") & (last != ""), F.concat_ws(" ", first, last)).otherwise(t)


def relator_role(c: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RELATORS.items() for x in kv])[t], t)


def extent_pages(c: Column) -> Column:
    """The last number before ``p`` or ``pages``."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(c, F.lit(r"(\d+)\s*(?:p\b|pages?\b)"), F.lit(1))), -1).try_cast("int")


def part_number(c: Column) -> Column:
    """The last word that is a number, trailing dots off."""
    numbers = F.filter(F.transform(F.split(F.trim(c), r"\s+"), lambda x: F.regexp_replace(x, r"\.+$", "").try_cast("double")), lambda x: x.isNotNull())
    return F.element_at(F.concat(F.array(F.lit(None).cast("double")), numbers), -1)


def split_on_subtitle(title: Column, subtitle: Column) -> Column:
    """The main title if ``subtitle`` follows it after a separator, else null."""
    cuts = []
    for s in SEPARATORS:
        at = F.call_function("locate", F.lower(F.concat(F.lit(s), subtitle)), F.lower(title), F.lit(2))
        cuts.append(F.when(at > 1, _null_if_blank(title.substr(F.lit(1), at - 1))))
    return F.coalesce(*cuts)


def is_unsupported_format(c: Column) -> Column:
    return F.lower(c).rlike("|".join(UNSUPPORTED_FORMATS))


def decision_code(c: Column) -> Column:
    return F.trim(F.substring_index(c, ":", 1))


def trusted_publishers(books: DataFrame, rules: DataFrame) -> DataFrame:
    """``books`` with ``publisher_trusted``: an enabled rule ``(match_mode, match_value, enabled)`` matches ``publisher_name``.

    Rules are a small settings table, matched once for each distinct name.
    """
    a_to_z = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = books.select(F.col("publisher_name").alias("name_")).where("name_ is not null").distinct()
    on = F.broadcast(rules.where("enabled").select("match_mode", "match_value"))
    exact = (F.col("match_mode") == "exact") & (a_to_z(F.col("name_")) == a_to_z(F.col("match_value")))
    inside = (F.col("match_mode") == "contains") & F.lower("name_").contains(F.lower("match_value"))
    hit = names.join(on, exact | inside, "left_semi").withColumn("hit_", F.lit(True))
    return books.join(hit, books["publisher_name"] == hit["name_"], "left").withColumn("publisher_trusted", F.coalesce("hit_", F.lit(False))).drop("name_", "hit_")


# --- file names and paths ------------------------------------------------------------------------------------------------


def parse_filename(c: Column) -> dict[str, Column]:
    """author, title, series, position, year: five patterns in order, else the title alone."""
    stem = F.translate(F.regexp_replace(c, rf"(?i)\.({'|'.join(KNOWN_EXTENSIONS)})$", ""), "_", " ")
    series = r"\[(.+?)(?:\s*#\s*(\d+(?:\.\d+)?))?\]\s*$"
    patterns = (
        (r"^(.+?)\s+-\s+(.+?)\s*\((\d{4})\)\s*$", ("author", "title", "year")), (rf"^(.+?)\s+-\s+(.+?)\s*{series}", ("author", "title", "series", "position")),
        (r"^(.+?)\s+-\s+(.+?)\s*$", ("author", "title")), (rf"^(.+?)\s*{series}", ("title", "series", "position")), (r"^(.+?)\s*\((\d{4})\)\s*$", ("title", "year")),
    )

    def part(name: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for p, names in patterns:
            value = F.regexp_extract(stem, p, names.index(name) + 1) if name in names else F.lit(None).cast("string")
            out = out.when(stem.rlike(p), _null_if_blank(value))
        return out.otherwise(_null_if_blank(stem) if name == "title" else F.lit(None).cast("string"))

    year = part("year").try_cast("int")
    return {"author": part("author"), "title": part("title"), "series": part("series"), "position": part("position").try_cast("double"), "year": F.when(year.between(1000, 2100), year)}


def parse_path(c: Column) -> dict[str, Column]:
    """As ``parse_filename``, with author and title from the folders above where the name has none."""
    steps = F.filter(F.split(c, "/"), lambda x: ~x.isin("", ".", ".."))
    name, n = F.element_at(steps, -1), F.size(steps)
    got = parse_filename(name)
    usable = lambda x: ~x.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$") & ~F.lower(x).isin(*INFRASTRUCTURE)
    clean = lambda x: _null_if_blank(F.translate(x, "_", " "))
    up = F.when(n >= 2, F.get(steps, n - 2))
    author_dir = F.when(n == 2, up).when(n >= 3, F.get(steps, n - 3))
    bare = got["author"].isNull() & got["series"].isNull() & got["year"].isNull()
    stem = F.translate(F.regexp_replace(name, rf"(?i)\.({'|'.join(KNOWN_EXTENSIONS)})$", ""), "_", " ")
    from_dir = (n >= 3) & (stem != F.translate(up, "_", " ")) & usable(up) & (bare | got["title"].isNull())
    return got | {
        "author": F.coalesce(got["author"], F.when(usable(author_dir), clean(author_dir))),
        "title": F.when(F.coalesce(from_dir, F.lit(False)), clean(up)).otherwise(got["title"]),
    }


def completeness(title: Column, author: Column, series: Column, year: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in ((title, 0.4), (author, 0.3), (series, 0.15), (year, 0.15))])


# What no file name may hold, what is dropped from it, names that systems keep for themselves, bytes of a name.
UNSAFE, DROPPED = r'[<>:"/\\|?*]+', r"[\x00-\x1F\x7F-\x9F؜‎‏‪-‮⁦-⁩]+"
RESERVED = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"
NO_NAME, NAME_BYTES = "_unknown", 255


def path_component(c: Column) -> Column:
    """One safe name: runs of unsafe characters become ``_``, control and reordering ones go, blanks are single, no dots or blanks at the end; nothing left gives ``_unknown``; at most 255 bytes, of which an extension is kept."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), DROPPED, ""), r"(?U)\s+", " ")
    bare = F.regexp_replace(F.regexp_replace(t, UNSAFE, ""), "[ .]+", "")
    t = F.regexp_replace(F.regexp_replace(F.trim(t), UNSAFE, "_"), "[ .]+$", "")
    t = F.when(t.rlike(RESERVED), F.regexp_replace(t, r"^([^.]*)", "$1_")).otherwise(t)
    end = F.regexp_extract(t, r"[^.](\.[^. ]{1,16})$", 1)
    cut = F.substring(t.cast("binary"), F.lit(1), F.lit(NAME_BYTES) - F.octet_length(end)).cast("string")
    # a character cut in two goes as a whole
    short = F.concat(F.regexp_replace(F.make_valid_utf8(cut), "�+$", ""), end)
    return F.when(bare == "", NO_NAME).when(F.octet_length(t) > NAME_BYTES, short).otherwise(t)


def storage_path(author: Column, title: Column, filename: Column) -> Column:
    """``L/author/title/file`` of safe names; ``_`` stands for a first character that is no letter."""
    who = path_component(author)
    first = F.substring(who, 1, 1)
    letter = F.when(first.rlike(r"^\p{IsAlphabetic}$"), F.upper(first)).otherwise("_")
    return F.concat_ws("/", letter, who, path_component(title), path_component(filename))


# --- likeness -----------------------------------------------------------------------------------------------------------------


def title_similarity(a: Column, b: Column) -> Column:
    return T.jaro_winkler(T.normalize_title(a), T.normalize_title(b))


def titles_match(a: Column, b: Column, threshold: float = 0.7) -> Column:
    """One compact title begins with the other, or their trigrams are ``threshold`` alike; an empty one matches nothing."""
    x, y = T.normalize_title(a), T.normalize_title(b)
    p, q = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    return (x != "") & (y != "") & (p.startswith(q) | q.startswith(p) | (T.trigram_similarity(x, y) >= threshold))


def authors_match(a: Column, b: Column, threshold: float = 0.6) -> Column:
    x, y = T.normalize_author(a), T.normalize_author(b)
    return (x != "") & (y != "") & (T.trigram_similarity(x, y) >= threshold)


def ingest_titles_match(a: Column, b: Column) -> Column:
    x, y = compact(a), compact(b)
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))


def search_confidence(result: Column, query: Column, same_isbn: Column) -> Column:
    """0.8 for the ISBN or an equal title, 0.7 if one contains the other, else by the share of words."""
    r, q, m = comparison_form(result), comparison_form(query), comparison_form(title_for_search(query))
    inside = lambda x, y: x.contains(y) | y.contains(x)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    common = F.size(F.filter(words(r), lambda w: F.array_contains(words(q), w)))
    share = common / F.greatest(F.size(words(r)), F.size(words(q)), F.lit(1))
    return (
        F.when(F.coalesce(same_isbn, F.lit(False)), 0.8).when(result.isNull() | query.isNull(), 0.5).when(r == q, 0.8)
        .when(inside(r, q) | ((m != q) & inside(r, m)), 0.7).otherwise(share * 0.3 + 0.5)
    )


def author_similarity(a: Column, b: Column) -> Column:
    """Sum of each name's best likeness in ``b`` over the longer list; two empty lists are alike, one is not."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(x, y):
        return pd.Series([T.lists_alike(list(s), list(t)) for s, t in zip(x, y, strict=True)], dtype="float64")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    some = lambda c: F.coalesce(F.transform(c, T.normalize_author), F.array().cast("array<string>"))
    return pandas_udf(run, "double")(some(a), some(b))
