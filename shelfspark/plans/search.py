"""The search language: text to clauses, and clauses to a filter over the catalog."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored

# Fields and their short names.
FIELDS = ("title", "author", "series", "publisher", "tag", "format", "status", "resolution", "outcome", "trusted", "locked", "language", "year", "has", "missing", "identifier", "description")
ALIASES = {"pub": "publisher", "desc": "description", "fmt": "format", "lang": "language", "id": "identifier"}


@dataclass(frozen=True)
class Text:
    words: str
    negated: bool = False


@dataclass(frozen=True)
class Phrase:
    words: str
    negated: bool = False


@dataclass(frozen=True)
class Field:
    name: str
    value: str
    negated: bool = False


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass
class Parsed:
    clauses: list
    empty_fields: list = field(default_factory=list)


_TOKEN = re.compile(r'(-?)"([^"]*)(?:"|$)|((?:[^\s":]+:"[^"]*(?:"|$))|[^\s"]+)')


def parse(query: str) -> Parsed:
    """Clauses of a query. ``OR`` groups neighbours, ``-`` negates, quotes make phrases; unknown fields are plain text."""
    items, empty, dash = [], [], False
    for m in _TOKEN.finditer(query):
        if m[3] is None:
            words = m[2].strip()
            if words:
                items.append(Phrase(words, negated=bool(m[1]) or dash))
            dash = False
            continue
        word, dash = m[3], False
        if word == "-":
            dash = True
            continue
        if word == "OR":
            items.append("OR")
            continue
        negated = word.startswith("-") and not word.startswith("--")
        body = word[1:] if negated else word
        name, colon, value = body.partition(":")
        name = ALIASES.get(name, name)
        if colon and name in FIELDS:
            value = value.strip('"').strip()
            if value:
                items.append(Field(name, value, negated))
            else:
                empty.append((name, negated))
        else:
            items.append(Text(body, negated))
    out, i = [], 0
    while i < len(items):
        if items[i] == "OR":
            i += 1
            continue
        group = [items[i]]
        while i + 2 < len(items) and items[i + 1] == "OR" and items[i + 2] != "OR":
            group.append(items[i + 2])
            i += 2
        out.append(Or(tuple(group)) if len(group) > 1 else group[0])
        i += 1
    merged: list = []
    for c in out:
        if isinstance(c, Text) and not c.negated and merged and isinstance(merged[-1], Text) and not merged[-1].negated:
            merged[-1] = Text(f"{merged[-1].words} {c.words}")
        else:
            merged.append(c)
    return Parsed(merged, empty)


@dataclass(frozen=True)
class BookFilter:
    """Predicates on books; a set field is one more condition, ``matches_nothing`` none at all."""

    text: str | None = None
    columns: tuple[tuple[str, str, bool], ...] = ()
    author: int | None = None
    series: str | None = None
    publisher: str | None = None
    tags: tuple[str, ...] = ()
    tags_all: bool = False
    not_author: tuple = ()
    not_series: tuple = ()
    not_publisher: tuple = ()
    not_tags: tuple = ()
    format: str | None = None
    status: str | None = None
    state: str | None = None
    outcome: str | None = None
    trusted: bool | None = None
    locked: bool | None = None
    language: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    has_cover: bool | None = None
    has_description: bool | None = None
    has_identifiers: bool | None = None
    identifier: tuple[str | None, str] | None = None
    matches_nothing: bool = False

    def canonical(self) -> BookFilter:
        """Sorted distinct tags, years in order and between 0 and 9999, blank strings unset."""
        lo, hi = self.year_min, self.year_max
        clamp = lambda y: None if y is None else min(max(y, 0), 9999)
        lo, hi = clamp(lo), clamp(hi)
        if lo is not None and hi is not None and lo > hi:
            lo, hi = hi, lo
        blank = lambda s: s.strip() or None if isinstance(s, str) else s
        return replace(self, tags=tuple(sorted({t.strip() for t in self.tags if t.strip()})), year_min=lo, year_max=hi, text=blank(self.text), language=blank(self.language), format=blank(self.format))


IDENTIFIERS = ("isbn13", "isbn10", "asin", "google_books", "open_library", "hardcover", "lccn")
FORMATS = ("epub", "pdf", "mobi", "cbz", "fb2", "txt", "djvu", "azw3", "unknown")
STATUSES, STATES = ("unidentified", "needs_review", "identified"), ("pending", "running", "done", "failed")
OUTCOMES = ("confirmed", "enriched", "disputed", "ambiguous", "unmatched")


def identifier_types(name: str | None) -> tuple[str, ...]:
    if name is None:
        return IDENTIFIERS
    name = name.strip().lower().replace("-", "_")
    name = {"olid": "open_library", "openlibrary": "open_library", "google": "google_books"}.get(name, name)
    return ("isbn10", "isbn13") if name == "isbn" else (name,) if name in IDENTIFIERS else ()


def is_isbn(text: str) -> str | None:
    t = re.sub(r"[\s-]", "", text).upper()
    if re.fullmatch(r"\d{13}", t) and sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(t)) % 10 == 0:
        return t
    if re.fullmatch(r"\d{9}[\dX]", t) and sum((10 if d == "X" else int(d)) * (10 - i) for i, d in enumerate(t)) % 11 == 0:
        return t
    return None


def year_range(value: str) -> tuple[int | None, int | None] | None:
    for pattern, make in (
        (r"(-?\d+)\.\.(-?\d+)", lambda a, b: (a, b)), (r">=(-?\d+)", lambda a: (a, None)), (r"<=(-?\d+)", lambda a: (None, a)),
        (r">(-?\d+)", lambda a: (a + 1, None)), (r"<(-?\d+)", lambda a: (None, a - 1)), (r"(-?\d+)", lambda a: (a, a)),
    ):
        if m := re.fullmatch(pattern, value.strip()):
            return make(*map(int, m.groups()))
    return None


def lookup(dimension: DataFrame, name: str, limit: int = 5) -> tuple[list, bool]:
    """Ids by exact name (A-Z folded), else by substring; (ids, exact)."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = name.translate({c: c + 32 for c in range(65, 91)})
    exact = [r.id for r in dimension.where(fold(F.col("name")) == low).orderBy("name", "id").limit(limit).collect()]
    if exact:
        return exact, True
    pattern = "%" + low.replace("\\", "\\\\") + "%"
    return [r.id for r in dimension.where(fold(F.col("name")).like(pattern)).orderBy("name", "id").limit(limit).collect()], False


def _grams(c: Column) -> Column:
    """All runs of one to three characters, and the empty one."""
    at = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(F.array(F.lit("")), at(1), at(2), at(3)))


def lookup_many(dimension: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """(query, ids, exact) of every distinct ``queries(query)``, as ``lookup`` finds them one at a time.

    Names found exactly come from one join. For the rest the names' runs of
    up to three characters are a posting list; a query reads that of its
    rarest run, and what it reads is compared with the whole pattern. Runs of
    many names are read by queries that have no rarer one. Null queries and
    names meet nothing.
    """
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = stored(dimension.where("name is not null").select("id", "name", fold(F.col("name")).alias("low")), "names")
    asked = stored(queries.where("query is not null").select("query").distinct().withColumn("q", fold(F.col("query"))), "asked")

    def first(rows: DataFrame, exact: bool) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy("name", "id"))
        top = rows.withColumn("place", place).where(F.col("place") <= limit).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("top"))
        return top.select("query", F.col("top.id").alias("ids"), F.lit(exact).alias("exact"))

    same = stored(first(asked.join(names, F.col("q") == F.col("low")).select("query", "id", "name"), True), "exact")
    rest = asked.join(same.select("query"), "query", "left_anti").withColumn("pattern", F.concat(F.lit("%"), F.replace("q", F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    posted = stored(names.select("id", "name", "low", F.explode(_grams(F.col("low"))).alias("gram")), "postings")
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # the wildcards of a pattern part it into what names must hold
    runs = F.array_distinct(F.flatten(F.transform(F.split("q", "[%_]"), _grams)))
    wanted = rest.withColumn("gram", F.explode(runs)).join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = wanted.groupBy("query", "pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    met = key.join(posted, "gram").where(F.expr("low LIKE pattern")).select("query", "id", "name")
    found = same.unionByName(first(met, False))
    return asked.select("query").join(found, "query", "left").select("query", F.coalesce("ids", F.array().cast(found.schema["ids"].dataType)).alias("ids"), F.coalesce("exact", F.lit(False)).alias("exact"))


def resolve(query: str, catalog, explicit: BookFilter | None = None) -> tuple[BookFilter, list[tuple[str, str]]]:
    """The filter of a query and its warnings; explicit fields win, and a query with no executable clause matches nothing."""
    base = (explicit or BookFilter()).canonical()
    if isbn := is_isbn(query):
        return (replace(base, identifier=("isbn", isbn)) if base.identifier is None else base), []
    parsed, got, warn, words = parse(query), {}, [], []
    warn += [("EmptyField", n) for n, _ in parsed.empty_fields]

    def relation(c: Field, dimension: str, one: str, none: str) -> None:
        ids, _ = lookup(getattr(catalog, dimension), c.value)
        if not ids:
            warn.append(("UnknownRelation", f"{c.name}:{c.value}"))
        elif len(ids) > 1:
            warn.append(("AmbiguousRelation", f"{c.name}:{c.value}"))
        elif c.negated:
            got[none] = (*got.get(none, ()), ids[0])
        elif one == "tags":
            got["tags"] = (*got.get("tags", ()), ids[0])
        else:
            got[one] = ids[0]

    def scalar(c: Field, key: str, allowed: tuple[str, ...] | None) -> None:
        value = c.value.lower() if allowed else c.value
        if c.negated or (allowed and value not in allowed):
            warn.append(("InvalidValue", f"{'-' if c.negated else ''}{c.name}:{c.value}"))
        else:
            got[key] = value

    for c in parsed.clauses:
        if isinstance(c, Or):
            parts = [f'"{p.words}"' if isinstance(p, Phrase) else p.words for p in c.parts if not isinstance(p, Field)]
            warn += [("UnsupportedOrField", f"{p.name}:{p.value}") for p in c.parts if isinstance(p, Field)]
            if parts:
                words.append(" OR ".join(parts))
        elif isinstance(c, Text):
            words += [f"NOT {w}" for w in c.words.split()] if c.negated else [c.words]
        elif isinstance(c, Phrase):
            words.append(f'{"NOT " if c.negated else ""}"{c.words}"')
        elif c.name in ("author", "series", "publisher", "tag"):
            relation(c, {"author": "authors", "series": "series", "publisher": "publishers", "tag": "tags"}[c.name], "tags" if c.name == "tag" else c.name, "not_tags" if c.name == "tag" else f"not_{c.name}")
        elif c.name in ("title", "description"):
            got["columns"] = (*got.get("columns", ()), (c.name, c.value, c.negated))
        elif c.name in ("format", "status", "resolution", "outcome", "language"):
            scalar(c, {"resolution": "state"}.get(c.name, c.name), {"format": FORMATS, "status": STATUSES, "resolution": STATES, "outcome": OUTCOMES}.get(c.name))
        elif c.name in ("trusted", "locked"):
            truth = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(c.value.lower())
            if truth is None or c.negated:
                warn.append(("InvalidValue", f"{'-' if c.negated else ''}{c.name}:{c.value}"))
            else:
                got[c.name] = truth
        elif c.name == "year":
            span = year_range(c.value)
            if span is None or c.negated:
                warn.append(("InvalidValue", f"year:{c.value}"))
            else:
                got["year_min"], got["year_max"] = span
        elif c.name in ("has", "missing"):
            key = {"cover": "has_cover", "description": "has_description", "desc": "has_description", "ids": "has_identifiers", "identifiers": "has_identifiers", "identifier": "has_identifiers"}.get(c.value.lower())
            if key is None:
                warn.append(("InvalidValue", f"{c.name}:{c.value}"))
            else:
                got[key] = not (c.negated != (c.name == "missing"))
        else:
            kind, colon, value = c.value.partition(":")
            kind, value = canonical_identifier(kind.strip() if colon else None, value if colon else c.value)
            if c.negated or not value or (colon and not is_identifier_type(kind)):
                warn.append(("InvalidValue", f"{'-' if c.negated else ''}{c.name}:{c.value}"))
            else:
                got.setdefault("identifier", (kind, value))
    text = " ".join(words)
    if text and not re.search(r"\w|[+#]", re.sub(r"\b(OR|NOT)\b", "", text)):
        warn.append(("NoSearchableTerms", text))
        text = ""
    if text:
        got["text"] = text
    unset = lambda k: k == "text" or getattr(base, k) is None or getattr(base, k) == ()
    merged = replace(base, **{k: v for k, v in got.items() if unset(k)}).canonical()
    if (parsed.clauses or parsed.empty_fields) and not got:
        merged = replace(merged, matches_nothing=True)
    return merged, warn


def canonical_identifier(kind: str | None, value: str) -> tuple[str | None, str]:
    """An identifier filter with its type's name and its value as that type writes it: ISBNs and ASINs without blanks (and hyphens) in capitals."""
    types = identifier_types(kind)
    value = value.strip()
    if kind is not None and set(types) <= {"isbn10", "isbn13"}:
        value = re.sub(r"[\s-]", "", value).upper()
    elif types == ("asin",):
        value = re.sub(r"\s", "", value).upper()
    return ("isbn" if len(types) == 2 else types[0] if len(types) == 1 else kind), value


def is_identifier_type(name: str) -> bool:
    return bool(identifier_types(name))


def from_request(params: dict[str, str]) -> BookFilter:
    """The canonical filter of request parameters; a value that can't be read raises ``ValueError``."""
    truth = {"true": True, "1": True, "false": False, "0": False}
    out: dict = {}
    for key, raw in params.items():
        if raw is None or not raw.strip():
            continue
        value = raw.strip()
        if key in ("year_min", "year_max"):
            out[key] = int(value)
        elif key in ("trusted", "locked", "has_cover", "has_description", "has_identifiers"):
            if value.lower() not in truth:
                raise ValueError(f"{key}: {raw!r}")
            out[key] = truth[value.lower()]
        elif key == "tags":
            out["tags"] = tuple(value.split(","))
        elif key == "tag_match":
            out["tags_all"] = value == "all"
        elif key == "identifier":
            kind, colon, rest = value.partition(":")
            out["identifier"] = canonical_identifier(kind if colon else None, rest if colon else value)
        elif key in ("text", "author", "series", "publisher", "format", "status", "state", "outcome", "language"):
            allowed = {"format": FORMATS, "status": STATUSES, "state": STATES, "outcome": OUTCOMES}.get(key)
            if allowed and value not in allowed:
                raise ValueError(f"{key}: {raw!r}")
            out[key] = int(value) if key == "author" else value
        else:
            raise ValueError(f"unknown parameter {key!r}")
    return BookFilter(**out).canonical()


def sign(f: BookFilter, key: bytes) -> str:
    """A token of the whole resolved filter, negations and columns included, with an HMAC-SHA256 of its canonical JSON."""
    body = json.dumps(asdict(f), sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.new(key, body, hashlib.sha256).digest() + body).decode().rstrip("=")


def verified(token: str, key: bytes) -> BookFilter:
    """The filter of a token; one that was made with another key or changed raises ``ValueError``."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except ValueError as e:
        raise ValueError("not a token") from e
    tag, body = raw[:32], raw[32:]
    if not body or not hmac.compare_digest(tag, hmac.new(key, body, hashlib.sha256).digest()):
        raise ValueError("token was tampered with")
    deep = lambda v: tuple(map(deep, v)) if isinstance(v, list) else v
    return BookFilter(**{k: deep(v) for k, v in json.loads(body).items()})
