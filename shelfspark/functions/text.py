"""Scalar functions on titles, names, identifiers, file names and markup, as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The articles of the title normaliser, in natural order.
ARTICLES = ("the", "a", "an", "le", "la", "les", "der", "die", "das")


def normalize_title(c: Column) -> Column:
    """Lower case, apostrophes dropped, other symbols to blanks, one leading article off if words follow."""
    t = F.regexp_replace(F.lower(c), "['’]", "")
    t = F.trim(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]+", " "))
    return F.regexp_replace(t, rf"^({'|'.join(ARTICLES)}) (?=.)", "")


def sort_title(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(the|a|an) ", "")


def sort_name(c: Column) -> Column:
    """``First Last`` as ``Last, First``; a name with a comma or of one word stays."""
    t = F.trim(c)
    return F.when(t.contains(",") | ~t.contains(" "), t).otherwise(F.regexp_replace(t, r"^(.*) ([^ ]+)$", "$2, $1"))


def normalize_author(c: Column) -> Column:
    swapped = F.regexp_replace(F.lower(c), r"^([^,]+),\s*([^,]+)$", "$2 $1")
    return F.trim(F.regexp_replace(swapped, r"[^\p{IsAlphabetic}\p{N}]+", " "))


def split_authors(c: Column) -> Column:
    """Names of an author field: by ``;``, by and/& between full names, or as ``Last, First`` pairs."""
    t = F.trim(c)
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    full = lambda a: F.forall(a, lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 2)
    both, commas = F.split(t, r"(?i)\s+(?:and|&)\s+"), F.split(t, ",")
    even = (F.size(commas) >= 4) & (F.size(commas) % 2 == 0)
    pairs = F.transform(F.filter(commas, lambda x, i: i % 2 == 1), lambda x, i: F.concat_ws(" ", F.trim(x), F.trim(F.element_at(commas, (i * 2 + 1).cast("int")))))
    return (
        F.when(t.contains(";"), clean(F.split(t, ";")))
        .when((F.size(both) > 1) & full(both), clean(both))
        .when(even & F.forall(commas, lambda x: F.size(F.split(F.trim(x), r"\s+")) == 1), pairs)
        .when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
    )


def normalize_isbn(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s\-]", ""))


def _weighted(c: Column, n: int, weight) -> Column:
    """Sum of the first ``n`` digits times their weights; ``c`` stands in it once, so that long expressions do not multiply."""
    digit = lambda x: F.when(x == "X", 10).otherwise(x.try_cast("int"))
    weights = F.array(*[F.lit(weight(i)) for i in range(1, n + 1)])
    return F.aggregate(F.zip_with(F.slice(F.split(c, ""), 1, n), weights, lambda x, w: digit(x) * w), F.lit(0), lambda a, b: a + b)


def isbn13_ok(c: Column) -> Column:
    return c.rlike(r"^[0-9]{13}$") & (_weighted(c, 13, lambda i: 1 if i % 2 else 3) % 10 == 0)


def isbn10_ok(c: Column) -> Column:
    return c.rlike(r"^[0-9]{9}[0-9X]$") & (_weighted(c, 10, lambda i: 11 - i) % 11 == 0)


def isbn_type(c: Column) -> Column:
    """``isbn13``, ``isbn10`` or null for the raw value of an identifier, checksum included."""
    t = normalize_isbn(c)
    return F.when(isbn13_ok(t), "isbn13").when(isbn10_ok(t), "isbn10")


def isbn10_to_13(c: Column) -> Column:
    body = F.concat(F.lit("978"), F.substring(c, 1, 9))
    return F.when(isbn10_ok(c), F.concat(body, ((10 - _weighted(body, 12, lambda i: 1 if i % 2 else 3) % 10) % 10).cast("string")))


def isbn13_to_10(c: Column) -> Column:
    body = F.substring(c, 4, 9)
    check = (11 - _weighted(body, 9, lambda i: 11 - i) % 11) % 11
    return F.when(isbn13_ok(c) & c.startswith("978"), F.concat(body, F.when(check == 10, "X").otherwise(check.cast("string"))))


def is_asin(c: Column) -> Column:
    return c.rlike(r"^[0-9A-Za-z]{10}$")


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, "(?<=[.?!][\"')\\]]{0,3})\\s+"), lambda x: x != "")


def leading_year(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")


def trigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 3, F.filter(F.array(c), lambda x: x != "")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of character trigrams: 1 if equal, 0 if either is empty."""
    x, y = trigrams(a), trigrams(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


@lru_cache(maxsize=1 << 16)
def alike(s: str, t: str) -> float:
    """Jaro-Winkler of two strings, with the prefix bonus at every similarity."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    taken, left = [False] * len(t), []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not taken[j] and t[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, on in zip(t, taken, strict=True) if on]
    jaro = (m / len(s) + m / len(t) + (m - sum(x != y for x, y in zip(left, right, strict=True)) / 2) / m) / 3
    prefix = 0
    for x, y in zip(s[:4], t[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def lists_alike(a: list[str], b: list[str]) -> float:
    """Sum of each name's best likeness in ``b`` over the length of the longer list."""
    if not a or not b:
        return float(not a and not b)
    return sum(max(alike(x, y) for y in b) for x in a) / max(len(a), len(b))


def jaro_winkler(a: Column, b: Column) -> Column:
    """``alike`` of two columns; each distinct pair of a batch is compared once."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(x, y):
        known: dict = {}
        out = []
        for pair in zip(x, y, strict=True):
            if pair not in known:
                known[pair] = alike(pair[0] or "", pair[1] or "")
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return pandas_udf(run, "double")(a, b)


def quality_score(valid_id: Column, title: Column, author: Column, context: Column, filled: Column, of: int, most: float) -> Column:
    """0.4 for a valid identifier, 0.3 for title and author (0.1 for a title alone), context, and a share for richness; at most 1."""
    base = F.when(valid_id, 0.4).otherwise(0.0) + F.when(title & author, 0.3).when(title, 0.1).otherwise(0.0)
    return F.least(base + context + filled / F.lit(float(of)) * most, F.lit(1.0))


def status_of(score: Column) -> Column:
    return F.when(score >= 0.6, "identified").when(score >= 0.2, "needs_review").otherwise("unidentified")
