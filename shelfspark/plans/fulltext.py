"""Full-text search: a stored index, a boolean match compiler, phrases, prefixes and weighted BM25.

The index holds a row for each token, (id, col, place, term), in the order of
(term, id), so that a query's terms reach the scan as a filter on ``term``,
and a row for each document with its length. A query reads the rows of its own
terms, counts them by document, and joins lengths of matching documents only.
""" 

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import files_version, spread, stored

# Columns and their ranking weights.
WEIGHTS = {"title": 10.0, "description": 1.0, "authors": 5.0, "series": 3.0, "publisher": 2.0, "tags": 2.0}
K1, B = 1.2, 0.75
# letters of the Latin alphabet with marks, and the letters without; other alphabets keep their marks
_FOLD = {c: unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()}
_FROM, _TO = "".join(map(chr, _FOLD)), "".join(_FOLD.values())


def tokens(c: Column) -> Column:
    """Lower-case tokens without diacritics; ``+`` and ``#`` belong to words."""
    c = F.coalesce(c, F.lit(""))
    plain = F.translate(F.regexp_replace(c, r"\p{M}", ""), _FROM, _TO)
    t = F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(plain))  # ASCII has no marks
    return F.filter(F.split(t, r"[^\p{L}\p{N}\p{Co}+#]+"), lambda x: x != "")


def plain_tokens(text: str) -> list[str]:
    t = "".join(_FOLD.get(ord(ch), ch) for ch in text if not unicodedata.combining(ch)).lower()
    return re.findall(r"[^\W_+#]+(?:[+#]+[^\W_]*)*|[+#]+[^\W_]*", t)


def documents(cat) -> DataFrame:
    """One row a book: the indexed text of each column."""
    linked = lambda col: _names(cat, col).withColumnRenamed("text", col)
    titled = _titled(cat).select("id", "title", "description", F.col("publisher_id").alias("publisher"))
    return titled.join(linked("authors"), "id", "left").join(linked("series"), "id", "left").join(linked("tags"), "id", "left")


_LINKS = {"authors": "author_id", "series": "series_id", "tags": "tag_id"}


def _titled(cat) -> DataFrame:
    return cat.books.withColumn("title", F.concat_ws(" ", "title", "subtitle")) if "subtitle" in cat.books.columns else cat.books


def _names(cat, col: str) -> DataFrame:
    """(id, text): the distinct names that a book is linked to, in order."""
    link, dim, key = getattr(cat, f"book_{col}"), getattr(cat, col), _LINKS[col]
    j = link.join(dim.select(F.col("id").alias(key), F.col("name").alias("n")), key)
    return j.groupBy(F.col("book_id").alias("id")).agg(F.concat_ws(" ", F.sort_array(F.collect_set("n"))).alias("text"))


def fields(cat) -> DataFrame:
    """(id, col, text): the texts of ``documents`` a row each, from where they lie, so that no join carries them."""
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("col"), F.col(c).alias("text")) for n, c in (("title", "title"), ("description", "description"), ("publisher", "publisher_id"))])).alias("f")
    rows = _titled(cat).select("id", own).select("id", "f.*")
    for col in _LINKS:  # links of books that are not there name no document
        rows = rows.unionByName(_names(cat, col).join(cat.books.select("id"), "id", "left_semi").select("id", F.lit(col).alias("col"), "text"))
    return rows


@dataclass
class Index:
    """``postings(id, col, place, term)`` and ``lengths(id, dl)``."""

    postings: DataFrame
    lengths: DataFrame

    def refreshed(self, changed: DataFrame, docs: DataFrame) -> Index:
        """The index after the documents ``changed(id)`` became those of ``docs``, or left if ``docs`` lacks them."""
        with spread(docs):
            ids = stored(changed.select("id").distinct(), "changed")
            new = of_words(stored(words(long_form(docs.join(ids, "id", "left_semi"))), "words"))
        keep = lambda rows: rows.join(ids, "id", "left_anti")
        return Index(keep(self.postings).unionByName(new.postings), keep(self.lengths).unionByName(new.lengths))

    def stored(self) -> Index:
        """The index on disk, sorted by term."""
        by_term = self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        return Index(stored(by_term, "postings"), stored(self.lengths, "lengths"))


def long_form(docs: DataFrame) -> DataFrame:
    """(id, col, text) of the columns of ``documents``, as ``fields``."""
    cols = [c for c in WEIGHTS if c in docs.columns]
    return docs.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in cols])).alias("f")).select("id", "f.*")


def words(rows: DataFrame) -> DataFrame:
    """(id, col, words) of (id, col, text)."""
    return rows.select("id", "col", tokens(F.col("text")).alias("words"))


def of_words(rows: DataFrame) -> Index:
    """The index of (id, col, words), in which every document has a row, be it without words."""
    posted = rows.select("id", "col", F.posexplode("words").alias("place", "term"))
    return Index(posted, rows.groupBy("id").agg(F.sum(F.size("words")).cast("int").alias("dl")))


def index(docs: DataFrame) -> Index:
    """The index of ``documents``, not written: each of its tables makes the tokens when it is read."""
    return of_words(words(long_form(docs)))


_indexes: dict[tuple[str, str], tuple[str, Index]] = {}


def index_of(cat) -> Index:
    """The stored index of a catalog, made when an application first asks for it and again when the catalog's files have changed."""
    key, version = (cat.spark.sparkContext.applicationId, cat.sf_dir), files_version(cat.spark, cat.sf_dir)
    if _indexes.get(key, ("", None))[0] != version:
        rows = fields(cat)
        with spread(rows):
            _indexes[key] = version, of_words(stored(words(rows), "words")).stored()
    return _indexes[key][1]


class Term:
    """A word, a phrase or a prefix, in one column or any."""

    def __init__(self, words: list[str], prefix: bool = False, column: str | None = None):
        self.words, self.prefix, self.column = words, prefix, column

    def word(self, k: int) -> Column:
        """Whether a posting is the term's word ``k``."""
        last = self.prefix and k == len(self.words) - 1
        hit = F.col("term").startswith(self.words[k]) if last else F.col("term") == self.words[k]
        return hit & (F.col("col") == self.column) if self.column else hit


@dataclass
class Group:
    """Terms that must all be there and terms that must not."""

    wanted: list[Term]
    unwanted: list[Term]


def compile_match(text: str | None, columns: tuple[tuple[str, str, bool], ...] = ()) -> tuple[list[Group], list[Term]]:
    """(alternatives, terms excluded from all documents if nothing is wanted).

    Adjacent terms bind tightest, then NOT, then OR. What is negated anywhere
    stands at the end, so it binds to the last alternative; words of column
    filters join that one too. The last plain word is a prefix.
    """
    lexed = re.findall(r'"([^"]*)"(\*?)|(\S+)', text or "")
    groups, excluded, negate, last = [[]], [], False, None
    for quoted, star, word in lexed:
        if word == "OR":
            if groups[-1]:
                groups.append([])
            continue
        if word == "NOT":
            negate = True
            continue
        w = plain_tokens(quoted or word)
        if w:
            t = Term(w, prefix=bool(star) or word.endswith("*"))
            if negate:
                excluded.append(t)
            else:
                groups[-1].append(t)
                last = t if word and len(w) == 1 else None
        negate = False
    if last is not None:
        last.prefix = True
    while len(groups) > 1 and not groups[-1]:
        groups.pop()
    for name, value, neg in columns:
        w = plain_tokens(value)
        if w:
            t = Term(w, prefix=len(w) == 1, column=name)
            (excluded if neg else groups[-1]).append(t)
    found = [Group(g, []) for g in groups if g]
    if found:
        found[-1].unwanted = excluded
    return found, [] if found else excluded


def _hits(postings: DataFrame, terms: list[Term], weights: dict[str, float]) -> DataFrame:
    """(id, n, weight): an occurrence of term number ``n``."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("col")]
    out = []
    single = [(i, t) for i, t in enumerate(terms) if len(t.words) == 1]
    if single:
        which = F.filter(F.array(*[F.when(t.word(0), F.lit(i)) for i, t in single]), lambda x: x.isNotNull())
        rows = postings.where(reduce(lambda a, b: a | b, [t.word(0) for _, t in single]))
        out.append(rows.select("id", F.explode(which).alias("n"), weight.alias("weight")))
    for i, t in enumerate(terms):
        size = len(t.words)
        if size > 1:  # the words of a phrase agree on where it starts
            at = F.filter(F.array(*[F.when(t.word(k), F.lit(k)) for k in range(size)]), lambda x: x.isNotNull())
            rows = postings.where(reduce(lambda a, b: a | b, [t.word(k) for k in range(size)])).select("id", "col", "place", F.explode(at).alias("k"))
            starts = rows.groupBy("id", "col", (F.col("place") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("there"))
            out.append(starts.where(F.col("there") == size).select("id", F.lit(i).alias("n"), weight.alias("weight")))
    return reduce(DataFrame.unionByName, out)


def search(idx: Index, text: str | None, columns: tuple = (), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, rank) of matching documents; lower ranks are better, negation alone ranks nothing."""
    groups, excluded = compile_match(text, columns)
    terms = [t for g in groups for t in (*g.wanted, *g.unwanted)] + excluded
    if not groups:
        every = idx.lengths.select("id", F.lit(0.0).alias("rank"))
        return every.join(_hits(idx.postings, excluded, weights).select("id").distinct(), "id", "left_anti") if excluded else every
    tf = [F.coalesce(F.sum(F.when(F.col("n") == i, F.col("weight"))), F.lit(0.0)).alias(f"tf{i}") for i in range(len(terms))]
    rows = _hits(idx.postings, terms, weights).groupBy("id").agg(*tf)
    on = lambda t: F.col(f"tf{terms.index(t)}") > 0
    every = lambda cs: reduce(lambda a, b: a & b, cs)
    held = [every([*map(on, g.wanted), *[~on(t) for t in g.unwanted]]) for g in groups]
    ranked = [terms.index(t) for g in groups for t in g.wanted]
    found = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in ranked])
    size = idx.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    score = F.lit(0.0)
    for g, there in zip(groups, held, strict=True):  # an alternative counts where it matches
        for t in g.wanted:
            df, tf_i = F.col(f"df{terms.index(t)}"), F.col(f"tf{terms.index(t)}")
            idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
            idf = F.when(idf <= 0, 1e-6).otherwise(idf)
            score = score + F.when(there, idf * tf_i * (K1 + 1) / (tf_i + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    holds = reduce(lambda a, b: a | b, held)
    return rows.where(holds).join(idx.lengths, "id").crossJoin(F.broadcast(found)).crossJoin(F.broadcast(size)).select("id", (-score).alias("rank"))
