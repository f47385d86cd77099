"""Merging the candidates of books: duplicates of a provider, the same ISBN at several providers, corroboration.

Candidates of one provider that are tied by identifiers, directly or over
others, become one. Then groups form around ISBNs, from the least on. What is
left is compared by titles and authors, distinct texts of a book once.

Candidates are sent once, to their books: all steps of a book of at most
``ROW_CANDIDATES`` are array functions of one row. Larger books are merged in
joins and aggregates that share the folding of groups: an ISBN is settled as
soon as no lesser one that still unites providers has a candidate in common
with it, so each round settles many and a book needs as many rounds as its
ISBNs depend on each other.

Defined results: candidates of a book go by ``ordinal``; null lists are empty,
empty strings and lists are gaps; without a book or an ordinal a candidate
merges with nothing; repeated (book_id, ordinal) are told apart by their
content, and equal rows are one; an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import author_similarity, is_unsupported_format
from ..sources.work import stored

# What corroboration adds, likeness that corroborates, whose covers are preferred, whose own identifiers are of which type.
BONUS, TITLE_ABOVE, AUTHORS_ABOVE = 0.1, 0.85, 0.7
COVER_RANK = {"open_library": 1, "hardcover": 2}
NATIVE = {"open_library": "open_library", "hardcover": "hardcover", "google_books": "google_books", "lccn": "loc"}
FILLED = ("subtitle", "description", "language", "publisher", "publication_year", "series", "page_count", "rating", "subjects", "physical_format")
COMPLETE = ("subtitle", "authors", "description", "publisher", "publication_year", "cover_url", "subjects", "series", "page_count", "language")
LISTS = ("authors", "identifiers", "subjects")
CANDIDATE = (
    "book_id long, ordinal int, provider string, score double, title string, authors array<string>, identifiers array<string>, subtitle string, description string, language string, "
    "publisher string, publication_year int, series string, page_count int, rating double, subjects array<string>, physical_format string, cover_url string"
)
NAMES = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", CANDIDATE)]
MERGED = [*NAMES, "cross_provider", "merged_from", "field_sources", "field_count"]
#: A candidate between the steps; ``pos`` is its place among those of its book, by ordinal and then by content.
STATE = [*MERGED[:-1], "pos"]
BY_CONTENT = ["ordinal", *[n for n in NAMES if n not in ("book_id", "ordinal")]]
#: Candidates, repeated rows counted, up to which a book is merged in one row.
ROW_CANDIDATES = 1_000
_TEXTS = {f.split(" ")[0] for f in re.split(r", (?=\w+ )", CANDIDATE) if f.endswith(" string")}


def _there(name: str, c: Column) -> Column:
    """Whether a field of a candidate holds something."""
    return F.coalesce(F.size(c) > 0 if name in LISTS else c != "" if name in _TEXTS else c.isNotNull(), F.lit(False))


def _isbn(i: Column) -> Column:
    """Normalised ISBN of an identifier ``type:value``; null for other types."""
    return F.when(F.substring_index(i, ":", 1).isin("isbn13", "isbn10"), T.normalize_isbn(F.regexp_extract(i, "^[^:]*:(.*)$", 1)))


def _isbns(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ids, _isbn), lambda x: x.isNotNull()))


def _rank(provider: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COVER_RANK.items() for x in kv])[provider], F.lit(0))


def _first(group: Column, name: str) -> Column:
    """The member of an ordered group that gives a field: the first that has it."""
    return F.get(F.filter(group, lambda m: _there(name, m[name])), F.lit(0))


def _folded(g: Column, across: bool) -> Column:
    """The one candidate of an ordered group (array of candidates): its first member with gaps filled by the next ones."""
    w = g[0]
    rest = F.slice(g, 2, 1 << 30)
    out = {n: w[n] for n in STATE}
    out |= {f: F.coalesce(_first(g, f)[f], w[f]) for f in FILLED}
    if not across:
        out["cover_url"] = F.coalesce(_first(g, "cover_url")["cover_url"], w["cover_url"])
        out["identifiers"] = F.array_distinct(F.flatten(F.transform(g, lambda m: m["identifiers"])))
        return F.struct(*[c.alias(n) for n, c in out.items()])
    # a cover of a better provider goes before the first one's, the last such before all
    better = F.filter(rest, lambda m: _there("cover_url", m["cover_url"]) & (_rank(m["provider"]) > _rank(w["provider"])))
    cover = F.coalesce(F.try_element_at(better, F.lit(-1)), _first(g, "cover_url"))
    out["cover_url"] = F.coalesce(cover["cover_url"], w["cover_url"])
    native = F.create_map(*[F.lit(x) for kv in NATIVE.items() for x in kv])
    others = F.transform(rest, lambda m: m["provider"])
    own = F.filter(w["identifiers"], lambda i: ~F.coalesce(F.array_contains(others, native[F.substring_index(i, ":", 1)]), F.lit(False)))
    keyed = F.filter(F.flatten(F.transform(rest, lambda m: F.transform(m["identifiers"], lambda i: F.struct(_isbn(i).alias("key"), i.alias("i"))))), lambda x: x["key"].isNotNull() & ~F.array_contains(_isbns(w["identifiers"]), x["key"]))
    once = F.filter(keyed, lambda x, n: (n == 0) | ~F.exists(F.slice(keyed, F.lit(1), n), lambda y: y["key"] == x["key"]))
    out["identifiers"] = F.concat(own, F.transform(once, lambda x: x["i"]))
    gave = [(f, _first(g, f)) for f in FILLED] + [("cover_url", cover)]
    sources = F.filter(F.array(*[F.when(m.isNotNull() & (m["pos"] != w["pos"]), F.struct(F.lit(f), m["provider"])) for f, m in gave]), lambda x: x.isNotNull())
    out |= {"field_sources": F.map_from_entries(sources), "merged_from": F.concat(w["merged_from"], others), "score": F.least(w["score"] + BONUS, F.lit(1.0)), "cross_provider": F.lit(True)}
    return F.struct(*[c.alias(n) for n, c in out.items()])


def _fold_rows(rows: DataFrame, key: list[str], order, across: bool) -> DataFrame:
    """``rows`` folded to one candidate for each key, in an order given by a comparison."""
    groups = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*STATE)), order).alias("group"))
    return groups.select(_folded(F.col("group"), across).alias("m")).select("m.*")


def _signs(*steps: Column) -> Column:
    """The first comparison that isn't even."""
    return F.coalesce(*[F.when(s != 0, s) for s in steps], F.lit(0)).cast("int")


def _less(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _by_score(a: Column, b: Column) -> Column:
    return _signs(_less(b["score"], a["score"]), _less(a["pos"], b["pos"]))


def _by_cover(a: Column, b: Column) -> Column:
    """By score, the rank of the covers where both have one, the provider's name."""
    both = _there("cover_url", a["cover_url"]) & _there("cover_url", b["cover_url"])
    return _signs(_less(b["score"], a["score"]), F.when(both, _rank(b["provider"]) - _rank(a["provider"])).otherwise(0), _less(a["provider"], b["provider"]), _less(a["pos"], b["pos"]))


def _ties(ids: Column) -> Column:
    return F.array_union(F.transform(_isbns(ids), lambda x: F.concat(F.lit("isbn:"), x)), ids)


def _within_providers(rows: DataFrame) -> DataFrame:
    """Candidates of a provider that are tied by identifiers become one, led by the best scored."""
    at = ["book_id", "provider"]
    edges = stored(rows.where("book_id is not null and ordinal is not null").select(*at, "pos", F.explode(_ties(F.col("identifiers"))).alias("tie")), "ties")
    label = edges.groupBy(*at, "pos").agg(F.first("pos").alias("lead"))
    while True:  # the least place spreads along ties; as many rounds as the longest chain
        least = edges.join(label, [*at, "pos"]).groupBy(*at, "tie").agg(F.min("lead").alias("least"))
        new = stored(edges.join(least, [*at, "tie"]).groupBy(*at, "pos").agg(F.min("least").alias("lead")), "leads")
        if not new.join(label.withColumnRenamed("lead", "was"), [*at, "pos"]).where("lead <> was").limit(1).count():
            break
        label = new
    led = rows.join(new, [*at, "pos"], "left").withColumn("lead", F.coalesce("lead", "pos"))
    return _fold_rows(led, [*at, "lead"], _by_score, False)


def _across_providers(rows: DataFrame) -> DataFrame:
    """Around each ISBN, from the least on, candidates of different providers that no other ISBN has claimed become one."""
    cand = stored(rows, "candidates")
    links = stored(cand.where("book_id is not null and ordinal is not null").select("book_id", "pos", "provider", F.explode(_isbns(F.col("identifiers"))).alias("isbn")), "isbns")
    taken, rest = None, links
    while True:
        united = rest.groupBy("book_id", "isbn").agg(F.count_distinct("provider").alias("n")).where("n > 1").drop("n")
        rest = stored(rest.join(united, ["book_id", "isbn"], "left_semi"), "links")
        if not rest.limit(1).count():
            break
        first = rest.groupBy("book_id", "pos").agg(F.min("isbn").alias("least"))
        ready = rest.join(first, ["book_id", "pos"]).groupBy("book_id", "isbn").agg(F.min("least").alias("least")).where("least = isbn").select("book_id", "isbn")
        # of each provider the first candidate
        step = stored(rest.join(ready, ["book_id", "isbn"], "left_semi").groupBy("book_id", "isbn", "provider").agg(F.min("pos").alias("pos")), "claims")
        taken = step if taken is None else stored(taken.unionByName(step), "claims")
        rest = rest.join(step.select("book_id", "pos"), ["book_id", "pos"], "left_anti").join(step.select("book_id", "isbn").distinct(), ["book_id", "isbn"], "left_anti")
    if taken is None:
        return cand
    alone = cand.join(taken.select("book_id", "pos"), ["book_id", "pos"], "left_anti")
    return _fold_rows(cand.join(taken.select("book_id", "pos", "isbn"), ["book_id", "pos"]), ["book_id", "isbn"], _by_cover, True).unionByName(alone)


def _rewarded(rows: DataFrame, met: Column) -> DataFrame:
    """The bonus for candidates that another provider's ``met``, once; one without an ordinal gets none."""
    new = met & F.col("ordinal").isNotNull() & ~F.col("cross_provider")
    score = F.when(F.col("new_"), F.least(F.col("score") + BONUS, F.lit(1.0))).otherwise(F.col("score"))
    return rows.withColumn("new_", new).withColumn("score", score).withColumn("cross_provider", F.col("cross_provider") | F.col("new_")).select(*STATE)


def _corroborated(rows: DataFrame) -> DataFrame:
    """A bonus, once, for candidates whose title and authors another provider has too; those of one ISBN count as settled."""
    cand = stored(rows, "merged")
    text = cand.where(_there("title", F.col("title")) & F.col("book_id").isNotNull() & F.col("provider").isNotNull()).select("book_id", "pos", "provider", _isbns(F.col("identifiers")).alias("isbns"), T.normalize_title(F.col("title")).alias("t"), F.transform("authors", T.normalize_author).alias("names"))
    distinct = stored(text.groupBy("book_id", "t", "names").agg(F.collect_set("provider").alias("by")), "texts")
    side = lambda k: distinct.select("book_id", *[F.col(c).alias(f"{c}{k}") for c in ("t", "names", "by")])
    pairs = side(1).join(side(2), "book_id").where("t1 <= t2 and (size(by1) > 1 or size(by2) > 1 or by1[0] <> by2[0])")
    near = stored(pairs.withColumn("like", T.jaro_winkler(F.col("t1"), F.col("t2"))).where(F.col("like") > TITLE_ABOVE), "like")
    near = near.withColumn("people", author_similarity(F.col("names1"), F.col("names2"))).where(F.col("people") > AUTHORS_ABOVE)
    of = lambda k: text.select("book_id", *[F.col(c).alias(f"{c}{k}") for c in ("pos", "provider", "isbns", "t", "names")])
    met = near.select("book_id", "t1", "names1", "t2", "names2").join(of(1), ["book_id", "t1", "names1"]).join(of(2), ["book_id", "t2", "names2"])
    met = met.where((F.col("provider1") != F.col("provider2")) & ~F.arrays_overlap("isbns1", "isbns2"))
    on = met.select("book_id", F.explode(F.array("pos1", "pos2")).alias("pos")).distinct().withColumn("on_", F.lit(True))
    return _rewarded(cand.join(on, ["book_id", "pos"], "left"), F.coalesce(F.col("on_"), F.lit(False)))


def _state(field, book_id: Column, pos: Column) -> list[Column]:
    """A candidate before any step; ``field`` gives its own columns."""
    new = {"book_id": book_id, "cross_provider": F.lit(False), "merged_from": F.array().cast("array<string>"), "field_sources": F.create_map().cast("map<string,string>"), "pos": pos}
    return [(new[n] if n in new else field(n)).alias(n) for n in STATE]


def _by_rounds(rows: DataFrame) -> DataFrame:
    """Books of any size, in rounds of joins over all of them."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(*BY_CONTENT))
    return _corroborated(_across_providers(_within_providers(rows.distinct().select(*_state(F.col, F.col("book_id"), place)))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.transform(F.array(value), body)[0]


def _shared(keys: Column) -> Column:
    """Of sorted (key, ...) the first of each key that stands there more than once."""
    same = lambda a, b: F.coalesce(a["key"] == b["key"], F.lit(False))
    return F.filter(keys, lambda k, n: same(k, F.get(keys, n + 1)) & ~same(k, F.get(keys, n - 1)))


def _keys(g: Column, make) -> Column:
    """(key, pos, provider) for each key that a candidate with a book and an ordinal has, sorted."""
    own = lambda m: F.filter(make(m), lambda k: k.isNotNull() & m["book_id"].isNotNull() & m["ordinal"].isNotNull())
    return F.sort_array(F.flatten(F.transform(g, lambda m: F.transform(own(m), lambda k: F.struct(k.alias("key"), m["pos"].alias("pos"), m["provider"].alias("provider"))))))


def _row_within(g: Column) -> Column:
    """``_within_providers`` of one book's array of candidates, in which ``pos`` is the index."""

    def leads(keys):  # of each tie in turn, the candidates and all that were united with them get the least place
        spread = lambda lead, old: F.transform(lead, lambda x: F.when(F.array_contains(old, x), F.array_min(old)).otherwise(x))
        of = lambda lead, k: F.array_distinct(F.transform(F.filter(keys, lambda o: o["key"] == k["key"]), lambda o: F.get(lead, o["pos"])))
        return F.aggregate(_shared(keys), F.transform(g, lambda m: m["pos"]), lambda lead, k: _let(of(lead, k), lambda old: spread(lead, old)))

    def fold(lead, many):
        of = lambda x: F.array_sort(F.filter(g, lambda m: F.get(lead, m["pos"]) == x), _by_score)
        united = F.transform(many, lambda x: _let(of(x), lambda group: _folded(group, False)))
        alone = F.transform(F.filter(g, lambda m: ~F.array_contains(many, F.get(lead, m["pos"]))), lambda m: F.struct(*[(F.array_distinct(m[n]) if n == "identifiers" else m[n]).alias(n) for n in STATE]))
        return F.concat(united, alone)

    tie = lambda m: F.transform(_ties(m["identifiers"]), lambda t: F.when(t.isNotNull() & m["provider"].isNotNull(), F.struct(m["provider"].alias("provider"), t.alias("tie"))))
    return _let(_let(_keys(g, tie), leads), lambda lead: _let(F.array_distinct(F.filter(lead, lambda x, n: x != n)), lambda many: fold(lead, many)))


def _row_across(g: Column) -> Column:
    """``_across_providers`` of one book's array of candidates."""

    def claims(keys):  # (isbn, pos) of each ISBN in turn: of each provider the first candidate that is free
        def settled(taken, k):
            free = F.filter(keys, lambda o: (o["key"] == k["key"]) & ~F.exists(taken, lambda t: t["pos"] == o["pos"]))

            def claimed(free):
                first = F.filter(free, lambda o, n: ~F.exists(F.slice(free, F.lit(1), n), lambda p: p["provider"].eqNullSafe(o["provider"])))
                several = F.size(F.array_distinct(F.filter(F.transform(free, lambda o: o["provider"]), lambda p: p.isNotNull()))) > 1
                return F.when(several, F.concat(taken, F.transform(first, lambda o: F.struct(o["key"].alias("isbn"), o["pos"].alias("pos"))))).otherwise(taken)

            return _let(free, claimed)

        return F.aggregate(_shared(keys), F.array().cast("array<struct<isbn:string,pos:int>>"), settled)

    def fold(taken):
        of = lambda isbn: F.array_sort(F.filter(g, lambda m: F.exists(taken, lambda t: (t["isbn"] == isbn) & (t["pos"] == m["pos"]))), _by_cover)
        united = F.transform(F.array_distinct(F.transform(taken, lambda t: t["isbn"])), lambda isbn: _let(of(isbn), lambda group: _folded(group, True)))
        return F.concat(united, F.filter(g, lambda m: ~F.exists(taken, lambda t: t["pos"] == m["pos"])))

    return _let(_let(_keys(g, lambda m: _isbns(m["identifiers"])), claims), fold)


def _near(pairs: Column) -> Column:
    """Whether the titles and the authors of each pair of texts are alike."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(t1, t2, names1, names2):
        known: dict = {}
        out = []
        for book in zip(t1, t2, names1, names2, strict=True):
            out.append([])
            for s, t, a, b in zip(*book, strict=True):
                if (s, t) not in known:
                    known[s, t] = T.alike(s, t)
                out[-1].append(bool(known[s, t] > TITLE_ABOVE and T.lists_alike(list(a), list(b)) > AUTHORS_ABOVE))
        return pd.Series(out)

    run.__annotations__ = {"t1": pd.Series, "t2": pd.Series, "names1": pd.Series, "names2": pd.Series, "return": pd.Series}
    return pandas_udf(run, "array<boolean>")(*[pairs[side][name] for name in ("t", "names") for side in ("a", "b")])


def _row_corroborated(rows: DataFrame) -> DataFrame:
    """``_corroborated`` of books as arrays of candidates ``g``; one row for each candidate."""
    text = lambda m: F.struct(m["pos"].alias("pos"), m["provider"].alias("provider"), _isbns(m["identifiers"]).alias("isbns"), F.struct(T.normalize_title(m["title"]).alias("t"), F.transform(m["authors"], T.normalize_author).alias("names")).alias("text"))
    texts = F.transform(F.filter("g", lambda m: _there("title", m["title"]) & m["book_id"].isNotNull() & m["provider"].isNotNull()), text)

    def pairs(texts):
        by = lambda x: F.array_distinct(F.transform(F.filter(texts, lambda m: m["text"] == x), lambda m: m["provider"]))
        distinct = F.transform(F.array_distinct(F.transform(texts, lambda m: m["text"])), lambda x: F.struct(x["t"].alias("t"), x["names"].alias("names"), by(x).alias("by")))
        fits = lambda a, b: (a["t"] <= b["t"]) & ((F.size(a["by"]) > 1) | (F.size(b["by"]) > 1) | (a["by"][0] != b["by"][0]))
        side = lambda x: F.struct(x["t"].alias("t"), x["names"].alias("names"))
        return _let(distinct, lambda d: F.flatten(F.transform(d, lambda a: F.transform(F.filter(d, lambda b: fits(a, b)), lambda b: F.struct(side(a).alias("a"), side(b).alias("b"))))))

    def met(near, texts):  # places of candidates that one of another provider and without a common ISBN is like
        other = lambda x, y: (x["provider"] != y["provider"]) & ~F.arrays_overlap(x["isbns"], y["isbns"])
        like = lambda x, mine, its: (x["text"] == mine) & F.exists(texts, lambda y: (y["text"] == its) & other(x, y))
        return F.transform(F.filter(texts, lambda x: F.exists(near, lambda p: like(x, p["a"], p["b"]) | like(x, p["b"], p["a"]))), lambda x: x["pos"])

    compared = rows.withColumn("texts", texts).withColumn("pairs", _let(F.col("texts"), pairs)).withColumn("like", _near(F.col("pairs")))
    near = F.filter("pairs", lambda p, n: F.get("like", n))
    marked = compared.withColumn("met", _let(F.struct(near.alias("near"), F.col("texts").alias("texts")), lambda v: met(v["near"], v["texts"])))
    return _rewarded(marked.select("met", F.explode("g").alias("m")).select("met", "m.*"), F.array_contains("met", F.col("pos")))


def _by_row(rows: DataFrame) -> DataFrame:
    """Books whose candidates fit in one row, each merged in its row."""
    # each candidate without a book is in a row of its own, or with such as have the same hash
    apart = F.when(F.col("book_id").isNull(), F.xxhash64(*BY_CONTENT))
    books = rows.withColumn("apart", apart).groupBy("book_id", "apart").agg(F.sort_array(F.collect_set(F.struct(*BY_CONTENT))).alias("all"))
    g = F.transform("all", lambda m, n: F.struct(*_state(lambda c: m[c], F.col("book_id"), n)))
    return _row_corroborated(books.select(_let(_let(g, _row_within), _row_across).alias("g")))


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` (columns of ``CANDIDATE``) after unsupported formats left and duplicates were merged, book by book."""
    wanted = candidates.where(~F.coalesce(is_unsupported_format(F.col("physical_format")), F.lit(False)))
    plain = wanted.select(*[F.coalesce(F.col(n), F.array()).alias(n) if n in LISTS else F.col(n) for n in NAMES])
    large = stored(plain.where("book_id is not null").groupBy("book_id").count().where(F.col("count") > ROW_CANDIDATES).select("book_id"), "large_books")
    if large.isEmpty():
        out = _by_row(plain)
    else:
        out = _by_row(plain.join(large, "book_id", "left_anti")).unionByName(_by_rounds(plain.join(large, "book_id", "left_semi")))
    count = sum((_there(f, F.col(f)).cast("int") for f in COMPLETE), F.lit(0))
    return out.withColumn("field_count", count.cast("int")).select(*MERGED)
