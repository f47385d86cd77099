"""Queries of the scalar functions: inputs in SQL that both engines share, results beside SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as T
from .functions import words as W
from .registry import ORACLES, add, shared_sql


def scalar(name: str, inputs: str, make: Callable[..., Column | dict[str, Column]], sql: str, source: str = "books", key: str = "id") -> None:
    """``make`` of the named ``inputs`` for each row of a view; ``sql`` gives the same value, or ``a := x; b := y`` several."""
    names = [part.rsplit(" AS ", 1)[1] for part in inputs.split(" ;; ")]
    rows = f"SELECT {key}, {inputs.replace(' ;; ', ', ')} FROM {source}"

    def run(c):
        got = make(*[F.col(n) for n in names])
        return shared_sql(c, rows).select(key, *[v.alias(k) for k, v in (got if isinstance(got, dict) else {"v": got}).items()])

    parts = [p.split(" := ", 1) for p in sql.split("; ")] if " := " in sql else [("v", sql)]
    add(name, run, f"SELECT {key}, " + ", ".join(f"{v} AS {k}" for k, v in parts) + f" FROM ({rows}) x")


_S = "'\\s+'"
_NT = "regexp_replace(trim(regexp_replace(replace(lower({0}), '''', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(the|a|an|le|la|les|der|die|das) (.)', '\\2')"
_CF = "regexp_replace(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(the|an|a)( |$)', '')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 2)), lambda i: substring({0}, i, 3)))"


def _tri(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 WHEN {x} = {y} THEN 1 ELSE len(list_intersect({_GRAMS.format(x)}, {_GRAMS.format(y)})) / len(list_distinct(list_concat({_GRAMS.format(x)}, {_GRAMS.format(y)}))) END"


def _jw(x: str, y: str) -> str:
    prefix = f"CASE WHEN {x}[1:4] = {y}[1:4] AND least(len({x}), len({y})) >= 4 THEN 4 WHEN {x}[1:3] = {y}[1:3] AND least(len({x}), len({y})) >= 3 THEN 3 WHEN {x}[1:2] = {y}[1:2] AND least(len({x}), len({y})) >= 2 THEN 2 WHEN {x}[1:1] = {y}[1:1] THEN 1 ELSE 0 END"
    return f"(jaro_similarity({x}, {y}) + {prefix} * 0.1 * (1 - jaro_similarity({x}, {y})))"


_ODD_TITLE = "CASE id % 5 WHEN 0 THEN concat(title, ' - ', 'part two') WHEN 1 THEN concat('It: ', title) WHEN 2 THEN upper(title) WHEN 3 THEN concat('A', title) ELSE title END AS t"
scalar("title_for_search", _ODD_TITLE, W.title_for_search, "CASE WHEN contains(t, ': ') AND len(regexp_extract_all(split_part(t, ': ', 1), '\\S+')) >= 2 THEN split_part(t, ': ', 1) WHEN contains(t, ' - ') AND len(regexp_extract_all(split_part(t, ' - ', 1), '\\S+')) >= 2 THEN split_part(t, ' - ', 1) ELSE t END")
scalar("comparison_form", "CASE id % 4 WHEN 0 THEN 'The' WHEN 1 THEN concat('An ', title, '!') ELSE title END AS t", W.comparison_form, _CF.format("t"))
scalar("compact_form", _ODD_TITLE, W.compact, "regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g')")
_MINOR = ", ".join(f"'{w}'" for w in W.MINOR_WORDS)
scalar("titlecase", "CASE id % 3 WHEN 0 THEN upper(concat(title, ' of the rings')) WHEN 1 THEN concat('the ', title, '  and a mcKay') ELSE concat(' in ', title) END AS t", W.titlecase, f"""
    array_to_string(list_transform(regexp_extract_all(CASE WHEN t = upper(t) AND regexp_matches(t, '[A-Z]') THEN lower(t) ELSE t END, '\\s+|\\S+'),
      lambda x, i: CASE WHEN regexp_matches(x, '^\\s') THEN x WHEN lower(x) IN ({_MINOR}) AND i <> CASE WHEN regexp_matches(t, '^\\s') THEN 2 ELSE 1 END THEN lower(x) ELSE concat(upper(x[1]), x[2:]) END), '')""")
scalar("author_casing", "CASE id % 3 WHEN 0 THEN 'ANN VAN LEE' WHEN 1 THEN 'A. LEE' ELSE 'Ann mcLee' END AS t", W.author_casing, "CASE t WHEN 'ANN VAN LEE' THEN 'Ann Van Lee' ELSE t END")
scalar("garbage_names", "CASE id % 4 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'N/A' WHEN 2 THEN 'Various Authors' ELSE title END AS t", lambda t: {"title": W.is_garbage_title(t), "author": W.is_garbage_author(t)}, f"title := lower(trim(t)) IN ({', '.join(map(repr, W.GARBAGE_TITLES))}); author := lower(trim(t)) IN ({', '.join(map(repr, W.GARBAGE_AUTHORS))})")
_PAIR = "CASE id % 4 WHEN 0 THEN concat(title, '.epub') WHEN 1 THEN upper(title) ELSE title END AS a ;; CASE id % 3 WHEN 0 THEN 'quite other words' WHEN 1 THEN concat(title, ' again') ELSE concat('of ', reverse(title), ' it') END AS b"
_LONG = "list_filter(string_split_regex(trim(lower({0})), '\\s+'), lambda w: strlen(w) > 2)"
scalar("titles_contradict", _PAIR, lambda a, b: {"same": W.titles_equivalent(a, b), "contradict": W.titles_contradict(a, b), "file": W.is_likely_filename(a)}, f"same := contains(lower(a), lower(b)) OR contains(lower(b), lower(a)); contradict := a <> '' AND b <> '' AND NOT regexp_matches(lower(a), '\\.epub$') AND NOT contains(lower(a), lower(b)) AND NOT contains(lower(b), lower(a)) AND len(list_intersect({_LONG.format('a')}, {_LONG.format('b')})) = 0; file := regexp_matches(lower(a), '\\.epub$')")
scalar("contributor_names", "CASE id % 3 WHEN 0 THEN 'David A. French' WHEN 1 THEN 'D. French' ELSE 'Mary French' END AS a ;; CASE id % 2 WHEN 0 THEN 'David French' ELSE 'French' END AS b", W.name_matches, f"{_CF.format('a')} = {_CF.format('b')} OR (contains({_CF.format('a')}, ' ') AND contains({_CF.format('b')}, ' ') AND regexp_extract({_CF.format('a')}, '\\S+$') = regexp_extract({_CF.format('b')}, '\\S+$') AND {_CF.format('a')}[1] = {_CF.format('b')}[1])")
scalar("is_asin", "CASE book_id % 3 WHEN 0 THEN concat(value, 'x') ELSE value END AS t", lambda t: {"asin": T.is_asin(t), "norm": T.normalize_isbn(F.concat(F.lower(t), F.lit(" -")))}, "asin := regexp_matches(t, '^[0-9A-Za-z]{10}$'); norm := upper(regexp_replace(concat(lower(t), ' -'), '[\\s-]', '', 'g'))", "identifiers", "book_id")
_TEN = " + ".join(f"CAST(substring({{0}}, {i}, 1) AS INT) * {11 - i}" for i in range(1, 10))
_BODY = "substring(value, 4, 9)"
_CHECK = f"CASE (11 - ({_TEN.format(_BODY)}) % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - ({_TEN.format(_BODY)}) % 11) % 11 AS VARCHAR(2)) END"
_ODD13 = " + ".join(f"CAST(substring({{0}}, {i}, 1) AS INT) * {1 if i % 2 else 3}" for i in range(1, 13))
add("isbn10_to_13", lambda c: shared_sql(c, f"SELECT book_id, concat({_BODY}, {_CHECK}) AS ten FROM identifiers WHERE identifier_type = 'isbn13'").select("book_id", T.isbn10_ok(F.col("ten")).alias("ok"), T.isbn10_to_13(F.col("ten")).alias("v"), W.to_isbn13(F.lit("isbn10"), F.col("ten")).alias("w")),
    f"SELECT book_id, true AS ok, concat(b, CAST((10 - ({_ODD13.format('b')}) % 10) % 10 AS VARCHAR)) AS v, concat(b, CAST((10 - ({_ODD13.format('b')}) % 10) % 10 AS VARCHAR)) AS w FROM (SELECT book_id, concat('978', {_BODY}) AS b FROM identifiers WHERE identifier_type = 'isbn13') x")
scalar("parse_identifier", "CASE book_id % 4 WHEN 0 THEN concat(substring(value, 1, 5), '-', substring(value, 6, 8)) WHEN 1 THEN substring(value, 4, 10) WHEN 2 THEN concat('x', value) ELSE value END AS raw ;; CASE book_id % 3 WHEN 0 THEN 'AMAZON-ASIN' WHEN 1 THEN 'isbn' END AS scheme",
       lambda raw, scheme: {"kind": W.parse_identifier(raw, scheme)["type"], "value": W.parse_identifier(raw, scheme)["value"]}, (
           "kind := CASE WHEN scheme = 'AMAZON-ASIN' AND regexp_matches(replace(raw, '-', ''), '^[0-9A-Za-z]{10}$') THEN 'asin' WHEN regexp_matches(replace(raw, '-', ''), '^97[89][0-9]{10}$') THEN 'isbn13' WHEN regexp_matches(replace(raw, '-', ''), '^[0-9]{9}[0-9X]$') THEN 'isbn10' WHEN regexp_matches(replace(raw, '-', ''), '^B[0-9A-Za-z]{9}$') THEN 'asin' END; "
           "value := CASE WHEN regexp_matches(replace(raw, '-', ''), '^97[89][0-9]{10}$|^[0-9]{9}[0-9X]$|^B[0-9A-Za-z]{9}$') OR (scheme = 'AMAZON-ASIN' AND regexp_matches(replace(raw, '-', ''), '^[0-9A-Za-z]{10}$')) THEN replace(raw, '-', '') END"), "identifiers", "book_id")
scalar("valid_identifier", "identifier_type AS kind ;; CASE WHEN book_id % 9 = 0 THEN '9780000000000' ELSE value END AS val", W.is_valid_identifier, f"CASE kind WHEN 'isbn13' THEN val <> '9780000000000' AND ({_ODD13.format('val')} + CAST(substring(val, 13, 1) AS INT)) % 10 = 0 ELSE true END".replace("CAST(substring", "TRY_CAST(substring"), "identifiers", "book_id")


def isbns_sql(t: str, checksum: bool = True) -> str:
    """SQL of ``scan_isbns``: places of matches are lengths of what lies before them once matches stand between two marks."""
    def spans(pattern: str, to: str) -> str:
        p = f"string_split(regexp_replace({t}, '{pattern}', concat({to}), 'g'), chr(1))"
        return f"list_transform({p}[2:], lambda x, i: {{'a': list_sum(list_transform({p}[1:i], lambda y: len(replace(y, chr(2), '')))), 'm': split_part(x, chr(2), 1)}})"

    last = r"([^\p{L}\p{N}_]|$)"  # the end of a word for all alphabets
    kept, marked = "'\\1', chr(1), '\\2', chr(2)", "chr(1), '\\1', chr(2), '\\2'"
    taken = f"list_concat({spans(_LABEL, kept)}, {spans(_ADDRESS, kept)})"
    digits = lambda v, n, weight: f"list_sum(list_transform(range(1, {n + 1}), lambda j: CASE substring({v}, j, 1) WHEN 'X' THEN 10 ELSE TRY_CAST(substring({v}, j, 1) AS INT) END * {weight}))"
    right13, right10 = (f"{digits('v', 13, 'CASE WHEN j % 2 = 0 THEN 3 ELSE 1 END')} % 10 = 0", f"{digits('v', 10, '(11 - j)')} % 11 = 0") if checksum else ("true", "true")
    thirteen = rf"list_transform(regexp_extract_all({t}, '(97[89][\p{{Nd}}\- ]{{9,16}}\p{{Nd}}){last}', 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"
    free = f"list_filter({spans(rf'(\p{{Nd}}[\p{{Nd}}\- ]{{8,12}}[\p{{Nd}}Xx]){last}', marked)}, lambda s: len(list_filter({taken}, lambda k: s.a < k.a + len(k.m) AND k.a < s.a + len(s.m))) = 0)"
    ten = f"list_transform({free}, lambda s: upper(regexp_replace(s.m, '[^0-9Xx]', '', 'g')))"
    found = f"list_concat(list_transform(list_filter({thirteen}, lambda v: len(v) = 13 AND {right13}), lambda v: concat('isbn13:', v)), list_transform(list_filter({ten}, lambda v: regexp_matches(v, '^[0-9]{{9}}[0-9X]$') AND NOT regexp_matches(v, '^97[89]') AND {right10}), lambda v: concat('isbn10:', v)))"
    return first_seen_sql(found)


def first_seen_sql(found: str) -> str:
    """Distinct values of a list in order, joined by ``|``."""
    return f"coalesce(array_to_string(list_filter({found}, lambda f, i: list_position({found}, f) = i), '|'), '')"


_LABEL = r"(?i)(\b(?:LCCN|Library\s+of\s+Congress\s+Control\s+Number)\b\s*:?\s*)((?:\d[\s-]?){8,12})\b"
_ADDRESS = r"(?i)(\blccn\.loc\.gov/)(\d{8,12})\b"
_LCCNS = first_seen_sql(f"list_filter(list_transform(list_concat(regexp_extract_all(t, '{_LABEL}', 2), regexp_extract_all(t, '{_ADDRESS}', 2)), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda v: len(v) BETWEEN 8 AND 12)")

_LOOSE = "CASE doc_id % 5 WHEN 0 THEN concat(text, ' ISBN 0-306-40615-2 or 0306406153.') WHEN 1 THEN concat('978-0-306-40615-7 ', text, ' 080442957X') WHEN 2 THEN concat(text, ' LCCN: 20030403 ', '0306406152.') WHEN 3 THEN concat(text, ' lccn.loc.gov/2003012345 LCCN 2003012345') ELSE text END AS t"
scalar("isbn_scan_all", _LOOSE, lambda t: {"found": F.array_join(W.scan_isbns(t), "|"), "loose": F.array_join(W.scan_isbns(t, checksum=False), "|"), "lccn": F.array_join(W.lccn_values(t), "|")}, f"found := {isbns_sql('t')}; loose := {isbns_sql('t', False)}; lccn := {_LCCNS}", "documents", "doc_id")
scalar("scan_confidence", "rating / CAST(5.0 AS DOUBLE) AS base ;; id % 4 AS n", lambda base, n: F.round(W.scan_confidence(base, n), 6), "round(least(greatest(base * CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0.8 ELSE 0.6 END, 0), 1)::DOUBLE, 6)")
scalar("language_codes", "CASE id % 9 WHEN 0 THEN 'en-US' WHEN 1 THEN ' GER ' WHEN 2 THEN 'fra' WHEN 3 THEN 'Español' WHEN 4 THEN 'Undetermined' WHEN 5 THEN 'english' WHEN 6 THEN 'xx' WHEN 7 THEN 'pt_BR' ELSE language END AS t", lambda t: {"code": W.normalize_language(t), "label": W.language_label(W.normalize_language(t))}, "code := CASE id % 9 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' WHEN 4 THEN NULL WHEN 5 THEN 'en' WHEN 6 THEN NULL WHEN 7 THEN 'pt' ELSE t END; label := CASE CASE id % 9 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' WHEN 5 THEN 'en' WHEN 7 THEN 'pt' WHEN 8 THEN t END WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'pt' THEN 'Portuguese' END")
_Y = "CAST(1900 + id % 120 AS VARCHAR(4))"
scalar("year_forms", f"CASE id % 3 WHEN 0 THEN {_Y} WHEN 1 THEN concat('June ', {_Y}) ELSE 'no year' END AS a ;; concat(CASE WHEN id % 2 = 0 THEN 'D:' ELSE '' END, {_Y}, '0102') AS b ;; CASE id % 3 WHEN 0 THEN concat('c', {_Y}) WHEN 1 THEN concat('[', {_Y}, ']') ELSE concat('©', {_Y}) END AS d", lambda a, b, d: {"free": W.first_year(a), "pdf": W.pdf_year(b), "bare": W.bare_date(d)}, "free := CASE id % 3 WHEN 2 THEN NULL ELSE CAST(1900 + id % 120 AS INT) END; pdf := CAST(1900 + id % 120 AS INT); bare := CAST(1900 + id % 120 AS VARCHAR)")
scalar("split_list", "CASE id % 2 WHEN 0 THEN concat(title, ';; x, y ; ') ELSE concat(title, ' , x,,y') END AS t", lambda t: F.array_join(W.split_list(t), "|"), "array_to_string(list_filter(list_transform(string_split(t, CASE WHEN contains(t, ';') THEN ';' ELSE ',' END), lambda x: trim(x)), lambda x: x <> ''), '|')".replace("; ", ";"))
scalar("series_string", "concat('ring ', CASE id % 4 WHEN 0 THEN concat('saga, #', CAST(id AS VARCHAR(9))) WHEN 1 THEN concat('saga ', CAST(id AS VARCHAR(9)), '.5') WHEN 2 THEN 'saga' ELSE concat('saga #', CAST(id AS VARCHAR(9))) END) AS t", W.parse_series, "name := 'Ring Saga'; position := CASE id % 4 WHEN 1 THEN id + 0.5::DOUBLE WHEN 2 THEN NULL ELSE id::DOUBLE END")
scalar("imprint", "concat('The ', title) AS t ;; publisher_id AS p", lambda t, p: {"by_name": W.is_imprint(t, F.array(F.concat(F.lit("Press of the "), p), F.lit("none"))), "none": W.is_imprint(t, F.lit(None).cast("array<string>"))}, "by_name := p IS NOT NULL; none := false")
scalar("catalog_names", "CASE id % 5 WHEN 0 THEN 'Lee, Ann B. (Anna Beth), 1892-1973' WHEN 1 THEN 'Lee, Ann.' WHEN 2 THEN 'Lee, A.' WHEN 3 THEN 'Lee, Ann, 1965-' ELSE 'Some Press;' END AS n ;; CASE id % 3 WHEN 0 THEN 'aut.' WHEN 1 THEN 'Ed' ELSE 'Designer' END AS r ;; CASE id % 3 WHEN 0 THEN 'xiii, 256 p.' WHEN 1 THEN '12 p., 423 pages ; 24 cm.' ELSE '1 volume' END AS e ;; CASE id % 3 WHEN 0 THEN 'bk. 2' WHEN 1 THEN 'vol. 3 of 1.5' ELSE 'none' END AS k",
       lambda n, r, e, k: {"name": W.clean_catalog_name(n), "role": W.relator_role(r), "pages": W.extent_pages(e), "part": W.part_number(k)}, "name := CASE id % 5 WHEN 0 THEN 'Ann B. Lee' WHEN 2 THEN 'A. Lee' WHEN 4 THEN 'Some Press' ELSE 'Ann Lee' END; role := CASE id % 3 WHEN 0 THEN 'author' WHEN 1 THEN 'editor' ELSE 'designer' END; pages := CAST(CASE id % 3 WHEN 0 THEN 256 WHEN 1 THEN 423 END AS INT); part := CASE id % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE END")
scalar("subtitle_split", "CASE id % 3 WHEN 0 THEN concat(title, ' - A STUDY of it') WHEN 1 THEN concat(': a study of ', title) ELSE title END AS t", lambda t: W.split_on_subtitle(t, F.lit("a study")), "CASE WHEN strpos(lower(t)[2:], ': a study') > 0 THEN trim(substring(t, 1, strpos(lower(t)[2:], ': a study'))) WHEN strpos(lower(t), ' - a study') > 1 THEN trim(substring(t, 1, strpos(lower(t), ' - a study') - 1)) END")
scalar("unsupported_format", "CASE id % 4 WHEN 0 THEN 'Audio CD' WHEN 1 THEN 'Sound Recording' WHEN 2 THEN 'Paperback' END AS t", W.is_unsupported_format, "CASE WHEN t IS NULL THEN NULL ELSE t <> 'Paperback' END")
scalar("decision_codes", "concat(' ', metadata_status, ' : more: text') AS t", W.decision_code, "trim(split_part(t, ':', 1))")
add("publisher_trust", lambda c: W.trusted_publishers(c.books.select("id", F.concat(F.lit("The "), F.col("publisher_id")).alias("publisher_name")), c.spark.createDataFrame([("exact", "the brand#11", True), ("contains", "RAND#2", True), ("contains", "brand", False)], "match_mode string, match_value string, enabled boolean")).select("id", "publisher_trusted"),
    "SELECT id, coalesce(lower(concat('The ', publisher_id)) = 'the brand#11' AND publisher_id IS NOT NULL OR contains(lower(publisher_id), 'rand#2'), false) AS publisher_trusted FROM books")
_FILE = "concat(CASE id % 6 WHEN 0 THEN 'Ann Lee - Red_Ring (1999)' WHEN 1 THEN 'Ann Lee - Red Ring [Rings #2.5]' WHEN 2 THEN 'Ann Lee - Red Ring' WHEN 3 THEN 'Red Ring [Rings]' WHEN 4 THEN 'Red Ring (0999)' ELSE 'Red_Ring' END, CASE id % 2 WHEN 0 THEN '.EPUB' ELSE '.pdf' END)"
_FILE_SQL = "author := CASE WHEN id % 6 < 3 THEN 'Ann Lee' END; title := 'Red Ring'; series := CASE WHEN id % 6 IN (1, 3) THEN 'Rings' END; position := CASE id % 6 WHEN 1 THEN 2.5::DOUBLE END; year := CAST(CASE id % 6 WHEN 0 THEN 1999 END AS INT)"
scalar("filename_parse", f"{_FILE} AS t", W.parse_filename, _FILE_SQL)
_DIR = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Bob_Kay/' WHEN 2 THEN '/in/Bob_Kay/Blue Moon/' WHEN 3 THEN '/Media/inbox/' ELSE '/x/Bob Kay/0f0f0f0f-1111-2222-3333-aaaaaaaaaaaa/' END"
scalar("path_parse", f"concat({_DIR}, {_FILE}) AS t", lambda t: {k: v for k, v in W.parse_path(t).items() if k in ("author", "title")}, "author := CASE WHEN id % 6 < 3 THEN 'Ann Lee' WHEN id % 5 IN (1, 2, 4) THEN 'Bob Kay' END; title := CASE WHEN id % 6 = 5 AND id % 5 = 2 THEN 'Blue Moon' WHEN id % 6 = 4 AND id % 5 = 2 THEN 'Blue Moon' ELSE 'Red Ring' END")
scalar("completeness", "CASE WHEN id % 2 = 0 THEN title END AS t ;; CASE WHEN id % 3 = 0 THEN title END AS a ;; CASE WHEN id % 5 = 0 THEN title END AS s ;; publication_year AS y", lambda t, a, s, y: F.round(W.completeness(t, a, s, y), 6), "round((CASE WHEN t IS NULL THEN 0 ELSE 0.4 END + CASE WHEN a IS NULL THEN 0 ELSE 0.3 END + CASE WHEN s IS NULL THEN 0 ELSE 0.15 END + CASE WHEN y IS NULL THEN 0 ELSE 0.15 END)::DOUBLE, 6)")
scalar("storage_path", "CASE id % 3 WHEN 0 THEN '42 Authors' WHEN 1 THEN '' ELSE 'ann lee' END AS a ;; concat(title, '?') AS t", lambda a, t: W.storage_path(a, t, F.lit("book.epub")), "concat(CASE id % 3 WHEN 2 THEN 'A' ELSE '_' END, '/', CASE a WHEN '' THEN '_unknown' ELSE a END, '/', regexp_replace(t, '[/\\\\:*?\"<>|]+', '_', 'g'), '/book.epub')")
_A, _B = _NT.format("a"), _NT.format("b")
_TWO = "title AS a ;; CASE id % 4 WHEN 0 THEN concat('The ', title, ' again') WHEN 1 THEN reverse(title) WHEN 2 THEN '' ELSE concat(substring(title, 1, 5), ' other end') END AS b"
# pairs without an odd number of transpositions, of which the oracle's engine drops half a one
scalar("title_similarity", "title AS a ;; CASE id % 4 WHEN 0 THEN concat(title, ' again') WHEN 1 THEN concat(title, 's') WHEN 2 THEN '' ELSE substring(title, 1, 5) END AS b", lambda a, b: F.round(W.title_similarity(a, b), 6), f"CASE WHEN {_A} = '' OR {_B} = '' THEN CASE WHEN {_A} = {_B} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE round({_jw(f'({_A})', f'({_B})')}, 6) END")
_PRE = "(starts_with({0}, {1}) OR starts_with({1}, {0}))"
scalar("titles_match", _TWO, lambda a, b: {"fuzzy": W.titles_match(a, b), "ingest": W.ingest_titles_match(a, b)}, "fuzzy := x <> '' AND y <> '' AND (" + _PRE.format("replace(x, ' ', '')", "replace(y, ' ', '')") + f" OR {_tri('x', 'y')} >= 0.7); ingest := p <> '' AND q <> '' AND " + _PRE.format("p", "q"))
_CMP = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
ORACLES["titles_match"] = (ORACLES["titles_match"].removesuffix(") x") + ") s1) x").replace("FROM (SELECT id, title AS a", f"FROM (SELECT *, {_A} AS x, {_B} AS y, {_CMP.format('a')} AS p, {_CMP.format('b')} AS q FROM (SELECT id, title AS a")
_N1 = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
scalar("authors_match", "name AS a ;; CASE id % 3 WHEN 0 THEN lower(name) WHEN 1 THEN concat(substring(name, 1, 12), '9') ELSE '' END AS b", W.authors_match, "(" + _N1.format("b") + " <> '' AND " + _tri(f"({_N1.format('a')})", f"({_N1.format('b')})") + " >= 0.6)", "authors")
scalar("author_similarity", "name AS a ;; CASE id % 3 WHEN 0 THEN lower(name) WHEN 1 THEN concat(substring(name, 1, 12), '9') ELSE NULL END AS b", lambda a, b: F.round(W.author_similarity(F.array(a), F.filter(F.array(b, F.lit("zz qq")), lambda x: x.isNotNull())), 6), f"CASE WHEN b IS NULL THEN {_jw(f'({_N1.format('a')})', "'zz qq'")} ELSE greatest({_jw(f'({_N1.format('a')})', f'({_N1.format('b')})')}, {_jw(f'({_N1.format('a')})', "'zz qq'")}) / 2 END", "authors")
_R, _Q, _M = _CF.format("r"), _CF.format("q"), _CF.format("m")
scalar("search_confidence", "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(title, ' the end') ELSE title END AS r ;; CASE id % 3 WHEN 0 THEN concat(title, ': its other part') WHEN 1 THEN concat('word ', reverse(title), ' study') ELSE title END AS q ;; id % 11 = 0 AS hit", lambda r, q, hit: F.round(W.search_confidence(r, q, hit), 6), "round(CASE WHEN hit THEN 0.8 WHEN r IS NULL THEN 0.5 WHEN x = y THEN 0.8 WHEN contains(x, y) OR contains(y, x) OR (z <> y AND (contains(x, z) OR contains(z, x))) THEN 0.7 ELSE 0.5 + 0.3 * len(list_filter(string_split(x, ' '), lambda w: list_contains(string_split(y, ' '), w))) / greatest(len(string_split(x, ' ')), len(string_split(y, ' '))) END::DOUBLE, 6)")
_MAIN = "CASE WHEN contains(q, ': ') AND len(regexp_extract_all(split_part(q, ': ', 1), '\\S+')) >= 2 THEN split_part(q, ': ', 1) WHEN contains(q, ' - ') AND len(regexp_extract_all(split_part(q, ' - ', 1), '\\S+')) >= 2 THEN split_part(q, ' - ', 1) ELSE q END"
ORACLES["search_confidence"] = ORACLES["search_confidence"].replace(" FROM (SELECT id, CASE id % 5", f" FROM (SELECT *, {_R} AS x, {_Q} AS y, {_M} AS z FROM (SELECT *, {_MAIN} AS m FROM (SELECT id, CASE id % 5").removesuffix(") x") + ") s1) s2) x"
