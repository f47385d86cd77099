"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_model, toxicity
from .byte_bpe import Vocabulary, decode, encode
from .common import table, work_dir
from .decontaminate import decontaminate
from .filter_audit import audit_documents
from .jaccard_join import near_duplicates
from .license_scan import scan_licenses
from .lm_score import stupid_backoff
from .mixing import mix_sources
from .quality_rules import quality_rules
from .suffix_dedup import remove_repeats
from .token_counts import Tokenizer, TokenRollup
from .vector_codes import vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_key", "text_hash")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under a bigram model of all others."""
    return stupid_backoff(table(spark, sf_dir, "documents")).withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


#: Where the public vocabulary lies on the driver.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after a load, committed twice, and batches that revise an eighth, delete an eighth and insert it again.

    The totals are those of the whole table, whatever the batches before did.
    """
    rollup = TokenRollup(spark, work_dir(spark, "tokens"), Tokenizer(TOKENIZER))
    docs = table(spark, sf_dir, "documents")
    load = docs.withColumn("change", F.lit("insert"))
    eighth = lambda n: F.crc32(F.col("doc_id").cast("string")) % 8 == n
    rollup.commit("load", load)
    rollup.commit("load", load)
    change = F.when(eighth(1), "revise").when(eighth(2), "delete")
    rollup.commit("change", docs.withColumn("change", change).where("change is not null"))
    rollup.commit("again", load.where(eighth(2)))
    return rollup.totals()


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /source/lang/shelf of 64/name; those of at most 400 characters are licence files."""
    name = F.when(F.length("text") <= 400, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.floor(F.col("doc_id") / 64), name)
    return scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path)).drop("path")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256).drop("label")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, offsets=False)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    rows = decode(rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), vocabulary)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_quality_model": op4_quality_model,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_score": op9_lm_score,
    "op10_mix_sources": op10_mix_sources,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {}

_SPACED = r"[^\x20\x09-\x0D]+"
ORACLES["op8_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (VALUES (5), (10), (101)) s(k) WHERE len(w) >= k),
h AS (SELECT doc_id, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS x FROM g),
r AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, x) AS n FROM h) q WHERE n > 1),
c AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM r) q GROUP BY doc_id, k),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) q WHERE regexp_matches(line, '{_SPACED}') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words, coalesce(c10.n, 0) AS covered_words, coalesce(c101.n, 0) > 0 AS long
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c c5 ON c5.doc_id = d.doc_id AND c5.k = 5
  LEFT JOIN c c10 ON c10.doc_id = d.doc_id AND c10.k = 10 LEFT JOIN c c101 ON c101.doc_id = d.doc_id AND c101.k = 101),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed, NOT base_failed AND covered_words <= 0.15 * n_words AND NOT long AS kept FROM b"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _ALNUM + "')"
ORACLES["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents), b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) q),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) s WHERE len(w) >= k) q),
hit AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON win.k = g.k AND win.x = g.x),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) q GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

ORACLES["op9_lm_score"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) q),
u AS (SELECT x, count(*) AS n FROM p GROUP BY x), b AS (SELECT v, x, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, x), z AS (SELECT count(*) AS n FROM p),
du AS (SELECT doc_id, x, count(*) AS n FROM p GROUP BY doc_id, x), db AS (SELECT doc_id, v, x, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY doc_id, v, x),
q AS (SELECT p.doc_id, p.v, u.n - du.n AS one, coalesce(b.n - db.n, 0) AS two, c.n - dc.n AS context, greatest(z.n - len(d.w), 1) AS size
  FROM p JOIN d ON d.doc_id = p.doc_id JOIN u ON u.x = p.x JOIN du ON du.doc_id = p.doc_id AND du.x = p.x LEFT JOIN b ON b.v = p.v AND b.x = p.x LEFT JOIN db ON db.doc_id = p.doc_id AND db.v = p.v AND db.x = p.x
  LEFT JOIN u c ON c.x = p.v LEFT JOIN du dc ON dc.doc_id = p.doc_id AND dc.x = p.v, z),
s AS (SELECT doc_id, sum(CASE WHEN two > 0 THEN ln(two / context) ELSE ln(CASE WHEN one > 0 THEN one ELSE 0.5::DOUBLE END / size) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END) AS s FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(CASE WHEN len(w) > 0 THEN s / len(w) ELSE 0 END, 6) AS mean_log_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""


ORACLES["op12_filter_audit"] = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) | (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  | (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END) | (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  | (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o) q),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
c AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN fails & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM c"""
