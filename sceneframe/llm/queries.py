"""The text operators as named queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.llm import extraction, idfiles, language, leakage, likelihood, manifest, overlap, privacy, quality, ranking, secrets, templates, tokens
from sceneframe.llm.common import read, remainder
from sceneframe.operators.scale import checkpoint_folder

#: rank file and pattern of the byte-level BPE query
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: tokenizer and end id of the id files
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op2_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return likelihood.likelihood(read(spark, sf, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.jaccard_groups(read(spark, sf, "documents"), n=4, percent=85)


def op4_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.round_trip(read(spark, sf, "documents"), RANKS, PATTERN)


def op5_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.main_text(read(spark, sf, "pages"))


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf, "documents")))


def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.digest(privacy.spans(read(spark, sf, "documents")))


def op8_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: lines with words, dropped lines, and the SHA-256 of the text that stays."""
    return (templates.drop_recurring(read(spark, sf, "documents").select("doc_id", "text"))
            .select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                    F.sha2("text", 256).alias("kept_sha256")))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(read(spark, sf, "documents"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.search(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Witnesses of all rows; a third of the ids, by a hash, are checked with a text that was lower-cased."""
    return manifest.verify(manifest.witnesses(read(spark, sf, "documents")), remainder("doc_id", 3) == 0)


def op13_id_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write the ids of all documents, read the files back and hash what they hold."""
    folder = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    idfiles.write(read(spark, sf, "documents"), folder, TOKENIZER, END_ID)
    return idfiles.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_score, op3_ngram_jaccard, op4_bpe_round_trip, op5_main_text, op6_secret_scan, op7_personal_data, op8_line_templates, op9_language_id, op10_decontamination,
                                    op11_ranked_search, op12_merkle_manifest, op13_id_files)}
ORACLE_SQL = {
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cuts AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS t FROM cuts),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT p.doc_id, p.s, p.m, win.item_id FROM (SELECT doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS t FROM places) p
        JOIN win ON win.t = p.t),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hit)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "op11_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
w AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term),
score AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
          FROM p JOIN weight USING (term) JOIN q USING (term), c GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM score WHERE score > 0) WHERE place <= 20""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE field AS (SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(len(CAST(doc_id AS VARCHAR)), ':', doc_id) END,
           CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
           CASE WHEN n_chars IS NULL THEN '-' ELSE concat(len(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head,
    list_reduce(list_concat([4294967295], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT))),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, xor(crc, 4294967295) % 3 = 0 AS tampered, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END) AS leaf,
               sha256(head || CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(low), ':', low) END) AS low_leaf FROM field)),
node AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaf
  UNION ALL SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM node WHERE n > 1 GROUP BY lang, lvl, pos // 8),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
run AS (SELECT lang, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM node WHERE n > 1 GROUP BY ALL),
toprun AS (SELECT lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
step AS (SELECT l.doc_id, l.leaf, l.lang, l.pos AS place, r.lvl, list_slice(hs, 1, (l.pos // CAST(pow(8, r.lvl) AS BIGINT)) % 8) AS before, list_slice(hs, (l.pos // CAST(pow(8, r.lvl) AS BIGINT)) % 8 + 2, 8) AS after
  FROM leaf l JOIN run r ON l.lang IS NOT DISTINCT FROM r.lang AND l.pos // CAST(pow(8, r.lvl + 1) AS BIGINT) = r.run
  UNION ALL SELECT l.doc_id, l.leaf, l.lang, l.pos, 100 + r.lvl, list_slice(hs, 1, (s.pos // CAST(pow(8, r.lvl) AS BIGINT)) % 8), list_slice(hs, (s.pos // CAST(pow(8, r.lvl) AS BIGINT)) % 8 + 2, 8)
  FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang JOIN toprun r ON s.pos // CAST(pow(8, r.lvl + 1) AS BIGINT) = r.run),
path AS (SELECT lang, place, list(array_to_string(before, '') ORDER BY lvl) AS b, list(array_to_string(after, '') ORDER BY lvl) AS a FROM step GROUP BY lang, place),
fold AS (SELECT l.lang, l.pos, 0 AS k, coalesce(b, []) AS b, coalesce(a, []) AS a, CASE WHEN tampered THEN low_leaf ELSE leaf END AS h
  FROM leaf l LEFT JOIN path p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.place
  UNION ALL SELECT lang, pos, k + 1, b, a, sha256(b[k + 1] || h || a[k + 1]) FROM fold WHERE k < len(b))
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(array_to_string(list_transform(range(1, len(f.b) + 1), lambda k: f.b[k] || f.a[k]), '')) AS proof_sha256,
       f.h AS folded_root, f.h = t.h AS verified
FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t ON t.n = 1 JOIN fold f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.k = len(f.b)""",
}
