"""The operators over their whole tables with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import alignment, decontaminate, divergence, encoding, language_model, line_dedup, near_dedup, quality_rules, suffix_dedup, token_count, token_files, toxicity, url_filter
from pathloom.llm.common import shared_folder, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 1


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoding.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("_toxicity.passages").cast("long").alias("n_passages"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(list_slice(w, p, p + l - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS p FROM bl)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, l, p, array_to_string(list_slice(w, p, p + l - 1), ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, p, l, item_id FROM dw JOIN bw USING (l, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, no, line FROM (
  SELECT doc_id, unnest(range(0, len(ls))) AS no, trim(unnest(ls), ' ' || chr(9) || chr(13)) AS line FROM raw) WHERE line <> ''),
w AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM l),
s AS (SELECT *, t - words AS s FROM (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS t FROM w)),
r AS (
  SELECT doc_id, no, list(line) OVER run AS lines, sum(words) OVER run AS n, max(no) OVER run AS last
  FROM s WINDOW run AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(no) OVER run, list(line) OVER run, sum(words) OVER run, no
  FROM s WINDOW run AS (PARTITION BY doc_id ORDER BY t RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
  UNION
  SELECT doc_id, before, [line_before, line], words, no FROM (
    SELECT *, lag(no) OVER doc AS before, lag(line) OVER doc AS line_before, lag(words) OVER doc AS words_before
    FROM s WINDOW doc AS (PARTITION BY doc_id ORDER BY no)) WHERE words >= 50 AND words_before >= 50),
k AS (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, no) AS nth FROM r WHERE n >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(no, last + 1)) AS no FROM k WHERE nth > 1),
parts AS (SELECT doc_id, unnest(range(0, len(ls))) AS no, unnest(ls) AS line FROM raw),
left_over AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.no) FILTER (g.no IS NULL) AS text, count(g.no) AS n_removed
  FROM parts p LEFT JOIN gone g USING (doc_id, no) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n, count(DISTINCT id) AS df
  FROM (SELECT lang, source, id, unnest(w) AS term FROM d) GROUP BY lang, source, term),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, term HAVING sum(df) >= 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS lang_n FROM k GROUP BY lang),
e AS (SELECT lang, source, term, n, total FROM c JOIN k USING (lang, term)),
g AS (
  SELECT lang, source, CAST(coalesce(group_n, 0) AS HUGEINT) AS group_n, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM e GROUP BY lang, source) USING (lang, source)
  LEFT JOIN l USING (lang)),
f AS (
  SELECT k.lang, g.source, k.term, 1 + 1000000000 * (coalesce(e.n, 0) + 1) // (group_n + v) AS p
  FROM k JOIN g USING (lang) LEFT JOIN e ON e.lang = k.lang AND e.source = g.source AND e.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
shares AS (
  SELECT lang, source, term AS item, 1 + 1000000000 * (n + 1) // (group_n + v) AS p, 1 + 1000000000 * (total + 1) // (lang_n + v) AS q
  FROM e JOIN g USING (lang, source)),
terms AS (SELECT lang, source, 'term' AS part, item, (p - q) * (p - q) // q AS value FROM shares WHERE p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""

ORACLES = {"op11_source_divergence": OP11_SQL, "op2_line_dedup": OP2_SQL, "op1_decontamination": OP1_SQL}
