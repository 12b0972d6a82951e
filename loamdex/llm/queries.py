"""The queries of the corpus operators over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import alignment, byte_bpe, decontaminate, fingerprints, licenses, merkle, pii, secrets, sharding, simhash, textops, token_counts, toxicity, wrappers
from loamdex.session import dealt

#: Folder of the public tokenizer files; None asks the package that ships them.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name == "documents" else rows


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, list_aggregate(list_slice(w, i, i + least(len(w), 13) - 1), 'string_agg', ' ') AS win
  FROM b, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i - 1 AS s, k, list_aggregate(list_slice(w, i, i + k - 1), 'string_agg', ' ') AS win
  FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i) WHERE len(w) >= k),
h AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, win)),
n_hit AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM h, unnest(generate_series(0, k - 1)) AS u(o) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.joined, '')) AS items_sha256, coalesce(n_hit.n_hit, 0) > 0 AND 20 * coalesce(n_hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleaved_shards(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def _list(values, kind: str = "VARCHAR[]") -> str:
    return f"{[list(v) if isinstance(v, tuple) else v for v in values]}::{kind}"


def _op10_sql() -> str:
    """The same by brute force: every line, and every run of words that begins with a template word, against every template."""
    rows = [f"({i}, '{t.label}', {_list(t.words)}, {t.need}, {t.span}, {_list(t.needed)}, {_list(t.others, 'VARCHAR[][]')})" for i, t in enumerate(licenses.compiled())]
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    pattern = textops.WORD
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS w FROM d),
template(id, label, words, need, span, needed, others) AS (VALUES {", ".join(rows)}),
phrase(words, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, i - 1 AS pos, label FROM w, phrase, unnest(generate_series(1, len(w.w))) AS u(i)
  WHERE w.w[i] = phrase.words[1] AND list_slice(w.w, i, i + len(phrase.words) - 1) = phrase.words),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
candidate AS MATERIALIZED (SELECT doc_id, id, w FROM w, template WHERE len(list_intersect(words, w)) >= need),
line AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{pattern}')) AS words FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d WHERE doc_id IN (SELECT doc_id FROM candidate))),
block AS (
  SELECT doc_id, id, line.words FROM line JOIN candidate USING (doc_id) UNION ALL
  SELECT doc_id, id, list_distinct(list_slice(w, i, i + span - 1)) FROM candidate JOIN template USING (id), unnest(generate_series(1, len(w))) AS u(i) WHERE list_contains(words, w[i])),
met AS (
  SELECT doc_id, label, len(list_intersect(t.words, b.words)) / CAST(len(t.words) AS DOUBLE) AS share FROM block b JOIN template t USING (id)
  WHERE len(list_intersect(t.words, b.words)) >= need AND len(list_intersect(needed, b.words)) = len(needed) AND len(list_filter(others, lambda o: len(list_intersect(o, b.words)) = len(o))) = 0),
label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS best FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN label USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(_table(spark, sf_dir, "documents"))


#: A leaf of document d with the text {0}; CRC-32 of the decimal id, bit by bit.
_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), repeat([0::BIGINT], 8)), lambda d, z: xor(d >> 1, (d & 1) * 3988292384))), 4294967295)"""
OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF_SQL.format("text")} AS leaf,
    CASE WHEN {_CRC32_SQL} % 3 = 0 THEN {_LEAF_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM d),
lower_level(lang, l, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed UNION ALL
  SELECT lang, l + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM lower_level WHERE n > 1 GROUP BY lang, l, pos // 8),
subroots AS MATERIALIZED (SELECT lang, h AS subroot, max_l, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM (SELECT *, max(l) OVER (PARTITION BY lang) AS max_l FROM lower_level) WHERE l = max_l),
upper_level(l, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM subroots UNION ALL
  SELECT l + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM upper_level WHERE n > 1 GROUP BY l, pos // 8),
top AS (SELECT h AS root FROM upper_level ORDER BY l DESC LIMIT 1),
run AS MATERIALIZED (
  SELECT lang, l, pos // 8 AS run, list(h ORDER BY pos) AS hs, 0 AS tree FROM lower_level WHERE n > 1 GROUP BY lang, l, pos // 8 UNION ALL
  SELECT NULL, l, pos // 8, list(h ORDER BY pos), 1 FROM upper_level WHERE n > 1 GROUP BY l, pos // 8),
step AS MATERIALIZED (
  SELECT id, r.l, array_to_string(list_slice(hs, 1, (pos // pow(8, r.l)::BIGINT) % 8), '') AS left_of, array_to_string(list_slice(hs, (pos // pow(8, r.l)::BIGINT) % 8 + 2, 8), '') AS right_of
  FROM placed p JOIN run r ON tree = 0 AND p.lang IS NOT DISTINCT FROM r.lang AND r.run = p.pos // pow(8, r.l + 1)::BIGINT UNION ALL
  SELECT id, max_l + r.l, array_to_string(list_slice(hs, 1, (s.pos // pow(8, r.l)::BIGINT) % 8), ''), array_to_string(list_slice(hs, (s.pos // pow(8, r.l)::BIGINT) % 8 + 2, 8), '')
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN run r ON tree = 1 AND r.run = s.pos // pow(8, r.l + 1)::BIGINT),
way AS MATERIALIZED (SELECT id, list((left_of, right_of) ORDER BY l) AS steps FROM step GROUP BY id),
fold(id, l, h) AS (
  SELECT id, 1, coalesce(tampered, leaf) FROM placed UNION ALL
  SELECT fold.id, l + 1, sha256(steps[l][1] || h || steps[l][2]) FROM fold JOIN way USING (id) WHERE l <= len(steps)),
folded AS (SELECT id, arg_max(h, l) AS folded_root FROM fold GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[1] || s[2]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN folded USING (id) LEFT JOIN way USING (id), top
"""


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(dealt(_table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_secret_scans": op2_secret_scans,
    "op3_token_counts": op3_token_counts,
    "op4_personal_data": op4_personal_data,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_license_scans": op10_license_scans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_html_extraction": op13_html_extraction,
}
SQL = {
    "op7_benchmark_decontamination": OP7_SQL,
    "op10_license_scans": _op10_sql(),
    "op11_merkle_manifest": OP11_SQL,
}
