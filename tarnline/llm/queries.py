"""Queries of the training-data operators, by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmlcut, imatch, importance, licences, neardup, packing, secretscan, suffixdedup, toxicity, warc, whitening
from .common import Staged, sha256_hex, table


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Staged(spark, "op1"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), "toxicity")
    score = F.col("toxicity.score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), "licence").select("doc_id", "licence.*")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    digests = chat.read_back(chat.format_conversations(chat.text_parts(turns.unionByName(own))))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secretscan.train_markov(secretscan.labelled_samples(spark))
    found = secretscan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "secrets", ratios)
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    joined = found.select("doc_id", *(secretscan.counted(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")), secretscan.joined(base).alias("base"), secretscan.joined(spans).alias("spans"))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", sha256_hex("base").alias("base_sha256"), "spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "hits")
    hits = F.col("hits")
    named = found.select("doc_id", hits["n_words"].alias("n_words"), decontam.n_hit(hits).alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"), F.array_join(hits["items"], ",").alias("items"), hits["longest_words"].alias("longest_words"), hits["longest_item"].alias("longest_item"), hits["longest_at"].alias("longest_at"))
    return named.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_words", "longest_item", "longest_at")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), Staged(spark, "op8"), words=4)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlcut.extract_pages(pages, "main").select("page_id", "url", F.col("main.text").alias("text"), F.col("main.n_chars").alias("n_chars"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), Staged(spark, "op10"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Staged(spark, "op11"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark, "op12")
    path = f"{staged.root}/archive"
    warc.write_pages(table(spark, sf_dir, "pages"), path, staged)
    read = warc.read_pages(spark, path, staged)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), Staged(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_harmonic_packing, op2_toxicity, op3_licence_scan, op4_chat_format, op5_imatch, op6_secret_scan, op7_decontaminate, op8_near_duplicates, op9_main_text, op10_suffix_dedup, op11_importance_sample, op12_web_archive, op13_whitening)}

_CHAT = r"""WITH turns AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(role) + length(text) + 23 + len(regexp_extract_all(role || ' ' || text, '[<\[]\\*(?:\||/?s>|</?SYS>>|/?INST\]|/?SYSTEM_PROMPT\]|/?AVAILABLE_TOOLS\]|/?TOOL_RESULTS\]|TOOL_CALLS\])')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id"""

# CRC-32 is linear: that of a text is the exclusive or of what each byte gives with so many bytes behind it ("back"), and of what the initial register gives.
_IMPORTANCE = r"""WITH RECURSIVE words AS MATERIALIZED (SELECT k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark)),
place AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM words),
feature AS MATERIALIZED (SELECT k, f, count(*) AS n FROM (SELECT k, w[i] AS f FROM place UNION ALL SELECT k, w[i] || ' ' || w[i + 1] FROM place WHERE i < len(w) UNION ALL SELECT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM place WHERE i < len(w) - 1) GROUP BY ALL),
kind AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, strlen(f) AS m FROM (SELECT DISTINCT f FROM feature)),
bits(b, j, c) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, j + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE j < 8),
tab AS MATERIALIZED (SELECT b, c FROM bits WHERE j = 8),
deepest AS MATERIALIZED (SELECT max(m) AS d FROM kind),
shifted(b, back, c) AS (SELECT b, 0, c FROM tab UNION ALL SELECT 256, 0, 4294967295 UNION ALL SELECT s.b, s.back + 1, xor(s.c >> 8, t.c) FROM shifted s JOIN tab t ON t.b = s.c & 255 WHERE s.back < (SELECT d FROM deepest)),
gives AS MATERIALIZED (SELECT printf('%02X', b) AS h, back, c FROM shifted WHERE b < 256),
summed AS (SELECT f, bit_xor(c) AS c FROM (SELECT f, m, unnest(range(m)) AS i, h FROM kind) b JOIN gives g ON g.h = substr(b.h, 2 * b.i + 1, 2) AND g.back = b.m - 1 - b.i GROUP BY f),
bucket AS MATERIALIZED (SELECT f, xor(xor(u.c, s.c), 4294967295) % 10000 AS bucket FROM summed u JOIN kind USING (f) JOIN shifted s ON s.b = 256 AND s.back = m),
total AS (SELECT bucket, coalesce(sum(n) FILTER (k > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (k < 0), 0)::DOUBLE AS t FROM feature JOIN bucket USING (f) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM total),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM total, whole),
weighed AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM feature JOIN bucket USING (f) JOIN gain USING (bucket) WHERE k > 0 GROUP BY k),
scored AS (SELECT k, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM words LEFT JOIN weighed USING (k) WHERE k > 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, k) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM ordered"""

_ARCHIVE = """WITH pay AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages), dig AS (SELECT page_id, octet_length(p) AS payload_bytes, sha256(p) AS payload_digest FROM pay),
least AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM dig)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM least"""

ORACLES: dict[str, str] = {"op12_web_archive": _ARCHIVE, "op11_importance_sample": _IMPORTANCE, "op3_licence_scan": licences.oracle(), "op4_chat_format": _CHAT}
