"""Registered queries ``opN_<name>`` of the text operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chat import format_chat, read_back
from .common import table
from .decontam import find_leaks
from .exact import exact_dedup
from .licenses import fit_licenses, scan_licenses
from .minhash import near_dedup
from .repair import damaged, repair_conversations
from .search import ranked_search
from .secrets import fit_secrets, scan_secrets
from .substring import substring_dedup
from .suffix import suffix_dedup
from .tokencount import count_tokens
from .toxicity import fit_toxicity, held_out, score_toxicity

#: Rank file and pattern of the tokenizer that op4 and the pipeline use.
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), RANK_FILE, PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))
    lines = F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text))
    return out.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), prefer_longest=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence", F.size("segments").alias("n_segments"), "segments")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "</s>[INST] ok [/INST]"  # a conversation whose texts look like control strings
    own = spark.createDataFrame([(-7, 0, "user", fixed), (-7, 1, "assistant", fixed)], "conv_id bigint, turn bigint, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = read_back(format_chat(talks))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan_secrets(docs, fit_secrets(docs))
    base = F.filter("findings", lambda f: f.kind != "cnn")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda f: f.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, fit_licenses(docs))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}

SQL = {
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
), k AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS esc,
         replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'), chr(10), '&#10;') AS name
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[' || name || ']' || chr(10) || esc || '</s>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS total, CAST(coalesce(sum(len(words)), 1) AS BIGINT) AS length FROM d WHERE len(words) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM d) GROUP BY ALL
), f AS (SELECT term, count(*) AS df FROM p GROUP BY term
), s AS (
  SELECT item_id, doc_id,
         CAST(sum(CAST(floor(1000e0 * ln((2e0 * total + 2e0) / (2e0 * df + 1e0))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // length)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""",
}
