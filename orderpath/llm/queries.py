"""One query per operator over the whole table, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpath.llm import attention_lm, bpe_tree, byte_cnn, feistel, heavy_dedup, id_files, lexicon, merkle, phrase_automata, setsketch, token_spans, whitening, winnowing
from orderpath.llm.common import fold, read_table
from orderpath.session import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/orderpath/ids-{uuid.uuid4().hex}"
    id_files.write_ids(documents(spark, sf_dir), path)
    return id_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(bpe_tree.encode_documents(documents(spark, sf_dir)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.group_near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = attention_lm.train_and_score(documents(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), *scored.columns[1:])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = byte_cnn.fit_quality(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return judged(byte_cnn.score_documents(docs, network), fold(F.col("doc_id"), 5) == 0, 0.3)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = heavy_dedup.group_copies(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.count_tokens(documents(spark, sf_dir), fields=("source", "text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find_contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        winnowing.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    entries = lexicon.learn_lexicon(docs, read_table(spark, sf_dir, "labels"))
    return judged(lexicon.score_documents(docs, entries), fold(F.col("doc_id"), 3) == 1, 0.7)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel.shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_automata.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = merkle.manifest(documents(spark, sf_dir), tampered, {"text": merkle.lowered(F.col("text"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def judged(scored: DataFrame, held_out, threshold: float) -> DataFrame:
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


QUERIES = {
    "op1_elias_fano_ids": op1,
    "op2_tree_bpe": op2,
    "op3_setsketch_near_dedup": op3,
    "op4_attention_lm": op4,
    "op5_byte_cnn_quality": op5,
    "op6_heavy_split_dedup": op6,
    "op7_token_spans": op7,
    "op8_winnowing": op8,
    "op9_lexicon_toxicity": op9,
    "op10_feistel_shards": op10,
    "op11_lanczos_whitening": op11,
    "op12_phrase_automata": op12,
    "op13_merkle_manifest": op13,
}

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_setsketch_near_dedup": rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
""",
    "op6_heavy_split_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
  text_sha256
FROM t
""",
    "op8_winnowing": rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, unnest(list_transform(range(1, len(words) - least(13, len(words)) + 2),
    lambda i: array_to_string(words[i : i + least(13, len(words)) - 1], ' '))) AS gram
  FROM b WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS pos,
    unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i : i + size - 1], ' '))) AS gram
  FROM d, sizes WHERE len(words) >= size),
hit AS (SELECT doc_id, item_id, pos, size FROM dw JOIN bw USING (size, gram)),
place AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM hit, range(13) r(k) WHERE k < size GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
""",
}
