"""The queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


def tokenizer(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return str(Path(TOKENIZERS) / name)
    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import warc

    archive = warc.write_archive(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_digests(archive).withColumnRenamed("id", "page_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import bpe

    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import langid, lm

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 7, 2)
    model = lm.train(docs.where(~held & F.col("doc_id").isNotNull()), order=2)
    return lm.score(docs, model).select(F.col("id").alias("doc_id"), langid.held_out(F.col("id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import records

    index = records.write_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return records.read_digests(index).withColumnRenamed("id", "doc_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import decontam

    index = decontam.build(_table(spark, sf_dir, "benchmark"))
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), index).withColumnRenamed("id", "doc_id")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import jaccard

    return jaccard.similar(_table(spark, sf_dir, "documents"), jaccard.Join(words=4, least=85, per=100)).withColumnRenamed("id", "doc_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import langid

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model, with_spans=False)
    return found.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import wordpiece

    vocabulary = wordpiece.load_vocabulary(tokenizer("piece_bpe_32k.model"))
    return wordpiece.piece_counts(_table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("id", "doc_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import licenses

    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    return found.select(F.col("id").alias("doc_id"), names.alias("license_ids"), F.size("licenses").cast("bigint").alias("n_licenses"), "n_unknown", F.get("licenses", F.lit(0))["start"].alias("first_start"), F.get("licenses", F.lit(0))["end"].alias("first_end"), "licenses")


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import matroska

    return matroska.media_features(matroska.store_texts(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import whiten

    vectors = _table(spark, sf_dir, "embeddings")
    return whiten.components_of(vectors, whiten.fit(vectors, components=4, scale=256.0)).withColumnRenamed("id", "vec_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import spelling

    return spelling.group(_table(spark, sf_dir, "documents"), spelling.Rules(shortest=7, least=2, ratio=10, noise=31)).select("word", "n", "n_near", "form", "form_n", "root")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concord.llm import interleave

    placed = interleave.assign(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {f.__name__: f for f in (op1_warc, op2_bpe, op3_lm, op4_records, op5_decontamination, op6_jaccard, op7_language, op8_token_counts, op9_licenses, op10_matroska, op11_whitening, op12_spelling, op13_sharding)}

SQL: dict[str, str] = {
    # the largest page_id of equal payloads is the response
    "op1_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, url,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS chosen
  FROM pages),
h AS (
  SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, octet_length(body) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER // power(32, 3 - i % 4)::INTEGER % 32 AS INTEGER), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = chosen THEN NULL ELSE chosen END AS refers_to,
  replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target_uri
FROM h""",
}
