"""The registered queries of this subpackage: thin maps from the given tables to the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import byte_bpe, chunk_bpe, fingerprints, hard_negatives, jaccard_join, language_crf, lm_scores, mixing, quality_mil, quality_rules, toxicity, url_filter, whitening
from tonelake.llm.statements import HARD_NEGATIVES, LM_SCORES, MIX, NEAR_DUPLICATES, QUALITY

Runner = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def payloads(documents: DataFrame) -> DataFrame:
    """Documents as payload records."""
    return documents.select(F.col("doc_id").alias("capture_id"), F.col("text").alias("message_utf8"))


def vocabulary() -> tuple[bytes, str]:
    """The rank file and the pre-token pattern of the public multilingual vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return lines.read(), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    encoded = byte_bpe.encode_payloads(payloads(table(spark, sf_dir, "documents")), ranks, pattern)
    return byte_bpe.decode_payloads(encoded, ranks).select(
        F.col("capture_id").alias("doc_id"),
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("message_bytes", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_payloads(payloads(table(spark, sf_dir, "documents")))
    return judged.select(
        F.col("capture_id").alias("doc_id"),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(payloads(table(spark, sf_dir, "documents"))).select(
        F.col("capture_id").alias("doc_id"), "n_shingles", "component_id"
    )


def toxicity_labels(labels: DataFrame) -> DataFrame:
    """The two categories that the labels hold, in chain order: junk, then toxic."""
    return labels.select(F.col("doc_id").alias("capture_id"), (1 - F.col("quality")).alias("junk"), "toxic")


def toxic_scores(documents: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    texts = payloads(documents) if not carried else documents
    return toxicity.score_toxicity(texts, toxicity_labels(labels), ["junk", "toxic"], carried=carried)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("capture_id").alias("doc_id"), (F.col("p_toxic") >= 0.5).alias("toxic"), "p_toxic", "p_junk"
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores.score_payloads(payloads(table(spark, sf_dir, "documents")))
    return scored.select(F.col("capture_id").alias("doc_id"), "n_words", "n_backed", F.round("score", 6).alias("score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("capture_id"), F.col("source").alias("modulation"), F.col("text").alias("message_utf8")
    )
    return mixing.plan_mix(captures).taken().select(
        F.col("capture_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "pages").select(F.col("page_id").alias("name"), "url")
    # The labelled addresses are those that a rule speaks for.
    rule = url_filter.longest_rule(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), URL_RULES)
    blocking = [r for r, verdict in URL_RULES.items() if verdict == "block"]
    labelled = manifest.select("url", rule.alias("rule")).where("rule IS NOT NULL")
    labelled = labelled.select("url", F.col("rule").isin(blocking).cast("int").alias("blocked"))
    return url_filter.judge_urls(manifest, URL_RULES, labelled).select(
        F.col("name").alias("page_id"), "host", "path", "rule", "verdict", "p_block"
    )


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = documents.where(~held_out).select(F.col("doc_id").alias("capture_id"), F.col("lang").alias("language"))
    return language_crf.label_languages(payloads(documents), labels).withColumnRenamed("capture_id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), F.col("language").alias("lang_pred"), "score", "n_words"
    )


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select(F.col("doc_id").alias("capture_id"), "quality")
    scored = quality_mil.score_quality(payloads(table(spark, sf_dir, "documents")), labels)
    return scored.withColumnRenamed("capture_id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages"
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(payloads(table(spark, sf_dir, "documents"))).select(
        F.col("capture_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def vectors(embeddings: DataFrame) -> tuple[DataFrame, list[str]]:
    """Embeddings as feature records: a column per dimension, null where a vector is shorter or longer than others.

    The number of dimensions is that of the longest vector.
    """
    width = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{k}" for k in range(max(width, 0))]
    cells = [F.get("embedding", F.lit(k)).alias(name) for k, name in enumerate(names)]
    return embeddings.select(F.col("vec_id").alias("capture_id"), "label", *cells), names


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, names = vectors(table(spark, sf_dir, "embeddings"))
    return whitening.whiten_features(records, names, scale=1024, offset=100_000, components=8).select(
        F.col("capture_id").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, names = vectors(table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("capture_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    records = records.withColumn("label", noisy)
    return hard_negatives.mine_hard_negatives(records, F.col("capture_id") % 100 == 0, names, scale=256)


def tokenizer_file() -> str:
    """The definition of the public byte-level tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        return definition.read()


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = payloads(table(spark, sf_dir, "documents"))
    return chunk_bpe.encode_payloads(source, tokenizer_file(), decoded=True).select(
        F.col("capture_id").alias("doc_id"),
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("message_bytes", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Runner] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language_crf": op4_language_crf,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scores": op6_lm_scores,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_quality_mil": op9_quality_mil,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chunk_bpe": op13_chunk_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op3_jaccard_join": NEAR_DUPLICATES,
    "op6_lm_scores": LM_SCORES,
    "op7_mixing": MIX,
    "op12_hard_negatives": HARD_NEGATIVES,
}
