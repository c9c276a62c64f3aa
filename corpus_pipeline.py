"""From raw documents to token ids: five stages, each a table to a table.

A stage takes all documents that the one before it kept. Toxic documents and documents of low
quality go, one document of each near-duplicate group stays, sources are mixed to their
weights, and the mix is encoded. All stages but the last return the columns of ``documents``.

In every stage a document is a row: rows without an id, or with an id that occurs again, are
judged by themselves. Columns beyond those of ``documents`` are not carried. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import byte_bpe, jaccard_join, mixing, quality_rules
from tonelake.llm.queries import table, toxic_scores, vocabulary
from tonelake.session import pin

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: What a payload record carries along to be a document again.
CARRIED = ("message_utf8", "lang", "source", "n_chars")


def _payloads(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("capture_id"), F.col("text").alias("message_utf8"), *CARRIED[1:])


def _documents(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("capture_id").alias("doc_id"), F.col("message_utf8").alias("text"), *CARRIED[1:])


def _content(docs: DataFrame) -> DataFrame:
    """Documents with a hash of their columns: equal for repeated rows only."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("content"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go."""
    scored = toxic_scores(_payloads(docs), table(spark, sf_dir, "labels"), carried=CARRIED)
    return _documents(scored.where("p_toxic < 0.5"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that are more probably bad than good go."""
    return _documents(quality_rules.judge_payloads(_payloads(docs), carried=CARRIED).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of repeated rows, one."""
    keyed = _content(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    groups = jaccard_join.near_duplicates(keyed.select(key.alias("capture_id"), F.col("text").alias("message_utf8")))
    stay = (
        groups.where("capture_id = component_id")
        .select(F.col("capture_id.doc_id").alias("_id"), F.col("capture_id.content").alias("_content"))
        .distinct()
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "content"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix: a row for each pass that takes words of a document.

    ``text`` holds the words that the pass takes, with the white space before them, in their
    order; a document that a pass takes whole keeps its text up to the last word. Documents of
    which nothing is taken go. ``n_chars`` is the new length.
    """
    keyed = _content(docs)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("content").cast("string"))
    named = keyed.select(*COLUMNS, name.alias("capture_id"))
    captures = named.select("capture_id", F.col("source").alias("modulation"), F.col("text").alias("message_utf8"))
    spans = (
        mixing.plan_mix(captures)
        .spans()
        .groupBy("capture_id", "turn")
        .agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("spans"))
    )
    rows = named.groupBy("capture_id").agg(F.first(F.struct(*COLUMNS)).alias("record"), F.count("*").alias("copies"))
    words = F.regexp_extract_all(F.col("record.text"), F.lit(mixing.SPACED_WORD), F.lit(0))
    stream = F.flatten(F.array_repeat(words, F.col("copies").cast("int")))
    cut = F.transform(
        "spans", lambda s: F.array_join(F.slice(F.col("stream"), (s["from_word"] + 1).cast("int"), s["n_words"].cast("int")), "")
    )
    # One row in, one row out: the words are split once before they are cut.
    split = rows.select("capture_id", "record", F.explode(F.array(stream)).alias("stream"))
    taken = split.join(spans, "capture_id").select("record", F.array_join(cut, "").alias("taken"))
    return taken.select(
        "record.doc_id",
        F.col("taken").alias("text"),
        "record.lang",
        "record.source",
        F.length("taken").cast("long").alias("n_chars"),
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256)`` of every row."""
    ranks, pattern = vocabulary()
    payloads = docs.select(F.col("doc_id").alias("capture_id"), F.col("text").alias("message_utf8"))
    return byte_bpe.encode_payloads(payloads, ranks, pattern, decoded=True).select(
        F.col("capture_id").alias("doc_id"),
        "n_tokens",
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("message_bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The first stage is a trained classifier, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
