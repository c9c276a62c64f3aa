"""Language-model scores of payload texts by stupid backoff over n-gram counts of all texts.

The score of a word is the relative frequency of it after its context if that n-gram occurs
often enough, else ``BACKOFF`` times its own share of all words. The tables of counts are
partitioned by the hash of the n-gram, and the n-grams of the texts are joined to them there.

N-grams travel packed: texts are dealt into chunks, and a row holds the distinct n-grams of a
chunk that fall in one bucket of the hash, with their counts. A bucket adds the rows up and
answers each with the totals of its n-grams; a chunk joins the answers to its texts and sums
per text. A frequent n-gram is one entry per chunk, so no bucket is hot; rows stay bounded
because the numbers of chunks and of buckets grow with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.records import extended
from tonelake.llm.shingles import Shingler
from tonelake.session import pin

BACKOFF = 0.4
#: An n-gram of two words counts only if it occurs so often in all texts.
LEAST = 2
#: Texts of a chunk on average, and chunks for each bucket of the hash.
CHUNK_ROWS = 2048
CHUNKS_PER_BUCKET = 2


def _grams(shingler: Shingler, texts: list[str | None], buckets: int):
    """Word and pair hashes per text, and the distinct ones of the chunk ordered by bucket and value.

    Words and pairs are told apart by the lowest bit.
    """
    pairs = shingler.sequences(texts, (1, 2))
    one, two = np.uint64(1), ~np.uint64(1)
    rows = [(w & two, p | one) for w, p in pairs]
    flat = np.concatenate([x for row in rows for x in row]) if rows else np.zeros(0, np.uint64)
    values, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the value
    return rows, values, place, counts, bucket


def score_payloads(payloads: DataFrame) -> DataFrame:
    """``payloads(capture_id, message_utf8)`` -> ``(capture_id, n_words long, n_backed long, score double)``.

    ``score`` is the mean natural logarithm of the scores of the words, ``n_backed`` the number
    of words scored by their own share (the first word always is). Words are the runs between
    ASCII white space with A-Z in lower case. Counts are over all words of all rows, so a
    repeated row counts again.

    Every input row gives one row, repeated rows included; equal texts get equal scores. A
    null, empty or blank text has no words and a null score. A null ``capture_id`` stays null.
    An empty table gives an empty table. Texts of any length are read whole.
    """
    rows = payloads.count()
    chunks = 1 + rows // CHUNK_ROWS
    buckets = max(8, chunks // CHUNKS_PER_BUCKET)
    source = payloads.select(
        "capture_id", "message_utf8", F.pmod(F.xxhash64("capture_id", "message_utf8"), F.lit(chunks)).alias("chunk")
    )

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, values, _, counts, bucket = _grams(Shingler(), table.column("message_utf8").to_pylist(), buckets)
        found, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(values))
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        return pa.table(
            {
                "bucket": pa.array(found, pa.int64()),
                "chunk": pa.array([key[0].as_py()] * len(found), pa.int64()),
                "grams": pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()),
                "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
            }
        )

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        values, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(place, weights=counts, minlength=len(values)).astype(np.int64)[place]
        ends = np.cumsum([len(g) for g in grams])
        answers = [totals[e - len(g) : e].tobytes() for g, e in zip(grams, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "totals": pa.array(answers, pa.binary())})

    def score(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("message_utf8").to_pylist()
        rows, values, place, _, _ = _grams(Shingler(), texts, buckets)
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([np.frombuffer(x, np.int64) for _, x in parts]) if parts else np.zeros(0, np.int64)
        logs, at = np.log(np.maximum(totals, 1).astype(float)), 0
        sums, backs = [], []
        for words, pairs in rows:
            w = place[at : at + len(words)]
            p = place[at + len(words) : at + len(words) + len(pairs)]
            at += len(words) + len(pairs)
            known = np.append(False, totals[p] >= LEAST)[: len(words)]
            value = logs[w] + np.log(BACKOFF)
            value[:1] -= np.log(BACKOFF)  # the first word has no context to back off from
            value[1:] = np.where(known[1:], logs[p] - logs[w[:-1]], value[1:])
            sums.append(float(value.sum()))
            backs.append(int((~known).sum()))
        columns = {
            "capture_id": table.column("capture_id"),
            "n_words": pa.array([len(w) for w, _ in rows], pa.int64()),
            "n_backed": pa.array(backs, pa.int64()),
            "log_sum": pa.array(sums, pa.float64()),
        }
        return pa.table(columns)

    by_chunk = source.groupBy("chunk")
    counted = by_chunk.applyInArrow(count, "bucket long, chunk long, grams binary, counts binary")
    answered = counted.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, totals binary")
    scored = pin(
        by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(
            score, extended(source, ["capture_id"], "n_words long, n_backed long, log_sum double")
        )
    )
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    share = F.col("log_sum") - F.col("n_backed") * F.log(F.lit(float(max(1, words))))
    return scored.select("capture_id", "n_words", "n_backed", F.when(F.col("n_words") > 0, share / F.col("n_words")).alias("score"))
