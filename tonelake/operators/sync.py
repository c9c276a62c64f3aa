"""Sync words: sliding correlation with a controlled false-alarm rate.

The search reads packed frames ``(capture_id, start, n_bits, data)``; each frame gives one
row per word, so only verdicts are shuffled. Frames from ``functions.bits.pack_frames``
carry a halo and make captures of any length searchable in parallel.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tonelake.functions.bits import pack_frames
from tonelake.operators import symbols
from tonelake.session import TEXT_ROWS, arrow_rows, pin

# Fixed values of the method.
FALSE_ALARM_TARGET = 0.01
SCORE_THRESHOLD = 0.85
DISCOVERY_WORDS = ("0x1ACFFC1D", "0x55555555", "0xAAAAAAAA", "0x7E7E7E7E")
FALLBACK_SCHEMES = ("BPSK", "QPSK", "16-QAM", "8PSK", "64-QAM", "2-FSK", "4-FSK")
ANALOG_LABELS = ("AM", "FM", "TONE", "AUDIO")
CORROBORATED_CONFIDENCE = 0.8

FRAME_BITS = 1 << 20
#: Bit positions that a word is compared with at a time; a multiple of 8.
SLICE_BITS = 1 << 18

_HITS = T.ArrayType(
    T.StructType([T.StructField("word", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("matches", T.IntegerType())])
)


def parse_word(text: str) -> list[int] | None:
    """Bits of a hex word, or None where it is not hex."""
    digits = text.lower().strip().removeprefix("0x")
    try:
        value = int(digits, 16)
    except ValueError:
        return None
    width = 4 * len(digits)
    return [value >> (width - 1 - k) & 1 for k in range(width)]


def _windows(buf: bytes) -> np.ndarray:
    """The 32 bits that start at every bit position, zeros beyond the end."""
    octets = np.zeros(len(buf) + 4, dtype=np.uint64)
    octets[: len(buf)] = np.frombuffer(buf, dtype=np.uint8)
    n = len(buf)
    wide = np.zeros(n, dtype=np.uint64)
    for k in range(5):
        wide = (wide << np.uint64(8)) | octets[k : k + n]
    shifts = np.arange(8, 0, -1, dtype=np.uint64)
    return ((wide[:, None] >> shifts[None, :]) & np.uint64(0xFFFFFFFF)).astype(np.uint32).ravel()


def scan_udf(words: list[list[int]]):
    """UDF over (data, n_bits): best offset and match count of every word."""
    parts = []
    for bits in words:
        pieces = []
        for at in range(0, len(bits), 32):
            piece = bits[at : at + 32]
            value = reduce(lambda a, b: a * 2 + b, piece, 0) << (32 - len(piece))
            mask = ((1 << len(piece)) - 1) << (32 - len(piece))
            pieces.append((at, np.uint32(value), np.uint32(mask)))
        parts.append((len(bits), pieces))

    @pandas_udf(_HITS)
    def scan(data: pd.Series, n_bits: pd.Series) -> pd.Series:
        out = []
        for buf, n in zip(data, n_bits):
            rows = []
            for index, (length, pieces) in enumerate(parts):
                places = int(n) - length + 1
                best: tuple[int, int] | None = None  # bits missed, offset: the first of the best
                for start in range(0, max(places, 0), SLICE_BITS):
                    here = min(SLICE_BITS, places - start)
                    windows = _windows(buf[start // 8 : (start + here + length + 7) // 8])
                    missed = np.zeros(here, dtype=np.uint16)
                    for at, value, mask in pieces:
                        missed += np.bitwise_count((windows[at : at + here] ^ value) & mask)
                    k = int(np.argmin(missed))
                    if best is None or missed[k] < best[0]:
                        best = int(missed[k]), start + k
                if best is not None:
                    rows.append({"word": index, "offset": best[1], "matches": length - best[0]})
            out.append(rows)
        return pd.Series(out)

    return scan


def whole_frames(payloads: DataFrame) -> DataFrame:
    """Payload rows as single frames (their size is bounded by the readers)."""
    return payloads.select(
        "capture_id", F.lit(0).cast("long").alias("start"), (F.length("data") * 8).alias("n_bits"), "data"
    )


def tails(length: int) -> list[float]:
    """P(at least k of ``length`` fair bits match) for k = 1..length."""
    total = 1 << length
    upper = 0
    out = []
    for k in range(length, 0, -1):
        upper += comb(length, k)
        out.append(upper / total)
    return out[::-1]


def min_matches(length: int, positions: Column, target: float = FALSE_ALARM_TARGET) -> Column:
    """Smallest match count whose expected chance hits stay within ``target``."""
    over = F.filter(F.array(*[F.lit(t) for t in tails(length)]), lambda t: t * positions > target)
    return F.when(positions <= 0, F.lit(length)).otherwise(F.least(F.size(over) + 1, F.lit(length)))


def correlate(frames: DataFrame, words: list[str], threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """One row per capture and word: best offset, score, and whether it counts as a header."""
    parsed = [parse_word(w) for w in words]
    usable = [(k, bits) for k, bits in enumerate(parsed) if bits]
    found = frames.select("capture_id", "start", scan_udf([bits for _, bits in usable])("data", F.col("n_bits").cast("int")).alias("hits"))
    with arrow_rows(frames.sparkSession, TEXT_ROWS):  # stored at once, so that few frames are in a batch
        found = pin(found)
    hits = (
        found.select("capture_id", "start", F.explode("hits").alias("h"))
        .select("capture_id", F.col("h.word").alias("w"), (F.col("start") + F.col("h.offset")).alias("offset"), "h.matches")
        .groupBy("capture_id", "w")
        .agg(F.max(F.struct("matches", (-F.col("offset")).alias("back"))).alias("top"))
    )
    sizes = frames.groupBy("capture_id").agg(F.max(F.col("start") + F.col("n_bits")).alias("n_bits"))
    entries = []
    for turn, (text, bits) in enumerate(zip(words, parsed)):
        entries.append(
            F.struct(
                F.lit(turn).alias("turn"),
                F.lit(text.strip()).alias("sync_word"),
                F.lit(len(bits) if bits else None).cast("int").alias("length"),
                F.lit([k for k, _ in usable].index(turn) if bits else None).cast("int").alias("w"),
                (
                    min_matches(len(bits), F.greatest(F.col("n_bits") - len(bits) + 1, F.lit(0)))
                    if bits
                    else F.lit(None).cast("int")
                ).alias("min_matches"),
            )
        )
    wanted = sizes.select("capture_id", "n_bits", F.explode(F.array(*entries)).alias("e")).select(
        "capture_id", "n_bits", "e.*"
    )
    joined = wanted.join(hits, ["capture_id", "w"], "left")
    score = F.coalesce(F.col("top.matches") / F.col("length"), F.lit(0.0))
    floor = F.col("min_matches") / F.col("length")
    error = F.when(F.col("length").isNull(), F.lit("unparseable hex sync word")).when(
        F.col("n_bits") < F.col("length"), F.lit("bit stream shorter than sync word")
    )
    return joined.select(
        "capture_id",
        "turn",
        "sync_word",
        F.col("length").alias("sync_length"),
        F.coalesce(-F.col("top.back"), F.lit(-1)).cast("long").alias("offset"),
        score.alias("score"),
        "min_matches",
        floor.alias("min_score"),
        F.greatest(F.col("n_bits") - F.col("length") + 1, F.lit(0)).cast("long").alias("positions"),
        F.coalesce(error.isNull() & (score >= F.greatest(F.lit(threshold), floor)), F.lit(False)).alias("detected"),
        error.alias("error"),
    )


def find_header(frames: DataFrame, word: str, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    return correlate(frames, [word], threshold).drop("turn", "error")


def discover(frames: DataFrame, words: tuple[str, ...] = DISCOVERY_WORDS, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """The word with the widest margin over chance; the closest miss where none is detected."""
    tried = correlate(frames, list(words), threshold).withColumn("margin", F.col("score") - F.col("min_score"))
    order = Window.partitionBy("capture_id").orderBy(
        F.col("detected").desc(),
        F.col("error").isNotNull(),
        F.col("margin").desc(),
        F.when(F.col("detected"), F.col("score")).desc_nulls_last(),
        F.when(F.col("detected"), F.col("sync_length")).desc_nulls_last(),
        "turn",
    )
    lists = tried.groupBy("capture_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", "sync_word", "score", "min_score", "detected", "error"))
        ).alias("tried")
    )
    best = tried.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
    failed = F.col("error").isNotNull()
    return best.join(lists, "capture_id").select(
        "capture_id",
        F.when(F.col("detected"), F.col("sync_word")).alias("sync_word"),
        "detected",
        F.when(failed, F.lit(-1)).otherwise(F.col("offset")).alias("offset"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("min_score")).alias("min_score"),
        F.when(failed, F.lit(0)).otherwise(F.col("min_matches")).alias("min_matches"),
        F.when(failed, F.lit(0)).otherwise(F.col("positions")).alias("positions"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("margin")).alias("margin"),
        "tried",
    )


def _halo(word: str) -> int:
    return -(-len(parse_word(word)) // 8) * 8


def corroborate(candidate_bits: DataFrame, labels: DataFrame, word: str, frame_bits: int = FRAME_BITS) -> DataFrame:
    """First other scheme, in cost order, whose bits show the header.

    ``candidate_bits`` is (capture_id, scheme, pos, bit); ``labels`` is (capture_id,
    scheme, estimated). Only estimated, non-analog labels without a detected header but
    with a positive score are revised.
    """
    keyed = candidate_bits.select(F.struct("capture_id", "scheme").alias("capture_id"), "pos", "bit")
    frames = pin(pack_frames(keyed, frame_bits, _halo(word)))
    found = find_header(frames, word).select(
        F.col("capture_id.capture_id").alias("capture_id"),
        F.col("capture_id.scheme").alias("candidate"),
        "detected",
        "score",
        "offset",
    )
    return revised(pin(found), labels)


def revised(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """The revision that header verdicts ``(capture_id, candidate, detected, score, offset)`` call for."""
    places = F.array(*[F.lit(s) for s in FALLBACK_SCHEMES])
    own = labels.join(
        heads.withColumnRenamed("candidate", "scheme").select(
            "capture_id", "scheme", F.col("detected").alias("own_detected"), F.col("score").alias("own_score")
        ),
        ["capture_id", "scheme"],
        "left",
    )
    open_case = (
        F.col("estimated")
        & ~F.coalesce(F.col("own_detected"), F.lit(False))
        & (F.coalesce(F.col("own_score"), F.lit(0.0)) > 0)
        & ~F.col("scheme").isin(*ANALOG_LABELS)
    )
    rival = (
        heads.where("detected")
        .join(labels, "capture_id")
        .where(F.col("candidate") != F.col("scheme"))
        .groupBy("capture_id")
        .agg(F.min_by(F.struct("candidate", "score", "offset"), F.array_position(places, F.col("candidate"))).alias("r"))
    )
    return own.join(rival, "capture_id", "left").select(
        "capture_id",
        F.when(open_case & F.col("r").isNotNull(), F.col("r.candidate")).otherwise(F.col("scheme")).alias("scheme"),
        F.when(open_case & F.col("r").isNotNull(), F.col("scheme")).alias("revised_from"),
        F.when(open_case & F.col("r").isNotNull(), F.col("r.offset")).alias("offset"),
        F.when(open_case & F.col("r").isNotNull(), F.col("r.score")).alias("score"),
        F.when(open_case & F.col("r").isNotNull(), F.lit(CORROBORATED_CONFIDENCE)).alias("confidence"),
    )


def resolve_rotation(samples: DataFrame, scheme: str, word: str, frame_bits: int = FRAME_BITS) -> DataFrame:
    """The symmetry rotation whose bits match the sync word best; the smallest on ties."""
    keyed = symbols.rotation_bits(samples, scheme).select(
        F.struct("capture_id", "rotation").alias("capture_id"), "pos", "bit"
    )
    heads = find_header(pack_frames(keyed, frame_bits, _halo(word)), word)
    best = heads.groupBy(F.col("capture_id.capture_id").alias("id")).agg(
        F.max_by(
            F.struct(F.col("capture_id.rotation").alias("rotation"), "score", "offset", "detected"),
            F.struct("score", -F.col("capture_id.rotation")),
        ).alias("b")
    )
    return best.select(F.col("id").alias("capture_id"), "b.rotation", "b.score", "b.offset", "b.detected")
