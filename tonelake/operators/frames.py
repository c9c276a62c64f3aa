"""De-interleaving, CRC-framed payload search and code screening of packed bit streams.

A stream is one row ``(capture_id, data)`` with at most one capture file of bits, which
the size rule of the readers bounds; work is spread over streams and needs no shuffle
until the per-capture verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tonelake.functions.bits import byte_values, scan_udf
from tonelake.functions.scalars import let
from tonelake.session import TEXT_ROWS, arrow_rows, pin

# Fixed values of the method.
ROWS = 8
COLS = 12
DEPTH = 8
SPACING = 1
SEED = 42
RANDOM_BLOCK = 256
INTERLEAVERS = ("none", "block", "convolutional", "diagonal", "pseudo-random", "pseudo-random-block")
SEARCH_MIN_BITS = 32
SEARCH_WINDOW = 32
CRC_SPACE = 65_536
FALSE_ALARM_TARGET = 0.01
SCREEN_TOP_K = 4
SCREEN_PLAUSIBLE = 0.10
VALIDATED_CONFIDENCE = 0.99

# Convolutional code family (name, constraint length, octal generators).
CODES = (
    ("K=7 r=1/2", 7, ("171", "133")),
    ("K=5 r=1/2", 5, ("23", "35")),
    ("K=6 r=1/2", 6, ("53", "75")),
    ("K=8 r=1/2", 8, ("247", "371")),
    ("K=9 r=1/2", 9, ("561", "753")),
    ("K=5 r=1/3", 5, ("25", "33", "37")),
    ("K=6 r=1/3", 6, ("51", "53", "75")),
    ("K=7 r=1/3", 7, ("171", "133", "165")),
    ("K=8 r=1/3", 8, ("247", "371", "225")),
    ("K=9 r=1/3", 9, ("557", "663", "711")),
)


def random_base(size: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).permutation(size)


def source_positions(name: str, n_bits: int) -> np.ndarray:
    """``out[p] = in[source[p]]`` over the zero-padded stream of ``n_bits`` bits."""
    unit = {"block": ROWS * COLS, "diagonal": ROWS * COLS, "convolutional": DEPTH, "pseudo-random-block": RANDOM_BLOCK}.get(name, 1)
    size = -(-n_bits // unit) * unit
    p = np.arange(size, dtype=np.int64)
    if name == "none":
        return p
    if name == "pseudo-random":
        source = np.empty(size, dtype=np.int64)
        source[random_base(size)] = p
        return source
    if name == "convolutional":
        branch = p % DEPTH
        return (p // DEPTH + branch * SPACING) % (size // DEPTH) * DEPTH + branch
    base, inner = p // unit * unit, p % unit
    if name == "block":
        return base + inner % COLS * ROWS + inner // COLS
    if name == "diagonal":
        row = inner // COLS
        return base + row * COLS + (inner % COLS + row) % COLS
    if name == "pseudo-random-block":
        return base + random_base(RANDOM_BLOCK)[(inner - p // unit) % RANDOM_BLOCK]
    raise ValueError(f"unknown interleaver {name!r}")


_UNIT_MAPS: dict[str, np.ndarray] = {}


def _unit_map(name: str) -> np.ndarray:
    """Source positions inside a unit; for the rotating map one row for each turn."""
    if name not in _UNIT_MAPS:
        if name == "pseudo-random-block":
            turns = source_positions(name, RANDOM_BLOCK * RANDOM_BLOCK).reshape(RANDOM_BLOCK, RANDOM_BLOCK)
            _UNIT_MAPS[name] = turns % RANDOM_BLOCK
        else:
            _UNIT_MAPS[name] = source_positions(name, ROWS * COLS)
    return _UNIT_MAPS[name]


#: By map: the words of a permuted unit that each value of each byte of the unit sets.
_LOOKUPS: dict[str, np.ndarray] = {}


def _lookup(name: str) -> np.ndarray:
    """(byte of the unit, its value, word): 64-bit words of the permuted unit, first bit highest."""
    if name not in _LOOKUPS:
        table = _unit_map(name)
        source = table if table.ndim == 1 else table[0]
        place = np.empty(source.size, np.int64)
        place[source] = np.arange(source.size)
        values = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
        out = np.zeros((source.size // 8, 256, -(-source.size // 64) * 64), np.uint8)
        for k in range(source.size // 8):
            out[k][:, place[8 * k : 8 * k + 8]] = values
        _LOOKUPS[name] = np.packbits(out, axis=2).view(">u8").astype(np.uint64)
    return _LOOKUPS[name]


def _rotated(words: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words, moved cyclically to the end by ``turns`` bits."""
    count = words.shape[1]
    far, near = turns // 64, (turns % 64).astype(np.uint64)[:, None]
    row, at = np.arange(len(words))[:, None], np.arange(count) - far[:, None]
    first, second = words[row, at % count], words[row, (at - 1) % count]
    return first >> near | np.where(near > 0, second << (np.uint64(64) - np.maximum(near, np.uint64(1))), np.uint64(0))


def _remapped_units(name: str, grid: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Packed units (rows of bytes) under a map that stays in a unit; ``turns`` are their numbers in their streams."""
    table = _lookup(name)
    words = table[0][grid[:, 0]]
    for k in range(1, grid.shape[1]):
        words |= table[k][grid[:, k]]
    if _unit_map(name).ndim > 1:  # the map of unit t is that of the first, t places on
        words = _rotated(words, turns % (8 * grid.shape[1]))
    return words.astype(">u8").view(np.uint8).reshape(len(grid), -1)[:, : grid.shape[1]]


def _remap_local(name: str, parts: list[bytes], turns: list[int]) -> list[bytes]:
    size = _unit_map(name).shape[-1] // 8
    units = np.array([-(-len(d) // size) for d in parts], np.int64)
    ends = np.cumsum(units)
    padded = b"".join(d + bytes(-len(d) % size) for d in parts)
    number = np.arange(int(ends[-1])) - np.repeat(ends - units - np.array(turns, np.int64), units)
    out = _remapped_units(name, np.frombuffer(padded, np.uint8).reshape(-1, size), number).tobytes()
    return [out[(e - u) * size : e * size] for e, u in zip(ends.tolist(), units.tolist())]


def rotated_bytes(parts: list[bytes]) -> list[bytes]:
    """Bit b of each byte from the byte b places on; a part ends in the ``DEPTH - 1`` bytes behind it, which go."""
    joined = np.frombuffer(b"".join(parts), np.uint8)
    moved = joined & np.uint8(0x80)
    for branch in range(1, DEPTH):
        far = branch * SPACING
        moved[: joined.size - far] |= joined[far:] & np.uint8(0x80 >> branch)
    out, at, found = moved.tobytes(), 0, []
    for d in parts:
        found.append(out[at : at + len(d) - (DEPTH - 1) * SPACING])
        at += len(d)
    return found


def _remap_random(data: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    place = np.arange(bits.size, dtype=np.int32)
    np.random.default_rng(SEED).shuffle(place)  # the draws of ``random_base``
    out = np.empty_like(bits)
    out[place] = bits
    return np.packbits(out).tobytes()


#: Bytes of streams that are mapped together.
_MAPPED = 1 << 20


def remap_many(name: str, streams: list[bytes], turns: list[int] | None = None) -> list[bytes]:
    """Packed streams under a hypothesis, short ones together; memory beyond some bytes a bit of them is not held.

    ``turns`` are the numbers of the streams' first units, for parts of longer streams and the maps
    that stay in a unit.
    """
    if name == "none":
        return list(streams)
    out: list[bytes] = list(streams)
    waiting, held = [], 0
    for k, d in enumerate(streams):
        if d:
            waiting.append(k)
            held += len(d)
        if waiting and (held >= _MAPPED or k + 1 == len(streams)):
            parts = [streams[w] for w in waiting]
            if name == "convolutional":  # a unit is a byte, and the stream is a ring
                reach = (DEPTH - 1) * SPACING
                done = rotated_bytes([d + (d * (-(-reach // len(d))))[:reach] if len(d) < reach else d + d[:reach] for d in parts])
            elif name == "pseudo-random":
                done = [_remap_random(d) for d in parts]
            else:
                done = _remap_local(name, parts, [0] * len(parts) if turns is None else [turns[w] for w in waiting])
            for w, d in zip(waiting, done, strict=True):
                out[w] = d
            waiting, held = [], 0
    return out


def remap_bytes(name: str, data: bytes) -> bytes:
    """A packed stream under a hypothesis."""
    return remap_many(name, [data])[0]


@pandas_udf(T.BinaryType())
def _remap(data: pd.Series, names: pd.Series) -> pd.Series:
    streams, chosen = data.tolist(), names.to_numpy()
    out: list = [None] * len(streams)
    for name in pd.unique(chosen):
        mine = np.flatnonzero(chosen == name).tolist()
        for k, d in zip(mine, remap_many(name, [streams[k] for k in mine]), strict=True):
            out[k] = d
    return pd.Series(out)


def deinterleave(streams: DataFrame, names: tuple[str, ...] = INTERLEAVERS) -> DataFrame:
    """Every stream under every hypothesis: adds ``interleaver`` and its ``priority``."""
    options = F.array(*[F.struct(F.lit(k).alias("priority"), F.lit(n).alias("interleaver")) for k, n in enumerate(names)])
    return (
        streams.select("capture_id", "data", F.explode(options).alias("h"))
        .select("capture_id", "h.interleaver", "h.priority", _remap("data", F.col("h.interleaver")).alias("data"))
    )


def deinterleave_custom(bits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Caller-supplied hypotheses as rows ``(interleaver, src_pos, dst_pos)``."""
    return bits.join(mapping, bits["pos"] == mapping["src_pos"]).select(
        "capture_id", "interleaver", F.col("dst_pos").alias("pos"), "bit"
    )


def crc_scan(streams: DataFrame, min_payload: int = 1, window: int | None = None) -> DataFrame:
    """Adds ``crc_pass``, ``payload`` and the number of CRC ``trials`` to every stream.

    Scanned and stored at once, so that few streams are in a batch, see ``arrow_rows``.
    """
    scanned = (
        streams.withColumn("scan", scan_udf(min_payload, window)("data"))
        .withColumn("crc_pass", F.col("scan.payload_len").isNotNull())
        .withColumn("payload", F.expr("substring(data, 1, scan.payload_len)"))
        .withColumn("trials", F.col("scan.trials"))
        .drop("scan", "data")
    )
    with arrow_rows(streams.sparkSession, TEXT_ROWS):
        return pin(scanned)


def search(streams: DataFrame, names: tuple[str, ...] = INTERLEAVERS, max_bits: int | None = None) -> DataFrame:
    """First interleaver hypothesis under which a CRC-framed payload is found.

    One row per capture with the attempts up to the hit; ``max_bits=None`` searches
    whole streams. Streams below 32 bits get no attempts.
    """
    limited = streams if max_bits is None else streams.withColumn("data", F.substring("data", 1, max_bits // 8))
    tried = crc_scan(
        deinterleave(limited.where(F.length("data") * 8 >= SEARCH_MIN_BITS), names), min_payload=1, window=SEARCH_WINDOW
    )
    hit = F.when(F.col("crc_pass"), F.col("priority"))
    verdict = tried.groupBy("capture_id").agg(
        F.min(hit).alias("hit"),
        F.min_by(F.struct("interleaver", "payload"), hit).alias("best"),
        F.collect_list(F.struct("priority", "interleaver", "crc_pass", "trials")).alias("all"),
    )
    made = F.filter("all", lambda a: F.col("hit").isNull() | (a["priority"] <= F.col("hit")))
    trials = F.aggregate("attempts", F.lit(0), lambda s, a: s + a["trials"])
    found = verdict.withColumn("attempts", F.sort_array(made)).select(
        "capture_id",
        F.col("hit").isNotNull().alias("validated"),
        F.when(F.col("hit").isNotNull(), F.col("best.interleaver")).alias("interleaver"),
        F.when(F.col("hit").isNotNull(), F.col("best.payload")).alias("payload"),
        F.size("attempts").alias("n_attempts"),
        trials.alias("crc_trials"),
        "attempts",
    )
    return (
        streams.select("capture_id")
        .join(found, "capture_id", "left")
        .select(
            "capture_id",
            F.coalesce("validated", F.lit(False)).alias("validated"),
            "interleaver",
            "payload",
            F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"),
            F.coalesce("crc_trials", F.lit(0)).alias("crc_trials"),
            "attempts",
        )
    )


def with_trial_account(searched: DataFrame) -> DataFrame:
    """How many chance passes that much searching would produce."""
    expected = F.col("crc_trials") / CRC_SPACE
    return searched.withColumn("expected_false_alarms", expected).withColumn(
        "false_alarm_risk_high", expected > FALSE_ALARM_TARGET
    )


def blind_scores(streams: DataFrame) -> DataFrame:
    """Capped heuristic scores of code and interleaver families; never a detection."""
    values = byte_values(F.col("data"))

    def flips(v):
        # Transitions inside one byte: adjacent bits differ.
        return F.bit_count(v.bitwiseXOR(F.shiftright(v, 1)).bitwiseAND(F.lit(0x7F)))

    def pairs(v):
        later = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        earlier = F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))
        return F.zip_with(later, earlier, lambda b, a: F.shiftright(b, 7).bitwiseXOR(a.bitwiseAND(F.lit(1))))

    def count(v):
        inside = F.aggregate(v, F.lit(0), lambda s, x: s + flips(x))
        borders = F.aggregate(pairs(v), F.lit(0), lambda s, x: s + x)
        return F.struct((F.size(v) * 8).alias("n_bits"), (inside + borders).alias("transitions"))

    counted = streams.select("capture_id", let(values, count).alias("c")).select("capture_id", "c.*")
    drift = F.when(F.col("n_bits") < 16, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(0.5), 0.35 - F.col("transitions") / F.col("n_bits") * 0.2))
    )
    rs = F.when(F.col("n_bits") % 8 == 0, F.lit(0.25)).otherwise(F.lit(0.15))
    families = [("Convolutional r=1/2 K=7", drift), ("RS(255,223)", rs), ("LDPC", F.lit(0.10)), ("Concatenated", F.lit(0.12))]
    ranked = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("turn"), F.lit(n).alias("name")) for k, (n, s) in enumerate(families)])
    best = F.array_max(ranked)
    return counted.where(F.col("n_bits") > 0).select(
        "capture_id",
        "n_bits",
        "transitions",
        best["name"].alias("code_candidate"),
        best["score"].alias("code_confidence"),
        F.lit("Block").alias("interleaver_candidate"),
        F.lit(0.28).alias("interleaver_confidence"),
    )


# -- convolutional code screen -------------------------------------------------


def _delays(octal: str, length: int) -> list[int]:
    mask = int(octal, 8)
    return [d for d in range(length) if mask >> (length - 1 - d) & 1]


def code_relations(length: int, generators: tuple[str, ...]) -> list[list[tuple[int, int]]]:
    """Parity relations of the dual code as (output column, delay) taps."""
    polys = [_delays(g, length) for g in generators]
    if len(polys) == 2:
        pairs = [((0, polys[1]), (1, polys[0]))]
    else:
        pairs = [((0, polys[1]), (1, polys[0])), ((0, polys[2]), (2, polys[0]))]
    return [[(column, d) for column, taps in pair for d in taps] for pair in pairs]


#: Bits whose syndromes are counted together.
_TOGETHER = 1 << 22


def _word_bits(words: np.ndarray, delay: int) -> np.ndarray:
    """64-bit words, first bit highest, of a sequence moved ``delay`` (below 64) places to its end."""
    if not delay:
        return words
    moved = words >> np.uint64(delay)
    moved[1:] |= words[:-1] << np.uint64(64 - delay)
    return moved


def syndromes(streams: list[np.ndarray]) -> np.ndarray:
    """(stream, code, 2): positions tested and syndrome weight of every code for unpacked streams.

    The columns of all streams lie in one row of 64-bit words, every stream from a new word on, so that
    a tap is a shift of words; what reaches over a stream's ends is masked.
    """
    out = np.zeros((len(streams), len(CODES), 2), np.int64)
    for rate in sorted({len(g) for _, _, g in CODES}):
        groups = np.array([b.size // rate for b in streams], np.int64)
        sizes = -(-groups // 64)
        first = np.cumsum(sizes) - sizes
        grid = np.zeros((rate, int(sizes.sum()) * 64), np.uint8)
        for b, n, at in zip(streams, groups.tolist(), (first * 64).tolist()):
            grid[:, at : at + n] = b[: n * rate].reshape(n, rate).T
        columns = [np.packbits(c).view(">u8").astype(np.uint64) for c in grid]
        inside = np.zeros(grid.shape[1], np.uint8)
        for n, at in zip(groups.tolist(), (first * 64).tolist()):
            inside[at : at + n] = 1
        known = np.packbits(inside).view(">u8").astype(np.uint64)
        moved = {(c, d): _word_bits(columns[c], d) for c in range(rate) for d in range(max(k for _, k, _ in CODES))}
        some = np.flatnonzero(sizes)
        heads = first[some]
        for turn, (_, length, generators) in enumerate(CODES):
            if len(generators) != rate:
                continue
            mask = known.copy()
            mask[heads] &= np.uint64((1 << (64 - (length - 1))) - 1)
            for relation in code_relations(length, generators):
                parity = mask.copy()
                taps = [moved[tap] for tap in relation]
                parity &= np.bitwise_xor.reduce(taps)
                if heads.size:
                    out[some, turn, 1] += np.add.reduceat(np.bitwise_count(parity).astype(np.int64), heads)
                out[:, turn, 0] += np.maximum(groups - (length - 1), 0)
            out[groups < 4, turn] = 0
    return out


def _screen_udf(names: tuple[str, ...]):
    """UDF: positions and weight under every hypothesis and, in it, every code; none for empty streams."""

    @pandas_udf(T.ArrayType(T.LongType()))
    def screen(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in parts:
            bufs = data.tolist()
            out = np.zeros((len(bufs), len(names), len(CODES), 2), np.int64)
            for priority, name in enumerate(names):
                waiting, held = [], 0
                for k, buf in enumerate(bufs):
                    if buf:
                        waiting.append(k)
                        held += 8 * len(buf)
                    if waiting and (held >= _TOGETHER or k + 1 == len(bufs)):
                        mapped = remap_many(name, [bufs[w] for w in waiting])
                        out[waiting, priority] = syndromes([np.unpackbits(np.frombuffer(d, np.uint8)) for d in mapped])
                        waiting, held = [], 0
            yield pd.Series([row.reshape(-1) if buf else [] for buf, row in zip(bufs, out)])

    return screen


def code_screen(streams: DataFrame, names: tuple[str, ...] = INTERLEAVERS, top_k: int | None = SCREEN_TOP_K) -> DataFrame:
    """Rank (interleaver, code) pairs by the syndrome weight of the dual code.

    ``top_k`` bounds the report per capture; ``None`` keeps every pair. A stream is ranked in its row;
    what remains of the streams of a capture is put together.
    """
    def score(counts: Column, at: Column) -> Column:
        tested, weight = F.get(counts, 2 * at), F.get(counts, 2 * at + 1)
        syndrome = F.round(F.when(tested > 0, weight / tested).otherwise(F.lit(1.0)), 6)
        return F.struct(syndrome.alias("syndrome"), at.alias("at"), tested.alias("n_positions"))

    # ``at`` counts the codes of the first hypothesis, then those of the next.
    places = F.sequence(F.lit(0), F.lit(len(names) * len(CODES) - 1))
    counted = streams.where(F.length("data") > 0).select("capture_id", _screen_udf(names)("data").alias("counts"))
    ranked = F.sort_array(F.transform(places, lambda at: score(F.col("counts"), at)))
    best = ranked if top_k is None else F.slice(ranked, 1, top_k)
    both = counted.select("capture_id", best.alias("best")).groupBy("capture_id").agg(
        F.sort_array(F.flatten(F.collect_list("best"))).alias("all")
    )
    kept = F.col("all") if top_k is None else F.slice("all", 1, top_k)
    interleavers, codes = (F.array(*[F.lit(n) for n in found]) for found in (names, [n for n, _, _ in CODES]))
    priority, turn = F.floor(F.col("s.at") / len(CODES)).cast("int"), F.col("s.at") % len(CODES)
    return both.select("capture_id", F.posexplode(kept).alias("place", "s")).select(
        "capture_id", (F.col("place") + 1).alias("rank"), F.get(interleavers, priority).alias("interleaver"),
        F.get(codes, turn).alias("code"), "s.n_positions", "s.syndrome",
        (F.col("s.syndrome") <= SCREEN_PLAUSIBLE).alias("plausible"),
    )
