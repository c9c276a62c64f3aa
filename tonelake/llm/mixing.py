"""Mix captures of several modulations to target weights, in blocks of words.

The messages of a modulation, one after the other in a pseudorandom order, form one long
stream of words that is cut into blocks of fixed length. A mix is a number of slots per
modulation that meets its target. Slots fall on output shards at random, so the counts per
shard are a multinomial draw, taken under the condition that the totals are met. Slot j of a
modulation with n blocks reads block ``p(j mod n)``, p being a permutation that is drawn
anew for each pass over the blocks. Blocks and slots are joined by modulation and index: no
modulation is gathered in one place, however large it is. All steps are DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.session import pin

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it; joined again they give the text up to its last word.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

BLOCK_WORDS = 64
#: Captures of a modulation whose places are counted in one task.
BUCKET_ROWS = 2048
#: Slots made from one row.
SLOT_RUN = 1 << 16
#: Slots of an output shard, on average.
SHARD_SLOTS = 1 << 16
#: Primes that serve as multipliers of the permutations.
PRIMES = (8388593, 8388587, 8388581, 8388571, 8388547, 8388539, 8388473, 8388461)


def digest(text: Column) -> Column:
    """A 60-bit whole number from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _name(modulation: Column) -> Column:
    return F.when(modulation.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), modulation))


@dataclass(frozen=True)
class Mix:
    """``captures``: one row per capture with its size, stream place and target; ``draws``: one row per slot."""

    captures: DataFrame
    draws: DataFrame
    block_words: int

    def spans(self) -> DataFrame:
        """``(shard, slot, turn, modulation, block, capture_id, from_word, n_words)``: the words of every slot.

        ``turn`` numbers the passes over the blocks of the modulation from 0.
        """
        width = self.block_words
        first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
        begin = F.greatest(F.col("start"), F.col("block") * width)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width)
        pieces = (
            self.captures.where("size > 0")
            .select("source_no", "capture_id", "modulation", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
            .select(
                "source_no", "block", "capture_id", "modulation",
                (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"),
            )
        )
        # Both sides grow with the captures, though the plan takes slots for as small as the runs they come from.
        return self.draws.hint("merge").join(pieces, ["source_no", "block"]).select(
            "shard", "slot", "turn", "modulation", "block", "capture_id", "from_word", "n_words"
        )

    def taken(self) -> DataFrame:
        """``(capture_id, modulation, size, source_size, target, taken)``: one row per capture."""
        sums = self.spans().groupBy("capture_id", "modulation").agg(F.sum("n_words").alias("taken"))
        sums = sums.select(F.col("capture_id").alias("_id"), F.col("modulation").alias("_mod"), "taken")
        same = F.col("capture_id").eqNullSafe(F.col("_id")) & F.col("modulation").eqNullSafe(F.col("_mod"))
        return self.captures.join(sums, same, "left").select(
            "capture_id", "modulation", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        )


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sizes(modulation, source_size)`` -> the same with ``source_no, weight, target``.

    Modulations in code point order, null last, take the weights in turn and share the total
    size by weight. A target stops at ``cap`` times its modulation's size and what is above is
    shared again, so every target is ``least(cap * size, level * weight)`` for one level. The
    table has one row per modulation, so its windows are small.
    """
    by_name = Window.orderBy(F.col("modulation").asc_nulls_last())
    weighed = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(F.array(*[F.lit(w).cast("double") for w in weights]), F.col("source_no") % len(weights))
    )
    limit = F.col("source_size").cast("double") * cap
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    filled = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double")
    levelled = weighed.withColumn("limit", limit).withColumn("level", (whole - filled) / rest)
    reached = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    return levelled.withColumn(
        "level", F.min_by(reached, F.when(reached.isNotNull(), F.struct(F.col("limit") / F.col("weight"), "source_no"))).over(
            Window.partitionBy(F.lit(1))
        )
    ).select(
        "modulation", "source_size", "source_no", "weight",
        F.least("limit", F.col("level") * F.col("weight")).alias("target"),
    )


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``start``: the place of a capture's first word in the stream of its modulation.

    Places are running sums in two steps, within buckets of the pseudorandom order and over
    buckets, so that a large modulation is never sorted in one task.
    """
    rows = sizes.count()
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    mixed = sizes.withColumn("order", digest(F.coalesce(F.col("capture_id").cast("string"), F.lit("none"))))
    # The table of modulations is as small as their number; Spark picks the join.
    mixed = (
        mixed.withColumn("name", _name(F.col("modulation")))
        .join(sources.withColumn("name", _name(F.col("modulation"))).drop("modulation"), "name")
        .withColumn("bucket", F.shiftright("order", 60 - bits))
    )
    sums = mixed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    over_buckets = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "source_no", "bucket", F.coalesce(F.sum("bucket_size").over(over_buckets), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source_no", "bucket").orderBy("order", "capture_id").rowsBetween(Window.unboundedPreceding, -1)
    return mixed.join(offsets, ["source_no", "bucket"]).withColumn(
        "start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )


def plan_mix(
    captures: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
) -> Mix:
    """Plan the mix of ``captures(capture_id, modulation, message_utf8)``.

    The number of slots of a modulation is its target in average blocks, rounded, so at most
    ``cap`` times its blocks: no capture is taken more than ``cap`` times. Runs with the same
    seed agree.

    Rows with equal ``capture_id`` and ``modulation`` count as one capture whose words follow
    one another. A null modulation is a modulation of its own, the last; a null ``capture_id``
    is an id of its own. A null or blank message has no words and nothing is taken from it. An
    empty table gives empty tables. Ties in the pseudorandom order go by ``capture_id``.
    """
    words = F.coalesce(F.regexp_count("message_utf8", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = pin(
        captures.select("capture_id", "modulation", words.alias("size"))
        .groupBy("capture_id", "modulation")
        .agg(F.sum("size").alias("size"))
    )
    per_source = sizes.groupBy("modulation").agg(F.sum("size").alias("source_size"))
    sources = targets(per_source, weights, cap).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    sources = pin(
        sources.withColumn(
            "slots",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5))
            .otherwise(0)
            .cast("long"),
        )
    )
    placed = pin(
        _placed(sizes, sources).select(
            "capture_id", "modulation", "size", "source_size", "target", "source_no", "start"
        )
    )
    return Mix(placed, _draws(sources, seed), block_words)


def _draws(sources: DataFrame, seed: int) -> DataFrame:
    """(shard, source_no, slot, turn, block): every slot, the shard it falls on and the block it reads."""
    shards = F.greatest(F.lit(1), F.ceil(F.col("all_slots") / SHARD_SLOTS))
    all_slots = sources.agg(F.sum("slots")).first()[0] or 0
    runs = (
        sources.where("slots > 0")
        .select(
            "*",
            F.lit(all_slots).alias("all_slots"),
            F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / SLOT_RUN))).alias("run"),
        )
        .repartition(1 + all_slots // SLOT_RUN, "source_no", "run")  # a run makes SLOT_RUN rows: one or two to a task
    )
    last = F.least((F.col("run") + 1) * SLOT_RUN, F.col("slots")) - 1
    slots = runs.select(
        "source_no", "n_blocks", shards.alias("shards"), _name(F.col("modulation")).alias("name"),
        F.explode(F.sequence(F.col("run") * SLOT_RUN, last)).alias("slot"),
    ).withColumn("turn", F.floor(F.col("slot") / F.col("n_blocks")))
    key = digest(F.concat_ws("|", F.lit(str(seed)), "name", F.col("turn").cast("string")))
    place = digest(F.concat_ws("|", F.lit(str(seed)), "name", F.lit("slot"), F.col("slot").cast("string")))
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    fitting = F.filter(primes, lambda p: F.col("n_blocks") % p != 0)
    return (
        slots.withColumn("key", key)
        .withColumn("factor", F.get(fitting, (F.col("key") % F.size(fitting)).cast("int")))
        .select(
            F.pmod(place, F.col("shards")).alias("shard"),
            "source_no",
            "slot",
            "turn",
            # factor < 2 ** 23 and slot - turn * n_blocks < 2 ** 40, so the product stays below 2 ** 63.
            (
                (F.col("factor") * (F.col("slot") - F.col("turn") * F.col("n_blocks")) + F.col("key") % F.col("n_blocks"))
                % F.col("n_blocks")
            ).alias("block"),
        )
    )
