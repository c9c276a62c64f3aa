"""The given tables seen as captures, samples, bits, payloads and reports.

The SQL twins of these views are in ``tonelake.plans.statements``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.scalars import let
from tonelake.session import pin, spread
from tonelake.sources.series import number_rows, to_blocks, to_samples

#: Block lengths of the views. Small, so that the test data exercises block borders.
EVENT_BLOCK = 1024
VECTOR_SAMPLES = 32
TONE_SYMBOL = 8

_PINNED: dict[tuple[str, str, str], DataFrame] = {}


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, build) -> DataFrame:
        """Ingest a block table once per session, as a stored table would be."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PINNED:
            _PINNED[key] = spread(pin(build()))
        return _PINNED[key]

    # -- I/Q captures from embedding vectors ---------------------------------

    def _vector_arrays(self):
        ks = F.sequence(F.lit(0), F.lit(VECTOR_SAMPLES - 1))
        vec = F.col("embedding")
        return (
            F.transform(ks, lambda k: F.get(vec, 2 * k).cast("double")),
            F.transform(ks, lambda k: F.get(vec, 2 * k + 1).cast("double")),
        )

    def vector_blocks(self) -> DataFrame:
        """One short capture per vector: 32 samples in one block."""
        i, q = self._vector_arrays()
        return spread(self.table("embeddings").select("vec_id", "embedding")).select(
            F.col("vec_id").alias("capture_id"),
            F.lit(0).cast("long").alias("block_no"),
            F.lit(0).cast("long").alias("start_n"),
            i.alias("i"),
            q.alias("q"),
        )

    def vector_samples(self) -> DataFrame:
        return to_samples(self.vector_blocks())

    def label_blocks(self) -> DataFrame:
        """One capture per label: the vectors of a label one after the other."""

        def build() -> DataFrame:
            numbered = number_rows(
                self.table("embeddings").select("label", "vec_id", "embedding"), "label", ["vec_id"], "block_no"
            )
            i, q = self._vector_arrays()
            return numbered.select(
                F.col("label").cast("long").alias("capture_id"),
                "block_no",
                (F.col("block_no") * VECTOR_SAMPLES).alias("start_n"),
                i.alias("i"),
                q.alias("q"),
            )

        return self._once("label_blocks", build)

    def label_samples(self) -> DataFrame:
        return to_samples(self.label_blocks())

    # -- real series from events ---------------------------------------------

    def event_blocks(self) -> DataFrame:
        """One long real series per event type, in time order."""

        def build() -> DataFrame:
            rows = self.table("events").select(
                F.col("event_type").alias("capture_id"),
                "ts",
                "event_id",
                F.col("value").alias("i"),
                F.lit(0.0).alias("q"),
            )
            return to_blocks(number_rows(rows, "capture_id", ["ts", "event_id"]), EVENT_BLOCK)

        return self._once("event_blocks", build)

    def event_samples(self) -> DataFrame:
        return to_samples(self.event_blocks())

    # -- two-tone captures keyed by the signs of a vector --------------------

    def tone_blocks(self) -> DataFrame:
        """64 symbols of 8 samples per vector; the sign of an element sets the tone.

        The phase before symbol k is ``2.4 * sum(sign_j, j < k)``; inside the symbol it
        moves by ``0.3 * sign_k`` per sample.
        """
        signs = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(-1))

        def turns(s):
            return F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.lit(63)),
                    lambda k: let(
                        # Once a symbol, not once a sample.
                        F.struct(F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda a, x: a + x).alias("before"), F.get(s, k).alias("sign")),
                        lambda c: F.transform(
                            F.sequence(F.lit(0), F.lit(TONE_SYMBOL - 1)), lambda m: TONE_SYMBOL * c["before"] + c["sign"] * m
                        ),
                    ),
                )
            )

        return self._once("tone_blocks", lambda: (
            spread(self.table("embeddings").select("vec_id", "embedding"))
            .select(F.col("vec_id").alias("capture_id"), let(signs, turns).alias("turns"))
            .select(
                "capture_id",
                F.lit(0).cast("long").alias("block_no"),
                F.lit(0).cast("long").alias("start_n"),
                F.transform("turns", lambda t: F.cos(0.3 * t)).alias("i"),
                F.transform("turns", lambda t: F.sin(0.3 * t)).alias("q"),
            )
        ))

    def tone_samples(self) -> DataFrame:
        return to_samples(self.tone_blocks())

    # -- payload bytes from documents ----------------------------------------

    def payloads(self) -> DataFrame:
        """(capture_id, data): the UTF-8 bytes of every document, whole."""
        return spread(self.table("documents").select("doc_id", "text")).select(
            F.col("doc_id").alias("capture_id"), F.encode("text", "UTF-8").alias("data")
        )

    def line_series(self) -> DataFrame:
        """All line items as one long series (a single hot capture); blocks of 4096."""

        def build() -> DataFrame:
            order = [
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_shipdate",
            ]
            rows = self.table("lineitem").select(
                F.lit("L").alias("capture_id"),
                *order,
                F.col("l_extendedprice").alias("i"),
                F.col("l_quantity").alias("q"),
            )
            return to_blocks(number_rows(rows, "capture_id", order).select("capture_id", "n", "i", "q"), 4096)

        return self._once("line_blocks", build)
