"""Hard negatives of feature vectors by inner product, with coordinate pruning.

An anchor is compared with all vectors. These are dealt into slabs; in a task a slab's vectors
are ordered by length and cut into buckets, and in each bucket every coordinate of the
normalised vectors has a sorted list. An anchor that still wants scores of at least ``t`` in a
bucket with lengths up to ``m`` wants cosines of at least ``t / (|anchor| m)``: for its largest
coordinates, the focus, that leaves a range of values a vector can have there. Vectors within
all ranges, found in the sorted lists, are candidates, and their integer scores decide. Buckets
come by falling length, and ``t`` rises as better scores are found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.operators.models import FEATURES
from tonelake.session import pin

#: Vectors of a slab at most, on average; of a bucket; anchors compared at once.
SLAB, BUCKET, ANCHORS = 1 << 17, 1024, 1024
#: Coordinates of an anchor whose lists are searched.
FOCUS = 4
#: The first of so many slabs is searched first; what it holds bounds what others have to return.
ROUND = 16
_MOST, _NO_ID = 2**62, 2**63 - 1


class Bucket:
    """Vectors of similar length: integers, and per coordinate a sorted list of the normalised values."""

    def __init__(self, ids: np.ndarray, owners: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.owners, self.labels, self.vectors = ids, owners, labels, vectors
        self.real = vectors.astype(np.float64)
        self.longest = float(lengths.max(initial=0.0))
        unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def scores(self, anchors: np.ndarray, longest: float) -> np.ndarray:
        """Exact: the partial sums of a product are at most the product of the lengths in size."""
        if longest * self.longest < 2.0**52:
            return (anchors.astype(np.float64) @ self.real.T).astype(np.int64)
        return anchors @ self.vectors.T


def buckets_of(ids: np.ndarray, owners: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    parts = [order[k : k + BUCKET] for k in range(0, len(order), BUCKET)]
    return [Bucket(ids[p], owners[p], labels[p], vectors[p], lengths[p]) for p in parts]


def feasible(anchor: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that a unit vector can have at a coordinate where the unit anchor has ``anchor``, for a cosine of ``least``.

    With the two angles to the axis a and b, the cosine is at most cos(a - b).
    """
    a, reach = np.arccos(np.clip(anchor, -1, 1)), np.arccos(np.clip(least, -1, 1))
    return np.cos(np.minimum(a + reach, np.pi)) - 1e-9, np.cos(np.maximum(a - reach, 0.0)) + 1e-9


def candidates(bucket: Bucket, unit: np.ndarray, focus: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Which anchors have to see the whole bucket, and the rows for each of the others.

    ``unit`` holds normalised anchors, ``focus`` their focus coordinates, ``least`` the cosine each
    wants at least; without a positive one nothing is pruned.
    """
    size = len(bucket.ids)
    low, high = feasible(np.take_along_axis(unit, focus, axis=1), least[:, None])
    first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, size)
    for c in np.unique(focus):
        at = focus == c
        first[at] = np.searchsorted(bucket.sorted[:, c], low[at], "left")
        last[at] = np.searchsorted(bucket.sorted[:, c], high[at], "right")
    # Lists that leave most of the bucket cost more than they spare.
    within = last - first
    whole = (least <= 0) | (within.min(axis=1) * 2 > size)
    chosen = []
    for a in np.flatnonzero(~whole):
        lists = [c for c in range(focus.shape[1]) if within[a, c] * 2 <= size]
        met = np.zeros(size, np.int8)
        for c in lists:
            met[bucket.order[first[a, c] : last[a, c], focus[a, c]]] += 1
        chosen.append((int(a), np.flatnonzero(met == len(lists))))
    return whole, chosen


class Wanted:
    """The best ``k`` scores in each of an anchor's ranges ``[low, high]``, ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, least_id: np.ndarray, k: int) -> None:
        self.high, self.k, self.ranges = high, k, low.shape[1]
        # An entry has to beat this one; ids are below ``_NO_ID``, so an equal score passes at first.
        self.score, self.id = np.maximum(low, least), np.where(least >= low, least_id, _NO_ID)
        self.key, self.found, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keys, scores, names = [self.key], [self.found], [self.ids]
        for j in range(self.ranges):
            bar = self.score[anchor, j]
            good = (score <= self.high[anchor, j]) & ((score > bar) | ((score == bar) & (ids < self.id[anchor, j])))
            keys.append(anchor[good] * self.ranges + j)
            scores.append(score[good])
            names.append(ids[good])
        if not sum(map(len, keys[1:])):
            return
        key, found, ids = np.concatenate(keys), np.concatenate(scores), np.concatenate(names)
        order = np.lexsort((ids, -found, key))
        key, found, ids = key[order], found[order], ids[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(begin, np.diff([*begin, len(key)]))
        kept = rank < self.k
        self.key, self.found, self.ids = key[kept], found[kept], ids[kept]
        full = rank == self.k - 1
        self.score.flat[key[full]], self.id.flat[key[full]] = found[full], ids[full]


def search(buckets: list[Bucket], vectors: np.ndarray, owners: np.ndarray, labels: np.ndarray, same: bool, wanted: Wanted) -> None:
    """Fill ``wanted`` for anchors from the buckets: rows of the anchor's label but itself, or of all other labels."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    highest = wanted.high.max(axis=1, initial=-_MOST)
    for bucket in buckets:
        bar = wanted.score.min(axis=1, initial=_MOST)
        active = np.flatnonzero((bar <= lengths * bucket.longest * (1 + 1e-9) + 1e-6) & (bar <= highest))
        if not len(active):
            continue
        reach = lengths[active] * bucket.longest
        least = np.where(reach > 0, bar[active] / np.where(reach > 0, reach, 1.0), -1.0) - 1e-9
        whole, chosen = candidates(bucket, unit[active], focus[active], least)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(a: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
            agree = labels[a] == bucket.labels[row]
            good = agree & (owners[a] != bucket.owners[row]) if same else ~agree
            good &= (score >= bar[a]) & (score <= highest[a])
            hits.append((a[good], score[good], bucket.ids[row[good]]))

        full = active[whole]
        if len(full):
            score = bucket.scores(vectors[full], float(lengths[full].max()))
            a, row = np.nonzero((score >= bar[full][:, None]) & (score <= highest[full][:, None]))
            keep(full[a], row, score[a, row])
        for a, rows in chosen:
            if len(rows):
                score = bucket.vectors[rows] @ vectors[active[a]]
                keep(np.full(len(rows), active[a]), rows, score)
        if hits:
            wanted.add(*(np.concatenate(part) for part in zip(*hits, strict=True)))


_ROW = (
    "slab int, label string, kind int, owner long, id long, vector array<int>,"
    " partners array<struct<id: long, score: long>>, low array<long>, high array<long>, least array<long>, least_id array<long>"
)
_FOUND = "owner long, anchor_id long, place int, partner_id long, partner_score long, id long, score long"


def _matrix(lists: pa.Array, kind: type) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(kind) if len(lists) else np.zeros((0, 0), kind)


def _compare(rows: DataFrame, by: list[str], same: bool, k: int) -> DataFrame:
    """Search each group of ``by``: its vectors (kind 0) come first, then its anchors (kind 1)."""
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, buckets, codes = None, [], [], {}

        def built() -> list[Bucket]:
            if not gathered:
                return []
            table = pa.concat_tables(gathered)
            labels = [codes.setdefault(label, len(codes)) for label in table["label"].to_pylist()]
            return buckets_of(
                table["id"].to_numpy(), table["owner"].to_numpy(), np.array(labels, np.int64),
                _matrix(table["vector"].combine_chunks(), np.int64),
            )

        def answers(anchors: pa.RecordBatch) -> pa.RecordBatch:
            partners = anchors.column("partners").to_pylist()
            width = max(len(p) for p in partners)
            fill = {"low": _MOST, "high": -_MOST, "least": _MOST, "least_id": _NO_ID}
            bounds = {
                name: np.array([v + [fill[name]] * (width - len(v)) for v in anchors.column(name).to_pylist()], np.int64)
                for name in fill
            }
            owners, ids = anchors.column("owner").to_numpy(), anchors.column("id").to_numpy()
            labels = np.array([codes.get(label, -1) for label in anchors.column("label").to_pylist()], np.int64)
            wanted = Wanted(bounds["low"], bounds["high"], bounds["least"], bounds["least_id"], k)
            search(buckets, _matrix(anchors.column("vector"), np.int64), owners, labels, same, wanted)
            a, j = np.divmod(wanted.key, max(width, 1))
            pair = [partners[x][y] for x, y in zip(a.tolist(), j.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(owners[a]),
                    pa.array(ids[a]),
                    pa.array(j.astype(np.int32)),
                    pa.array([p["id"] for p in pair], pa.int64()),
                    pa.array([p["score"] for p in pair], pa.int64()),
                    pa.array(wanted.ids),
                    pa.array(wanted.found),
                ],
                [field.split()[0] for field in _FOUND.split(", ")],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(name).to_pylist() for name in [*by, "kind"]), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if keys[begin][:-1] != current:
                    current, gathered, buckets, codes = keys[begin][:-1], [], [], {}
                part = batch.slice(begin, end - begin)
                if keys[begin][-1] == 0:
                    gathered.append(pa.Table.from_batches([part.select(["label", "owner", "id", "vector"])]))
                    continue
                if gathered:
                    buckets, gathered = built(), []
                for k0 in range(0, part.num_rows if buckets else 0, ANCHORS):
                    yield answers(part.slice(k0, ANCHORS))

    return ordered.mapInArrow(run, _FOUND)


def _best(vectors: DataFrame, anchors: DataFrame, slabs: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows for each anchor and range, over all slabs.

    The anchors meet one slab in ``ROUND`` first. What it yields bounds what the others have to
    return, so that the rows to be merged don't grow with the number of slabs.
    """
    by = ["slab", "label"] if same else ["slab"]
    bare = F.lit(None)
    own = vectors.select(
        "slab", "label", F.lit(0).alias("kind"), "owner", "id", "vector",
        bare.cast("array<struct<id: long, score: long>>").alias("partners"),
        *[bare.cast("array<long>").alias(c) for c in ("low", "high", "least", "least_id")],
    )

    def met(asked: DataFrame, first: bool) -> DataFrame:
        chosen = [s for s in range(slabs) if (s % ROUND == 0) == first]
        if not chosen:
            return asked.sparkSession.createDataFrame([], _FOUND)
        dealt = F.explode(F.expr(f"filter(sequence(0, {slabs - 1}), s -> {'' if first else 'NOT '}s % {ROUND} = 0)"))
        sent = asked.select(
            dealt.alias("slab"), "label", F.lit(1).alias("kind"), "owner", "id", "vector", "partners", "low", "high", "least", "least_id"
        )
        there = own.where(F.col("slab") % ROUND == 0) if first else own.where(F.col("slab") % ROUND != 0)
        return _compare(there.unionByName(sent), by, same, k)

    def merged(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("owner", "place").orderBy(F.col("score").desc(), F.col("id").asc())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.transform("low", lambda _: F.lit(-_MOST).cast("long")), F.transform("low", lambda _: F.lit(_NO_ID).cast("long"))
    asked = anchors.withColumn("least", none[0]).withColumn("least_id", none[1])
    begun = pin(merged(met(asked, True)))
    last = begun.where(F.col("rank") == k).groupBy("owner").agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.struct("score", "id")))).alias("last")
    )
    bounded = asked.join(last, "owner", "left")

    def bound(field: str, otherwise: int) -> Column:
        return F.transform(
            "low", lambda _, j: F.coalesce(F.try_element_at("last", j)[field], F.lit(otherwise).cast("long"))
        )

    bounded = bounded.withColumn("least", bound("score", -_MOST)).withColumn("least_id", bound("id", _NO_ID)).drop("last")
    return merged(begun.drop("rank").unionByName(met(bounded, False)))


def mine_hard_negatives(
    features: DataFrame,
    anchor: Column,
    names: Sequence[str] = FEATURES,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """Vectors of other labels that come close to an anchor's best ones of its own label.

    ``features(capture_id, label, <names>)``; ``anchor`` is a condition on ``capture_id``. Features
    count as integers ``floor(scale * x)``, scores are their inner products; higher scores come
    first, ties by smaller ``capture_id``. An anchor's positives are its first ``positives`` other
    rows of the same label. For each, the first ``negatives`` rows of different labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned:
    ``anchor_id, positive_id, rank int`` (from 1, among these), ``negative_id, positive_score,
    negative_score``. All rows are searched.

    Rows with a null id or label, a null, NaN or infinite feature, or one whose integer is ``2^24``
    or more in size, take no part. Repeated rows count each: they can be one another's positives,
    and an anchor that occurs twice is answered twice. Where fewer rows qualify, all of them are
    returned. An empty table, or one without anchors, gives an empty table. Other columns are not
    read. Vectors of any label, and a label with most of the rows, are spread over all slabs.
    """
    vector = F.array(*[F.col(f"`{name}`").cast("double") for name in names])
    # A hundred times the sum of products of such integers, over up to 2^8 features, fits a long.
    fits = F.forall("exact", lambda c: F.coalesce(F.abs(c * scale) < float(2**24), F.lit(False)))
    usable = features.select(
        F.col("capture_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        vector.alias("exact"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & fits)
    integers = F.transform("exact", lambda c: F.floor(c * scale).cast("int"))
    stored = pin(usable.select("id", "label", "anchor", integers.alias("vector"), F.monotonically_increasing_id().alias("owner")))
    size = stored.count()
    slabs = max(stored.sparkSession.sparkContext.defaultParallelism, -(-size // SLAB))
    vectors = stored.withColumn("slab", F.pmod(F.xxhash64("owner"), F.lit(slabs)).cast("int"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")))
    anchors = stored.where("anchor").select(
        "owner", "id", "label", "vector", one.alias("partners"),
        F.array(F.lit(-_MOST).cast("long")).alias("low"), F.array(F.lit(_MOST).cast("long")).alias("high"),
    )
    found = _best(vectors, anchors, slabs, True, positives)
    partners = found.groupBy("owner").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.struct(F.col("id"), F.col("score")).alias("p")))).alias("p")
    ).select("owner", F.transform("p", lambda r: r["p"]).alias("partners"))
    asked = anchors.drop("partners", "low", "high").join(partners, "owner")

    def hundredths(value: Column) -> Column:
        """The largest integer of at most ``value / 100``, in integers."""
        return F.call_function("div", value - F.pmod(value, F.lit(100).cast("long")), F.lit(100).cast("long"))

    # The smallest integer of at least low/100 times a positive score, and the largest of at most high/100.
    asked = asked.withColumn("low", F.transform("partners", lambda p: -hundredths(-p["score"] * low)))
    asked = asked.withColumn("high", F.transform("partners", lambda p: hundredths(p["score"] * high)))
    mined = _best(vectors, pin(asked), slabs, False, negatives)
    return mined.select(
        "anchor_id", F.col("partner_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("partner_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
