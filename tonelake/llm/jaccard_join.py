"""Near-duplicate payloads: an exact Jaccard join on word shingles.

Two payloads link when ``100 * intersection >= percent * union`` of their shingle sets.

* Payloads with equal sets form one node; everything below works on nodes.
* Tiles: a linked pair shares a shingle among the first ``n - ceil(percent * n / 100) + 1``
  of each set in any common order, and in the smaller set even among the first
  ``n - ceil(2 * percent * n / (100 + percent)) + 1``. Nodes meet in tiles keyed by such a
  shingle and a size band (sizes of one power of two); a node near the upper end of its band
  also enters the next one, as the smaller partner only. Shingles that many payloads share
  come last in the order, so shared passages make no tiles.
* Signatures: every node has a parity bitmap of about one to two bits per shingle. Shingles
  outside the intersection are the only ones that can make two bitmaps differ, so
  ``(n + m - differing bits) / 2`` bounds the intersection from above.
* Pairs left over are decided by counting the common entries of their sorted arrays of hashes.

Only connectivity is asked for, so pairs never become rows. Nodes are gathered in clusters, a
cluster is cut into blocks of bounded size, and a task that holds two blocks compares their
members by bitmap, then by array, and returns a link only where it joins two components that
the task has not joined yet.

First each node is put to the member of its tiles that its bitmap allows the largest overlap
with. Components of the links found there leave few tiles with members of several components;
in these, the component with the most members leads, and all nodes that share such a tile with
a component form its cluster. Two nodes that link share a tile, so they are in one component
already or in one cluster. A first pass by bitmaps tells which members of a cluster may link at
all; arrays are made and dealt out for these only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.components import components
from tonelake.llm.records import extended
from tonelake.llm.shingles import Shingler, mix, set_hash
from tonelake.session import arrow_rows, pin

#: At most so many shingles count as widely shared: each has at least this part of all occurrences.
SHARED_LIMIT = 1 << 18
#: Occurrences counted together, and how often one must occur among them to be reported.
COUNT_BUFFER = 1 << 21
COUNT_LEAST = 4
#: Members of one tile that a task compares with one another's smallest; larger tiles are split.
TILE_MEMBERS = 4096
#: Members of a block that bitmaps are compared in, and shingles (8 bytes each) of one that arrays are.
BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 19
#: Bits, for each wanted text and at most, of the table that says which texts are read again: 8 MiB.
BITS_EACH, MOST_BITS = 8, 1 << 26
#: Parts that the members of a component are dealt to when its smallest id is sent to them.
SALTS = 16
#: Rows of an Arrow batch; a row can be a whole text or a set.
BATCH_ROWS = 1024
#: Texts whose sets a task makes together.
PORTION = 256
#: Members compared at once with a block.
STRIP = 128


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int):
    return n - -(-2 * percent * n // (100 + percent)) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of ``2**k`` bits, ``2**k`` the first power beyond n."""
    width = max(64, 1 << len(shingles).bit_length())
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(n: int, bits_n: bytes, m: int, bits_m: bytes) -> int:
    """An upper bound of the intersection from two bitmaps; the wider one is folded by parity."""
    if len(bits_n) > len(bits_m):
        n, bits_n, m, bits_m = m, bits_m, n, bits_n
    a, b = int.from_bytes(bits_n, "little"), int.from_bytes(bits_m, "little")
    width = len(bits_m) * 8
    while width > len(bits_n) * 8:
        width //= 2
        b = (b >> width) ^ (b & ((1 << width) - 1))
    return min(n, m, (n + m - (a ^ b).bit_count()) // 2)


def _links(overlap, n, m, percent: int):
    return overlap * (100 + percent) >= percent * (n + m)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of texts in portions; sets are many times heavier than their rows."""
    for k in range(0, batch.num_rows, PORTION):
        yield batch.slice(k, PORTION)


def _texts(payloads: DataFrame) -> DataFrame:
    return payloads.select("capture_id", "message_utf8")


def _survey(payloads: DataFrame, words: int) -> DataFrame:
    """One pass over the texts: (capture_id, n, node, bits) rows, and (shingle, hits) rows with null n."""
    source = _texts(payloads)
    schema = extended(source, ["capture_id"], "n long, node long, bits binary, shingle long, hits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        held: list[np.ndarray] = []

        def counts(kind: pa.DataType) -> pa.RecordBatch:
            together = np.concatenate(held)
            held.clear()
            together.sort()
            starts = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]]))
            hits = np.diff(np.append(starts, len(together)))
            often = hits >= COUNT_LEAST
            values, hits = together[starts[often]].view(np.int64), hits[often]
            void = [pa.nulls(len(values), t) for t in (kind, pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*void, pa.array(values), pa.array(hits)], names)

        names = ["capture_id", "n", "node", "bits", "shingle", "hits"]
        kind, occurrences = None, 0
        for whole in batches:
            kind = whole.column(0).type
            for batch in _portions(whole):
                sets = shingler.sets(batch.column(1).to_pylist())
                void = [pa.nulls(len(sets), pa.int64())] * 2
                columns = [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) for s in sets], pa.int64()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    *void,
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                for s in sets:
                    held.append(s)
                    occurrences += len(s)
                    if occurrences >= COUNT_BUFFER:
                        yield counts(kind)
                        occurrences = 0
        if held:
            yield counts(kind)

    return source.mapInArrow(run, schema)


def _shared(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Widely shared shingles, rarest first, and in how many payloads they were counted.

    Each of them has at least 1 / SHARED_LIMIT of all occurrences, so there are at most
    SHARED_LIMIT of them, whatever the input: 4 MiB.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(2 * COUNT_LEAST, -(-total // SHARED_LIMIT))
    found = (
        counted.where("shingle IS NOT NULL")
        .groupBy("shingle")
        .agg(F.sum("hits").alias("hits"))
        .where(F.col("hits") >= least)
        .toPandas()
    )
    found = found.sort_values(["hits", "shingle"])
    return found["shingle"].to_numpy(np.int64), found["hits"].to_numpy(np.int64)


def _tiles(payloads: DataFrame, words: int, percent: int, shared: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(tile, salt, node, n, pos): where each node meets others.

    ``pos`` is 0 within the index prefix, else 1. The members of a tile of a widely shared
    shingle are dealt over as many salts as it has multiples of TILE_MEMBERS; -1: one salt.
    """
    spark = payloads.sparkSession
    table = spark.sparkContext.broadcast(shared)
    source = payloads.select("message_utf8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        values, hits = table.value
        order = np.argsort(values.view(np.uint64))
        by_value, rank, often = values.view(np.uint64)[order], order, hits[order]
        seen: set[int] = set()
        for batch in (portion for whole in batches for portion in _portions(whole)):
            nodes, sizes, lengths, keys, smaller, salts = [], [], [], [], [], []
            for s in shingler.sets(batch.column(0).to_pylist()):
                n = len(s)
                node = set_hash(s)
                if not n or node in seen:  # copies within a task are left out early
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                at = np.minimum(np.searchsorted(by_value, s), max(0, len(by_value) - 1))
                wide = by_value[at] == s if len(by_value) else np.zeros(n, bool)
                length = prefix_length(n, percent)
                rare = s[~wide][:length]
                parts = np.ones(len(rare), np.int64)
                if len(rare) < length:
                    which = at[wide]
                    which = which[np.argsort(rank[which])][: length - len(rare)]
                    rare = np.concatenate([rare, by_value[which]])
                    parts = np.concatenate([parts, 1 + often[which] // TILE_MEMBERS])
                salt = np.where(parts > 1, node % parts, -1)
                short = index_length(n, percent)
                band = n.bit_length()
                bands = [(band, length)]
                if 100 * n >= percent << band:  # a partner in the next band can be close enough
                    bands.append((band + 1, short))
                nodes.append(node)
                sizes.append(n)
                keys += [mix(rare[:k] ^ np.uint64(b * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64) for b, k in bands]
                salts += [salt[:k] for _, k in bands]
                smaller += [np.arange(k) >= short for _, k in bands]
                lengths.append(sum(k for _, k in bands))
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys)),
                        pa.array(np.concatenate(salts).astype(np.int32)),
                        pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array(np.concatenate(smaller).astype(np.int8)),
                    ],
                    ["tile", "salt", "node", "n", "pos"],
                )

    return source.mapInArrow(run, "tile long, salt int, node long, n int, pos tinyint")


def _meetings(tiles: DataFrame) -> DataFrame:
    """Rows of tiles with two members or more, each with the smallest member of its tile and salt (``pivot``).

    A scan over sorted rows that holds one batch, the row before it and the open pivot.
    """
    schema = "tile long, salt int, node long, n int, pos tinyint, pivot long, pivot_n int"
    names = ["tile", "salt", "node", "n", "pos", "pivot", "pivot_n"]
    kinds = [np.int64, np.int32, np.int64, np.int32, np.int8, np.int64, np.int32]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pivot = None

        def done(rows: np.ndarray, after: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            nonlocal pivot
            count = rows.shape[1]
            first = np.ones(count, bool)
            first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            ends = np.append(first[1:], after is None or (rows[:2, -1] != after[:2]).any())
            if pivot is not None and (rows[:2, 0] == pivot[:2]).all():
                first[0] = False
            lead = np.maximum.accumulate(np.where(first, np.arange(count), -1))
            chosen = rows[2:4, lead]
            if lead[0] < 0:
                chosen[:, lead < 0] = pivot[2:4, None]
            pivot = np.concatenate([rows[:2, -1], chosen[:, -1]])
            keep = ~(first & ends) | (rows[1] >= 0)  # a lone member of a salt may meet the other salts
            columns = [*rows[:, keep], *chosen[:, keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if last is not None:
                rows = np.concatenate([last, rows], axis=1)
            if not rows.shape[1]:
                continue
            fresh = np.ones(rows.shape[1], bool)  # copies of a node from several tasks lie side by side
            fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
            rows = rows[:, fresh]
            rows, last = rows[:, :-1], rows[:, -1:]
            if rows.shape[1]:
                yield from done(rows, last[:, 0])
        if last is not None:
            yield from done(last, None)

    ordered = tiles.repartition("tile", "salt").sortWithinPartitions("tile", "salt", "n", "node")
    return ordered.mapInArrow(run, schema)


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow a link, with the sizes and the bound."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            bound = [overlap_bound(*row) for row in zip(n, x, m, y, strict=True)]
            keep = [k for k, (o, p, q) in enumerate(zip(bound, n, m, strict=True)) if _links(o, p, q, percent)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[k] for k in keep], pa.int64()),
                    pa.array([b[k] for k in keep], pa.int64()),
                    pa.array([bound[k] for k in keep], pa.int64()),
                ],
                ["a", "b", "bound"],
            )

    return both.mapInArrow(run, "a long, b long, bound long")


def _arrays(payloads: DataFrame, wanted: DataFrame, survey: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<long>): the sorted arrays of the wanted nodes, computed again from the texts.

    Texts are not shuffled: a bit table says which rows may be wanted, the others are passed
    over, and what the table lets through in vain is dropped by the join. The table has some
    bits for each wanted node and a size bound; beyond it more is let through in vain.
    """
    spark = payloads.sparkSession
    keep = pin(survey.join(wanted, "node").groupBy("node").agg(F.min("capture_id").alias("capture_id")))
    size = min(MOST_BITS, 1 << max(16, (BITS_EACH * keep.count()).bit_length()))

    def hashed(capture_id: Column) -> Column:
        return F.pmod(F.xxhash64(capture_id.cast("string")), F.lit(size))

    words_of_bits = (
        keep.select(hashed(F.col("capture_id")).alias("bit"))
        .groupBy(F.shiftright("bit", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31L AS INT))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(size >> 5, dtype=np.uint32)
    table[words_of_bits["word"].to_numpy(np.int64)] = words_of_bits["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)
    source = payloads.select("message_utf8", hashed(F.col("capture_id")).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(words), shared.value
        for batch in batches:
            bit = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(table[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1))
            for k in range(0, len(hit), PORTION):
                sets = [s for s in shingler.sets(batch.column(0).take(pa.array(hit[k : k + PORTION])).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_hash(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["node", "shingles"],
                )

    found = source.mapInArrow(run, "node long, shingles array<long>")
    return found.join(keep.select("node"), "node", "left_semi").dropDuplicates(["node"])


# -- clusters ---------------------------------------------------------------------


class Block:
    """Members of a block, by size band: all bitmaps of a band have one width, the next band's folds to it."""

    def __init__(self, node: np.ndarray, n: np.ndarray, root: np.ndarray, bits: list[bytes]) -> None:
        self.node, self.n, self.root = node, n, root
        self.bands: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        width = np.array([len(b) for b in bits])
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            own = np.frombuffer(b"".join(bits[k] for k in rows), "<u8").reshape(len(rows), -1)
            half = own.shape[1] // 2
            self.bands[int(w)] = rows, own, own[:, :half] ^ own[:, half:]

    def close(self, other: Block, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (own row, row of ``other``) of different components that sizes and bitmaps let link, in strips.

        Rows of the strip are compared as long as ``root`` tells them apart; it is read anew for each strip.
        """
        for width, (rows, own, folded) in self.bands.items():
            for factor in (1, 2, 0.5):
                met = other.bands.get(int(width * factor))
                if met is None:
                    continue
                there = met[0]
                left, right = (own, met[1]) if factor == 1 else (own, met[2]) if factor == 2 else (folded, met[1])
                for k in range(0, len(rows), STRIP):
                    i, x = rows[k : k + STRIP], left[k : k + STRIP]
                    n, m = self.n[i][:, None], other.n[there][None, :]
                    open_ = (self.root[i][:, None] != other.root[there][None, :]) & (
                        100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                    )
                    a, b = np.nonzero(open_)
                    for c in range(0, len(a), 1 << 18):
                        p, q = a[c : c + (1 << 18)], b[c : c + (1 << 18)]
                        differ = np.bitwise_count(x[p] ^ right[q]).sum(axis=1, dtype=np.int64)
                        n_p, n_q = self.n[i[p]], other.n[there[q]]
                        bound = np.minimum(np.minimum(n_p, n_q), (n_p + n_q - differ) // 2)
                        good = _links(bound, n_p, n_q, percent)
                        if good.any():
                            yield i[p[good]], there[q[good]]


def common_counts(x: np.ndarray, values: np.ndarray, owner: np.ndarray, members: int) -> np.ndarray:
    """How many entries of the sorted array ``x`` each member has, from all members' entries merged in order."""
    low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
    runs = high - low
    places = np.arange(int(runs.sum())) + np.repeat(low - np.cumsum(runs) + runs, runs)
    return np.bincount(owner[places], minlength=members)


def links_of(one: Block, two: Block, arrays_one: list, arrays_two: list, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks that join components, at most one less than there are components.

    ``one.root`` and ``two.root`` name the components and are changed as links join them. A block
    may be compared with itself.
    """
    merged: tuple[np.ndarray, np.ndarray] | None = None
    found = []
    for i, j in one.close(two, percent):
        for p in np.unique(i):
            rows = j[i == p]
            rows = rows[two.root[rows] != one.root[p]]
            if not len(rows):
                continue
            x = arrays_one[p]
            if len(rows) <= 4:
                both = [(np.minimum(np.searchsorted(y := arrays_two[q], x), len(y) - 1), y) for q in rows]
                overlap = np.array([(y[at] == x).sum() for at, y in both])
            else:
                if merged is None:
                    values = np.concatenate(arrays_two)
                    owner = np.repeat(np.arange(len(arrays_two)), [len(y) for y in arrays_two])
                    order = np.argsort(values, kind="stable")
                    merged = values[order], owner[order]
                overlap = common_counts(x, *merged, len(arrays_two))[rows]
            for q in rows[_links(overlap, one.n[p], two.n[rows], percent)]:
                old, new = two.root[q], one.root[p]
                if old != new:
                    found.append((int(one.node[p]), int(two.node[q])))
                    one.root[one.root == old] = new
                    two.root[two.root == old] = new
    return found


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group from batches ordered by the first ``keys`` columns; one group is held at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.stack([held.column(k).to_numpy() for k in range(keys)]).astype(np.int64)
        edges = [0, *(1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield held.slice(a, b - a)
        held = held.slice(edges[-1])  # may go on in the next batch
    if held is not None:
        yield held


def _blocks_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Block, Block]:
    """Rows and blocks of the two sides of a group (leader, low, high, own, node, n, component, bits)."""
    low, high, own, node, n, component = (table.column(k).to_numpy().astype(np.int64) for k in range(1, 7))
    bits = table.column(7).to_pylist()
    sides = [np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0])]
    one = Block(node[sides[0]], n[sides[0]], component[sides[0]], [bits[k] for k in sides[0]])
    if low[0] == high[0]:
        return sides[0], sides[0], one, one
    return *sides, one, Block(node[sides[1]], n[sides[1]], component[sides[1]], [bits[k] for k in sides[1]])


def _dealt(clusters: DataFrame, members: int, shingles: int, mixed: bool) -> DataFrame:
    """Rows of clusters (leader, node, n, component, lead, ...) dealt out to pairs of blocks (low, high).

    Blocks 0 on hold members outside the leading component, later ones those of it (``lead``),
    which are not compared with one another. Without ``mixed`` each of the others meets its own
    block and the leading members only; these must be few.
    """
    def blocks(condition: Column) -> Column:
        weight = F.greatest(
            F.ceil(F.count_if(condition) / members), F.ceil(F.sum(F.when(condition, F.col("n")).otherwise(0)) / shingles)
        )
        return weight.cast("int")

    sizes = clusters.groupBy("leader").agg(blocks(~F.col("lead")).alias("others"), blocks(F.col("lead")).alias("leading"))
    rows = clusters.join(sizes, "leader").where("others > 0")
    place = F.xxhash64("node")
    own = F.when(F.col("lead"), F.col("others") + F.pmod(place, F.greatest("leading", F.lit(1)))).otherwise(F.pmod(place, F.col("others")))
    rows = rows.withColumn("own", own.cast("int"))
    every = F.sequence(F.lit(0), F.col("others") - 1)
    if mixed:
        met = F.when(F.col("lead"), every).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("leading") - 1))
        pair = [F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own"]
    else:
        met = F.when(F.col("lead"), every).otherwise(F.array("own"))
        pair = [F.col("met").alias("low"), F.col("met").alias("high"), F.col("met").alias("own")]
    carried = [c for c in clusters.columns if c not in ("leader", "lead", "node", "n", "component")]
    rows = rows.withColumn("met", F.explode(met)).select("leader", *pair, "node", "n", "component", *carried)
    return rows.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high")


def _may_link(clusters: DataFrame, percent: int) -> DataFrame:
    """(leader, node): members of a cluster whose bitmaps allow a link with a member of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            _, _, one, two = _blocks_of(table)
            seen_one, seen_two = np.zeros(len(one.node), bool), np.zeros(len(two.node), bool)
            for i, j in one.close(two, percent):
                seen_one[i] = True
                seen_two[j] = True
            nodes = np.unique(np.concatenate([one.node[seen_one], two.node[seen_two]]))
            if len(nodes):
                leader = np.full(len(nodes), table.column(0)[0].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leader), pa.array(nodes)], ["leader", "node"])

    dealt = _dealt(clusters, BLOCK_MEMBERS, 64 * BLOCK_SHINGLES, True)
    return dealt.mapInArrow(run, "leader long, node long").distinct()


def _links_within(clusters: DataFrame, arrays: DataFrame, percent: int, mixed: bool) -> DataFrame:
    """Links (a, b) between members of a cluster, enough to join all of its components that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            rows_one, rows_two, one, two = _blocks_of(table)
            lists = table.column(8).combine_chunks()
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            arrays_one = [values[offsets[k] : offsets[k + 1]] for k in rows_one]
            arrays_two = arrays_one if one is two else [values[offsets[k] : offsets[k + 1]] for k in rows_two]
            found = links_of(one, two, arrays_one, arrays_two, percent)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
                )

    dealt = _dealt(clusters.join(arrays, "node"), BLOCK_MEMBERS, BLOCK_SHINGLES, mixed)
    return dealt.mapInArrow(run, "a long, b long")


def _to_best(bounded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Clusters of nodes around the partner that each may overlap most with."""
    best = bounded.groupBy("a").agg(F.max(F.struct("bound", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    best = pin(best)
    led = best.select(F.col("b").alias("leader"), F.col("a").alias("node"), F.lit(False).alias("lead"))
    leaders = best.select(F.col("b").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("lead")).distinct()
    return led.unionByName(leaders).join(nodes, "node").select("leader", "lead", "node", "n", F.col("node").alias("component"), "bits")


def _open_clusters(meetings: DataFrame, label: DataFrame) -> DataFrame:
    """Clusters (leader, lead, node, n, component) of the tiles whose members lie in several components."""
    rows = meetings.select("tile", "node", "n").join(label, "node", "left")
    rows = pin(rows.select("tile", "node", "n", F.coalesce("component", "node").alias("component")))
    each = rows.groupBy("tile", "component").agg(F.count("*").alias("members"))
    top = each.groupBy("tile").agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("components"))
    leader = top.where("components > 1").select("tile", F.col("top.component").alias("leader"))
    found = rows.join(leader, "tile").select("leader", "node", "n", "component").distinct()
    return found.withColumn("lead", F.col("component") == F.col("leader"))


def _linked(payloads: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(capture_id, n, node)`` of every row, and ``(node, component)`` of the nodes that link."""
    surveyed = pin(_survey(payloads, words))
    sets = surveyed.where("n IS NOT NULL")
    survey = sets.select("capture_id", "n", "node")
    nodes = sets.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    shared = _shared(surveyed)

    near = F.expr(f"100L * least(n, pivot_n) >= {percent}L * greatest(n, pivot_n)")
    meetings = pin(_meetings(_tiles(payloads, words, percent, shared)))
    salted = meetings.where("salt >= 0").select("tile", F.col("pivot").alias("node"), F.col("pivot_n").alias("n")).distinct()
    lowest = salted.groupBy("tile").agg(F.min(F.struct("n", "node")).alias("low"))
    between_salts = salted.join(lowest, "tile").select(
        "node", "n", F.col("low.node").alias("pivot"), F.col("low.n").alias("pivot_n")
    )
    to_pivot = (
        meetings.select("node", "n", "pivot", "pivot_n")
        .unionByName(between_salts)
        .where("node <> pivot")
        .where(near)
        .select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        .distinct()
    )
    first = pin(_to_best(_bounded(to_pivot, nodes, percent), nodes))
    links = pin(_links_within(first, _arrays(payloads, first.select("node").distinct(), survey, words), percent, False))
    label = components(links)

    open_ = pin(_open_clusters(meetings, label).join(nodes.select("node", "bits"), "node"))
    alive = pin(_may_link(open_, percent))
    second = open_.join(alive, ["leader", "node"])
    more = _links_within(second, _arrays(payloads, alive.select("node").distinct(), survey, words), percent, True)
    return survey, components(links.unionByName(pin(more)))


def near_duplicates(payloads: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``payloads(capture_id, message_utf8)`` -> ``(capture_id, n_shingles long, component_id)``.

    ``component_id`` is the smallest ``capture_id`` that links lead to, the own one included.
    Every input row gives one row, repeated rows included. A null, empty or blank message has
    no shingles and links with nothing; fewer than ``words`` words are one shingle. A null
    ``capture_id`` is never the smallest unless all of its component are null. An empty table
    gives an empty table. Texts of any length are used whole; no tile, group or number of
    candidates is capped.
    """
    with arrow_rows(payloads.sparkSession, BATCH_ROWS):
        survey, final = _linked(payloads, words, percent)

    smallest = survey.where("n > 0").groupBy("node").agg(F.min("capture_id").alias("smallest"))
    # A component of very many nodes would be one key of the join with its head, so both are salted.
    named = final.join(smallest, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    head = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    head = head.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    by_node = named.join(head, ["component", "salt"]).select("node", "component_id")
    by_node = smallest.join(by_node, "node", "left").select("node", F.coalesce("component_id", "smallest").alias("component_id"))
    return survey.join(by_node, "node", "left").select(
        "capture_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("capture_id")).alias("component_id"),
    )
