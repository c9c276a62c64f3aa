"""Fingerprints of payload texts: a Merkle tree over sections, paragraphs and pieces.

A text is cut into paragraphs (lines with their line end) and paragraphs into pieces at places
that depend on the bytes around them; pieces are the leaves. Consecutive paragraphs form
sections; a section ends after a blank paragraph or one whose digest says so, which also depends
on content alone. The digest of a paragraph is that of its leaves' hashes and its bytes, of a
section that of its paragraphs' digests, and the root that of the sections' digests. So equal
roots mean equal texts. For different roots the trees are compared from the top: sections with
equal digests are passed over, then paragraphs of the others, then pieces of the paragraphs that
are left, and the pieces without a match are where the texts differ.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.records import extended
from tonelake.llm.shingles import mix
from tonelake.session import pin

#: A piece ends where the hash of the last bytes has this many low bits zero: 32 bytes on average.
WINDOW, PIECE_BITS = 8, 5
#: A section ends after a paragraph whose digest has this many low bits zero: 8 paragraphs on average.
SECTION_BITS = 3
DIGEST_BYTES = 16

_VALUE_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x2545F4914F6CDD1D | 1


#: Bytes looked at together, so that scratch memory does not grow with the text.
SLICE = 1 << 18


@dataclass(frozen=True)
class Tree:
    """Digests of sections and paragraphs, hashes of pieces with their bytes, and where each level's nodes end in the next.

    ``section_ends[k]`` is the paragraph after section k, ``paragraph_ends[k]`` the piece after
    paragraph k.
    """

    root: str
    sections: list[bytes]
    section_ends: list[int]
    paragraphs: list[bytes]
    paragraph_ends: np.ndarray
    pieces: np.ndarray
    lengths: np.ndarray


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def _pieces(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of the pieces, slice by slice with the open piece carried on."""
    total = len(data)
    line_start = piece_start = 0
    open_sum = np.zeros(1, np.uint64)
    hashes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin in range(0, total, SLICE):
        end = min(total, begin + SLICE)
        lead = max(0, begin - WINDOW + 1)
        raw = np.frombuffer(data, np.uint8, end - lead, lead)
        place = np.arange(begin, end)
        line_end = raw[begin - lead :] == 10
        after = np.concatenate([[False], line_end[:-1]])
        if begin and data[begin - 1] == 10:
            line_start = begin
        start_of_line = np.maximum.accumulate(np.where(after, place, line_start))
        line_start = int(start_of_line[-1])
        with np.errstate(over="ignore"):
            values = _VALUE_OF_BYTE[raw]
            rolling = values.copy()
            for k in range(1, WINDOW):
                rolling[k:] += values[:-k] << np.uint64(k)
            values, rolling = values[begin - lead :], rolling[begin - lead :]
            # Only high bits of the sum depend on all bytes of the window.
            inner = (rolling >> np.uint64(40) & np.uint64((1 << PIECE_BITS) - 1)) == 0
            cut = line_end | (inner & (place - start_of_line >= WINDOW))
            if end == total:
                cut[-1] = True
            ends = place[cut] + 1
            starts = np.concatenate([[piece_start], ends])
            offset = (place - np.repeat(starts, np.diff(np.concatenate([[begin], ends, [end]])))).astype(np.uint64)
            # The order of the bytes in a piece counts: each value is mixed with its place.
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + offset * np.uint64(_STEP)), dtype=np.uint64)])
            at = np.concatenate([[begin], ends, [end]]) - begin
            own = sums[at[1:]] - sums[at[:-1]]
            own[0] += open_sum[0]
            size = np.diff(starts)
            hashes.append(mix(own[:-1] + size.astype(np.uint64)))
            lengths.append(size)
            open_sum, piece_start = own[-1:], int(starts[-1])
    return np.concatenate(hashes), np.concatenate(lengths)


def build(text: str) -> Tree:
    data = text.encode()
    hashes, lengths = _pieces(data)
    ends = np.cumsum(lengths)
    last = np.frombuffer(data, np.uint8)[ends - 1] == 10
    if len(last):
        last[-1] = True
    paragraph_ends = np.flatnonzero(last) + 1
    paragraphs, sections, section_ends, open_section = [], [], [], []
    begin = first = 0
    for piece, end in zip(paragraph_ends.tolist(), ends[paragraph_ends - 1].tolist(), strict=True):
        paragraph = data[begin:end]
        digest = _digest(b"p" + hashes[first:piece].tobytes() + paragraph)
        paragraphs.append(digest)
        open_section.append(digest)
        if not paragraph.strip() or digest[0] & ((1 << SECTION_BITS) - 1) == 0:
            sections.append(_digest(b"s" + b"".join(open_section)))
            section_ends.append(len(paragraphs))
            open_section = []
        begin, first = end, piece
    if open_section:
        sections.append(_digest(b"s" + b"".join(open_section)))
        section_ends.append(len(paragraphs))
    root = _digest(b"r" + b"".join(sections)).hex()
    return Tree(root, sections, section_ends, paragraphs, paragraph_ends, hashes, lengths)


def _unmatched(own: list, other: list) -> list[int]:
    """Places of ``own`` entries beyond as many equal ones in ``other``; the first ones are matched."""
    free = Counter(other)
    left = []
    for k, digest in enumerate(own):
        if free[digest] > 0:
            free[digest] -= 1
        else:
            left.append(k)
    return left


def _unmatched_hashes(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``_unmatched`` for many small nodes."""
    order = np.argsort(own, kind="stable")
    ordered, known = own[order], np.sort(other)
    first = np.searchsorted(ordered, ordered, "left")
    turn = np.arange(len(own)) - first  # how many equal ones came before
    free = np.searchsorted(known, ordered, "right") - np.searchsorted(known, ordered, "left")
    return np.sort(order[turn >= free])


def _children(nodes: list[int], ends: list[int] | np.ndarray) -> np.ndarray:
    """Places of the next level under ``nodes``."""
    spans = [np.arange(int(ends[k - 1]) if k else 0, int(ends[k])) for k in nodes]
    return np.concatenate(spans) if spans else np.zeros(0, np.int64)


def differing(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each tree that have no match in the other, from the top down."""
    if a.root == b.root:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sections = _unmatched(a.sections, b.sections), _unmatched(b.sections, a.sections)
    below = _children(sections[0], a.section_ends).tolist(), _children(sections[1], b.section_ends).tolist()
    digests = [a.paragraphs[k] for k in below[0]], [b.paragraphs[k] for k in below[1]]
    paragraphs = [below[0][k] for k in _unmatched(*digests)], [below[1][k] for k in _unmatched(*digests[::-1])]
    leaves = _children(paragraphs[0], a.paragraph_ends), _children(paragraphs[1], b.paragraph_ends)
    own, other = a.pieces[leaves[0]], b.pieces[leaves[1]]
    return leaves[0][_unmatched_hashes(own, other)], leaves[1][_unmatched_hashes(other, own)]


def likeness(a: Tree, b: Tree, apart: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Twice the bytes in matched branches and pieces, over the bytes of both; equal roots are 1."""
    if a.root == b.root:
        return 1.0
    total = int(a.lengths.sum() + b.lengths.sum())
    own, other = differing(a, b) if apart is None else apart
    return float(total - a.lengths[own].sum() - b.lengths[other].sum()) / total


def changed_ranges(tree: Tree, pieces: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges ``(start, end)`` of pieces, neighbours joined."""
    ends = np.cumsum(tree.lengths)
    ranges: list[tuple[int, int]] = []
    for start, end in zip((ends[pieces] - tree.lengths[pieces]).tolist(), ends[pieces].tolist(), strict=True):
        if ranges and ranges[-1][1] == start:
            ranges[-1] = ranges[-1][0], end
        else:
            ranges.append((start, end))
    return ranges


def edited(text: str, other: str) -> str:
    """The last half of the characters, rounded down, replaced by as many of the first of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = {
    "n_chars": ("long", pa.int64()),
    "n_paragraphs": ("long", pa.int64()),
    "root": ("string", pa.string()),
    "edited_sha256": ("string", pa.string()),
    "edited_root": ("string", pa.string()),
    "near_edited": ("double", pa.float64()),
    "near_next": ("double", pa.float64()),
    "changes": ("array<struct<start: long, end: long>>", _SPANS),
}
_FIELDS = ", ".join(f"{name} {kind}" for name, (kind, _) in _RESULT.items())


def _compared(text: str, own: Tree, other: str, following: Tree) -> tuple:
    new = edited(text, other)
    tree = own if new == text else build(new)
    apart = differing(own, tree)
    changes = [{"start": a, "end": b} for a, b in changed_ranges(own, apart[0])]
    return (
        len(text), len(own.paragraphs), own.root, hashlib.sha256(new.encode()).hexdigest(), tree.root,
        likeness(own, tree, apart), likeness(own, following), changes,
    )


def fingerprint_edits(payloads: DataFrame) -> DataFrame:
    """Fingerprint every message of ``payloads(capture_id, message_utf8)`` and an edited version of it.

    Columns: ``capture_id, n_chars, n_paragraphs, root`` (hex fingerprint), ``edited_sha256,
    edited_root, near_edited`` (likeness of the two trees), ``near_next`` (likeness with the
    next message) and ``changes``, the byte ranges of the message that the edited version lacks, as the
    branches of the trees tell it. The
    next message is that of the next smaller ``capture_id``, after the smallest that of the
    largest; its head replaces the last half of the message in the edited version.

    Every input row gives one row. Repeated ids follow one another in the order of a hash of
    their text, null ids come last. A null message counts as empty; empty messages have the
    root of no sections and likeness 1 with one another. A single row is its own next. An
    empty table gives an empty table. Messages of any length are read whole.

    Messages are dealt out once, by range of id. A task compares neighbours as it scans; only
    the first and the last message of each range are stored to be compared in a second step.
    """
    source = payloads.select(
        "capture_id",
        F.coalesce("message_utf8", F.lit("")).alias("message_utf8"),
        F.xxhash64(F.coalesce("message_utf8", F.lit(""))).alias("tie"),
    )
    order = [F.col("capture_id").desc_nulls_last(), F.col("tie").asc()]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    names = ["capture_id", *_RESULT, "part", "kind", "message_utf8"]
    schema = extended(source, ["capture_id"], f"{_FIELDS}, part int, kind int, message_utf8 string")
    kinds = [kind for _, kind in _RESULT.values()]
    width = len(names) - 4

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kind_of_id = None
        before: tuple | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind_of_id, *kinds, pa.int32(), pa.int32(), pa.string()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        void = (None,) * width
        for batch in batches:
            kind_of_id = batch.column(0).type
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = build(text)
                if before is None:
                    rows.append((None, *void, part, 2, text))
                else:
                    rows.append((before[0], *_compared(before[1], before[2], text, tree), part, 0, None))
                before = (key, text, tree)
            if rows:
                yield batch_of(rows)
        if before is not None:
            yield batch_of([(before[0], *void, part, 1, before[1])])

    scanned = pin(ordered.mapInArrow(scan, schema))
    # One row per range, with no text: which range comes next.
    parts = scanned.where("kind = 2").select("part")
    by_part = Window.orderBy("part")
    following = parts.select(
        "part", F.lead("part").over(by_part).alias("later"), F.min("part").over(Window.partitionBy(F.lit(1))).alias("first")
    ).select("part", F.coalesce("later", "first").alias("next_part"))
    heads = scanned.where("kind = 2").select(F.col("part").alias("next_part"), F.col("message_utf8").alias("other"))
    tails = scanned.where("kind = 1").select("capture_id", "part", "message_utf8")
    edges = tails.join(following, "part").join(heads, "next_part").select("capture_id", "message_utf8", "other")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _compared(text, build(text), other, build(other))
                for text, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], names[: width + 1]
            )

    finished = edges.mapInArrow(finish, extended(source, ["capture_id"], _FIELDS))
    return scanned.where("kind = 0").select(names[: width + 1]).unionByName(finished)
