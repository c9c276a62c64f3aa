"""Byte-level BPE over payload texts: a merge-rank file becomes a sentencepiece model.

The vocabulary is a list of byte strings with ranks; merging always takes the pair whose
joined bytes have the lowest rank. A sentencepiece BPE model merges the pair with the highest
score, so a model whose pieces are the byte strings, spelled one visible character per byte,
scored by minus the rank and free of any normalisation, merges in the same order. It is
serialised here straight into sentencepiece's file format; nothing is trained.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.records import extended

#: Texts beyond this many characters are cut into pre-tokens lazily, so that memory stays bounded.
LONG_TEXT = 1 << 21
#: Pre-tokens whose ids are remembered in one task.
REMEMBERED = 50_000
#: Texts taken together.
PORTION = 256
#: Pre-tokens longer than this are encoded but not remembered.
REMEMBERED_LENGTH = 64


def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself if printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Parse a rank file: a base64 byte string and its rank on each line."""
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """Serialise the ranks as a sentencepiece BPE model.

    Field numbers are those of sentencepiece's public model format. Pieces come in rank
    order, so piece k is the k-th lowest rank; the piece for unknown text comes last and is
    never used, since every single byte is a piece.
    """
    letters = byte_alphabet()
    parts = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        piece = "".join(letters[b] for b in token).encode()
        parts.append(_chunk(1, _chunk(1, piece) + struct.pack("<Bf", 2 << 3 | 5, -float(rank))))
    unknown = _chunk(1, b"<unk>") + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _number(3, 2)
    parts.append(_chunk(1, unknown))
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _chunk(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(parts) + _chunk(2, trainer) + _chunk(3, normaliser)


class PretokenEncoder:
    """Ids of one pre-token at a time, as packed little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import sentencepiece

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.rank_of_piece = np.array([*sorted(ranks.values()), 0], dtype="<u4")
        self.letters = dict(enumerate(byte_alphabet()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pretokens: list[str]) -> dict[str, bytes]:
        found, spelled = {}, []
        for token in pretokens:
            raw = token.encode()
            rank = self.ranks.get(raw)
            if rank is not None:  # a pre-token that is itself in the vocabulary is never split
                found[token] = struct.pack("<I", rank)
            else:
                spelled.append((token, raw.decode("latin-1").translate(self.letters)))
        ids = self.model.encode([s for _, s in spelled], out_type=int, num_threads=1) if spelled else []
        for (token, _), pieces in zip(spelled, ids, strict=True):
            found[token] = self.rank_of_piece[pieces].tobytes()
        return found

    def encode(self, pretokens: list[str]) -> bytes:
        known = self.known
        new = [t for t in set(pretokens) if t not in known]
        if not new:
            return b"".join(map(known.__getitem__, pretokens))
        if len(known) > REMEMBERED // 2:
            # What came up since the last time is kept beside what comes up from now on.
            self.older, self.known = known, {}
            known, new = self.known, list(set(pretokens))
        older = self.older
        known.update(self._learn([t for t in new if t not in older]))
        known.update((t, older[t]) for t in new if t in older)
        packed = b"".join(map(known.__getitem__, pretokens))
        for token in new:
            if len(token) > REMEMBERED_LENGTH:
                del known[token]
        return packed


def _pretokens(pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    matches = (m.group() for m in pattern.finditer(text))
    while part := list(itertools.islice(matches, LONG_TEXT // 8)):
        yield part


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, PORTION) for batch in batches for k in range(0, batch.num_rows, PORTION))


class Decoder:
    """Bytes of ids: every id back to its piece, every character of it to its byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        letters = byte_alphabet()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        spelled = {rank: "".join(letters[b] for b in token) for token, rank in ranks.items()}
        self.bytes_of = {rank: bytes(byte_of[c] for c in piece) for rank, piece in spelled.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_payloads(payloads: DataFrame, rank_lines: bytes, pattern: str, decoded: bool = False) -> DataFrame:
    """Encode ``message_utf8`` of every payload.

    ``payloads(capture_id, message_utf8)`` -> ``(capture_id, n_tokens long, token_ids binary)``;
    ``token_ids`` holds little-endian unsigned 32-bit ids. ``rank_lines`` is the content of the
    rank file (a fixed vocabulary, below 1 MB), ``pattern`` cuts a text into pre-tokens, each of
    which is merged by itself. No special tokens: their spellings are ordinary text. With
    ``decoded`` the ids are decoded at once, which adds ``message_bytes`` as ``decode_payloads``
    does without another worker.

    Every input row gives one row, repeated rows included. A null or empty message has no
    tokens (0, empty binary). A null ``capture_id`` stays null. An empty table gives an empty
    table. Long messages are cut lazily, and their ids are the only thing that grows with them.
    """
    source = payloads.select("capture_id", F.coalesce("message_utf8", F.lit("")).alias("message_utf8"))
    schema = extended(source, ["capture_id"], "n_tokens long, token_ids binary" + ", message_bytes binary" * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks = read_ranks(rank_lines)
        encoder, cut = PretokenEncoder(ranks), regex.compile(pattern)
        decoder = Decoder(ranks) if decoded else None
        for batch in _portions(batches):
            packed = [
                b"".join(encoder.encode(part) for part in _pretokens(cut, text.as_py()))
                for text in batch.column(1)
            ]
            columns = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            if decoder is not None:
                columns.append(pa.array([decoder.decode(p) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def decode_payloads(encoded: DataFrame, rank_lines: bytes) -> DataFrame:
    """Invert ``encode_payloads``: every id back to its piece, every character to its byte.

    ``encoded(capture_id, token_ids)`` -> ``(capture_id, n_tokens, token_ids, message_bytes
    binary)``. Null ids decode to no bytes; an id outside the vocabulary raises.
    """
    source = encoded.select("capture_id", "n_tokens", F.coalesce("token_ids", F.lit(b"")).alias("token_ids"))
    schema = extended(source, source.columns, "message_bytes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(rank_lines))
        for batch in _portions(batches):
            decoded = [decoder.decode(ids.as_py()) for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], schema.names)

    return source.mapInArrow(run, schema)
