"""Byte-level BPE over payload texts, with chunks that several messages share encoded once.

A text is cut into chunks where a rolling hash of the last bytes says so; the places depend on
content alone, so messages with common passages have common chunks. Digests of chunks are
counted over all messages. A chunk met twice or more is encoded by one owner and its ids are
joined to every message that has it; all other stretches are encoded where they stand.

Ids of neighbouring stretches can't just be strung together: a pre-token may lie across their
border. Each join is repaired by encoding a window around it again. The window starts at a
pre-token of the left side that the border can't reach, and is widened to the right until one
of its pre-tokens begins where one of the right stretch does; from there on both agree.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.records import extended
from tonelake.session import pin

#: A chunk ends where the hash of the last ``WINDOW`` bytes has ``CHUNK_BITS`` bits zero, after ``LEAST``
#: bytes at the earliest, 1 280 bytes on average; a stretch without such a place is cut every ``MOST`` bytes.
WINDOW, CHUNK_BITS, LEAST, MOST = 16, 10, 256, 1 << 14
#: Stretches that no other message has are encoded in runs of about this many bytes.
RUN = 1 << 16
#: Texts handed to the tokenizer at once, in bytes.
BATCH = 1 << 18
#: Pre-tokens whose ids are remembered in one worker, about 170 bytes each; longer ones are encoded each time.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: No pre-token rule looks further ahead than this; a longer special token adds to it.
AHEAD = 16

# Fixed value: the cut into pre-tokens of byte-level vocabularies, as published with them, but for the
# order: letters and numbers, the frequent kinds, are tried before the endings, which begin with an apostrophe.
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in texts of ASCII characters only.
ASCII_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Marks the first id of a pre-token while ids are put together.
_FIRST = 1 << 31


def _scatter(n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers without pattern."""
    words = [hashlib.blake2b(bytes([k]), digest_size=8, person=b"chunks").digest() for k in range(n)]
    return np.frombuffer(b"".join(words), "<u8")


_VALUE_OF_BYTE = _scatter(256)
#: Bytes hashed at a time, so that scratch memory doesn't grow with the text.
_SLICE = 1 << 20


def _candidates(raw: np.ndarray) -> Iterator[int]:
    """Places after which a chunk may end, ascending: the hash is zero and the next byte starts a character."""
    for start in range(0, len(raw), _SLICE):
        first = max(0, start - WINDOW + 1)
        part = raw[first : start + _SLICE]
        rolling = _VALUE_OF_BYTE[part]
        reach = 1
        while reach < WINDOW:
            longer = rolling.copy()
            longer[reach:] += rolling[:-reach] << np.uint64(reach)
            rolling, reach = longer, 2 * reach
        # Bits above the window's shifts depend on all of its bytes.
        hit = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64((1 << CHUNK_BITS) - 1) == 0) + first + 1
        hit = hit[(hit > start) & (hit < len(raw))]
        yield from hit[raw[hit] & 0xC0 != 0x80].tolist()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last one is its length."""
    raw = np.frombuffer(data, np.uint8)
    ends, start = [], 0

    def long_stretch(end: int) -> None:
        nonlocal start
        while end - start > MOST:
            place = start + MOST
            while place > start + 1 and raw[place] & 0xC0 == 0x80:
                place -= 1
            ends.append(place)
            start = place

    for place in _candidates(raw):
        long_stretch(place)
        if place - start >= LEAST:
            ends.append(place)
            start = place
    long_stretch(len(raw))
    if len(raw) > start:
        ends.append(len(raw))
    return ends


def _key(capture_id, data: bytes) -> tuple[int, int]:
    """128 bits that name a record: equal for equal ids with equal texts only."""
    digest = hashlib.blake2b(data, digest_size=16, key=hashlib.blake2b(repr(capture_id).encode()).digest()).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def byte_of_letter() -> dict[str, int]:
    """The visible character that a byte-level vocabulary writes for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {chr(b) if b in plain else chr(next(others)): b for b in range(256)}


def token_bytes(parsed: dict) -> dict[int, bytes]:
    """The bytes that each id of a parsed tokenizer file stands for; added tokens are spelled as they are."""
    letters = byte_of_letter()
    own = {number: bytes(map(letters.__getitem__, token)) for token, number in parsed["model"]["vocab"].items() if letters.keys() >= set(token)}
    odd = {number: token.encode() for token, number in parsed["model"]["vocab"].items() if number not in own}
    return own | odd | {t["id"]: t["content"].encode() for t in parsed.get("added_tokens") or []}


def token_sizes(spelled: dict[int, bytes]) -> np.ndarray:
    sizes = np.zeros(max(spelled) + 1, np.int64)
    for number, token in spelled.items():
        sizes[number] = len(token)
    return sizes


def decode(spelled: dict[int, bytes], ids: np.ndarray) -> bytes:
    """The library's text for the ids, in UTF-8; broken characters are replaced as it does."""
    return b"".join(map(spelled.__getitem__, ids.tolist())).decode(errors="replace").encode()


class _Known(dict):
    """A dict that asks for what it does not hold."""

    def __init__(self, ask: Callable[[str], bytes]) -> None:
        self.ask = ask

    def __missing__(self, token: str) -> bytes:
        return self.ask(token)


class Tokenizer:
    """A byte-level BPE tokenizer file, with the places where pre-tokens begin.

    Pre-tokens are cut here, and the ids of the frequent ones remembered; others are encoded by
    the library. A text with a character that the library puts in another class than the pattern
    does (classes differ between Unicode versions) is left to the library as a whole.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        import tokenizers

        parsed = json.loads(definition)
        cutter, added = parsed.get("pre_tokenizer") or {}, parsed.get("added_tokens") or []
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        if parsed.get("normalizer") or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("chunks can be joined for a plain byte-level vocabulary without normaliser or prefix space only")
        self.library = tokenizers.Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = {b: letter for letter, b in byte_of_letter().items()}
        self.spelled = token_bytes(parsed)
        self.size = token_sizes(self.spelled)
        self.special = {t["content"]: t["id"] for t in added}
        self.margin = max([AHEAD, *(len(s.encode()) + 3 for s in self.special)])
        self.pattern = regex.compile(PATTERN)
        self.ascii_pattern = re.compile(ASCII_PATTERN, re.ASCII)
        spelled = sorted(self.special, key=len, reverse=True)
        self.around = regex.compile("(" + "|".join(map(regex.escape, spelled)) + ")") if spelled else None
        self.agree: dict[str, bool] = {}
        self.known: dict[str, bytes] = _Known(self._learn)
        self.older: dict[str, bytes] = {}

    def _agrees(self, character: str) -> bool:
        probe = "a{0}1{0}{0} {0}.{0}\n".format(character)
        cut = [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
        return cut == self.pattern.findall(probe)

    def _ours(self, text: str) -> bool:
        if text.isascii():
            return True
        for character in set(text) - self.agree.keys():
            self.agree[character] = self._agrees(character)
        return all(map(self.agree.__getitem__, set(text)))

    def _learn(self, token: str) -> bytes:
        """Packed ids of a pre-token that is not known, the first one marked."""
        packed = self.older.get(token)
        if packed is None:
            spelled = token.encode().decode("latin-1").translate(self.letters)
            ids = [piece.id for piece in self.model.tokenize(spelled)]
            ids[:1] = [number | _FIRST for number in ids[:1]]
            packed = b"".join([number.to_bytes(4, "little") for number in ids])
        if len(token) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED // 2:
                # What came up since the last time is kept beside what comes up from now on.
                self.older = dict(self.known)
                self.known.clear()
            self.known[token] = packed
        return packed

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = self.around.split(text) if self.around and any(s in text for s in self.special) else [text]
        pattern = self.ascii_pattern if text.isascii() else self.pattern
        packed: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:  # a special token, matched before anything is cut
                packed.append((self.special[part] | _FIRST).to_bytes(4, "little"))
            else:
                packed += map(self.known.__getitem__, pattern.findall(part))
        marked = np.frombuffer(b"".join(packed), "<u4")
        return (marked & (_FIRST - 1)).astype(np.int32), marked >= _FIRST

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text, and whether each id is the first of a pre-token."""
        found = []
        for text in map(bytes.decode, texts):
            if self._ours(text):
                found.append(self._encode(text))
                continue
            encoding = self.library.encode(text, add_special_tokens=False)
            ids = np.array(encoding.ids, np.int32)
            word = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
            found.append((ids, np.concatenate([[True], word[1:] != word[:-1]]) if len(ids) else np.zeros(0, bool)))
        return found


@functools.lru_cache(maxsize=1)
def _tokenizer(definition: str) -> Tokenizer:
    """One for all tasks of a worker: the file is parsed once, and what is remembered serves the next task."""
    return Tokenizer(definition)


class _Stretch:
    """Ids of ``data[start:end]`` and whether each is the first of a pre-token."""

    def __init__(self, tokenizer: Tokenizer, start: int, ids: np.ndarray, first: np.ndarray) -> None:
        self.size, self.start, self.ids, self.first = tokenizer.size, start, ids, first
        self.end = start + int(self.size[ids].sum())

    def places(self) -> np.ndarray:
        """The byte at which each id begins."""
        width = self.size[self.ids]
        return self.start + np.cumsum(width) - width

    def cut(self, low: int, high: int) -> None:
        """Keep the ids that begin in ``[low, high)``, both of them places or the end."""
        i, j = np.searchsorted(self.places(), [low, high])
        self.ids, self.first = self.ids[i:j], self.first[i:j]
        self.start, self.end = max(self.start, low), min(self.end, high)

    def borders(self) -> np.ndarray:
        return self.places()[self.first]


def join_stretches(tokenizer: Tokenizer, data: bytes, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Ids of ``data`` from the ids of consecutive stretches ``(start, ids, first-of-pre-token)``.

    A border that ends ``margin`` bytes before the end of the left side holds whatever follows.
    At or after the border of the two, a place where both the window and the right stretch begin
    a pre-token, ``margin`` bytes before the window's end, is one of the whole text, and cutting
    goes on from it without looking back.
    """
    margin = tokenizer.margin
    done: list[_Stretch] = []
    for start, ids, first in parts:
        right = _Stretch(tokenizer, start, ids, first)
        if not len(right.ids):
            continue
        if not done:
            done.append(right)
            continue
        low = 0
        while done:
            safe = done[-1].borders()
            safe = safe[safe <= start - margin]
            if len(safe):
                low = int(safe[-1])
                break
            done.pop()
        if done:
            done[-1].cut(0, low)
        reach, meet, window = 2 * margin, None, None
        borders = right.borders()
        while meet is None:
            beyond = borders[borders >= start + reach]
            high = int(beyond[0]) if len(beyond) else right.end
            window = _Stretch(tokenizer, low, *tokenizer.encode([data[low:high]])[0])
            common = np.intersect1d(window.borders(), borders)
            common = common[common <= high - margin]
            if len(common):
                meet = int(common[0])
            elif high == right.end:
                break
            reach *= 4
        if meet is not None:
            window.cut(low, meet)
            right.cut(meet, right.end)
            done += [window, right]
        else:
            done.append(window)
    return np.concatenate([d.ids for d in done]) if done else np.zeros(0, np.int32)


def _record_bytes(text) -> bytes:
    return (text.as_py() or "").encode()


def _chunk_refs(payloads: DataFrame) -> DataFrame:
    """A row per chunk: the record's key, the place of the chunk in it, the chunk's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "place", "d1", "d2"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                keys, places, digests = [], [], []
                for capture_id, text in zip(batch.column(0)[begin : begin + 256], batch.column(1)[begin : begin + 256]):
                    data = _record_bytes(text)
                    ends = cuts(data)
                    keys += [_key(capture_id.as_py(), data)] * len(ends)
                    places += range(len(ends))
                    digests += [
                        hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)
                    ]
                key = np.array(keys, np.int64).reshape(-1, 2)
                digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [key[:, 0], key[:, 1], np.array(places, np.int32), digest[:, 0], digest[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return payloads.mapInArrow(run, "k1 long not null, k2 long not null, place int, d1 long, d2 long")


def _packed(payloads: DataFrame) -> DataFrame:
    """A row per record: its key and its text, compressed since it is dealt out by that key."""
    schema = extended(payloads, ["capture_id"], "k1 long not null, k2 long not null, packed binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                data = [_record_bytes(text) for text in part.column(1)]
                key = [_key(capture_id.as_py(), d) for capture_id, d in zip(part.column(0), data)]
                columns = [
                    part.column(0),
                    pa.array([k[0] for k in key], pa.int64()),
                    pa.array([k[1] for k in key], pa.int64()),
                    pa.array([press.compress(d) for d in data], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return payloads.mapInArrow(run, schema)


def _encode_owned(owned: DataFrame, definition: str) -> DataFrame:
    """Ids of the chunks at ``places`` of each packed text, with a bit per id for the begin of a pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokenizer, unpress = _tokenizer(definition), zstandard.ZstdDecompressor()

        def rows(chunks: list[bytes]) -> pa.RecordBatch:
            digest = [hashlib.blake2b(c, digest_size=16).digest() for c in chunks]
            number = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            encoded = tokenizer.encode(chunks)
            width = "<u2" if len(tokenizer.size) <= 1 << 16 else "<u4"
            columns = [
                pa.array(number[:, 0]),
                pa.array(number[:, 1]),
                pa.array([ids.astype(width).tobytes() for ids, _ in encoded], pa.binary()),
                pa.array([np.packbits(first).tobytes() for _, first in encoded], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["d1", "d2", "ids", "first"])

        for batch in batches:
            waiting, held = [], 0
            for packed, places in zip(batch.column(1), batch.column(2)):
                data = unpress.decompress(packed.as_py())
                ends = [0, *cuts(data)]
                for place in set(places.as_py()):
                    waiting.append(data[ends[place] : ends[place + 1]])
                    held += len(waiting[-1])
                    if held > BATCH:
                        yield rows(waiting)
                        waiting, held = [], 0
            if waiting:
                yield rows(waiting)

    # The id is read for nothing but that both readers of the texts share one exchange.
    return owned.select("capture_id", "packed", "places").mapInArrow(run, "d1 long, d2 long, ids binary, first binary")


def _assemble(texts: DataFrame, definition: str, decoded: bool) -> DataFrame:
    """Ids of whole texts: shared chunks as given, other runs encoded here, joins repaired."""
    schema = extended(texts, ["capture_id"], "n_tokens long, token_ids binary" + ", message_bytes binary" * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokenizer, unpress = _tokenizer(definition), zstandard.ZstdDecompressor()
        width = "<u2" if len(tokenizer.size) <= 1 << 16 else "<u4"

        def stretches(data: bytes, given: dict) -> list[list]:
            """Consecutive ``[start, end, ids, first]``; ids are None for runs to be encoded."""
            found: list[list] = []
            for place, (a, b) in enumerate(zip([0, *(ends := cuts(data))], ends)):
                if place in given:
                    ids = np.frombuffer(given[place][0], width).astype(np.int32)
                    first = np.unpackbits(np.frombuffer(given[place][1], np.uint8), count=len(ids)).astype(bool)
                    found.append([a, b, ids, first])
                elif found and found[-1][2] is None and b - found[-1][0] <= RUN:
                    found[-1][1] = b
                else:
                    found.append([a, b, None, None])
            return found

        def finished(ids_in: list, waiting: list) -> pa.RecordBatch:
            # Runs of several texts go to the tokenizer together, in portions of bounded size.
            todo = [(data, s) for data, parts in waiting for s in parts if s[2] is None]
            portion, held = [], 0
            for k, (data, s) in enumerate(todo):
                portion.append((data, s))
                held += s[1] - s[0]
                if held > BATCH or k + 1 == len(todo):
                    for (_, run_), (ids, first) in zip(portion, tokenizer.encode([d[r[0] : r[1]] for d, r in portion])):
                        run_[2:] = [ids, first]
                    portion, held = [], 0
            whole, back = [], []
            for data, parts in waiting:
                ids = join_stretches(tokenizer, data, [(s[0], s[2], s[3]) for s in parts])
                if tokenizer.size[ids].sum() != len(data):
                    raise ValueError("ids do not spell the text they stand for")
                whole.append(ids.astype("<u4").tobytes())
                back += [decode(tokenizer.spelled, ids)] if decoded else []
            columns = [pa.array(ids_in, schema_of_id), pa.array([len(w) // 4 for w in whole], pa.int64()), pa.array(whole, pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(back, pa.binary())] if decoded else [])], schema.names)

        for batch in batches:
            schema_of_id = batch.schema.field(0).type
            ids_in, waiting, held = [], [], 0
            for capture_id, packed, given in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = unpress.decompress(packed.as_py())
                shared = {g["place"]: (g["ids"], g["first"]) for g in given.as_py() or []}
                ids_in.append(capture_id.as_py())
                waiting.append((data, stretches(data, shared)))
                held += len(data)
                if held > BATCH:
                    yield finished(ids_in, waiting)
                    ids_in, waiting, held = [], [], 0
            if waiting:
                yield finished(ids_in, waiting)

    return texts.mapInArrow(run, schema)


def encode_payloads(payloads: DataFrame, definition: str, decoded: bool = False) -> DataFrame:
    """Encode ``message_utf8`` of every payload as the tokenizers library does.

    ``payloads(capture_id, message_utf8)`` -> ``(capture_id, n_tokens long, token_ids binary)``;
    ``token_ids`` holds little-endian unsigned 32-bit ids. With ``decoded`` they are decoded at
    once, which gives ``message_bytes`` as ``decode_payloads`` does without another worker. ``definition`` is the content of a
    tokenizer file: a byte-level BPE vocabulary without normaliser (a fixed file of a few MB).
    No special tokens are added; spellings of special tokens in a text become their ids, as the
    library does by default.

    Every input row gives one row, repeated rows included. A null or empty message has no
    tokens (0, empty binary). A null ``capture_id`` stays null. An empty table gives an empty
    table. Long texts are cut into runs, so that only text and ids grow with them. Texts without
    any place to cut are cut at fixed distances; the joins make up for it.

    Records are named by 128 bits of id and text, chunks by 128 bits of content. Digests are
    counted with partial sums; a chunk in very many messages is a hot key of the join of ids,
    which adaptive execution splits. Texts are dealt out once, by key, and read twice: by
    owners of shared chunks and by the final step.
    """
    source = payloads.select("capture_id", "message_utf8")
    refs = pin(_chunk_refs(source))
    shared = refs.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("uses"), F.min("k1").alias("owner")).where("uses > 1")
    uses = refs.join(shared.select("d1", "d2", "owner"), ["d1", "d2"])
    texts = _packed(source)
    owned = uses.where("k1 = owner").groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    encoded = _encode_owned(texts.join(owned, ["k1", "k2"]), definition)
    once = encoded.groupBy("d1", "d2").agg(F.first("ids").alias("ids"), F.first("first").alias("first"))
    given = refs.join(once, ["d1", "d2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "ids", "first")).alias("given"))
    return _assemble(texts.join(given, ["k1", "k2"], "left").select("capture_id", "packed", "given"), definition, decoded)


def decode_payloads(encoded: DataFrame, definition: str) -> DataFrame:
    """Decode ``token_ids``, special tokens included.

    ``encoded(capture_id, n_tokens, token_ids)`` -> the same with ``message_bytes binary``, UTF-8
    of the text that the library's ``decode`` returns. Null ids decode to no bytes; an id outside
    the vocabulary raises.
    """
    source = encoded.select("capture_id", "n_tokens", F.coalesce("token_ids", F.lit(b"")).alias("token_ids"))
    schema = extended(source, source.columns, "message_bytes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = token_bytes(json.loads(definition))
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                decoded = [decode(spelled, np.frombuffer(ids.as_py(), "<u4")) for ids in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], schema.names)

    return source.mapInArrow(run, schema)
