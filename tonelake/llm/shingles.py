"""Word-shingle sets of texts, many texts at a time.

Words are the runs of bytes between ASCII white space after A-Z are lower-cased. A shingle is
hashed as the bytes of its words joined by one blank: a polynomial over random byte values
modulo 2**64 makes the hash of any stretch a difference of two prefix sums, so whole batches
are hashed with array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes hashed together; a longer text is hashed in slices of about this length.
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of the splitmix64 generator)."""
    v = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


_BLANK = re.compile(r"[\t-\r ]")


class Shingler:
    def __init__(self, size: int = 5) -> None:
        self.size = size
        self.value_of_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, length: int) -> None:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            steps = np.ones((2, length), dtype=np.uint64)
            steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), inverse
            self.power, self.inverse = np.multiply.accumulate(steps, axis=1)

    def _chunks(self, texts: list[str | None]) -> Iterator[list[list[bytes]] | str]:
        """Words of texts, as many texts together as fit in CHUNK_BYTES; a longer text as it is."""
        chunk: list[list[bytes]] = []
        held = 0
        for text in texts:
            long = len(text or "") > CHUNK_BYTES
            words = [] if long else (text or "").encode().lower().split()
            length = sum(map(len, words)) + len(words)
            if chunk and (long or held + length > CHUNK_BYTES):
                yield chunk
                chunk, held = [], 0
            if long:
                yield text
                continue
            chunk.append(words)
            held += length
        if chunk:
            yield chunk

    def _hashes(self, chunk: list[list[bytes]], size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on, over all texts of a chunk, cut at its end."""
        data = np.frombuffer(b" ".join(b" ".join(words) for words in chunk if words) + b" ", dtype=np.uint8)
        if len(data) >= len(self.power):
            self._grow(len(data) + 1)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        with np.errstate(over="ignore"):
            terms = self.value_of_byte[data]
            terms *= self.power[: len(data)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            last = np.minimum(np.arange(len(ends)) + size - 1, len(ends) - 1)
            return mix((sums[ends[last]] - sums[starts]) * self.inverse[starts])

    def _long(self, text: str, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], list[bytes]]:
        """Hashes of the n-grams of a long text for each size, slice by slice, and its last words.

        A slice begins with the last words of the one before, as many as the longest n-gram needs.
        """
        found: list[list[np.ndarray]] = [[] for _ in sizes]
        carried: list[bytes] = []
        start = 0
        while start < len(text):
            blank = _BLANK.search(text, start + CHUNK_BYTES) if start + CHUNK_BYTES < len(text) else None
            end = blank.end() if blank else len(text)
            words = carried + text[start:end].encode().lower().split()
            for k, out in zip(sizes, found, strict=True):
                if len(words) >= k and len(words) > len(carried):
                    out.append(self._hashes([words], k)[max(0, len(carried) - k + 1) : len(words) - k + 1])
            carried = words[len(words) - max(sizes) + 1 :] if max(sizes) > 1 and len(words) >= max(sizes) else words[: max(sizes) - 1]
            start = end
        return [np.concatenate(out) if out else np.zeros(0, np.uint64) for out in found], carried

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of every text; of no words, an empty array."""
        none = np.zeros(0, dtype=np.uint64)
        out: list[np.ndarray] = []
        for chunk in self._chunks(texts):
            if isinstance(chunk, str):
                (hashes,), words = self._long(chunk, (self.size,))
                if not len(hashes) and words:
                    hashes = self._hashes([words], len(words))[:1]
                out.append(np.unique(hashes))
                continue
            if not any(chunk):
                out += [none] * len(chunk)
                continue
            whole, first = self._hashes(chunk, self.size), 0
            for words in chunk:
                n = len(words)
                if not n:
                    out.append(none)
                elif n < self.size:
                    out.append(self._hashes([words], n)[:1])
                else:
                    out.append(np.unique(whole[first : first + n - self.size + 1]))
                first += n
        return out

    def sequences(self, texts: list[str | None], sizes: tuple[int, ...]) -> list[tuple[np.ndarray, ...]]:
        """The hashes of the n-grams of every text in their order, one array for each n of ``sizes``."""
        out: list[tuple[np.ndarray, ...]] = []
        for chunk in self._chunks(texts):
            if isinstance(chunk, str):
                out.append(tuple(self._long(chunk, sizes)[0]))
                continue
            whole = [self._hashes(chunk, k) if any(chunk) else np.zeros(0, np.uint64) for k in sizes]
            first = 0
            for words in chunk:
                n = len(words)
                out.append(tuple(w[first : first + max(0, n - k + 1)] for w, k in zip(whole, sizes, strict=True)))
                first += n
        return out


def set_hash(shingles: np.ndarray) -> int:
    """One signed 64-bit value for a whole set; equal sets have equal values."""
    with np.errstate(over="ignore"):
        total = np.sum(mix(shingles + np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)
        total = mix(np.array([total + np.uint64(len(shingles))], dtype=np.uint64))[0]
    return int(total.view(np.int64))
