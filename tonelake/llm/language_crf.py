"""Languages of the words of payload texts by a linear-chain conditional random field.

Texts may switch language from word to word. The field labels every word: its score for a
language comes from affixes, character n-grams and lexicons of frequent words, the score of
two neighbours from learned transitions, and the forward-backward recursion gives every word
its probability for each language. The language of a text is that of most of its words'
probability.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.records import extended
from tonelake.llm.sampling import bounded_sample

#: Labelled rows that the field is fitted on, at most.
SAMPLE_ROWS = 3_000
BUCKETS = 1 << 16
LEXICON_WORDS = 300
#: Training sequences: length, and words between switches of language within one.
SEQUENCE, STRETCH = 48, 12
STEPS, BATCH = 250, 64
#: A letter with the marks on it, again and again; longer runs are read in parts.
WORD = r"\p{L}[\p{L}\p{M}]{0,99}"
REMEMBERED = 150_000
#: Words whose recursions run side by side.
GROUP_WORDS = 400_000
#: A text of more words is cut into stretches; characters of a text that are read at a time.
LONG_WORDS = 16_384
SLICE = 1 << 20


def features_of(word: str, lexicon: dict[str, int]) -> list[int]:
    """Buckets of a lower-case word: prefixes, suffixes, inner n-grams, and the lexicons that list it."""
    names = [f"<{word[:k]}" for k in (1, 2, 3) if len(word) >= k]
    names += [f"{word[-k:]}>" for k in (1, 2, 3) if len(word) >= k]
    names += [f"={word[k : k + n]}" for n in (2, 3) for k in range(len(word) - n + 1)]
    listed = lexicon.get(word, 0)
    names += [f"lexicon {k}" for k in range(listed.bit_length()) if listed >> k & 1]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


@dataclass(frozen=True)
class Field:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # languages x languages
    start: np.ndarray
    lexicon: dict[str, int]

    def scores(self, words: list[str]) -> np.ndarray:
        """The emission scores of lower-case words."""
        rows = [features_of(w, self.lexicon) for w in words]
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
        return np.add.reduceat(self.weights[flat], starts, axis=0) if rows else np.zeros((0, len(self.languages)))


def marginals(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray, expected: bool = True):
    """Forward-backward over sequences side by side.

    ``emissions`` is (time, sequence, language), sequences sorted from long to short by
    ``lengths``. Returns the probabilities of each language at each place, the expected
    transitions (zeros unless ``expected``), and the log likelihood denominators. Messages are
    scaled at each step.
    """
    steps, count, size = emissions.shape
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    peak = emissions.max(axis=2, keepdims=True)
    local, move = np.exp(emissions - peak), np.exp(transitions)
    forward, backward = np.zeros_like(local), np.ones_like(local)
    scale = np.ones((steps, count))
    for t in range(steps):
        n = alive[t]
        step = np.exp(start) * local[0, :n] if t == 0 else (forward[t - 1, :n] @ move) * local[t, :n]
        scale[t, :n] = step.sum(axis=1)
        forward[t, :n] = step / scale[t, :n, None]
    for t in range(steps - 2, -1, -1):
        n = alive[t + 1]
        backward[t, :n] = ((backward[t + 1, :n] * local[t + 1, :n]) @ move.T) / scale[t + 1, :n, None]
    place = forward * backward
    place /= np.maximum(place.sum(axis=2, keepdims=True), 1e-300)
    pairs = np.zeros((size, size))
    if steps > 1 and expected:
        inner = forward[:-1] / scale[1:, :, None] * (np.arange(1, steps)[:, None] < lengths)[:, :, None]
        after = backward[1:] * local[1:]
        pairs = move * np.einsum("tbi,tbj->ij", inner, after)
    inside = np.arange(steps)[:, None] < lengths
    return place * inside[:, :, None], pairs, (np.log(scale) + peak[:, :, 0])[inside].sum()


def fit_field(texts: list[list[str]], labels: list[str], seed: int = 0) -> Field:
    """Fit on words of texts and the language of each text.

    Training sequences splice stretches of texts of different languages, as code-switched
    texts do, so that transitions are learned along with the words. Adam on the conditional
    log likelihood; the same input gives the same field.
    """
    languages = sorted(set(labels))
    size = len(languages)
    number = {name: k for k, name in enumerate(languages)}
    by_language: list[list[list[str]]] = [[] for _ in languages]
    for words, label in zip(texts, labels, strict=True):
        if words:
            by_language[number[label]].append(words)
    lexicon: dict[str, int] = {}
    for k, rows in enumerate(by_language):
        counts = Counter(w for words in rows for w in set(words))
        for word, _ in sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:LEXICON_WORDS]:
            lexicon[word] = lexicon.get(word, 0) | 1 << k
    weights, transitions, start = np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size)
    present = [k for k in range(size) if by_language[k]]
    if size < 2 or not present:
        return Field(languages, weights, transitions, start, lexicon)
    rng = np.random.default_rng(seed)
    known: dict[str, list[int]] = {}
    slots = [np.zeros((2, *p.shape)) for p in (weights, transitions, start)]
    for step in range(1, STEPS + 1):
        buckets, owner, truth = [], [], np.zeros((SEQUENCE, BATCH), np.int64)
        for b in range(BATCH):
            t = 0
            while t < SEQUENCE:
                k = present[rng.integers(len(present))]
                words = by_language[k][rng.integers(len(by_language[k]))]
                at = rng.integers(len(words))
                for word in words[at : at + min(STRETCH * (1 + rng.integers(4)), SEQUENCE - t)]:
                    if word not in known:
                        known[word] = features_of(word, lexicon)
                    buckets += known[word]
                    owner += [t * BATCH + b] * len(known[word])
                    truth[t, b] = k
                    t += 1
        buckets_, owner_ = np.array(buckets), np.array(owner)
        emissions = np.zeros((SEQUENCE * BATCH, size))
        np.add.at(emissions, owner_, weights[buckets_])
        emissions = emissions.reshape(SEQUENCE, BATCH, size)
        place, pairs, _ = marginals(emissions, transitions, start, np.full(BATCH, SEQUENCE))
        off = place.copy()
        np.subtract.at(off.reshape(-1, size), (np.arange(SEQUENCE * BATCH), truth.reshape(-1)), 1.0)
        for x, y in zip(truth[:-1].reshape(-1), truth[1:].reshape(-1), strict=True):
            pairs[x, y] -= 1
        slope = np.zeros_like(weights)
        np.add.at(slope, buckets_, off.reshape(-1, size)[owner_])
        slopes = (slope / BATCH + 1e-4 * weights, pairs / BATCH + 1e-4 * transitions, off[0].sum(axis=0) / BATCH)
        for value, slot, g in zip((weights, transitions, start), slots, slopes, strict=True):
            slot[0] = 0.9 * slot[0] + 0.1 * g
            slot[1] = 0.999 * slot[1] + 0.001 * g * g
            value -= 0.05 * (slot[0] / (1 - 0.9**step)) / (np.sqrt(slot[1] / (1 - 0.999**step)) + 1e-8)
    return Field(languages, weights.astype(np.float32), transitions, start, lexicon)


def long_shares(field: Field, words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean word probabilities of a long text, with the loops over places within stretches that run side by side.

    A stretch is a product of matrices; the products of all stretches give the messages that
    enter each of them from both ends, and with these each stretch is labelled by itself. Exact,
    with a number of steps and scratch memory of about the square root of the length.
    """
    move, size = np.exp(field.transitions), len(field.languages)
    length = int(np.ceil(np.sqrt(len(words))))
    count = -(-len(words) // length)
    together = max(1, GROUP_WORDS // length)

    def stretches(first: int) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, place, language) factors, and which places exist, from stretch ``first`` on."""
        part = words[first * length : (first + together) * length]
        here = -(-len(part) // length)
        scores = np.zeros((here * length, size))
        scores[: len(part)] = table[part]
        local = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(here, length, size)
        return local, (np.arange(here * length) < len(part)).reshape(here, length)

    ahead, back = np.empty((count, size, size)), np.empty((count, size, size))
    for first in range(0, count, together):
        local, exists = stretches(first)
        one = np.broadcast_to(np.eye(size), (len(local), size, size)).copy()
        two = one.copy()
        for t in range(length):
            on, off = exists[:, t], exists[:, length - 1 - t]
            one[on] = (one[on] * local[on, t, None, :]) @ move
            two[off] = move @ (local[off, length - 1 - t, :, None] * two[off])
            one /= one.max(axis=(1, 2), keepdims=True)
            two /= two.max(axis=(1, 2), keepdims=True)
        ahead[first : first + len(local)], back[first : first + len(local)] = one, two
    enter, leave = np.empty((count, size)), np.ones((count, size))
    message = np.exp(field.start)
    for k in range(count):
        enter[k] = message
        message = message @ ahead[k]
        message = message / message.sum()
    for k in range(count - 2, -1, -1):
        message = back[k + 1] @ leave[k + 1]
        leave[k] = message / message.sum()
    total = np.zeros(size)
    for first in range(0, count, together):
        local, exists = stretches(first)
        forward, backward = np.empty_like(local), np.ones_like(local)
        message, behind = enter[first : first + len(local)], leave[first : first + len(local)].copy()
        for t in range(length):
            forward[:, t] = message * local[:, t]
            message = forward[:, t] @ move
            message = message / message.sum(axis=1, keepdims=True)
        for t in range(length - 1, -1, -1):
            on = exists[:, t]
            backward[on, t] = behind[on]
            behind[on] = (local[on, t] * behind[on]) @ move.T
            behind /= behind.sum(axis=1, keepdims=True)
        place = forward * backward
        place /= np.maximum(place.sum(axis=2, keepdims=True), 1e-300)
        total += place[exists].sum(axis=0)
    return total / len(words)


def label_texts(field: Field, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Mean word probabilities per text, given as places in the emission ``table``."""
    out = np.zeros((len(texts), len(field.languages)))
    order = sorted((k for k in range(len(texts)) if len(texts[k])), key=lambda k: -len(texts[k]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        if longest > LONG_WORDS:
            out[order[at]] = long_shares(field, np.asarray(texts[order[at]]), table)
            at += 1
            continue
        part = order[at : at + max(1, GROUP_WORDS // longest)]
        at += len(part)
        lengths = np.array([len(texts[k]) for k in part])
        emissions = np.zeros((longest, len(part), len(field.languages)))
        for b, k in enumerate(part):
            emissions[: lengths[b], b] = table[texts[k]]
        place, _, _ = marginals(emissions, field.transitions, field.start, lengths, expected=False)
        out[part] = place.sum(axis=0) / lengths[:, None]
    return out


#: Between words, where a long text may be cut.
_BLANK = re.compile(r"\s")


def _slices(text: str) -> Iterator[str]:
    """A text in lower case; a long one in slices that end after white space."""
    start = 0
    while len(text) - start > SLICE:
        blank = _BLANK.search(text, start + SLICE)
        if blank is None:
            break
        yield text[start : blank.end()].lower()
        start = blank.end()
    yield text[start:].lower()


def label_languages(payloads: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``payloads(capture_id, message_utf8)`` and ``labels(capture_id, language)`` ->
    ``(capture_id, n_words long, language string, score double)``.

    ``language`` is the one with the largest mean probability over the words, ``score`` that
    mean. The field is fitted on at most ``sample_rows`` labelled rows: lexicons count all their
    words, training stretches are drawn from whole texts. Every word of every row is labelled.

    Every input row gives one row, repeated rows included; equal texts get equal results. A
    null text or one without a letter is ``und`` with score 0. Ties go to the language that
    comes first by code point. Null labels and labels of unknown rows are passed over; without
    labels every text is ``und``. A null ``capture_id`` is labelled and never matched with a
    label. An empty table gives an empty table.
    """
    import regex

    known = labels.where("capture_id IS NOT NULL AND language IS NOT NULL").groupBy("capture_id").agg(
        F.min("language").alias("language")
    )
    sample = bounded_sample(known, F.col("capture_id").cast("string"), sample_rows)
    source = payloads.select("capture_id", "message_utf8")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(WORD).findall
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(" ".join(find((text or "").lower())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["capture_id", "words"])

    # At most sample_rows rows of an id and a label.
    wanted = source.join(F.broadcast(sample.select("capture_id")), "capture_id", "left_semi")
    gathered = (
        wanted.mapInArrow(split, extended(source, ["capture_id"], "words string"))
        .join(F.broadcast(sample), "capture_id")
        .select(F.xxhash64(F.col("capture_id").cast("string")).alias("mixed"), "words", "language")
        .dropDuplicates(["mixed"])
        .toPandas()
        .sort_values("mixed")
    )
    # Equal words are one string.
    field = fit_field([list(map(sys.intern, w.split())) for w in gathered["words"]], gathered["language"].tolist())
    model = payloads.sparkSession.sparkContext.broadcast(
        (field.languages, field.weights, field.transitions, field.start, field.lexicon)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        find = regex.compile(WORD).findall
        seen: dict[str, int] = {}
        table = np.zeros((1024, len(field.languages)), np.float32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, names, scores = [], [], []
            for first in range(0, len(texts), 512):
                if len(seen) > REMEMBERED:
                    seen.clear()
                rows = []
                for text in texts[first : first + 512]:
                    parts = []
                    for part in _slices(text or ""):
                        words = find(part)
                        new = [w for w in set(words) if w not in seen]
                        if new:
                            while len(seen) + len(new) > len(table):
                                table = np.concatenate([table, np.zeros_like(table)])
                            table[len(seen) : len(seen) + len(new)] = field.scores(new)
                            seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                        parts.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                    rows.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
                shares = label_texts(field, rows, table) if field.languages else np.zeros((len(rows), 1))
                best = shares.argmax(axis=1)
                for k, row in enumerate(rows):
                    labelled = bool(len(row)) and bool(field.languages)
                    counts.append(len(row))
                    names.append(field.languages[best[k]] if labelled else "und")
                    scores.append(float(min(1.0, shares[k, best[k]])) if labelled else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["capture_id", "n_words", "language", "score"],
            )

    return source.mapInArrow(run, extended(source, ["capture_id"], "n_words long, language string, score double"))
