"""Quality of payload texts by attention-based multiple-instance learning.

A text is a bag of passages; only the bag has a label. Every passage is encoded by measures
that hold for any language and by a learned layer. A gated attention network learns from the
labels of the bags which passages matter, and the score is a logistic function of the
attention-weighted mean of the encodings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.records import extended
from tonelake.llm.sampling import bounded_sample

#: Labelled rows that the network is fitted on, at most.
SAMPLE_ROWS = 6_000
PASSAGE_WORDS = 64
HIDDEN, GATES = 16, 8
EPOCHS, BATCH = 30, 128

#: Classes of bytes whose share is a measure each.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b".,;:?",
    b"!",
    b"|",
    b"#*$%&<>",
    b"@/\\_=+~^`'\"()[]{}-",
    bytes(range(128, 256)),
)
MEASURES = len(_CLASSES) + 7


def encode_passages(text: str | None) -> np.ndarray:
    """One row of measures per passage of PASSAGE_WORDS words; a text without words has one passage of zeros.

    Measures: share of bytes by class, mean length and spread of words, how full the passage
    is, distinct words, words equal to the one before, the most frequent word, and whether the
    passage has words at all.
    """
    words = (text or "").encode().split()
    rows = []
    for k in range(0, len(words), PASSAGE_WORDS):
        part = words[k : k + PASSAGE_WORDS]
        data = b"".join(part)
        n, size = len(part), len(data)
        lengths = list(map(len, part))
        mean = size / n
        spread = (sum(x * x for x in lengths) / n - mean * mean) ** 0.5 if n > 1 else 0.0
        distinct = set(part)
        most = max(Counter(part).values())
        row = [(size - len(data.translate(None, c))) / size for c in _CLASSES]
        row += [
            min(mean, 40.0) / 10, min(abs(spread), 40.0) / 10, n / PASSAGE_WORDS, len(distinct) / n,
            sum(map(eq, part, part[1:])) / n, most / n, 1.0,
        ]
        rows.append(row)
    return np.array(rows or [[0.0] * MEASURES], np.float32)


class Network:
    """Encoder, gated attention and logistic output with their gradients.

    h = tanh(x E + e); a = softmax over the bag of (tanh(h V) * sigmoid(h U)) w;
    score = sigmoid((sum a h) c + d).
    """

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @staticmethod
    def fresh(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)

        def table(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        return Network(
            {
                "shift": np.zeros(MEASURES), "scale": np.ones(MEASURES), "E": table(MEASURES, HIDDEN), "e": np.zeros(HIDDEN),
                "V": table(HIDDEN, GATES), "U": table(HIDDEN, GATES), "w": table(GATES), "c": table(HIDDEN), "d": np.zeros(1),
            }
        )

    def forward(self, passages: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``starts``: where each bag begins; no bag is empty."""
        w = self.w
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(passages))))
        x = (passages - w["shift"]) / w["scale"]
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (t * g) @ w["w"]
        power = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        a = power / np.add.reduceat(power, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"bag": bag, "x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    def gradient(self, passages: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        w, f = self.w, self.forward(passages, starts)
        bag, x, h, t, g, a = (f[k] for k in "bag x h t g a".split())
        off = (f["score"] - label) * weight / weight.sum()
        to_z = off[:, None] * w["c"]
        to_a = (to_z[bag] * h).sum(axis=1)
        to_raw = a * (to_a - np.add.reduceat(a * to_a, starts)[bag])
        to_t = to_raw[:, None] * w["w"] * g * (1 - t * t)
        to_g = to_raw[:, None] * w["w"] * t * g * (1 - g)
        to_h = a[:, None] * to_z[bag] + to_t @ w["V"].T + to_g @ w["U"].T
        to_u = to_h * (1 - h * h)
        return {
            "E": x.T @ to_u, "e": to_u.sum(axis=0), "V": h.T @ to_t, "U": h.T @ to_g,
            "w": (t * g).T @ to_raw, "c": f["z"].T @ off, "d": np.array([off.sum()]),
        }


def fit_network(bags: list[np.ndarray], label: np.ndarray, seed: int = 0) -> Network:
    """Adam in small batches; both classes weigh the same. The same input gives the same network."""
    net = Network.fresh(seed)
    if not bags:
        net.w["c"] = np.zeros(HIDDEN)
        return net
    every = np.concatenate(bags)
    net.w["shift"], net.w["scale"] = every.mean(axis=0), every.std(axis=0) + 1e-2
    share = np.clip(label.mean(), 0.05, 0.95)
    weight = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])[:-1]])
            slopes = net.gradient(np.concatenate([bags[i] for i in part]), starts, label[part], weight[part])
            step += 1
            for name, slope in slopes.items():
                slope = slope + 1e-4 * net.w[name]
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope**2
                net.w[name] = net.w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return net


def score_quality(payloads: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``payloads(capture_id, message_utf8)`` and ``labels(capture_id, quality 0/1)`` ->
    ``(capture_id, n_passages long, score double, attended long)``.

    ``score`` is the probability of label 1; ``attended`` numbers the passage with the largest
    attention weight. The network is fitted on at most ``sample_rows`` labelled rows; every
    row is scored, and every passage of it is encoded.

    Every input row gives one row, repeated rows included; equal texts get equal scores. A
    null, empty or blank text has one passage of zeros and gets a score from that. Null labels
    and labels of unknown rows are passed over; without labels every score is 0.5. A null
    ``capture_id`` is scored and never matched with a label. An empty table gives an empty table.
    """
    known = labels.where("capture_id IS NOT NULL AND quality IS NOT NULL").groupBy("capture_id").agg(
        F.max(F.col("quality").cast("double")).alias("quality")
    )
    sample = bounded_sample(known, F.col("capture_id").cast("string"), sample_rows)
    source = payloads.select("capture_id", "message_utf8")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [encode_passages(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["capture_id", "passages"])

    # At most sample_rows rows of an id and a label.
    wanted = source.join(F.broadcast(sample.select("capture_id")), "capture_id", "left_semi")
    gathered = (
        wanted.mapInArrow(measured, extended(source, ["capture_id"], "passages binary"))
        .join(F.broadcast(sample), "capture_id")
        .select(F.xxhash64(F.col("capture_id").cast("string")).alias("mixed"), "passages", "quality")
        .dropDuplicates(["mixed"])
        .toPandas()
        .sort_values("mixed")
    )
    bags = [np.frombuffer(p, np.float32).reshape(-1, MEASURES).astype(float) for p in gathered["passages"]]
    weights = fit_network(bags, gathered["quality"].to_numpy(float)).w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, scores, attended = [], [], []
            for k in range(0, len(texts), 256):
                bags = [encode_passages(text) for text in texts[k : k + 256]]
                starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
                out = net.forward(np.concatenate(bags).astype(float), starts)
                counts += [len(b) for b in bags]
                scores += out["score"].tolist()
                attended += [int(np.argmax(out["a"][s : s + len(b)])) for s, b in zip(starts, bags, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64()), pa.array(attended, pa.int64())],
                ["capture_id", "n_passages", "score", "attended"],
            )

    return source.mapInArrow(run, extended(source, ["capture_id"], "n_passages long, score double, attended long"))
