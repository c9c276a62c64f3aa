"""Toxic payload texts by a classifier chain.

Categories are predicted one after the other by linear models on the words of a text; each
model also reads the probabilities of the categories before it. In training those come from
models that have not seen the row (out-of-fold), as they will in use.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.linear import Logistic, Sparse, fit, telling_features
from tonelake.llm.records import extended
from tonelake.llm.sampling import bounded_sample

#: Labelled rows that the models are fitted on, at most.
SAMPLE_ROWS = 6_000
#: Features of one model, at most.
MODEL_FEATURES = 512
FOLDS = 3
#: Leading parts of a word that are features of their own, so that inflected words share one.
STEMS = (4, 5)
#: A stretch of characters that is read as one word, at most; a longer one is read in parts.
TOKEN = re.compile(r"\w{1,200}|[^\w\s]{1,20}")
REMEMBERED = 100_000
#: Texts whose features a task holds together.
PORTION = 256


def features_of(token: str) -> list[int]:
    """Feature numbers of a token: itself and its leading parts."""
    parts = [f"w{token}"] + [f"{n}{token[:n]}" for n in STEMS if len(token) >= n]
    return [zlib.crc32(p.encode()) for p in parts]


def tokens_of(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def _feature_rows(payloads: DataFrame) -> DataFrame:
    """(capture_id, features): the distinct feature numbers of each text."""
    source = payloads.select("capture_id", "message_utf8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column(1):  # one text at a time: packed features are a tenth of the numbers
                row = {f for token in tokens_of(text.as_py()) for f in features_of(token)}
                packed.append(np.sort(np.fromiter(row, np.uint32, len(row))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["capture_id", "features"])

    return source.mapInArrow(run, extended(source, ["capture_id"], "features binary"))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(rows: Sparse, labels: np.ndarray, fold: np.ndarray) -> list[Logistic]:
    """One model per column of ``labels`` (nan: unknown), in order.

    Column k is fitted on the features and on the out-of-fold logits of columns before k.
    """
    columns = np.zeros((len(rows), 0))
    chain = []
    for k in range(labels.shape[1]):
        label, known = labels[:, k], ~np.isnan(labels[:, k])

        def model(keep: np.ndarray, label=label, columns=columns) -> Logistic:
            inside, target = rows.rows(keep), label[keep]
            return fit(inside, columns[keep], target, telling_features(inside, target, MODEL_FEATURES))

        chain.append(model(known))
        unseen = np.zeros(len(rows))
        for part in range(FOLDS):
            held = fold == part
            if held.any():
                unseen[held] = model(known & ~held).probability(rows.rows(held), columns[held])
        columns = np.hstack([columns, _logit(unseen)[:, None]])
    return chain


def score_chain(chain: list[Logistic], rows: Sparse) -> np.ndarray:
    """Probabilities, one column per category."""
    columns = np.zeros((len(rows), 0))
    out = []
    for model in chain:
        out.append(model.probability(rows, columns))
        columns = np.hstack([columns, _logit(out[-1])[:, None]])
    return np.stack(out, axis=1)


def score_toxicity(
    payloads: DataFrame,
    labels: DataFrame,
    categories: list[str],
    sample_rows: int = SAMPLE_ROWS,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """``payloads(capture_id, message_utf8)`` and ``labels(capture_id, <category> 0/1 ...)`` ->
    ``(capture_id, p_<category> double ...)``, one column per category in chain order, and the
    ``carried`` columns of the payloads, which spares a caller the join back.

    The chain is fitted on at most ``sample_rows`` labelled rows; every row is scored. Every
    input row gives one row, repeated rows included; equal texts get equal scores. A null or
    empty text has no features and gets the score of a text without telling words. Labels of
    unknown rows and null labels are passed over; without any labels every score is 0.5. A
    null ``capture_id`` is scored and never matched with a label. An empty table gives an
    empty table. Only distinct tokens are kept of a text, which is read whole.
    """
    known = labels.where("capture_id IS NOT NULL").groupBy("capture_id").agg(
        *[F.max(F.col(c).cast("double")).alias(c) for c in categories]
    )
    sample = bounded_sample(known, F.col("capture_id").cast("string"), sample_rows)
    texts = payloads.where("capture_id IS NOT NULL").select("capture_id", "message_utf8")
    # The sample has at most sample_rows rows of an id and a few numbers.
    wanted = texts.join(F.broadcast(sample.select("capture_id")), "capture_id", "left_semi")
    gathered = (
        _feature_rows(wanted)
        .join(F.broadcast(sample), "capture_id")
        .select(F.xxhash64(F.col("capture_id").cast("string")).alias("mixed"), "features", *categories)
        .dropDuplicates(["mixed"])
        .toPandas()
        .sort_values("mixed")
    )
    rows = Sparse.of([np.frombuffer(f, np.uint32) for f in gathered["features"]])
    targets = gathered[categories].to_numpy(float).reshape(len(gathered), len(categories))
    chain = fit_chain(rows, targets, gathered["mixed"].to_numpy(np.int64) % FOLDS)
    used = np.unique(np.concatenate([m.chosen for m in chain])) if chain else np.zeros(0, np.int64)
    kept, added = ["capture_id", *carried], [f"p_{c}" for c in categories]
    source = payloads.select("message_utf8", *[c for c in kept if c != "message_utf8"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = set(used.tolist())
        known: dict[str, list[int]] = {}
        none: list[int] = []  # most tokens tell nothing and share one list
        for batch in (whole.slice(k, PORTION) for whole in batches for k in range(0, whole.num_rows, PORTION)):
            found = []
            for value in batch.column("message_utf8"):
                text = value.as_py()
                row: set[int] = set()
                if len(known) > REMEMBERED:
                    known.clear()
                for token in tokens_of(text):
                    hits = known.get(token)
                    if hits is None:
                        hits = known[token] = [f for f in features_of(token) if f in telling] or none
                    if hits:
                        row.update(hits)
                found.append(np.array(sorted(row), np.int64))
            scores = score_chain(chain, Sparse.of(found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(scores[:, k]) for k in range(len(categories))]], [*kept, *added]
            )

    return source.mapInArrow(run, extended(source, kept, ", ".join(f"`{n}` double" for n in added)))
