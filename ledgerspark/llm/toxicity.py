"""Toxicity by compression distance: how much shorter a window gets with a toxic dictionary.

Two Zstandard dictionaries are trained.  The ordinary one learns from windows of ordinary texts.
The toxic one learns from parts of all windows of toxic texts: of each word, its longest start (the
whole word, or a stem) whose share of toxic texts exceeds its share of ordinary texts by ``MIN_Z``
standard errors, as often as it occurs.  Trained on whole windows instead, the dictionary holds what
all texts have in common, and next to no toxic text is found.  The toxic dictionary is used together with the ordinary one, so
that ordinary text costs the same either way and the difference of the compressed lengths of a
window is what the toxic part saves.

A text is cut into windows of ``WINDOW`` words.  Its largest savings, the numbers of windows that
save at least so many bytes and its number of windows enter a logistic regression, fitted on labelled texts that no dictionary has seen and
weighted to the shares of the labels; a text is predicted toxic from ``THRESHOLD`` on.

Learning uses the ``TOXIC_TEXTS`` and ``ORDINARY_TEXTS`` labelled ids with the smallest hash
outside the held-out fold, and the first text of each; both learning and scoring read whole texts
of any length.  Defined cases: a null or empty text has no windows and gets the score of that; rows
that repeat an id are scored each by its text; contradicting labels count as toxic; null labels
are ignored; with one class only, or none, every score is that class's share (0 without labels);
an empty table gives no rows; columns other than ``doc_id``, ``text`` and ``toxic`` are not read.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import crc_mod, slices, staged
from ledgerspark.llm.language import sample_ids

FOLDS = 3
HELD_FOLD = 1
TOXIC_TEXTS = 1400
ORDINARY_TEXTS = 3600
WINDOW = 6
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 2048
MIN_Z = 6.0
MIN_START = 4
LEVEL = 3
# features of a text: its largest savings, the numbers of windows that save so much, its length
TOP = 3
COUNTED = (2, 3, 4, 5, 6)
FEATURES = 2 + TOP + len(COUNTED)
THRESHOLD = 0.7


def windows(text: str | None, words: int = WINDOW) -> list[bytes]:
    """The runs of ``words`` lower-case words, with one blank around them."""
    found = (text or "").lower().encode("utf-8", "replace").split()
    return [b" " + b" ".join(found[i : i + words]) + b" " for i in range(0, len(found), words)]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Train on the samples; too few samples are joined as they are."""
    samples = list(samples)
    random.Random(1).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def starts(word: bytes) -> list[bytes]:
    """The starts of a word with the blank before it; the longest has the blank after it too."""
    whole = b" " + word + b" "
    return [whole[:i] for i in range(min(MIN_START, len(whole)), len(whole) + 1)]


def distinctive(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """The parts of the toxic windows that set them apart, as often as they occur."""
    counts = []
    for texts in (toxic, ordinary):
        counts.append(Counter(s for t in texts for s in {s for w in {w for x in t for w in x.split()} for s in starts(w)}))
    n, m = max(1, len(toxic)), max(1, len(ordinary))

    def z(start: bytes) -> float:
        a, b = counts[0][start], counts[1][start]
        p = (a + b + 1) / (n + m + 2)
        return (a / n - b / m) / (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    strong = {s for s in counts[0] if z(s) >= MIN_Z}
    found = (max((s for s in starts(w) if s in strong), key=len, default=b"") for t in toxic for x in t for w in x.split())
    return [s for s in found if s]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            if held:
                held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
            ))
        return made

    def features(self, text: str | None, pair: list[zstandard.ZstdCompressor]) -> list[float]:
        plain, mixed = (c.compress for c in pair)
        saved = np.array([len(plain(w)) - len(mixed(w)) for w in windows(text)])
        top = np.sort(np.pad(saved, (0, TOP)))[::-1][:TOP].clip(0, 12)
        at_least = [np.log1p((saved >= x).sum()) for x in COUNTED]
        return [1.0, *map(float, top), *at_least, float(np.log1p(len(saved)))]

    def scores(self, texts: list[str | None], pair: list[zstandard.ZstdCompressor]) -> np.ndarray:
        x = np.array([self.features(t, pair) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a weighted logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The bounded sample ``(label, place, n, text)``, whole texts, and the numbers of the labels.

    ``place`` counts a label's texts by the hash of their ids, ``n`` is their number.  An id that
    stands on several rows gives its first text.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD_FOLD))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    known = staged(known)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = sample_ids(known.where("label = 1"), "label", TOXIC_TEXTS).union(
        sample_ids(known.where("label = 0"), "label", ORDINARY_TEXTS)
    )
    # at most the two documented numbers of rows
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "label"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(ids, F.col("doc_id") == F.col("_id"))
    texts = rows.groupBy("label", "_id").agg(F.min("text").alias("text"))
    of_label = Window.partitionBy("label")
    return texts.select(
        "label", F.row_number().over(of_label.orderBy(F.xxhash64("_id"), "_id")).alias("place"),
        F.count(F.lit(1)).over(of_label).alias("n"), "text",
    ), totals


def _measured(held: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of texts, computed in tasks."""
    packed = held.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(packed.value)
        pair = loaded.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [loaded.features(t, pair) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("place"), pa.array(found, pa.list_(pa.float64()))], ["label", "place", "x"]
                )

    spread = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "place")
    rows = spread.select("label", "place", "text").mapInArrow(measure, "label int, place int, x array<double>")
    found = sorted((r["label"], r["place"], r["x"]) for r in rows.collect())
    return np.array([x for _, _, x in found]), np.array([float(c) for c, _, _ in found])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample, totals = training_sample(docs, labels)
    sample = staged(sample)
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = 1.0 if 1 in classes else 0.0
        return Model(b"", b"", np.array([30.0 * (2 * share - 1)] + [0.0] * (FEATURES - 1)))
    # the first part of each class is for the dictionaries, the rest for the regression
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * 0.55))
    learned = sorted((r["label"], r["place"], r["text"]) for r in sample.where(F.col("place") <= cut).collect())
    seen = {c: [windows(t) for label, _, t in learned if label == c] for c in (0, 1)}
    parts = distinctive(seen[1], seen[0])
    toxic = dictionary(parts, TOXIC_BYTES, 24) if parts else b""
    model = Model(dictionary([w for t in seen[0] for w in t], ORDINARY_BYTES, 48), toxic, np.zeros(FEATURES))
    x, y = _measured(sample.where((F.col("place") > cut) | (F.col("n") == 1)), model)
    all_labels = sum(totals.values())
    weight = np.array([totals[int(c)] / all_labels / (y == c).sum() * len(y) for c in y])
    model.weights = _logistic(x, y, weight)
    return model


def toxic_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(packed.value)
        pair = loaded.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                found = loaded.scores(part.column("text").to_pylist(), pair)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
