"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams, n = 1 to ``MAX_N`` blended, that are
present in both, divided by the root of the product of their own numbers (a presence kernel with
norm 1).  Texts are lower-cased and what is not a letter counts as one blank.  ``landmarks`` of
the training texts span the approximation: with ``K_mm`` their kernels and ``K_nm`` those of the
training texts, one ridge regression per language solves
``(K_nm' K_nm + ridge K_mm) a = K_nm' y`` with targets +1 and -1.

A presence kernel is a scalar product, so a batch of texts is scored as the matrix product of
their presence rows over the landmarks' n-grams with ``L' a`` (n-grams by languages).  The largest
output decides; the score is its share in a softmax whose scale is fitted on the training texts.

The training texts are the ``per_class`` texts of each language with the smallest hash of their
id; nothing else is sampled.  Defined cases: a text that is null or has no letter is ``und`` with
score 0; a null language is not learned; without anything to learn from, every text is ``und``; an
empty table gives no rows; other columns are ignored, whatever their names; very long texts are read
whole, in pieces of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import crc_mod, slices

PER_CLASS = 400
LANDMARKS_PER_CLASS = 64
MAX_N = 3
RIDGE = 0.05
FOLDS = 5
HELD_FOLD = 0
# characters turned into n-grams at once
PIECE = 1 << 20
UNKNOWN = "und"


def ngrams(text: str) -> np.ndarray:
    """The distinct 1- to 3-grams of a text, as sorted numbers; a code point takes 21 bits."""
    found, tail, after_letter = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for at in range(0, len(text), PIECE):
        # lower case of a capital sigma would depend on what follows
        low = text[at : at + PIECE].replace("Σ", "σ").lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters = np.frombuffer(bytes(map(str.isalpha, low)), bool)
        # all that is not a letter is one blank between words
        keep = letters | np.concatenate([[after_letter], letters[:-1]])
        after_letter = letters[-1]
        # the last points kept of the piece before come first, for the n-grams across its end
        points = np.concatenate([tail, np.where(letters, points, 32)[keep]])
        tail = points[-(MAX_N - 1) :]
        parts = [found, points]
        for n in range(2, MAX_N + 1):
            grams = points[: max(0, len(points) - n + 1)]
            for i in range(1, n):
                grams = (grams << 21) | points[i : i + len(grams)]
            parts.append(grams)
        found = np.unique(np.concatenate(parts))
    return found[found != 32]


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted n-grams of the landmarks
    weights: np.ndarray  # n-grams by languages
    scale: float

    def outputs(self, sets: list[np.ndarray]) -> np.ndarray:
        """Texts by languages: the regressions' outputs, by one matrix product."""
        rows = np.zeros((len(sets), len(self.grams)), np.float32)
        for row, grams in zip(rows, sets, strict=True):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            row[at[self.grams[at] == grams]] = 1
        norm = np.sqrt([max(1, len(x)) for x in sets])
        return rows @ self.weights / norm[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        sets = {i: g for i, t in enumerate(texts) if t and len(g := ngrams(t)) and self.languages}
        at = list(sets)
        for start in range(0, len(at), 128):
            rows = at[start : start + 128]
            out = self.outputs([sets[i] for i in rows])
            best = out.argmax(1)
            share = np.exp(self.scale * (out - out.max(1, keepdims=True)))
            for i, b, s in zip(rows, best, share, strict=True):
                names[i], scores[i] = self.languages[b], float(s[b] / s.sum())
        return names, scores


def sample_ids(rows: DataFrame, group: str, most: int) -> DataFrame:
    """``(group, doc_id)``: the ``most`` different ids of each group with the smallest hashes.

    Hashes above a share of their range, set by the group's size, are left out before ranking, so
    a ranking meets a few times ``most`` ids however large the group is; the share is widened
    where too few different ids are below it.
    """
    keyed = rows.select(group, "doc_id", F.xxhash64("doc_id").alias("_h"))
    sizes = {r[0]: r[1] for r in keyed.groupBy(group).count().collect()}
    share = {g: 8.0 * most / n for g, n in sizes.items()}
    while True:
        # a hash is a number from -2^63 up
        below = F.lit(False)
        for g, part in share.items():
            below = below | ((F.col(group) == F.lit(g)) & (F.col("_h") <= F.lit(min(int(part * 2**64), 2**64 - 1) - 2**63)))
        found = keyed.where(below).distinct()
        counts = dict(found.groupBy(group).count().collect())
        few = [g for g, part in share.items() if part < 1 and counts.get(g, 0) < most]
        if not few:
            break
        share |= {g: share[g] * 8 for g in few}
    first = Window.partitionBy(group).orderBy("_h", "doc_id")
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select(group, "doc_id")


def training_sets(docs: DataFrame, per_class: int) -> list[tuple[str, np.ndarray]]:
    """Language and n-grams of the bounded sample; ids are chosen before texts are read.

    An id that stands on several rows of a language gives its first text.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    learned = rows.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_FOLD)
    chosen = sample_ids(learned, "lang", per_class).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(sets, pa.binary())], ["doc_id", "lang", "grams"])

    # at most per_class ids per language
    texts = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(grams, f"doc_id {kind}, lang string, grams binary").collect()
    found = sorted((r["lang"], r["doc_id"], bytes(r["grams"])) for r in found if r["grams"])
    return [(lang, np.frombuffer(g, np.int64)) for lang, _, g in found]


def train(docs: DataFrame, per_class: int = PER_CLASS, landmarks: int = LANDMARKS_PER_CLASS, ridge: float = RIDGE) -> Model:
    """Fit on the rows of ``docs`` whose id is not in the held-out fold."""
    sample = training_sets(docs, per_class)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], np.zeros(1, np.int64), np.zeros((1, 0)), 1.0)
    marks = [g for lang in languages for g in [g for x, g in sample if x == lang][:landmarks]]
    grams = np.unique(np.concatenate(marks))

    def presence(sets: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(sets), len(grams)), np.float32)
        for row, s in zip(rows, sets, strict=True):
            row[np.searchsorted(grams, np.intersect1d(s, grams, assume_unique=True))] = 1
        return rows / np.sqrt([max(1, len(s)) for s in sets], dtype=np.float32)[:, None]

    base = presence(marks)
    k_mm = (base @ base.T).astype(float)
    k_nm = np.concatenate([presence([g for _, g in sample[i : i + 256]]) @ base.T for i in range(0, len(sample), 256)]).astype(float)
    targets = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in sample])
    count = np.array([sum(x == lang for x, _ in sample) for lang, _ in sample])
    weight = (1 / count)[:, None]
    left = k_nm.T @ (weight * k_nm) + ridge * k_mm / len(marks) + 1e-9 * np.eye(len(marks))
    alpha = np.linalg.solve(left, k_nm.T @ (weight * targets))
    model = Model(languages, grams, (base.T @ alpha).astype(np.float32), 1.0)
    # the softmax scale of the smallest log loss on the training texts
    out, own = k_nm @ alpha, np.array([languages.index(lang) for lang, _ in sample])

    def loss(scale: float) -> float:
        z = scale * (out - out.max(1, keepdims=True))
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(own)), own]))

    model.scale = min((1.0, 2.0, 3.0, 5.0, 8.0, 12.0), key=loss)
    return model


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``, in place of columns of these names."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = [c for c in docs.columns if c not in (pred, score)]
    rows = docs.select(*names)
    # one field of the bounded model is sent once per worker; the text column gives the sizes
    text_at = names.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(packed.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found, scores = loaded.predict(part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.string()), pa.array(scores)], [*names, pred, score]
                )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(rows.schema.fields)).add(pred, StringType()).add(score, DoubleType())
    return rows.mapInArrow(predict, schema)


def languages_of(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document."""
    model = model or train(docs)
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
