"""Language identification by nearest centroid.

A text becomes the normalised TF-IDF vector of its hashed character n-grams
(one to three letters within words, fixed number of slots).  Each language has
several centroids, the means of clusters found by spherical k-means among its
training texts; the predicted language is that of the centroid with the highest
cosine.  A text farther from every centroid than nearly all training texts are
from theirs is marked ``rejected``; its nearest language is still given.

The vectors of all texts are made on the executors from whole texts; fitting
reads at most ``max_train`` training rows, the same number of every language
(those with the smallest hash of their id; one of each if there are more
languages), and sends their sparse vectors to the driver.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows
with a null label are not learned from; an empty table gives an empty result;
without any training row every text is ``und``; repeated rows are predicted
each on its own; of equal cosines the alphabetically first language wins; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, list_array, texts_of

SLOTS = 4096
MAX_TRAIN = 6000
CENTROIDS = 4                    # per language
UNDETERMINED = "und"

_P = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams by slot; None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _LETTER[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)               # one blank between words
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)]))
    shift = np.uint32(32 - (SLOTS.bit_length() - 1))
    counts = np.bincount((c * _P[0]) >> shift, minlength=SLOTS)
    two = (c[:-1] * _P[1]) ^ (c[1:] * _P[0])
    counts += np.bincount((two * _P[2]) >> shift, minlength=SLOTS)
    three = (two[:-1] * _P[1]) ^ (c[2:] * _P[2])
    counts += np.bincount((three * _P[0]) >> shift, minlength=SLOTS)
    return counts


@dataclass
class CentroidModel:
    idf: np.ndarray
    languages: list[str]         # of each centroid
    centroids: np.ndarray
    least_cosine: float

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt(v @ v)
        return v / norm if norm else v


def _spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                m = x[near == j].sum(axis=0)
                centres[j] = m / max(np.sqrt(m @ m), 1e-12)
    return centres


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """An equal number of rows of each language, those with the smallest hashes.

    Hashes are screened by the language's count first, so that no task sorts a
    whole language; about twice the rows wanted are left.
    """
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, most // max(1, sizes.count()))
    place = F.col("h") / F.lit(2.0 ** 64) + 0.5              # 0 to 1
    near = rows.join(F.broadcast(sizes), "lang").where(place * F.col("n") <= 2 * each + 32)     # a row per language
    return (near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
            .where(F.col("at") <= each))


def fit(train: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang",
        max_train: int = MAX_TRAIN, centroids: int = CENTROIDS, reject_share: float = 0.005) -> CentroidModel:
    """Fit on at most ``max_train`` labelled rows."""
    rows = _sample(train.where(F.col(label).isNotNull()).select(
        F.xxhash64(key).alias("h"), F.col(label).alias("lang"), F.col(text).alias("text")), max_train)

    def sparse(batches):
        for batch in batches:
            langs, slots, values = [], [], []
            for lang, t in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                counts = gram_counts(t)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    langs.append(lang)
                    slots.append(at.astype(np.int32))
                    values.append(counts[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), list_array(slots, pa.int32()),
                 list_array(values, pa.int32())], names=["lang", "slots", "counts"])

    table = rows.select("lang", "text").mapInArrow(
        sparse, "lang string, slots array<int>, counts array<int>").toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    x = np.zeros((len(langs), SLOTS), dtype=np.float32)
    for i in range(len(langs)):
        x[i, table.column("slots")[i].values.to_numpy()] = table.column("counts")[i].values.to_numpy()
    df = (x > 0).sum(axis=0)
    idf = (np.log((1 + len(langs)) / (1 + df)) + 1).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    names, centres, rng = [], [], np.random.default_rng(0)
    for lang in sorted(set(langs)):
        c = _spherical_kmeans(x[langs == lang], centroids, rng)
        names += [lang] * len(c)
        centres.append(c)
    centres = np.concatenate(centres) if centres else np.zeros((0, SLOTS), np.float32)
    best = (x @ centres.T).max(axis=1) if len(names) and len(x) else np.ones(1)
    return CentroidModel(idf, names, centres, float(np.quantile(best, reject_share)))


def predict(docs: DataFrame, model: CentroidModel, *, key: str = "doc_id", text: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the ``keep`` columns, lang_pred, score (cosine, 0 to 1), rejected."""
    shown = docs.select(F.col(key).alias("doc_id"), *keep, F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)             # SLOTS x centroids floats

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for t in texts_of(batch):
                counts = gram_counts(t) if m.languages else None
                if counts is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                cosine = m.centroids @ m.vector(counts).astype(np.float32)
                at = int(cosine.argmax())
                langs.append(m.languages[at])
                scores.append(float(min(1.0, max(0.0, cosine[at]))))
                rejected.append(bool(cosine[at] < m.least_cosine))
            kept = [batch.column(n) for n in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=["doc_id", *keep, "lang_pred", "score", "rejected"])

    types = dict(shown.dtypes)
    columns = ", ".join(f"`{n}` {types[n]}" for n in ("doc_id", *keep))
    return shown.mapInArrow(run, f"{columns}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang",
             **options) -> DataFrame:
    """Learn from the rows whose fold (crc32 of the id, modulo 4) is not 2 and
    predict every row; ``held_out`` marks the rows not learned from."""
    held_out = F.coalesce(fold(key, 4) == 2, F.lit(False))
    model = fit(docs.where(fold(key, 4) != 2), key=key, text=text, label=label, **options)
    marked = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return predict(marked, model, keep=("held_out",))
