"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on a few whole-text statistics (fitted on at most
``max_train`` labelled rows) gives every document's evidence.  Its probabilities
are summed by path (site section) and host in grouped aggregations; the rates are
shrunk, path towards host, host towards the global rate, by the strength that the
spread of the observed rates supports (method of moments): a sparse site says
little and stays near its parent.  A document's posterior odds are its own
evidence (the classifier's odds without its prior) times its path's prior odds.

The host is ``source`` up to the first ``/``, the path its first segment after
that, within it the language (sections of one site differ by language here).

Edge cases: null sources, paths and languages count as empty strings; null or
empty texts have zero statistics and are judged as such; repeated rows are
judged each on its own; repeated labels of a document count once, its smallest;
without any labelled row (or with one class only) the evidence is even and every
document is kept; an empty table gives an empty result; other columns pass
through ``keep_good`` unchanged.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, texts_of

MAX_TRAIN = 20_000
KEEP_FROM = 0.5
MAX_BROADCAST_PATHS = 100_000    # beyond, the rates are joined by a salted shuffle
SALTS = 16                       # a hot path's rows are joined in so many parts
_CLASSES = np.zeros(128, dtype=np.int8)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 1, 2, 3
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
FEATURES = ("log words", "word length", "upper", "digits", "marks", "blanks", "distinct words",
            "top word", "distinct lines", "marked words", "repeated neighbours")


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text, each of limited range."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    raw = raw[raw < 128]
    size = len(raw) or 1
    kinds = np.bincount(_CLASSES[raw], minlength=5) / size
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    marked = sum(k for w, k in seen.items() if not (w[-1].isalnum() or w[-1] in ".,") or not w[0].isalnum())
    lines = [x for x in text.split("\n") if x]
    again = sum(map(str.__eq__, words, words[1:]))
    return [float(np.log1p(n)), min(len(text) / n, 40.0), float(kinds[2]), float(kinds[3]), float(kinds[0]),
            float(kinds[4]), len(seen) / n, max(seen.values()) / n,
            len(set(lines)) / max(1, len(lines)), marked / n, again / n]


def _expanded(x: np.ndarray) -> np.ndarray:
    """The standardised statistics and their squares, and a constant."""
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


class Evidence:
    """Logistic regression by iteratively reweighted least squares, ridge 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = self._inputs(x)
        self.prior = float(np.log(y.mean() / (1 - y.mean())))
        self.w = np.zeros(z.shape[1])
        ridge = np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * s[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _inputs(self, x):
        return _expanded(np.clip((x - self.mean) / self.sd, -6, 6))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(x) @ self.w, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
        label: str = "quality", max_train: int = MAX_TRAIN) -> Evidence | None:
    """Fit on the ``max_train`` labelled rows of the smallest hash; null if
    there are not two classes."""
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("id")).agg(F.min(label).alias("y"))
             .orderBy(F.xxhash64("id")).limit(max_train))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(known), "id")                                 # max_train rows

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").cast(pa.float64()),
                 pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["y", "x"])

    table = rows.select("y", "text").mapInArrow(run, "y double, x array<double>").toArrow()
    y = table.column("y").to_numpy()
    if len(set(y)) < 2:
        return None
    return Evidence(np.array(table.column("x").to_pylist()), y)


def _strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-counts of the beta prior whose spread explains the groups' rates
    (n, s) around their parents' rate: little spread, strong shrinkage."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), F.lit(2))).alias("between"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("v")).first()
    if not r["n"]:
        return 1.0
    within = r["v"] / r["n"]
    tau2 = max(0.0, r["between"] / r["n"] - within * r["k"] / r["n"])
    return float(min(1e6, max(1.0, within / max(tau2, 1e-9) - 1)))


def path_rates(scratch: Scratch, scored: DataFrame) -> DataFrame:
    """(host, path, rate, n): shrunken rates of good documents of all paths.

    ``scored`` has host, path and p (the classifier's probability).
    """
    paths = scratch.save(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = total["s"] / total["n"] if total["n"] else 0.5
    hosts = hosts.withColumn("parent", F.lit(overall))
    m = _strength(hosts, "parent")
    hosts = hosts.select("host", ((F.col("s") + m * F.col("parent")) / (F.col("n") + m)).alias("host_rate"))
    nested = scratch.save(paths.join(hosts, "host"), "nested")
    m = _strength(nested, "host_rate")
    return scratch.save(nested.select(
        "host", "path", ((F.col("s") + m * F.col("host_rate")) / (F.col("n") + m)).alias("rate"), "n"), "rates")


class _Columns:
    """Names of added columns that cannot clash with a table's own."""

    def __init__(self):
        tag = uuid.uuid4().hex[:8]
        self.evidence, self.p, self.host, self.path, self.rate, self.score, self.salt = (
            f"{n}_{tag}" for n in ("evidence", "p", "host", "path", "rate", "score", "salt"))


def _with_evidence(docs: DataFrame, model: Evidence | None, names: _Columns, text: str, source: str,
                   lang: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)      # a few dozen floats
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch, at)]).reshape(-1, len(FEATURES))
            odds = m.log_odds(x) if m else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(odds - (m.prior if m else 0.0)), pa.array(1 / (1 + np.exp(-odds)))],
                names=[*batch.schema.names, names.evidence, names.p])

    added = [T.StructField(names.evidence, T.DoubleType()), T.StructField(names.p, T.DoubleType())]
    site = F.lower(F.coalesce(F.col(source).cast("string"), F.lit("")))
    section = F.when(site.contains("/"), F.substring_index(F.substring_index(site, "/", 2), "/", -1)).otherwise("")
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added)).withColumns({
        names.host: F.substring_index(site, "/", 1),
        names.path: F.concat_ws("/", section, F.coalesce(F.col(lang).cast("string"), F.lit("")))})


def _with_posterior(scored: DataFrame, rates: DataFrame, names: _Columns) -> DataFrame:
    """Adds the path's rate and the posterior probability."""
    rates = rates.select(F.col("host").alias(names.host), F.col("path").alias(names.path),
                         F.col("rate").alias(names.rate))
    on = [names.host, names.path]
    if rates.count() <= MAX_BROADCAST_PATHS:
        joined = scored.join(F.broadcast(rates), on)
    else:                                                         # a hot path's rows, equal ones too, go to SALTS tasks
        joined = (scored.withColumn(names.salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
                  .join(rates.withColumn(names.salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")),
                        [*on, names.salt]).drop(names.salt))
    rate = F.least(F.greatest(F.col(names.rate), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col(names.evidence) + F.log(rate / (1 - rate))
    return joined.withColumn(names.score, 1 / (1 + F.exp(-odds)))


def score_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
                  source: str = "source", lang: str = "lang", label: str = "quality",
                  keep_from: float = KEEP_FROM, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, host, path, evidence (log odds without the classifier's prior),
    path_rate, score (posterior probability of good quality), keep."""
    scratch, n = Scratch(docs.sparkSession, "quality"), _Columns()
    model = fit(docs, labels, key=key, text=text, label=label, max_train=max_train)
    base = docs.select(*(F.col(c) for c in dict.fromkeys((key, text, source, lang))))
    scored = scratch.save(_with_evidence(base, model, n, text, source, lang)
                          .select(F.col(key).alias("doc_id"), n.host, n.path, n.evidence, n.p), "scored")
    rates = path_rates(scratch, scored.select(F.col(n.host).alias("host"), F.col(n.path).alias("path"),
                                              F.col(n.p).alias("p")))
    return _with_posterior(scored, rates, n).select(
        "doc_id", F.col(n.host).alias("host"), F.col(n.path).alias("path"), F.col(n.evidence).alias("evidence"),
        F.col(n.rate).alias("path_rate"), F.col(n.score).alias("score"), (F.col(n.score) >= keep_from).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
              source: str = "source", lang: str = "lang", label: str = "quality",
              keep_from: float = KEEP_FROM, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents, same columns, whose posterior is at least ``keep_from``."""
    scratch, n = Scratch(docs.sparkSession, "quality"), _Columns()
    model = fit(docs, labels, key=key, text=text, label=label, max_train=max_train)
    scored = _with_evidence(docs, model, n, text, source, lang)
    rates = path_rates(scratch, scored.select(F.col(n.host).alias("host"), F.col(n.path).alias("path"),
                                              F.col(n.p).alias("p")))
    return _with_posterior(scored, rates, n).where(F.col(n.score) >= keep_from).select(*docs.columns)
