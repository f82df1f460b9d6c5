"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two words sums over the letter subsequences of length 3 that they
share; a subsequence weighs 0.6 for every letter of the stretch it spans, so gaps
and inserted characters cost but do not hide a match.  It is normalised, and
counted from ``FLOOR`` up only.  Words are runs between blanks without what is no
letter or digit; three or more single characters with blanks between ("s t u p i d")
form one word; words of over 24 characters are read in overlapping windows; a word
with digits is read without them as well.

*Landmarks* are words found far more often in toxic than in clean training texts,
so much so that among as many words without a preference less than about one would
be, each unlike the ones before it.  They are counted by their neighbours: copies of
a toxic text, whose every word is found in toxic texts, count once.  A sentence's
features are, per landmark, the highest kernel value of its words and its fourth
power (a kernel as well, so that a close match tells more than several loose ones),
each put through its Nystroem map K^(-1/2).  A linear support vector machine
(squared hinge) is trained on labelled sentences: those of clean texts, and of each
toxic text the one that the machine itself finds most toxic (chosen again ``ROUNDS`` times, as labels belong to texts).  A training text, toxic or
clean, gives at most ``SENTENCES`` sentences, those with the highest kernel value.
A text to score is read whole and scores by its most toxic sentence, turned into a
probability by Platt's scaling of margins that were cross-validated.

Pairs of a word and a landmark are screened before the kernel: they need some
ordered letter pairs (at distances 1 to 3) in common, else the value is 0, in
training and in scoring alike.

Learning reads at most ``max_toxic`` toxic and ``max_clean`` clean texts (those
with the smallest hash of their id); all texts are scored whole.

Edge cases: null or empty texts have no words and get the score of a text without
a match; labels of unknown ids are ignored, of repeated ones the highest counts;
rows with a null id are scored and held in; without both classes every score is
0; an empty table gives an empty result; repeated rows are scored each; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, in_slices, list_array, texts_of

LENGTH, DECAY = 3, 0.6           # of the subsequences; per letter spanned
FLOOR = 0.3                      # lower kernel values count as 0
WINDOW = 24                      # letters of a word read together
LANDMARKS = 80
APART = 0.6                      # landmarks are less alike than this
MAX_TOXIC, MAX_CLEAN = 6_000, 10_000
MAX_CANDIDATES = 2_000           # words looked at for landmarks
SENTENCES = 8                    # of a training text, toxic or clean
POWERS = (1, 4)                  # of the kernel: close matches weigh apart from loose ones
COST = 0.1                       # of the machine's errors
ROUNDS = 3                       # of choosing the most toxic sentence of a toxic text
FOLDS = 4                        # for the margins that the probabilities are fitted on
PREDICT_FROM = 0.7
_CACHED_WORDS = 800_000
_STRIP = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def word_of(raw: str) -> str:
    """A run between blanks (in lower case) without what is no letter or digit."""
    return raw if raw.isalnum() else _STRIP.sub("", raw)


def spaced(text: str) -> list[str]:
    """Words written as three or more single characters with blanks between."""
    return [m[0] for m in _SPACED.finditer(text)]


def windows(word: str) -> list[str]:
    """What is compared of a word: all of it in windows, and, as digits are
    often put between letters, its letters alone."""
    kinds = [word] if word.isalpha() else [word, _DIGITS.sub("", word)]
    return [w[i:i + WINDOW] for w in kinds for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)
            if len(w) >= LENGTH]


def codes(words: list[str]) -> np.ndarray:
    """Code points, one row a word, padded with 0."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros((len(words), int(sizes.max(initial=0))), dtype=np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.int32)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(words)), sizes), np.arange(len(flat)) - begin] = flat
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of the rows of s with those of t, pair by pair.

    The usual recurrence over prefixes, for all pairs at once: ``tail[a][b]``
    holds the weight of the subsequences that end anywhere in the first a and b
    letters, counted up to their ends.
    """
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    zero = np.zeros(n, dtype=np.float32)
    same = [[((s[:, a] == t[:, b]) & (s[:, a] > 0)).astype(np.float32) * np.float32(DECAY * DECAY)
             for b in range(lt)] for a in range(ls)]
    tail = None                                              # None: all ones
    for _ in range(LENGTH - 1):
        new = [[zero] * (lt + 1) for _ in range(ls + 1)]
        for a in range(1, ls + 1):
            run = zero
            for b in range(1, lt + 1):
                hit = same[a - 1][b - 1]
                run = run * np.float32(DECAY) + (hit if tail is None else hit * tail[a - 1][b - 1])
                new[a][b] = new[a - 1][b] * np.float32(DECAY) + run
        tail = new
    total = zero.copy()
    for a in range(ls):
        for b in range(lt):
            total += same[a][b] * tail[a][b]
    return total


def normalised(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    size = np.sqrt(kernel(s, s) * kernel(t, t))
    return np.where(size > 0, kernel(s, t) / np.maximum(size, 1e-12), 0).astype(np.float32)


class LandmarkKernel:
    """Kernel values of words with the landmarks, kept for the words met so far.

    ``values`` holds, by run between blanks, those with a value that is not 0.
    """

    def __init__(self, landmarks: tuple[str, ...]):
        self.codes = codes(list(landmarks))
        self.size = len(landmarks)
        self.own = kernel(self.codes, self.codes) if landmarks else np.zeros(0, np.float32)
        self.pairs = np.zeros((64 * 64, self.size), dtype=np.uint8)
        self.needed = np.zeros(self.size, dtype=np.int32)
        for j, row in enumerate(self.codes):
            c = row[row > 0] & 63
            self.needed[j] = max(2, len(c) // 2)
            for gap in (1, 2):
                self.pairs[c[:-gap] * 64 + c[gap:], j] = 1
        self.seen: set[str] = set()
        self.singles: set[str] = set()                       # runs of one character
        self.values: dict[str, np.ndarray] = {}
        self.words: dict[str, np.ndarray | None] = {}

    def learn(self, runs: set[str]) -> None:
        """Find the values of runs not met yet."""
        if len(self.seen) > _CACHED_WORDS:
            self.seen, self.values, self.words = set(), {}, {}
            runs = set(runs)
        new = runs - self.seen
        self.seen |= new
        self.singles.update(r for r in new if len(r) == 1)
        by_run = {r: w for r in new if len(w := word_of(r)) >= LENGTH}
        words = sorted((w for w in set(by_run.values()) if w not in self.words), key=len)
        for at in range(0, len(words), 4096):
            self._learn(words[at:at + 4096])
        for r, w in by_run.items():
            if (v := self.words[w]) is not None:
                self.values[r] = v

    def _learn(self, words: list[str]) -> None:
        self.words.update(dict.fromkeys(words))
        if not self.size:
            return
        parts = [(w, p) for w in words for p in ((w,) if w.isalpha() and len(w) <= WINDOW else windows(w))]
        c = codes([p for _, p in parts])
        low = (c & 63).astype(np.int64)
        shared = np.zeros((len(parts), self.size), dtype=np.uint8)
        for gap in (1, 2, 3):
            for a in range(c.shape[1] - gap):
                there = np.flatnonzero(c[:, a + gap])
                if len(there):
                    shared[there] += self.pairs[low[there, a] * 64 + low[there, a + gap]]
        i, j = np.nonzero(shared >= self.needed[None, :])
        if not len(i):
            return
        used, at = np.unique(i, return_inverse=True)
        long = int((c[used] > 0).sum(axis=1).max())
        own = kernel(c[used, :long], c[used, :long])[at] * self.own[j]
        for lo in range(0, len(i), 8192):
            ii, jj = i[lo:lo + 8192], j[lo:lo + 8192]
            width = int((c[ii] > 0).sum(axis=1).max())
            value = kernel(c[ii, :width], self.codes[jj]) / np.sqrt(own[lo:lo + 8192])
            high = value >= FLOOR
            for a, b, v in zip(ii[high], jj[high], value[high]):
                word = parts[a][0]
                if self.words[word] is None:
                    self.words[word] = np.zeros(self.size, dtype=np.float32)
                self.words[word][b] = max(self.words[word][b], v)

    def sentences(self, text: str) -> np.ndarray:
        """Features of the sentences with a match, one row each; ``text`` is in
        lower case and its runs have been learned."""
        runs = set(text.split())
        apart = [] if self.singles.isdisjoint(runs) else spaced(text)
        if apart:
            self.learn(set(apart))
        values = self.values
        hits = values.keys() & runs
        found = [values[r] for r in hits] + [values[w] for w in apart if w in values]
        if not found:
            return np.zeros((0, self.size), dtype=np.float32)
        rows, starts = [], []                                # all sentences' words, then maxima in one go
        for sentence in _SENTENCE.split(text):
            before = len(rows)
            rows += [values[r] for r in hits.intersection(sentence.split())]
            if apart:
                rows += [values[w] for w in spaced(sentence) if w in values]
            if len(rows) > before:
                starts.append(before)
        if not starts:                                       # a spaced word that a sentence's end cuts
            rows, starts = found, [0]
        return np.maximum.reduceat(np.concatenate(rows).reshape(-1, self.size), starts, axis=0)


@lru_cache(maxsize=1)
def _kernel(landmarks: tuple[str, ...]) -> LandmarkKernel:
    """One per worker process, kept from task to task."""
    return LandmarkKernel(landmarks)


def _power(x: np.ndarray, p: int) -> np.ndarray:
    """x ** p by products, which are faster than numpy's powers."""
    return x if p == 1 else _power(x * x, p // 2) if p % 2 == 0 else x * _power(x, p - 1)


@dataclass
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray          # on kernel values, by power: K^(-1/2) w
    bias: float
    slope: float
    shift: float

    def margins(self, features: np.ndarray) -> np.ndarray:
        return sum((_power(features, p) @ w for p, w in zip(POWERS, self.weights)), self.bias)

    def score(self, features: np.ndarray) -> float:
        margin = max(self.bias, float(self.margins(features).max())) if len(features) else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton's method; the last weight is the bias."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    share = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    for _ in range(30):
        gap = 1 - y * (z @ w)
        on = gap > 0
        g = ridge @ w - z[on].T @ (share[on] * y[on] * gap[on])
        step = np.linalg.solve(ridge + (z[on] * share[on, None]).T @ z[on], g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def choose_landmarks(ranked: list[str], most: int = LANDMARKS) -> list[str]:
    """The best-ranked words that are less alike than APART."""
    chosen: list[str] = []
    for w in ranked:
        w = w[:WINDOW]
        if len(chosen) == most:
            break
        if not chosen or normalised(codes([w]).repeat(len(chosen), 0), codes(chosen)).max() < APART:
            chosen.append(w)
    return chosen


def _evidence(share: float) -> Column:
    """Half the likelihood-ratio statistic of a word's texts against the ``share`` of
    toxic ones among all: words that prefer neither class have x or more of it with
    a probability of about exp(-x)."""
    n = F.col("toxic") + F.col("clean")
    return (F.col("toxic") * F.log(F.col("toxic") / (n * share))
            + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel | None:
    """Fit on bounded samples of both classes of ``labels``; null without both."""
    spark = docs.sparkSession
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y")))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
            for y, n in ((1, max_toxic), (0, max_clean))]
    train = (docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
             .join(F.broadcast(pick[0].union(pick[1])), "id")        # max_toxic + max_clean rows
             .select("text", F.col("y").cast("int").alias("y")))

    def counted(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            y = batch.column("y").to_pylist()
            for t, c in zip(texts_of(batch), y):
                t = t.lower()
                for w in set(map(word_of, t.split() + spaced(t))):
                    if len(w) >= LENGTH:
                        found.setdefault(w, [0, 0])[c] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()),
                 pa.array([v[0] for v in found.values()], pa.int64())], names=["word", "toxic", "clean"])

    sizes = {r["y"]: r["n"] for r in pick[0].union(pick[1]).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    per_word = (train.mapInArrow(counted, "word string, toxic long, clean long")
                .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    several = Scratch(spark, "toxicity").save(per_word.where("toxic + clean >= 3"), "words")
    odds = (F.log((F.col("toxic") + 0.5) / sizes[1]) - F.log((F.col("clean") + 0.5) / sizes[0]))
    evidence = _evidence(sizes[1] / (sizes[0] + sizes[1]))
    telling = (F.col("toxic") >= 3) & (odds > 2)
    candidates = {r["word"] for r in several.where(telling & (evidence > np.log(max(1, several.count()))))
                  .orderBy(F.desc(odds * F.sqrt("toxic")), "word").limit(MAX_CANDIDATES).collect()}
    wanted = spark.sparkContext.broadcast(candidates)

    def neighbours(batches):
        for batch in batches:
            found = []
            for t, c in zip(texts_of(batch), batch.column("y").to_pylist()):
                runs, met = t.lower().split(), set()
                for i, w in enumerate(map(word_of, runs)):
                    if w in wanted.value and w not in met:
                        met.add(w)
                        found.append((w, " ".join(runs[max(0, i - 1):i + 2]), c))
            words, places, y = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.string()),
                                              pa.array(y, pa.int32())], names=["word", "place", "y"])

    # a word counts once for each pair of neighbours, so that copies of a text count once
    placed = (train.mapInArrow(neighbours, "word string, place string, y int").groupBy("word", "place")
              .agg(F.max("y").alias("toxic"), (1 - F.min("y")).alias("clean"))
              .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    ranked = [r["word"] for r in placed.where(telling & (evidence > np.log(max(1, len(candidates)))))
              .orderBy(F.desc(odds * F.sqrt("toxic")), "word").collect()]
    landmarks = choose_landmarks(ranked)
    if not landmarks:
        return ToxicityModel([], np.zeros((len(POWERS), 0)), 0.0, 0.0, float(np.log(sizes[1] / sizes[0])))
    shared = spark.sparkContext.broadcast(tuple(landmarks))

    def featured(batches):
        values = _kernel(shared.value)
        for batch in batches:
            out = []
            for t in texts_of(batch):
                t = t.lower()
                values.learn(set(t.split()))
                f = values.sentences(t)
                best = np.argsort(-f.max(axis=1, initial=0), kind="stable")[:SENTENCES]
                out.append(f[best].ravel().astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("y"), list_array(out, pa.float64())], names=["y", "f"])

    table = train.mapInArrow(featured, "y int, f array<double>").toArrow()
    y = table.column("y").to_numpy()
    texts = [f.values.to_numpy().reshape(-1, len(landmarks)) for f in table.column("f")]
    return _train(landmarks, texts, y)


def _roots(landmarks: list[str]) -> list[np.ndarray]:
    """The Nystroem map K^(-1/2) of each power of the kernel."""
    m = len(landmarks)
    c = codes(landmarks)
    own = normalised(c.repeat(m, 0), np.tile(c, (m, 1))).reshape(m, m).astype(np.float64)
    roots = []
    for power in POWERS:
        value, vector = np.linalg.eigh((own ** power + own.T ** power) / 2 + 1e-3 * np.eye(m))
        roots.append(vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T)
    return roots


def _train(landmarks: list[str], texts: list[np.ndarray], y: np.ndarray) -> ToxicityModel:
    m = len(landmarks)
    roots = _roots(landmarks)
    nothing = np.zeros((1, m * len(POWERS)))
    bags = [np.concatenate([_power(t, p) @ r for p, r in zip(POWERS, roots)], axis=1) if len(t) else nothing for t in texts]
    toxic = [k for k, c in enumerate(y) if c and bags[k].any()]
    clean = [k for k, c in enumerate(y) if not c]
    if not toxic:
        return ToxicityModel([], np.zeros((len(POWERS), 0)), 0.0, 0.0, float(np.log(max(1, y.sum()) / max(1, len(y) - y.sum()))))

    def machine(pos: list[int], neg: list[int]) -> np.ndarray:
        x = np.concatenate([[picked[k] for k in pos], *(bags[k] for k in neg)])
        return _svm(x, np.concatenate([np.ones(len(pos)), -np.ones(len(x) - len(pos))]), COST)

    def margin(w: np.ndarray, k: int) -> float:
        return max(w[-1], float((bags[k] @ w[:-1]).max() + w[-1]))

    picked = {k: bags[k][np.abs(bags[k]).sum(axis=1).argmax()] for k in toxic}
    for _ in range(ROUNDS):
        w = machine(toxic, clean)
        picked = {k: bags[k][(bags[k] @ w[:-1]).argmax()] for k in toxic}
    weights = np.array([r @ part for r, part in zip(roots, w[:-1].reshape(len(POWERS), m))])
    model = ToxicityModel(landmarks, weights, float(w[-1]), 1.0, 0.0)
    # margins of texts that the machine has not seen tell what its margins are worth
    margins = np.array([margin(w, k) for k in range(len(y))])
    for f in range(FOLDS):
        pos, neg = [k for k in toxic if k % FOLDS != f], [k for k in clean if k % FOLDS != f]
        if pos and neg:
            own = machine(pos, neg)
            margins[f::FOLDS] = [margin(own, k) for k in range(f, len(y), FOLDS)]
    model.slope, model.shift = _platt(margins, y.astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          predict_from: float = PREDICT_FROM) -> DataFrame:
    """The ``keep`` columns, score and predicted of every text."""
    shown = docs.select(*keep, F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)      # LANDMARKS words and weights

    def run(batches):
        m = shared.value
        values = _kernel(tuple(m.landmarks)) if m else None
        for batch in batches:
            out = []
            for texts in in_slices(batch):                        # words are learned together
                texts = [t.lower() for t in texts]
                if m:
                    values.learn(set().union(*map(str.split, texts)))
                out += [m.score(values.sentences(t)) if m else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(out, pa.float64()),
                 pa.array([int(s >= predict_from) for s in out], pa.int32())],
                names=[*keep, "score", "predicted"])

    types = dict(shown.dtypes)
    return shown.mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in keep) + ", score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
                   label: str = "toxic", **options) -> DataFrame:
    """Learn from rows whose fold (crc32 of the id, modulo 3) is not 1, score
    every row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(fold(key, 3) != 1), key=key, text=text, label=label, **options)
    marked = docs.select(F.col(key).alias("doc_id"), F.coalesce(fold(key, 3) == 1, F.lit(False)).alias("held_out"),
                         F.col(text).alias("text"))
    return score(marked, model, keep=("doc_id", "held_out"))
