r"""Secret scans: fixed patterns plus a randomness test battery.

The base patterns (``assign``, ``access``, ``hex``) are reported as they match.
The method adds spans of kind ``random``: candidate tokens, whose encoding is
inferred from the characters they use, go through

1. a chi-squared test of the characters against a uniform alphabet,
2. a runs test on the classes (lower, upper, digit, other) of the characters,
3. a test of the lag-1 serial correlation of the alphabet positions.

A token is *random* when all three agree with uniform random characters (the
smallest two-sided p-value, Bonferroni, is at least ``consistent``) and when
ordinary text is rejected as its source: the chi-squared statistic and the
class changes get p-values under the character frequencies and the change rate
of the corpus (counted over all documents; both depend on the length), combined
by Fisher's method.  The rejections are limited by Benjamini and Hochberg's
step-up rule over all candidates, each weighted by its length's share, so that
a short token needs a smaller p-value.  The p-values are ranked by a histogram of
fixed width, rounded so that no token passes that the exact rule would refuse.

Edge cases: a null text is an empty text (no spans); an empty table gives an
empty result; repeated rows are scanned each on its own; other columns are
ignored; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from math import erf, exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_batch, texts_of

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

#: Candidate tokens; a digit is required, as an encoded secret of 20 characters
#: lacks one with a probability of under 3 %.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HAS_DIGIT = re.compile(r"[0-9]")

BINS = 4096                      # of the p-value histogram; -ln p up to BINS / 16
_PER_UNIT = 16
LENGTH_BANDS = (24, 32, 48)      # lengths below each, and the rest

_CLASS = np.full(256, 3, dtype=np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_B64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Alphabets by inferred encoding, the narrowest first.
ALPHABETS = {"hex": b"0123456789abcdef", "HEX": b"0123456789ABCDEF",
             "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base36": b"0123456789abcdefghijklmnopqrstuvwxyz",
             "base62": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "base64": _B64, "base64url": _B64[:-2] + b"-_"}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_PLACE = {}
for _name, _a in ALPHABETS.items():
    _PLACE[_name] = np.full(256, -1, dtype=np.int16)
    _PLACE[_name][list(_a)] = np.arange(len(_a))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches per kind, too short ones left out."""
    return {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST],
            "access": [m.span() for m in ACCESS.finditer(text)],
            "hex": [m.span() for m in HEX.finditer(text)]}


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind; spans are (start, kind, end)."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def infer_encoding(token: bytes) -> str | None:
    used = frozenset(token.rstrip(b"="))
    return next((n for n, s in _SETS.items() if used <= s), None)


def _normal_sf(z: float) -> float:
    return 0.5 * (1 - erf(z / sqrt(2)))


def battery(token: bytes, encoding: str) -> tuple[float, float, int]:
    """(smallest two-sided p-value of the three tests under uniform random
    characters, times three; the chi-squared statistic; class changes)."""
    body = np.frombuffer(token.rstrip(b"="), dtype=np.uint8)
    place = _PLACE[encoding][body].astype(np.float64)
    n, size = len(body), len(ALPHABETS[encoding])
    counts = np.bincount(place.astype(int), minlength=size)
    chi2 = float((counts * counts).sum()) * size / n - n
    # Wilson and Hilferty's cube root makes the statistic close to normal
    df = size - 1
    z_chi = ((max(chi2, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))
    kind = _CLASS[body]
    changes = int((kind[1:] != kind[:-1]).sum())
    share = np.bincount(_CLASS[list(ALPHABETS[encoding])], minlength=4) / size
    rate = 1 - float((share ** 2).sum())
    z_runs = (changes - (n - 1) * rate) / sqrt(max((n - 1) * rate * (1 - rate), 1e-9)) if rate else 0.0
    centred = place - (size - 1) / 2
    z_serial = float((centred[1:] * centred[:-1]).sum()) / (sqrt(n - 1) * (size * size - 1) / 12)
    p = min(2 * _normal_sf(abs(z)) for z in (z_chi, z_runs, z_serial))
    return min(1.0, 3 * p), chi2, changes


class OrdinaryText:
    """What characters and class changes ordinary text has; the null model."""

    def __init__(self, counts: np.ndarray, changes: int, pairs: int):
        self.counts = counts + 0.5
        self.change = (changes + 1) / (pairs + 100)
        self.moments = {}
        for name, alphabet in ALPHABETS.items():
            q = self.counts[list(alphabet)]
            q = q / q.sum()
            self.moments[name] = (len(alphabet), float((q ** 2).sum()), float((q ** 3).sum()))

    def p_value(self, encoding: str, n: int, chi2: float, changes: int) -> float:
        """How likely ordinary text is at least as uniform and as mixed."""
        size, s2, s3 = self.moments[encoding]
        mean = size * (1 - s2) + n * (size * s2 - 1)
        var = size * size * (4 * n * max(s3 - s2 * s2, 0) + 2 * s2 * s2)
        p1 = max(_normal_sf((mean - chi2) / sqrt(var)), 1e-12)
        t = self.change
        # P(Binomial(n - 1, t) >= changes), by Chernoff's bound
        a, m = changes / (n - 1), n - 1
        p2 = 1.0 if a <= t else exp(-m * (a * log(a / t) + ((1 - a) * log((1 - a) / (1 - t)) if a < 1 else 0)))
        f = -log(p1) - log(max(p2, 1e-100))
        return max(exp(-f) * (1 + f), 1e-100)          # Fisher, two tests


def _corpus_model(docs: DataFrame) -> OrdinaryText:
    """Characters, class changes and neighbours counted over all texts."""
    def rows(batch):
        counts, changes, pairs = np.zeros(256, np.int64), 0, 0
        for text in texts_of(batch):
            b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
            counts += np.bincount(b, minlength=256)
            kind = _CLASS[b]
            inside = (kind[1:] < 3) & (kind[:-1] < 3)
            pairs += int(inside.sum())
            changes += int((inside & (kind[1:] != kind[:-1])).sum())
        return {"k": list(range(258)), "n": [*counts.tolist(), changes, pairs]}

    schema = pa.schema([("k", pa.int32()), ("n", pa.int64())])
    sums = (docs.select("text").mapInArrow(per_batch(rows, schema), "k int, n long")
            .groupBy("k").agg(F.sum("n").alias("n")).collect())      # at most 258 rows
    by = {r["k"]: r["n"] for r in sums}
    return OrdinaryText(np.array([by.get(k, 0) for k in range(256)], float), by.get(256, 0), by.get(257, 0))


def _length_band(n: int) -> int:
    return sum(n >= b for b in LENGTH_BANDS)


def step_up(histogram: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Least bin of -ln p that passes, by length band (weighted step-up rule).

    A band's weight is its length's share: longer tokens say more, so a band
    weighs in proportion to its place, with the candidates' mean weight at 1.
    """
    total = sum(histogram.values())
    if not total:
        return {}
    bands = range(len(LENGTH_BANDS) + 1)
    mean = sum((1 + b) * n for (b, _), n in histogram.items()) / total
    weight = {b: (1 + b) / mean for b in bands}
    shift = {b: log(weight[b]) * _PER_UNIT for b in bands}      # weighted: p / w
    for least in range(BINS + 1):                               # the largest passing p first
        passed = sum(n for (b, k), n in histogram.items() if k + shift[b] >= least)
        if passed and exp(-least / _PER_UNIT) <= rate * passed / total:
            return {b: max(0, int(np.ceil(least - shift[b]))) for b in bands}
    return {b: BINS + 1 for b in bands}


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rate: float = 0.01,
                 consistent: float = 0.01) -> DataFrame:
    """One row per document: key, counts and digest of the base spans, all
    spans as text (``spans``) and the number of added ones (``n_random``)."""
    scratch = Scratch(docs.sparkSession, "secrets")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    model = _corpus_model(docs)

    def scanned(batches):
        for batch in batches:
            out = {n: [] for n in ("base", "digest", "counts", "cands")}
            for t in texts_of(batch):
                base = base_spans(t)
                spans = [(s, k, e) for k, name in enumerate(KINDS[:3]) for s, e in base[name]]
                out["base"].append([{"s": s, "k": k, "e": e} for s, k, e in spans])
                out["digest"].append(hashlib.sha256(joined(spans).encode()).hexdigest())
                out["counts"].append([len(base[name]) for name in KINDS[:3]])
                cands = []
                for m in TOKEN.finditer(t):
                    token = m[0].encode()
                    if not _HAS_DIGIT.search(m[0]) or (encoding := infer_encoding(token)) is None:
                        continue
                    fit, chi2, changes = battery(token, encoding)
                    n = len(token.rstrip(b"="))
                    p = model.p_value(encoding, n, chi2, changes)
                    cands.append({"s": m.start(), "e": m.end(), "band": _length_band(n),
                                  "bin": min(BINS, int(-log(p) * _PER_UNIT)), "fit": fit})
                out["cands"].append(cands)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["base"], span), pa.array(out["digest"]),
                 pa.array(out["counts"], pa.list_(pa.int64())), pa.array(out["cands"], cand)],
                names=["doc_id", "base", "digest", "counts", "cands"])

    span = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
    cand = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("band", pa.int32()),
                               ("bin", pa.int32()), ("fit", pa.float64())]))
    found = scratch.save(docs.mapInArrow(
        scanned, f"doc_id {kind}, base array<struct<s:bigint,k:int,e:bigint>>, digest string, "
                 "counts array<bigint>, cands array<struct<s:bigint,e:bigint,band:int,bin:int,fit:double>>"),
        "found")
    bins = (found.select(F.explode("cands").alias("c")).groupBy("c.band", "c.bin").count()
            .collect())                                          # at most 4 x (BINS + 1) rows
    least = step_up({(r["band"], r["bin"]): r["count"] for r in bins}, rate) or {0: 0}

    def passes(c):
        limit = F.lit(BINS + 1)
        for band, low in least.items():
            limit = F.when(c["band"] == band, F.lit(low)).otherwise(limit)
        return (c["bin"] >= limit) & (c["fit"] >= consistent)

    added = F.transform(F.filter("cands", passes),
                        lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    names = F.array(*map(F.lit, KINDS))
    everything = F.array_sort(F.concat(F.col("base"), added))
    return found.select(
        "doc_id", *(F.col("counts")[i].alias(f"n_{name}") for i, name in enumerate(KINDS[:3])),
        F.col("digest").alias("base_sha256"),
        F.array_join(F.transform(everything, lambda c: F.concat_ws(
            ":", F.element_at(names, c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",").alias("spans"),
        F.size(added).cast("long").alias("n_random"))
