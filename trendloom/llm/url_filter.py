"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed, one after the other, into the bits of a few 64-bit
words.  A step over one byte of all URLs of a batch is

    D = ((D << 1) & B[byte]) | (D & L[byte])

(the shift carries between words): ``B`` holds the literals, ``L`` the
self-loops of the positions that a wildcard follows.  All patterns of all URLs
of the batch are simulated at once; a bit left set at a pattern's end means
that the whole canonical URL matches.

Edge cases: a null URL or one without ``://`` has an empty host and path and
matches no rule; an empty table gives an empty result; repeated rows are judged
each on its own; other columns are ignored.  Of several fitting rules the
longest wins, of equally long ones the first given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAD = 256                       # beyond a URL's end: every state stays
_ROWS = 4096                     # URLs simulated together


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        literal = "".join("\\" + c if c in "*?\\" else c for c in f".{self.host}{self.path}")
        return f"*{literal}**"


class WildcardAutomaton:
    """Patterns over bytes: ``*`` any run without ``/``, ``**`` any run, ``?``
    one byte but ``/``, ``\\x`` the character x itself."""

    def __init__(self, globs: list[str]):
        literals, loops, self.starts, self.ends = [], [], [], []
        for glob in globs:
            self.starts.append(len(literals))
            literals.append(None)            # the start state consumes nothing
            loops.append("")
            i = 0
            while i < len(glob):
                c = glob[i]
                if c == "*":
                    wide = glob[i:i + 2] == "**"
                    loops[-1] = "any" if wide or loops[-1] == "any" else "segment"
                    i += 2 if wide else 1
                    continue
                if c == "\\" and i + 1 < len(glob):
                    i += 1
                    c = glob[i]
                    symbols = [bytes([b]) for b in c.encode()]
                else:
                    symbols = ["?"] if c == "?" else [bytes([b]) for b in c.encode()]
                for s in symbols:
                    literals.append(s)
                    loops.append("")
                i += 1
            self.ends.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        self.step = np.zeros((257, self.words), dtype=np.uint64)
        self.loop = np.zeros((257, self.words), dtype=np.uint64)
        self.first = np.zeros(self.words, dtype=np.uint64)
        slash = ord("/")
        for k, (symbol, kind) in enumerate(zip(literals, loops)):
            w, bit = k // 64, np.uint64(1) << np.uint64(k % 64)
            if symbol == "?":
                self.step[:256, w] |= bit
                self.step[slash, w] &= ~bit
            elif symbol is not None:
                self.step[symbol[0], w] |= bit
            if kind:
                self.loop[:256, w] |= bit
                if kind == "segment":
                    self.loop[slash, w] &= ~bit
        for k in self.starts:
            self.first[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        self.loop[_PAD] = ~np.uint64(0)

    def match(self, strings: list[bytes]) -> np.ndarray:
        """bool[string, pattern]: which patterns match each whole string."""
        out = np.zeros((len(strings), len(self.ends)), dtype=bool)
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        for at in range(0, len(order), _ROWS):
            self._simulate(strings, order[at:at + _ROWS], out)
        return out

    def _simulate(self, strings, rows, out) -> None:
        lengths = np.array([len(strings[i]) for i in rows])
        flat = np.frombuffer(b"".join(strings[i] for i in rows), dtype=np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.tile(self.first, (len(rows), 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(lengths.max(initial=0))):
            symbol = np.full(len(rows), _PAD)
            live = lengths > j
            symbol[live] = flat[begin[live] + j]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.step[symbol]) | (state & self.loop[symbol])
        for p, k in enumerate(self.ends):
            out[rows, p] = (state[:, k // 64] >> np.uint64(k % 64)) & one == one


def host_and_path(url):
    """(host, path) columns of a URL column; both empty without ``://``."""
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format(url))
    has = F.coalesce(F.col(url).contains("://"), F.lit(False))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return (F.when(has, F.translate(raw, _UPPER, _LOWER)).otherwise(""),
            F.when(has, path).otherwise(""))


def judge_urls(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits), verdict."""
    ranked = sorted(rules, key=lambda r: -len(r.text))
    automaton = WildcardAutomaton([r.glob for r in ranked])
    urls = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    parts = urls.select("page_id", *(c.alias(n) for c, n in zip(host_and_path("url"), ("host", "path"))))
    kind = dict(parts.dtypes)["page_id"]
    names = [r.text for r in ranked]
    verdicts = [r.verdict for r in ranked]

    def rows(batch):
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        fits = automaton.match([f".{h}{p}".encode() if h or p else b""
                                for h, p in zip(hosts, paths)])
        best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if names else [-1] * len(hosts)
        return {"page_id": batch.column("page_id"), "host": batch.column("host"),
                "path": batch.column("path"),
                "rule": [names[b] if b >= 0 else None for b in best],
                "verdict": [verdicts[b] if b >= 0 else default for b in best]}

    def run(batches):
        for batch in batches:
            schema = pa.schema([("page_id", batch.schema.field("page_id").type), ("host", pa.string()),
                                ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
            yield from per_batch(rows, schema)([batch])

    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
