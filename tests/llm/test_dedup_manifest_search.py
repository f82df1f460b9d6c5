"""MinHash near-dedup, Merkle manifest and ranked search against plain versions,
and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK, SF_SMALL
from trendloom.llm import common, merkle, near_dup, queries, ranked_search
from trendloom.llm.hashing import WordHashes

PROSE = "the quick brown fox jumps over the lazy dog while seven other animals watch it closely"
LONG = " ".join(f"word{i % 977} of" for i in range(40_000))


# ---- MinHash near-dedup ------------------------------------------------------------

def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(sets, num=85):
    """Smallest id reachable over all pairs of similarity num / 100 or more."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_near(df, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = {i: (len(sets[i]), c, c == i) for i, c in classes(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == want


def test_near_duplicates_against_all_pairs(spark):
    df = common.read(spark, SF_CHECK, "documents").where("doc_id < 400")
    check_near(df, {r.doc_id: r.text for r in df.collect()})


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(out)


def test_near_duplicates_around_the_threshold(spark):
    """Chains and stars of edited copies, most of them around 0.85."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 120, 300)))]
        for share in (0, 0, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1):
            texts += [edited(rng, base, share) for _ in range(8)]
    texts += ["a b c", "A b  C", "a b d", "", " \n", None]
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    check_near(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(7), rows)


def test_tables_hold_similar_pairs_at_the_stated_rate():
    """Pairs of similarity s share a half key of both collections with P(s)."""
    rng = np.random.default_rng(3)
    for s, least, most in ((0.85, 0.995, 1), (0.5, 0.45, 0.65), (0.1, 0, 0.01)):
        n, met = 400, 0
        union, both = n, int(round(s * n))
        for _ in range(500):
            e = rng.integers(0, 2 ** 63, union, dtype=np.uint64) * np.uint64(2)
            cut = both + (union - both) // 2
            a, b = near_dup.half_keys(np.sort(e[:cut])), near_dup.half_keys(np.sort(np.concatenate((e[:both], e[cut:]))))
            same = a == b
            met += same[:near_dup.HALVES].any() and same[near_dup.HALVES:].any()
        assert least <= met / 500 <= most, (s, met)


def test_half_keys_tell_their_place():
    keys = near_dup.half_keys(near_dup.text_set(WordHashes(), "one"))
    assert len(set(keys.tolist())) == 2 * near_dup.HALVES


def test_near_duplicates_edges(spark):
    rows = [(1, PROSE, "x"), (1, PROSE, "y"), (None, PROSE, "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x"),
            (5, LONG + " end", "x"), (None, "all alone", "x"), (None, None, None), (9, "  \t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == {(1, 1, True): 2, (None, 1, False): 1, (2, 2, True): 1, (3, 3, True): 1, (4, 4, True): 1,
                   (5, 4, False): 1, (None, None, True): 2, (9, 9, True): 1}
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


# ---- Merkle manifest ---------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """The root, and each leaf's siblings left and right, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            begin = i - i % arity
            paths[k].append((level[begin:i], level[i + 1:begin + arity]))
            at[k] = i // arity
        level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def plain_manifest(rows, altered, arity=3):
    """Counter of (id, leaf, subroot, root, proof, folded root, verified)."""
    def leaf(r, text):
        values = (r[0], r[1], r[2], r[3], text)
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, altered(r)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s])], arity) for s in names]
    root, tops = plain_tree([t[0] for t in trees], arity)
    out = collections.Counter()
    for s, (subroot, paths), top in zip(names, trees, tops):
        for (_, _, own, test, key), path in zip(sorted(groups[s]), paths):
            proof = H(*(x for left, right in path + top for x in left + right))
            for left, right in path + top:
                test = H(*left, test, *right)
            out[key, own, subroot, root, proof, test, test == root] += 1
    return out


def without_line_ends(r):
    cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
    return r[4].replace("\n", "") if cut else r[4]


def manifest_rows(spark, df, arity=3):
    altered = F.when(common.fold("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.check_manifest(df, {"text": altered}, arity=arity)
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                               for r in out.collect())


DOCS = "doc_id long, source string, lang string, n_chars long, text string, h string, c long, path string"


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_against_a_plain_tree(spark, arity):
    rng = random.Random(arity)
    rows = [(i, rng.choice(["b", "a", "é", "Z", None, "a", "a", "a"]), rng.choice(["en", None]), rng.choice([None, i]),
             rng.choice([None, "", "x\ny", "日本\n", f"text {i}\n"]), "x", 1, "y") for i in range(211)]
    rows += [(1000, "alone", "en", 1, "one\nline", "x", 1, "y"), (None, "a", None, None, "n\n", "x", 1, "y"),
             (1001, "a", "en", 5, "same", "x", 1, "y"), (1001, "a", "en", 5, "same", "x", 1, "y"),
             (1001, "a", "en", 5, "other", "x", 1, "y"), (1002, "a", "en", 9, LONG, "x", 1, "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert manifest_rows(spark, df, arity) == plain_manifest(rows, without_line_ends, arity)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 10])
def test_manifest_sizes(spark, n):
    """One group only: its subroot is the root."""
    rows = [(i, "s", "en", 1, f"t{i}\n", "x", 1, "y") for i in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    assert manifest_rows(spark, df) == (plain_manifest(rows, without_line_ends) if n else {})


def test_verify_finds_changed_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "en", 1, f"t{i}", "x", 1, "y") for i in range(20)], DOCS)
    manifest = merkle.build_manifest(df)
    changed = df.where("doc_id <> 4").withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    changed = changed.union(spark.createDataFrame([(99, "a", "en", 1, "new", "x", 1, "y")], DOCS))
    got = {r.doc_id: r.verified for r in merkle.verify(manifest, changed).collect()}
    assert got == {i: i != 7 for i in range(20) if i != 4} | {99: None}


# ---- ranked search -----------------------------------------------------------------

def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    bags = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked, found = collections.Counter(plain_terms(text)), []
        for (doc, bag), size in zip(bags, sizes):
            score = 0
            for w, times in asked.items():
                if bag[w]:
                    m = 75 + (25 * size * n) // total
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += times * weight * ((10 ** 9 * bag[w]) // (1000 * bag[w] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return collections.Counter(out)


def search_rows(docs, items, **options):
    return collections.Counter((r.item_id, r["rank"], r.doc_id, r.score)
                               for r in ranked_search.top_documents(docs, items, **options).collect())


def test_ranked_search_against_all_scores(spark):
    docs, items = (common.read(spark, SF_SMALL, t) for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    assert search_rows(docs, items) == want


def test_ranked_search_ties_blocks_and_small_shards(spark, monkeypatch):
    """Many equal scores, several blocks of items, shards of few documents."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "delta", "é", "日本", "x1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 2, 3, 30))))) for i in range(700)]
    docs += [(5, "alpha"), (5, "alpha"), (None, "alpha beta"), (None, None), (900, ""), (901, "--- !"), (902, LONG)]
    items = [(1, "ALPHA alpha beta"), (2, "gamma, DELTA; é"), (2, "gamma, DELTA; é"), (3, "unknown words"), (4, None),
             (None, "日本 x1"), (6, "..."), (7, "word3 of of of alpha")]
    monkeypatch.setattr(ranked_search, "BLOCK_CHARACTERS", 20)
    monkeypatch.setattr(ranked_search, "SHARD", 64)
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, item int, score double")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert search_rows(d.repartition(6), q, k=7) == plain_search(docs, items, 7)


def test_ranked_search_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search_rows(d.limit(0), q) == {} and search_rows(d, q.limit(0)) == {}


def test_threshold_stops_before_the_lists_end():
    """Long lists with one clear winner are not read to their ends."""
    rng = np.random.default_rng(1)
    size, terms = 4096, 6
    rows = [(t, d, int(c)) for t in range(terms) for d, c in enumerate(rng.integers(1, 4, size))]
    rows += [(t, size, 1000) for t in range(terms)]
    t, d, c = (np.array(x, dtype=np.int64) for x in zip(*sorted(rows, key=lambda r: (r[1], r[0]))))
    shard = ranked_search.Shard(np.full(terms, 1000), t, d, c, np.full(size + 1, 100))
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, index):
            out = super().__getitem__(index)
            reads.append(np.size(out))
            return np.asarray(out)

    shard.positions = shard.positions.view(Counted)
    places, scores = shard.best(np.arange(terms), np.ones(terms, np.int64), 1, 1)
    assert places[scores.argmax()] == size and sum(reads) < size * terms / 2


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_ranked_search"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from tools.check_oracle import digest
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = digest(queries.queries()[name](spark, SF_SMALL).toPandas())
    assert got == digest(con.sql(queries.oracle_sql()[name]).df())
