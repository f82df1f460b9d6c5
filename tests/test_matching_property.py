"""Brute-force check of the matching rules: a direct Python reading of the
specification (T1-T5) against the Spark column expressions, on generated text
made of the characters and fragments the rules care about."""

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trendloom.functions import text as tx
from trendloom.sources.dictionary import Dictionary

SYN = {"python": "python", "py": "python", "python3": "python", "cpp": "cpp",
       "csharp": "csharp", "fsharp": "fsharp", "k8s": "kubernetes", "go": "go",
       "rust": "rust", "der": "de", "de": "de", "é": "e"}

FRAGMENTS = ["py", "python", "Python3", "c++", "C#", "f#", "k8s", "go", "rust", "der", "de",
             "é", "Ü", "1", "42", "-", "--", ".", "/", "@", "~", "~/", " ", " ", "\n", ",",
             "<b>", "</b>", "<a href=\"x\">", "http://", "https://a.b/", "#", "+", "'", "_",
             "based", "org", "ñ"]

texts = st.lists(st.sampled_from(FRAGMENTS), min_size=0, max_size=14).map("".join)


def reference(text, syn):
    """T1-T5 read literally from the specification."""
    if text is None:
        return None
    t = text.lower()
    for search, repl in tx.TERM_REPLACEMENTS:
        t = t.replace(search, repl)
    t = regex.sub(tx.TAG_PATTERN, " ", t)
    t = regex.sub(tx.URL_PATTERN, " ", t)
    canon = set(syn.values())
    out = set()
    for chunk in regex.findall(tx.CHUNK_PATTERN, t):
        if any(ch in chunk for ch in "./@"):
            continue                                   # T2: opaque
        if chunk in syn:
            out.add(syn[chunk])                        # T3: whole chunk via dictionary
        if "-" in chunk:
            out.update(p for p in regex.split(tx.PART_SEPARATOR, chunk) if p in canon)  # T4
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=40, max_size=40))
def test_spark_matches_reference(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    got = [sorted(r[0]) for r in df.select(tx.match_words("t", SYN)).collect()]
    assert got == [reference(t, SYN) for t in batch]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=30, max_size=30))
def test_join_path_matches_reference(spark, batch):
    from trendloom.operators import matching
    rows = [(str(i), t) for i, t in enumerate(batch)]
    docs = spark.createDataFrame(rows, "objectid string, title string")
    kw = spark.createDataFrame([(c, True) for c in sorted(set(SYN.values()))],
                               "keyword string, include_hiring boolean")
    syn = spark.createDataFrame(sorted(SYN.items()), "token string, canonical string")
    got = sorted((r.word, r.objectid) for r in
                 matching.postings_by_join(docs, "title", ("objectid",), kw, syn).collect())
    # A keyword goes through the dictionary; one that is not a token
    # itself (here "kubernetes", "e") matches nothing
    keywords = sorted(set(SYN.values()))
    want = sorted((k, i) for i, t in rows for k in keywords
                  if k in SYN and SYN[k] in reference(t, SYN))
    assert got == want
    d = Dictionary.of(SYN, {c: True for c in SYN.values()})
    mapped = sorted((r.word, r.objectid) for r in
                    matching.postings(docs, "title", ("objectid",), d).collect())
    assert mapped == want


def test_reference_on_documents(spark):
    """The same comparison on real multilingual documents (whole texts)."""
    from tests.conftest import SF_SMALL
    from trendloom.plans import fixtures as fx
    syn = fx.DOC_SYNONYMS
    docs = fx.read(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = {r.doc_id: sorted(r.w) for r in
           docs.select("doc_id", tx.match_words("text", syn).alias("w")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == reference(r.text, syn), r.doc_id
