"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
column names: every operator and every pipeline stage, with its defined result."""

import public_tokenizers
import pytest

import corpus_pipeline
from trendloom.llm import (cover_tree, decontaminate, language_id, line_dedup, ngram_join, packing, quality,
                           secret_scan, toxicity, url_filter)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals watch it closely"
LONG = " ".join(f"word{i % 977} of" for i in range(40_000))
CLASHING = "node string, key string, n long, h string, label string, drops string, bad_id long, row long, rank long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None, "a", "b", 1, "c", "d", "e", 2, 3, 4)


ROWS = [row(1, PROSE), row(1, PROSE), row(2, None), row(3, ""), row(None, PROSE + "\n" + PROSE), row(4, LONG),
        row(5, "short"), row(6, PROSE + " again", None, None), row(7, "\x00 \ud7ff 日本語 123"), row(None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (99, 0, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, PROSE), (3, None), (4, ""), (None, "short"), (5, LONG[:3000])],
                                 "item_id long, text string")


def test_decontamination(docs, empty, bench, spark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == {(d, i) for d in (1, None, 6) for i in (1, 2)} | {(4, 5), (5, None)}
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 7]
    assert decontaminate.find_overlaps(empty, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_quality(docs, empty, labels):
    assert quality.score_quality(docs, labels).count() == len(ROWS)
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.score_quality(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0


def test_toxicity(docs, empty, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_language(docs, empty):
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(ROWS)
    assert [r.lang_pred for r in rows if r.doc_id in (2, 3)] == ["und", "und"]
    assert {r.lang_pred for r in rows if r.doc_id in (1, 5)} == {"en"}
    assert language_id.identify(empty).count() == 0


def test_urls(spark):
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "a.net", "/x/")]
    urls = [None, "", "no scheme", "http://A.NET/x/1?q#f", "http://b.net", "http://b.net/", "x://c.com/a.net/x/",
            "http://net/", "http://anet/x/", "http://é.net/" + "y" * 5000, "http://b.net?x/", "p://q://r.net/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got[0] == ("", None, "allow") and got[3] == ("a.net", "a.net/x/", "allow") and got[5][1:] == ("net/", "block")
    assert [got[i][2] for i in (1, 2, 4, 6, 8, 10)] == ["allow"] * 6 and got[7][1] == got[9][1] == "net/"
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert url_filter.judge_urls(df, []).where("verdict = 'allow'").count() == df.count()


def test_packing(docs, empty):
    rows = packing.pack(docs, TOKENIZER).collect()
    assert sorted(r.length for r in rows if r.doc_id in (2, 3)) == [1, 1]
    assert sum(r.doc_id == 1 and r.piece == 0 for r in rows) == 2
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_lines(docs, empty):
    out = line_dedup.dedup_lines(docs, counts=("before", "gone"))
    rows = out.collect()
    assert out.columns == [*docs.columns, "before", "gone"] and len(rows) == len(ROWS)
    both_null = [r for r in rows if r.doc_id is None]
    assert {r.text for r in both_null} == {PROSE, None}             # a null id comes first, one line stays
    assert [r.text for r in rows if r.doc_id == 1] == ["", ""]
    assert [r.text for r in rows if r.doc_id in (2, 3, 5)] == [None, "", "short"]
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs, drop_emptied=True).where("doc_id = 1").count() == 0


def test_ngrams(docs, empty):
    rows = ngram_join.ngram_components(docs).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(ROWS) and {(2, 0, 2), (3, 0, 3), (None, 0, None), (5, 1, 5)} <= got
    assert {c for d, _, c in got if d in (1, 6)} == {1}
    assert ngram_join.ngram_components(empty).count() == 0


def test_secrets(docs, empty):
    rows = secret_scan.scan_secrets(docs).collect()
    assert len(rows) == len(ROWS) and all(r.spans == "" for r in rows)
    assert secret_scan.scan_secrets(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (40, [-1.0, -1.0]), (20, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in
           cover_tree.top_k(df, k=3).orderBy("query_id", "rank").collect()]
    top = 64 * 64 + 128 * 128
    assert got[:3] == [(20, 1, 1, top), (20, 2, 2, top), (20, 3, 2, 32 * 64)]
    assert got[3:] == [(40, 1, 2, -32 * 64), (40, 2, 1, -64 * 64 - 64 * 128), (40, 3, 2, -64 * 64 - 64 * 128)]
    assert cover_tree.top_k(df.limit(0)).count() == 0


def test_stages(spark, docs, empty, tmp_path, labels, bench):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, empty):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = kept.count()
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == start.columns and kept.count() <= before, name
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()} == {
            r.doc_id for r in kept.collect()}
