"""What the operators hold at once and write in between."""

import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from trendloom.llm import clusters, common, line_dedup, ngram_join, packing


class Rows:
    """Stands for a table of texts: gives back the function that its tasks would run."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        return run


def test_sets_are_written_slice_by_slice(spark):
    texts = [f"{i} " + "a b c d e f " * 20_000 if i % 7 else None for i in range(40)]      # 240,000 characters each
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    none = np.zeros(1 << 18, dtype=np.uint64)
    made = list(ngram_join._signatures(Rows(spark), (none, none))([batch]))
    assert max(b.num_rows for b in made) <= 6
    rows = pa.Table.from_batches(made).to_pylist()
    words = ngram_join.WordHashes()
    assert [r["doc_id"] for r in rows] == list(range(40))
    assert [r["n"] for r in rows] == [len(ngram_join.text_set(words, t or "")) for t in texts]


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 1, 5])
    for values in (rng.integers(-9, 9, 9), rng.integers(0, 99, 9).astype(np.int32), rng.integers(0, 256, (9, 115)).astype(np.uint8)):
        column = line_dedup.packed(values, sizes)
        got, lengths = line_dedup.unpacked(column, values.dtype.type)
        assert (got == values.ravel()).all() and (lengths == sizes * (values.nbytes // 9)).all()
        got, lengths = line_dedup.unpacked(column.slice(1, 2), values.dtype.type)
        assert (got == values[3:4].ravel()).all() and len(lengths) == 2
    assert len(line_dedup.unpacked(line_dedup.packed(np.empty((0, 115), np.uint8), []), np.uint8)[0]) == 0


def test_band_keys_in_five_bytes():
    """Keys stay those of their band and meet where the full ones do."""
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcdef"), 60)) for _ in range(200)]
    keys = line_dedup.band_keys(lines + lines[:50])
    kept = line_dedup.kept_keys(line_dedup.kept_bytes(keys))
    assert (kept >> np.uint64(24) == keys.view(np.uint64) >> np.uint64(24)).all()
    assert (kept & np.uint64((1 << 24) - 1) == np.arange(line_dedup.BANDS, dtype=np.uint64)).all()
    assert len(np.unique(kept)) == len(np.unique(keys))


def test_lines_of_a_document_are_one_row_of_few_bytes(spark, monkeypatch):
    made = {}
    save = common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, name: made.setdefault(name, save(self, df, name)))
    lines = [[f"line {i} {j} " + "abcdefghij" * 3 for j in range(1500 if i == 3 else 20)] for i in range(5)]
    lines[4] = lines[0]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert kept[4] == "" and kept[0].startswith("line 0 0 ")
    rows = made["lines"].collect()
    assert len(rows) == 6                                          # 1500 lines: two rows
    assert sum(len(r.nodes) for r in rows) == 8 * 1580
    assert sum(len(r.bands) for r in rows) == 1580 * line_dedup.BANDS * 5


def test_sketches_that_joins_carry_are_short(spark, monkeypatch):
    made = {}
    save = common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, name: made.setdefault(name, save(self, df, name)))
    rng = np.random.default_rng(8)
    start, lines = [f"word{k}" for k in range(30)], []
    for _ in range(60):
        line = list(start)
        for k in rng.choice(30, 4, replace=False):
            line[k] = f"other{rng.integers(400)}"
        lines.append(" ".join(line))
    line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    rows = made["limits"].collect()
    assert rows and all(len(r.sketch) * 64 == 1024 for r in rows)


def test_stars_take_no_further_step(spark):
    """Edges that are stars already are done; others are made stars."""
    for pairs, want in (([(1, 5), (1, 9), (2, 7)], {1: 1, 5: 1, 9: 1, 2: 2, 7: 2}),
                        ([(1, 5), (5, 9), (9, 12), (2, 7)], {1: 1, 5: 1, 9: 1, 12: 1, 2: 2, 7: 2}),
                        ([(1, 5), (2, 5)], {1: 1, 2: 1, 5: 1}), ([(4, 4)], {})):
        edges = clusters._largest_first(spark.createDataFrame(pairs, "a long, b long"))
        stars = sorted((v, u) for u, v in edges.collect()) == sorted((c, n) for n, c in want.items() if n != c)
        assert clusters._are_stars(edges) == stars
        scratch, names = common.Scratch(spark, "t"), []
        save = scratch.save
        scratch.save = lambda df, name: (names.append(name), save(df, name))[1]
        got = clusters.components(scratch, spark.createDataFrame(pairs, "a long, b long"), "c")
        assert {r.node: r.comp for r in got.collect()} == want
        assert (names == ["c-0"]) == stars


def test_a_worker_keeps_few_words_between_packing_tasks(monkeypatch):
    """The others go; the ids are those of a whole encoding."""
    path = public_tokenizers.path("word_bpe_49k.json")
    packing._tokens.cache_clear()
    monkeypatch.setattr(packing, "_KEPT_WORDS", 500, raising=False)
    monkeypatch.setattr(packing, "_CACHED_WORDS", 2_000)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = ["the first words " + " ".join(f"w{i}x{j}" for j in range(900)) for i in range(8)]
    made = []
    for some in (texts[:4], texts[4:]):                            # two tasks of one worker
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some)], names=["doc_id", "text"])
        made += pa.Table.from_batches(list(packing._pieces(path, 1 << 20)([batch]))).to_pylist()
        kept = packing._tokens(path)
        assert "" in kept and len(kept) <= 500
    whole = kept.tokenizer
    for row, text in zip(made, texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, packing.CLOSING_ID], dtype="<u4")
        assert (row["length"], row["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    packing._tokens.cache_clear()
