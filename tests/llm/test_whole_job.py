"""Cases that the operators once left out, at the registered parameters."""

import corpus_pipeline
import numpy as np
import pytest

from trendloom.llm import decontaminate, language_id, line_dedup, queries, toxicity

LETTERS = list("abcdefghijklmnopqrstuvwxyz")


def words_of_six(rng, n):
    return ["".join(rng.choice(LETTERS, 6)) for _ in range(n)]


def test_short_lines_with_one_word_or_character_changed(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, far = [], []
    for i in range(60):
        words = words_of_six(rng, 8 if i % 2 else 14)              # 55 or 97 characters
        rows.append((2 * i, " ".join(words)))
        at = len(words) // 2
        words[at] = words[at][:3] + "0" + words[at][4:] if i % 2 else "zzzzzz"
        rows.append((2 * i + 1, " ".join(words)))
    for i in range(10):                                            # half of the words: no link
        words = words_of_six(rng, 14)
        far += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join(words[:7] + words_of_six(rng, 7)))]
    spark.createDataFrame(rows + far, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert sum(got[2 * i + 1] for i in range(60)) >= 59            # banding may miss one
    assert not any(got[2 * i] for i in range(60)) and not any(got[i] for i, _ in far)


def test_bands_meet_at_the_stated_rate():
    miss = (1 - 0.8 ** line_dedup.ROWS) ** line_dedup.BANDS
    assert miss < 0.005
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(LETTERS, 300)) for _ in range(1500)]
    other = ["".join(rng.choice(LETTERS, 33)) + x[33:] for x in base]        # Jaccard 263 / 329
    met = (line_dedup.band_keys(base, 5) == line_dedup.band_keys(other, 5)).any(axis=1)
    assert met.mean() > 0.985


def test_documents_keep_their_short_lines(spark):
    """A repeated line takes no document with it that has short lines left."""
    licence = "permission is granted to copy this text in any form"
    rows = [(1, licence), (2, licence + "\nrose is a rose\nis a rose"), (3, licence + "\n \n\t"),
            (4, "x = 1\n" + licence + "\ny = 2"), (5, licence), (6, "\u65e5\u672c\u8a9e\u306e\u6587\n" + licence), (7, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.distinct_lines(spark, df, None).collect()}
    assert got == {1: licence, 2: "rose is a rose\nis a rose", 4: "x = 1\ny = 2", 6: "\u65e5\u672c\u8a9e\u306e\u6587", 7: "\n"}


def test_items_with_words_replaced_at_their_ends(spark):
    rng = np.random.default_rng(6)
    items, docs, want = [], [], set()
    for n in range(6, 21):
        for replaced in ([], [n - 1], [0, n - 1], [0, 2, n - 1]):
            if len(replaced) > n // 5 or n == 6 and replaced:
                continue
            i = len(items)
            words = words_of_six(rng, n)
            items.append((i, " ".join(words)))
            part = ["other" if p in replaced else w for p, w in enumerate(words)]
            docs.append((i, " ".join(words_of_six(rng, 40) + part + words_of_six(rng, 40))))
            want.add((i, i))
    long = words_of_six(rng, 60)                                   # half an item, replaced near the passage's ends
    items.append((1000, " ".join(long)))
    docs.append((1000, " ".join(words_of_six(rng, 40) + [*long[20:22], "other", *long[23:33], "other", *long[34:36]]
                                + words_of_six(rng, 40))))
    want.add((1000, 1000))
    for k in (1001, 1002):                                         # six equal words, then every second one: no overlap
        words = words_of_six(rng, 20)
        items.append((k, " ".join(words)))
        docs.append((k, " ".join([*words[:6], *(w if p % 2 else "other" for p, w in enumerate(words[6:]))])))
    got = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_equal >= 0.8 * r.n_words for r in got)


def test_longest_run_is_that_of_all_runs():
    rng = np.random.default_rng(7)
    for _ in range(300):
        equal = rng.random(int(rng.integers(1, 25))) < 0.75
        runs = [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
                if equal[a] and equal[b - 1] and 5 * equal[a:b].sum() >= 4 * (b - a)]
        start, end, same = decontaminate.longest_run(equal)
        assert end - start == max(runs, default=0) and same == equal[start:end].sum()
        assert not runs or 5 * same >= 4 * (end - start)


def test_letters_inserted_into_short_insults():
    insults = ("idiot", "trash", "loser", "moron", "stupid")
    k = toxicity.LandmarkKernel(insults)
    made = [(w, w[:a] + x + w[a:b] + y + w[b:]) for w in insults for x in ("x", "z") for y in ("", "x", "z")
            for a in range(len(w) + 1) for b in range(a, len(w) + 1)]
    made += [("idiot", "idxxiot"), ("stupid", "stuxxpid"), ("idiot", "idxiozt"), ("trash", "trxaszh"), ("loser", "loxsezr")]
    value = toxicity.normalised(toxicity.codes([m for _, m in made]), toxicity.codes([w for w, _ in made]))
    k.learn({m for _, m in made})
    for (w, m), v in zip(made, value):                             # the screen loses nothing above the floor
        got = k.values[m][insults.index(w)] if m in k.values else 0
        assert got == (pytest.approx(v, abs=1e-4) if v >= 0.3 else 0) or abs(v - 0.3) < 1e-4, (w, m, v)
    one = [v for (w, m), v in zip(made, value) if len(m) == len(w) + 1]
    assert min(one) >= 0.3 and min(value[-5:]) >= 0.3


def test_rare_languages_are_learned(spark):
    rows = [(i, "the house and the river are near", "en") for i in range(400)] + [(1000, "ztrq wxyv qqzk", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, max_train=20)
    assert set(model.languages) == {"en", "xx"}
    sample = language_id._sample(df.selectExpr("xxhash64(doc_id) h", "lang", "text"), 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample} == {"en": 10, "xx": 1}


def test_signatures_and_sketches_by_definition():
    """Lines signed and sketched together, over the ends of blocks, as one by one."""
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcdé ð𐍈"), n)) for n in [20, 21, 300, 5, 5, 64, *rng.integers(5, 90, 40)]]
    got, block = line_dedup.band_keys(lines, 5), line_dedup._SIGNED
    try:
        line_dedup._SIGNED = 70
        assert (line_dedup.band_keys(lines, 5) == got).all()
    finally:
        line_dedup._SIGNED = block
    for line, keys in zip(lines, got):
        grams = line_dedup.gram_hashes(np.array([ord(c) for c in line], dtype=np.uint32), 5)
        minima = [int((grams * a).min()) for a in line_dedup._A]
        for b in range(line_dedup.BANDS):
            h = np.array([line_dedup.tag(b, 60)])
            for r in range(line_dedup.ROWS):
                h += np.uint64(minima[b * line_dedup.ROWS + r]) * line_dedup.MULTIPLIERS[r:r + 1]
            assert line_dedup.signed(line_dedup.mix(h))[0] == keys[b]
    sets = line_dedup.gram_sets(lines)
    marks = line_dedup.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    for x, m in zip(sets, marks.view(np.uint64)):
        cells = {int(g) >> 52 for g in x}
        assert {i for i in range(line_dedup.SKETCH) if int(m[i >> 6]) >> (i & 63) & 1} == cells


def test_texts_that_lose_no_line_stay_as_they_are(spark):
    line = "a line of some twenty characters"
    docs = spark.createDataFrame([(1, f"{line}\n\nx"), (2, f"  {line}\r\n\tshort\n"), (3, None), (4, ""), (5, " y \r\n"),
                                  (6, line)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text, r.n, r.gone) for r in line_dedup.dedup_lines(docs, counts=("n", "gone")).collect()}
    assert got == {1: (f"{line}\n\nx", 3, 0), 2: ("\tshort\n", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0),
                   5: (" y \r\n", 2, 0), 6: ("", 1, 1)}
    left = line_dedup.dedup_lines(docs, drop_emptied=True).where("doc_id = 6 or doc_id = 3")
    assert [r.doc_id for r in left.collect()] == [3]


def test_many_lines_of_one_text_are_removed_at_once(spark):
    """A long text is taken apart once, and every kind of blank counts as one."""
    rng = np.random.default_rng(9)
    lines = [" ".join(words_of_six(rng, 5)) for _ in range(3000)]
    blanks = "\t\x0b\x0c\x1c \x85\xa0\u2003\u2028\u3000\r"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::-1]) + f"\n{blanks}\n"),
                                  (3, "\n".join(["x", *lines[:1500], "", *lines[1500:], "\u200b"]))],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n, r.gone) for r in line_dedup.dedup_lines(docs, counts=("n", "gone")).collect()}
    assert got == {1: ("\n".join(lines), 3000, 0), 2: (f"{blanks}\n", 3002, 3000), 3: ("x\n\n\u200b", 3003, 3000)}
    left = line_dedup.dedup_lines(docs, drop_emptied=True).collect()
    assert {r.doc_id: r.text for r in left} == {1: "\n".join(lines), 3: "x\n\n\u200b"}
