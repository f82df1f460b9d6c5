"""Vocabulary sources (S2, S3) and the bounded dictionary.

The keyword list and the synonym file are read as DataFrames.  Matching needs
them on every executor, so they are turned into a :class:`Dictionary` — but
only after checking their size: at most ``max_entries`` rows are ever brought
to the driver.  A larger one stays distributed, as :class:`DictionaryTables`.
:func:`any_dictionary` gives whichever fits; matching, refresh and streams take
both (``operators.matching``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, vocab
from ..session import scratch_path

# Largest dictionary folded into a column expression (map literal).  Larger
# dictionaries are matched with the join path instead.  Measured on the 10,000
# sf0.1 documents (local[8]): map literal 4.2 s / 7.6 s / 45-52 s for 50 /
# 1,000 / 10,000 tokens (array_intersect hashes the literal per row), join
# path 16-18 s at every size; the crossover is near 2,900 tokens.
MAP_LIMIT = 2_000


class DictionaryTooLarge(ValueError):
    pass


def read_keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary CSV (comma delimiter, header row), explicit schema."""
    return (spark.read.option("header", True).option("delimiter", ",")
            .schema(schema.KEYWORD_LIST).csv(path))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """S3: whitespace-separated ``token canonical`` lines; repeats collapse.

    Tokens are case-folded, as the synonym dictionary folds its input.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (spark.read.text(path)
            .where(F.trim(F.col("value")) != "")
            .select(F.lower(parts.getItem(0)).alias("token"),
                    F.lower(parts.getItem(1)).alias("canonical"))
            .where(F.col("canonical").isNotNull())
            # first canonical per token; the file's repeated line is identical
            .groupBy("token").agg(F.min("canonical").alias("canonical")))


def default_keyword_list(spark: SparkSession) -> DataFrame:
    rows = [line.split(",") for line in vocab.KEYWORDS_CSV.strip().splitlines()[1:]]
    data = [(k, d, inc.strip().lower() == "true", img) for k, d, inc, img in rows]
    return spark.createDataFrame(data, schema.KEYWORD_LIST)


def default_synonyms(spark: SparkSession) -> DataFrame:
    seen: dict[str, str] = {}
    for line in vocab.SYNONYMS_TEXT.splitlines():
        parts = line.split()
        if len(parts) >= 2 and parts[0].lower() not in seen:
            seen[parts[0].lower()] = parts[1].lower()
    return spark.createDataFrame(sorted(seen.items()), schema.SYNONYMS)


@dataclass(frozen=True)
class Dictionary:
    """A bounded vocabulary, held on the driver to be folded into expressions.

    ``synonyms``  token -> canonical word (all tokens of the dictionary)
    ``keywords``  keyword -> (canonical word or None, include_hiring)
    """

    synonyms: dict[str, str]
    keywords: dict[str, tuple[str | None, bool | None]] = field(default_factory=dict)

    @property
    def canonical_words(self) -> list[str]:
        return sorted(set(self.synonyms.values()))

    def effective(self, hiring_only: bool = False) -> dict[str, str]:
        """Keyword -> canonical, for keywords the dictionary knows."""
        return {k: c for k, (c, inc) in sorted(self.keywords.items())
                if c is not None and (not hiring_only or inc is True)}

    def dropped_keywords(self) -> list[str]:
        """Keywords absent from the synonym dictionary (they match nothing)."""
        return sorted(k for k, (c, _) in self.keywords.items() if c is None)

    def restricted(self, hiring_only: bool = False) -> "Dictionary":
        """Only the tokens whose canonical word some keyword needs."""
        targets = set(self.effective(hiring_only).values())
        return Dictionary({t: c for t, c in self.synonyms.items() if c in targets},
                          {k: v for k, v in self.keywords.items()
                           if v[0] in targets and (not hiring_only or v[1] is True)})

    def fingerprint(self) -> str:
        """A digest of the dictionary: facts matched with another one are stale."""
        import hashlib
        text = repr((sorted(self.synonyms.items()),
                     sorted((k, c or "", bool(inc)) for k, (c, inc) in self.keywords.items())))
        return hashlib.sha256(text.encode()).hexdigest()

    @staticmethod
    def of(synonyms: dict[str, str], keywords: dict[str, bool | None] | None = None) -> "Dictionary":
        syn = {t.lower(): c.lower() for t, c in synonyms.items()}
        kw = {k: (syn.get(k.lower()), inc) for k, inc in (keywords or {}).items()}
        return Dictionary(syn, kw)


def _bounded_rows(df: DataFrame, max_entries: int, what: str) -> list:
    rows = df.limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise DictionaryTooLarge(f"{what} has more than {max_entries} rows")
    return rows


def folded_synonyms(synonyms: DataFrame) -> DataFrame:
    """(token, canonical) in lower case, one canonical word (the smallest) a token."""
    return (synonyms.where(F.col("token").isNotNull() & F.col("canonical").isNotNull())
            .groupBy(F.lower("token").alias("token")).agg(F.min(F.lower("canonical")).alias("canonical")))


def folded_keywords(keyword_list: DataFrame) -> DataFrame:
    """(keyword, include_hiring), one row a keyword as written; flagged if any row is."""
    return (keyword_list.where(F.col("keyword").isNotNull())
            .groupBy("keyword").agg(F.max("include_hiring").alias("include_hiring")))


class Meanings(NamedTuple):
    """A :class:`DictionaryTables` as matching needs it.

    ``tokens`` (token, whole, part), a row a token: what it stands for as a chunk and as
    a part of a compound, or null; a keyword where each canonical word has only one,
    else the canonical word, whose keywords are in ``words`` (word, canonical).
    ``sole``: no two tokens stand for one word."""

    tokens: DataFrame
    words: DataFrame | None
    sole: bool


def _written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = scratch_path(spark, f"dictionary-{name}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class DictionaryTables:
    """A vocabulary of any size, held as tables; the counterpart of :class:`Dictionary`."""

    def __init__(self, keyword_list: DataFrame, synonyms: DataFrame):
        self.keywords, self.synonyms = folded_keywords(keyword_list), folded_synonyms(synonyms)
        self._meanings: dict[bool, Meanings] = {}

    def vocabulary(self, hiring_only: bool = False) -> DataFrame:
        """(word, canonical) of the keywords that the dictionary knows."""
        kept = self.keywords.where("include_hiring") if hiring_only else self.keywords
        return kept.join(self.synonyms, F.lower(kept["keyword"]) == self.synonyms["token"]).select(
            F.col("keyword").alias("word"), "canonical")

    def lookup(self, hiring_only: bool = False) -> DataFrame:
        """(token, kind, canonical): what chunks (``whole``) and parts of compounds
        (``part``) stand for, as far as some keyword needs it."""
        needed = self.vocabulary(hiring_only).select("canonical").distinct()
        whole = self.synonyms.join(needed, "canonical", "left_semi")
        parts = needed.join(self.synonyms.select("canonical").distinct(), "canonical", "left_semi")
        return whole.select("token", F.lit("whole").alias("kind"), "canonical").unionByName(
            parts.select(F.col("canonical").alias("token"), F.lit("part").alias("kind"), "canonical"))

    def meanings(self, hiring_only: bool = False) -> Meanings:
        """The lookup by token, written once to the scratch folder: what it is derived
        from, a corpus maybe, is not read again wherever it is used."""
        if hiring_only not in self._meanings:
            words = _written(self.vocabulary(hiring_only), "vocabulary")
            lookup = _written(self.lookup(hiring_only), "lookup")
            single = words.groupBy("canonical").count().where("count > 1").isEmpty()
            sole = (lookup.select("token", "canonical").distinct().groupBy("canonical").count()
                    .where("count > 1").isEmpty())
            named = lookup.join(words, "canonical") if single else lookup.withColumn("word", F.col("canonical"))
            tokens = _written(named.groupBy("token").agg(
                F.max(F.when(F.col("kind") == "whole", F.col("word"))).alias("whole"),
                F.max(F.when(F.col("kind") == "part", F.col("word"))).alias("part")), "meanings")
            self._meanings[hiring_only] = Meanings(tokens, None if single else words, sole)
        return self._meanings[hiring_only]

    def fingerprint(self) -> str:
        """A digest of both tables, from sums over their rows."""
        def mark(rows: DataFrame) -> str:
            r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
            return f"{r['n']}:{r['s']}"
        return f"tables:{mark(self.keywords)}:{mark(self.synonyms)}"


def effective_vocabulary(keyword_list: DataFrame, synonyms: DataFrame) -> DataFrame:
    """T6 as a DataFrame: (keyword, canonical, include_hiring) for the keywords
    the dictionary knows.  A keyword goes through the dictionary like a query
    term does; one absent from it matches nothing."""
    kws = keyword_list.where(F.col("keyword").isNotNull()).dropDuplicates(["keyword"])
    # no broadcast hint: the synonym table's size is not known here; the
    # planner broadcasts it only under its size threshold
    return (kws.join(synonyms, F.lower(kws["keyword"]) == synonyms["token"], "inner")
            .select("keyword", "canonical", "include_hiring"))


def load_dictionary(keyword_list: DataFrame, synonyms: DataFrame,
                    max_entries: int | None = None) -> Dictionary:
    """Bring a size-checked vocabulary to the driver (raises if over the bound,
    ``MAP_LIMIT`` by default)."""
    max_entries = MAP_LIMIT if max_entries is None else max_entries
    syn = {r["token"]: r["canonical"]
           for r in _bounded_rows(folded_synonyms(synonyms), max_entries, "synonym dictionary")}
    kw_rows = _bounded_rows(folded_keywords(keyword_list), max_entries, "keyword list")
    return Dictionary.of(syn, {r["keyword"]: r["include_hiring"] for r in kw_rows})


def any_dictionary(keyword_list: DataFrame, synonyms: DataFrame) -> "Dictionary | DictionaryTables":
    """The vocabulary in the form that its size allows: up to ``MAP_LIMIT`` tokens
    on the driver, to be folded into expressions; tables beyond."""
    try:
        return load_dictionary(keyword_list, synonyms)
    except DictionaryTooLarge:
        return DictionaryTables(keyword_list, synonyms)


def default_dictionary(spark: SparkSession) -> Dictionary:
    return load_dictionary(default_keyword_list(spark), default_synonyms(spark))
