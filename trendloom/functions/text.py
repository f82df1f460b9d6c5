"""Text normalisation, tokenisation and vocabulary matching as Column expressions.

Matching semantics (T1-T5), for a text ``t`` and a dictionary token -> canonical:

1. normalise: lower case, then ``f#`` -> ``fsharp``, ``c#`` -> ``csharp``,
   ``c++`` -> ``cpp`` (plain substring replacement, in that order)          (P6)
2. drop markup tags and ``http(s)://`` URLs, then cut the text into maximal
   chunks of letters/digits joined by ``- . / @`` (a ``/`` or ``~/`` prefix
   belongs to the chunk)                                                     (T1)
3. chunks containing ``.``, ``/`` or ``@`` (hosts, paths, e-mail, versions)
   are opaque and match nothing                                              (T2)
4. a chunk found in the dictionary yields its canonical word; unknown chunks
   yield nothing                                                             (T3)
5. the parts of a hyphenated chunk match by identity: a part equal to a
   canonical word yields it (``python-based`` -> python, ``py-based`` -> none) (T4)
6. the match set is the distinct union of 4 and 5                            (T5)

Everything runs JVM-side (regex functions and higher-order array functions);
the dictionary is folded in as a literal map, so matching is a map-only stage.
"""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the matching rules above.
TAG_PATTERN = r"<[/!?]?[a-z][^>]*>"
URL_PATTERN = r"https?://[^ \t\n\x0B\f\r]+"
CHUNK_PATTERN = r"(?:~?/)?[\p{L}\p{N}]+(?:[-./@]+[\p{L}\p{N}]+)*"
PART_SEPARATOR = r"-+"

# Fixed values: (search, replacement) applied in order after lower-casing.
TERM_REPLACEMENTS = (("f#", "fsharp"), ("c#", "csharp"), ("c++", "cpp"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_terms(text: Column | str) -> Column:
    """Lower, then the three term rewrites in order."""
    out = F.lower(_col(text))
    for search, repl in TERM_REPLACEMENTS:
        out = F.replace(out, F.lit(search), F.lit(repl))
    return out


def chunks(text: Column | str) -> Column:
    """Array of candidate chunks of the normalised text (NULL for NULL)."""
    cleaned = F.regexp_replace(normalize_terms(text), TAG_PATTERN, " ")
    cleaned = F.regexp_replace(cleaned, URL_PATTERN, " ")
    return F.regexp_extract_all(cleaned, F.lit(CHUNK_PATTERN), 0)


def _is_opaque(c: Column) -> Column:
    return c.contains(".") | c.contains("/") | c.contains("@")


def plain_chunks(text: Column | str) -> Column:
    """Chunks that are words or hyphenated compounds (not opaque)."""
    return F.filter(chunks(text), lambda c: ~_is_opaque(c))


def _map_literal(pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def _array_literal(values) -> Column:
    values = sorted(set(values))
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (a one-element
    ``transform``), so an expensive input used twice is not computed twice."""
    return F.transform(F.array(value), body).getItem(0)


def match_from_chunks(words: Column, synonyms: dict[str, str]) -> Column:
    """T3-T5 on an array of plain chunks (see :func:`plain_chunks`).

    Dictionary look-ups are set intersections with literal arrays
    (``array_intersect``: generated code over a hash set), so only the few
    chunks that are dictionary tokens reach the map look-up.
    """
    syn = _map_literal(synonyms)
    tokens = _array_literal(synonyms.keys())
    canon = _array_literal(synonyms.values())
    whole = F.transform(F.array_intersect(words, tokens), lambda c: F.element_at(syn, c))
    compounds = F.filter(words, lambda c: c.contains("-"))
    parts = F.array_intersect(
        F.flatten(F.transform(compounds, lambda c: F.split(c, PART_SEPARATOR))), canon)
    return F.array_distinct(F.concat(whole, parts))


def match_words(text: Column | str, synonyms: dict[str, str]) -> Column:
    """Distinct canonical words matched in ``text`` (array<string>).

    ``synonyms`` is a bounded token -> canonical dictionary.  NULL text gives a
    NULL array (no rows after ``explode``); text without matches an empty one.
    """
    return _let(plain_chunks(text), lambda words: match_from_chunks(words, synonyms))


def contains_word(text: Column | str, word: str, synonyms: dict[str, str]) -> Column:
    """does ``text`` match the (single-word) query ``word``?

    The query word goes through the dictionary too; a word it does not know
    matches nothing.  NULL text never matches.
    """
    target = synonyms.get(word.lower())
    if target is None:
        return F.lit(False)
    return F.coalesce(F.array_contains(match_words(text, synonyms), F.lit(target)), F.lit(False))


# ---- HTML entities (P3) ------------------------------------------------------

_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});"


def _named_references() -> dict[str, str]:
    """``&name;`` -> characters, from the standard library's HTML5 table."""
    return {f"&{name}": chars for name, chars in html.entities.html5.items() if name.endswith(";")}


def _numbered(piece: Column) -> Column:
    """The character of a numeric reference; NULL for another piece.

    As HTML asks, 128-159 are read as windows-1252, and numbers that are no
    character become U+FFFD.
    """
    ten = F.nullif(F.regexp_extract(piece, "^&#0*([0-9]+);$", 1), F.lit(""))
    sixteen = F.nullif(F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]+);$", 1), F.lit(""))
    beyond = F.lit(0x110000).cast("long")                     # more digits than any character has
    number = F.coalesce(F.when(F.length(ten) > 7, beyond).otherwise(ten.try_cast("long")),
                        F.when(F.length(sixteen) > 6, beyond).otherwise(F.conv(sixteen, 16, 10).try_cast("long")))
    windows = {str(i): html.unescape(f"&#{i};") for i in range(128, 160)}
    known = F.from_json(F.lit(json.dumps(windows)), "map<string,string>")
    bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return (F.when(number.isNull(), F.lit(None).cast("string")).when(bad, F.lit("\ufffd"))
            .when(number.between(128, 159), F.element_at(known, number.cast("string")))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))


def unescape_html(text: Column | str) -> Column:
    """Decode every ``;``-terminated named or numeric reference in one
    pass, JVM-side; NULL -> ''.

    The text is cut into references and what lies between; each reference is
    looked up once, so what it stands for is not read again (``&amp;lt;`` ->
    ``&lt;``).  Unknown references and tags stay in the text.
    """
    named = F.from_json(F.lit(json.dumps(_named_references())), "map<string,string>")
    pieces = F.regexp_extract_all(_col(text), F.lit(_REFERENCE + "|[^&]+|&"), 0)
    decoded = F.transform(pieces, lambda p: F.when(
        p.startswith("&") & p.endswith(";"), F.coalesce(F.element_at(named, p), _numbered(p), p)).otherwise(p))
    whole = F.when(_col(text).contains("&"), F.array_join(decoded, "")).otherwise(_col(text))
    return F.coalesce(whole, F.lit(""))
