"""Tokens, chunks and links as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"

# The English stop words of search, and those of the stemmer's tokenizer.
SEARCH_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by could did do "
    "does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is "
    "it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she "
    "should so some such than that the their theirs them themselves then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
STEM_STOPWORDS = "a about an and are as at be by com de en for from how i in is it la of on or that the this to was what when where who will with und www".split()


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case. Split first, as lower('İ') has a mark that would split."""
    return F.filter(F.transform(F.split(text, SEPARATORS), F.lower), lambda t: t != "")


def without(words: Column, stop: list[str]) -> Column:
    """words that are not in stop, repeats kept: one look into a hash set for each."""
    return F.filter(words, lambda t: ~t.isin(list(stop))) if stop else words


def tokens_with_stopwords(text: Column, stop: list[str] | None = None) -> Column:
    return without(tokens(text), SEARCH_STOPWORDS if stop is None else stop)


def longer_than(words: Column, least_bytes: int) -> Column:
    return F.filter(words, lambda t: F.octet_length(t) >= least_bytes)


def count_chars(text: Column) -> Column:
    """Unicode scalar values."""
    return F.length(text).cast("long")


def fixed_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of `size` characters, each starting `size - overlap` after the last; an empty text has none."""
    if size <= 0 or overlap >= size:
        raise ValueError("chunk size must be positive and greater than the overlap")
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0)) / step
    starts = F.sequence(F.lit(0), F.floor(last).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(text.isNotNull(), pieces)


LINK = r"(?i)\bhttps?://[a-z0-9][a-z0-9.-]*(?::[0-9]+)?(?:/[a-z0-9._~%/?#=&+-]*[a-z0-9_~%/#=&+-])?"
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+\b"


def links(text: Column) -> Column:
    """http and https links of ASCII texts, in order."""
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(0))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def link_spans(text: Column) -> Column:
    """Byte ranges of the links of a text, in order: start and end."""
    import re

    from loomtext.functions.udf import scalar

    def run(t: str) -> list[dict]:
        return [{"start": len(t[: m.start()].encode()), "end": len(t[: m.end()].encode())} for m in re.finditer(LINK, t, re.A)]

    return scalar(run, "array<struct<start:int,end:int>>")(text)


def has_link(text: Column) -> Column:
    return text.rlike(LINK)


def ascii_slug(text: Column, sep: str = "-") -> Column:
    """Slug of ASCII texts: runs of letters and digits in lower case, joined."""
    return F.array_join(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""), sep)


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """A field with quotes where it needs them."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    needs = v.rlike(f'["\\r\\n{"".join(chr(92) + c for c in delimiter)}]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(values: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *(csv_field(v, delimiter) for v in values))


def json_rows(values: list[Column]) -> Column:
    """A row as a JSON array of strings."""
    return F.to_json(F.array(*(F.coalesce(v.cast("string"), F.lit("")) for v in values)))
