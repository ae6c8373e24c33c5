"""Text expressions: tokenising, stripping and tests of words. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is two letters or more, with apostrophes, hyphens, dots and middle dots inside.
TOKEN = r"\p{L}[-'\x{2019}.\x{00B7}\p{L}]*\p{L}"
# Tags, addresses and entities of web pages; sentences.
TAG, URL, ENTITY = r"<[^>]+>", r"""(?i)(https?://|www\.)[^\s"'<>]+""", r"&(?:[a-zA-Z]+|#\d+);"
SENTENCE = r"[^.!?]+[.!?]+|\S.*$"
# Words that betray leftovers of web pages.
WEB_WORDS = ("http", "https", "www", "href", "aspx", "html", "nbsp")


def tokenize(text: Column, lowercase: bool = True, stopwords: Iterable[str] = (), min_length: int = 0) -> Column:
    """Tokens of a text (null: none): found, then lower-cased one by one, then stopped, then held to a length."""
    out = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    if lowercase:
        out = F.transform(out, F.lower)
    if stop := sorted(set(stopwords)):
        out = F.filter(out, lambda w: ~w.isin(stop))
    return F.filter(out, lambda w: F.char_length(w) >= min_length) if min_length > 2 else out


def strip_web(text: Column) -> Column:
    """Tags become spaces, then URLs go, then entities: that order matters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TAG, " "), URL, " "), ENTITY, " ")


def strip_quotes(text: Column) -> Column:
    """Text less its italics and its quoted lines (those that start with >), joined by spaces; basic entities decoded."""
    parts = F.split(F.regexp_replace(text, r"(?s)<i>.*?</i>", " "), r"<p>|\n")
    own = F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: ~x.rlike(r"^(>|&gt;)") & (x != "")), " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        own = F.replace(own, F.lit(entity), F.lit(plain))
    return own


def sentences(text: Column) -> Column:
    """Runs up to and with their end marks, and what follows the last one; trimmed, none empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def is_numeric(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def mostly_non_alpha(word: Column) -> Column:
    """Fewer than half of the characters are letters."""
    return F.char_length(F.regexp_replace(word, r"\P{L}", "")) / F.char_length(word) < 0.5


def join_phrase(a: Column, b: Column, delimiter: str = "_") -> Column:
    return F.concat(a, F.lit(delimiter), b)


def label_string(x: Column) -> Column:
    """A number as a label: whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def sparkline(values: list[float]) -> str:
    """Eight block heights from the least to the greatest value."""
    low, high = min(values, default=0.0), max(values, default=0.0)
    return "".join("▁▂▃▄▅▆▇█"[min(7, int(8 * (v - low) / (high - low)))] if high > low else "▁" for v in values)
