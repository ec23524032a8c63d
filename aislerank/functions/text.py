"""Column expressions over product text."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noise words added to the English list when a catalogue text is stripped.
CATALOGUE_NOISE = (
    "product", "amazon", "brand", "buy", "new", "best", "get",
    "pack", "set", "also", "free", "offer", "deal", "sale",
)

# First words of a name that are never a brand.
NOT_A_BRAND = (
    "for", "with", "and", "or", "by", "in", "on", "the", "a", "an",
    "combo", "pack", "set", "kit", "bundle",
)

# Words that never explain a match.
KEYWORD_STOPS = (
    "the", "a", "an", "and", "or", "for", "in", "on", "with", "to",
    "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "of", "by", "at", "from", "as", "into", "this",
    "that", "it", "its", "also", "each", "inch", "size", "color",
    "design", "product", "features", "compatible", "available",
)

# Patterns.
LIST_MARKS = r"[\[\]'\"{}()]"
WORD = r"[\p{L}\p{N}_]{2,}"
KEYWORD = r"[a-zA-Z][a-zA-Z0-9+\-]*"


@lru_cache(maxsize=1)
def english_stops() -> tuple[str, ...]:
    """Spark ML's default English list, read from the jar that ships with PySpark."""
    import pyspark

    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
    for home in homes:
        jars = os.path.join(home, "jars")
        if not os.path.isdir(jars):
            continue
        for jar in sorted(os.listdir(jars)):
            if jar.startswith("spark-mllib_"):
                with zipfile.ZipFile(os.path.join(jars, jar)) as archive:
                    text = archive.read("org/apache/spark/ml/feature/stopwords/english.txt")
                return tuple(w for w in text.decode().split("\n") if w)
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column) -> Column:
    """Lower case, letters a-z, digits and single spaces only; '' for a missing text."""
    blank = text.isNull() | F.trim(text).isin("", "nan", "None")
    return F.when(blank, "").otherwise(_plain(text))


def _plain(text: Column) -> Column:
    """One pass: whatever stands between letters a-z and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalised_description(text: Column) -> Column:
    """``normalise(clean_description(text))`` in one pass.

    What the cleaning replaces is no letter or digit, so it matters only to a text that may come out as a missing one.
    """
    plain = _plain(text)
    return F.coalesce(F.when(plain.isin("nan", "none"), normalise(clean_description(text))).otherwise(plain), F.lit(""))


def clean_description(text: Column) -> Column:
    """Drop list marks, turn bars into spaces, collapse spaces."""
    blank = text.isNull() | F.trim(text).isin("", "nan")
    bare = F.regexp_replace(F.regexp_replace(text, LIST_MARKS, " "), r"\|", " ")
    return F.when(blank, "").otherwise(squeeze(bare))


def clean_category(text: Column) -> Column:
    return squeeze(text)


def drop_stops(text: Column, stops: Sequence[str]) -> Column:
    """Words of at least two characters outside the stop list, order kept."""
    words = F.split(F.trim(text), r"\s+")
    return F.array_join(
        F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stops)), " "
    )


def first_image(links: Column) -> Column:
    return F.split(F.split(links, r"\|")[0], ",")[0]


def is_web_link(link: Column) -> Column:
    return F.coalesce(F.trim(link).startswith("http"), F.lit(False))


def readable_category(name: Column) -> Column:
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.coalesce(spaced, F.lit("")), "&", " & "))


def short_description(text: Column, parts: int = 2) -> Column:
    return F.array_join(F.slice(F.split(text, r"\|"), 1, parts), " ")


def category_level(category: Column, level: int) -> Column:
    return F.coalesce(F.trim(F.get(F.split(category, r"\|"), F.lit(level))), F.lit(""))


def brand_of(name: Column) -> Column:
    """First acceptable word among the first three, letters and digits only."""
    heads = F.slice(F.split(F.trim(name), r"\s+"), 1, 3)
    bare = F.transform(heads, lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    fit = F.filter(bare, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*NOT_A_BRAND))
    return F.coalesce(F.initcap(F.get(fit, F.lit(0))), F.lit("Unknown"))


def keyword_set(text: Column, min_length: int = 4) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({KEYWORD})"), 1)
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*KEYWORD_STOPS))
    )


def matched_keywords(left_set: Column, right_set: Column, limit: int = 5) -> Column:
    """Shared keywords, longest first then alphabetical, title-cased."""
    shared = F.transform(
        F.array_intersect(left_set, right_set),
        lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")),
    )
    return F.transform(F.slice(F.sort_array(shared), 1, limit), lambda s: F.initcap(s["w"]))


def words(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def without(tokens: Column, stops: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stops)) if stops else tokens


def with_bigrams(tokens: Column) -> Column:
    """The words followed by each adjacent pair joined by a space."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, pairs)
