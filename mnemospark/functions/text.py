"""Text functions as Spark columns; all run in the JVM unless noted."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = r"[\x{4E00}-\x{9FFF}]"
WORD = r"[\p{L}\p{N}_]+"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for; in Arrow batches."""
    return values.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def words(text: Column) -> Column:
    """Words outside Chinese script, lower case, in order."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), HAN + "+", " "), F.lit(f"({WORD})"), F.lit(1))


def han_bigrams(text: Column) -> Column:
    """Pairs of neighbouring Chinese characters; a single one stays as it is."""
    runs = F.regexp_extract_all(text, F.lit(f"({HAN}+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))


def terms(text: Column) -> Column:
    """Words and Chinese bigrams with repeats; empty for null."""
    safe = F.coalesce(text, F.lit(""))
    return F.concat(words(safe), han_bigrams(safe))


def token_set(text: Column) -> Column:
    return F.array_distinct(terms(text))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token sets; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coverage(text: Column, query_terms: Column) -> Column:
    """Share of the query's terms that occur in the text as substrings; 0 without terms."""
    lower = F.lower(text)
    hits = F.size(F.filter(query_terms, lambda t: F.contains(lower, t)))
    return F.when(F.size(query_terms) > 0, hits / F.size(query_terms)).otherwise(0.0)


def estimated_tokens(text: Column) -> Column:
    """Chinese characters plus a quarter of the others, rounded up."""
    han = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", ""))
    return (han + F.ceil((F.length(text) - han) / 4)).cast("long")


def fingerprint(text: Column) -> Column:
    """Lower case without spaces, punctuation and symbols."""
    return F.regexp_replace(F.lower(text), r"[\s\p{P}\p{S}]+", "")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(F.trim(text), 256), 1, 16)


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1))


def has_negation(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(not|never|no|cannot|nicht|kein|keine|nie)\b") | text.rlike("不|没|别|勿")


def has_update_signal(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(now|instead|no longer|changed|moved|since|replaces|statt|jetzt)\b") | text.rlike("改成|改为|换成|不再|现在|之后")


def paths_in(text: Column) -> Column:
    """File paths with at least one directory and an extension."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+)"), F.lit(1))


def module_of(path: Column) -> Column:
    """The first two directories of a path."""
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.least(F.lit(2), F.size(F.split(path, "/")) - 1)), "/")


def identifiers_in(text: Column) -> Column:
    """Entities by shape: words joined by - or _, and words in camel case; lower case."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z]*[a-z][A-Z][A-Za-z]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def hash_tags(text: Column) -> Column:
    """#tags in a text, without those that are numbers only; lower case."""
    found = F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_-]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(x)), lambda x: ~x.rlike(r"^\d+$")))


def first_label(text: Column, patterns: dict[str, str], default: str) -> Column:
    """The first label whose pattern occurs in the lower-case text."""
    lower = F.lower(text)
    out = F.lit(default)
    for label, pattern in reversed(patterns.items()):
        out = F.when(lower.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def all_labels(text: Column, patterns: dict[str, str]) -> Column:
    """All labels whose pattern occurs, in the order given."""
    lower = F.lower(text)
    return F.array_compact(F.array(*[F.when(lower.rlike(p), F.lit(label)) for label, p in patterns.items()]))


def l2_normalised(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text; the offset and the prime are fixed values of the published hash."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"),
        lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(4294967296)),
    )


#: Length of a hashed vector, and the weights of a word and of a Chinese bigram; fixed values.
SLOTS, WORD_WEIGHT, BIGRAM_WEIGHT = 256, 1.0, 0.5


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed(words_: pd.Series, runs: pd.Series) -> pd.Series:
    """Sums of the weights of words and of the pairs in Chinese runs by slot, the token's 32-bit FNV-1a over UTF-16 units.

    Spark can't run a Python function over an argument with a lambda, so pairs are cut here.
    """
    slots: dict[str, int] = {}

    def slot(token: str) -> int:
        if token not in slots:
            h = 2166136261
            for unit in np.frombuffer(token.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
                h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
            slots[token] = h % SLOTS
        return slots[token]

    def vector(a: Iterable[str], b: Iterable[str]) -> np.ndarray:
        at = [slot(t) for t in a], [slot(r[i:i + 2]) for r in b for i in range(max(len(r) - 1, 1))]
        return WORD_WEIGHT * np.bincount(np.array(at[0], dtype=int), minlength=SLOTS) + BIGRAM_WEIGHT * np.bincount(np.array(at[1], dtype=int), minlength=SLOTS)

    return pd.Series([vector(a, b) for a, b in zip(words_, runs)], dtype=object)


def hashed_vector(text: Column) -> Column:
    """A text as a vector of hashed words and Chinese bigrams, not normalised; the zero vector without any."""
    safe = F.coalesce(text, F.lit(""))
    return _hashed(words(safe), F.regexp_extract_all(safe, F.lit(f"({HAN}+)"), F.lit(1)))
