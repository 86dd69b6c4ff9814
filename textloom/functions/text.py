"""Column expressions over text: normal forms, counts, words, n-grams. All of them are built-in functions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns; fixed values.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:(?:\+?1[-.\s]*)?(?:\(\d{3}\)|\d{3})[-.\s]*)\d{3}[-.\s]*\d{4}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
URL = r"(?i)\b(?:https?://|www\.)\S+|\b\S+\.(?:com|org|net|edu|gov|io|co)\S*"
SENTENCE = r"[.!?]+(?:\s+|$)"
LETTER_WORD = r"[A-Za-z][A-Za-z']*"

STOP = frozenset(".^$*+?{}[]|()\\")


def squeeze(text: Column) -> Column:
    """NUL and white space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\0", " "), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def scrub(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then social security numbers become placeholders."""
    for pattern, name in ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (SSN, "[SSN]")):
        text = F.regexp_replace(text, pattern, name)
    return text


def drop_provenance(text: Column) -> Column:
    """Domain text without its source prefix, with pipes, spaced dashes and dot leaders made into prose."""
    text = F.trim(F.regexp_replace(text, r"(?iU)^\s*Source:\s*.+?\.\s*Section:\s*", ""))
    text = F.regexp_replace(text, r"(?U)\s*\|\s*", ", ")
    text = F.regexp_replace(text, r"(?U)\s+-\s+", "; ")
    return squeeze(F.regexp_replace(text, r"\.{5,}", " "))


def split_words(squeezed: Column) -> Column:
    """Words between spaces, of squeezed text."""
    return F.filter(F.split(squeezed, " "), lambda w: w != "")


def count_split_words(squeezed: Column) -> Column:
    return F.when(F.length(squeezed) == 0, 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1)


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTER_WORD), F.lit(0))


def count_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE))


def literal_pattern(term: str) -> str:
    return "".join("\\" + c if c in STOP else c for c in term)


def count_terms(lowered: Column, terms: Sequence[str]) -> Column:
    """Non-overlapping whole-word occurrences of any term; a space in a term stands for any white space.

    The pattern runs only over texts that hold a term's first word at all: finding that takes a fraction of its time.
    """
    alternatives = "|".join(r"\b" + r"\s+".join(map(literal_pattern, t.lower().split())) + r"\b" for t in terms)
    heads = sorted({t.lower().split()[0] for t in terms})
    return F.when(contains_any([lowered], heads), F.regexp_count(lowered, F.lit(f"(?U)(?:{alternatives})"))).otherwise(0)


def contains_any(texts: Sequence[Column], phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in texts:
        for p in phrases:
            out = out | t.contains(p)
    return out


def count_containing(text: Column, phrases: Sequence[str]) -> Column:
    """How many distinct phrases occur."""
    return sum((t.cast("int") for t in (text.contains(p) for p in phrases)), F.lit(0))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def ngrams(words: Column, n: int) -> Column:
    """All n-grams, space-joined; none where there are fewer words."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def leading_ngrams(words: Column, n: int, limit: int) -> Column:
    """The first distinct n-grams."""
    return F.slice(F.array_distinct(ngrams(words, n)), 1, limit)


#: SHA-256 of nothing: the signature_hash of texts without letters.
NO_LETTERS = hashlib.sha256(b"").hexdigest()


def signature_hash(text: Column) -> Column:
    """A hash of a normal form without digits and punctuation; NO_LETTERS where nothing is left."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]", " "), r"[^a-z\s]+", " ")
    return F.sha2(F.trim(F.regexp_replace(low, r"\s+", " ")), 256)


def signature(text: Column) -> Column:
    """signature_hash, null where nothing is left."""
    return F.nullif(signature_hash(text), F.lit(NO_LETTERS))


def document_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def ratio(n: Column, d: Column) -> Column:
    """n over d, where d counts as one at least."""
    return n.cast("double") / F.greatest(d, F.lit(1)).cast("double")


def nonempty(text: Column) -> Column:
    """Squeezed text, null where empty."""
    return F.nullif(squeeze(text), F.lit(""))


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("...")))


def context_around(text: Column, phrase: Column, width: int) -> Column:
    """The text from width characters before the first occurrence to width after it; null without one."""
    at = F.position(phrase, text)
    start = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.substr(text, start, at + F.length(phrase) + width - start))
