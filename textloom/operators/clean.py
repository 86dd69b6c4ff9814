"""Documents: cleaning, quality reasons, exact deduplication where the first in source order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.rules import first_reason, mode_rules, with_metrics

MIN_CHARS, MAX_CHARS = 128, 200_000


def clean(df: DataFrame, mode: str = "basic", text: str = "text", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, pii: bool = True) -> DataFrame:
    """Adds raw (the text as read), text (cleaned) and drop_reason (null where kept); rejected rows stay.

    White space is squeezed first, then personal data is scrubbed, then domain text loses its provenance; rules see the
    cleaned text, line rules the raw one. A null text is dropped as non_text.
    """
    cleaned = T.squeeze(F.col("raw"))
    cleaned = T.scrub(cleaned) if pii else cleaned
    cleaned = T.drop_provenance(cleaned) if mode == "domain_lm" else cleaned
    df = df.withColumn("raw", F.col(text)).withColumn("text", cleaned)
    kept = [x for x in df.columns]
    judged = with_metrics(df).withColumn("drop_reason", F.when(F.col("raw").isNull(), "non_text").otherwise(first_reason(mode_rules(mode, min_chars, max_chars))))
    return judged.select(*kept, "drop_reason")


def first_wins(df: DataFrame, order: list[str], key: str = "document_hash", dedup: str | None = None) -> DataFrame:
    """Marks later copies as exact_duplicate in drop_reason. Rows that are already dropped neither win nor lose; rows
    whose column dedup is false neither check nor register.

    The first row of a key comes from an aggregate that is combined before its shuffle, and only keys that occur more
    than once are joined back. Neither side is filtered by drop_reason: a filter would be pushed below the cleaning and
    evaluate all of it once more.
    """
    takes_part = F.col("drop_reason").isNull() & (F.col(dedup) if dedup else F.lit(True))
    place = F.struct(*order)
    # Never null, or the join would push a null check, and with it the cleaning, below the aggregate.
    named = df.withColumn("__key", F.coalesce(key, F.lit("")))
    firsts = named.groupBy("__key").agg(F.min(F.when(takes_part, place)).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = named.join(firsts, "__key", "left")
    again = takes_part & F.col("__first").isNotNull() & (place != F.col("__first"))
    return joined.withColumn("drop_reason", F.when(again, "exact_duplicate").otherwise(F.col("drop_reason"))).drop("__key", "__first", "__n")


def prepared(docs: DataFrame, mode: str = "curated_lm", min_chars: int = MIN_CHARS) -> DataFrame:
    """documents cleaned, judged and deduplicated in id order."""
    cleaned = clean(docs.select("doc_id", "source", "lang", "text"), mode, min_chars=min_chars)
    return first_wins(cleaned.withColumn("document_hash", T.document_hash(F.col("text"))), ["doc_id"])


def drop_short_tokenized(judged: DataFrame, tokens: Column, least: int = 2) -> DataFrame:
    """Kept rows of fewer than least tokens become too_short_tokenized. It follows deduplication, so such a row's hash
    still stands for its copies."""
    return judged.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (tokens < least), "too_short_tokenized").otherwise(F.col("drop_reason")))


def corpus_texts(docs: DataFrame, min_chars: int, text: str = "text") -> DataFrame:
    """Squeezed texts of min_chars characters at least, as a tokenizer's corpus takes them."""
    return docs.withColumn(text, T.squeeze(F.coalesce(text, F.lit("")))).filter(F.length(text) >= min_chars)


def reason_histogram(df: DataFrame, by: str = "source") -> DataFrame:
    return df.filter("drop_reason IS NOT NULL").groupBy(by, "drop_reason").agg(F.count(F.lit(1)).alias("n"))


def ngram_repeats(df: DataFrame, id_col: str, words: str, sizes: tuple[int, ...] = (5, 8)) -> DataFrame:
    """Per document the largest count and the share of repeats of its n-grams; no shuffle."""
    from textloom.plans.rules import ngram_signal

    signals = df.select(id_col, *[ngram_signal(F.col(words), n).alias(f"s{n}") for n in sizes])
    return signals.select(id_col, *[c for n in sizes for c in (F.col(f"s{n}.max_count").alias(f"max_{n}"), F.col(f"s{n}.extra").alias(f"extra_{n}"))])


def quality_wins(df: DataFrame, key: list[str], quality: list, order: list[str]) -> DataFrame:
    """Of each key the row with the greatest quality tuple; the first in order wins ties."""
    w = Window.partitionBy(*key).orderBy(*[q.desc() for q in quality], *order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
