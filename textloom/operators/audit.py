"""Corpus statistics per source: shape, n-gram families, near-duplicates, artifact densities, shares and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans import lists as L

#: (n, how many leading distinct n-grams a document contributes)
FAMILIES = ((4, 8), (8, 6), (12, 4), (20, 3))
MALFORMED = r"(?:\b[a-z]{1,6}-){2,}[a-z]{1,10}\b|-[a-z]{1,4}-|\b(?:" + "|".join(map(T.literal_pattern, (t.lower() for t in L.MALFORMED_FRAGMENTS))) + r")\b"
QUOTES = "[\"'“”‘’]"
BROKEN_QUOTES = rf"(?:{QUOTES}\s*){{3,}}|(?:\b[a-z]\s+{QUOTES}\s*){{2,}}"

n_rows = lambda: F.count(F.lit(1))


def shape(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Documents, characters, words, sentences and paragraphs (squeezed text is one paragraph) by group."""
    t = F.col(text)
    return df.groupBy(*by).agg(
        n_rows().alias("documents"),
        F.sum(F.length(t).cast("long")).alias("chars"),
        F.sum(T.count_split_words(t).cast("long")).alias("words"),
        F.sum(T.count_sentences(t).cast("long")).alias("sentences"),
        F.sum((F.length(t) > 0).cast("long")).alias("paragraphs"),
    )


def leading_families(df: DataFrame, by: str, top: int, families: Sequence[tuple[int, int]] = FAMILIES, text: str = "text") -> DataFrame:
    """The most frequent leading n-grams by group and n; ties go to the smaller phrase.

    Counts are combined before the shuffle and the rank keeps only top rows per task before its own.
    """
    words = T.split_words(F.lower(F.col(text)))

    def tagged(n: int, k: int) -> Column:
        return F.transform(T.leading_ngrams(F.col("w"), n, k), lambda g: F.struct(F.lit(n).alias("n"), g.alias("phrase")))

    pairs = F.flatten(F.array(*[tagged(n, k) for n, k in families]))
    each = df.select(by, words.alias("w")).select(by, F.explode(pairs).alias("p")).select(by, "p.n", "p.phrase")
    counted = each.groupBy(by, "n", "phrase").agg(n_rows().alias("count"))
    w = Window.partitionBy(by, "n").orderBy(F.desc("count"), "phrase")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def clusters(df: DataFrame, by: str, key: Column, nothing: str = T.NO_LETTERS) -> DataFrame:
    """Groups of equal keys by group: clusters of two or more, the largest, the rows in them, repeats beyond the first.

    Rows whose key is nothing belong to no cluster. They are left out by conditions in the second aggregate: a filter on
    the key would be pushed below the cleaning and evaluate it again.
    """
    sized = df.groupBy(by, key.alias("k")).agg(n_rows().alias("n"))
    counts = F.col("k") != nothing
    many = counts & (F.col("n") > 1)
    out = sized.groupBy(by).agg(
        F.count_if(many).alias("clusters"),
        F.max(F.when(counts, F.col("n"))).alias("largest"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("clustered"),
        F.sum(F.when(counts, F.col("n") - 1)).alias("repeats"),
    )
    return out.filter("largest IS NOT NULL")


def artifact_families() -> dict[str, Column]:
    """Occurrences of each artifact family in the lower-cased column low."""
    low = F.col("low")
    return {
        "excessive_hyphen_fragments": F.regexp_count(low, F.lit("(?U)" + MALFORMED)),
        "broken_quote_fragments": F.regexp_count(low, F.lit("(?U)" + BROKEN_QUOTES)),
        "navigation_like_text": T.count_terms(low, L.NAVIGATION_TERMS),
        "generic_article_formula": T.count_terms(low, L.GENERIC_FORMULAE),
        "medical_body_health": T.count_terms(low, L.MEDICAL_TERMS),
        "product_commercial": T.count_terms(low, L.PRODUCT_TERMS),
        "dictionary_fragment": T.count_terms(low, L.DICTIONARY_TERMS),
        "page_boilerplate": T.count_terms(low, (*L.PAGE_TERMS, *L.PAGE_INSTRUCTIONS)),
    }


def artifact_counts(df: DataFrame, by: str, families: Mapping[str, Column] | None = None, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """By group and family: documents with a hit, occurrences, and occurrences per token (rounded to 6)."""
    families = artifact_families() if families is None else families
    counted = df.select(by, F.lower(text).alias("low"), (T.count_split_words(F.col(text)) if tokens is None else tokens).cast("long").alias("tokens"))
    counted = counted.select(by, "tokens", *[e.cast("long").alias(k) for k, e in families.items()])
    sums = [F.sum(k).alias(f"o_{k}") for k in families] + [F.count_if(F.col(k) > 0).alias(f"d_{k}") for k in families]
    wide = counted.groupBy(by).agg(F.sum("tokens").alias("tokens"), *sums)
    rows = F.array(*[F.struct(F.lit(k).alias("family"), F.col(f"d_{k}").alias("documents"), F.col(f"o_{k}").alias("occurrences")) for k in families])
    return wide.select(by, "tokens", F.inline(rows)).withColumn("density", F.round(T.ratio(F.col("occurrences"), F.col("tokens")), 6))


def junk_score(densities: DataFrame, by: str) -> DataFrame:
    """min(1, medical + 2 navigation + 4 malformed + 2 generic), of the rounded densities; wide, one row per group."""
    wide = densities.groupBy(by).pivot("family", list(artifact_families())).agg(F.first("density"))
    malformed = F.col("excessive_hyphen_fragments") + F.col("broken_quote_fragments")
    score = F.col("medical_body_health") + 2 * F.col("navigation_like_text") + 4 * malformed + 2 * F.col("generic_article_formula")
    return wide.withColumn("junk_score", F.round(F.least(F.lit(1.0), score), 6))


def gate(values: DataFrame, limits: Mapping[str, float], by: str) -> DataFrame:
    """(group, name, value, limit) for every column of values that exceeds its limit."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit")) for k, v in limits.items()])
    return values.select(by, F.inline(F.filter(rows, lambda x: x["value"] > x["limit"])))


def with_shares(report: DataFrame, targets: Mapping[str, float] | None = None, tokens: str = "tokens", documents: str = "documents") -> DataFrame:
    """Adds token and document shares of the whole, and the gap to a target share; the report has a row per source."""
    whole = Window.partitionBy(F.lit(1))  # a row per source, so one task is enough
    columns = report.columns
    out = report.withColumn("__t", F.sum(tokens).over(whole)).withColumn("__d", F.sum(documents).over(whole))
    target = F.lit(None).cast("double")
    for k, v in (targets or {}).items():
        target = F.when(F.col("source") == k, F.lit(float(v))).otherwise(target)
    share = T.ratio(F.col(tokens), F.col("__t"))
    return out.select(
        *columns, F.round(share, 6).alias("token_share"), F.round(T.ratio(F.col(documents), F.col("__d")), 6).alias("document_share"), F.round(share - target, 6).alias("share_gap")
    )


def source_report(judged: DataFrame) -> DataFrame:
    """One row per source over judged rows (raw, text, drop_reason): what came in, what stayed, how much repeats."""
    kept = F.col("drop_reason").isNull()
    words = F.when(kept, T.count_split_words(F.col("text"))).otherwise(0).cast("long")
    base = judged.groupBy("source").agg(
        n_rows().alias("raw_records"),
        F.count_if(kept).alias("documents"),
        F.count_if(F.col("drop_reason") == "exact_duplicate").alias("duplicates"),
        F.sum(words).alias("tokens"),
        F.sum(F.when(kept, F.length("text")).otherwise(0).cast("long")).alias("chars"),
    )
    near = clusters(judged.filter(kept), "source", T.signature_hash(F.col("text"))).select("source", "clusters", "largest", "clustered")
    out = base.join(near, "source", "left").fillna(0, ["clusters", "largest", "clustered"])
    out = out.withColumn("near_duplicate_ratio", F.round(T.ratio(F.col("clustered"), F.col("documents")), 6))
    return with_shares(out.withColumn("average_tokens", F.round(T.ratio(F.col("tokens"), F.col("documents")), 2))).drop("share_gap")


def realizable(unique_documents: float, average_tokens: float, repeat_cap: float) -> float:
    """Tokens that a source can give when at most repeat_cap of its documents are repeats."""
    return unique_documents / max(1 - repeat_cap, 1e-9) * average_tokens


def allocate(total: float, shares: Mapping[str, float], capacities: Mapping[str, float]) -> dict[str, float]:
    """Water filling: in each pass every open source with a target wants its share of what then remains; one that wants more
    than its capacity gets that and is closed, and what is left goes on to the next within the pass. Once no source is
    closed the open ones take their shares. If only sources without a target are open, they share what is left equally, up
    to their capacities."""
    got, left, remaining = dict.fromkeys(shares, 0.0), list(shares), float(total)
    while left and remaining > 0 and (weight := sum(max(shares[s], 0.0) for s in left)) > 0:
        full = []
        for s in left:
            if remaining * max(shares[s], 0.0) / weight > capacities[s] + 1e-8:
                got[s] = capacities[s]
                remaining -= capacities[s]
                full.append(s)
        left = [s for s in left if s not in full]
        if not full:
            for s in left:
                got[s] = remaining * max(shares[s], 0.0) / weight
            return got
    for s in left if remaining > 0 else []:
        got[s] = min(remaining / len(left), capacities[s])
    return got


def named_or_family(source: Column, family: Column, names: Sequence[str], families: Sequence[str]) -> Column:
    """Whether a source is in a class, by its name or by its family."""
    return source.isin(list(names)) | F.coalesce(family.isin(list(families)), F.lit(False))


def captured_samples(judged: DataFrame, order: str, rejected: int = 10, accepted: int = 30) -> DataFrame:
    """(source, kind, id): the first rejected rows of each source and reason, and accepted ones at even distances of their
    rank in their source. Ranks come from ordered ranges of ids, so a source of very many rows is no task of its own."""
    from textloom.operators.ranges import ranked

    by_reason = Window.partitionBy("source", "drop_reason").orderBy(order)
    first = judged.filter("drop_reason IS NOT NULL").select("source", "drop_reason", order, F.row_number().over(by_reason).alias("n")).filter(F.col("n") <= rejected)
    kept = ranked(judged.filter("drop_reason IS NULL").select("source", order), [order], "i", ["source"])
    kept = kept.join(kept.groupBy("source").agg(F.count(F.lit(1)).alias("total")), "source")
    many = F.least(F.lit(accepted), F.col("total"))
    step = (F.col("total") - 1) / F.greatest(many - 1, F.lit(1)).cast("double")
    wanted = F.transform(F.sequence(F.lit(0), (many - 1).cast("int")), lambda j: F.bround(j * step, 0).cast("long"))
    even = kept.filter(F.array_contains(wanted, F.col("i").cast("long")))
    return first.select("source", F.col("drop_reason").alias("kind"), order).union(even.select("source", F.lit("accepted"), order))


def pattern_examples(df: DataFrame, id_col: str, patterns: Mapping[str, Sequence[str]] = L.HIDDEN_PATTERNS, examples: int = 5, terms: int = 8, text: str = "text") -> DataFrame:
    """Per family of phrases: documents with any, and up to so many examples with the first matched terms."""
    low = F.lower(text)
    found = F.array(*[F.struct(F.lit(k).alias("family"), F.filter(F.array(*map(F.lit, v)), lambda p: F.contains(F.col("low"), p)).alias("matched")) for k, v in patterns.items()])
    each = df.select(id_col, low.alias("low")).select(id_col, F.inline(found)).filter(F.size("matched") > 0)
    each = each.select("family", F.struct(F.col(id_col).alias("id"), F.slice("matched", 1, terms).alias("matched")).alias("example"))
    w = Window.partitionBy("family").orderBy("example.id")
    totals = each.groupBy("family").agg(n_rows().alias("documents"))
    shown = each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= examples).groupBy("family").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return totals.join(shown, "family")
