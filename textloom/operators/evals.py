"""Scores of generated text and of benchmark answers, rollups, release gates, event tiers, report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


#: Words that say nothing about a text's subject; fixed values.
COMMON_WORDS = (
    "about after also and are because before below between but can does for from has have how into its that the their this what when where which while with"
).split()
ABSTENTION = r"(?i)(does not contain enough information|cannot answer|could not find|not enough information|not provided)"
#: Reasons of which one alone makes an output degenerate.
FATAL = (
    "blank_output", "punctuation_only", "hyphen_letter_garbage", "copyright_date_residue", "grounded_answer_too_short", "ignores_provided_context",
    "leading_punctuation_fragment", "low_prompt_retention",
)


def longest_run(words: Column) -> Column:
    """How often a word stands after itself at most, plus one; one without words."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("best"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(w == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(words, start, step, lambda s: s["best"])


def content_terms(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9'-]{2,}"), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), "^['-]+|['-]+$", ""))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*COMMON_WORDS)))


def generation_quality(df: DataFrame, response: str, prompt: str | None = None, context: str | None = None, grounded: bool = False) -> DataFrame:
    """Adds metrics of a response, its reasons (an array) and degenerate. grounded: an answer must rest on its context."""
    from textloom.plans.rules import ngram_signal

    none = F.array().cast("array<string>")
    given = lambda c: content_terms(F.col(c)) if c else none
    df = df.withColumn("__t", F.regexp_replace(F.coalesce(F.col(response), F.lit("")), r"(?U)^\s+|\s+$", ""))
    df = df.withColumns(
        {
            "__raw": F.filter(F.split("__t", r"(?U)\s+"), lambda w: w != ""),
            "__solid": F.regexp_replace("__t", r"(?U)\s+", ""),
            "__out": content_terms(F.col("__t")),
            "__prompt": given(prompt),
            "__context": given(context),
        }
    )
    df = df.withColumn("__norm", F.transform("__raw", lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")))
    df = df.withColumn("__words", F.filter("__norm", lambda w: w != ""))
    share = lambda n, d: F.when(d == 0, 0.0).otherwise(T.ratio(n, d))
    solid, tokens, words = F.length("__solid"), F.size("__raw"), F.size("__words")
    df = df.withColumns(
        {
            "nonspace_chars": solid,
            "token_count": tokens,
            "word_count": words,
            "alpha_ratio": share(F.length(F.regexp_replace("__solid", r"[^\p{L}]", "")), solid),
            "comma_ratio": share(solid - F.length(F.translate("__solid", ",", "")), solid),
            "separator_bursts": F.regexp_count("__t", F.lit(r"([,./>\-])\1{2,}")),
            "short_fragment_ratio": share(F.size(F.filter("__norm", lambda w: F.length(w) <= 2)), tokens),
            "punctuation_suffix_ratio": share(F.size(F.filter("__raw", lambda w: w.rlike(r"[,./>\-]$"))), tokens),
            "unique_token_ratio": share(F.size(F.array_distinct("__words")), words),
            "repeated_token_run": longest_run(F.col("__words")),
            "content_term_count": F.size("__out"),
            "prompt_overlap": F.array_sort(F.array_intersect("__out", "__prompt")),
            "context_overlap": F.array_sort(F.array_intersect("__out", "__context")),
            "most_common": ngram_signal(F.col("__words"), 1)["max_count"],
            "repeated_phrase": (ngram_signal(F.col("__words"), 2)["max_count"] >= 4) | (ngram_signal(F.col("__words"), 3)["max_count"] >= 3),
        }
    )
    c = F.col
    asks, rests = F.size("__prompt"), F.size("__context")
    bound = F.lit(grounded) & ~c("__t").rlike(ABSTENTION)
    rules = [
        ("separator_spam", c("separator_bursts") >= 2),
        ("low_alphabetic_ratio", (c("nonspace_chars") >= 40) & (c("alpha_ratio") < 0.45)),
        ("too_many_short_fragments", (c("token_count") >= 12) & (c("short_fragment_ratio") > 0.55)),
        ("malformed_token_dump", (c("token_count") >= 12) & (c("punctuation_suffix_ratio") > 0.55)),
        ("repeated_token_burst", c("repeated_token_run") >= 4),
        ("comma_spam", (c("nonspace_chars") >= 40) & (c("comma_ratio") > 0.12)),
        ("low_token_variety", (c("word_count") >= 12) & (c("unique_token_ratio") < 0.3)),
        ("blank_output", c("__t") == ""),
        ("punctuation_only", (c("__t") != "") & c("__t").rlike(r"(?U)^[\W_]+$")),
        ("too_short_no_content", (c("nonspace_chars") <= 3) | (c("word_count") <= 2) & (c("content_term_count") == 0)),
        ("hyphen_letter_garbage", c("__t").rlike(r"(?U)\b(?:[A-Za-z]{1,3}-){3,}[A-Za-z]{1,3}\b")),
        ("copyright_date_residue", (c("token_count") <= 8) & c("__t").rlike(r"(?i)(?:©|copyright)\s*(?:19|20)\d{2}")),
        ("low_alphabetic_ratio", c("nonspace_chars").between(1, 39) & (c("alpha_ratio") < 0.35)),
        ("repeated_phrase", c("repeated_phrase")),
        ("dominant_repeated_token", (c("word_count") >= 10) & (c("most_common") >= 3) & (T.ratio(c("most_common"), c("word_count")) >= 0.18)),
        ("leading_punctuation_fragment", F.lit(grounded) & c("__t").rlike(r"^[.?!,;:]")),
        ("grounded_answer_too_short", bound & (c("token_count") <= 3)),
        ("ignores_provided_context", bound & (rests > 0) & (c("content_term_count") > 0) & (F.size("context_overlap") == 0)),
        ("prompt_not_reflected", bound & (asks > 0) & (c("content_term_count") > 0) & (F.size("prompt_overlap") == 0) & (F.size("context_overlap") == 0)),
        ("low_prompt_retention", bound & (asks >= 3) & (c("content_term_count") > 0) & (F.size("prompt_overlap") < 2)),
    ]
    df = df.withColumn("reasons", F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules])))
    dump = (c("token_count") >= 16) & (c("punctuation_suffix_ratio") > 0.7) & (c("short_fragment_ratio") > 0.6)
    fatal = [*FATAL, *(("repeated_phrase", "dominant_repeated_token") if grounded else ())]
    degenerate = (F.size("reasons") >= 2) | (c("separator_bursts") >= 4) | (c("repeated_token_run") >= 6) | dump | F.arrays_overlap("reasons", F.array(*map(F.lit, fatal)))
    rounded = {k: F.round(k, 4) for k in ("alpha_ratio", "comma_ratio", "short_fragment_ratio", "punctuation_suffix_ratio", "unique_token_ratio")}
    df = df.withColumn("degenerate", degenerate).withColumns(rounded).withColumns({k: F.slice(k, 1, 12) for k in ("prompt_overlap", "context_overlap")})
    return df.drop("__t", "__raw", "__solid", "__out", "__prompt", "__context", "__norm", "__words", "most_common", "repeated_phrase")


#: Marks of an answer that abstains, and answers that say nothing; fixed values.
ABSTAIN_MARKS = (
    "i don't know", "i do not know", "not enough information", "insufficient information", "i cannot confirm", "i can't confirm", "not in the catalog",
    "not listed in the catalog", "could not find", "couldn't find", "no matching catalog entries", "cannot verify", "don't want to guess", "not listed",
)
FILLER = ("what would you like to work on", "what would you like help with", "how can i help today", "tell me what you want to figure out")


def abstains(response: Column) -> Column:
    return T.contains_any([F.lower(F.coalesce(response, F.lit("")))], ABSTAIN_MARKS)


def cites(response: Column) -> Column:
    return T.contains_any([F.lower(F.coalesce(response, F.lit("")))], ("[source:", "<|citation|>"))


def exact_score(response: Column, all_of: Column, any_of: Column, expects_abstention: Column) -> Column:
    """Whether a response abstains where it should, else holds all and any of what is expected; where nothing is
    expected, whether there is one."""
    low = F.lower(F.coalesce(response, F.lit("")))
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    every = ~some(all_of) | F.forall(F.coalesce(all_of, F.array().cast("array<string>")), lambda x: low.contains(F.lower(x)))
    either = ~some(any_of) | F.exists(F.coalesce(any_of, F.array().cast("array<string>")), lambda x: low.contains(F.lower(x)))
    return F.when(F.coalesce(expects_abstention, F.lit(False)), abstains(response)).when(some(all_of) | some(any_of), every & either).otherwise(F.trim(low) != "")


def expected_share(response: Column, expected: Column) -> Column:
    """The share of expected substrings in a response, case ignored; one where none is expected."""
    low = F.lower(F.coalesce(response, F.lit("")))
    found = F.filter(expected, lambda x: low.contains(F.lower(x)))
    return F.when(F.size(expected) > 0, F.size(found) / F.greatest(F.size(expected), F.lit(1))).otherwise(1.0)


def assistant_score(response: Column, expected: Column, forbidden: Column, requires_citation: Column, reference: Column | None = None, style: bool = True, cited: Column | None = None) -> Column:
    """One for the reference, the share of expected substrings, minus one for each forbidden one, two for repeated
    punctuation or connectors, one for filler and two for markup, half for or against a citation; zero at least. Without style
    punctuation, connectors, filler and markup do not count; cited says whether there is a citation, else the text does."""
    text = F.coalesce(response, F.lit(""))
    low = F.lower(text)
    bad = F.size(F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda x: low.contains(F.lower(x))))
    loops = text.rlike(r"([,.;:!?])(?:\s*\1){4,}") | low.rlike(r"(?U)\b(and|or)\b(?:\s+\1){3,}")
    minus = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    markup = T.contains_any([text], ("</s>", "<|assistant|>", "<|user|>"))
    score = F.when(F.size(expected) > 0, expected_share(response, expected)).otherwise(0.0) - bad
    if style:
        score = score - minus(loops, 2) - minus(T.contains_any([low], FILLER), 1) - minus(markup, 2)
    score = score + F.when(F.coalesce(requires_citation, F.lit(False)), F.when(cites(response) if cited is None else cited, 0.5).otherwise(-0.5)).otherwise(0.0)
    if reference is not None:
        score = score + minus(F.trim(text) == F.trim(reference), 1)
    return F.greatest(F.lit(0.0), score)


def route_audit(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """One row: questions, and the shares whose route is expected or among those that were tried (column routes)."""
    hit = F.array_contains(expected, F.col(predicted))
    fan = F.arrays_overlap(expected, "routes")
    return df.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(hit.cast("double")), 6).alias("route_accuracy"), F.round(F.avg(fan.cast("double")), 6).alias("fanout_recall"))


def expected_routes(explicit: Column, domain: Column) -> Column:
    """The routes that are stated, else the one that a domain's name implies."""
    low = F.lower(F.coalesce(domain, F.lit("")))
    implied = F.lit("chat")
    for parts, name in reversed(
        [
            (("handbook",), "handbook_policy"), (("faculty",), "faculty"), (("admission",), "admissions_general"), (("student_life",), "student_life"),
            (("mission_values", "college_guidance"), "admissions_general"), (("museum",), "museum_programs"), (("athletics",), "athletics"), (("planner",), "planner_advice"),
            (("course",), "course_catalog"),
        ]
    ):
        implied = F.when(T.contains_any([low], parts), name).otherwise(implied)
    return F.coalesce(F.when(F.size(explicit) > 0, explicit), F.array(implied))


def weighted_average(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Averages weighted by examples, with their number."""
    return df.groupBy(*by).agg(F.sum(weight).alias(weight), *[F.round(F.sum(F.col(v) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1)), 6).alias(v) for v in values])


def release_gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, kind, threshold, value, passed): each threshold (name, kind min|max|equals, threshold) against metrics
    (name, value); a metric that is missing fails."""
    met = F.broadcast(thresholds).join(metrics, "name", "left")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).when(F.col("kind") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    return met.select("name", "kind", "threshold", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def event_tiers(events: DataFrame, value: str, tiers: Sequence[tuple[str, float]]) -> DataFrame:
    """Adds tier: the first whose bound the value stays below; rows above every bound are left out."""
    tier = F.lit(None).cast("string")
    for name, bound in reversed(list(tiers)):
        tier = F.when(F.col(value) < bound, name).otherwise(tier)
    return events.withColumn("tier", tier).filter("tier IS NOT NULL")


def throttled(events: DataFrame, order: str, first: int = 10, every: int = 100) -> DataFrame:
    """Severe events all; of each other tier the first few, then every so many."""
    n = F.row_number().over(Window.partitionBy("tier").orderBy(order))
    return events.withColumn("n", n).filter((F.col("tier") == "severe") | (F.col("n") <= first) | (F.pmod("n", F.lit(every)) == 0))


def funnel(stages: Mapping[str, Column], df: DataFrame) -> DataFrame:
    """(stage_no, stage, n): how many rows satisfy each stage's condition."""
    wide = df.agg(*[F.count_if(c).alias(k) for k, c in stages.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(k).alias("stage"), F.col(k).alias("n")) for i, k in enumerate(stages)])))


def score_matrix(hits: DataFrame, by: str, columns: str, values: Sequence[str], score: str) -> DataFrame:
    """Best score by row group and column; the columns are named so that the plan needs no extra pass."""
    return hits.groupBy(by).pivot(columns, list(values)).agg(F.max(score))


def manifest_delta(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(metric, a, b, delta) of two one-row manifests."""
    long = lambda d, name: d.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias(name)) for k in keys])))
    return long(a, "a").join(long(b, "b"), "metric").withColumn("delta", F.col("b") - F.col("a"))


def perplexity(loss: Column, cap: float = 20.0) -> Column:
    return F.exp(F.least(loss, F.lit(cap)))


def repetition_score(words: Column) -> Column:
    """Share of repeated words, raised by the most frequent 4-gram; between zero and one."""
    from textloom.plans.rules import ngram_signal

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - T.ratio(F.size(F.array_distinct(words)), F.size(words)) + 0.12 * F.greatest(ngram_signal(words, 4)["max_count"] - 1, F.lit(0))))


def clean_response(text: Column, stops: Sequence[str], special: Sequence[str] = ("</s>", "<pad>", "<unk>")) -> Column:
    """A response up to its first stop string, without special pieces."""
    for s in stops:
        text = F.substring_index(text, s, 1)
    for s in special:
        text = F.replace(text, F.lit(s), F.lit(""))
    return F.trim(text)


#: Marks in grounded samples; fixed values.
SAMPLE_REFUSALS = ("i can't say that", "i cant say that", "i can’t say that", "i can't help you", "i can’t help you", "i can't help you to help")
SAMPLE_ABSTENTIONS = (
    "not listed", "not in the catalog", "not in the handbook", "not enough information", "cannot confirm", "can't confirm", "i don't see", "i do not see", "i can't verify", "i cannot verify",
)
SAMPLE_CLARIFICATIONS = ("what ", "which ", "can you share", "could you share", "tell me more", "before i recommend", "before recommending")
SOURCE_MENTIONS = {"course catalog": ("course catalog says", "catalog says", "[source: course catalog]"), "handbook": ("handbook says", "[source: handbook]")}
FABRICATED = ("the handbook says", "the course catalog says", "catalog says", "handbook says")
GROUNDED_COUNTS = ("unsupported_source_tag", "wrong_source_attribution", "grounded_abstention_fail", "clarification_missing", "fabricated_fact_pattern")


def source_mentions(response: Column) -> Column:
    """The sources that a response names, lower-cased: those in tags and those it says something of."""
    low = F.lower(response)
    tags = F.transform(F.regexp_extract_all(response, F.lit(r"(?i)\[source:\s*([^\]]+)\]"), F.lit(1)), lambda x: F.lower(T.squeeze(x)))
    said = F.array_compact(F.array(*[F.when(T.contains_any([low], marks), label) for label, marks in SOURCE_MENTIONS.items()]))
    return F.array_distinct(F.concat(tags, said))


def grounded_sample(df: DataFrame, response: str = "response", mode: str = "expected_mode", allowed: str = "allowed_sources", forbidden: str = "forbidden_sources", requires: str = "requires_source") -> DataFrame:
    """Adds the counts GROUNDED_COUNTS of each sample: tags without a source to cite or none where one is needed, sources that
    are not allowed, answers where it should abstain, none of the questions it should ask, and facts it makes up."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__r", T.squeeze(F.coalesce(response, F.lit(""))))
    df = df.withColumns({"__m": source_mentions(F.col("__r")), "__ok": F.transform(F.coalesce(allowed, none), lambda x: F.lower(T.squeeze(x))), "__no": F.transform(F.coalesce(forbidden, none), lambda x: F.lower(T.squeeze(x)))})
    low, said, kind, needs = F.lower("__r"), F.size("__m") > 0, F.lower(T.squeeze(F.coalesce(mode, F.lit("")))), F.coalesce(requires, F.lit(False))
    has = F.size("__ok") > 0
    wrong = (has & said & (F.size(F.array_except("__m", "__ok")) > 0)) | F.coalesce(F.arrays_overlap("__no", "__m"), F.lit(False))
    silent = (kind == "abstain") & ~T.contains_any([low], SAMPLE_ABSTENTIONS)
    asks = F.col("__r").contains("?") | T.contains_any([low], SAMPLE_CLARIFICATIONS)
    n = lambda c: c.cast("int")
    counts = {
        "unsupported_source_tag": n(said & ~has & ~needs) + n(needs & ~said),
        "wrong_source_attribution": n(wrong),
        "grounded_abstention_fail": n(silent),
        "clarification_missing": n((kind == "clarify") & ~asks),
        "fabricated_fact_pattern": n(silent & said) + n(kind.isin("abstain", "clarify") & T.contains_any([low], FABRICATED) & said),
    }
    return df.withColumns({k: F.when(F.col("__r") == "", 0).otherwise(v) for k, v in counts.items()}).drop("__r", "__m", "__ok", "__no")


def sample_behavior(scored: DataFrame, response: str = "response") -> DataFrame:
    """One row over grounded samples: blank, refusing and repetitive ones, the sums of GROUNDED_COUNTS, whether they collapse
    and what blocks a promotion."""
    from textloom.plans.rules import ngram_signal

    df = scored.withColumn("__t", F.lower(T.squeeze(F.coalesce(response, F.lit(""))))).withColumn("__w", T.split_words(F.col("__t")))
    repetitive = (F.size("__w") >= 6) & (T.ratio(ngram_signal(F.col("__w"), 1)["max_count"], F.size("__w")) >= 0.35)
    out = df.agg(
        F.count_if(F.col("__t") == "").alias("blank"), F.count_if((F.col("__t") != "") & T.contains_any([F.col("__t")], SAMPLE_REFUSALS)).alias("generic_refusal"), F.count_if(repetitive).alias("repetitive"),
        *[F.coalesce(F.sum(F.col(k).cast("long")), F.lit(0)).alias(k) for k in GROUNDED_COUNTS],
    )
    c = F.col
    blockers = [
        ("blank_sample_output", c("blank") > 0), ("generic_refusal_collapse", c("generic_refusal") > 0), ("repetitive_sample_collapse", c("repetitive") > 0),
        ("unsupported_grounded_claims", (c("unsupported_source_tag") >= 2) | (c("fabricated_fact_pattern") >= 2)), ("grounded_abstention_failures", c("grounded_abstention_fail") > 0),
        ("source_attribution_failures", c("wrong_source_attribution") > 0),
    ]
    collapse = (c("blank") > 0) | (c("generic_refusal") > 0) | (c("repetitive") >= 2) | (c("wrong_source_attribution") > 0) | (c("grounded_abstention_fail") > 0) | (c("unsupported_source_tag") >= 2)
    return out.withColumn("collapse_detected", collapse).withColumn("blockers", F.array_compact(F.array(*[F.when(cond, name) for name, cond in blockers])))


def counts_as_collapse(step: Column, steps_per_epoch: Column, behavior: DataFrame | None = None) -> Column:
    """Whether a collapse counts towards stopping, over columns of sample_behavior: severe ones at once, failures to abstain
    from half an epoch on, others always."""
    c = F.col
    severe = (c("blank") > 0) | (c("generic_refusal") > 0) | (c("repetitive") >= 2) | (c("wrong_source_attribution") > 0) | (c("unsupported_source_tag") >= 2)
    warm = F.greatest(F.lit(1), F.ceil(F.greatest(steps_per_epoch, F.lit(1)) * 0.5))
    return (step > 0) & c("collapse_detected") & (severe | F.when(c("grounded_abstention_fail") > 0, step >= warm).otherwise(F.lit(True)))


def includes_samples(step: Column, final: Column, best_step: Column, every: int) -> Column:
    return (step == 0) | final | (step == best_step) | (F.lit(every > 0) & (step > 0) & (F.pmod(step, F.lit(max(every, 1))) == 0))


def size_blockers(train: Column, validation: Column, least_train: int, least_validation: int) -> Column:
    small = [("dpo_train_dataset_too_small", F.lit(least_train > 0) & (train < least_train)), ("dpo_validation_dataset_too_small", F.lit(least_validation > 0) & (validation < least_validation))]
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in small]))


def lane_rollup(results: DataFrame, by: str = "lane", rates: Sequence[str] = ("exactness", "citation_rate", "abstention_rate"), weight: str = "examples") -> DataFrame:
    """Rates of each lane over several results, weighted by examples."""
    return results.groupBy(by).agg(F.sum(weight).alias(weight), *[(F.sum(F.col(r) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(r) for r in rates])


def retrieval_rates(totals: DataFrame) -> DataFrame:
    """Adds the rates that a retrieval audit's totals give; null where nothing was asked."""
    c = F.col
    share = lambda n, d: F.when(c(d) > 0, n / c(d))
    return totals.withColumns(
        {
            "router_trigger_rate": share(c("router_triggers"), "queries"), "retrieval_hit_rate": share(c("retrieval_hits"), "queries"),
            "present_query_hit_rate": share(c("present_queries") - c("retrieval_false_negatives"), "present_queries"), "retrieval_false_negative_rate": share(c("retrieval_false_negatives"), "present_queries"),
            "true_missing_rate": share(c("true_missing_answers"), "missing_queries"), "model_hallucination_after_no_hit_rate": share(c("model_hallucinations_after_no_hit"), "missing_queries"),
        }
    )


def output_flags(prompt: Column, output: Column, hits: Column) -> Column:
    """What is notable about a checkpoint's answer to a fixed prompt."""
    from textloom.plans.rules import ngram_signal

    low, asked = F.lower(output), F.lower(prompt)
    missing = asked.contains("dean") & asked.contains("does not name")
    prerequisite = asked.contains("prerequisite") & asked.contains("recommendation")
    words = F.regexp_extract_all(low, F.lit("[A-Za-z0-9']+"), F.lit(0))
    first = F.slice(F.regexp_extract_all(prompt, F.lit("[A-Za-z]{5,}"), F.lit(0)), 1, 3)
    return F.struct(
        (T.strip(output) == "").alias("blank"), output.rlike(r"(?i)\[(source|citation):").alias("fake_citation"),
        (T.contains_any([low], ("does not contain enough information", "cannot answer")) & ~missing).alias("over_refusal"), (ngram_signal(words, 4)["max_count"] >= 3).alias("semantic_repetition"),
        F.exists(first, lambda w: low.contains(F.lower(w))).alias("prompt_retention"), F.when(prerequisite, low.contains("required") & T.contains_any([low], ("suggested", "not required"))).alias("context_grounded"),
        F.when(missing, T.contains_any([low], ("does not contain", "not name", "not enough"))).alias("missing_context_honesty"), (hits > 0).alias("retrieved_chunk_usage"),
        (F.size(T.split_words(T.squeeze(output))) > 90).alias("copies_context_too_much"), T.contains_any([low], ("dean is", "deadline is", "phone number is")).alias("unsupported_fact_risk"),
    )


def family_ranking(losses: DataFrame, family: str = "family", loss: str = "loss") -> DataFrame:
    """(family, loss, perplexity, windows, place): mean losses of holdout families, the best first."""
    out = losses.groupBy(family).agg(F.round(F.avg(loss), 6).alias("loss"), F.round(perplexity(F.avg(loss)), 6).alias("perplexity"), F.count(F.lit(1)).alias("windows"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("loss", family)))  # a row per family


def series(history: DataFrame, step: str, losses: Sequence[str], perplexities: Sequence[str]) -> DataFrame:
    """(step, loss, perplexity): the first of some columns that is there; a perplexity that is not follows from the loss."""
    loss = F.coalesce(*[F.col(x) for x in losses])
    given = F.coalesce(*[F.col(x) for x in perplexities])
    return history.select(F.col(step).alias("step"), loss.alias("loss"), F.coalesce(given, F.when(loss.isNotNull(), perplexity(loss, 13.8))).alias("perplexity")).filter("loss IS NOT NULL OR perplexity IS NOT NULL")


def output_precision(key: Column) -> Column:
    """Decimals that a value is shown with, by the last telling name of its key path (joined by dots)."""
    names = F.reverse(F.split(F.lower(key), r"\."))
    digits = F.transform(names, lambda n: F.when((n == "lr") | n.contains("learning_rate") | n.endswith("_lr"), 8).when(n.contains("loss"), 5).when(n.contains("margin"), 3))
    return F.coalesce(F.try_element_at(F.array_compact(digits), F.lit(1)), F.lit(2))


def rounded_output(value: Column, key: Column) -> Column:
    """A value at its precision, half to even; minus zero is zero, and what is no finite number stays."""
    digits = output_precision(key)
    out = F.lit(None).cast("double")
    for n in (2, 3, 5, 8):
        out = F.when(digits == n, F.bround(value, n)).otherwise(out)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(F.when(out == 0, 0.0).otherwise(out))


def outcome_predicates(df: DataFrame) -> DataFrame:
    """Adds generated, with_sources, weak, abstained, fallback and failed to output rows (text, response, status and rag as
    structs, abstained, output_degenerate, final_label ...), whichever of the fields there are."""
    known = {f.name: f.dataType for f in df.schema.fields}

    def get(path: str, kind: str) -> Column:
        head, _, tail = path.partition(".")
        if head not in known or tail and tail not in getattr(known[head], "names", ()):
            return F.lit(None).cast(kind)
        return F.col(path).cast(kind)

    flag = lambda *paths: F.coalesce(*[get(p, "boolean") for p in paths], F.lit(False))
    either = lambda *paths: sum((flag(p).cast("int") for p in paths), F.lit(0)) > 0
    text = F.coalesce(F.nullif(get("text", "string"), F.lit("")), get("response", "string"), F.lit(""))
    count = F.coalesce(get("retrieved_hit_count", "int"), get("rag.retrieved_hits", "int"), F.lit(0))
    abstained = either("status.abstained", "abstained") | F.lower(text).contains("does not contain enough information")
    reasons = F.coalesce(F.size(get("quality_reasons", "array<string>")), F.lit(0)) > 0
    weak = either("output_degenerate", "status.degenerate_output", "status.generation_failed") | reasons
    label = F.lower(F.coalesce(get("final_label", "string"), get("status.final_label", "string"), F.lit("")))
    fallback = either("fallback_triggered", "status.retrieved_context_fallback") | label.contains("fallback")
    generated = (T.strip(text) != "") & ~abstained
    attached = (count > 0) & F.coalesce(get("source_display_correct", "boolean"), F.lit(True))
    return df.withColumns({"is_generated": generated, "with_sources": generated & attached, "is_weak": weak, "is_abstained": abstained, "is_fallback": fallback, "is_failed": flag("status.generation_failed") | fallback & weak})


def outcome_counts(df: DataFrame) -> DataFrame:
    """(outcome, n): how many rows show each outcome; a row may show several."""
    names = {"Generated": "is_generated", "Generated with sources": "with_sources", "Weak generation": "is_weak", "Abstained": "is_abstained", "Generation failed": "is_failed"}
    return funnel({k: F.col(v) for k, v in names.items()}, outcome_predicates(df)).select(F.col("stage").alias("outcome"), "n")


def output_cases(parts: Sequence[tuple[str, DataFrame]], fields: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(source, prompt, text, reasons) of output files of several shapes; fields gives each source's expressions for prompt,
    text and reasons. Rows without a text are left out."""
    union = None
    for name, df in parts:
        own = fields[name]
        rows = df.select(F.lit(name).alias("source"), F.coalesce(F.expr(own["prompt"]), F.lit("prompt")).alias("prompt"), F.coalesce(F.expr(own["text"]), F.lit("")).alias("text"),
                         F.coalesce(F.expr(own.get("reasons", "array()")).cast("array<string>"), F.array().cast("array<string>")).alias("reasons"))
        rows = rows.filter("text <> ''")
        union = rows if union is None else union.unionByName(rows)
    return union


def checkpoint_deltas(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of two evaluations side by side with their differences; what only one has is null in the other."""
    left = a.select(*key, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*key, *[F.col(v).alias(f"{v}_b") for v in values])
    met = left.join(right, list(key), "full")
    return met.select(*key, *[c for v in values for c in (f"{v}_a", f"{v}_b")], *[(F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_delta") for v in values])


def assistant_benchmark(scored: DataFrame, score: str = "score", threshold: str = "threshold", exact: str = "exact", cited: str = "cited") -> DataFrame:
    """One row: examples, average score, the share that passes (its threshold, one by default), exact and citing shares."""
    passes = (F.col(score) >= F.coalesce(threshold, F.lit(1.0))).cast("double")
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scored.agg(F.count(F.lit(1)).alias("examples"), share(F.col(score)).alias("average_score"), share(passes).alias("pass_rate"), share(F.col(exact).cast("double")).alias("exact_rate"), share(F.col(cited).cast("double")).alias("citation_rate"))


def fixed_prompt_rollup(df: DataFrame) -> DataFrame:
    """One row over answers to fixed prompts (hits, output_degenerate, abstained, answered, grounded, fallback)."""
    on = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("prompts"), on(F.col("hits") > 0).alias("with_hits"), *[on(F.col(c)).alias(c) for c in ("output_degenerate", "abstained", "answered", "grounded", "fallback")])


def low_loss_summary(events: DataFrame, names: Mapping[str, str], value: str, key: str, top: int) -> DataFrame:
    """(kind, name, n): the top names of each kind by (-events, name), and the key of the least value of all and by tier."""
    union = None
    for kind, column in names.items():
        counted = events.groupBy(F.col(column).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top)
        rows = counted.select(F.lit(kind).alias("kind"), "name", "n")
        union = rows if union is None else union.unionByName(rows)
    least = F.min_by(key, F.struct(value, key)).alias("n")
    union = union.unionByName(events.agg(least).select(F.lit("least").alias("kind"), F.lit("all").alias("name"), "n"))
    return union.unionByName(events.groupBy(F.col("tier").alias("name")).agg(least).select(F.lit("least").alias("kind"), "name", "n"))


#: Files that say whether an artifact may be promoted, in order, and the stages that a path may name. Fixed values.
TRUST_FILES = ("artifact_trust", "stage_summary", "checkpoint_metadata")
STAGES = ("pretrain", "continue", "sft", "dpo", "preference", "validation")


def artifact_trust(rows: DataFrame) -> DataFrame:
    """Adds artifact_status, promotion_eligible and source from the first of TRUST_FILES (JSON texts) that is there, with the
    defaults for what it does not say; where none is, the artifact may be promoted."""
    named = F.coalesce(*[F.when(F.col(f).isNotNull(), f) for f in TRUST_FILES])
    text = F.coalesce(*[F.col(f) for f in TRUST_FILES])
    get = lambda k: F.get_json_object(text, f"$.{k}")
    return rows.withColumns(
        {
            "artifact_status": F.coalesce(get("artifact_status"), F.lit("promotable")), "run_health_status": F.coalesce(get("run_health_status"), F.lit("valid")),
            "promotion_eligible": F.coalesce(get("promotion_eligible").cast("boolean"), named.isNull()), "source": F.coalesce(named, F.lit("")),
        }
    )


def stage_of(path: Column) -> Column:
    """The first part of a path that names a stage."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: p.isin(*STAGES)), F.lit(1))


def run_metrics(rows: DataFrame, by: str) -> DataFrame:
    """A row per run over output rows: counts that are set side by side before and after, and the rates of a radar."""
    reasons = F.coalesce(F.col("quality_reasons"), F.array().cast("array<string>")) if "quality_reasons" in rows.columns else F.array().cast("array<string>")
    df = outcome_predicates(rows).withColumns({"__reasons": reasons, "__hits": F.coalesce("retrieved_hit_count", F.lit(0))})
    attached = (F.col("__hits") > 0) & (F.coalesce("source_display_correct", F.lit(True)) if "source_display_correct" in rows.columns else F.lit(True))
    on = F.count_if
    c, total = F.col, F.count(F.lit(1))
    named = lambda *names: F.sum(F.size(F.array_intersect("__reasons", F.array(*map(F.lit, names)))))
    return df.groupBy(by).agg(
        on(c("is_weak") & ~c("is_abstained")).alias("bad_outputs"), on(c("is_abstained")).alias("abstentions"), on(attached).alias("sources_surfaced"), on(c("is_weak")).alias("weak_outputs"), on((c("__hits") > 0) | c("is_abstained")).alias("grounded"),
        F.greatest(F.lit(0.0), 1 - on(c("is_weak")) / total).alias("fluency"), F.greatest(F.lit(0.0), 1 - named("low_prompt_retention", "prompt_not_reflected") / total).alias("prompt_retention"), (on((c("__hits") > 0) | c("is_abstained")) / total).alias("grounding_support"),
        F.coalesce(F.try_divide(on((c("__hits") == 0) & c("is_abstained")), on(c("__hits") == 0)), F.lit(0.0)).alias("abstention_honesty"), F.greatest(F.lit(0.0), 1 - named("repeated_phrase", "dominant_repeated_token") / total).alias("repetition_control"),
        F.coalesce(F.try_divide(on(attached), on(c("__hits") > 0)), F.lit(0.0)).alias("source_surfacing"),
    )
