"""Samples of a raw language model: legibility, topic, repetition, malformed words, drift; their gate; answer scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.rules import ngram_signal

# Word lists, patterns and limits of this module are fixed values: results depend on each of them.
ATTRACTORS = {
    "word_language_text": ("word", "words", "language", "term", "terms", "text", "texts"),
    "book_story_article_essay": ("book", "books", "story", "stories", "article", "articles", "essay", "essays"),
    "water_fire_land_history": ("water", "fire", "river", "rivers", "land", "city", "cities", "war", "wars"),
    "problem_issue_solution": ("problem", "problems", "issue", "issues", "solution", "solutions"),
    "data_study_research_result": ("data", "study", "studies", "research", "result", "results"),
    "product_computer_video_project": ("product", "products", "computer", "computers", "video", "videos", "project", "projects"),
    "student_course_class_teacher": ("student", "students", "course", "courses", "class", "classes", "teacher", "teachers"),
    "health_body_child_medical": ("health", "body", "bodies", "child", "children", "virus", "viruses", "infection", "infections", "diet", "diets", "heart"),
    "generic_fillers": ("world", "time", "thing", "things", "same", "important", "process", "people"),
}
GENERIC = tuple(w for words in ATTRACTORS.values() for w in words)
STOPWORDS = (
    "a an and are as at be because but by can for from has have help how if in is it its of on or should that the their then this to when who will with what which why you your"
).split()
DOMAIN_TERMS = (
    "advisor", "advising", "catalog", "class", "course", "credit", "department", "departmental", "description", "elective", "eligible", "enroll", "honors", "placement", "planning",
    "prerequisite", "prerequisites", "recommendation", "schedule", "semester", "workload",
)
CATALOG_CONTEXT = ("catalog", "course", "courses", "class", "classes")
CATALOG_GROUNDING = ("approval", "credit", "credits", "department", "departmental", "eligible", "eligibility", "enroll", "enrollment", "prerequisite", "prerequisites")
RECOMMENDATION_GROUNDING = ("background", "eligible", "eligibility", "prerequisite", "prerequisites", "recommendation", "recommendations", "required", "requirement", "requirements")
CREDIT_GROUNDING = ("credit", "credits", "eligible", "eligibility", "enroll", "enrollment", "junior", "juniors", "open", "senior", "seniors")
DOMAIN_BOILERPLATE = (
    "catalog entry should be read", "read for any placement or departmental approval notes", "the catalog entry should", "a useful continuation", "grounded in the catalog",
)
CATALOG_DRIFT = (
    "course catalog", "catalog entry", "catalog facts", "catalog says", "department approval", "departmental approval", "one-half credit", "prerequisite", "prerequisites",
)
NARRATIVE_DRIFT = (
    "catalog", "course", "students", "the article", "this article", "the study", "the research", "the history of", "geography", "in the early", "in the late", "united states", "population",
    "century", "government", "largest city", "first country", "was first known", "was established",
)
MEDICAL_DRIFT = (
    "blood", "body", "child", "children", "diabetes", "diet", "doctor", "food", "health", "medical", "pain", "symptoms", "virus", "viruses", "infection", "infections", "heart",
)
PRODUCT_DRIFT = ("computer", "computers", "data", "product", "products", "project", "projects", "research", "study", "studies", "video", "videos")
MAJOR_FAILURES = (
    "prompt_topic_retention_too_low", "domain_collapse", "boilerplate_repetition", "semantic_repetition", "narrative_to_expository_drift", "everyday_to_medical_drift",
    "catalog_advising_drift_into_unrelated_prompt", "malformed_token_rate_high",
)
UNFINISHED_WORDS = ("a", "an", "and", "as", "because", "but", "for", "from", "if", "in", "of", "or", "the", "to", "with")
RAW_WORD = r"[a-zA-Z][a-zA-Z']*"
WEIRD_HYPHEN = r"(?:\b[a-zA-Z]{1,6}-){2,}[a-zA-Z]{1,10}\b|-[a-zA-Z]{1,4}-|\b(?:Newth|F-the-s|based-in|in-in|to-in|mvp-[a-z]{1,3})\b"
MALFORMED_WORD = r"(?i)\b(?:scheduleite|berled|inology|engagingable|pronting|unforgetable)\b|\b[a-z]{4,}ingable\b|\bover-the-[a-z]{2,4}\b"
QUOTE = "[\"'“”‘’]"
QUOTE_LOOP = rf"(?i){QUOTE}[a-z]{{1,4}}{QUOTE}(?:\s+(?:or|and|is|means|of|in|as)\s+{QUOTE}[a-z]{{1,4}}{QUOTE}){{2,}}"
SMALL_QUOTED = rf"{QUOTE}([a-zA-Z]{{1,4}}){QUOTE}"

#: Marks of abstention that scorers of catalog and domain answers look for.
CATALOG_ABSTENTIONS = (
    "i don't know", "i do not know", "not enough information", "insufficient information", "i cannot confirm", "i can't confirm", "not in the catalog", "not listed in the catalog", "could not find",
    "couldn't find", "no matching catalog entries",
)
DOMAIN_ABSTENTIONS = (
    "i don't know", "i do not know", "not enough information", "insufficient information", "i cannot confirm", "i can't confirm", "could not find", "couldn't find", "cannot verify",
    "don't want to guess", "not listed",
)


def expectation_score(response: Column, codes: Column, every: Column, some: Column, abstains: Column, marks: Sequence[str]) -> Column:
    """exact, cited and abstained of an answer: whether it abstains where it should, else holds all expected codes and
    fragments and any of the alternatives; without an expectation, whether there is an answer."""
    text = F.coalesce(response, F.lit(""))
    low = F.lower(text)
    none = F.array().cast("array<string>")
    given = [F.coalesce(x, none) for x in (codes, every, some)]
    has = lambda x: low.contains(F.lower(x))
    met = F.forall(given[0], has) & F.forall(given[1], has) & ((F.size(given[2]) == 0) | F.exists(given[2], has))
    empty = (F.size(given[0]) == 0) & (F.size(given[1]) == 0) & (F.size(given[2]) == 0)
    abstained = T.contains_any([low], marks)
    exact = F.when(F.coalesce(abstains, F.lit(False)), abstained).when(empty, T.strip(text) != "").otherwise(met)
    return F.struct(exact.alias("exact"), T.contains_any([low], ("[source:", "<|citation|>")).alias("cited"), abstained.alias("abstained"))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.lower)


def _among(words: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*terms)))


def _keywords(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS) & ~w.isin(*GENERIC)))


def assess(df: DataFrame, response: str = "response", prompt: str = "prompt", bucket: str = "bucket", probe: str = "probe_type", institution: str | None = None) -> DataFrame:
    """Adds what a sample of a raw model shows: legible heads of 40 and 128 words, topic kept, the largest 4-gram count, odd
    hyphens, malformed words, unfinished ends, generic words, domain phrases and their accuracy, drifts, semantic loops and
    a drift score between zero and one. institution: a name that counts as a domain term and as drift."""
    terms, drifts = (*DOMAIN_TERMS, *([institution.lower()] if institution else [])), (*CATALOG_DRIFT, *([institution.lower()] if institution else []))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumns({"__r": T.squeeze(text(response)), "__p": F.lower(text(prompt)), "__b": F.lower(text(bucket)), "__k": F.lower(text(probe))})
    df = df.withColumns({"__low": F.lower("__r"), "__w": _words(F.col("__r")), "__pw": _words(F.col("__p"))})
    df = df.withColumns({"__c": F.filter("__w", lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS)), "__kw": _keywords(F.col("__w")), "__pk": _keywords(F.col("__pw"))})
    c = F.col
    count = F.size("__w")
    weird = F.regexp_count("__r", F.lit(WEIRD_HYPHEN))

    def legible(most: int) -> Column:
        head = F.slice("__w", 1, most)
        n = F.size(head)
        return (n >= 8) & (T.ratio(F.size(F.array_distinct(head)), n) >= 0.32) & (T.ratio(weird, n) <= 0.04) & (T.ratio(ngram_signal(head, 1)["max_count"], n) < 0.22)

    domain_probe = c("__k").contains("domain") | c("__b").contains("catalog")
    retained = F.when(F.size("__pk") == 0, F.size("__kw") > 0).otherwise(F.arrays_overlap("__pk", "__kw") | domain_probe & (_among(c("__kw"), terms) > 0))
    small = F.transform(F.regexp_extract_all("__r", F.lit(SMALL_QUOTED), F.lit(1)), F.lower)
    malformed = F.regexp_count("__r", F.lit(MALFORMED_WORD)) + weird + c("__r").rlike(QUOTE_LOOP).cast("int") + ((F.size(small) >= 6) & (F.size(F.array_distinct(small)) <= 4)).cast("int")
    tail = _words(F.right("__r", F.lit(80)))
    unfinished = (c("__r") == "") | ~c("__r").rlike("[.!?\"'”’)\\]]$") & ((F.size(tail) == 0) | F.coalesce(F.try_element_at(tail, F.lit(-1)), F.lit("a")).isin(*UNFINISHED_WORDS))
    boilerplate = T.count_containing(c("__low"), DOMAIN_BOILERPLATE)
    is_domain = domain_probe | c("__p").contains("catalog") | c("__p").contains("course")
    asks = lambda words, phrase: (_among(c("__pw"), words) > 0) | c("__p").contains(phrase)
    accurate = (
        F.when(~is_domain, None).when(_among(c("__w"), terms) == 0, False).when(boilerplate >= 2, False)
        .when(asks(("credit", "juniors", "seniors", "open"), "one-half credit"), _among(c("__w"), CREDIT_GROUNDING) > 0)
        .when(asks(("recommendation", "recommendations", "background"), "different from recommendations"), _among(c("__w"), RECOMMENDATION_GROUNDING) > 0)
        .when(c("__b").contains("catalog") | T.contains_any([c("__p")], ("catalog", "course", "class")), (_among(c("__w"), CATALOG_CONTEXT) > 0) & (_among(c("__w"), CATALOG_GROUNDING) > 0))
        .when(c("__k").contains("domain"), _among(c("__w"), (*CATALOG_GROUNDING, *RECOMMENDATION_GROUNDING)) > 0).otherwise(True)
    )
    everyday = c("__b").contains("everyday")
    total = F.size("__c")
    grams = {n: ngram_signal(c("__c"), n) for n in (2, 3)}
    df = df.withColumns(
        {
            "blank": c("__r") == "", "word_count": count, "first_40_legible": legible(40), "full_128_legible": legible(128), "topic_retained": retained, "max_4gram": ngram_signal(c("__w"), 4)["max_count"], "weird_hyphens": weird,
            "malformed_tokens": malformed, "unfinished": unfinished, "generic_words": _among(c("__w"), GENERIC), "boilerplate_hits": boilerplate, "domain_phrase_accurate": accurate,
            "catalog_drift": ~is_domain & ~T.contains_any([c("__p")], drifts) & T.contains_any([c("__low")], drifts), "narrative_drift": c("__b").contains("narrative") & T.contains_any([c("__low")], NARRATIVE_DRIFT),
            "medical_drift": everyday & (_among(c("__pw"), MEDICAL_DRIFT) == 0) & (_among(c("__w"), MEDICAL_DRIFT) > 0), "product_drift": everyday & (_among(c("__pw"), PRODUCT_DRIFT) == 0) & (_among(c("__w"), PRODUCT_DRIFT) >= 2),
            "dominant_content_rate": T.ratio(ngram_signal(c("__c"), 1)["max_count"], total), "content_bigram_rate": grams[2]["extra"], "content_trigram_rate": grams[3]["extra"], "__m3": grams[3]["max_count"], "__n": total,
        }
    )
    loop = (c("__n") >= 8) & ((c("dominant_content_rate") >= 0.24) | (c("content_bigram_rate") >= 0.18) | (c("content_trigram_rate") >= 0.12) | (c("__m3") >= 3))
    rate = T.ratio(c("generic_words"), c("word_count"))
    df = df.withColumns({"generic_rate": rate, "generic_attractor": (rate >= 0.16) | (c("generic_words") >= 20), "semantic_loop": loop})
    part = lambda cond, weight: F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    drift = (
        part(~c("topic_retained"), 0.35) + part(c("generic_attractor"), 0.20) + part(c("max_4gram") >= 3, 0.15) + part((c("malformed_tokens") > 0) | (c("weird_hyphens") > 0), 0.15) + part(c("semantic_loop"), 0.15)
        + part(c("narrative_drift") | c("medical_drift") | c("product_drift") | c("catalog_drift"), 0.10) + part(c("unfinished"), 0.05)
    )
    return df.withColumn("drift_score", F.least(drift, F.lit(1.0))).drop("__r", "__p", "__b", "__k", "__low", "__w", "__pw", "__c", "__kw", "__pk", "__m3", "__n")


def gate(assessed: DataFrame) -> DataFrame:
    """One row over assessed samples: rates, maxima, the reasons why the gate fails, in order, and whether it passes."""
    c, on = F.col, lambda x: F.count_if(F.col(x))
    out = assessed.agg(
        F.count(F.lit(1)).alias("samples"), on("blank").alias("blank"), on("first_40_legible").alias("first_40"), on("full_128_legible").alias("full_128"), on("topic_retained").alias("retained"), F.max("max_4gram").alias("max_4gram"),
        F.coalesce(F.sum("weird_hyphens"), F.lit(0)).alias("weird"), F.count_if(c("weird_hyphens") > 0).alias("weird_samples"), F.coalesce(F.sum("malformed_tokens"), F.lit(0)).alias("malformed"), F.count_if(c("malformed_tokens") > 0).alias("malformed_samples"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.count_if(c("domain_phrase_accurate").isNotNull()).alias("domain"), F.count_if(c("boilerplate_hits") > 0).alias("boilerplate"), on("catalog_drift").alias("catalog_drift"),
        on("semantic_loop").alias("loops"), F.max("content_bigram_rate").alias("bigram"), F.max("content_trigram_rate").alias("trigram"), on("narrative_drift").alias("narrative"), on("medical_drift").alias("medical"), on("product_drift").alias("product"),
        on("generic_attractor").alias("generic"), F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("drift"),
    )
    out = out.withColumns(
        {
            "first_40_rate": T.ratio(c("first_40"), c("samples")), "retention_rate": T.ratio(c("retained"), c("samples")), "generic_rate": T.ratio(c("generic"), c("samples")), "weird_rate": T.ratio(c("weird"), c("words")),
            "malformed_rate": T.ratio(c("malformed"), c("words")),
        }
    )
    share = lambda n: F.floor(c("samples") / n)
    everyday = (c("medical") >= 1) | (c("product") >= 1)
    rules = [
        ("blank_sample_output", c("blank") > 0), ("first_40_tokens_not_legible_enough", c("first_40") < F.least(F.lit(10), c("samples"))), ("prompt_topic_retention_too_low", c("retained") < F.least(F.lit(8), c("samples"))),
        ("dominant_repeated_4gram", c("max_4gram") >= 4), ("weird_hyphen_or_subword_artifacts", (c("weird_rate") > 0.025) | (c("weird_samples") >= F.greatest(F.lit(2), share(5)))),
        ("malformed_token_rate_high", (c("malformed_rate") > 0.015) | (c("malformed_samples") >= F.greatest(F.lit(1), share(6)))), ("domain_boilerplate_repetition", (c("domain") > 0) & (c("boilerplate") >= c("domain"))),
        ("boilerplate_repetition", (c("domain") > 0) & (c("boilerplate") >= c("domain"))), ("catalog_advising_drift_into_unrelated_prompt", c("catalog_drift") > 0),
        ("semantic_repetition", (c("loops") > 0) | (c("bigram") >= 0.18) | (c("trigram") >= 0.12)), ("narrative_prompts_drift_to_expository_history", c("narrative") >= 1), ("narrative_to_expository_drift", c("narrative") >= 1),
        ("everyday_prompts_drift_to_medical_body_child_content", everyday), ("everyday_to_medical_drift", everyday), ("generic_attractor_collapse", c("generic_rate") > 0.4), ("semantic_drift_too_high", c("drift") > 0.45),
    ]
    return out.withColumn("reasons", F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))).withColumn("passed", F.size("reasons") == 0)


def status(short: DataFrame, long: DataFrame) -> DataFrame:
    """One row: weak, improving or usable, from the gates of short stable samples and of long ones."""
    a = short.select(F.col("reasons").alias("ra"), F.col("passed").alias("pa"), F.col("first_40_rate").alias("f"), F.col("retention_rate").alias("t"))
    b = long.select(F.col("reasons").alias("rb"), F.col("passed").alias("pb"), F.col("drift").alias("d"), F.col("generic_rate").alias("g"))
    major = F.arrays_overlap(F.concat("ra", "rb"), F.array(*map(F.lit, MAJOR_FAILURES)))
    improving = (F.col("f") >= 0.75) & (F.col("t") >= 0.55) & (F.col("d") <= 0.4) & (F.col("g") <= 0.3)
    kind = F.when(F.coalesce(major, F.lit(False)), "weak_raw_lm").when(F.col("pa") & F.col("pb"), "usable_raw_lm").when(improving, "improving_raw_lm").otherwise("weak_raw_lm")
    return a.crossJoin(b).select(kind.alias("status"))  # a row each
