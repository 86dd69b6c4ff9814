"""Reports over sources, manifests and outputs: scaffold phrases, dominance, contribution, gates, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.ranges import ranked
from textloom.plans import lists as L

#: Limits of the corpus gates; fixed values.
MAX_4GRAM, MAX_8GRAM, MAX_12GRAM, MAX_DOMAIN_20GRAM = 8_000, 4_000, 2_500, 500
MAX_NEAR_DUPLICATE, MAX_DOMINANCE, DOMINANCE_DOCUMENTS = 0.12, 0.20, 16
MIN_DOMAIN_SHARE, MIN_DOMAIN_TOKENS, MIN_DOMAIN_REALIZATION = 0.05, 5_000_000, 0.5
BROAD_ALLOWED_PHRASES = ("the model", "in scenario")

n_rows = lambda: F.count(F.lit(1))


def scaffold_counts(df: DataFrame, by: str = "source", text: str = "text", phrases: Sequence[str] = L.SCAFFOLD_PHRASES) -> DataFrame:
    """(by, phrase, occurrences) over the raw text of every record, dropped ones too; phrases that never occur are left out."""
    low = df.select(by, F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    sums = low.groupBy(by).agg(*[F.sum(T.occurrences(F.col("low"), p).cast("long")).alias(f"p{i}") for i, p in enumerate(phrases)])
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("occurrences")) for i, p in enumerate(phrases)])
    return sums.select(by, F.inline(rows)).filter("occurrences > 0")


def dominance(families: DataFrame, documents: DataFrame, by: str = "source") -> DataFrame:
    """(by, dominance): the largest count among leading 8-, 12- and 20-grams over kept documents; zero for few of these.

    families(by, n, count), documents(by, documents).
    """
    top = families.filter(F.col("n").isin(8, 12, 20)).groupBy(by).agg(F.max("count").alias("__top"))
    share = F.when(F.col("documents") < DOMINANCE_DOCUMENTS, 0.0).otherwise(T.ratio(F.coalesce("__top", F.lit(0)), F.col("documents")))
    return documents.join(top, by, "left").select(by, F.round(share, 6).alias("dominance"))


def contribution(report: DataFrame, domain: Column, targets: Mapping[str, float]) -> DataFrame:
    """One row: tokens and documents of domain sources, their shares, how much of the target is realised, failures."""
    target = sum(targets.values())
    out = report.agg(
        F.coalesce(F.sum(F.when(domain, F.col("tokens"))), F.lit(0)).alias("domain_tokens"),
        F.coalesce(F.sum(F.when(domain, F.col("documents"))), F.lit(0)).alias("domain_documents"),
        F.sum("tokens").alias("__t"),
        F.sum("documents").alias("__d"),
    )
    share = T.ratio(F.col("domain_tokens"), F.col("__t"))
    realised = share / target if target else F.lit(0.0)
    failures = [
        ("domain_token_share_too_low", share < MIN_DOMAIN_SHARE),
        ("domain_tokens_too_low", F.col("domain_tokens") < MIN_DOMAIN_TOKENS),
        ("domain_realization_ratio_too_low", F.lit(target >= MIN_DOMAIN_SHARE) & (realised < MIN_DOMAIN_REALIZATION)),
    ]
    return out.select(
        "domain_tokens", "domain_documents", F.round(share, 6).alias("token_share"), F.round(T.ratio(F.col("domain_documents"), F.col("__d")), 6).alias("document_share"),
        F.round(F.lit(float(target)), 6).alias("configured_share"), F.round(realised, 6).alias("realization_ratio"), F.array_compact(F.array(*[F.when(c, n) for n, c in failures])).alias("failures"),
    )


def realization_gate(row: DataFrame, mode: str) -> DataFrame:
    """Adds passed and severity to a contribution, by mode off, informational, warn or fail."""
    loose = mode in ("off", "informational")
    bad = F.size("failures") > 0
    severity = F.when(~bad, "pass").otherwise("informational" if loose else "error" if mode == "fail" else "warning")
    return row.withColumn("passed", F.lit(True) if loose else ~bad).withColumn("severity", severity)


def corpus_gate(families: DataFrame, report: DataFrame, scaffold: DataFrame, domain: Column, gated: Column) -> DataFrame:
    """One row: the extremes that the corpus gate looks at, failures and passed. families(source, n, count), report(source,
    documents, near_duplicate_ratio), scaffold(source, phrase, occurrences); domain and gated: conditions on source."""
    most = families.groupBy().agg(*[F.coalesce(F.max(F.when(F.col("n") == k, F.col("count"))), F.lit(0)).alias(f"max_{k}gram") for k in (4, 8, 12)],
                                  F.coalesce(F.max(F.when((F.col("n") == 20) & domain, F.col("count"))), F.lit(0)).alias("max_domain_20gram"))
    share = dominance(families, report.select("source", "documents")).agg(F.coalesce(F.max("dominance"), F.lit(0.0)).alias("max_dominance"))
    near = report.agg(F.coalesce(F.max(F.when(gated, F.col("near_duplicate_ratio"))), F.lit(0.0)).alias("max_near_duplicate"))
    counted = domain | ~F.col("phrase").isin(*BROAD_ALLOWED_PHRASES)
    phrases = scaffold.agg(F.coalesce(F.sum(F.when(counted, F.col("occurrences"))), F.lit(0)).alias("scaffold_phrases"))
    wide = most.crossJoin(share).crossJoin(near).crossJoin(phrases)  # a row each
    rules = [
        ("synthetic_meta_phrase_count_nonzero", F.col("scaffold_phrases") > 0),
        ("repeated_4gram_count_above_limit", F.col("max_4gram") > MAX_4GRAM),
        ("repeated_8gram_count_above_limit", F.col("max_8gram") > MAX_8GRAM),
        ("repeated_12gram_count_above_limit", F.col("max_12gram") > MAX_12GRAM),
        ("template_family_dominance_above_limit", F.col("max_dominance") > MAX_DOMINANCE),
        ("near_duplicate_ratio_above_limit", F.col("max_near_duplicate") > MAX_NEAR_DUPLICATE),
        ("domain_repeated_20gram_count_above_limit", F.col("max_domain_20gram") > MAX_DOMAIN_20GRAM),
    ]
    return wide.withColumn("failures", F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).withColumn("passed", F.size("failures") == 0)


def readiness(report: DataFrame, tokens: int, documents: int, families: int, max_share: float, max_repeat_rate: float) -> DataFrame:
    """One row: whether a corpus is enough to go on with. report(source, family, tokens, documents, duplicates)."""
    wide = report.agg(
        F.sum("tokens").alias("clean_tokens"), F.sum("documents").alias("documents"), F.countDistinct("family").alias("families"), F.max("tokens").alias("__most"),
        F.max(T.ratio(F.col("repeated"), F.col("documents"))).alias("max_repeat_rate"),
    )
    wide = wide.withColumn("max_source_share", F.round(T.ratio(F.col("__most"), F.col("clean_tokens")), 6)).drop("__most")
    rules = [
        ("insufficient_clean_tokens", F.col("clean_tokens") < tokens),
        ("insufficient_documents", F.col("documents") < documents),
        ("insufficient_source_families", F.col("families") < families),
        ("single_source_share_too_high", F.col("max_source_share") > max_share),
        ("repeat_rate_too_high", F.col("max_repeat_rate") > max_repeat_rate),
    ]
    return wide.withColumn("failures", F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).withColumn("passed", F.size("failures") == 0)


def contributor_counts(windows: DataFrame, contributors: str = "contributors") -> DataFrame:
    """(source, document_id, appearances) over packed windows."""
    return windows.select(F.explode(contributors).alias("c")).groupBy("c.source", "c.document_id").agg(n_rows().alias("appearances"))


def weighted_density(densities: DataFrame) -> DataFrame:
    """(family, density): densities of all sources weighted by their tokens."""
    return densities.groupBy("family").agg(F.round(F.sum(F.col("density") * F.col("tokens")) / F.greatest(F.sum("tokens"), F.lit(1)), 6).alias("density"))


def merged_reasons(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("drop_reason").agg(F.sum("n").alias("n"))


def example_diagnostics(df: DataFrame, by: Sequence[str], signature: str, label_tokens: str, total_tokens: str, limit: int) -> DataFrame:
    """Rows, label tokens, shares, cut examples and repeated prompts by group. Repeats are counted per group from one
    aggregate by signature, combined before its shuffle."""
    per = df.groupBy(*by, signature).agg(n_rows().alias("__n"), F.sum(label_tokens).alias("__l"), F.count_if(F.col(total_tokens) > limit).alias("__c"))
    out = per.groupBy(*by).agg(F.sum("__n").alias("rows"), F.sum("__l").alias("label_tokens"), F.sum("__c").alias("truncated"), F.sum(F.col("__n") - 1).alias("duplicate_prompts"))
    columns, whole = out.columns, Window.partitionBy(F.lit(1))  # a row per group
    joined = out.withColumn("__r", F.sum("rows").over(whole)).withColumn("__t", F.sum("label_tokens").over(whole))
    return joined.select(*columns, F.round(T.ratio(F.col("rows"), F.col("__r")), 6).alias("row_share"), F.round(T.ratio(F.col("label_tokens"), F.col("__t")), 6).alias("label_token_share"))


#: Questions, the answer to what a context does not hold, and ranks of risk; fixed values.
QUESTIONS = (
    "What information does this context provide?",
    "What should a student understand from this context?",
    "How would you answer using only this context?",
    "What should an assistant not infer beyond this context?",
    "What kind of question can this context support?",
)
MISSING_QUESTIONS = ("Who is the dean?", "What is the current phone policy?", "What is the admissions deadline?", "What are the dining hall hours?")
MISSING_ANSWER = "The context does not contain enough information to answer that question, so I should not invent the missing detail."
RISK = {"low": 0, "medium": 1, "high": 2}


def grounded_answer(text: Column, template: Column) -> Column:
    """An answer from the template-th sentence of eight words or more, cut at 48 words, in one of three forms, at least
    fifteen words long."""
    words = lambda s: T.split_words(s)
    clean = T.squeeze(text)
    long = F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda s: F.size(words(s)) >= 8)
    first = F.when(F.size(long) > 0, F.get(long, F.pmod(template, F.greatest(F.size(long), F.lit(1))))).otherwise(F.array_join(F.slice(words(clean), 1, 35), " "))
    cut = F.when(F.size(words(first)) > 48, F.rtrim(F.array_join(F.slice(words(first), 1, 48), " "), F.lit(",;:"))).otherwise(first)
    sentence = F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    lowered = F.concat(F.lower(F.left(sentence, F.lit(1))), F.substr(sentence, F.lit(2)))
    form = F.pmod(template, F.lit(3))
    answer = (
        F.when(form == 1, F.concat(F.lit("Using only the context, the supported point is that "), lowered))
        .when(form == 2, F.concat(F.lit("The answer should stay limited to this context: "), sentence))
        .otherwise(F.concat(F.lit("The context says that "), lowered))
    )
    return F.when(F.size(words(answer)) < 15, F.concat(answer, F.lit(" This answer stays limited to the provided context."))).otherwise(answer)


def examples_from_chunks(chunks: DataFrame, train: int, validation: int, risk: str = "medium", per_chunk: int = 2) -> DataFrame:
    """Question rows from chunks (chunk_id, source_file, risk_level, allowed_use, text): allowed ones in the order of risk,
    file and id; every fifth is for validation; each gives per_chunk questions and every third one a question that it
    can't answer; a split ends at its target. Ranks run over chunk ids only."""
    rank = F.lit(99)
    for name, k in RISK.items():
        rank = F.when(F.lower("risk_level") == name, k).otherwise(rank)
    allowed = chunks.withColumn("__risk", rank).filter(F.lower("allowed_use").contains("rag") & (F.col("__risk") <= RISK[risk]) & (F.size(T.split_words(T.squeeze(F.col("text")))) >= 80))
    place = ranked(allowed.select("chunk_id", "__risk", "source_file"), ["__risk", "source_file", "chunk_id"], "__i")
    # Every fifth goes to validation, so a chunk's index in its split follows from its rank, and from that how many
    # questions the chunks before it in the split give.
    held = F.col("__i") % 5 == 0
    index = F.when(held, F.floor(F.col("__i") / 5)).otherwise(F.col("__i") - F.floor(F.col("__i") / 5) - 1)
    place = place.withColumn("split", F.when(held, "validation").otherwise("train")).withColumn("index", index)
    asks = F.concat(F.sequence(F.lit(0), F.lit(per_chunk - 1)), F.when(F.col("index") % 3 == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    asked = place.select("chunk_id", "split", "index", F.posexplode(asks).alias("k", "template"))
    number = F.col("index") * per_chunk + F.ceil(F.col("index") / 3) + F.col("k")
    asked = asked.withColumn("number", number).filter(F.col("number") < F.when(F.col("split") == "train", train).otherwise(validation))
    pick = lambda options, at: F.get(F.array(*map(F.lit, options)), F.pmod(at, F.lit(len(options))))
    missing = F.col("template") < 0
    return asked.join(chunks.select("chunk_id", "text", "source_file"), "chunk_id").select(
        F.format_string("grounded-%s-%04d", "split", "number").alias("row_id"), "split", "chunk_id", "source_file",
        F.when(missing, "missing_context_abstention").otherwise("grounded_context_answer").alias("mix"),
        F.when(missing, pick(MISSING_QUESTIONS, F.col("index"))).otherwise(pick(QUESTIONS, F.col("index") + F.col("template"))).alias("question"),
        F.when(missing, MISSING_ANSWER).otherwise(grounded_answer(F.col("text"), F.col("template"))).alias("answer"),
    )


def outcomes(df: DataFrame) -> DataFrame:
    """One row of non-exclusive counts over output rows (response, hits, abstained, fallback)."""
    blank = F.trim(F.coalesce("response", F.lit(""))) == ""
    return df.agg(
        n_rows().alias("rows"), F.count_if(~blank).alias("answered"), F.count_if(blank).alias("blank"), F.count_if(F.coalesce("hits", F.lit(0)) > 0).alias("grounded"),
        F.count_if(F.coalesce("abstained", F.lit(False))).alias("abstained"), F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallback"),
    )


def progress(df: DataFrame, done: str, total: str, seconds: str) -> DataFrame:
    """Adds the share done and the seconds left at the pace so far."""
    rate = F.col(done) / F.when(F.col(seconds) > 0, F.col(seconds))
    return df.withColumn("share", T.ratio(F.col(done), F.col(total))).withColumn("seconds_left", (F.col(total) - F.col(done)) / F.when(rate > 0, rate))


def swing(n: Column) -> Column:
    """How much one example moves a rate, and a warning where there are fewer than eight."""
    return F.struct((1 / F.greatest(n, F.lit(1))).alias("per_example"), (n < 8).alias("few"))


def preference_metrics(df: DataFrame, chosen: str, rejected: str, chosen_base: str, rejected_base: str, beta: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one by group: loss, accuracy and margin from log-probabilities of the policy and of the reference."""
    margin = beta * ((F.col(chosen) - F.col(chosen_base)) - (F.col(rejected) - F.col(rejected_base)))
    return df.groupBy(*by).agg(F.avg(F.log1p(F.exp(-margin))).alias("loss"), F.avg((margin > 0).cast("double")).alias("accuracy"), F.avg(margin).alias("margin"))


def console_lines(judged: DataFrame, top: int) -> DataFrame:
    """(line): what a console shows of judged rows: kept rows by source and in all, and the most frequent rejects."""
    kept = F.count_if(F.col("drop_reason").isNull()).cast("string")
    of = F.concat(kept, F.lit(" kept of "), n_rows().cast("string"))
    sources = judged.groupBy("source").agg(of.alias("x")).select(F.concat(F.lit("source "), "source", F.lit(": "), "x").alias("line"))
    total = judged.agg(of.alias("x")).select(F.concat(F.lit("total: "), "x").alias("line"))
    rejects = judged.filter("drop_reason IS NOT NULL").groupBy("drop_reason").agg(n_rows().alias("n")).orderBy(F.desc("n"), "drop_reason").limit(top)
    return sources.union(total).union(rejects.select(F.concat(F.lit("reject "), "drop_reason", F.lit(": "), F.col("n").cast("string")).alias("line")))


def first_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """The counts (reason, n) of the first part that has any."""
    union = None
    for k, p in enumerate(parts):
        p = p.select("reason", "n", F.lit(k).alias("__k"))
        union = p if union is None else union.unionByName(p)
    return union.withColumn("__f", F.min("__k").over(Window.partitionBy(F.lit(1)))).filter("__k = __f").groupBy("reason").agg(F.sum("n").alias("n"))  # a row per reason
