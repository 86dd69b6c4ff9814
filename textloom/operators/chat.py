"""Chat and preference examples: messages, signatures, buckets, quotas, grouped splits, leakage checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.ranges import running
from textloom.plans import lists as L

ROLES = ("system", "user", "assistant")


def gather(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(by, messages): turns in order as ARRAY<STRUCT<role, content>>; a conversation is taken to fit a row."""
    met = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return met.select(by, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def coalesce_messages(messages: Column, prompt: Column, response: Column) -> Column:
    """messages where there are any, else a user turn and an assistant turn."""
    turn = lambda role, t: F.struct(F.lit(role).alias("role"), t.alias("content"))
    return F.coalesce(F.when(F.size(messages) > 0, messages), F.array(turn("user", prompt), turn("assistant", response)))


def normalized(messages: Column, assistant: bool = True) -> Column:
    kept = messages if assistant else F.filter(messages, lambda m: F.trim(m["role"]) != "assistant")
    return F.transform(kept, lambda m: F.struct(F.trim(m["role"]).alias("role"), T.squeeze(m["content"]).alias("content")))


def signature_text(messages: Column) -> Column:
    """The prompt turns in a canonical form: content and role, in JSON."""
    return F.to_json(F.transform(normalized(messages, False), lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))))


def signature(messages: Column) -> Column:
    return F.sha2(signature_text(messages), 256)


def example_id(*ladder: Column, content: Column) -> Column:
    """The first non-empty of some columns, else a hash of the content."""
    return F.coalesce(*[T.nonempty(x.cast("string")) for x in ladder], F.sha2(content, 256))


def render(messages: Column) -> Column:
    """<|role|>, content and end mark by turn, joined by line feeds; an unknown role is an error."""
    known = lambda m: F.when(m["role"].isin(*ROLES), m["role"]).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), m["role"])).cast("string"))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), known(m), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n</s>"))), "\n")


def last_answer(messages: Column) -> Column:
    return F.coalesce(T.squeeze(F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]), F.lit(""))


def bucket_of(answer: Column, explicit: Column | None = None) -> Column:
    """The behaviour bucket: an alias that is given, else what the answer says."""
    low = F.lower(answer)
    inferred = (
        F.when(low == "", "hard_refusal")
        .when(T.contains_any([low], L.REFUSAL_PHRASES), "hard_refusal")
        .when(F.endswith(low, F.lit("?")) | T.contains_any([low], L.CLARIFY_PHRASES), "clarifying_question")
        .when(T.contains_any([low], L.ABSTAIN_PHRASES), "informative_abstention")
        .otherwise("constructive_direct")
    )
    if explicit is None:
        return inferred
    aliases = F.create_map(*[F.lit(x) for kv in L.BUCKET_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, T.nonempty(explicit)), inferred)


def keep_reason(answer: Column, bucket: Column, label_tokens: Column) -> Column:
    """Why an example is left out: a bare refusal, or an abstention of fewer than 24 label tokens."""
    return F.when(F.lower(answer).isin("i can't help with that.", "i cannot help with that.", "i'm sorry, i can't help with that."), "generic_refusal").when(
        (bucket == "informative_abstention") & (label_tokens < 24), "short_abstention"
    )


def targets_of(bucket: Column, targets: Mapping[str, tuple[float, float, int]] = L.BUCKET_TARGETS, default: str = "constructive_direct") -> Column:
    """The row share, token share and least number of a bucket; a bucket that is not known has those of the default."""
    def value(k: int) -> Column:
        out = F.lit(targets[default][k])
        for name, v in targets.items():
            out = F.when(bucket == name, F.lit(v[k])).otherwise(out)
        return out

    return F.struct(value(0).alias("share"), value(1).alias("token_share"), value(2).alias("least"))


def plan_total(available: Mapping[str, int], warmup: int = 40, targets: Mapping[str, tuple[float, float, int]] = L.BUCKET_TARGETS) -> int:
    """How many examples to take: all of few; else as many as the scarcest bucket that meets its minimum carries."""
    total = sum(available.values())
    if total <= warmup:
        return total
    floor = sum(min(n, targets.get(b, targets["constructive_direct"])[2]) for b, n in available.items())
    carried = [int(n / share) for b, n in available.items() for share, _, least in [targets.get(b, targets["constructive_direct"])] if n >= least and share > 0]
    return min(total, max(floor, min(carried))) if carried else total


def plan_quotas(available: Mapping[str, int], total: int, targets: Mapping[str, tuple[float, float, int]] = L.BUCKET_TARGETS) -> dict[str, int]:
    """Minima first, then one at a time to the bucket that lags its target share most."""
    default = targets["constructive_direct"]
    quota = {b: min(n, targets.get(b, default)[2]) for b, n in available.items()}
    while sum(quota.values()) < total:
        room = [b for b in quota if quota[b] < available[b]]
        if not room:
            break
        share = lambda b: targets.get(b, default)[0]
        quota[max(room, key=lambda b: (share(b) - quota[b] / total, share(b), available[b] - quota[b], b != "constructive_direct", b))] += 1
    return quota


def take_quotas(df: DataFrame, quotas: Mapping[str, int], bucket: str, order: str) -> DataFrame:
    """Each bucket's first rows in order up to its quota; informative abstentions from the newest."""
    quota = F.lit(0)
    for b, n in quotas.items():
        quota = F.when(F.col(bucket) == b, F.lit(n)).otherwise(quota)
    direction = F.when(F.col(bucket) == "informative_abstention", -F.col(order)).otherwise(F.col(order))
    w = Window.partitionBy(bucket).orderBy(direction)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota)


def holdout_target(n: int, fraction: float, least: int = 1) -> int:
    return max(least, round(n * fraction))


def grouped_split(df: DataFrame, group: str, fraction: float, seed: int, least: int = 1) -> DataFrame:
    """Adds is_validation: whole groups in the order of a seeded hash until their rows reach the target, never all groups.

    Sums run over group sizes only, one row per group, in ordered ranges of them.
    """
    total = df.count()
    target = holdout_target(total, fraction, least)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))))
    marked = running(sizes, ["__hash", group], "__n", "__before")
    if marked.limit(2).count() < 2:
        raise ValueError("a grouped split needs two groups at least")
    # The last group in order stays for training whatever the target.
    chosen = marked.select(group, ((F.col("__before") < target) & (F.col("__before") + F.col("__n") < total)).alias("is_validation"))
    return df.join(chosen, group)


def leaks(prompts: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """The prompts whose signature is among the examples'."""
    return prompts.join(examples.select(key).distinct(), key, "left_semi")


def assert_no_leaks(prompts: DataFrame, examples: DataFrame, key: str) -> None:
    n = leaks(prompts, examples, key).count()
    if n:
        raise ValueError(f"{n} held-out prompts are among the examples")


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """(identity, a, b): pairs of record windows (identity, name, first, last) of one source that overlap, by an equi-join
    on the identity and a range condition."""
    a = windows.select("identity", F.col("name").alias("a"), F.col("first").alias("a1"), F.col("last").alias("a2"))
    b = windows.select("identity", F.col("name").alias("b"), F.col("first").alias("b1"), F.col("last").alias("b2"))
    return a.join(b, "identity").filter("a < b AND a1 <= b2 AND b1 <= a2").select("identity", "a", "b")


def encode_labels(messages: Column, limit: int, ignore: str = "-100") -> Column:
    """(ids, labels) of whitespace tokens of the rendered turns, cut to limit; only answers and their end marks count."""

    def turn(m: Column) -> Column:
        tokens = F.concat(F.array(F.concat(F.lit("<|"), m["role"], F.lit("|>"))), T.split_words(T.squeeze(m["content"])), F.array(F.lit("</s>")))
        return F.transform(tokens, lambda t, i: F.struct(t.alias("id"), F.when((m["role"] == "assistant") & (i > 0), t).otherwise(ignore).alias("label")))

    all_tokens = F.slice(F.flatten(F.transform(messages, turn)), 1, limit)
    return F.struct(all_tokens["id"].alias("ids"), all_tokens["label"].alias("labels"))


def preference_problems(df: DataFrame, tiers: tuple[str, ...], negatives: tuple[str, ...], template: str = "approved_template", limit: float = 0.25) -> DataFrame:
    """One row: rows with a tier or a negative type that is not allowed, the share of templates, and whether it passes."""
    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(F.col("chosen_quality_tier"), F.lit("")).isin(*tiers)).alias("bad_tier"),
        F.count_if(~F.coalesce(F.col("negative_type"), F.lit("")).isin(*negatives)).alias("bad_negative"),
        F.count_if(F.col("chosen_quality_tier") == template).alias("templates"),
    )
    return out.withColumn("template_share", T.ratio(F.col("templates"), F.col("rows"))).withColumn("passes", (F.col("bad_tier") + F.col("bad_negative") == 0) & (F.col("template_share") <= limit))

