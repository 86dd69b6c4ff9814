"""Source mixing to target token shares, exact next-fit packing, token budgets and fixed windows.

Mixing and packing depend on every earlier document, so they are scans in order. Both run over a narrow table of
(source, record, tokens), about 24 bytes a document, in one task; token arrays never go through it. The closed form
and packing per shard are the ways without that task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranges import ranked, running


def concatenated(df: DataFrame, sources: Sequence[str], order: str, source: str = "source") -> DataFrame:
    """Adds place: sources one after the other as given, each in order, as they stand where no source has a weight. Places
    come from the sizes of ordered ranges."""
    number = F.lit(None).cast("int")
    for k, s in enumerate(sources):
        number = F.when(F.col(source) == s, k).otherwise(number)
    own = df.withColumn("__source_no", number).filter(F.col("__source_no").isNotNull())
    return ranked(own, ["__source_no", order], "place").drop("__source_no")


def mask_of(ids: Column, pad) -> Column:
    """1 for a token, 0 for a pad."""
    return F.transform(ids, lambda x: F.when(x == pad, 0).otherwise(1))


def closed_form_mix(df: DataFrame, shares: Mapping[str, float], order: str, tokens: str = "n_tokens", source: str = "source") -> DataFrame:
    """Adds mix_key, by which two uncapped sources stand in the order of deficit-greedy mixing: the tokens before a
    document in its source over the source's share; ties go to the larger share."""
    share = F.lit(None).cast("double")
    for k, v in shares.items():
        share = F.when(F.col(source) == k, F.lit(float(v))).otherwise(share)
    own = df.filter(F.col(source).isin(list(shares))).withColumn("share", share)
    return running(own, [order], F.col(tokens).cast("long"), "__before", [source]).withColumn("mix_key", F.col("__before") / F.col("share")).drop("__before")


def schedule(rows: pd.DataFrame, shares: Mapping[str, float], max_share: float = 1.0, budget: int = 0, repeat_cap: float = 0.0) -> pd.DataFrame:
    """Deficit-greedy order over (source, record, n_tokens, and where there is one key): the open source with the largest (target - realised,
    -realised / target, target, -tokens) gives its next document. A source over max_share waits while another one below
    it is open, once budget tokens are out. A source that ends may begin again while repeats stay within repeat_cap of
    its documents and its gap is worth an average document. A document whose key has been given out is passed over; a
    source that has begun again may repeat its own, but not those that other sources gave first."""
    total_share = sum(shares.values())
    target = {s: w / total_share for s, w in shares.items()}
    rows = rows if "key" in rows else rows.assign(key=None)
    docs = {s: list(g.sort_values("record")[["record", "n_tokens", "key"]].itertuples(index=False, name=None)) for s, g in rows.groupby("source") if s in target}
    owner: dict = {}
    at, epoch, got, repeats, kept = {s: 0 for s in docs}, {s: 0 for s in docs}, dict.fromkeys(docs, 0), dict.fromkeys(docs, 0), dict.fromkeys(docs, 0)
    out, total = [], 0

    def may_restart(s: str) -> bool:
        if not repeat_cap or not docs[s]:
            return False
        room = int((repeat_cap * kept[s] - repeats[s]) / (1 - repeat_cap)) if repeat_cap < 1 else len(docs[s])
        average = sum(d[1] for d in docs[s]) / len(docs[s])
        return min(room, len(docs[s])) >= 1 and target[s] * total - got[s] >= average

    def pass_over(s: str) -> None:
        while at[s] < len(docs[s]) and (key := docs[s][at[s]][2]) is not None and key in owner and not (epoch[s] and owner[key] == s):
            at[s] += 1

    while True:
        for s in docs:
            pass_over(s)
            if at[s] >= len(docs[s]) and may_restart(s):
                at[s], epoch[s] = 0, epoch[s] + 1
                pass_over(s)
        ready = [s for s in docs if at[s] < len(docs[s])]
        ready = [s for s in ready if not (epoch[s] and repeats[s] + 1 > repeat_cap * (kept[s] + 1))] if any(not epoch[s] for s in ready) else [s for s in ready if not epoch[s]]
        if not ready:
            return pd.DataFrame(out, columns=["mix_order", "source", "record", "epoch", "n_tokens"])
        under = [s for s in ready if not (total >= budget and total and got[s] / total > max_share and any(got[x] < got[s] for x in ready if x != s))]
        realised = lambda s: got[s] / total if total else 0.0
        s = max(under or ready, key=lambda s: (target[s] - realised(s), -realised(s) / target[s], target[s], -got[s]))
        record, n, key = docs[s][at[s]]
        owner.setdefault(key, s)
        out.append((len(out), s, record, epoch[s], n))
        at[s] += 1
        got[s] += n
        total += n
        kept[s] += 1
        repeats[s] += epoch[s] > 0


def capped_mix(df: DataFrame, shares: Mapping[str, float], order: str, tokens: str = "n_tokens", source: str = "source", key: str | None = None, **caps) -> DataFrame:
    """(mix_order, source, record, epoch, n_tokens) by schedule, in one task over the narrow table."""
    columns = [F.col(source).alias("source"), F.col(order).cast("long").alias("record"), F.col(tokens).cast("long").alias("n_tokens"), *([F.col(key).alias("key")] if key else [])]
    narrow = df.filter(F.col(source).isin(list(shares))).select(*columns)
    schema = "mix_order long, source string, record long, epoch long, n_tokens long"
    return narrow.groupBy(F.lit(1).alias("one")).applyInPandas(lambda rows: schedule(rows, shares, **caps), schema)


def budget_prefix(df: DataFrame, order: list[str], tokens: str, budget: int) -> DataFrame:
    """The rows in order up to and with the one that reaches the budget: those whose predecessors stay below it."""
    return running(df, order, tokens, "tokens_before").filter(F.col("tokens_before") < budget)


def next_fit(lengths: Iterator[tuple[object, int]], size: int) -> Iterator[tuple[int, int, object, int, int]]:
    """(window, part, key, token_start, token_end) of documents by key and length, end mark included. A document over
    size is cut into windows of its own at once; else the open window is closed when the document does not fit."""
    window, fill, parts = 0, 0, []
    for key, n in lengths:
        if n > size:
            for a in range(0, n, size):
                yield window, 0, key, a, min(n, a + size)
                window += 1
            continue
        if fill + n > size and parts:
            for p in parts:
                yield (window, *p)
            window, fill, parts = window + 1, 0, []
        parts.append((len(parts), key, 0, n))
        fill += n
    for p in parts:
        yield (window, *p)


def pack_windows(df: DataFrame, order: str, tokens: str, size: int = 512, shards: int = 1, least: int = 3) -> DataFrame:
    """(shard, window, part, record, token_start, token_end): exact next-fit over the documents in order, an end mark
    added to each; windows of fewer than least tokens are left out. One shard is one scan in global order; more shards
    pack hashed parts of the documents independently, each shard leaving one window open at its end."""
    shard = F.lit(0).cast("long") if shards == 1 else F.pmod(F.conv(F.left(F.md5(F.col(order).cast("string")), F.lit(8)), 16, 10).cast("long"), F.lit(shards))
    narrow = df.select(shard.alias("shard"), F.col(order).cast("long").alias("record"), F.col(tokens).cast("long").alias("n"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record")
        out = pd.DataFrame(next_fit(zip(rows["record"], rows["n"] + 1), size), columns=["window", "part", "record", "token_start", "token_end"])
        if len(out):
            held = (out["token_end"] - out["token_start"]).groupby(out["window"]).transform("sum")
            out = out[held >= least].copy()
        out.insert(0, "shard", key[0])
        return out

    return narrow.groupBy("shard").applyInPandas(run, "shard long, window long, part long, record long, token_start long, token_end long")


def window_rows(parts: DataFrame, docs: DataFrame, record: str, tokens: Column, end_mark: str, pad: str, size: int, source: str) -> DataFrame:
    """Rebuilds the windows: ids padded to size, their contributors and sources, from the parts and the token arrays."""
    joined = parts.join(docs.select(F.col(record).alias("record"), F.concat(tokens, F.array(F.lit(end_mark))).alias("ids"), F.col(source).alias("source")), "record")
    piece = F.struct("part", F.slice("ids", F.col("token_start") + 1, F.col("token_end") - F.col("token_start")).alias("ids"), "source", "record")
    met = joined.groupBy("shard", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    return met.select(
        "shard", "window", F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size).alias("ids"), F.array_distinct("p.source").alias("source_names"),
        F.transform("p", lambda x: F.struct(x["source"].alias("source"), x["record"].alias("document_id"))).alias("contributors"), F.size("p").alias("packed_document_count"),
    )


def fixed_windows(df: DataFrame, id_col: str, tokens: str, size: int, pad: str) -> DataFrame:
    """Consecutive windows of each document alone, the last one padded; documents without tokens give none."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    # Cut before the rows are made: a row per window with the whole array would be quadratic in long documents.
    each = df.select(id_col, F.posexplode(F.transform(starts, lambda i: F.slice(F.col(tokens), i * size + 1, size))).alias("window", "part"))
    return each.select(id_col, "window", F.concat("part", F.array_repeat(F.lit(pad), size - F.size("part"))).alias("ids"), F.size("part").alias("n_tokens"))


def labels_of(ids: Column, pad, ignore) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, ignore).otherwise(x))


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even distances of their rank, the first and the last among them."""
    total = df.count()
    wanted = sorted({round(i * (total - 1) / max(n - 1, 1)) for i in range(min(n, total))})
    return ranked(df, [order], "__rank").filter(F.col("__rank").isin(wanted)).drop("__rank")


def locate(row: Column, shard_rows: int) -> tuple[Column, Column]:
    """(shard_index, row_index) of a global row number."""
    return F.floor(row / shard_rows).cast("long"), F.pmod(row, F.lit(shard_rows)).cast("long")
