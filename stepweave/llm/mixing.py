"""Mixing sources to target weights by apportioned blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.tokens import TOKENIZER, token_sizes
from stepweave.operators.ranking import distributed_row_number
from stepweave.runtime import cut

#: Tokens of a block at most, and blocks of a mixture at least: a small mixture has smaller blocks, down to one token.
BLOCK, LEAST_BLOCKS = 256, 16_384
#: Documents of a shard, about.
SHARD = 4096
SEED = 20


def sainte_lague(groups: DataFrame, part: str, key: str, votes: str, seats: str) -> DataFrame:
    """(part, key, quota): the ``seats`` of each part among its groups by the highest quotients votes / (2 k + 1).

    Each group surely has floor(votes / d + 1/2) seats for a divisor d at which the part can't run out of seats; for the others only the next quotients, about four a group, are ranked. Groups without votes get none; equal quotients go by key.
    """
    whole = Window.partitionBy(part)
    g = groups.where(F.col(votes) > 0).withColumn("__v", F.sum(votes).over(whole)).withColumn("__n", F.count(F.lit(1)).over(whole))
    share = F.greatest(F.col(seats) - F.col("__n") / 2, F.lit(0))
    g = g.withColumn("__sure", F.floor(F.when(share > 0, F.col(votes) * share / F.col("__v") + 0.5).otherwise(F.lit(0.0))))
    g = cut(g)
    left = g.groupBy(part).agg((F.max(seats) - F.sum("__sure")).alias("__left"))
    upper = F.ceil(F.col("__n") * F.col(votes) / F.col("__v")) + 2
    upper = F.least(upper + F.when(F.col("__sure") == 0, F.ceil(F.col(votes) * F.col(seats) / F.col("__v"))).otherwise(0), F.col(seats) + 1)
    open_seats = g.where(upper > 0).select(part, key, F.explode(F.sequence(F.col("__sure"), F.col("__sure") + upper - 1)).alias("__k"), F.col(votes).alias("__votes"))
    open_seats = open_seats.withColumn("__q", F.col("__votes") / (2 * F.col("__k") + 1)).select(part, key, "__k", "__q")
    ranked = distributed_row_number(open_seats, [part], [F.desc("__q"), F.asc(key), F.asc("__k")], "__rank")
    more = ranked.join(left, part).where(F.col("__rank") <= F.col("__left")).groupBy(part, key).agg(F.count(F.lit(1)).alias("__more"))
    return g.join(more, [part, key], "left").select(part, key, (F.col("__sure") + F.coalesce("__more", F.lit(0))).cast("bigint").alias("quota"))


def source_name(value: Column) -> Column:
    """A source without case and surrounding blanks."""
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def _goal(targets: DataFrame) -> DataFrame:
    """(source, share, repeats) of the targets that count."""
    return targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each text of a target source is used; texts not used have 0.

    The mixture is the largest in which every target source that has tokens gives its share (shares of sources without any are spread over the others) and no text is used more than its source's ``max_repeats`` times. Its blocks of equal size (BLOCK tokens, fewer where the mixture has not LEAST_BLOCKS of them) go to the sources, and those of a source to its hashed shards, by Sainte-Laguë quotients; a shard runs through all its texts as often as its quota holds, and once more through those that still fit, in an order by seed and hash: what a shard gives falls short of its quota by less than its shortest unused text.

    Sources lose case and surrounding blanks; null sources and texts are left out, as are targets with a null, a share or repeats not above 0; of targets with one name the greater share counts; rows repeated under one doc_id are one text; empty texts and empty tables give uses 0 or no row; other columns are not read. A source of any size is split into shards of about SHARD texts.
    """
    goal = _goal(targets)
    sized = token_sizes(documents.where("source IS NOT NULL"), tokenizer, "source").withColumn("source", source_name(F.col("source")))
    docs = cut(sized.join(goal, "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    sources = docs.groupBy("source").agg(F.sum("tokens").alias("v"), F.count(F.lit(1)).alias("n_docs"), F.max("share").alias("share"), F.max("repeats").alias("repeats")).where("v > 0")
    sources = sources.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(0))))  # one row for each target source
    most = F.min(F.col("repeats") * F.col("v") / F.col("share")).over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("most", most).withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("most") / LEAST_BLOCKS))))
    sources = cut(sources.withColumn("part", F.lit(0)).withColumn("seats", F.floor(F.col("most") / F.col("block"))).withColumn("weight", F.col("share").cast("double")))
    quotas = sainte_lague(sources.select("part", "source", "weight", "seats"), "part", "source", "weight", "seats").select("source", F.col("quota").alias("seats"))
    shards = F.greatest(F.ceil(F.col("n_docs") / SHARD), F.lit(1))
    sharded = docs.join(sources.select("source", "n_docs", "block").join(quotas, "source"), "source").withColumn("shard", F.pmod("h", shards))
    sharded = cut(sharded.select("doc_id", "source", "tokens", "repeats", "h", "shard", "seats", "block"))
    by_shard = sharded.groupBy("source", "shard").agg(F.sum("tokens").cast("double").alias("v"), F.max("seats").alias("seats"))
    shard_quota = sainte_lague(by_shard, "source", "shard", "v", "seats")
    planned = sharded.join(shard_quota, ["source", "shard"], "left").withColumn("room", F.coalesce("quota", F.lit(0)) * F.col("block"))
    return planned.select("doc_id", "source", "shard", "tokens", "repeats", "h", "room").groupBy("source", "shard").applyInPandas(_uses, "doc_id bigint, source string, tokens bigint, uses int")


def _uses(shard: pd.DataFrame) -> pd.DataFrame:
    """Whole passes through the shard, then its texts by hash as long as each still fits."""
    shard = shard.sort_values(["h", "doc_id"], kind="stable")
    tokens, room, repeats = shard["tokens"].to_numpy(np.int64), int(shard["room"].iloc[0]), int(shard["repeats"].iloc[0])
    total = int(tokens.sum())
    passes = min(room // total, repeats) if total else 0
    uses, room = np.where(tokens > 0, passes, 0), room - passes * total
    if passes < repeats:
        for i, n in enumerate(tokens):
            if 0 < n <= room:
                uses[i] += 1
                room -= n
    return shard[["doc_id", "source", "tokens"]].assign(uses=uses)


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, texts, tokens_used, share): what each target source gives; one without documents gives 0."""
    used = mixed.groupBy("source").agg(F.count_if(F.col("uses") > 0).alias("texts"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"))
    goal = _goal(targets).select("source", F.col("share").alias("target_share"))
    all_used = used.agg(F.sum("tokens_used")).scalar()
    return goal.join(used, "source", "left").select("source", "target_share", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.round(F.coalesce(F.try_divide(F.col("tokens_used"), all_used), F.lit(0.0)), 6).alias("share"))
