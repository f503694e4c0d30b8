"""Evaluation of agents: summaries, intervals, tests, calibration, advantages."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.ranking import distributed_row_number, distributed_running_sum
from stepweave.runtime import cut

# Bounds of |t| or |z| for the words given as p.
_BANDS = ((3.5, "p<0.001"), (2.5, "p<0.01"), (2.0, "p<0.05"), (1.5, "p<0.15"))


def t_factor(n: Column, confidence: float = 0.95) -> Column:
    """The table of t by sample size."""
    if confidence >= 0.99:
        return F.when(n >= 30, 2.576).otherwise(3.50)
    return F.when(n >= 30, 1.96).when(n >= 15, 2.13).when(n >= 10, 2.26).when(n >= 5, 2.78).otherwise(4.30)


def p_words(x: Column) -> Column:
    out = None
    for bound, word in _BANDS:
        out = F.when(F.abs(x) > bound, word) if out is None else out.when(F.abs(x) > bound, word)
    return out.otherwise("p>0.15")


def summaries(rows: DataFrame, by: str, value: str = "reward", success: str = "success", confidence: float = 0.95) -> DataFrame:
    """By group: n, mean, sample deviation (0 for one), extremes, four bins, t interval, success rate with Wilson interval at z = 1.96."""
    v, n = F.col(value), F.col("n")
    g = rows.groupBy(by).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(F.col(success).cast("double")).alias("p"),
        *(F.count_if((v >= a) & (v < b)).alias(f"bin{i}") for i, (a, b) in enumerate(((-9e9, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 9e9)))),
    )
    half = F.when(n < 2, 0.0).otherwise(t_factor(n, confidence) * F.col("s") / F.sqrt("n"))
    z = 1.96
    base, centre = 1 + z * z / n, F.col("p") + z * z / (2 * n)
    wide = z * F.sqrt((F.col("p") * (1 - F.col("p")) + z * z / (4 * n)) / n)
    r = lambda c, name: F.round(c, 4).alias(name)
    return g.where("n > 0").select(by, "n", r(F.col("m"), "mean"), r(F.col("s"), "std"), r(F.col("lo"), "min"), r(F.col("hi"), "max"), "bin0", "bin1", "bin2", "bin3", r(F.col("m") - half, "ci_low"), r(F.col("m") + half, "ci_high"), r(F.col("p"), "success_rate"), r((centre - wide) / base, "wilson_low"), r((centre + wide) / base, "wilson_high"))


def leaderboard(rows: DataFrame, by: str = "agent_model") -> DataFrame:
    """(by, n, avg_reward, success_share, place), best first; ties by name."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("avg_reward"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_share"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("avg_reward"), by)))  # one row a group


def _moments(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))


def _welch(a: str, b: str) -> tuple[Column, Column, Column]:
    se = F.sqrt(F.col(f"{a}.v") / F.col(f"{a}.n") + F.col(f"{b}.v") / F.col(f"{b}.n"))
    diff = F.col(f"{a}.m") - F.col(f"{b}.m")
    effect = F.coalesce(F.try_divide(diff, F.sqrt((F.col(f"{a}.v") + F.col(f"{b}.v")) / 2)), F.lit(0.0))
    few = (F.col(f"{a}.n") < 2) | (F.col(f"{b}.n") < 2)
    t = F.when(few | (se < 1e-10), 0.0).otherwise(F.try_divide(diff, se))
    words = F.when(few, "insufficient_data").when(se < 1e-10, "identical").otherwise(p_words(t))
    return F.round(t, 4), F.when(few | (se < 1e-10), 0.0).otherwise(F.round(effect, 4)), words


def pairwise_welch(rows: DataFrame, by: str = "agent_model", value: str = "reward", alpha: float = 0.05) -> DataFrame:
    """(a, b, t, effect, p, significant, significant_corrected) for all pairs of groups, from their moments; Bonferroni compares the words' bounds strictly with alpha / pairs."""
    m = _moments(rows, by, value)
    pairs = m.alias("a").join(m.alias("b"), F.col(f"a.{by}") < F.col(f"b.{by}"))
    t, effect, words = _welch("a", "b")
    out = pairs.select(F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b"), t.alias("t"), effect.alias("effect"), words.alias("p"))
    out = out.withColumn("significant", F.abs("t") > 2.0)
    bound = F.when(F.col("p") == "p<0.001", 0.001).when(F.col("p") == "p<0.01", 0.01).when(F.col("p") == "p<0.05", 0.05).when(F.col("p") == "p<0.15", 0.15).otherwise(1.0)
    return out.withColumn("significant_corrected", bound < F.lit(alpha) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, t, effect, df, p) of the differences of two columns."""
    d = F.col(a) - F.col(b)
    g = rows.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    flat = (F.col("n") < 2) | (F.col("s") < 1e-10)
    t = F.when(flat, 0.0).otherwise(F.try_divide("m", F.col("s") / F.sqrt("n")))
    words = F.when(F.col("n") < 2, "insufficient_data").when(F.col("s") < 1e-10, "identical").otherwise(p_words(t))
    return g.select("n", F.round(t, 4).alias("t"), F.when(flat, 0.0).otherwise(F.round(F.try_divide("m", "s"), 4)).alias("effect"), (F.col("n") - 1).alias("df"), words.alias("p"))


def mann_whitney(rows: DataFrame, value: str, is_a: Column) -> DataFrame:
    """(u, z, effect, p) with average ranks and without a correction for ties. Values are ranked by their counts, so equal values are one row."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb"))
    counts = distributed_running_sum(counts.withColumn("both", F.col("na") + F.col("nb")), [F.asc("v")], "both", "below")
    rank = F.col("below") + (F.col("both") + 1) / 2
    s = counts.withColumn("rank", rank).agg(F.sum(F.col("rank") * F.col("na")).alias("ra"), F.sum("na").cast("double").alias("n1"), F.sum("nb").cast("double").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    ua = F.col("ra") - n1 * (n1 + 1) / 2
    u = F.least(ua, n1 * n2 - ua)
    z = F.try_divide(u - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    return s.select(F.round(u, 4).alias("u"), F.round(z, 4).alias("z"), F.round(1 - F.try_divide(2 * u, n1 * n2), 4).alias("effect"), p_words(z).alias("p"))


def _pearson(x: Column, y: Column) -> Column:
    """Pearson's r from co-moments that are updated row by row, so that nothing cancels in large tables; 0 where a deviation is 0."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def calibration(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman, mae, max_error, min_error): average ranks for ties, all rounded to 4. Ranks come from running sums of the counts of distinct values; rows with a null are left out, and fewer than two are an error."""
    ranked = rows = cut(rows.select(x, y).dropna())
    if len(rows.take(2)) < 2:
        raise ValueError("at least two rows with both scores are needed")
    for c in (x, y):
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        counts = distributed_running_sum(counts, [F.asc(c)], "_n", "_below")
        ranked = ranked.join(counts.select(c, (F.col("_below") + (F.col("_n") + 1) / 2).alias(f"_r_{c}")), c)
    error = F.abs(F.col(x) - F.col(y))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(_pearson(F.col(x), F.col(y)), 4).alias("pearson"), F.round(_pearson(F.col(f"_r_{x}"), F.col(f"_r_{y}")), 4).alias("spearman"), F.round(F.avg(error), 4).alias("mae"), F.round(F.max(error), 4).alias("max_error"), F.round(F.min(error), 4).alias("min_error"))


def _rising(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> int:
    """Pairs of rows that rise in ``first`` and in ``second``, each row standing for ``n``; ``second`` is unique. Bit by bit of the rank of ``second``."""
    order = np.lexsort((-second, first))
    v, n, total = np.argsort(np.argsort(second))[order], n[order], 0
    for b in range(len(v).bit_length()):
        o = np.argsort(v >> (b + 1), kind="stable")
        group, upper, w = v[o] >> (b + 1), (v[o] >> b) & 1, n[o]
        lower = np.concatenate(([0], np.cumsum(np.where(upper == 0, w, 0))))
        total += int((upper * w * (lower[1:] - lower[np.searchsorted(group, group)])).sum())
    return total


def pairwise_agreement(rows: DataFrame, x: str, y: str, block: int = 65_536) -> DataFrame:
    """(pairs, agreement): share of pairs that both columns order alike or both tie, on the values as they are; rows with a null are left out.

    Distinct pairs of values get their places by (x, y falling) and by (y, x falling): a pair rises in both columns just when it rises in both places. Places are cut into blocks of ``block``; pairs in different blocks of both are counted by sums over the grid of blocks, the others inside blocks, so no task holds more than a block.
    """
    spark = rows.sparkSession
    cells = rows.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1).alias("one")).dropna().groupBy("one", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    placed = distributed_row_number(cells, ["one"], [F.asc("x"), F.desc("y")], "r")
    placed = distributed_row_number(placed, ["one"], [F.asc("y"), F.desc("x")], "s")
    placed = cut(placed.select("n", "r", "s", F.expr(f"(r - 1) div {block}").alias("br"), F.expr(f"(s - 1) div {block}").alias("bs")))

    def inside(first: str):
        return lambda g: pd.DataFrame({"c": [_rising(g[first].to_numpy(), g["s"].to_numpy(), g["n"].to_numpy())]})

    k = placed.count() // block + 1
    grid = spark.range(k * k).select(F.expr(f"id div {k}").alias("br"), (F.col("id") % k).alias("bs"))
    grid = grid.join(placed.groupBy("br", "bs").agg(F.sum("n").alias("n")), ["br", "bs"], "left").fillna(0, ["n"])
    grid = grid.withColumn("left", F.sum("n").over(Window.partitionBy("bs").orderBy("br").rowsBetween(Window.unboundedPreceding, -1)))
    grid = grid.withColumn("before", F.sum("left").over(Window.partitionBy("br").orderBy("bs").rowsBetween(Window.unboundedPreceding, -1)))
    found = grid.select((F.col("n") * F.coalesce("before", F.lit(0))).alias("c"))
    found = found.unionByName(placed.groupBy("bs").applyInPandas(inside("br"), "c bigint")).unionByName(placed.groupBy("br").applyInPandas(inside("r"), "c bigint"))
    sums = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum(F.expr("n * (n - 1) div 2")).alias("t"))
    total = F.expr("rows * (rows - 1) div 2")
    return sums.withColumn("c", found.agg(F.sum("c")).scalar()).select(total.alias("pairs"), F.round(F.try_divide(F.col("c") + F.col("t"), total), 4).alias("agreement"))


def group_advantages(rows: DataFrame, by: str = "task_id", value: str = "reward") -> DataFrame:
    """Adds ``advantage``: (value - mean) / (sample deviation + 1e-8) within groups of two or more."""
    w = Window.partitionBy(by)
    out = rows.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2")
    return out.withColumn("advantage", F.round((F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-8), 4)).drop("_n")


def step_advantages(steps: DataFrame, value: str = "step_total") -> DataFrame:
    """Adds ``step_weight``: the step's value over its trajectory's mean; 1 where the mean is nearly 0."""
    mean = F.avg(value).over(Window.partitionBy("traj_id"))
    return steps.withColumn("step_weight", F.round(F.when(F.abs(mean) < 1e-8, 1.0).otherwise(F.try_divide(F.col(value), mean + 1e-8)), 4))


def bootstrap_interval(rows: DataFrame, by: str, value: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42, statistic=None) -> DataFrame:
    """(by, low, high) by percentiles of a statistic (default: mean) of seeded resamples of each group."""
    stat = statistic or (lambda x: sum(x) / len(x))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rng, data = random.Random(seed), group[value].dropna().sort_values().tolist()
        if not data:
            return pd.DataFrame({by: group[by].iloc[:1], "low": [None], "high": [None]})
        found = sorted(stat([data[rng.randrange(len(data))] for _ in data]) for _ in range(resamples))
        return pd.DataFrame({by: group[by].iloc[:1], "low": [found[int(resamples * alpha / 2)]], "high": [found[min(resamples - 1, int(resamples * (1 - alpha / 2)))]]})

    return rows.select(by, value).groupBy(by).applyInPandas(run, f"{by} string, low double, high double")


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta x ((chosen - ref_chosen) - (rejected - ref_rejected))) of given log-probabilities."""
    return F.log1p(F.exp(-beta * ((chosen - ref_chosen) - (rejected - ref_rejected))))


def grpo_loss(rows: DataFrame, clip: float = 0.2, kl_coef: float = 0.01) -> DataFrame:
    """(loss, policy_loss, kl, ratio_mean, ratio_std, advantage_mean) of rows with log_prob, old_log_prob and advantage: the clipped objective plus ``kl_coef`` times the mean fall of the log-probability."""
    ratio = F.exp(F.col("log_prob") - F.col("old_log_prob"))
    held = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    gain = F.least(ratio * F.col("advantage"), held * F.col("advantage"))
    g = rows.agg((-F.avg(gain)).alias("policy_loss"), F.avg(F.col("old_log_prob") - F.col("log_prob")).alias("kl"), F.avg(ratio).alias("ratio_mean"), F.stddev_samp(ratio).alias("ratio_std"), F.avg("advantage").alias("advantage_mean"))
    return g.select((F.col("policy_loss") + kl_coef * F.col("kl")).alias("loss"), "*")


def weighted_cross_entropy(tokens: DataFrame) -> DataFrame:
    """(loss): of token rows with label, log_prob and weight (null: 1), the mean of weight times the negative log-probability over the tokens whose label isn't -100; 0 without such tokens. The log-probabilities are those of the label at its own place, so the shift by one is the caller's."""
    counts = F.col("label") != -100
    total = F.sum(F.when(counts, -F.col("log_prob") * F.coalesce("weight", F.lit(1.0))).otherwise(0.0))
    return tokens.agg(F.coalesce(F.try_divide(total, F.count_if(counts)), F.lit(0.0)).alias("loss"))


def sequence_log_probs(tokens: DataFrame, by: str = "traj_id") -> DataFrame:
    """(by, log_prob): sums over the tokens whose label isn't -100; the first token of a sequence, which nothing predicts, doesn't count."""
    counts = (F.col("label") != -100) & (F.col("pos") > 0)
    return tokens.groupBy(by).agg(F.sum(F.when(counts, F.col("log_prob")).otherwise(0.0)).alias("log_prob"))


def episode_summary(rows: DataFrame) -> DataFrame:
    """One row of an agent's evaluation: episodes, success rate with its Wilson interval, mean, deviation, interval and extremes of rewards, mean, deviation and interval of steps, and the four bins."""
    one = rows.withColumn("_all", F.lit("all"))
    reward = summaries(one, "_all")
    steps = summaries(one.withColumn("n_steps", F.col("n_steps").cast("double")), "_all", "n_steps").select("_all", F.col("mean").alias("avg_steps"), F.col("std").alias("std_steps"), F.col("ci_low").alias("steps_low"), F.col("ci_high").alias("steps_high"))
    return reward.join(steps, "_all").drop("_all")


def compare_agents(rows: DataFrame, by: str = "agent_model") -> DataFrame:
    """The leaderboard with, for each agent, the number of other agents that it differs from significantly, before and after the correction for many pairs (which is only made beyond two agents)."""
    board, pairs = leaderboard(rows, by), pairwise_welch(rows, by)
    each = pairs.select(F.explode(F.array("a", "b")).alias(by), "significant", "significant_corrected")
    n = each.groupBy(by).agg(F.count_if("significant").alias("differs"), F.count_if("significant_corrected").alias("differs_corrected"))
    return board.join(n, by, "left").fillna(0, ["differs", "differs_corrected"])


def welch(rows: DataFrame, value: str, is_a: Column) -> DataFrame:
    """(t, effect, p, significant) of two samples told apart by ``is_a``."""
    m = _moments(rows.withColumn("_a", F.when(is_a, "a").otherwise("b")), "_a", value)
    t, effect, words = _welch("a", "b")
    return m.where("_a = 'a'").alias("a").join(m.where("_a = 'b'").alias("b")).select(t.alias("t"), effect.alias("effect"), words.alias("p"), (F.abs(t) > 2.0).alias("significant"))


def perplexity(rows: DataFrame) -> DataFrame:
    """(perplexity, accuracy) of rows with nll, n_tokens and n_right."""
    return rows.agg(F.exp(F.sum("nll") / F.sum("n_tokens")).alias("perplexity"), (F.sum("n_right") / F.sum("n_tokens")).alias("accuracy"))
