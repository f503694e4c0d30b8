"""Process-reward rules on steps, as windows over each trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave import dims
from stepweave.functions.text import rounded


def classify_tools(steps: DataFrame, domain: str = "coding") -> DataFrame:
    """Adds ``category``, ``is_read`` (read or search), ``is_write``, ``is_execute`` and ``stateful_key``; tools the domain doesn't know are none of them."""
    known = dims.profile(domain)
    category = F.create_map(*(F.lit(x) for n, c, _ in known for x in (n, c))) if known else F.create_map().cast("map<string,string>")
    keys = [(n, k) for n, _, k in known if k]
    key = F.create_map(*(F.lit(x) for pair in keys for x in pair)) if keys else F.create_map().cast("map<string,string>")
    out = steps.withColumn("category", F.try_element_at(category, F.col("tool"))).withColumn("stateful_key", F.try_element_at(key, F.col("tool")))
    is_ = lambda *names: F.coalesce(F.col("category").isin(*names), F.lit(False))
    return out.withColumn("is_read", is_("read", "search")).withColumn("is_write", is_("write")).withColumn("is_execute", is_("execute"))


def target_param(params: Column, stateful_key: Column) -> Column:
    """The value of the stateful key if present and not empty, else of the first of the usual keys, else ''."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(F.try_element_at(params, stateful_key)), *(filled(F.try_element_at(params, F.lit(k))) for k in dims.TARGET_KEYS), F.lit(""))


def redundancy(steps: DataFrame) -> DataFrame:
    """Adds ``r1``: 0 for a repeated or needless read, 0.3 for another exact repeat, else 1. Needs traj_id, ord, tool, params_key, target, is_read and is_write."""
    before = Window.partitionBy("traj_id", "target").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("traj_id", "tool", "params_key").orderBy("ord")
    read = F.max(F.when(F.col("is_read"), F.col("ord"))).over(before)
    write = F.max(F.when(F.col("is_write"), F.col("ord"))).over(before)
    out = steps.withColumn("_read", read).withColumn("_write", write).withColumn("_dup", F.row_number().over(same) > 1)
    named = F.col("target") != ""
    fresh = F.col("is_read") & named & F.col("_write").isNotNull() & (F.col("_read").isNull() | (F.col("_write") > F.col("_read")))
    r1 = F.when(F.col("is_read") & ~fresh & ((named & F.col("_read").isNotNull()) | F.col("_dup")), 0.0).when(F.col("_dup") & ~F.col("is_read"), 0.3).otherwise(1.0)
    return out.withColumn("r1", r1).drop("_read", "_write", "_dup")


def regression(steps: DataFrame) -> DataFrame:
    """Adds ``r2``: 0 for a write that swaps back an earlier write on its target, else 1. Needs old_s, new_s."""
    both = F.col("is_write") & (F.col("old_s") != "") & (F.col("new_s") != "")
    out = steps.withColumn("_lo", F.when(both, F.least("old_s", "new_s"))).withColumn("_hi", F.when(both, F.greatest("old_s", "new_s")))
    out = out.withColumn("_way", F.when(both, F.when(F.col("old_s") < F.col("new_s"), 1).when(F.col("old_s") > F.col("new_s"), -1).otherwise(0)))
    w = Window.partitionBy("traj_id", "target", "_lo", "_hi").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    up, down, any_ = (F.max(F.when(F.col("_way") == v, 1)).over(w) for v in (1, -1, 0))
    swapped = ((F.col("_way") == 1) & down.isNotNull()) | ((F.col("_way") == -1) & up.isNotNull()) | ((F.col("_way") == 0) & any_.isNotNull())
    return out.withColumn("r2", F.when(both & swapped, 0.0).otherwise(1.0)).drop("_lo", "_hi", "_way")


def info_tokens(output: Column) -> Column:
    """Words with a slash (stripped of marks) or that are identifiers with an underscore, longer than 3."""
    words = F.split(F.trim(F.regexp_replace(output, r"\s+", " ")), " ")
    paths = F.filter(words, lambda w: w.contains("/") & (F.length(w) > 3))
    stripped = F.transform(paths, lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}\"'`]+|[.,;:()\[\]{}\"'`]+$", ""))
    names = F.filter(words, lambda w: w.contains("_") & (F.length(w) > 3) & w.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))
    return F.array_distinct(F.concat(stripped, names))


def info_utilization(steps: DataFrame) -> DataFrame:
    """Adds ``r3``: 0.7 for a write or execute that uses none of the tokens of earlier outputs, else 1. Needs output and params_text.

    Each token keeps the step that first showed it, so the join has a row for each step and distinct earlier token of its trajectory; nothing is collected.
    """
    tokens = steps.select("traj_id", "ord", F.explode(info_tokens(F.col("output"))).alias("token")).groupBy("traj_id", "token").agg(F.min("ord").alias("_first"))
    asked = steps.where((F.col("is_write") | F.col("is_execute")) & (F.col("ord") > 0)).select("traj_id", "ord", F.lower("params_text").alias("_text"))
    seen = asked.join(tokens, "traj_id").where(F.col("_first") < F.col("ord"))
    used = seen.groupBy("traj_id", "ord").agg(F.max(F.contains("_text", F.lower("token"))).alias("_used"))
    out = steps.join(used, ["traj_id", "ord"], "left")
    return out.withColumn("r3", F.when(F.col("_used").eqNullSafe(False), 0.7).otherwise(1.0)).drop("_used")


def efficiency(actual: Column, reference: Column) -> Column:
    """min(1, reference / actual); 1 without a reference, 0 without steps."""
    return F.when(reference <= 0, 1.0).when(actual <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(reference, actual)))


def outcome_score(partial: Column, score: Column, total: Column, success: Column) -> Column:
    """Partial credit held to 0..1 if present, else score / total as it is, else the success flag."""
    held = F.when(partial.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), partial)))
    return F.coalesce(held, F.when(total > 0, F.try_divide(score, total)), F.when(success, 1.0).otherwise(0.0))


def scored_steps(steps: DataFrame, domain: str = "coding", model_score: float = 0.5) -> DataFrame:
    """Adds r1, r2, r3 and ``step_total``: the rubrics' weighted mean, the model's rubrics at ``model_score``."""
    out = info_utilization(regression(redundancy(classify_tools(steps, domain))))
    rubrics = [r for r in dims.rubric_rows() if r[0] == dims.rubric_set_of(domain)]
    value = {"non_redundancy": F.least("r1", "r2"), "info_utilization": F.col("r3")}
    total = sum((F.lit(w) * value.get(i, F.lit(model_score)) for _, i, w, _ in rubrics), F.lit(0.0)) / sum(w for _, _, w, _ in rubrics)
    return out.withColumn("step_total", total)


def trajectory_rewards(scored: DataFrame, trajectories: DataFrame, outcome: Column, reference: Column | None = None) -> DataFrame:
    """(traj_id, task_id, outcome, process, efficiency, reward): 0.4 outcome + 0.5 process + 0.1 efficiency, rounded to 6. A trajectory without steps keeps its outcome and has 0 for all else."""
    process = scored.groupBy("traj_id").agg(F.avg("step_total").alias("process"))
    joined = trajectories.join(process, "traj_id", "left").withColumn("_none", F.col("process").isNull()).withColumn("process", F.coalesce("process", F.lit(0.0)))
    eff = F.when(F.col("_none"), 0.0).otherwise(efficiency(F.col("n_steps"), reference if reference is not None else F.col("n_steps")))
    total = F.when(F.col("_none"), 0.0).otherwise(0.4 * outcome + 0.5 * F.col("process") + 0.1 * eff)
    return joined.select("traj_id", "task_id", rounded(outcome, 6).alias("outcome"), rounded(F.col("process"), 6).alias("process"), rounded(eff, 6).alias("efficiency"), rounded(total, 6).alias("reward"))


def rescored(trajs: DataFrame) -> DataFrame:
    """The stored reward, and ``computed`` where it is exactly 0: scoring again changes nothing that has a score."""
    return trajs.withColumn("reward", F.when(F.col("reward") == 0, F.col("computed")).otherwise(F.col("reward")))
