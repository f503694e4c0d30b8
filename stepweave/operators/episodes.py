"""Episode flags and sums over rows of (episode, ord, ...), as the wrappers of an environment give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave import dims


def _run(by: str = "traj_id") -> Window:
    return Window.partitionBy(by).orderBy("ord")


def truncate_after(steps: DataFrame, most: int, by: str = "traj_id") -> DataFrame:
    """Adds ``truncated``: the step count reached ``most`` and the step doesn't end the episode."""
    return steps.withColumn("truncated", (F.row_number().over(_run(by)) >= most) & ~F.col("terminated"))


def time_out(steps: DataFrame, seconds: float, by: str = "traj_id") -> DataFrame:
    """Adds ``timed_out``: ``seconds`` have passed since the episode's first step."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return steps.withColumn("timed_out", at - F.first(at).over(_run(by)) >= seconds)


def running_statistics(steps: DataFrame, value: str = "step_total", by: str = "traj_id") -> DataFrame:
    """Adds ``return_so_far`` (rounded to 4) and ``length_so_far``."""
    w = _run(by).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("return_so_far", F.round(F.sum(value).over(w), 4)).withColumn("length_so_far", F.count(F.lit(1)).over(w))


def terminal(tool: Column, domain: str) -> Column:
    return tool.isin(*dims.TERMINAL.get(domain, ("submit", "finish")))


def recorded(steps: DataFrame, by: str = "traj_id") -> DataFrame:
    """(episode, n_steps, success): success is an end that is terminated and not truncated."""
    last = F.max_by(F.struct("terminated", "truncated"), "ord")
    return steps.groupBy(by).agg(F.count(F.lit(1)).alias("n_steps"), (last["terminated"] & ~last["truncated"]).alias("success"))


def shortened(text: Column, most: int = 8000, suffix: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def early_stop(iterations: DataFrame, patience: int = 3) -> DataFrame:
    """Adds ``stop``: the first iteration at which ``patience`` iterations in a row brought no strictly better mean. Needs iteration and mean; one row an iteration."""
    w = Window.orderBy("iteration")
    best_before = F.max("mean").over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = iterations.withColumn("_better", (F.col("mean") > best_before) | best_before.isNull())
    last = better.withColumn("_last", F.max(F.when(F.col("_better"), F.col("iteration"))).over(w))
    waited = last.withColumn("_wait", F.col("iteration") - F.col("_last"))
    return waited.withColumn("stop", F.col("_wait") == patience).drop("_better", "_last", "_wait")


def flagged(steps: DataFrame, domain: str, most: int, by: str = "traj_id", always: bool = False) -> DataFrame:
    """Adds ``terminated`` (a tool that ends the domain's episodes) and ``truncated`` (the turn ``most`` is reached; where the step also ends the episode only with ``always``)."""
    end = F.coalesce(terminal(F.col("tool"), domain), F.lit(False))
    full = F.row_number().over(_run(by)) >= most
    return steps.withColumn("terminated", end).withColumn("truncated", full if always else full & ~end)


def episode_statistics(steps: DataFrame, value: str, by: str = "traj_id") -> DataFrame:
    """(episode, ret, length, elapsed): sum of rewards (rounded to 4), steps, and seconds from the first to the last step (rounded to 2)."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return steps.groupBy(by).agg(F.round(F.sum(value), 4).alias("ret"), F.count(F.lit(1)).alias("length"), F.round(F.max(at) - F.min(at), 2).alias("elapsed"))


def recorded_steps(steps: DataFrame, by: str = "traj_id") -> DataFrame:
    """(episode, steps, success): the actions in order as one text, and whether the last step terminated and wasn't truncated."""
    last = F.max_by(F.struct("terminated", "truncated"), "ord")
    listed = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "tool", "target").alias("a"))))
    g = steps.groupBy(by).agg(listed.alias("_s"), (last["terminated"] & ~last["truncated"]).alias("success"))
    return g.select(by, F.array_join(F.transform("_s", lambda s: s["a"]), " ").alias("steps"), "success")


def iteration_statistics(trajs: DataFrame, iteration: str) -> DataFrame:
    """(iteration, n, success_rate, avg_return, min_return, max_return, avg_steps)."""
    r = lambda c, name: F.round(c, 4).alias(name)
    return trajs.groupBy(iteration).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("success").cast("double")), "success_rate"), r(F.avg("ret"), "avg_return"), r(F.min("ret"), "min_return"), r(F.max("ret"), "max_return"), r(F.avg("n_steps"), "avg_steps"))


def worker_shares(n_tasks: int, workers: int) -> list[int]:
    """How many tasks each worker gets: n // workers, and one more for the first of them."""
    each, more = divmod(n_tasks, workers)
    return [each + (w < more) for w in range(workers)]


def shares(tasks: DataFrame, workers: int) -> DataFrame:
    """(worker, n): the same as rows."""
    total = tasks.agg(F.count(F.lit(1))).scalar()
    w = tasks.sparkSession.range(workers).select(F.col("id").alias("worker"))
    return w.select("worker", (F.floor(total / workers) + (F.col("worker") < total % workers).cast("int")).cast("bigint").alias("n"))
