"""Sinks: saved trajectories, checkpoints, data cards, reports, payloads. What is written goes through Spark to any file system of the cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.text import rounded
from stepweave.operators import statistics, store
from stepweave.sources.files import write_lines

#: Reward from which a trajectory is of high quality.
HIGH = 0.7


def save_trajectories(trajs: DataFrame, steps_json: Column, path: str, append: bool = False) -> DataFrame:
    """Writes JSON lines with a content hash filled in where it is missing or empty, and returns the rows."""
    known = F.col("content_hash") if "content_hash" in trajs.columns else F.lit(None).cast("string")
    out = trajs.withColumn("content_hash", F.coalesce(F.when(known != "", known), store.content_hash(steps_json), F.lit("")))
    write_lines(out, path, append)
    return out


def save_checkpoint(done: DataFrame, trajs: DataFrame, path: str) -> None:
    """Counts, finished tasks and trajectories below ``path``; each part is replaced as a whole."""
    trajs.agg(F.count(F.lit(1)).alias("trajectories")).withColumn("done", done.agg(F.count(F.lit(1))).scalar()).write.mode("overwrite").json(f"{path}/counts")
    done.select("task_id").distinct().write.mode("overwrite").parquet(f"{path}/done")
    trajs.write.mode("overwrite").parquet(f"{path}/trajectories")


def resume(spark: SparkSession, tasks: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(the tasks that a checkpoint hasn't, its trajectories)."""
    return tasks.join(spark.read.parquet(f"{path}/done"), "task_id", "left_anti"), spark.read.parquet(f"{path}/trajectories")


def datacard(trajs: DataFrame) -> DataFrame:
    """(card): the data card in Markdown, one row. Without trajectories the shares are 0."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    g = trajs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success") == 1).alias("ok"), F.coalesce(F.avg("reward"), F.lit(0.0)).alias("reward"), F.coalesce(F.avg("n_steps"), F.lit(0.0)).alias("steps"), names("agent_model").alias("models"), names("agent_framework").alias("frameworks"))
    line = lambda label, c: F.concat(F.lit(f"| {label} | "), c, F.lit(" |"))
    rows = (
        line("Total trajectories", F.col("n").cast("string")),
        line("Successful", F.col("ok").cast("string")),
        line("Success rate", F.format_string("%.1f%%", rounded(F.coalesce(F.try_divide(F.col("ok") * 100.0, F.col("n")), F.lit(0.0)), 1))),
        line("Average reward", F.format_string("%.3f", rounded(F.col("reward"), 3))),
        line("Average steps", F.format_string("%.1f", rounded(F.col("steps"), 1))),
        line("Agent models", F.col("models")),
        line("Agent frameworks", F.col("frameworks")),
    )
    return g.select(F.concat_ws("\n", F.lit("# Agent trajectories"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|"), *rows).alias("card"))


def _percent(c: str) -> Column:
    return F.format_string("%.1f%%", rounded(F.col(c) * 100, 1))


def evaluation_report(episodes: DataFrame) -> DataFrame:
    """(report): an agent's evaluation in Markdown, one row."""
    s = statistics.episode_summary(episodes)
    bins = [F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" | "), F.format_string("%.1f%%", rounded(F.col(c) * 100 / F.col("n"), 1)), F.lit(" |")) for label, c in (("0.00-0.25", "bin0"), ("0.25-0.50", "bin1"), ("0.50-0.75", "bin2"), ("0.75-1.00", "bin3"))]
    lines = (
        F.lit("# Evaluation"),
        F.concat(F.lit("- success rate "), _percent("success_rate"), F.lit(" (95% CI "), _percent("wilson_low"), F.lit(" - "), _percent("wilson_high"), F.lit(")")),
        F.format_string("- reward %.3f +- %.3f (95%% CI %.3f - %.3f)", *(rounded(F.col(c), 3) for c in ("mean", "std", "ci_low", "ci_high"))),
        F.format_string("- rewards [%.3f, %.3f]", rounded(F.col("min"), 3), rounded(F.col("max"), 3)),
        F.format_string("- steps %.1f +- %.1f", rounded(F.col("avg_steps"), 1), rounded(F.col("std_steps"), 1)),
        F.concat(F.lit("- episodes "), F.col("n").cast("string")),
        F.lit("| rewards | episodes | share |"),
        *bins,
    )
    return s.select(F.concat_ws("\n", *lines).alias("report"))


def comparison_report(episodes: DataFrame, by: str = "agent_model") -> DataFrame:
    """(place, line): the comparison of agents as the lines of a Markdown table, best first: place, agent, success rate, reward, and the number of agents it differs from before and after the correction."""
    c = statistics.compare_agents(episodes, by)
    text = F.concat(F.lit("| "), F.col("place").cast("string"), F.lit(" | "), F.col(by), F.lit(" | "), _percent("success_share"), F.lit(" | "), F.format_string("%.3f", rounded(F.col("avg_reward"), 3)), F.lit(" | "), F.col("differs").cast("string"), F.lit(" | "), F.col("differs_corrected").cast("string"), F.lit(" |"))
    return c.select("place", text.alias("line"))


def save_report(report: DataFrame, path: str) -> None:
    """A report as text (.md) or its columns as JSON (.json); any other ending is an error. Columns named episodes are left out of the JSON."""
    if path.endswith(".json"):
        write_lines(report.drop("episodes").coalesce(1), path)
    elif path.endswith(".md"):
        one = report.columns[-1]
        (report.orderBy("place") if "place" in report.columns else report).select(one).coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"a report is written as .md or .json, not {path}")


def export_folder(trajs: DataFrame, sft: DataFrame, dpo: DataFrame | None, benchmark: DataFrame, path: str, upload: Callable[[str], None] | None = None) -> None:
    """A folder with the data card, the SFT set, the pairs if there are any, and the benchmark; ``upload`` gets the folder's path."""
    datacard(trajs).coalesce(1).write.mode("overwrite").text(f"{path}/README")
    write_lines(sft, f"{path}/sft")
    if dpo is not None and not dpo.isEmpty():
        write_lines(dpo, f"{path}/dpo")
    write_lines(benchmark, f"{path}/benchmark")
    if upload:
        upload(path)


def append_batch(path: str, texts: Callable[[DataFrame], DataFrame]):
    """For ``foreachBatch``: appends each batch's trajectories, those of high quality, and a line of its numbers, each below its own folder of the batch, which a batch run again replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = texts(batch)
        write_lines(rows, f"{path}/trajectories/batch={batch_id}")
        write_lines(high_quality(rows), f"{path}/high_quality/batch={batch_id}")
        write_lines(daily_numbers(rows), f"{path}/numbers/batch={batch_id}")

    return write


def high_quality(rows: DataFrame, least: float = HIGH) -> DataFrame:
    return rows.where(F.col("reward") >= least)


def daily_numbers(rows: DataFrame) -> DataFrame:
    """(n, succeeded, avg_reward, high): the numbers of a batch; zeros without rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success") == 1).alias("succeeded"), F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 4).alias("avg_reward"), F.count_if(F.col("reward") >= HIGH).alias("high"))


def push_payloads(trajs: DataFrame) -> DataFrame:
    """(traj_id, payload): what would be sent for each trajectory, as JSON; the sending is the caller's."""
    payload = F.to_json(F.struct("task_id", "agent_model", "employee", F.col("reward"), (F.col("success") == 1).alias("success"), F.col("n_steps").alias("total_steps")))
    return trajs.select("traj_id", payload.alias("payload"))


def push_counts(trajs: DataFrame) -> DataFrame:
    return trajs.groupBy("employee").agg(F.count(F.lit(1)).alias("n"))
