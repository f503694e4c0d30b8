"""Preference pairs and groups of trajectories of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import rounded
from stepweave.operators.ranking import distributed_row_number


def _ranked(trajs: DataFrame, by: str = "task_id") -> DataFrame:
    """Best first, ties by traj_id, with the size of the group. No group is ranked in one task; rows without a group are left out."""
    ranked = distributed_row_number(trajs, [by], [F.desc("reward"), F.asc("traj_id")], "rn")
    return ranked.join(ranked.groupBy(by).agg(F.max("rn").alias("n")), by)


def adjacent_pairs(trajs: DataFrame, by: str = "task_id", keep_ties: bool = False, digits: int | None = None) -> DataFrame:
    """(by, chosen, rejected, margin): each trajectory with the next lower one of its group; equal rewards only with ``keep_ties``. Groups named '' give none with ``keep_ties``."""
    ranked = distributed_row_number(trajs.select(by, "traj_id", "reward"), [by], [F.desc("reward"), F.asc("traj_id")], "rn")
    lower = ranked.select(by, (F.col("rn") - 1).alias("rn"), F.col("traj_id").alias("rejected"), F.col("reward").alias("_less"))
    out = ranked.join(lower, [by, "rn"])
    out = out.where(F.col(by) != "") if keep_ties else out.where(F.col("reward") != F.col("_less"))
    return out.select(by, F.col("traj_id").alias("chosen"), "rejected", rounded(F.col("reward") - F.col("_less"), digits or 6).alias("margin"))


# The words of a rationale.
FEWER, MORE = "chosen used fewer steps (%d vs %d)", "chosen used more steps (%d vs %d) but achieved higher quality"
SCORED, BETTER, SAME = "chosen scored %.3f vs rejected %.3f (margin=%.3f)", "chosen had better task outcome", "both had same outcome, but chosen had better process quality"


def outside_in_pairs(trajs: DataFrame, min_margin: float = 0.05) -> DataFrame:
    """Best with worst, second with second worst, and so on, from ``min_margin`` on; with a rationale by score, steps, outcome (where ``outcome`` is known) and summaries (where ``summary`` is)."""
    for name, kind in (("outcome", "double"), ("summary", "string")):
        if name not in trajs.columns:
            trajs = trajs.withColumn(name, F.lit(None).cast(kind))
    r = _ranked(trajs.select("task_id", "traj_id", "reward", "n_steps", "outcome", "summary"))
    one = F.struct("traj_id", "reward", "n_steps", "outcome", "summary")
    a = r.select("task_id", "rn", "n", one.alias("a"))
    b = r.select("task_id", (F.col("n") + 1 - F.col("rn")).alias("rn"), one.alias("b"), F.col("rn").alias("rn_b"))
    pairs = a.join(b, ["task_id", "rn"]).where("rn < rn_b").withColumn("margin", F.col("a.reward") - F.col("b.reward")).where(F.round("margin", 9) >= min_margin)
    x, y = F.col("a.n_steps"), F.col("b.n_steps")
    counts = F.when((x > 0) & (y > 0), F.when(x < y, F.format_string(FEWER, x, y)).when(x > y, F.format_string(MORE, x, y)))
    outcome = F.when(F.col("a.outcome") > F.col("b.outcome"), BETTER).when(F.col("a.outcome") == F.col("b.outcome"), SAME)
    said = [F.when(F.col(f"{c}.summary") != "", F.concat(F.lit(f"{n}: "), f"{c}.summary")) for c, n in (("a", "chosen"), ("b", "rejected"))]
    why = F.concat_ws("; ", F.format_string(SCORED, rounded(F.col("a.reward"), 3), rounded(F.col("b.reward"), 3), rounded(F.col("margin"), 3)), counts, outcome, *said)
    return pairs.select("task_id", F.col("a.traj_id").alias("chosen"), F.col("b.traj_id").alias("rejected"), F.round("margin", 6).alias("margin"), why.alias("rationale"))


def pairs_summary(pairs: DataFrame) -> DataFrame:
    """Number of pairs and tasks, and mean, least and greatest margin; zeros without pairs."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("task_id").alias("n_tasks"), zero(F.avg("margin")).alias("avg_margin"), zero(F.min("margin")).alias("min_margin"), zero(F.max("margin")).alias("max_margin"))


def query_by_task(trajs: DataFrame, low: float = 0.0, high: float = 1.0, min_per_task: int = 2, limit: int = 1000) -> DataFrame:
    """Rewards within bounds, by task and reward, the first ``limit``, and of these the tasks that still have enough."""
    kept = trajs.where((F.col("reward") >= low) & (F.col("reward") <= high) & (F.col("task_id") != "")).orderBy("task_id", F.desc("reward"), "traj_id").limit(limit)
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("task_id"))).where(F.col("_n") >= min_per_task).drop("_n")


def judged_candidates(trajs: DataFrame, batch: int = 10, low: float = 0.3, high: float = 0.7, min_per_task: int = 2) -> DataFrame:
    """The first ``batch`` adjacent pairs, ties included, of the middling trajectories of tasks that have enough of them."""
    pairs = adjacent_pairs(query_by_task(trajs, low, high, min_per_task), keep_ties=True, digits=4)
    return pairs.orderBy("task_id", "chosen").limit(batch)


def judge_requests(trajs: DataFrame, summaries: DataFrame, batch: int = 10, low: float = 0.3, high: float = 0.7, min_per_task: int = 2) -> DataFrame:
    """(chosen, rejected, title, description, skipped): the questions for the first ``batch`` candidate pairs, and how many candidates are left over. ``trajs`` has employee and perhaps description, ``summaries`` (traj_id, summary)."""
    kept = query_by_task(trajs, low, high, min_per_task)
    n = kept.groupBy("task_id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = adjacent_pairs(kept, keep_ties=True, digits=4).orderBy("task_id", "chosen").limit(batch)
    description = F.col("description") if "description" in trajs.columns else F.lit(None).cast("string")
    a = trajs.select(F.col("traj_id").alias("chosen"), F.coalesce("employee", F.lit("Agent")).alias("who"), F.coalesce(description, F.concat(F.lit("Task "), "task_id")).alias("asked"))
    one, two = (summaries.select(F.col("traj_id").alias(c), F.col("summary").alias(f"_{c}")) for c in ("chosen", "rejected"))
    title = F.concat(F.lit("Which answer of "), "who", F.lit(" is better? (task: "), F.substring("asked", 1, 50), F.lit(")"))
    text = F.concat(F.lit("## Task\n"), "asked", F.lit("\n\n## A\n"), F.coalesce("_chosen", F.lit("")), F.lit("\n\n## B\n"), F.coalesce("_rejected", F.lit("")))
    out = pairs.join(a, "chosen").join(one, "chosen", "left").join(two, "rejected", "left")
    made = min(batch, n)
    return out.select("chosen", "rejected", F.substring(title, 1, 200).alias("title"), F.substring(text, 1, 2000).alias("description"), F.lit(int(n - made)).alias("skipped"))


def group_records(trajs: DataFrame, texts: DataFrame, size: int | None = 8) -> DataFrame:
    """(task_id, prompt, n, rn, traj_id, response, reward): the best ``size`` (None: all) of each named task with two or more trajectories, one row each so that no group is gathered, with the prompt of the best one: its description, else the task's name."""
    r = _ranked(trajs.where("task_id <> ''")).where("n >= 2")
    if size:
        r = r.where(F.col("rn") <= size).withColumn("n", F.least(F.col("n"), F.lit(size)))
    description = F.col("description") if "description" in trajs.columns else F.lit(None).cast("string")
    prompts = r.where("rn = 1").select("task_id", F.coalesce(description, F.concat(F.lit("Solve task: "), "task_id")).alias("prompt"))
    return r.join(prompts, "task_id").join(texts.select("traj_id", F.col("text").alias("response")), "traj_id", "left").select("task_id", "prompt", "n", "rn", "traj_id", F.coalesce("response", F.lit("")).alias("response"), "reward")


def benchmark(trajs: DataFrame) -> DataFrame:
    """(task_id, description, repo, base_commit, test_command, difficulty, runs, low, high) of all tasks, also unnamed ones: texts of the first run, where it has them, and the list of (agent_model, reward, success, total_steps) of all runs by traj_id."""
    for name in ("description", "repo", "base_commit", "test_command"):
        if name not in trajs.columns:
            trajs = trajs.withColumn(name, F.lit(""))
    if "difficulty" not in trajs.columns:
        trajs = trajs.withColumn("difficulty", F.lit("unknown"))
    first = F.min_by(F.struct("description", "repo", "base_commit", "test_command", "difficulty"), "traj_id")
    run = F.struct("traj_id", "agent_model", "reward", (F.col("success") == 1).alias("success"), F.col("n_steps").alias("total_steps"))
    g = trajs.groupBy("task_id").agg(first.alias("f"), F.array_sort(F.collect_list(run)).alias("r"), F.round(F.min("reward"), 2).alias("low"), F.round(F.max("reward"), 2).alias("high"))
    return g.select("task_id", "f.*", F.transform("r", lambda x: x.dropFields("traj_id")).alias("runs"), "low", "high")


def remaining(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a completed row."""
    return tasks.join(done, "task_id", "left_anti")


def tool_difference(steps: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b, shared, n_a, n_b) of the tools of two trajectories."""
    sets = steps.where(F.col("traj_id").isin(a, b)).groupBy().agg(*(F.collect_set(F.when(F.col("traj_id") == t, F.col("tool"))).alias(n) for t, n in ((a, "x"), (b, "y"))), *(F.count_if(F.col("traj_id") == t).alias(n) for t, n in ((a, "n_a"), (b, "n_b"))))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select(joined(F.array_except("x", "y")).alias("only_a"), joined(F.array_except("y", "x")).alias("only_b"), joined(F.array_intersect("x", "y")).alias("shared"), "n_a", "n_b")


def replay(steps: DataFrame) -> DataFrame:
    """(traj_id, compared, first_divergence, success): trimmed outputs against expected ones that aren't null; needs expected, output, exit_code."""
    differs = F.col("expected").isNotNull() & (F.trim("expected") != F.trim("output"))
    out = steps.groupBy("traj_id").agg(F.count("expected").alias("compared"), F.min(F.when(differs, F.col("ord"))).alias("_d"), F.min(F.col("exit_code") == 0).alias("_ok"))
    return out.select("traj_id", "compared", F.coalesce("_d", F.lit(-1)).alias("first_divergence"), (F.col("_d").isNull() & F.col("_ok")).alias("success"))


def agreed_judgments(judgments: DataFrame) -> DataFrame:
    """Judgments by a majority of two responses or more."""
    return judgments.where((F.col("consensus") == "majority") & (F.col("responses") >= 2))
