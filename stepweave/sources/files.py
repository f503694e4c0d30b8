"""Readers and writers of JSON lines, task lists and stores, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP_TYPE = "STRUCT<step_id: INT, thought: STRING, tool: STRING, params: STRING, output: STRING, exit_code: INT, action: STRING, observation: STRING, tool_call: STRUCT<name: STRING, parameters: STRING>, tool_result: STRUCT<output: STRING, exit_code: INT, error: STRING>>"
RECORDER = f"task STRUCT<task_id: STRING, description: STRING, type: STRING, language: STRING, difficulty: STRING, repo: STRING, base_commit: STRING, test_command: STRING, domain: STRING>, agent STRING, model STRING, steps ARRAY<{STEP_TYPE}>, outcome STRUCT<success: BOOLEAN, score: DOUBLE, tests_passed: INT, tests_failed: INT, total_steps: INT, total_tokens: INT>, metadata STRING"
HUB = f"content_hash STRING, task_id STRING, agent_framework STRING, agent_model STRING, steps ARRAY<{STEP_TYPE}>, total_steps INT, success BOOLEAN, reward DOUBLE, step_rewards ARRAY<DOUBLE>, duration_seconds DOUBLE, metadata STRING"
SFT = "instruction STRING, input STRING, response STRING, task_id STRING, reward DOUBLE, metadata STRUCT<agent_framework: STRING, agent_model: STRING, total_steps: INT>"
DPO = "prompt STRING, chosen STRING, rejected STRING, task_id STRING, reward_margin DOUBLE, metadata STRING"
GRPO = "task_id STRING, prompt STRING, trajectories ARRAY<STRUCT<response: STRING, reward: DOUBLE>>"
PREFERENCE = "task_id STRING, chosen STRING, rejected STRING, reward_margin DOUBLE"
TASK = "task_id STRING, description STRING, type STRING, language STRING, difficulty STRING, repo STRING, base_commit STRING, test_command STRING, metadata STRING"


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; a bad line raises where ``strict``, else it is left out. Blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_recorder(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, RECORDER, strict=True)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Hub trajectories with every missing field at its default."""
    rows = read_lines(spark, path, HUB, strict=True)
    text = {c: F.coalesce(c, F.lit("")) for c in ("content_hash", "task_id", "agent_framework", "agent_model")}
    return rows.withColumns(text | {"success": F.coalesce("success", F.lit(False)), "reward": F.coalesce("reward", F.lit(0.0)), "total_steps": F.coalesce("total_steps", F.size("steps")), "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0))})


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from JSON lines or from one JSON array, as the first character tells."""
    first = spark.read.text(path).where("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1)).first()
    return spark.read.schema(PREFERENCE).option("multiLine", first is not None and first[0] == "[").json(path)


def tasks_of(lines: DataFrame) -> DataFrame:
    """Tasks of JSON texts (value, line) with defaults: id by the line's place in the file, counted from 1 over all lines, bug_fix, python, medium; bad lines are left out."""
    rows = lines.withColumn("_line", F.row_number().over(Window.orderBy("line")))  # a task list is a small file
    rows = rows.where("trim(value) <> ''").withColumn("t", F.from_json("value", TASK)).where(F.try_parse_json("value").isNotNull())
    default = lambda c, v: F.coalesce(F.col(f"t.{c}"), v).alias(c)
    return rows.select(default("task_id", F.concat(F.lit("task_"), F.col("_line").cast("string"))), default("description", F.lit("")), default("type", F.lit("bug_fix")), default("language", F.lit("python")), default("difficulty", F.lit("medium")), default("repo", F.lit("")), default("base_commit", F.lit("")), default("test_command", F.lit("")))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a file of JSON lines; a missing file is an error."""
    return tasks_of(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def filter_tasks(tasks: DataFrame, language: str | None = None, difficulty: str | None = None, kind: str | None = None) -> DataFrame:
    """Tasks equal, without regard to case, to all that is given."""
    for name, value in (("language", language), ("difficulty", difficulty), ("type", kind)):
        if value:
            tasks = tasks.where(F.lower(name) == value.lower())
    return tasks


def write_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def user_message(message: Column, context: Column, description: Column) -> Column:
    """The first of a task's message, context and description that isn't empty, else ''."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(message), filled(context), filled(description), F.lit(""))


def task_errors(domain: Column, repo: Column, base_commit: Column) -> Column:
    """array of what a task lacks: coding needs a repository and a commit."""
    gone = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(F.when((domain == "coding") & gone(repo), "no repository"), F.when((domain == "coding") & gone(base_commit), "no base commit")))


def benchmark_tasks(rows: DataFrame) -> DataFrame:
    """Tasks of a benchmark's rows (instance_id, problem_statement, repo, base_commit, patch): fixes in Python, as difficult as their patch is long."""
    from stepweave.operators.export import difficulty_of_patch

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(blank("instance_id").alias("task_id"), blank("problem_statement").alias("description"), F.lit("bug_fix").alias("type"), F.lit("python").alias("language"), difficulty_of_patch(blank("patch")).alias("difficulty"), blank("repo").alias("repo"), blank("base_commit").alias("base_commit"))
