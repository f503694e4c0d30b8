"""Whole flows: raw logs to scored trajectories, stored, paired and exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import pairs, rules, store
from stepweave.sources import files, logs


def prepared_steps(steps: DataFrame) -> DataFrame:
    """Steps (traj_id, ord, tool, params as JSON, output, ...) with what the rules need: params_key (sorted), params_text, target, old_s and new_s."""
    params = F.from_json("params", "map<string,string>")
    of = lambda key: F.coalesce(F.get_json_object("params", f"$.{key}"), F.lit(""))
    return steps.withColumns({"_params": params, "params_text": F.coalesce("params", F.lit("")), "old_s": of("old_string"), "new_s": of("new_string")}).withColumn("params_key", F.coalesce(F.to_json(F.array_sort(F.map_entries("_params"))), F.lit("")))


def scored(steps: DataFrame, domain: str = "coding") -> DataFrame:
    """Scored steps of any layout that ``prepared_steps`` takes."""
    classified = rules.classify_tools(prepared_steps(steps), domain)
    return rules.scored_steps(classified.withColumn("target", F.coalesce(rules.target_param(F.col("_params"), F.col("stateful_key")), F.lit(""))).drop("category", "stateful_key", "is_read", "is_write", "is_execute"), domain)


def log_steps(events: DataFrame) -> DataFrame:
    """Steps of event logs in the layout of ``prepared_steps``."""
    return logs.openhands_steps(events).withColumnsRenamed({"log_id": "traj_id", "step_id": "ord"})


def log_rewards(events: DataFrame, domain: str = "coding") -> DataFrame:
    """(traj_id, task_id, outcome, process, efficiency, reward, success, n_steps) of event logs: adapter, rules and outcome in one plan. The outcome is the share of passed tests where tests were counted, else the success."""
    o = logs.openhands_outcome(events).select(F.col("log_id").alias("traj_id"), F.col("log_id").alias("task_id"), "success", "tests_passed", "tests_failed", F.col("total_steps").alias("n_steps"))
    return _rewards(scored(log_steps(events), domain), o, F.col("tests_passed"), F.col("tests_passed") + F.col("tests_failed"))


def _rewards(steps: DataFrame, trajs: DataFrame, score: Column, total: Column) -> DataFrame:
    outcome = rules.outcome_score(F.lit(None).cast("double"), score, total, F.col("success"))
    return rules.trajectory_rewards(steps, trajs, outcome).join(trajs.select("traj_id", "success", "n_steps"), "traj_id")


def browser_rewards(browser: DataFrame, domain: str = "browser") -> DataFrame:
    """The same for nested recorder trajectories; their outcome is the success alone, as the store's variant sends it."""
    one = browser.where("traj_id IS NOT NULL").groupBy("traj_id").agg(F.min_by(F.struct("task", "outcome", "steps"), F.to_json(F.struct("steps", "task", "outcome"))).alias("t"))
    trajs = one.select("traj_id", F.coalesce("t.task.task_id", F.lit("")).alias("task_id"), F.coalesce("t.outcome.success", F.lit(False)).alias("success"), F.when(F.col("t.steps").isNull(), 0).otherwise(F.size("t.steps")).alias("n_steps"))
    s = one.select("traj_id", F.posexplode("t.steps").alias("ord", "s"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    steps = s.select("traj_id", "ord", blank(F.col("s.tool_call.name")).alias("tool"), F.coalesce("s.tool_call.parameters", F.lit("{}")).alias("params"), blank(F.col("s.tool_result.output")).alias("output"))
    return _rewards(scored(steps, domain), trajs, F.lit(0), F.lit(0))


def browser_scores(browser: DataFrame) -> DataFrame:
    """(traj_id, score): the recorded score where there is one, else the rules' reward."""
    said = browser.where("traj_id IS NOT NULL").groupBy("traj_id").agg(F.max("outcome.score").alias("said"))
    return browser_rewards(browser).join(said, "traj_id").select("traj_id", F.coalesce("said", "reward").alias("score"))


def hashed(trajs: DataFrame, steps: DataFrame) -> DataFrame:
    """Trajectories with the content hashes of their steps."""
    return trajs.join(store.flat_content_hash(steps), "traj_id")


def hub_trajectories(recorded: DataFrame, rewards: DataFrame) -> DataFrame:
    """Recorder trajectories (log_id, task, agent, model, steps, outcome, metadata) as the hub's, with their rewards; the recorder's own metadata goes last and so overrides."""
    step = lambda s: F.struct(s["thought"].alias("thought"), s["tool_call"]["name"].alias("tool"), s["tool_call"]["parameters"].alias("params"), F.coalesce(s["tool_result"]["output"], F.lit("")).alias("output"), F.coalesce(s["tool_result"]["exit_code"], F.lit(0)).alias("exit_code"))
    r = rewards.select(F.col("traj_id").alias("log_id"), "reward")
    base = F.create_map(F.lit("task_description"), F.col("task.description"), F.lit("outcome_tests_passed"), F.col("outcome.tests_passed").cast("string"), F.lit("outcome_tests_failed"), F.col("outcome.tests_failed").cast("string"), F.lit("outcome_total_tokens"), F.col("outcome.total_tokens").cast("string"))
    own = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    joined = recorded.join(r, "log_id", "left")
    return joined.select("log_id", F.col("task.task_id").alias("task_id"), F.col("agent").alias("agent_framework"), F.col("model").alias("agent_model"), F.transform("steps", step).alias("steps"), F.size("steps").alias("total_steps"), F.col("outcome.success").alias("success"), F.coalesce("reward", F.lit(0.0)).alias("reward"), F.to_json(metadata).alias("metadata"))


def run_from_logs(messages: DataFrame, task: dict[str, str] | None = None) -> DataFrame:
    """Event logs to hub trajectories with rewards; a given task (task_id, description) overrides what the logs say. Logs that don't begin with an event are left out."""
    events = logs.event_log(messages)
    events = events.join(logs.valid_event_logs(events).where("valid").select("log_id"), "log_id", "left_semi")
    recorded = logs.openhands_trajectories(events)
    if task:
        recorded = recorded.withColumn("task", F.struct(F.lit(task.get("task_id", "")).alias("task_id"), F.lit(task.get("description", "")).alias("description")))
    return hub_trajectories(recorded, log_rewards(events))


def convert_batch(spark: SparkSession, folder: str, adapter: str, pattern: str = "*") -> DataFrame:
    """Step rows of all files in a folder whose names match; files that the adapter finds invalid are left out."""
    if adapter in ("swe-agent", "sweagent"):
        docs = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), "value").where(F.col("doc").endswith(".json"))
        return logs.swe_steps(docs.join(logs.valid_swe(docs).where("valid").select("doc"), "doc", "left_semi"))
    if adapter == "openhands":
        schema = "id INT, source STRING, action STRING, observation STRING, args STRING, content STRING, thought STRING, timestamp STRING, extras STRUCT<model: STRING, agent_class: STRING, token_count: INT, exit_code: INT, error: STRING, instance_id: STRING, max_iterations: INT>"
        rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder).withColumn("log_id", F.col("_metadata.file_name")).withColumn("received_at", F.monotonically_increasing_id())
        events = logs.event_log(rows.where(F.col("log_id").rlike(r"\.jsonl?$")))
        return logs.openhands_steps(events.join(logs.valid_event_logs(events).where("valid").select("log_id"), "log_id", "left_semi"))
    return logs.get_adapter(adapter)(spark.read.option("pathGlobFilter", pattern).json(folder))


def load_tasks(spark: SparkSession, path: str, language: str | None = None, difficulty: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Tasks of a list or of a benchmark's parquet or JSON, filtered, the first ``limit`` by id."""
    tasks = files.filter_tasks(files.read_tasks(spark, path), language, difficulty, kind)
    return tasks.orderBy("task_id").limit(limit) if limit else tasks


def run_single(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Every task with every agent as a failed trajectory without steps: the place where an outside agent's runs go."""
    listed = agents.agg(F.array_sort(F.collect_set("agent"))).scalar()  # a run has a handful of agents
    return tasks.select("task_id", F.explode(listed).alias("agent")).select("task_id", "agent", F.lit(0).alias("total_steps"), F.lit(False).alias("success"), F.lit(0.0).alias("reward"))


def store_and_score(trajs: DataFrame, now: Column) -> DataFrame:
    """(content_hash, task_id, reward, gdi_score): trajectories with content_hash, reward, export_count and created_at put into an empty store, then scored by desirability from the stored rows."""
    kept = store.deduplicate(trajs)
    extra = trajs.groupBy("content_hash").agg(F.max("export_count").alias("export_count"), F.min("created_at").alias("created_at"))
    g = store.desirability(F.col("reward"), F.col("export_count"), F.col("created_at"), now)
    return kept.join(extra, "content_hash").select("content_hash", "task_id", "reward", g["total"].alias("gdi_score"))


def run(trajs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What one run of the pipeline leaves: the trajectories, their preference pairs, and the store with its scores."""
    return {"trajectories": trajs, "preferences": pairs.adjacent_pairs(trajs), "store": store_and_score(trajs, now)}
