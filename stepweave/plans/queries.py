"""The queries of the core by name, and their SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave import derive, dims
from stepweave.functions import agent_text, sanitize
from stepweave.functions.text import rounded
from stepweave.operators import episodes, export, judging, nested, pairs, rules, statistics, store
from stepweave.plans import coverage
from stepweave.plans.sql import ORACLES
from stepweave.runtime import table
from stepweave.sources import logs
from stepweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def base_steps(s: SparkSession, d: str) -> DataFrame:
    """Derived steps with their parameters as text."""
    steps = derive.steps(s, d)
    return steps.withColumn("params_key", F.concat_ws("|", "target", "old_s", "new_s")).withColumn("params_text", F.concat(F.lit('{"file_path": "'), "target", F.lit('", "k": '), F.col("k").cast("string"), F.lit("}")))


def scored(s: SparkSession, d: str) -> DataFrame:
    return rules.scored_steps(base_steps(s, d))


def rewarded(s: SparkSession, d: str) -> DataFrame:
    """Derived trajectories with their rewards."""
    steps = base_steps(s, d)
    trajs = derive.trajectories(steps)
    rewards = rules.trajectory_rewards(rules.scored_steps(steps), trajs, F.col("success").cast("double"))
    return trajs.join(rewards.select("traj_id", "outcome", "process", "efficiency", "reward"), "traj_id")


def step_texts(s: SparkSession, d: str) -> DataFrame:
    steps = base_steps(s, d)
    return export.steps_text(steps.withColumn("thought", F.lit("")).withColumn("action", F.concat("tool", F.lit("("), "target", F.lit(")"))).withColumn("observation", F.col("output")))


def _cas(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "trajectories")


def _one_cas(s: SparkSession, d: str) -> DataFrame:
    """The store with one row a hash, whose export count is the highest."""
    score = F.when(~F.isnan("reward"), F.col("reward"))
    return _cas(s, d).where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("task_id").alias("task_id"), F.min("employee").alias("employee"), F.min("domain").alias("domain"), F.max(score).alias("reward"), F.max("gdi_score").alias("gdi_score"), F.max("export_count").alias("export_count"), F.min("created_at").alias("created_at"), F.max("total_steps").alias("total_steps"))


def _tasks(s: SparkSession, d: str) -> DataFrame:
    """Tasks derived from parts: a language by brand, a difficulty by size."""
    return s.sql("SELECT concat('task_', CAST(p_partkey AS STRING)) AS task_id, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'Go' ELSE 'TypeScript' END AS language, CASE WHEN p_size < 10 THEN 'easy' WHEN p_size < 30 THEN 'Medium' ELSE 'hard' END AS difficulty, CASE p_size % 2 WHEN 0 THEN 'bug_fix' ELSE 'feature' END AS type, p_size FROM {p}", p=table(s, d, "part"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return logs.event_log(table(s, d, "messages"))


def _now() -> object:
    return F.unix_timestamp(F.lit(derive.NOW).cast("timestamp")).cast("double")


def _gdi(s: SparkSession, d: str) -> DataFrame:
    g = store.desirability(F.col("reward"), F.col("export_count"), F.col("created_at"), _now())
    return rewarded(s, d).select("traj_id", g.alias("g")).select("traj_id", "g.*")


def _store(s: SparkSession, d: str) -> DataFrame:
    rows = rewarded(s, d).join(store.flat_content_hash(base_steps(s, d)), "traj_id")
    return store.deduplicate(rows)


def _orders(s: SparkSession, d: str) -> DataFrame:
    """Steps from order lines: order = trajectory, customer = task, line = step."""
    return s.sql("SELECT CAST(l_orderkey AS STRING) AS traj_id, CAST(o_custkey AS STRING) AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord, CASE l_returnflag WHEN 'R' THEN 'read_file' WHEN 'A' THEN 'edit_file' ELSE 'bash' END AS tool, concat('part_', CAST(l_partkey % 7 AS STRING)) AS target, CAST(l_quantity AS INT) AS length, l_extendedprice AS price FROM {l} JOIN {o} ON l_orderkey = o_orderkey", l=table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity"), o=table(s, d, "orders").select("o_orderkey", "o_custkey"))


def _two_samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("is_a"))


def _calibrated(s: SparkSession, d: str) -> DataFrame:
    return rewarded(s, d).select(F.round("reward", 2).alias("x"), F.round(F.least(F.lit(1.0), F.col("mean_value") / 100), 2).alias("y"))


def _exact(s: SparkSession, d: str) -> DataFrame:
    """As ``_calibrated``, which rounds as its SQL does, but on the values as they are."""
    return rewarded(s, d).select(F.col("reward").alias("x"), F.least(F.lit(1.0), F.col("mean_value") / 100).alias("y"))


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return base_steps(s, d).withColumn("terminated", episodes.terminal(F.col("tool"), "coding"))


def _iterations(s: SparkSession, d: str) -> DataFrame:
    return rewarded(s, d).groupBy(F.regexp_extract("traj_id", "w([0-9]+)$", 1).cast("int").alias("iteration")).agg(F.round(F.avg("reward"), 4).alias("mean"))


def queries() -> dict[str, Query]:
    return _queries() | coverage.queries()


def _queries() -> dict[str, Query]:
    return {
        "p2_found": lambda s, d: nested.flat_tables(table(s, d, "trajectories"), table(s, d, "browser_trajectory")),
        "p2_merged_schema": lambda s, d: nested.merged_schema(nested.trajectory_roots(table(s, d, "trajectories"))),
        # Sources
        "s3_load_store": lambda s, d: _cas(s, d).where("gdi_score >= 0.5").orderBy(F.desc("gdi_score"), "content_hash", "created_at").limit(10000).select("content_hash", "gdi_score", "created_at"),
        "s7_read_from_store": lambda s, d: store.read_best(_one_cas(s, d), 0.5, domain="coding", limit=500).select("content_hash", "reward"),
        "s13_event_pairs": lambda s, d: logs.openhands_steps(_events(s, d)),
        "s15_outcome": lambda s, d: logs.openhands_outcome(_events(s, d)),
        "s16_metadata": lambda s, d: logs.openhands_metadata(_events(s, d)),
        "s30_profiles": lambda s, d: dims.tool_dim(s),
        # Projections and filters
        "f1_filter_tasks": lambda s, d: _filter_tasks(s, d),
        "f3_listing": lambda s, d: store.listing(_one_cas(s, d), "reward", 100, 50).select("content_hash", "reward"),
        "f4_counts": lambda s, d: _cas(s, d).groupBy(F.lower(F.trim("task_id")).alias("task_id")).agg(F.count(F.lit(1)).alias("n")),
        "f5_since": lambda s, d: store.since(_one_cas(s, d), 1770000000.0).select("content_hash", "created_at"),
        "f6_normalized_steps": lambda s, d: logs.normalized_steps(table(s, d, "browser_trajectory")),
        "f7_sft_records": lambda s, d: export.sft_records(rewarded(s, d), step_texts(s, d)),
        "f8_dpo_records": lambda s, d: export.dpo_records(pairs.adjacent_pairs(rewarded(s, d)), step_texts(s, d)),
        "f9_difficulty": lambda s, d: _tasks(s, d).select("task_id", export.difficulty_of_patch(F.repeat(F.lit("x\n"), F.col("p_size"))).alias("difficulty")),
        "f13_tool_classes": lambda s, d: rules.classify_tools(base_steps(s, d)).groupBy("tool", "category", "is_read", "is_write", "is_execute").agg(F.count(F.lit(1)).alias("n")),
        "f14_target_param": lambda s, d: base_steps(s, d).select("traj_id", "ord", rules.target_param(F.create_map(F.lit("file_path"), "target"), F.lit("file_path")).alias("found")),
        "f17_rubrics": lambda s, d: dims.rubric_dim(s).groupBy("rubric_set", "evaluator").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight")),
        "f18_high_quality": lambda s, d: rewarded(s, d).where("reward >= 0.7").select("traj_id", "task_id", "agent_model", "employee", "n_steps", "success", "reward"),
        # Rules
        "r1_redundancy": lambda s, d: scored(s, d).select("traj_id", "ord", "r1"),
        "r2_regression": lambda s, d: scored(s, d).select("traj_id", "ord", "r2"),
        "r3_info_utilization": lambda s, d: scored(s, d).select("traj_id", "ord", "r3"),
        "r4_info_tokens": lambda s, d: base_steps(s, d).select("traj_id", "ord", F.array_join(rules.info_tokens(F.col("output")), " ").alias("tokens")),
        "r5_efficiency": lambda s, d: derive.trajectories(base_steps(s, d)).select("traj_id", F.round(rules.efficiency(F.col("n_steps"), F.lit(8)), 6).alias("efficiency")),
        "r6_outcome": lambda s, d: table(s, d, "orders").select("o_orderkey", rounded(rules.outcome_score(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") / 200000), F.col("o_custkey") % 7, F.col("o_custkey") % 5, F.col("o_orderstatus") == "F"), 6).alias("score")),
        "r7_rewards": lambda s, d: rewarded(s, d).select("traj_id", "task_id", "outcome", "process", "efficiency", "reward"),
        "r11_prefix_scores": lambda s, d: scored(s, d).select("traj_id", "ord", F.round("step_total", 6).alias("step_total")),
        # Judge
        "j2_sampled_steps": lambda s, d: base_steps(s, d).join(derive.trajectories(base_steps(s, d)).select("traj_id", "n_steps"), "traj_id").where(judging.sampled(F.col("ord"), F.col("n_steps").cast("int"))).select("traj_id", "ord"),
        "j6_median_filled": lambda s, d: judging.fill_with_median(base_steps(s, d).select("traj_id", "ord", F.when(F.col("ord") % 3 != 2, F.round("value", 2)).alias("score"))),
        # Pairs and groups
        "pg1_adjacent": lambda s, d: pairs.adjacent_pairs(rewarded(s, d)),
        "pg2_outside_in": lambda s, d: pairs.outside_in_pairs(rewarded(s, d).drop("outcome")),
        "pg3_adjacent_ties": lambda s, d: pairs.adjacent_pairs(rewarded(s, d), keep_ties=True, digits=4),
        "pg4_by_employee": lambda s, d: pairs.adjacent_pairs(rewarded(s, d), by="employee"),
        "pg5_judge_batch": lambda s, d: pairs.judged_candidates(rewarded(s, d)),
        "pg6_summary": lambda s, d: pairs.pairs_summary(pairs.outside_in_pairs(rewarded(s, d))),
        "pg7_by_task": lambda s, d: pairs.query_by_task(rewarded(s, d), 0.4, 0.9, 2, 300).select("task_id", "traj_id", "reward"),
        "pg14_task_agents": lambda s, d: _task_agents(s, d),
        "pg16_tool_difference": lambda s, d: pairs.tool_difference(base_steps(s, d), "t1-w0", "t2-w0"),
        "pg17_replay": lambda s, d: pairs.replay(base_steps(s, d).withColumn("expected", F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, "other").otherwise(F.concat("output", F.lit(" ")))).withColumn("exit_code", F.lit(0))),
        "pg18_pairwise": lambda s, d: statistics.pairwise_welch(rewarded(s, d)),
        # Store
        "d1_deduplicated": lambda s, d: _store(s, d),
        "d3_desirability": lambda s, d: _gdi(s, d),
        "d4_ranked": lambda s, d: _gdi(s, d).orderBy(F.desc("total"), "traj_id").select("traj_id", "total"),
        "d6_feedback": lambda s, d: store.feedback_update(_one_cas(s, d).where("reward IS NOT NULL"), _one_cas(s, d).where("reward > 0.6").select("content_hash", F.lit(0.9).alias("feedback")), F.lit(1780000000.0)).select("content_hash", "gdi_score"),
        "d7_exported": lambda s, d: store.increment_export(_one_cas(s, d), _one_cas(s, d).where("reward > 0.8")).select("content_hash", "export_count"),
        "d8_migrated": lambda s, d: store.migrate(_one_cas(s, d), {"channel": "string"}).groupBy("channel").agg(F.count(F.lit(1)).alias("n")),
        # Aggregates
        "a1_stats": lambda s, d: store.stats(_one_cas(s, d)),
        "a2_iterations": lambda s, d: _returns(s, d),
        "a3_summaries": lambda s, d: statistics.summaries(rewarded(s, d), "agent_model"),
        "a6_leaderboard": lambda s, d: statistics.leaderboard(rewarded(s, d)),
        "a9_datacard": lambda s, d: rewarded(s, d).groupBy("employee").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("success"), 4).alias("success_rate"), F.round(F.avg("reward"), 4).alias("avg_reward"), F.round(F.avg("n_steps"), 4).alias("avg_steps"), F.countDistinct("agent_model").alias("models")),
        "a10_calibration": lambda s, d: statistics.calibration(_calibrated(s, d), "x", "y"),
        "a10_calibration_exact": lambda s, d: statistics.calibration(_exact(s, d), "x", "y"),
        "a13_agreement": lambda s, d: statistics.pairwise_agreement(_calibrated(s, d), "x", "y"),
        "a13_agreement_exact": lambda s, d: statistics.pairwise_agreement(_exact(s, d), "x", "y"),
        "a15_advantages": lambda s, d: statistics.group_advantages(rewarded(s, d)).select("traj_id", "advantage"),
        "a16_step_weights": lambda s, d: statistics.step_advantages(scored(s, d)).select("traj_id", "ord", "step_weight"),
        "a17_step_means": lambda s, d: statistics.step_advantages(scored(s, d)).groupBy("traj_id").agg(F.round(F.avg("step_weight"), 4).alias("mean_weight")),
        "a18_difficulties": lambda s, d: rewarded(s, d).select("traj_id", F.round(F.col("n_steps") - F.col("reward"), 6).alias("difficulty")),
        # Tests
        "t1_intervals": lambda s, d: statistics.summaries(rewarded(s, d), "employee").select("employee", "mean", "ci_low", "ci_high"),
        "t4_paired": lambda s, d: statistics.paired_t(_calibrated(s, d), "x", "y"),
        "t4_paired_exact": lambda s, d: statistics.paired_t(_exact(s, d), "x", "y"),
        "t5_mann_whitney": lambda s, d: statistics.mann_whitney(_two_samples(s, d), "value", F.col("is_a")),
        # Orders, splits, curricula
        "o1_export_order": lambda s, d: rewarded(s, d).where("success = 1").orderBy(F.desc("reward"), "traj_id").select("traj_id", "reward"),
        "o5_split": lambda s, d: export.split(rewarded(s, d).select("traj_id"), "traj_id"),
        "o6_curriculum": lambda s, d: export.curriculum(rewarded(s, d).select("traj_id", (F.col("n_steps") - F.col("reward")).alias("difficulty")), "difficulty", "traj_id", 1).select("traj_id"),
        "o9_union": lambda s, d: rewarded(s, d).where("success = 1").select("traj_id", "reward").unionByName(rewarded(s, d).where("success = 0").select("traj_id", "reward")),
        "o11_assigned": lambda s, d: rewarded(s, d).select("traj_id", F.pmod("user_id", F.lit(4)).alias("worker")),
        # Episodes and streams
        "x5_truncated": lambda s, d: episodes.truncate_after(_flagged(s, d), 6).select("traj_id", "ord", "terminated", "truncated"),
        "x6_timed_out": lambda s, d: episodes.time_out(_flagged(s, d), 172800).select("traj_id", "ord", "timed_out"),
        "x8_recorded": lambda s, d: episodes.recorded(episodes.truncate_after(_flagged(s, d), 6)),
        "x9_running": lambda s, d: episodes.running_statistics(_flagged(s, d).withColumn("gain", F.round("value", 2)), "gain").select("traj_id", "ord", "return_so_far", "length_so_far"),
        "x10_shortened": lambda s, d: table(s, d, "documents").select("doc_id", episodes.shortened(F.col("text"), 200).alias("text")),
        "x12_early_stop": lambda s, d: episodes.early_stop(_iterations(s, d), 2),
        "x15_sessions": lambda s, d: ingest.session_trajectories(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").select("user_id", "n_events", "total"),
        # Scalar functions
        "e1_sanitized": lambda s, d: table(s, d, "browser_trajectory").select("traj_id", F.explode("steps").alias("st")).select("traj_id", "st.step_id", sanitize.sanitized(F.col("st.thought")).alias("text")).distinct(),
        "e2_sanitized_json": lambda s, d: table(s, d, "trajectories").select("content_hash", sanitize.sanitized_json(F.col("data")).alias("data")).distinct(),
        "e4_steps_text": step_texts,
        "e6_parsed_steps": lambda s, d: table(s, d, "sft_records").select("record_id", F.size(agent_text.parse_steps(F.coalesce("response", F.lit("")))).alias("n_steps")),
        "e8_messages": lambda s, d: table(s, d, "sft_records").select("record_id", agent_text.messages_text(agent_text.messages(F.coalesce("instruction", F.lit("")), agent_text.parse_steps(F.coalesce("response", F.lit(""))))).alias("text")),
        "e11_actions": lambda s, d: base_steps(s, d).select("traj_id", "ord", agent_text.parse_action(F.concat_ws(" ", "tool", "target")).alias("a")).select("traj_id", "ord", "a.tool", "a.params"),
        "e14_shortened": lambda s, d: table(s, d, "documents").select("doc_id", agent_text.shortened(F.col("text"), 300).alias("text")),
        "e16_chunks": lambda s, d: export.chunks(base_steps(s, d).withColumn("length", F.length("output") + F.col("k")), 200),
        "e16_order_chunks": lambda s, d: export.chunks(_orders(s, d), 120),
        "r1_order_redundancy": lambda s, d: rules.redundancy(rules.classify_tools(_orders(s, d)).withColumn("params_key", F.col("target"))).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r1") == 0).alias("needless"), F.count_if(F.col("r1") == 0.3).alias("repeats")),
    }


def _filter_tasks(s: SparkSession, d: str) -> DataFrame:
    from stepweave.sources.files import filter_tasks

    return filter_tasks(_tasks(s, d), "PYTHON", "medium", "Bug_Fix").select("task_id")


def _task_agents(s: SparkSession, d: str) -> DataFrame:
    agents = F.array(*(F.lit(a) for a in ("openhands", "sweagent", "crew")))
    return derive.trajectories(base_steps(s, d)).select("task_id").distinct().select("task_id", F.explode(agents).alias("agent"))


def _returns(s: SparkSession, d: str) -> DataFrame:
    per = base_steps(s, d).groupBy("traj_id", "week").agg(F.sum(F.round("value", 2)).alias("ret"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("week").agg(F.count(F.lit(1)).alias("trajectories"), F.round(F.avg("ret"), 4).alias("avg_return"), F.round(F.min("ret"), 4).alias("min_return"), F.round(F.max("ret"), 4).alias("max_return"), F.round(F.avg("n"), 4).alias("avg_steps"))


def oracle_sql() -> dict[str, str]:
    return ORACLES | coverage.oracle_sql()
