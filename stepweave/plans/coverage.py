
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave import derive, dims, sinks
from stepweave.functions import sanitize
from stepweave.functions.text import rounded
from stepweave.operators import episodes, export, judging, nested, pairs, rules, statistics, store, training
from stepweave.plans import flows
from stepweave.plans.sql import _EV, _OUT, _OUTCOME, _R, _S, _TEXT, _rows
from stepweave.runtime import table
from stepweave.sources import files, logs, sessions

Query = Callable[[SparkSession, str], DataFrame]


def _events(s: SparkSession, d: str) -> DataFrame:
    return logs.event_log(table(s, d, "messages"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    from stepweave.plans import queries

    return queries.base_steps(s, d)


def _rewarded(s: SparkSession, d: str) -> DataFrame:
    from stepweave.plans import queries

    return queries.rewarded(s, d)


def _texts(s: SparkSession, d: str) -> DataFrame:
    from stepweave.plans import queries

    return queries.step_texts(s, d)


def _odd_steps(s: SparkSession, d: str) -> DataFrame:
    """Derived steps whose outputs also hold line ends, tabs, quotes, control characters and nulls."""
    odd = F.when(F.col("event_id") % 7 == 0, F.lit("line1\nline2\ttab \"quoted\" back\\slash")).when(F.col("event_id") % 7 == 1, F.lit("bell\u0007 é 漢")).when(F.col("event_id") % 7 == 2, F.lit(None).cast("string")).otherwise(F.col("output"))
    return _steps(s, d).withColumn("output", odd)


def _some_steps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Derived steps without those that submit, and all trajectories, of which some then have no steps."""
    steps = _steps(s, d)
    return steps.where("tool <> 'submit'"), derive.trajectories(steps)


def _partial(s: SparkSession, d: str) -> DataFrame:
    steps, trajs = _some_steps(s, d)
    return rules.trajectory_rewards(rules.scored_steps(steps), trajs, F.col("success").cast("double"))


def _swe(s: SparkSession, d: str) -> DataFrame:
    """Derived steps as documents of the [action, observation] layout."""
    steps = _steps(s, d)
    output = F.when(F.col("tool") == "bash", F.concat(F.lit("Error: "), "output")).otherwise(F.col("output"))
    act = F.when(F.col("tool") == "grep", F.concat(F.lit('"ls '), "target", F.lit('"'))).when(F.col("k") % 11 == 0, F.to_json(F.struct(F.lit("think").alias("action"), F.lit("wait").alias("thought")))).otherwise(F.to_json(F.struct(F.when(F.col("tool") == "read_file", "open").otherwise(F.col("tool")).alias("action"), F.col("target").alias("path"), F.lit("go on").alias("thought"))))
    one = F.concat(F.lit("["), act, F.lit(', "'), output, F.lit('"]'))
    listed = steps.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("j")))).alias("h"), F.count(F.lit(1)).alias("n"))
    history = F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: x["j"]), ", "), F.lit("]"))
    status = F.when(F.col("n") % 2 == 0, "submitted").otherwise("exit_cost")
    value = F.concat(F.lit('{"history": '), history, F.lit(', "problem_statement": "Mend it", "info": {"instance_id": "'), "traj_id", F.lit('", "exit_status": "'), status, F.lit('", "model_stats": {"tokens_sent": '), (F.col("n") * 10).cast("string"), F.lit(', "tokens_received": '), F.col("n").cast("string"), F.lit("}}}"))
    return listed.select(F.col("traj_id").alias("doc"), value.alias("value"))


def _crew_events(s: SparkSession, d: str) -> DataFrame:
    """Derived steps as session events: searches ask for steps, other tools answer; some sessions don't begin with a start."""
    steps = _steps(s, d)
    none = F.lit(None).cast("string")
    role = F.when(F.col("tool") == "read_file", "prompt").when(F.col("tool") == "grep", "step").otherwise("assistant")
    event = F.when(F.col("tool") == "grep", "step").otherwise("message")
    inner = steps.select(F.col("traj_id").alias("session"), (F.col("ord") + 1).cast("bigint").alias("ord"), event.alias("event"), role.alias("role"), none.alias("session_type"), F.concat("tool", F.lit(" "), "target").alias("content"), none.alias("status"))
    trajs = derive.trajectories(steps)
    kind = F.when(F.col("user_id") % 2 == 0, "pipeline").otherwise("employee")
    start = trajs.where("user_id % 9 <> 0").select(F.col("traj_id").alias("session"), F.lit(0).cast("bigint").alias("ord"), F.lit("start").alias("event"), none.alias("role"), kind.alias("session_type"), none.alias("content"), none.alias("status"))
    end = trajs.select(F.col("traj_id").alias("session"), (F.col("n_steps") + 1).cast("bigint").alias("ord"), F.lit("end").alias("event"), none.alias("role"), none.alias("session_type"), none.alias("content"), F.when(F.col("success") == 1, "completed").otherwise("failed").alias("status"))
    return inner.unionByName(start).unionByName(end)


def _session_lines(s: SparkSession, d: str) -> DataFrame:
    """Derived steps as lines of session files: each step is an assistant's message (submits as text alone, others with two uses of the tool) and a user's message with the results."""
    steps = _steps(s, d)
    q = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts))
    text = q('{"type": "text", "text": "I use ', "$tool", '"}')
    use = lambda n: q(', {"type": "tool_use", "id": "', "$event_id", f'-{n}", "name": "', "$tool", '", "input": {"path": "', "$target", '"}}')
    body = F.when(F.col("tool") == "submit", text).otherwise(F.concat(text, use(0), use(1)))
    said = F.concat(F.lit('{"type": "assistant", "sessionId": "s1", "timestamp": "t", "message": {"role": "assistant", "model": "m1", "usage": {"input_tokens": '), F.col("k").cast("string"), F.lit(', "output_tokens": 5}, "content": ['), body, F.lit("]}}"))
    got = q('{"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "', "$event_id", '-0", "content": "', "$output", '"}, {"type": "tool_result", "tool_use_id": "', "$event_id", '-1", "is_error": true, "content": [{"type": "text", "text": "no"}, {"type": "text", "text": "way"}]}]}}')
    asked = steps.where("ord = 0").select(F.col("traj_id").alias("file"), F.lit(-1).cast("bigint").alias("ord"), q('{"type": "user", "sessionId": "', "$task_id", '", "message": {"role": "user", "content": "Please mend ', "$target", '"}}').alias("value"))
    rows = steps.select(F.col("traj_id").alias("file"), F.posexplode(F.array(said, got)).alias("half", "value"), (F.col("ord") * 2).cast("bigint").alias("at"))
    return rows.select("file", (F.col("at") + F.col("half")).alias("ord"), "value").unionByName(asked)


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Reviews as sessions of their items: odd ones are the user's, even ones the assistant's."""
    docs = table(s, d, "documents").where("item_id IS NOT NULL AND doc_id IS NOT NULL")
    return docs.select(F.col("item_id").alias("session"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 1, "user").otherwise("assistant").alias("role"), "text").distinct()


def _pair_rows(s: SparkSession, d: str) -> DataFrame:
    """Adjacent pairs with texts, of which some lack a side."""
    made = export.dpo_records(pairs.adjacent_pairs(_rewarded(s, d)), _texts(s, d))
    return made.select(F.when(F.col("margin") > 0.2, F.lit(None).cast("string")).otherwise(F.col("chosen")).alias("chosen"), "rejected", "margin")


def _store_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "trajectories").select("task_id", "success", "reward", F.col("total_steps").alias("n_steps"), F.length(F.coalesce("data", F.lit(""))).alias("text_length"))


def _task_lines(s: SparkSession, d: str) -> DataFrame:
    """Parts as lines of a task list, of which some are no JSON."""
    key, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    text = F.when(kind == 0, "not json").when(kind == 1, F.concat(F.lit('{"task_id": "p'), key, F.lit('", "language": "Go"}'))).when(kind == 2, F.concat(F.lit('{"description": "part '), key, F.lit('", "difficulty": "hard"}'))).otherwise("{}")
    return table(s, d, "part").select(text.alias("value"), F.col("p_partkey").alias("line"))


def _replies(s: SparkSession, d: str) -> DataFrame:
    """Replies of a judge in several states: plain, fenced, cut off, without scores, no JSON."""
    o = table(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 300000, 2).alias("v"))
    v = F.format_string("%.2f", "v")
    plain = F.concat(F.lit('{"scores": {"goal": '), v, F.lit(', "tool": 2, "late": "x"}, "rationale": "fine"}'))
    return o.withColumn("reply", F.element_at(F.array(plain, F.concat(F.lit("So:\n```json\n"), plain, F.lit("\n```")), F.concat(F.lit('{"scores": {"goal": '), v, F.lit(', "tool": 2}, "rationale": "it was cu')), F.concat(F.lit('{"goal": '), v, F.lit("}")), F.lit("no judgment")), (F.col("o_orderkey") % 5 + 1).cast("int")))


def _judgments(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "majority").otherwise("split").alias("consensus"), (F.col("o_custkey") % 4).alias("responses"))


def _log_probs(s: SparkSession, d: str) -> DataFrame:
    """Steps as tokens: labels of reads don't count, log-probabilities and weights by value."""
    label = F.when(F.col("tool") == "read_file", -100).otherwise(F.col("k"))
    return _steps(s, d).select("traj_id", F.col("ord").alias("pos"), label.alias("label"), (-F.col("value") / 100).alias("log_prob"), (1 + F.col("k") % 3).cast("double").alias("weight"))


def _policy(s: SparkSession, d: str) -> DataFrame:
    a = statistics.group_advantages(_rewarded(s, d)).select("advantage", (-F.col("mean_value") / 50).alias("log_prob"), (-F.col("reward")).alias("old_log_prob"))
    return a


def _samples(s: SparkSession, d: str) -> DataFrame:
    """Derived trajectories as records of agent steps with rewards."""
    steps = _steps(s, d)
    scored = rules.scored_steps(steps)
    one = F.struct(F.lit("").alias("thought"), F.concat("tool", F.lit("("), "target", F.lit(")")).alias("action"), F.col("output").alias("observation"))
    listed = scored.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("s"), "step_total"))).alias("l"))
    return listed.select("traj_id", F.concat(F.lit("Solve "), "traj_id").alias("instruction"), F.lit("").alias("input"), F.lit("").alias("response"), F.transform("l", lambda x: x["s"]).alias("steps"), F.transform("l", lambda x: x["step_total"]).alias("step_rewards"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    out = training.agent_samples(_samples(s, d), 64)
    return out.select("traj_id", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x != training.IGNORED)).alias("n_labels"))


def _cas_sft(s: SparkSession, d: str) -> DataFrame:
    return export.store_sft_records(table(s, d, "trajectories"))


def queries() -> dict[str, Query]:
    coding = [(i, w) for r, i, w, _ in dims.rubric_rows() if r == "default"]
    return {
        # Sources and adapters
        "s8_tasks": lambda s, d: files.tasks_of(_task_lines(s, d)),
        "s9_benchmark_tasks": lambda s, d: files.benchmark_tasks(s.sql("SELECT concat('i-', p_partkey) AS instance_id, p_name AS problem_statement, p_brand AS repo, CAST(NULL AS STRING) AS base_commit, repeat('x\n', p_size) AS patch FROM {p}", p=table(s, d, "part"))),
        "s12_valid_logs": lambda s, d: logs.valid_event_logs(_events(s, d)),
        "s17_valid_documents": lambda s, d: logs.valid_swe(_swe(s, d).unionByName(_swe(s, d).select(F.concat("doc", F.lit("-x")).alias("doc"), F.lit('{"history": []}').alias("value")))),
        "s18_document_steps": lambda s, d: logs.swe_steps(_swe(s, d)).select("doc", "step_id", "tool", "thought", "output", "exit_code"),
        "s19_document_outcomes": lambda s, d: logs.swe_outcome(_swe(s, d)),
        "s20_valid_sessions": lambda s, d: logs.valid_crew(_crew_events(s, d)),
        "s22_session_steps": lambda s, d: logs.crew_steps(_crew_events(s, d)),
        "s25_converted": lambda s, d: logs.crew_trajectories(table(s, d, "browser_trajectory").where("traj_id IS NOT NULL").withColumn("agent", F.when(F.col("traj_id") % 3 == 0, F.concat(F.lit("crew/"), "agent")).otherwise(F.col("agent"))).withColumn("metadata", F.when(F.col("traj_id") % 4 == 0, '{"employee": "ann", "channel": "desk"}').otherwise(F.col("metadata")))).distinct(),
        "s27_tool_steps": lambda s, d: sessions.session_steps(sessions.entries(_session_lines(s, d))),
        "s28_session_heads": lambda s, d: sessions.session_heads(sessions.entries(_session_lines(s, d)), s.createDataFrame([("w1", "employee-w1"), ("w2", "employee-w2")], "name string, employee string")),
        # Projections
        "f2_loaded_tasks": lambda s, d: files.filter_tasks(s.sql("SELECT concat('task_', p_partkey) AS task_id, CASE p_size % 3 WHEN 0 THEN 'python' ELSE 'Go' END AS language FROM {p}", p=table(s, d, "part")), "go").orderBy("task_id").limit(50),
        "f4_by_hash": lambda s, d: store.by_hash(table(s, d, "trajectories"), ["0", "f"], prefix=True).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")),
        "f7_store_records": lambda s, d: export.sft_from(_rewarded(s, d).withColumn("metadata", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"task_description": "Mend '), "task_id", F.lit('", "repo": "r'), F.col("user_id").cast("string"), F.lit('"}')))), _texts(s, d)),
        "f8_prompts": lambda s, d: export.dpo_from(pairs.adjacent_pairs(_rewarded(s, d)), _rewarded(s, d).withColumn("description", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Mend "), "task_id"))), _texts(s, d)),
        "f10_cas_sft": lambda s, d: _cas_sft(s, d),
        "f12_parsed_rows": lambda s, d: store.parsed_rows(table(s, d, "trajectories")).groupBy("content_hash").agg(F.max("n_steps").alias("n_steps"), F.max("parsed").alias("parsed")),
        "f15_user_messages": lambda s, d: table(s, d, "documents").where("doc_id IS NOT NULL").select("doc_id", files.user_message(F.col("title"), F.col("source"), F.col("lang")).alias("message")).distinct(),
        "f16_task_errors": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(files.task_errors(F.when(F.col("p_size") % 2 == 0, "coding").otherwise("browser"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))), ", ").alias("errors")),
        "f17_descriptions": lambda s, d: dims.rubric_lines(s),
        "f19_memories": lambda s, d: sessions.memories(_turns(s, d)),
        # Rules and flows
        "r7_partial": _partial,
        "r9_browser_rewards": lambda s, d: flows.browser_rewards(table(s, d, "browser_trajectory")),
        "r10_rescored": lambda s, d: rules.rescored(_rewarded(s, d).withColumn("computed", F.col("reward")).withColumn("reward", F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(F.col("mean_value")))).select("traj_id", "reward"),
        "r12_scores": lambda s, d: flows.browser_scores(table(s, d, "browser_trajectory")),
        "g2_stubs": lambda s, d: flows.run_single(table(s, d, "customer").select(F.col("c_custkey").alias("task_id")), s.createDataFrame([("openhands",), ("crew",)], "agent string")),
        "g4_log_rewards": lambda s, d: flows.log_rewards(_events(s, d)),
        "f11_hub_trajectories": lambda s, d: flows.run_from_logs(table(s, d, "messages")).select("log_id", "task_id", "agent_framework", "agent_model", "total_steps", "success", "reward", F.get_json_object("metadata", "$.outcome_tests_passed").alias("tests_passed")),
        "g1_run_preferences": lambda s, d: flows.run(flows.hashed(_rewarded(s, d), _steps(s, d)), _now())["preferences"],
        "d5_stored_scores": lambda s, d: flows.store_and_score(flows.hashed(_rewarded(s, d), _steps(s, d)), _now()),
        # Judge
        "j1_prompts": lambda s, d: _steps(s, d).select("traj_id", "ord", judging.judge_prompt(F.when(F.col("user_id") % 2 == 0, "advisory").otherwise("coding"), F.lit(""), F.col("tool"), F.col("params_text"), F.repeat("output", F.lit(120)), F.col("ord") + 1, F.lit(9), F.lit(""), coding).alias("prompt")),
        "j3_contexts": lambda s, d: judging.judge_context(_steps(s, d).withColumn("score", F.when(F.col("k") % 3 > 0, rounded(F.col("value") / 100, 2)))).select("traj_id", "ord", "context"),
        "j4_scores": lambda s, d: judging.parsed_replies(_replies(s, d), "reply", ["goal", "tool", "late"]).select("o_orderkey", F.element_at("scores", 1).alias("goal"), F.element_at("scores", 2).alias("tool"), F.element_at("scores", 3).alias("late"), F.round(judging.weighted_score(F.col("scores"), [("goal", 0.5), ("tool", 0.3), ("late", 0.2)]), 6).alias("score")),
        "j5_without_judge": lambda s, d: judging.judged(_steps(s, d), ["a", "b"]).select("traj_id", "ord", F.element_at("scores", 1).alias("a"), F.element_at("scores", 2).alias("b")),
        # Pairs and groups
        "pg2_rationales": lambda s, d: pairs.outside_in_pairs(_rewarded(s, d).withColumn("outcome", F.col("success").cast("double")).withColumn("summary", F.when(F.col("user_id") % 2 == 0, F.col("agent_model")))),
        "pg4_by_description": lambda s, d: pairs.adjacent_pairs(_rewarded(s, d).withColumn("description", F.concat(F.lit("Mend module "), (F.col("user_id") % 50).cast("string"))), by="description"),
        "pg5_requests": lambda s, d: pairs.judge_requests(_rewarded(s, d), export.trajectory_summaries(_steps(s, d).withColumn("thought", F.lit("")))),
        "pg8_groups": lambda s, d: pairs.group_records(_rewarded(s, d), _texts(s, d), 4),
        "pg9_all_members": lambda s, d: pairs.group_records(_rewarded(s, d).withColumn("description", F.concat(F.lit("Mend "), "task_id")), _texts(s, d), None),
        "pg10_benchmark": lambda s, d: pairs.benchmark(_rewarded(s, d)).select("task_id", "description", "difficulty", F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["agent_model"], F.format_string("%.6f", r["reward"]), r["success"].cast("string"), r["total_steps"].cast("string"))), ";").alias("runs"), "low", "high"),
        "pg13_resume": lambda s, d: pairs.remaining(table(s, d, "customer").select(F.col("c_custkey").alias("task_id")), table(s, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("task_id"))),
        "pg15_agreed": lambda s, d: pairs.agreed_judgments(_judgments(s, d)),
        # Store
        "d2_content_hash": lambda s, d: store.flat_content_hash(_odd_steps(s, d)),
        # Aggregates and tests
        "a4_episodes": lambda s, d: statistics.episode_summary(_rewarded(s, d)),
        "a5_comparison": lambda s, d: statistics.compare_agents(_rewarded(s, d)),
        "a7_scored_files": lambda s, d: statistics.leaderboard(_rewarded(s, d), "task_id").select("task_id", "avg_reward", "place"),
        "a8_validation": lambda s, d: export.validate_sft(table(s, d, "sft_records")),
        "a8_trajectories": lambda s, d: export.validate_trajectories(_store_rows(s, d)),
        "a8_pairs": lambda s, d: export.validate_dpo(_pair_rows(s, d)),
        "a14_counts": lambda s, d: sinks.push_counts(_rewarded(s, d)),
        "t2_bootstrap": lambda s, d: statistics.bootstrap_interval(_rewarded(s, d), "agent_model", "reward", 100),
        "t3_welch": lambda s, d: statistics.welch(_rewarded(s, d).where("agent_model IN ('model-0', 'model-1')"), "reward", F.col("agent_model") == "model-0"),
        # Orders and shares
        "o7_fitted": lambda s, d: _samples(s, d).select("traj_id", F.size(export.fitted(F.col("step_rewards"), F.lit(5))).alias("n"), F.round(F.element_at(export.fitted(F.col("step_rewards"), F.lit(5)), 5), 6).alias("last")),
        "o5_pair_split": lambda s, d: export.split(pairs.adjacent_pairs(_rewarded(s, d)).select("chosen"), "chosen", {"train": 0.9, "test": 0.1}),
        "o6_shuffled": lambda s, d: export.curriculum(_rewarded(s, d).select("traj_id", (F.col("n_steps") - F.col("reward")).alias("difficulty")), "difficulty", "traj_id", 5, shuffle_seed=3),
        "o11_worker_shares": lambda s, d: episodes.shares(table(s, d, "customer"), 7),
        # Episodes
        "x8_recorded_steps": lambda s, d: episodes.recorded_steps(episodes.flagged(_steps(s, d), "coding", 6)),
        "x9_episode_sums": lambda s, d: episodes.episode_statistics(_steps(s, d).withColumn("gain", F.round("value", 2)), "gain"),
        "x10_flagged": lambda s, d: table(s, d, "documents").where("doc_id IS NOT NULL").select("doc_id", episodes.shortened(F.col("text"), 200).alias("text"), (F.length("text") > 200).alias("truncated")).distinct(),
        "x11_flags": lambda s, d: episodes.flagged(_steps(s, d), "coding", 4, always=True).select("traj_id", "ord", "terminated", "truncated"),
        "x12_iterations": lambda s, d: episodes.iteration_statistics(_rewarded(s, d).withColumn("ret", F.col("reward")).withColumn("week", F.regexp_extract("traj_id", "w([0-9]+)$", 1).cast("int")), "week"),
        # Texts
        "e1_audit": lambda s, d: table(s, d, "browser_trajectory").where("traj_id IS NOT NULL").select("traj_id", F.explode("steps").alias("st")).select("traj_id", "st.step_id", F.explode(sanitize.audit(F.col("st.tool_result.output"))).alias("a")).select("traj_id", "step_id", "a.*").distinct(),
        "e2_redacted_trajectories": lambda s, d: sanitize.sanitize_trajectories(table(s, d, "trajectories").select("content_hash", "data").distinct()).select("content_hash", "data", "total_redacted", F.size("entries").alias("n_entries")),
        "e3_full": lambda s, d: table(s, d, "sft_records").select("record_id", sanitize.sanitize_full(F.col("response")).alias("text")),
        "e5_tool_text": lambda s, d: export.tool_steps_text(_steps(s, d).withColumn("thought", F.when(F.col("k") % 2 == 0, "hm")).withColumn("output", F.repeat("output", F.lit(40)))),
        "e7_structured": lambda s, d: _samples(s, d).select("traj_id", F.posexplode("steps").alias("ord", "s")).select("traj_id", "ord", "s.thought", "s.action", "s.observation"),
        "e10_summaries": lambda s, d: export.trajectory_summaries(_steps(s, d).withColumn("thought", F.when(F.col("k") % 2 == 0, "hm"))),
        "e18_labels": _labels,
        "e19_padded": lambda s, d: training.collated(_samples(s, d).select("traj_id", "step_rewards"), F.substring("traj_id", 1, 2), {"step_rewards": -1.0}, 6).select("traj_id", F.size("step_rewards").alias("n"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real")),
        "e20_schema": lambda s, d: s.createDataFrame([(f.name, f.dataType.simpleString()) for f in table(s, d, "lineitem").schema.fields], "name string, type string"),
        "g7_chunk_weights": lambda s, d: training.chunk_steps(export.chunks(_steps(s, d).withColumn("length", F.length("output") + F.col("k")), 200), _steps(s, d).withColumn("reward", F.round("value", 2))),
        "g9_sequences": lambda s, d: statistics.sequence_log_probs(_log_probs(s, d)).select("traj_id", F.round("log_prob", 6).alias("log_prob")),
        "l1_grpo_loss": lambda s, d: statistics.grpo_loss(_policy(s, d)).select(*(F.round(c, 6).alias(c) for c in ("loss", "policy_loss", "kl", "ratio_mean", "ratio_std", "advantage_mean"))),
        "l2_cross_entropy": lambda s, d: statistics.weighted_cross_entropy(_log_probs(s, d)).select(F.round("loss", 6).alias("loss")),
        "l3_dpo_loss": lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(statistics.dpo_loss(-F.col("o_totalprice") / 1e5, -(F.col("o_custkey") % 7).cast("double"), F.lit(-1.0), F.lit(-2.0)), 6).alias("loss")),
        "l4_perplexity": lambda s, d: statistics.perplexity(table(s, d, "orders").select((F.col("o_totalprice") / 1e5).alias("nll"), (F.col("o_custkey") % 9 + 1).alias("n_tokens"), (F.col("o_custkey") % 2).alias("n_right"))).select(F.round("perplexity", 6).alias("perplexity"), F.round("accuracy", 6).alias("accuracy")),
        # Sinks
        "k6_datacard": lambda s, d: sinks.datacard(_rewarded(s, d).withColumn("agent_framework", F.lit("derived"))),
        "k7_report": lambda s, d: sinks.evaluation_report(_rewarded(s, d)),
        "k8_comparison": lambda s, d: sinks.comparison_report(_rewarded(s, d)),
        "k9_batch_numbers": lambda s, d: sinks.daily_numbers(_rewarded(s, d)),
        "k10_payloads": lambda s, d: sinks.push_payloads(_rewarded(s, d)),
        "p2_child_tables": lambda s, d: nested.child_rows(table(s, d, "trajectories")),
    }


def _now() -> object:
    return F.unix_timestamp(F.lit(derive.NOW).cast("timestamp")).cast("double")


def _score(base: str, reads: str, writes: str, runs: str) -> str:
    """Common table expressions that score the steps of ``base`` (traj_id, ord, tool, params_key, target, old_s, new_s, output, params_text)."""
    return f""", b AS (SELECT *, tool IN ({reads}) AS is_read, tool IN ({writes}) AS is_write, tool IN ({runs}) AS is_execute FROM {base}),
tw AS (SELECT traj_id, ord, string_split(trim(regexp_replace(output, '\\s+', ' ', 'g')), ' ') AS ws FROM b),
tok AS (SELECT traj_id, ord, regexp_replace(w, '^[.,;:()\\[\\]{{}}"''`]+|[.,;:()\\[\\]{{}}"''`]+$', '', 'g') AS token FROM (SELECT traj_id, ord, unnest(ws) AS w FROM tw) WHERE contains(w, '/') AND length(w) > 3
  UNION SELECT traj_id, ord, w FROM (SELECT traj_id, ord, unnest(ws) AS w FROM tw) WHERE contains(w, '_') AND length(w) > 3 AND regexp_full_match(w, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*')),
c AS (SELECT *, max(CASE WHEN is_read THEN ord END) OVER pw AS lr, max(CASE WHEN is_write THEN ord END) OVER pw AS lw, row_number() OVER (PARTITION BY traj_id, tool, params_key ORDER BY ord) > 1 AS dup
  FROM b WINDOW pw AS (PARTITION BY traj_id, target ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sc AS (SELECT traj_id, ord,
    CASE WHEN is_read AND NOT (target <> '' AND lw IS NOT NULL AND (lr IS NULL OR lw > lr)) AND ((target <> '' AND lr IS NOT NULL) OR dup) THEN 0.0 WHEN dup AND NOT is_read THEN 0.3 ELSE 1.0 END AS r1,
    CASE WHEN is_write AND old_s <> '' AND new_s <> '' AND EXISTS (SELECT 1 FROM b p WHERE p.traj_id = c.traj_id AND p.target = c.target AND p.is_write AND p.ord < c.ord AND p.old_s = c.new_s AND p.new_s = c.old_s) THEN 0.0 ELSE 1.0 END AS r2,
    CASE WHEN (is_write OR is_execute) AND ord > 0 AND EXISTS (SELECT 1 FROM tok t WHERE t.traj_id = c.traj_id AND t.ord < c.ord) AND NOT EXISTS (SELECT 1 FROM tok t WHERE t.traj_id = c.traj_id AND t.ord < c.ord AND contains(lower(c.params_text), lower(t.token))) THEN 0.7 ELSE 1.0 END AS r3 FROM c),
pr AS (SELECT traj_id, avg((0.15 * least(r1, r2) + 0.15 * r3 + 0.7 * 0.5)::DOUBLE) AS process FROM sc GROUP BY traj_id)
"""


def _r6(x: str) -> str:
    return f"round(({x})::DOUBLE + 1e-9, 6)"


def _final(outcome: str) -> str:
    return f"{_r6(outcome)} AS outcome, {_r6('coalesce(process, 0)')} AS process, CASE WHEN process IS NULL THEN {_r6('0')} ELSE {_r6('1')} END AS efficiency, CASE WHEN process IS NULL THEN {_r6('0')} ELSE {_r6(f'0.4 * ({outcome}) + 0.5 * process + 0.1')} END AS reward"


def _first(keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(params, '$.{k}'), '')" for k in keys.split()) + ", '')"


_PARAM_KEY = "coalesce((SELECT string_agg(k || '=' || coalesce(json_extract_string(params, '$.\"' || k || '\"'), '<null>'), chr(1) ORDER BY k) FROM (SELECT unnest(json_keys(params)) AS k)), '')"
_LOG_SCORE = (
    _OUTCOME
    + f""", ls AS (SELECT log_id AS traj_id, step_id AS ord, tool, output, params AS params_text, {_PARAM_KEY} AS params_key, {_first('file_path path url element_id')} AS target, coalesce(json_extract_string(params, '$.old_string'), '') AS old_s, coalesce(json_extract_string(params, '$.new_string'), '') AS new_s FROM steps)"""
    + _score("ls", "'read_file', 'grep'", "'edit_file', 'write_file'", "'bash', 'ipython', 'git'")
    + """, lr2 AS (SELECT o.*, process, CASE WHEN tests_passed + tests_failed > 0 THEN tests_passed::DOUBLE / (tests_passed + tests_failed) WHEN success THEN 1.0 ELSE 0.0 END AS oc FROM outcomes o LEFT JOIN pr ON pr.traj_id = o.log_id)
"""
)
_BROWSER_TOOLS = {c: ", ".join(f"'{t}'" for _, t, k, _ in dims.tool_rows("browser") if k in c) for c in (("read", "search"), ("write",), ("execute",))}
_BROWSER = (
    """WITH one AS (SELECT traj_id, any_value(task) AS task, any_value(outcome) AS outcome, any_value(steps) AS steps FROM (SELECT DISTINCT traj_id, task, outcome, steps FROM browser_trajectory WHERE traj_id IS NOT NULL) GROUP BY traj_id),
u AS (SELECT traj_id, unnest(range(len(steps))) AS ord, unnest(steps) AS s FROM one),
bs AS (SELECT traj_id, ord, coalesce(s.tool_call.name, '') AS tool, coalesce(s.tool_call.parameters, '{}') AS params0, coalesce(s.tool_result.output, '') AS output FROM u),
bp AS (SELECT *, CASE WHEN json_valid(params0) THEN params0 END AS params FROM bs),
"""
    + f"""bq AS (SELECT traj_id, ord, tool, output, params0 AS params_text, {_PARAM_KEY} AS params_key, CASE WHEN tool IN ('navigate', 'goto', 'open_url') THEN {_first('url file_path path element_id')} WHEN tool IN ('click', 'tap', 'type_text', 'type', 'fill', 'input') THEN {_first('element_id file_path path url')} ELSE {_first('file_path path url element_id')} END AS target,
  coalesce(json_extract_string(params, '$.old_string'), '') AS old_s, coalesce(json_extract_string(params, '$.new_string'), '') AS new_s FROM bp)"""
    + _score("bq", _BROWSER_TOOLS[("read", "search")], _BROWSER_TOOLS[("write",)], "''")
    + """, br AS (SELECT one.traj_id, coalesce(task.task_id, '') AS task_id, coalesce(outcome.success, false) AS success, outcome.score AS score, coalesce(len(steps), 0) AS n_steps, process, CASE WHEN coalesce(outcome.success, false) THEN 1.0 ELSE 0.0 END AS oc FROM one LEFT JOIN pr USING (traj_id))
"""
)
_CREW = _S + """, ce AS (SELECT traj_id AS session, ord + 1 AS ord, CASE WHEN tool = 'grep' THEN 'step' ELSE 'message' END AS event, CASE tool WHEN 'read_file' THEN 'prompt' WHEN 'grep' THEN 'step' ELSE 'assistant' END AS role, tool || ' ' || target AS content FROM b),
ok AS (SELECT t.traj_id AS session, CASE WHEN user_id % 2 = 0 THEN 'pipeline' ELSE 'employee' END AS kind, success = 1 AS success, user_id % 9 <> 0 AND EXISTS (SELECT 1 FROM ce WHERE ce.session = t.traj_id AND role = 'assistant' AND event = 'message') AS valid FROM trajs t)
"""
_SWE = _S + """, h AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY ord) AS i, CASE WHEN tool = 'grep' THEN 'bash' WHEN k % 11 = 0 THEN 'think' WHEN tool = 'read_file' THEN 'open' ELSE tool END AS act FROM b),
hs AS (SELECT traj_id AS doc, row_number() OVER (PARTITION BY traj_id ORDER BY ord) - 1 AS step_id, CASE act WHEN 'open' THEN 'read_file' WHEN 'edit_file' THEN 'edit_file' ELSE act END AS tool, CASE WHEN tool = 'grep' THEN '' ELSE 'go on' END AS thought,
  CASE WHEN tool = 'bash' THEN 'Error: ' || output ELSE output END AS output, CASE WHEN act = 'bash' AND tool = 'bash' THEN 1 ELSE 0 END AS exit_code FROM h WHERE act <> 'think')
"""
_MEMORY = """WITH t AS (SELECT DISTINCT item_id AS session, doc_id AS ord, doc_id % 2 = 1 AS usr, text FROM documents WHERE item_id IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT *, sum(usr::INT) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(text, '决定|统一|不再|确定|方案定|最终选|采用|弃用|禁止') THEN 'decision' WHEN regexp_matches(text, '其实|说错了|纠正|更正|之前错|搞错|误解|实际上应该') THEN 'correction' WHEN turn >= 3 AND length(text) > 200 THEN 'finding' END AS category FROM n WHERE NOT usr AND trim(coalesce(text, ''), ' ') <> '')
"""
_SPLIT = "greatest(0.0, least(1.0, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN round(o_totalprice / 300000, 2) ELSE 0.5 END))"
_PAIR3 = _R + """, nx AS (SELECT *, lead(traj_id) OVER o AS n_id, lead(reward) OVER o AS n_reward FROM w WINDOW o AS (PARTITION BY task_id ORDER BY reward DESC, traj_id)),
pp AS (SELECT task_id, traj_id AS chosen, n_id AS rejected, round(reward - n_reward + 1e-9, 6) AS margin FROM nx WHERE reward <> n_reward)
"""
_HASHED = _R + """, hh AS (SELECT traj_id, left(sha256('[' || string_agg('{"output": "' || output || '", "params": {"path": "' || target || '"}, "tool": "' || tool || '"}', ', ' ORDER BY ord) || ']'), 16) AS content_hash FROM b GROUP BY traj_id),
hw AS (SELECT content_hash, arg_min(task_id, (created_at, reward)) AS task_id, max(reward) AS reward, max(export_count) AS export_count, min(created_at) AS created_at FROM w JOIN hh USING (traj_id) GROUP BY content_hash)
"""
_EPISODE = """ SELECT 'all' AS a, count(reward) AS n, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS s, min(reward) AS lo, max(reward) AS hi, avg(success) AS p, 1.96::DOUBLE AS z, avg(n_steps) AS sm, coalesce(stddev_samp(n_steps), 0) AS ss,
  count(*) FILTER (reward < 0.25) AS bin0, count(*) FILTER (reward >= 0.25 AND reward < 0.5) AS bin1, count(*) FILTER (reward >= 0.5 AND reward < 0.75) AS bin2, count(*) FILTER (reward >= 0.75) AS bin3 FROM w"""
_SUMMARY = """round(m, 4) AS mean, round(s, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(m - 1.96 * s / sqrt(n), 4) AS ci_low, round(m + 1.96 * s / sqrt(n), 4) AS ci_high, round(p, 4) AS success_rate,
  round((p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 4) AS wilson_low, round((p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 4) AS wilson_high,
  round(sm, 4) AS avg_steps, round(ss, 4) AS std_steps, round(sm - 1.96 * ss / sqrt(n), 4) AS steps_low, round(sm + 1.96 * ss / sqrt(n), 4) AS steps_high"""
_PC = "printf('%.1f%%', round({0} * 100 + 1e-9, 1))"


def oracle_sql() -> dict[str, str]:
    from stepweave.plans.sql import ORACLES

    rubric_text = "".join(f"\n- {i} (weight {w})" for r, i, w, _ in dims.rubric_rows() if r == "default")
    lines = [(r, "\n".join(f"- {i} (weight: {w})" for t, i, w, _ in dims.rubric_rows() if t == r)) for r in dict.fromkeys(x[0] for x in dims.rubric_rows())]
    board = ORACLES["a6_leaderboard"].split("SELECT *, row_number()")[0]
    welch = ORACLES["pg18_pairwise"]
    redacted = "st.thought"
    for _, pattern, shown in sanitize.RULES:
        redacted = "regexp_replace({}, '{}', '{}', 'g')".format(redacted, pattern.replace("'", "''"), shown.replace("$1", "\\1"))
    exact = lambda name: ORACLES[name].replace("round(reward, 2) AS x, round(least(1.0, mean_value / 100), 2) AS y", "reward AS x, least(1.0, mean_value / 100) AS y")
    return {
        "a10_calibration_exact": exact("a10_calibration"),
        "a13_agreement_exact": exact("a13_agreement"),
        "t4_paired_exact": exact("t4_paired"),
        "e3_full": f"SELECT record_id, {redacted.replace('st.thought', 'response')} AS text FROM sft_records",
        "e1_sanitized": f"WITH u AS (SELECT traj_id, unnest(steps) AS st FROM browser_trajectory) SELECT DISTINCT traj_id, st.step_id AS step_id, {redacted} AS text FROM u",
        "k10_payloads": _R + """SELECT traj_id, to_json(struct_pack(task_id := task_id, agent_model := agent_model, employee := employee, reward := reward, success := success = 1, total_steps := n_steps))::VARCHAR AS payload FROM w""",
        "s8_tasks": """WITH t AS (SELECT p_partkey, p_size % 4 AS c, row_number() OVER (ORDER BY p_partkey) AS line FROM part)
SELECT CASE c WHEN 1 THEN 'p' || p_partkey ELSE 'task_' || line END AS task_id, CASE c WHEN 2 THEN 'part ' || p_partkey ELSE '' END AS description, 'bug_fix' AS type, CASE c WHEN 1 THEN 'Go' ELSE 'python' END AS language, CASE c WHEN 2 THEN 'hard' ELSE 'medium' END AS difficulty, '' AS repo, '' AS base_commit, '' AS test_command FROM t WHERE c <> 0""",
        "s9_benchmark_tasks": "SELECT 'i-' || p_partkey AS task_id, p_name AS description, 'bug_fix' AS type, 'python' AS language, CASE WHEN p_size + 1 < 10 THEN 'easy' WHEN p_size + 1 < 50 THEN 'medium' ELSE 'hard' END AS difficulty, p_brand AS repo, '' AS base_commit FROM part",
        "s12_valid_logs": _EV + "SELECT log_id, action IS NOT NULL OR observation IS NOT NULL AS valid FROM e WHERE rn = 1",
        "s17_valid_documents": _S + "SELECT traj_id AS doc, true AS valid FROM trajs UNION ALL SELECT traj_id || '-x', false FROM trajs",
        "s18_document_steps": _SWE + "SELECT * FROM hs",
        "s19_document_outcomes": _SWE + "SELECT t.traj_id AS doc, t.traj_id AS task_id, 'Mend it' AS description, '' AS model, '' AS repo, '' AS base_commit, t.n_steps % 2 = 0 AS success, t.n_steps * 11 AS total_tokens, (SELECT count(*) FROM hs WHERE hs.doc = t.traj_id) AS total_steps FROM trajs t",
        "s20_valid_sessions": _CREW + "SELECT session, valid FROM ok",
        "s22_session_steps": _CREW
        + """SELECT session, kind, st.i AS step_id, an.content AS output, success FROM ok JOIN (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ord) - 1 AS i FROM ce WHERE role = 'step') st USING (session)
JOIN (SELECT session, content, row_number() OVER (PARTITION BY session ORDER BY ord) - 1 AS i FROM ce WHERE role = 'assistant') an USING (session, i) WHERE valid AND kind = 'pipeline'
UNION ALL SELECT session, kind, 0, arg_max(content, ord), any_value(success) FROM ok JOIN ce USING (session) WHERE valid AND kind = 'employee' AND role = 'assistant' GROUP BY session, kind""",
        "s25_converted": """WITH q AS (SELECT DISTINCT traj_id, task, CASE WHEN traj_id % 3 = 0 THEN 'crew/' || agent ELSE agent END AS agent, model, CASE WHEN traj_id % 4 = 0 THEN '{"employee": "ann", "channel": "desk"}' ELSE metadata END AS m, len(steps) AS n, outcome FROM browser_trajectory WHERE traj_id IS NOT NULL)
SELECT DISTINCT traj_id, coalesce(task.task_id, '') AS task_id, CASE WHEN contains(agent, '/') THEN split_part(agent, '/', 1) ELSE 'crew' END AS agent_framework, coalesce(model, '') AS agent_model, coalesce(nullif(json_extract_string(m, '$.employee'), ''), CASE WHEN contains(agent, '/') THEN substr(agent, position('/' IN agent) + 1) END, '') AS employee,
  coalesce(json_extract_string(m, '$.channel'), json_extract_string(m, '$.source'), 'crew') AS source, coalesce(task.domain, json_extract_string(m, '$.domain'), 'crew') AS domain, coalesce(outcome.total_steps, n, 0) AS total_steps, coalesce(outcome.success, false) AS success FROM q""",
        "s27_tool_steps": _S
        + """, q AS (SELECT *, unnest(CASE WHEN tool = 'submit' THEN [0] ELSE [0, 1] END) AS n FROM b)
SELECT traj_id AS file, row_number() OVER (PARTITION BY traj_id ORDER BY ord, n) AS step_id, CASE WHEN tool = 'submit' THEN 'thinking' ELSE tool END AS tool, CASE WHEN tool = 'submit' THEN '{}' ELSE '{"path":"' || target || '"}' END AS params, CASE WHEN n = 0 THEN 'I use ' || tool ELSE '' END AS thought,
  CASE WHEN tool = 'submit' THEN '' WHEN n = 0 THEN output ELSE 'no' || chr(10) || 'way' END AS output, n AS exit_code, 't' AS "timestamp", CASE WHEN n = 0 THEN k + 5 ELSE 0 END AS token_count FROM q""",
        "s28_session_heads": _S + "SELECT traj_id AS file, any_value(task_id) AS session_id, CASE WHEN contains(traj_id, 'w1') THEN 'employee-w1' WHEN contains(traj_id, 'w2') THEN 'employee-w2' ELSE 'unknown-agent' END AS employee, 'm1' AS model, 'Please mend ' || arg_min(target, ord) AS description FROM b GROUP BY traj_id",
        "f2_loaded_tasks": "SELECT 'task_' || p_partkey AS task_id, 'Go' AS language FROM part WHERE p_size % 3 <> 0 ORDER BY task_id LIMIT 50",
        "f4_by_hash": "SELECT content_hash, count(*) AS n FROM trajectories WHERE content_hash LIKE '0%' OR content_hash LIKE 'f%' GROUP BY content_hash",
        "f7_store_records": _TEXT
        + """SELECT traj_id, CASE WHEN user_id % 2 = 0 THEN 'Mend ' ELSE 'Solve task: ' END || task_id AS instruction, '{"repo": "' || CASE WHEN user_id % 2 = 0 THEN 'r' || user_id ELSE '' END || '", "base_commit": "", "test_command": ""}' AS input, text AS response, reward, agent_model, n_steps AS total_steps FROM w JOIN x USING (traj_id) WHERE success = 1""",
        "f8_prompts": _TEXT.replace(", x AS", _PAIR3[len(_R) :].rstrip() + ", x AS", 1)
        + """SELECT CASE WHEN a.user_id % 2 = 0 THEN 'Mend ' || pp.task_id ELSE 'Solve the following task:' || chr(10) || chr(10) || 'Task ID: ' || pp.task_id END AS prompt, xa.text AS chosen, xb.text AS rejected, margin, a.agent_model AS chosen_model, b2.agent_model AS rejected_model, a.reward AS chosen_reward, b2.reward AS rejected_reward
FROM pp JOIN w a ON a.traj_id = pp.chosen JOIN w b2 ON b2.traj_id = pp.rejected JOIN x xa ON xa.traj_id = pp.chosen JOIN x xb ON xb.traj_id = pp.rejected""",
        "f12_parsed_rows": """WITH q AS (SELECT content_hash, CASE WHEN json_valid(data) THEN data END AS j FROM trajectories WHERE content_hash IS NOT NULL)
SELECT content_hash, max(CASE json_type(j) WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.steps') = 'ARRAY' THEN json_array_length(j, '$.steps') END WHEN 'ARRAY' THEN json_array_length(j) END)::INT AS n_steps, max(coalesce(json_type(j) IN ('OBJECT', 'ARRAY'), false)) AS parsed FROM q GROUP BY content_hash""",
        "f15_user_messages": "SELECT DISTINCT doc_id, coalesce(nullif(title, ''), nullif(source, ''), nullif(lang, ''), '') AS message FROM documents WHERE doc_id IS NOT NULL",
        "f16_task_errors": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat_ws(', ', CASE WHEN p_size % 3 = 0 THEN 'no repository' END, CASE WHEN p_size % 5 = 0 THEN 'no base commit' END) ELSE '' END AS errors FROM part",
        "f17_descriptions": f"SELECT * FROM {_rows(lines, 'rubric_set, description')}",
        "f19_memories": _MEMORY + "SELECT session, category, arg_min(CASE WHEN length(trim(text, ' ')) > 300 THEN left(trim(text, ' '), 300) || '...' ELSE trim(text, ' ') END, ord) AS content FROM k WHERE category IS NOT NULL GROUP BY session, category",
        "r7_partial": _S.replace("FROM steps)", "FROM steps WHERE tool <> 'submit')")
        + _score("b", "'read_file', 'grep'", "'edit_file'", "'bash'").replace(", b AS (SELECT *, tool IN ('read_file', 'grep') AS is_read, tool IN ('edit_file') AS is_write, tool IN ('bash') AS is_execute FROM b)", "", 1)
        + f"SELECT traj_id, task_id, {_final('success::DOUBLE')} FROM trajs LEFT JOIN pr USING (traj_id)",
        "r9_browser_rewards": _BROWSER + f"SELECT traj_id, task_id, {_final('oc')}, success, n_steps FROM br",
        "r10_rescored": _R + "SELECT traj_id, CASE WHEN user_id % 3 = 0 OR mean_value = 0 THEN reward ELSE mean_value END AS reward FROM w",
        "r12_scores": _BROWSER + f"SELECT traj_id, coalesce(score, CASE WHEN process IS NULL THEN {_r6('0')} ELSE {_r6('0.4 * oc + 0.5 * process + 0.1')} END) AS score FROM br",
        "g2_stubs": "SELECT c_custkey AS task_id, agent, 0 AS total_steps, false AS success, 0.0::DOUBLE AS reward FROM customer, (VALUES ('openhands'), ('crew')) a(agent)",
        "g4_log_rewards": _LOG_SCORE + f"SELECT log_id AS traj_id, log_id AS task_id, {_final('oc')}, success, total_steps AS n_steps FROM lr2",
        "f11_hub_trajectories": _LOG_SCORE
        + f""", md AS (SELECT log_id, arg_max(extras.model, rn) FILTER (extras.model <> '') AS model, arg_max(extras.instance_id, rn) FILTER (extras.instance_id <> '') AS instance_id, arg_min(action IS NOT NULL OR observation IS NOT NULL, rn) AS valid FROM e GROUP BY log_id)
SELECT log_id, coalesce(instance_id, log_id) AS task_id, 'openhands' AS agent_framework, coalesce(model, '') AS agent_model, total_steps, success, CASE WHEN process IS NULL THEN {_r6('0')} ELSE {_r6('0.4 * oc + 0.5 * process + 0.1')} END AS reward, tests_passed::VARCHAR AS tests_passed FROM lr2 JOIN md USING (log_id) WHERE valid""",
        "g1_run_preferences": _PAIR3 + "SELECT * FROM pp",
        "d5_stored_scores": _HASHED + f"SELECT content_hash, task_id, reward, round(0.35 * least(1, greatest(0, reward)) + 0.30 * (CASE WHEN export_count <= 0 THEN 0 ELSE least(1, ln(1 + export_count) / ln(101)) END) + 0.1 + 0.15 / (1 + greatest(0, (epoch(TIMESTAMP '{derive.NOW}') - created_at) / 86400) * 0.05) + 1e-9, 4)::DOUBLE AS gdi_score FROM hw",
        "j1_prompts": _S
        + f"""SELECT traj_id, ord, CASE WHEN user_id % 2 = 0 THEN 'You judge one step of an agent that prepares advice.' ELSE 'You judge one step of an agent that works on code.' END || chr(10) || 'Task: (no description)' || chr(10) || 'Step: ' || (ord + 1) || '/9' || chr(10) || 'Tool: ' || tool || chr(10) || 'Parameters: ' || params_text || chr(10) || 'Output: '
  || CASE WHEN length(repeat(output, 120)) > 2000 THEN left(repeat(output, 120), 2000) || chr(10) || '... (truncated)' ELSE repeat(output, 120) END || chr(10) || 'Before:' || chr(10) || '(first step)' || chr(10) || 'Rubrics, each from 0 to 1:{rubric_text}' || chr(10) || 'Reply with JSON alone: {{"scores": {{"rubric": score}}, "rationale": "..."}}' AS prompt FROM b""",
        "j3_contexts": _S
        + """, q AS (SELECT *, 'Step ' || (ord + 1) || ': ' || tool || CASE WHEN k % 3 > 0 THEN printf(' -> score=%.2f', round(value / 100 + 1e-9, 2)) ELSE ' (skipped)' END AS line FROM b)
SELECT traj_id, ord, coalesce((SELECT string_agg(line, chr(10) ORDER BY p.ord) FROM q p WHERE p.traj_id = q.traj_id AND p.ord >= q.ord - 5 AND p.ord < q.ord), '') AS context FROM q""",
        "j4_scores": f"SELECT o_orderkey, {_SPLIT}::DOUBLE AS goal, (CASE WHEN o_orderkey % 5 < 3 THEN 1.0 ELSE 0.5 END)::DOUBLE AS tool, 0.5::DOUBLE AS late, round((0.5::DOUBLE * {_SPLIT}::DOUBLE + 0.3::DOUBLE * (CASE WHEN o_orderkey % 5 < 3 THEN 1.0 ELSE 0.5 END)::DOUBLE + 0.1::DOUBLE), 6) AS score FROM orders",
        "j5_without_judge": _S + "SELECT traj_id, ord, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b FROM b",
        "pg2_rationales": _OUT
        + """SELECT task_id, chosen, rejected, round(m, 6) AS margin, concat_ws('; ', printf('chosen scored %.3f vs rejected %.3f (margin=%.3f)', round(ar + 1e-9, 3), round(br + 1e-9, 3), round(m + 1e-9, 3)), CASE WHEN an < bn THEN printf('chosen used fewer steps (%d vs %d)', an, bn) WHEN an > bn THEN printf('chosen used more steps (%d vs %d) but achieved higher quality', an, bn) END,
  CASE WHEN a.success > b2.success THEN 'chosen had better task outcome' WHEN a.success = b2.success THEN 'both had same outcome, but chosen had better process quality' END, CASE WHEN a.user_id % 2 = 0 THEN 'chosen: ' || a.agent_model END, CASE WHEN b2.user_id % 2 = 0 THEN 'rejected: ' || b2.agent_model END) AS rationale
FROM oi JOIN (SELECT traj_id AS chosen, success, user_id, agent_model FROM w) a USING (chosen) JOIN (SELECT traj_id AS rejected, success, user_id, agent_model FROM w) b2 USING (rejected)""",
        "pg4_by_description": _R + ", ny AS (SELECT 'Mend module ' || (user_id % 50) AS description, traj_id, reward, lead(traj_id) OVER o AS n_id, lead(reward) OVER o AS n_reward FROM w WINDOW o AS (PARTITION BY user_id % 50 ORDER BY reward DESC, traj_id)) SELECT description, traj_id AS chosen, n_id AS rejected, round(reward - n_reward + 1e-9, 6) AS margin FROM ny WHERE reward <> n_reward",
        "pg5_requests": _R
        + """, q AS (SELECT * FROM w WHERE reward BETWEEN 0.3 AND 0.7 AND task_id <> '' ORDER BY task_id, reward DESC, traj_id LIMIT 1000), q2 AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS c2 FROM q),
q3 AS (SELECT *, lead(traj_id) OVER o AS n_id FROM q2 WHERE c2 >= 2 WINDOW o AS (PARTITION BY task_id ORDER BY reward DESC, traj_id)), q4 AS (SELECT *, (SELECT count(*) FROM q3 WHERE n_id IS NOT NULL) AS cand FROM q3 WHERE n_id IS NOT NULL ORDER BY task_id, traj_id LIMIT 10),
sm AS (SELECT traj_id, string_agg('Step ' || (ord + 1) || ': -> ' || tool, chr(10) ORDER BY ord) AS summary FROM b WHERE ord < 3 GROUP BY traj_id)
SELECT q4.traj_id AS chosen, n_id AS rejected, left('Which answer of ' || employee || ' is better? (task: ' || left('Task ' || task_id, 50) || ')', 200) AS title, left('## Task' || chr(10) || 'Task ' || task_id || chr(10) || chr(10) || '## A' || chr(10) || s1.summary || chr(10) || chr(10) || '## B' || chr(10) || s2.summary, 2000) AS description, (cand - least(10, cand))::INT AS skipped FROM q4 JOIN sm s1 ON s1.traj_id = q4.traj_id JOIN sm s2 ON s2.traj_id = n_id""",
        "pg8_groups": _TEXT + ", rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, traj_id) AS rn, count(*) OVER (PARTITION BY task_id) AS n FROM w) SELECT task_id, 'Solve task: ' || task_id AS prompt, least(n, 4) AS n, rn, traj_id, text AS response, reward FROM rk JOIN x USING (traj_id) WHERE n >= 2 AND rn <= 4",
        "pg9_all_members": _TEXT + ", rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, traj_id) AS rn, count(*) OVER (PARTITION BY task_id) AS n FROM w) SELECT task_id, 'Mend ' || task_id AS prompt, n, rn, traj_id, text AS response, reward FROM rk JOIN x USING (traj_id) WHERE n >= 2",
        "pg10_benchmark": _R + "SELECT task_id, '' AS description, 'unknown' AS difficulty, string_agg(agent_model || ':' || printf('%.6f', reward) || ':' || (success = 1)::VARCHAR || ':' || n_steps, ';' ORDER BY traj_id) AS runs, round(min(reward), 2) AS low, round(max(reward), 2) AS high FROM w GROUP BY task_id",
        "pg13_resume": "SELECT c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
        "pg15_agreed": "SELECT o_orderkey, 'majority' AS consensus, o_custkey % 4 AS responses FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 >= 2",
        "d2_content_hash": _S
        + r""", q AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 'line1\nline2\ttab \"quoted\" back\\slash' WHEN 1 THEN 'bell\u0007 é 漢' WHEN 2 THEN '' ELSE output END AS escaped FROM b)
SELECT traj_id, left(sha256('[' || string_agg('{"output": "' || escaped || '", "params": {"path": "' || target || '"}, "tool": "' || tool || '"}', ', ' ORDER BY ord) || ']'), 16) AS content_hash FROM q GROUP BY traj_id""",
        "a4_episodes": _R + f", m AS ({_EPISODE}) SELECT n, bin0, bin1, bin2, bin3, {_SUMMARY} FROM m",
        "a5_comparison": board.replace("WITH ", "WITH ", 1)
        + ", bd AS (SELECT *, row_number() OVER (ORDER BY avg_reward DESC, agent_model) AS place FROM q), pw AS ("
        + welch.replace("WITH ", "WITH ", 1)
        + ") SELECT bd.*, (SELECT count(*) FROM pw WHERE (a = agent_model OR b = agent_model) AND significant) AS differs, (SELECT count(*) FROM pw WHERE (a = agent_model OR b = agent_model) AND significant_corrected) AS differs_corrected FROM bd",
        "a7_scored_files": _R + "SELECT task_id, round(avg(reward), 6) AS avg_reward, row_number() OVER (ORDER BY round(avg(reward), 6) DESC, task_id) AS place FROM w GROUP BY task_id",
        "a8_validation": """WITH q AS (SELECT count(*) AS total, count(*) FILTER (trim(coalesce(instruction, '')) = '') AS no_instruction, count(*) FILTER (trim(coalesce(response, '')) = '') AS no_response, min(length(coalesce(response, ''))) AS min_length, max(length(coalesce(response, ''))) AS max_length,
  round(avg(length(coalesce(response, ''))), 2) AS avg_length, count(*) FILTER (length(coalesce(response, '')) > 16384) AS too_long, count(*) FILTER (isnan(reward)) AS bad_reward, count(*) FILTER (reward = 0) AS zero_reward FROM sft_records)
SELECT *, total > 0 AND no_instruction / total <= 0.05 AND no_response / total <= 0.05 AND bad_reward = 0 AS valid FROM q""",
        "a8_trajectories": """WITH q AS (SELECT count(*) AS total, count(*) FILTER (coalesce(task_id, '') = '') AS no_task_id, count(*) FILTER (coalesce(total_steps, 0) <= 0) AS no_steps, count(*) FILTER (success IS NULL) AS no_success, count(*) FILTER (reward IS NULL) AS no_reward, count(*) FILTER (isnan(reward)) AS nan, count(*) FILTER (isinf(reward)) AS infinite,
  coalesce(bool_and(reward = 0) FILTER (reward IS NOT NULL AND NOT isnan(reward) AND NOT isinf(reward)), false) AS all_zero, min(length(coalesce(data, ''))) FILTER (total_steps > 0) AS min_length, max(length(coalesce(data, ''))) FILTER (total_steps > 0) AS max_length, round(avg(length(coalesce(data, ''))) FILTER (total_steps > 0), 2) AS avg_length, count(*) FILTER (total_steps > 0 AND length(coalesce(data, '')) > 16384) AS too_long FROM trajectories),
i AS (SELECT *, concat_ws('; ', CASE WHEN no_task_id / total > 0.05 THEN 'task_id missing in ' || printf('%.1f%%', 100 * round(no_task_id / total, 6)) END, CASE WHEN no_steps / total > 0.05 THEN 'steps missing in ' || printf('%.1f%%', 100 * round(no_steps / total, 6)) END, CASE WHEN no_success / total > 0.05 THEN 'success missing in ' || printf('%.1f%%', 100 * round(no_success / total, 6)) END,
  CASE WHEN no_reward / total > 0.05 THEN 'reward missing in ' || printf('%.1f%%', 100 * round(no_reward / total, 6)) END, CASE WHEN nan > 0 THEN nan || ' rewards are NaN' END, CASE WHEN infinite > 0 THEN infinite || ' rewards are infinite' END, CASE WHEN too_long > 0 THEN too_long || ' texts are too long' END, CASE WHEN no_steps > 0 THEN no_steps || ' without steps' END, CASE WHEN all_zero THEN 'all rewards are 0' END) AS issues FROM q) SELECT *, issues = '' AS valid FROM i""",
        "a8_pairs": _PAIR3 + "SELECT count(*) AS total, count(*) FILTER (margin > 0.2) AS no_chosen, 0::BIGINT AS no_rejected, count(*) FILTER (margin < 0) AS negative, coalesce(bool_and(margin = 0), false) AS all_zero, round(min(margin), 6) AS min_margin, round(max(margin), 6) AS max_margin, round(avg(margin), 6) AS mean_margin, count(*) > 0 AND count(*) FILTER (margin > 0.2) = 0 AND count(*) FILTER (margin < 0) = 0 AND NOT coalesce(bool_and(margin = 0), false) AS valid FROM pp",
        "a14_counts": _R + "SELECT employee, count(*) AS n FROM w GROUP BY employee",
        "t3_welch": welch.split("SELECT a, b, t, effect, p, significant, CASE")[0].replace("FROM w GROUP BY 1", "FROM w WHERE agent_model IN ('model-0', 'model-1') GROUP BY 1") + "SELECT t, effect, p, significant FROM q3",
        "o7_fitted": _R + ", q AS (SELECT traj_id, list(step_total ORDER BY ord) AS l FROM st GROUP BY traj_id) SELECT traj_id, 5 AS n, round(CASE WHEN len(l) >= 5 THEN l[5] ELSE l[len(l)] END, 6) AS last FROM q",
        "o5_pair_split": _PAIR3 + ", q AS (SELECT chosen, row_number() OVER (ORDER BY md5('42-' || chosen), chosen) AS rn, count(*) OVER () AS n FROM pp) SELECT chosen, CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM q",
        "o6_shuffled": _R + "SELECT traj_id, n_steps - reward AS difficulty, row_number() OVER (ORDER BY md5('3-' || traj_id), traj_id) AS place FROM w",
        "o11_worker_shares": "SELECT w AS worker, (SELECT count(*) FROM customer) // 7 + CASE WHEN w < (SELECT count(*) FROM customer) % 7 THEN 1 ELSE 0 END AS n FROM range(7) r(w)",
        "x8_recorded_steps": _S + "SELECT traj_id, string_agg(tool || ':' || target, ' ' ORDER BY ord) AS steps, arg_max(tool = 'submit', ord) AS success FROM b GROUP BY traj_id",
        "x9_episode_sums": _S + "SELECT traj_id, round(sum(round(value, 2)), 4) AS ret, count(*) AS length, round(epoch(max(ts)) - epoch(min(ts)), 2) AS elapsed FROM b GROUP BY traj_id",
        "x10_flagged": "SELECT DISTINCT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '... [truncated]' ELSE text END AS text, length(text) > 200 AS truncated FROM documents WHERE doc_id IS NOT NULL",
        "x11_flags": _S + "SELECT traj_id, ord, tool = 'submit' AS terminated, ord + 1 >= 4 AS truncated FROM b",
        "x12_iterations": _R + "SELECT regexp_extract(traj_id, 'w([0-9]+)$', 1)::INT AS week, count(*) AS n, round(avg(success), 4) AS success_rate, round(avg(reward), 4) AS avg_return, round(min(reward), 4) AS min_return, round(max(reward), 4) AS max_return, round(avg(n_steps), 4) AS avg_steps FROM w GROUP BY 1",
        "e5_tool_text": _S + "SELECT traj_id, string_agg(concat_ws(chr(10), 'Step ' || (ord + 1) || ':', CASE WHEN k % 2 = 0 THEN 'Thought: hm' END, 'Tool: ' || tool || '(' || params_text || ')', 'Output: ' || CASE WHEN length(repeat(output, 40)) > 500 THEN left(repeat(output, 40), 500) || '...' ELSE repeat(output, 40) END), chr(10) || chr(10) ORDER BY ord) AS text FROM b GROUP BY traj_id",
        "e7_structured": _S + "SELECT traj_id, ord::INT AS ord, '' AS thought, tool || '(' || target || ')' AS action, output AS observation FROM b",
        "e10_summaries": _S + "SELECT traj_id, string_agg('Step ' || (ord + 1) || ':' || CASE WHEN k % 2 = 0 THEN ' hm' ELSE '' END || ' -> ' || tool, chr(10) ORDER BY ord) AS summary FROM b WHERE ord < 3 GROUP BY traj_id",
        "e18_labels": _S + ", q AS (SELECT traj_id, ord, 3 + 7 * ord AS s FROM b), z AS (SELECT traj_id, least(64, 3 + max(7 * (ord + 1))) AS n FROM q GROUP BY traj_id) SELECT traj_id, n::INT AS n_ids, (sum(greatest(0, least(n, s + 3) - least(n, s))))::INT AS n_labels FROM q JOIN z USING (traj_id) GROUP BY traj_id, n",
        "e19_padded": _S + ", q AS (SELECT traj_id, least(6, n_steps) AS n0 FROM trajs) SELECT traj_id, (max(n0) OVER (PARTITION BY left(traj_id, 2)))::INT AS n, n0::INT AS n_real FROM q",
        "g7_chunk_weights": "WITH RECURSIVE " + ORACLES["e16_chunks"].split("WITH RECURSIVE ", 1)[1].rsplit("SELECT traj_id, chunk, min(ord)", 1)[0].rstrip()
        + """, cs AS (SELECT traj_id, chunk, min(ord) AS first_ord, max(ord) AS last_ord, CASE WHEN chunk = 0 THEN 0 ELSE greatest(min(ord) - 1, 0) END AS context_from FROM k GROUP BY traj_id, chunk)
SELECT cs.traj_id, cs.chunk, b.ord::INT AS ord, b.ord < first_ord AS is_context, CASE WHEN b.ord < first_ord THEN 0.0 ELSE round(b.value, 2) END AS reward FROM cs JOIN b ON b.traj_id = cs.traj_id AND b.ord BETWEEN context_from AND last_ord""",
        "g9_sequences": _S + "SELECT traj_id, round(sum(CASE WHEN tool <> 'read_file' AND ord > 0 THEN -value / 100 ELSE 0 END), 6) AS log_prob FROM b GROUP BY traj_id",
        "l1_grpo_loss": _R
        + """, q AS (SELECT round((reward - avg(reward) OVER p) / (stddev_samp(reward) OVER p + 1e-8), 4) AS a, exp(-mean_value / 50 + reward) AS r, -reward + mean_value / 50 AS kl FROM w WINDOW p AS (PARTITION BY task_id) QUALIFY count(*) OVER (PARTITION BY task_id) >= 2),
g AS (SELECT -avg(least(r * a, greatest(0.8, least(1.2, r)) * a)) AS pl, avg(kl) AS kl, avg(r) AS rm, stddev_samp(r) AS rs, avg(a) AS am FROM q) SELECT round(pl + 0.01::DOUBLE * kl, 6) AS loss, round(pl, 6) AS policy_loss, round(kl, 6) AS kl, round(rm, 6) AS ratio_mean, round(rs, 6) AS ratio_std, round(am, 6) AS advantage_mean FROM g""",
        "l2_cross_entropy": _S + "SELECT round(sum(value / 100 * (1 + k % 3)) FILTER (tool <> 'read_file') / count(*) FILTER (tool <> 'read_file'), 6) AS loss FROM b",
        "l3_dpo_loss": "SELECT o_orderkey, round(ln(1 + exp(-0.1::DOUBLE * ((-o_totalprice / 1e5 + 1) - (-(o_custkey % 7) + 2)))), 6) AS loss FROM orders",
        "l4_perplexity": "SELECT round(exp(sum(o_totalprice / 1e5) / sum(o_custkey % 9 + 1)), 6) AS perplexity, round(sum(o_custkey % 2)::DOUBLE / sum(o_custkey % 9 + 1), 6) AS accuracy FROM orders",
        "k6_datacard": _R
        + """, g AS (SELECT count(*) AS n, count(*) FILTER (success = 1) AS ok, avg(reward) AS reward, avg(n_steps) AS steps, (SELECT string_agg(agent_model, ', ' ORDER BY agent_model) FROM (SELECT DISTINCT agent_model FROM w)) AS models FROM w)
SELECT '# Agent trajectories' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|---|---|' || chr(10) || '| Total trajectories | ' || n || ' |' || chr(10) || '| Successful | ' || ok || ' |' || chr(10) || '| Success rate | ' || printf('%.1f%%', round(ok * 100.0::DOUBLE / n + 1e-9, 1)) || ' |' || chr(10) || '| Average reward | ' || printf('%.3f', round(reward + 1e-9, 3)) || ' |' || chr(10) || '| Average steps | ' || printf('%.1f', round(steps + 1e-9, 1)) || ' |' || chr(10) || '| Agent models | ' || models || ' |' || chr(10) || '| Agent frameworks | derived |' AS card FROM g""",
        "k7_report": _R
        + f", m AS ({_EPISODE}), f AS (SELECT n, bin0, bin1, bin2, bin3, {_SUMMARY} FROM m) SELECT '# Evaluation' || chr(10) || '- success rate ' || {_PC.format('success_rate')} || ' (95% CI ' || {_PC.format('wilson_low')} || ' - ' || {_PC.format('wilson_high')} || ')' || chr(10) || printf('- reward %.3f +- %.3f (95%% CI %.3f - %.3f)', round(mean + 1e-9, 3), round(std + 1e-9, 3), round(ci_low + 1e-9, 3), round(ci_high + 1e-9, 3)) || chr(10) || printf('- rewards [%.3f, %.3f]', round(min + 1e-9, 3), round(max + 1e-9, 3)) || chr(10) || printf('- steps %.1f +- %.1f', round(avg_steps + 1e-9, 1), round(std_steps + 1e-9, 1)) || chr(10) || '- episodes ' || n || chr(10) || '| rewards | episodes | share |' "
        + "".join(f"|| chr(10) || '| {label} | ' || {c} || ' | ' || printf('%.1f%%', round({c} * 100::DOUBLE / n + 1e-9, 1)) || ' |' " for label, c in (("0.00-0.25", "bin0"), ("0.25-0.50", "bin1"), ("0.50-0.75", "bin2"), ("0.75-1.00", "bin3")))
        + "AS report FROM f",
        "k8_comparison": board + ", bd AS (SELECT *, row_number() OVER (ORDER BY avg_reward DESC, agent_model) AS place FROM q), pw AS (" + welch + f") SELECT place, '| ' || place || ' | ' || agent_model || ' | ' || {_PC.format('success_share')} || ' | ' || printf('%.3f', round(avg_reward + 1e-9, 3)) || ' | ' || (SELECT count(*) FROM pw WHERE (a = agent_model OR b = agent_model) AND significant) || ' | ' || (SELECT count(*) FROM pw WHERE (a = agent_model OR b = agent_model) AND significant_corrected) || ' |' AS line FROM bd",
        "k9_batch_numbers": _R + "SELECT count(*) AS n, count(*) FILTER (success = 1) AS succeeded, round(avg(reward), 4) AS avg_reward, count(*) FILTER (reward >= 0.7) AS high FROM w",
    }
