"""Adapters: logs of several tools to step rows. An adapter is a function from event rows to step rows, registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave import dims

_ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_adapter(name: str, adapter: Callable[[DataFrame], DataFrame]) -> None:
    _ADAPTERS[name] = adapter


def get_adapter(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name!r}; there are {', '.join(list_adapters())}")
    return _ADAPTERS[name]


def list_adapters() -> list[str]:
    return sorted(_ADAPTERS)


def _mapped(names: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), c), c)


_EVENT = ("source", "action", "observation", "args", "content", "thought", "timestamp", "extras")


def _order() -> Window:
    """Events of a log by id; different events under one id by arrival."""
    return Window.partitionBy("log_id").orderBy("id", "received_at", F.coalesce("content", F.lit("")), F.coalesce("args", F.lit("")))


def event_log(messages: DataFrame) -> DataFrame:
    """Events of the ``messages`` layout: deliveries of the same event are one, the first received; different events under one id all stay, and so do events without an id. Speakers lose case and surrounding blanks; rows without a log are left out."""
    rows = messages.where("log_id IS NOT NULL").select("log_id", "id", *_EVENT, "received_at").withColumn("_e", F.to_json("extras"))
    same = ["log_id", "id", *(c for c in _EVENT if c != "extras"), "_e"]
    one = rows.groupBy(*same).agg(F.min("received_at").alias("received_at"), F.first("extras", ignorenulls=True).alias("extras"))
    return one.drop("_e").withColumn("source", F.lower(F.trim("source")))


def valid_event_logs(events: DataFrame) -> DataFrame:
    """(log_id, valid): whether the first event of a log has an action or an observation."""
    first = events.withColumn("_rn", F.row_number().over(_order())).where("_rn = 1")
    return first.select("log_id", (F.col("action").isNotNull() | F.col("observation").isNotNull()).alias("valid"))


def openhands_steps(events: DataFrame) -> DataFrame:
    """(log_id, step_id, tool, params, thought, output, exit_code, error, timestamp, token_count): an observation pairs with the event right before it that has an action or observation, if that is a real action and not a user's, message or finish. A timestamp that is missing stays null, as there is no clock that would give the same twice."""
    kept = events.where("action IS NOT NULL OR observation IS NOT NULL OR source = 'user'")
    before = F.lag(F.struct("source", "action", "thought", "args", "timestamp", F.col("extras.token_count").alias("tokens"))).over(_order())
    paired = kept.withColumn("_b", before).where(F.col("observation").isNotNull() & F.col("action").isNull() & F.col("_b.action").isNotNull() & ~F.col("_b.action").isin("message", "finish") & ~F.col("_b.source").eqNullSafe("user"))
    return paired.select(
        "log_id",
        (F.row_number().over(_order()) - 1).alias("step_id"),
        _mapped(dims.OPENHANDS_TOOLS, F.col("_b.action")).alias("tool"),
        F.coalesce("_b.args", F.lit("{}")).alias("params"),
        F.coalesce("_b.thought", F.lit("")).alias("thought"),
        F.coalesce("content", F.lit("")).alias("output"),
        F.coalesce("extras.exit_code", F.lit(0)).alias("exit_code"),
        F.col("extras.error").alias("error"),
        F.col("_b.timestamp").alias("timestamp"),
        F.col("_b.tokens").alias("token_count"),
    )


def openhands_outcome(events: DataFrame) -> DataFrame:
    """(log_id, events, finished, success, tests_passed, tests_failed, total_steps, total_tokens): as the first finish says (its test result, else its success), else whether a run before it ended with 0 and says that tests passed; tokens are those of the steps."""
    e = events.withColumn("_rn", F.row_number().over(_order()))
    said = lambda path: F.get_json_object("args", f"$.outputs.{path}")
    tested = said("test_result").isNotNull()
    result = F.struct(F.when(tested, F.coalesce(said("test_result.success"), F.lit("false"))).otherwise(said("success")).alias("success"), F.coalesce(said("test_result.tests_passed").cast("int"), F.lit(0)).alias("passed"), F.coalesce(said("test_result.tests_failed").cast("int"), F.lit(0)).alias("failed"))
    finish = e.where("action = 'finish'").groupBy("log_id").agg(F.min("_rn").alias("_finish"), F.min_by(result, "_rn").alias("_said"))
    e = e.join(finish, "log_id", "left")
    passed = (F.col("observation") == "run") & (F.col("extras.exit_code") == 0) & F.col("content").rlike("passed|PASSED") & (F.col("_finish").isNull() | (F.col("_rn") < F.col("_finish")))
    g = e.groupBy("log_id").agg(F.count(F.lit(1)).alias("events"), F.max(F.col("_finish").isNotNull()).alias("finished"), F.max(F.coalesce(passed, F.lit(False))).alias("_passed"), F.max("_said").alias("_said"))
    steps = openhands_steps(events).groupBy("log_id").agg(F.count(F.lit(1)).alias("total_steps"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return g.join(steps, "log_id", "left").select("log_id", "events", "finished", F.coalesce(F.col("_said.success") == "true", F.col("_passed")).alias("success"), none("_said.passed").alias("tests_passed"), none("_said.failed").alias("tests_failed"), none("total_steps").alias("total_steps"), none("total_tokens").alias("total_tokens"))


def openhands_trajectories(events: DataFrame) -> DataFrame:
    """One recorder trajectory a log: task, agent, model, steps in order, outcome and metadata."""
    step = F.struct("step_id", "thought", F.struct(F.col("tool").alias("name"), F.col("params").alias("parameters")).alias("tool_call"), F.struct("output", "exit_code", "error").alias("tool_result"), "timestamp", "token_count")
    steps = openhands_steps(events).groupBy("log_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    meta = openhands_metadata(events)
    outcome = F.struct("success", "tests_passed", "tests_failed", "total_steps", "total_tokens")
    joined = openhands_outcome(events).select("log_id", outcome.alias("outcome")).join(meta, "log_id").join(steps, "log_id", "left")
    task = F.struct(F.coalesce("instance_id", "log_id").alias("task_id"), F.coalesce("task", F.lit("")).alias("description"))
    metadata = F.to_json(F.struct("instance_id", "max_iterations", "agent_class"))
    return joined.select("log_id", task.alias("task"), F.lit("openhands").alias("agent"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)).alias("steps"), "outcome", metadata.alias("metadata"))


def openhands_metadata(events: DataFrame) -> DataFrame:
    """(log_id, task, model, agent_class, instance_id, max_iterations): the first user message, and of the others the last that isn't empty."""
    events = events.withColumn("_rn", F.row_number().over(_order()))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("_rn")))
    asked = F.when((F.col("source") == "user") & (F.col("action") == "message"), F.col("_rn"))
    text = F.coalesce(F.get_json_object("args", "$.content"), "content")
    flat = events.select("log_id", "_rn", "source", "action", text.alias("text"), "extras.model", "extras.agent_class", "extras.instance_id", "extras.max_iterations")
    return flat.groupBy("log_id").agg(F.min_by("text", asked).alias("task"), *(last(c).alias(c) for c in ("model", "agent_class", "instance_id", "max_iterations")))


def valid_swe(documents: DataFrame) -> DataFrame:
    """(doc, valid): whether a document is a JSON object with a history and info."""
    return documents.select("doc", (F.get_json_object("value", "$.history").isNotNull() & F.get_json_object("value", "$.info").isNotNull()).alias("valid"))


def swe_steps(documents: DataFrame) -> DataFrame:
    """(doc, step_id, tool, params, thought, output, exit_code) of documents (doc, value), whose ``history`` holds [action, observation] pairs: an action is an object with its name under ``action``, or a bare command; think and short entries are left out, ids are dense, and params are all of the action but its name."""
    history = F.from_json(F.get_json_object("value", "$.history"), "array<array<string>>")
    items = documents.select("doc", F.posexplode(history).alias("pos", "p")).where(F.size("p") >= 2)
    act = F.try_element_at("p", F.lit(1))
    fields = F.from_json(act, "map<string,string>")
    is_object = act.startswith("{") & F.try_parse_json(act).isNotNull()
    name = F.when(is_object, F.coalesce(F.get_json_object(act, "$.action"), F.lit("unknown"))).otherwise("bash")
    params = F.when(is_object, F.to_json(F.map_filter(fields, lambda k, _: k != "action"))).otherwise(F.to_json(F.create_map(F.lit("command"), act)))
    rows = items.select("doc", "pos", name.alias("name"), params.alias("params"), F.when(is_object, F.coalesce(F.get_json_object(act, "$.thought"), F.lit(""))).otherwise("").alias("thought"), F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")).alias("output")).where("name <> 'think'")
    failed = F.col("name").isin("bash", "run") & F.col("output").startswith("Error")
    return rows.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).alias("step_id"), _mapped(dims.SWE_TOOLS, F.col("name")).alias("tool"), "params", "thought", "output", F.when(failed, 1).otherwise(0).alias("exit_code"))


def swe_outcome(documents: DataFrame) -> DataFrame:
    """(doc, task_id, description, model, repo, base_commit, success, total_steps, total_tokens): submitted is success; tokens sent and received."""
    of = lambda path: F.get_json_object("value", f"$.{path}")
    number = lambda path: F.coalesce(of(path).cast("bigint"), F.lit(0))
    blank = lambda *c: F.coalesce(*c, F.lit(""))
    steps = swe_steps(documents).groupBy("doc").agg(F.count(F.lit(1)).alias("total_steps"))
    rows = documents.select("doc", blank(of("info.instance_id"), of("instance_id")).alias("task_id"), blank(of("problem_statement")).alias("description"), blank(of("info.model_name"), of("model_name_or_path")).alias("model"), blank(of("info.repo")).alias("repo"), blank(of("info.base_commit")).alias("base_commit"), F.coalesce(of("info.exit_status") == "submitted", F.lit(False)).alias("success"), (number("info.model_stats.tokens_sent") + number("info.model_stats.tokens_received")).alias("total_tokens"))
    return rows.join(steps, "doc", "left").fillna(0, ["total_steps"])


def valid_crew(events: DataFrame) -> DataFrame:
    """(session, valid): the first event is a start with a session type, and an assistant says something later."""
    first = F.min_by(F.struct("event", "session_type"), "ord")
    g = events.groupBy("session").agg(first.alias("f"), F.max((F.col("event") == "message") & (F.col("role") == "assistant")).alias("said"))
    return g.select("session", (F.coalesce((F.col("f.event") == "start") & F.col("f.session_type").isNotNull(), F.lit(False)) & F.coalesce("said", F.lit(False))).alias("valid"))


def crew_steps(events: DataFrame) -> DataFrame:
    """(session, kind, step_id, output, success) of valid sessions: pipelines by their paired steps, others by the last answer."""
    kinds = events.groupBy("session").agg(F.coalesce(F.min_by("session_type", "ord"), F.lit("employee")).alias("kind"), F.coalesce(F.min_by("status", F.when(F.col("event") == "end", F.col("ord"))) == "completed", F.lit(False)).alias("success"))
    ok = kinds.join(valid_crew(events).where("valid").select("session"), "session", "left_semi")
    piped = crew_pipeline_steps(events).select("session", "step_id", F.col("content").alias("output")).join(ok.where("kind = 'pipeline'"), "session")
    single = crew_employee_step(events).where("content <> ''").select("session", F.lit(0).alias("step_id"), F.col("content").alias("output")).join(ok.where("kind <> 'pipeline'"), "session")
    return piped.unionByName(single).select("session", "kind", "step_id", "output", "success")


def crew_trajectories(rows: DataFrame) -> DataFrame:
    """Crew trajectories (traj_id, task, agent, model, steps, outcome, metadata JSON) as the store's: framework before the slash of the agent (crew without one), employee from the metadata or behind the slash, source by channel, source or crew, domain by task, metadata or crew."""
    of = lambda key: F.get_json_object("metadata", f"$.{key}")
    slashed = F.contains("agent", F.lit("/"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "traj_id",
        blank("task.task_id").alias("task_id"),
        F.when(slashed, F.split_part("agent", F.lit("/"), F.lit(1))).otherwise("crew").alias("agent_framework"),
        blank("model").alias("agent_model"),
        F.coalesce(F.when(of("employee") != "", of("employee")), F.when(slashed, F.regexp_extract("agent", r"(?s)^[^/]*/(.*)$", 1)), F.lit("")).alias("employee"),
        F.coalesce(of("channel"), of("source"), F.lit("crew")).alias("source"),
        F.coalesce("task.domain", of("domain"), F.lit("crew")).alias("domain"),
        F.coalesce("outcome.total_steps", F.when(F.col("steps").isNull(), 0).otherwise(F.size("steps"))).alias("total_steps"),
        F.coalesce("outcome.success", F.lit(False)).alias("success"),
    )


def crew_pipeline_steps(events: DataFrame) -> DataFrame:
    """(session, step_id, prompt, content): the i-th step event with the i-th assistant event; steps without content are left out, step_id keeps i."""
    w = Window.partitionBy("session").orderBy("ord")
    numbered = lambda role, c: events.where(F.col("role") == role).select("session", (F.row_number().over(w) - 1).alias("step_id"), F.col("content").alias(c))
    return numbered("step", "prompt").join(numbered("assistant", "content"), ["session", "step_id"], "left").where("coalesce(content, '') <> ''")


def crew_employee_step(events: DataFrame) -> DataFrame:
    """(session, content, success): the last assistant message, and whether the first end event says completed."""
    g = events.groupBy("session").agg(F.max_by("content", F.when((F.col("role") == "assistant") & F.col("content").isNotNull(), F.col("ord"))).alias("content"), F.min_by("status", F.when(F.col("event") == "end", F.col("ord"))).alias("_s"))
    return g.where("content IS NOT NULL").select("session", "content", F.coalesce(F.col("_s") == "completed", F.lit(False)).alias("success"))


def normalized_steps(browser: DataFrame) -> DataFrame:
    """(traj_id, ord, tool, params, output, exit_code, thought) of nested recorder steps; missing parts as ''. Rows stored twice count once."""
    one = browser.where("traj_id IS NOT NULL").groupBy("traj_id").agg(F.min_by("steps", F.to_json(F.struct("steps"))).alias("steps"))
    s = one.select("traj_id", F.posexplode("steps").alias("ord", "s"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return s.select("traj_id", "ord", blank(F.col("s.tool_call.name")).alias("tool"), blank(F.col("s.tool_call.parameters")).alias("params"), blank(F.col("s.tool_result.output")).alias("output"), F.coalesce("s.tool_result.exit_code", F.lit(0)).alias("exit_code"), blank(F.col("s.thought")).alias("thought"))


register_adapter("openhands", openhands_steps)
register_adapter("swe-agent", swe_steps)
register_adapter("sweagent", swe_steps)
register_adapter("crew", crew_pipeline_steps)
