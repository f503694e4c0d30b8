"""Training sets: records, splits, chunks, curricula, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import deepjson
from stepweave.functions.text import json_text
from stepweave.operators.ranking import distributed_row_number


def steps_text(steps: DataFrame) -> DataFrame:
    """(traj_id, text): ``Step i:`` with thought, action and observation lines, steps parted by a blank line; empty parts are left out."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"\n{label}: "), c)).otherwise("")
    one = F.concat(F.lit("Step "), (F.col("ord") + 1).cast("string"), F.lit(":"), line("Thought", F.coalesce("thought", F.lit(""))), line("Action", F.coalesce("action", F.lit(""))), line("Observation", F.coalesce("observation", F.lit(""))))
    listed = steps.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))).alias("_s"))
    return listed.select("traj_id", F.array_join(F.transform("_s", lambda s: s["t"]), "\n\n").alias("text"))


def sft_records(trajs: DataFrame, texts: DataFrame) -> DataFrame:
    """(traj_id, instruction, input, response, reward) of the successful trajectories."""
    blank = '{"repo": "", "base_commit": "", "test_command": ""}'
    return trajs.where("success = 1").join(texts, "traj_id").select("traj_id", F.concat(F.lit("Solve task: "), "task_id").alias("instruction"), F.lit(blank).alias("input"), F.col("text").alias("response"), "reward")


def dpo_records(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected, margin) of pairs of trajectories."""
    a, b = (texts.select(F.col("traj_id").alias(n), F.col("text").alias(f"{n}_text")) for n in ("chosen", "rejected"))
    out = pairs.join(a, "chosen").join(b, "rejected")
    return out.select(F.concat(F.lit("Solve the following task:\n\nTask ID: "), "task_id").alias("prompt"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), "margin")


def _of(metadata: str, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}")


def sft_from(trajs: DataFrame, texts: DataFrame) -> DataFrame:
    """(traj_id, instruction, input, response, reward, agent_model, total_steps) of the successful trajectories; the instruction is the description of their ``metadata`` (JSON or null), else the task's name; the input always has its three keys."""
    quoted = lambda key: F.coalesce(_of("metadata", key), F.lit(""))
    text = F.concat(F.lit('{"repo": '), json_text(quoted("repo")), F.lit(', "base_commit": '), json_text(quoted("base_commit")), F.lit(', "test_command": '), json_text(quoted("test_command")), F.lit("}"))
    name = F.coalesce(_of("metadata", "task_description"), F.concat(F.lit("Solve task: "), "task_id"))
    return trajs.where("success = 1").join(texts, "traj_id").select("traj_id", name.alias("instruction"), text.alias("input"), F.col("text").alias("response"), "reward", "agent_model", F.col("n_steps").alias("total_steps"))


def dpo_from(pairs: DataFrame, trajs: DataFrame, texts: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected, margin, chosen_model, rejected_model, chosen_reward, rejected_reward) of pairs; the prompt is the chosen one's ``description`` where it has one, else it names the task."""
    side = lambda n: trajs.join(texts, "traj_id", "left").select(F.col("traj_id").alias(n), F.coalesce("text", F.lit("")).alias(f"{n}_text"), F.col("agent_model").alias(f"{n}_model"), F.col("reward").alias(f"{n}_reward"), *([F.col("description")] if n == "chosen" else []))
    out = pairs.join(side("chosen"), "chosen").join(side("rejected"), "rejected")
    prompt = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.concat(F.lit("Solve the following task:\n\nTask ID: "), "task_id"))
    return out.select(prompt.alias("prompt"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), "margin", "chosen_model", "rejected_model", "chosen_reward", "rejected_reward")


def store_sft_records(store: DataFrame) -> DataFrame:
    """(content_hash, instruction, input, response, task_id, reward, agent_framework, agent_model, total_steps, employee, domain) of the store's successful rows: texts and metadata come from ``data`` (of any depth); the input has only the keys that aren't empty, and is '' without any; data that isn't JSON gives an empty response."""

    def run(texts: pd.Series, tasks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_record(t, k) for t, k in zip(texts, tasks)], columns=["instruction", "input", "response"])

    made = F.pandas_udf(run, "struct<instruction:string,input:string,response:string>")
    rows = store.where("success = 1 AND content_hash IS NOT NULL").withColumn("_r", made("data", "task_id"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("content_hash", "_r.*", blank("task_id"), "reward", blank("agent_framework"), blank("agent_model"), "total_steps", blank("employee"), blank("domain"))


def _record(text: str | None, task: str | None) -> tuple[str, str, str]:
    try:
        root = deepjson.loads(text) if text else None
    except ValueError:
        root = None
    meta = root.get("metadata") if isinstance(root, dict) else None
    meta = meta if isinstance(meta, dict) else {}
    steps = root.get("steps") if isinstance(root, dict) else None
    extra = {k: meta[k] for k in ("repo", "base_commit", "test_command") if meta.get(k)}
    said = meta.get("task_description")
    instruction = said if isinstance(said, str) else f"Solve task: {task or ''}"
    return instruction, deepjson.dumps(extra) if extra else "", steps_as_text(steps if isinstance(steps, list) else [])


def steps_as_text(steps: list) -> str:
    """``Step i:`` with thought, action and observation of steps in any layout; what is empty is left out. An action is its text, else the tool with its parameters as JSON."""

    def called(name: object, params: object) -> str:
        return f"{name}({deepjson.dumps(params)})" if name and params else str(name or "")

    out = []
    for i, s in enumerate((x for x in steps if isinstance(x, dict)), 1):
        call, result = (s.get(k) if isinstance(s.get(k), dict) else {} for k in ("tool_call", "tool_result"))
        action = s.get("action") or called(s.get("tool"), s.get("params")) or called(call.get("name"), call.get("parameters"))
        seen = s.get("observation") or s.get("output") or result.get("output")
        parts = [f"{label}: {v if isinstance(v, str) else deepjson.dumps(v)}" for label, v in (("Thought", s.get("thought")), ("Action", action), ("Observation", seen)) if v]
        out.append("\n".join([f"Step {i}:", *parts]))
    return "\n\n".join(out)


def difficulty_of_patch(patch: Column) -> Column:
    """easy below 10 lines, medium below 50, else hard."""
    lines = F.size(F.split(patch, "\n", -1))
    return F.when(lines < 10, "easy").when(lines < 50, "medium").otherwise("hard")


def split(rows: DataFrame, key: str, ratios: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split``: rows in an order by a seeded hash; every split has int(total x ratio) rows, the last one the rest. The order is found without one task for all rows."""
    shares = ratios or {"train": 0.8, "val": 0.1, "test": 0.1}
    ranked = distributed_row_number(rows.withColumn("_all", F.lit(0)).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))), ["_all"], [F.asc("_h"), F.asc(key)], "_rn")
    total = rows.agg(F.count(F.lit(1))).scalar()
    bound, names, choice = F.lit(0), list(shares), None
    for n in names[:-1]:
        bound = bound + F.floor(total * F.lit(shares[n]))
        choice = F.when(F.col("_rn") <= bound, n) if choice is None else choice.when(F.col("_rn") <= bound, n)
    return ranked.withColumn("split", choice.otherwise(names[-1])).drop("_all", "_h", "_rn")


def curriculum(rows: DataFrame, difficulty: str, key: str, epoch: int, warmup: int = 3, start: float = 0.3, shuffle_seed: int | None = None) -> DataFrame:
    """The easiest max(1, ceil(n x ratio)) rows, the ratio growing over the warm-up epochs; with ``shuffle_seed`` they get a ``place`` in an order by a seeded hash."""
    start, warmup = min(1.0, max(0.1, start)), max(1, warmup)
    ratio = 1.0 if epoch >= warmup else start + (1 - start) * epoch / warmup
    ranked = distributed_row_number(rows.withColumn("_all", F.lit(0)), ["_all"], [F.asc(difficulty), F.asc(key)], "_rn")
    total = rows.agg(F.count(F.lit(1))).scalar()
    kept = ranked.where(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(total * F.lit(ratio)))).drop("_rn")
    if shuffle_seed is None:
        return kept.drop("_all")
    hashed = kept.withColumn("_h", F.md5(F.concat(F.lit(f"{shuffle_seed}-"), F.col(key).cast("string"))))
    return distributed_row_number(hashed, ["_all"], [F.asc("_h"), F.asc(key)], "place").drop("_all", "_h")


def chunks(steps: DataFrame, max_length: int = 2048, prompt_length: int = 0, overlap: int = 1) -> DataFrame:
    """(traj_id, chunk, first_ord, last_ord, context_from): greedy cuts at step borders.

    A trajectory that fits is one chunk; else the budget is max - prompt - 50 (half of max where that isn't above 0), and each chunk but the first has the last ``overlap`` steps before it as context. Needs ord and length. The fold runs inside each trajectory, on its steps' lengths alone.
    """
    budget = max_length - prompt_length - 50
    budget = budget if budget > 0 else max_length // 2
    listed = steps.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "length"))), lambda s: s["length"].cast("bigint")).alias("_l"))

    # The fold keeps the places where chunks begin, not a copy of all steps' chunks: its state grows with the chunks alone.
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("held"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(acc: Column, n: Column) -> Column:
        over = (acc["held"] > 0) & (acc["used"] + n > budget)
        return F.struct(F.when(over, n).otherwise(acc["used"] + n).alias("used"), F.when(over, 1).otherwise(acc["held"] + 1).alias("held"), (acc["at"] + 1).alias("at"), F.when(over, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    total = F.aggregate("_l", F.lit(0).cast("bigint"), lambda a, n: a + n)
    starts = F.when(total + prompt_length <= max_length, F.array().cast("array<int>")).otherwise(F.aggregate("_l", zero, add)["starts"])
    listed = listed.select("traj_id", F.size("_l").alias("_n"), F.concat(F.array(F.lit(0)), starts).alias("_starts"))
    cut = listed.select("traj_id", "_n", "_starts", F.posexplode("_starts").alias("chunk", "first_ord"))
    g = cut.select("traj_id", "chunk", "first_ord", (F.coalesce(F.try_element_at("_starts", F.col("chunk") + 2), F.col("_n")) - 1).alias("last_ord"))
    return g.withColumn("context_from", F.when(F.col("chunk") == 0, 0).otherwise(F.greatest(F.col("first_ord") - overlap, F.lit(0))))


def validate_sft(records: DataFrame, max_length: int = 4096) -> DataFrame:
    """One row: counts of missing fields, lengths, over-long ones, and rewards that are missing, zero or no number; ``valid`` is false for no records or above 5 % missing."""
    gone = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    size = F.length(F.coalesce("response", F.lit("")))
    g = records.agg(F.count(F.lit(1)).alias("total"), gone("instruction").alias("no_instruction"), gone("response").alias("no_response"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.avg(size), 2).alias("avg_length"), F.count_if(size > max_length * 4).alias("too_long"), F.count_if(F.isnan("reward")).alias("bad_reward"), F.count_if(F.col("reward") == 0).alias("zero_reward"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(1.0)) <= 0.05
    return g.withColumn("valid", (F.col("total") > 0) & share("no_instruction") & share("no_response") & (F.col("bad_reward") == 0))


def validate_trajectories(rows: DataFrame, max_length: int = 4096) -> DataFrame:
    """One row over trajectories with task_id, success, reward, n_steps and text_length (characters of actions and observations): missing fields, rewards that are NaN, infinite or all zero, lengths, and the issues in words; ``valid`` is no issue. An empty table is invalid."""
    ok = F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") != float("inf"))
    has = F.coalesce(F.col("n_steps"), F.lit(0)) > 0
    size = F.when(has, F.col("text_length"))
    g = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("task_id", F.lit("")) == "").alias("no_task_id"),
        F.count_if(~has).alias("no_steps"),
        F.count_if(F.col("success").isNull()).alias("no_success"),
        F.count_if(F.col("reward").isNull()).alias("no_reward"),
        F.count_if(F.isnan("reward")).alias("nan"),
        F.count_if(F.abs("reward") == float("inf")).alias("infinite"),
        F.coalesce(F.min(F.when(ok, F.col("reward") == 0)), F.lit(False)).alias("all_zero"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.round(F.avg(size), 2).alias("avg_length"),
        F.count_if(size > max_length * 4).alias("too_long"),
    )
    share = lambda c: F.try_divide(F.col(c), F.col("total"))
    issues = [F.when(F.col("total") == 0, "the set is empty")]
    issues += [F.when(share(c) > 0.05, F.concat(F.lit(f"{c[3:]} missing in "), F.format_string("%.1f%%", 100 * F.round(share(c), 6)))) for c in ("no_task_id", "no_steps", "no_success", "no_reward")]
    issues += [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}"))) for c, text in (("nan", "rewards are NaN"), ("infinite", "rewards are infinite"), ("too_long", "texts are too long"), ("no_steps", "without steps"))]
    issues.append(F.when(F.col("all_zero"), "all rewards are 0"))
    return g.withColumn("issues", F.concat_ws("; ", *issues)).withColumn("valid", F.col("issues") == "")


def validate_dpo(pairs: DataFrame) -> DataFrame:
    """One row over preference pairs (chosen, rejected, margin): sides that are missing, negative margins, margins all zero; any of them, or no pair at all, is an issue."""
    gone = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    g = pairs.agg(F.count(F.lit(1)).alias("total"), gone("chosen").alias("no_chosen"), gone("rejected").alias("no_rejected"), F.count_if(F.col("margin") < 0).alias("negative"), F.coalesce(F.min(F.col("margin") == 0), F.lit(False)).alias("all_zero"), F.round(F.min("margin"), 6).alias("min_margin"), F.round(F.max("margin"), 6).alias("max_margin"), F.round(F.avg("margin"), 6).alias("mean_margin"))
    return g.withColumn("valid", (F.col("total") > 0) & (F.col("no_chosen") == 0) & (F.col("no_rejected") == 0) & (F.col("negative") == 0) & ~F.col("all_zero"))


def tool_steps_text(steps: DataFrame, most: int = 500) -> DataFrame:
    """(traj_id, text): the compact form with ``Tool: name(params)`` and outputs cut to ``most`` characters with dots, steps parted by a blank line."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    shown = F.when(F.length("output") > most, F.concat(F.substring("output", 1, most), F.lit("..."))).otherwise(blank("output"))
    one = F.concat_ws("\n", F.concat(F.lit("Step "), (F.col("ord") + 1).cast("string"), F.lit(":")), F.when(blank("thought") != "", F.concat(F.lit("Thought: "), "thought")), F.when(blank("tool") != "", F.concat(F.lit("Tool: "), "tool", F.lit("("), blank("params_text"), F.lit(")"))), F.when(shown != "", F.concat(F.lit("Output: "), shown)))
    listed = steps.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))).alias("_s"))
    return listed.select("traj_id", F.array_join(F.transform("_s", lambda s: s["t"]), "\n\n").alias("text"))


def trajectory_summaries(steps: DataFrame, most: int = 3) -> DataFrame:
    """(traj_id, summary): ``Step i: thought -> action`` of the first ``most`` steps."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("Step "), (F.col("ord") + 1).cast("string"), F.lit(":"), F.when(blank("thought") != "", F.concat(F.lit(" "), "thought")).otherwise(""), F.when(blank("tool") != "", F.concat(F.lit(" -> "), "tool")).otherwise(""))
    listed = steps.where(F.col("ord") < most).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))).alias("_s"))
    return listed.select("traj_id", F.array_join(F.transform("_s", lambda s: s["t"]), "\n").alias("summary"))


def fitted(values: Column, size: Column) -> Column:
    """An array brought to ``size``: cut, or continued with its last value (0 where it is empty)."""
    last = F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(0.0))
    return F.slice(F.concat(values, F.array_repeat(last, F.greatest(size - F.size(values), F.lit(0)))), F.lit(1), size)


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Right-padded or cut to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
