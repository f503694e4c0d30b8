"""Training samples: token ids, label masks and step weights of conversations, and their padding. The tokenizer is a callable; splitting at blanks is the default."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The label of a token that doesn't count.
IGNORED = -100
Tokenizer = Callable[[str], list[int]]
_SAMPLE = "struct<input_ids:array<int>,labels:array<int>,weights:array<double>>"


def words_tokenizer(text: str) -> list[int]:
    """An id above 0 for each word between blanks; the same word has the same id."""
    return [1 + zlib.crc32(w.encode()) % 30_000 for w in text.split()]


def conversation_text(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}: {content}" for role, content in turns)


def agent_turns(instruction: str, extra: str, steps: list[dict]) -> list[tuple[str, str]]:
    """The user's task, then for each step the assistant's thought and action and the environment's observation as a user turn; empty turns are left out."""
    turns = [("user", f"{instruction}\n\n{extra}" if extra else instruction)]
    for s in steps:
        said = [f"{label}: {s[key]}" for label, key in (("Thought", "thought"), ("Action", "action")) if s[key]]
        if said:
            turns.append(("assistant", "\n".join(said)))
        if s["observation"]:
            turns.append(("user", f"Observation: {s['observation']}"))
    return turns


def boundaries(turns: list[tuple[str, str]], tokenizer: Tokenizer, length: int) -> list[int]:
    """Tokens up to the end of each turn, none above ``length``: the sizes of the prefixes of the conversation."""
    return [min(len(tokenizer(conversation_text(turns[: i + 1]))), length) for i in range(len(turns))]


def masked(turns: list[tuple[str, str]], tokenizer: Tokenizer, most: int, rewards: list[float] | None = None, all_but_first: bool = False) -> dict:
    """Ids of the conversation up to ``most``, labels that count in the assistant's turns (or in all but the first), and weights by the steps' rewards over their mean (1 elsewhere; a mean not above 0 counts as 1)."""
    ids = tokenizer(conversation_text(turns))[:most]
    labels, weights = [IGNORED] * len(ids), [1.0] * len(ids)
    mean = sum(rewards) / len(rewards) if rewards else 1.0
    shares = [r / (mean if mean > 0 else 1.0) for r in rewards or ()]
    at = step = 0
    for (role, _), end in zip(turns, boundaries(turns, tokenizer, len(ids))):
        counts = at > 0 if all_but_first else role == "assistant"
        if counts:
            labels[at:end] = ids[at:end]
        if role == "assistant" and step < len(shares):
            weights[at:end] = [shares[step]] * max(0, end - at)
            step += 1
        at = max(at, end)
    return {"input_ids": ids, "labels": labels, "weights": weights}


def agent_samples(records: DataFrame, most: int = 2048, tokenizer: Tokenizer = words_tokenizer, mask_observations: bool = True) -> DataFrame:
    """Adds input_ids, labels and weights to records with instruction, input, response, steps (thought, action, observation) and step_rewards (null: no weights). A record without steps is a plain pair of task and response."""

    def run(instruction: pd.Series, extra: pd.Series, response: pd.Series, steps: pd.Series, rewards: pd.Series) -> pd.DataFrame:
        out = []
        for i, x, r, s, w in zip(instruction, extra, response, steps, rewards):
            if s is None or not len(s):
                out.append(masked([("user", f"{i or ''}\n\n{x}" if x else i or ""), ("assistant", r or "")], tokenizer, most))
            else:
                out.append(masked(agent_turns(i or "", x or "", list(s)), tokenizer, most, None if w is None else list(w), not mask_observations))
        return pd.DataFrame(out, columns=["input_ids", "labels", "weights"])

    sample = F.pandas_udf(run, _SAMPLE)
    return records.withColumn("_s", sample("instruction", "input", "response", "steps", "step_rewards")).select("*", "_s.*").drop("_s")


def pair_samples(pairs: DataFrame, most: int = 2048, tokenizer: Tokenizer = words_tokenizer) -> DataFrame:
    """Adds chosen_ids, chosen_labels, rejected_ids and rejected_labels to pairs of prompt, chosen and rejected; labels count behind the prompt."""

    def run(prompt: pd.Series, answer: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([masked([("user", p or ""), ("assistant", a or "")], tokenizer, most) for p, a in zip(prompt, answer)], columns=["input_ids", "labels", "weights"])

    sample = F.pandas_udf(run, _SAMPLE)
    out = pairs.withColumn("_c", sample("prompt", "chosen")).withColumn("_r", sample("prompt", "rejected"))
    return out.select(*pairs.columns, *(F.col(f"{s}.{c}").alias(f"{n}_{t}") for s, n in (("_c", "chosen"), ("_r", "rejected")) for c, t in (("input_ids", "ids"), ("labels", "labels"))))


def message_mask(turns: Column) -> Column:
    """Whether each message counts: the assistant's do."""
    return F.transform(turns, lambda m: m["role"] == "assistant")


def chunk_steps(chunks: DataFrame, steps: DataFrame) -> DataFrame:
    """(traj_id, chunk, ord, is_context, reward): the steps of each chunk (traj_id, chunk, first_ord, last_ord, context_from) with its context before them, whose rewards are 0."""
    listed = chunks.select("traj_id", "chunk", "first_ord", F.explode(F.sequence("context_from", "last_ord")).alias("ord"))
    s = steps.select("traj_id", F.col("ord").cast("int").alias("ord"), "reward")
    context = F.col("ord") < F.col("first_ord")
    return listed.join(s, ["traj_id", "ord"]).select("traj_id", "chunk", "ord", context.alias("is_context"), F.when(context, 0.0).otherwise(F.col("reward")).alias("reward"))


def collated(samples: DataFrame, batch: Column, columns: dict[str, float], most: int = 2048) -> DataFrame:
    """The array ``columns`` of each row cut to ``most`` and padded on the right with their values to the longest of its batch; adds attention_mask of the first column, 0 where its padding stands."""
    rows = samples.withColumn("_b", batch)
    for c in columns:
        rows = rows.withColumn(c, F.slice(c, 1, most))
    for c, pad in columns.items():
        length = F.max(F.size(c)).over(Window.partitionBy("_b"))
        kind = rows.schema[c].dataType.elementType.simpleString()
        rows = rows.withColumn("_n", length).withColumn(c, F.concat(c, F.array_repeat(F.lit(pad).cast(kind), F.col("_n") - F.size(c)))).drop("_n")
    first, pad = next(iter(columns.items()))
    return rows.withColumn("attention_mask", F.transform(first, lambda x: (x != pad).cast("int"))).drop("_b")
