"""The data logic around a model judge; the judge itself is a callable."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a trajectory that are judged at most, and those at each end that always are.
MOST, ENDS = 30, 5


def sampled(ord_: Column, n: Column) -> Column:
    """Whether a step is judged: all of up to 30; else the first and last five and evenly spaced ones between."""
    middle, budget = n - 2 * ENDS, MOST - 2 * ENDS
    stride = F.greatest(F.lit(1), F.floor(middle / (budget + 1)).cast("int"))
    spaced = ((ord_ - ENDS) % stride == 0) & (F.floor((ord_ - ENDS) / stride) < budget)
    return (n <= MOST) | (ord_ < ENDS) | (ord_ >= n - ENDS) | ((ord_ >= ENDS) & spaced)


def fill_with_median(steps: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``filled``: the score, or the upper median of the trajectory's scores where it is null; 0.5 where none is known. The median comes from counts of distinct scores."""
    counts = steps.where(F.col(score).isNotNull()).groupBy("traj_id", score).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("traj_id")
    upto = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    median = upto.where(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy("traj_id").agg(F.min(score).alias("_median"))
    return steps.join(median, "traj_id", "left").withColumn("filled", F.coalesce(score, "_median", F.lit(0.5))).drop("_median")


# What each domain's judge is told about its task; other domains get the first.
_TASKS = {
    "coding": "You judge one step of an agent that works on code.",
    "conversation": "You judge one reply of an agent that talks with a person.",
    "engineering": "You judge one step of an agent that reviews a technical matter.",
    "advisory": "You judge one step of an agent that prepares advice.",
    "discussion": "You judge one contribution of an agent to a discussion.",
}


def judge_prompt(domain: Column, task: Column, tool: Column, params: Column, output: Column, index: Column | None = None, total: Column | None = None, context: Column | None = None, rubrics: list[tuple[str, float]] | None = None) -> Column:
    """The text a judge gets, by domain: task, step and place, tool, parameters, output (cut beyond 2000 characters with a mark), what came before, the rubrics, and the form of the reply."""
    shown = F.when(F.length(output) > 2000, F.concat(F.substring(output, 1, 2000), F.lit("\n... (truncated)"))).otherwise(output)
    filled = lambda c, other: F.coalesce(F.when(c != "", c), F.lit(other))
    told = F.lit(_TASKS["coding"])
    for name, text in _TASKS.items():
        told = F.when(domain == name, text).otherwise(told)
    place = F.concat(F.lit("\nStep: "), index.cast("string"), F.lit("/"), total.cast("string")) if index is not None and total is not None else F.lit("")
    before = F.concat(F.lit("\nBefore:\n"), filled(context, "(first step)")) if context is not None else F.lit("")
    listed = "".join(f"\n- {i} (weight {w})" for i, w in rubrics or ())
    return F.concat(told, F.lit("\nTask: "), filled(task, "(no description)"), place, F.lit("\nTool: "), filled(tool, "unknown"), F.lit("\nParameters: "), filled(params, "{}"), F.lit("\nOutput: "), F.coalesce(shown, F.lit("")), before, F.lit(f"\nRubrics, each from 0 to 1:{listed}" if listed else ""), F.lit('\nReply with JSON alone: {"scores": {"rubric": score}, "rationale": "..."}'))


def judge_context(steps: DataFrame, keep: int = 5) -> DataFrame:
    """Adds ``context``: the last ``keep`` steps before each, one a line, with their score or as skipped where it is null. Needs traj_id, ord, tool and score."""
    line = F.concat(F.lit("Step "), (F.col("ord") + 1).cast("string"), F.lit(": "), F.coalesce(F.when(F.col("tool") != "", F.col("tool")), F.lit("unknown")), F.when(F.col("score").isNull(), " (skipped)").otherwise(F.concat(F.lit(" -> score="), F.format_string("%.2f", "score"))))
    before = Window.partitionBy("traj_id").orderBy("ord").rowsBetween(-keep, -1)
    return steps.withColumn("_line", line).withColumn("context", F.array_join(F.collect_list("_line").over(before), "\n")).drop("_line")


def weighted_score(scores: Column, rubrics: list[tuple[str, float]]) -> Column:
    """The weighted mean of an array of scores in the rubrics' order; 0.5 where the weights sum to 0."""
    total = sum(w for _, w in rubrics)
    return sum((F.element_at(scores, i + 1) * w for i, (_, w) in enumerate(rubrics)), F.lit(0.0)) / total if total > 0 else F.lit(0.5)


def parsed_replies(rows: DataFrame, reply: str, rubrics: list[str]) -> DataFrame:
    """Adds ``scores`` of the replies in column ``reply``."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scores_of(t, rubrics))

    return rows.withColumn("scores", F.pandas_udf(run, "array<double>")(reply))


def repaired(text: str) -> dict | None:
    """The JSON object of a reply: as it is, from a fence, from the first brace, or with its end trimmed and closed."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    start = text.find("{")
    for part in (text, fenced and fenced.group(1), start >= 0 and text[start : text.rfind("}") + 1]):
        try:
            if isinstance(found := json.loads(part or ""), dict):
                return found
        except ValueError:
            pass
    if start < 0:
        return None
    body = text[start:]
    for cut in range(min(500, len(body))):
        head = body[: len(body) - cut]
        depth, quoted, skip = [], False, False
        for c in head:
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth.append("}" if c == "{" else "]")
            elif c in "}]" and depth:
                depth.pop()
        try:
            if isinstance(found := json.loads(head.rstrip().rstrip(",") + ('"' if quoted else "") + "".join(reversed(depth))), dict):
                return found
        except ValueError:
            continue
    return None


def scores_of(reply: str | None, rubrics: list[str]) -> list[float]:
    """A score for each rubric of the reply's ``scores``, held to 0..1; 0.5 where it is missing or the reply can't be read."""
    found = (repaired(reply) or {}).get("scores") if reply else None
    if not isinstance(found, dict):
        found = {}
    out = []
    for r in rubrics:
        try:
            out.append(min(1.0, max(0.0, float(found.get(r, 0.5)))))
        except (TypeError, ValueError):
            out.append(0.5)
    return out


def judged(steps: DataFrame, rubrics: list[str], ask: Callable[[str], str] | None = None, tries: int = 3) -> DataFrame:
    """(traj_id, ord, scores): the replies of ``ask`` to ``prompt``; 0.5 for all rubrics without a judge or after ``tries`` failures."""
    if ask is None:
        return steps.select("traj_id", "ord", F.array(*(F.lit(0.5) for _ in rubrics)).alias("scores"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt in b["prompt"]:
                reply = None
                for _ in range(tries):
                    try:
                        reply = ask(prompt)
                        break
                    except Exception:  # noqa: BLE001 - any failure of the outside judge counts as none
                        continue
                out.append(scores_of(reply, rubrics))
            yield pd.DataFrame({"traj_id": b["traj_id"], "ord": b["ord"], "scores": out})

    return steps.select("traj_id", "ord", "prompt").mapInPandas(run, "traj_id string, ord bigint, scores array<double>")
