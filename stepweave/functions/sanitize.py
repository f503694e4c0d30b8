"""Redaction of credentials and the like in log texts, rule after rule."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import deepjson

# Name, pattern and placeholder of the rules, in their order.
RULES = [
    ("api_token_prefix", r"\b(?:sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{36,}|gho_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xoxb-[A-Za-z0-9\-]+|xoxp-[A-Za-z0-9\-]+|AKIA[A-Z0-9]{16})\b", "[REDACTED_TOKEN]"),
    ("credential_assignment", r"(?i)((?:password|passwd|token|secret|api_?key|access_?key|auth)\s*[=:]\s*['\"]?)[A-Za-z0-9_/+\-.]{8,}", "$1[REDACTED_CREDENTIAL]"),
    ("long_random_string", r"\b[A-Za-z0-9_+\-]{32,}\b", "[REDACTED_TOKEN]"),
    ("id_card", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b", "[REDACTED_ID_CARD]"),
    ("phone", r"\b1[3-9]\d{9}\b", "[REDACTED_PHONE]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("bank_card", r"\b(?:6[0-9]{15,18}|4[0-9]{15,18}|5[1-5][0-9]{14,17}|3[47][0-9]{13,16})\b", "[REDACTED_BANK_CARD]"),
    ("internal_ip", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", "[REDACTED_INTERNAL_IP]"),
    ("internal_url", r"https?://[A-Za-z0-9.\-]*(?:internal|intranet|local|corp|private|staging|dev\.)[A-Za-z0-9.\-]*(?::\d+)?(?:/[^\s]*)?", "[REDACTED_INTERNAL_URL]"),
]


def sanitized(text: Column) -> Column:
    """The text after all rules, each over the result of the ones before."""
    for _, pattern, placeholder in RULES:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


_AUDIT = "array<struct<rule:string,original:string,replacement:string,position:int>>"
#: Characters of an original that an audit keeps, and entries that a trajectory's keeps.
ORIGINAL, ENTRIES = 100, 100


def _compiled() -> list[tuple[str, re.Pattern, str]]:
    return [(n, re.compile(p), r.replace("$1", "")) for n, p, r in RULES]


def redact(text: str, rules: list[tuple[str, re.Pattern, str]]) -> tuple[str, list[tuple[str, str, str, int]]]:
    """The text after all rules, and (rule, original, replacement, position in the text as the rule found it) of every hit. Of an assignment only the value is the original, and it keeps its name before it."""
    log = []
    for name, pattern, shown in rules:
        parts, at = [], 0
        for m in pattern.finditer(text):
            start = m.end(1) if pattern.groups else m.start()
            log.append((name, text[start : m.end()][:ORIGINAL], shown, start))
            parts += [text[at:start], shown]
            at = m.end()
        text = "".join([*parts, text[at:]])
    return text, log


def audit(text: Column) -> Column:
    """array of struct(rule, original, replacement, position) of all that ``sanitized`` replaces, in its order."""

    def run(texts: pd.Series) -> pd.Series:
        rules = _compiled()
        return texts.map(lambda t: redact(t, rules)[1] if t else [])

    return F.pandas_udf(run, _AUDIT)(text)


def sanitize_trajectories(trajs: DataFrame, data: str = "data") -> DataFrame:
    """(..., data, total_redacted, entries): the JSON of trajectories with the texts of their steps redacted (thoughts, outputs of either layout, strings of parameters at any depth, the task's description), the number of hits and the first ENTRIES of them as (step_id, field, rule, original, replacement). What isn't JSON is redacted as one text; null stays null."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rules = _compiled()
        return pd.DataFrame([_trajectory(t, rules) for t in texts], columns=["data", "total_redacted", "entries"])

    kind = "struct<data:string,total_redacted:int,entries:array<struct<step_id:string,field:string,rule:string,original:string,replacement:string>>>"
    return trajs.withColumn("_s", F.pandas_udf(run, kind)(data)).drop(data).select("*", "_s.*").drop("_s")


def _trajectory(text: str | None, rules: list) -> tuple[str | None, int, list]:
    if text is None:
        return None, 0, []
    entries: list[tuple] = []

    def plain(value: str, step: object, field: str) -> str:
        value, log = redact(value, rules)
        entries.extend((None if step is None else str(step), field, *e[:3]) for e in log)
        return value

    try:
        root = deepjson.loads(text)
    except ValueError:
        return plain(text, None, "text"), len(entries), entries[:ENTRIES]
    steps = root.get("steps") if isinstance(root, dict) else root
    for step in steps if isinstance(steps, list) else ():
        if not isinstance(step, dict):
            continue
        call, result = step.get("tool_call"), step.get("tool_result")
        for holder, key, field in ((step, "thought", "thought"), (result, "output", "tool_output"), (step, "output", "output")):
            if isinstance(holder, dict) and isinstance(holder.get(key), str):
                holder[key] = plain(holder[key], step.get("step_id"), field)
        for holder, key in ((call, "parameters"), (step, "params")):
            if isinstance(holder, dict) and isinstance(holder.get(key), dict):
                deepjson.map_strings(holder[key], lambda v: plain(v, step.get("step_id"), "params"))
    task = root.get("task") if isinstance(root, dict) else None
    if isinstance(task, dict) and isinstance(task.get("description"), str):
        task["description"] = plain(task["description"], None, "task.description")
    return deepjson.dumps(root), len(entries), entries[:ENTRIES]


def sanitize_full(text: Column, soft: Callable[[str], str] | None = None, most: int = 4000, least: int = 10) -> Column:
    """The rules, then a model's redaction of the first ``most`` characters where one is given; texts below ``least`` characters and failures stay as the rules left them."""
    hard = sanitized(text)
    if soft is None:
        return hard

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or len(t) < least:
                return t
            try:
                return soft(t[:most]) + t[most:]
            except Exception:  # noqa: BLE001 - any failure of the outside model leaves the text
                return t

        return texts.map(one)

    return F.pandas_udf(run, "string")(hard)


def sanitized_json(text: Column) -> Column:
    """JSON of any depth with every string in it redacted; text that isn't JSON is redacted as text."""
    rules = [(re.compile(p), r.replace("$1", r"\1")) for _, p, r in RULES]

    def plain(s: str) -> str:
        for p, r in rules:
            s = p.sub(r, s)
        return s

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return deepjson.dumps(deepjson.map_strings(deepjson.loads(t), plain))
            except ValueError:
                return plain(t)

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)
