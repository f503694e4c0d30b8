"""Dimension data: tools by domain, rubrics, outcome fields, terminal tools."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Domain, tool, category, stateful key and aliases.
TOOLS = [
    ("coding", "read_file", "read", "file_path", ("Read", "cat")),
    ("coding", "edit_file", "write", "file_path", ("Edit", "sed", "write_file", "Write")),
    ("coding", "bash", "execute", None, ("Bash", "shell", "run")),
    ("coding", "grep", "search", None, ("Grep", "Glob", "find", "ls", "search")),
    ("coding", "git", "execute", None, ()),
    ("coding", "ipython", "execute", None, ()),
    ("coding", "submit", "submit", None, ()),
    ("coding", "finish", "submit", None, ()),
    ("coding", "think", "think", None, ()),
    ("browser", "click", "write", "element_id", ("tap",)),
    ("browser", "type_text", "write", "element_id", ("type", "fill", "input")),
    ("browser", "navigate", "navigate", "url", ("goto", "open_url")),
    ("browser", "screenshot", "read", None, ()),
    ("browser", "scroll", "navigate", None, ("scroll_up", "scroll_down")),
    ("browser", "wait", "read", None, ()),
    ("browser", "extract_text", "read", None, ()),
    ("browser", "select", "write", None, ()),
    ("browser", "submit", "submit", None, ()),
    ("conversation", "respond", "write", None, ("reply", "answer")),
    ("conversation", "query_stats", "read", None, ("query", "lookup", "get_stats")),
    ("conversation", "send_message", "write", None, ("message", "notify")),
    ("conversation", "delegate", "execute", None, ("assign", "dispatch")),
    ("conversation", "web_search", "search", None, ("search", "browse")),
    ("conversation", "create_note", "write", None, ("note", "memo")),
    ("conversation", "think", "think", None, ()),
    ("engineering", "read_file", "read", "file_path", ("file_read", "cat")),
    ("engineering", "grep", "search", None, ("glob", "find", "search")),
    ("engineering", "git", "execute", None, ("git_diff", "git_log")),
    ("engineering", "knowledge_base", "read", None, ("kb", "docs")),
    ("engineering", "bash", "execute", None, ("shell", "run")),
    ("engineering", "think", "think", None, ()),
    ("advisory", "respond", "write", None, ("reply", "answer")),
    ("advisory", "knowledge_base", "read", None, ("kb", "docs", "research")),
    ("advisory", "web_search", "search", None, ("search", "browse")),
    ("advisory", "create_note", "write", None, ("note", "memo")),
    ("advisory", "think", "think", None, ()),
    ("discussion", "respond", "write", None, ("reply", "contribute")),
    ("discussion", "knowledge_base", "read", None, ("kb", "reference")),
    ("discussion", "think", "think", None, ()),
    ("crew", "respond", "write", None, ("reply", "answer")),
    ("crew", "read_notes", "read", None, ("read_file", "Read")),
    ("crew", "write_notes", "write", None, ("write_file", "Write", "edit_file", "Edit")),
    ("crew", "web_search", "search", None, ("search", "browse", "WebSearch")),
    ("crew", "web_fetch", "read", None, ("fetch", "WebFetch")),
    ("crew", "bash", "execute", None, ("Bash", "shell", "run")),
    ("crew", "delegate", "execute", None, ("assign", "dispatch", "pull")),
    ("crew", "think", "think", None, ()),
]
# Domains; generic has no tools.
DOMAINS = ("coding", "browser", "conversation", "engineering", "advisory", "discussion", "crew", "generic")
# Rubric set, rubric, weight and evaluator.
RUBRICS = [
    ("default", "goal_progress", 0.3, "model"),
    ("default", "tool_choice", 0.2, "model"),
    ("default", "param_correctness", 0.2, "model"),
    ("default", "info_utilization", 0.15, "rule"),
    ("default", "non_redundancy", 0.15, "rule"),
    ("conversation", "relevance", 0.25, "model"),
    ("conversation", "completeness", 0.2, "model"),
    ("conversation", "clarity", 0.2, "model"),
    ("conversation", "actionability", 0.15, "model"),
    ("conversation", "tone_fit", 0.1, "model"),
    ("conversation", "non_redundancy", 0.1, "rule"),
    ("engineering", "technical_accuracy", 0.3, "model"),
    ("engineering", "tool_usage", 0.2, "model"),
    ("engineering", "thoroughness", 0.2, "model"),
    ("engineering", "info_utilization", 0.15, "rule"),
    ("engineering", "non_redundancy", 0.15, "rule"),
    ("advisory", "analysis_depth", 0.25, "model"),
    ("advisory", "recommendation_quality", 0.25, "model"),
    ("advisory", "evidence_based", 0.2, "model"),
    ("advisory", "risk_awareness", 0.15, "model"),
    ("advisory", "stakeholder_consideration", 0.15, "model"),
    ("discussion", "substantive_contribution", 0.25, "model"),
    ("discussion", "engagement_quality", 0.25, "model"),
    ("discussion", "professional_depth", 0.2, "model"),
    ("discussion", "constructive_challenge", 0.15, "model"),
    ("discussion", "actionability", 0.15, "model"),
]
# Fields of an outcome that hold its score and its total.
OUTCOMES = {"coding": ("tests_passed", "tests_total"), "crew": ("total_steps", "total_tokens")}
# Tools that end an episode; other domains end with submit or finish.
TERMINAL = {"conversation": ("respond",), "engineering": ("submit", "finish"), "advisory": ("submit", "finish"), "discussion": ("respond", "submit")}
# Parameters that may name a target where a tool has no stateful key.
TARGET_KEYS = ("file_path", "path", "url", "element_id")
# Tool names of two log layouts.
OPENHANDS_TOOLS = {"run": "bash", "run_ipython": "ipython", "read": "read_file", "write": "write_file", "browse": "browse_url", "edit": "edit_file", "think": "think"}
SWE_TOOLS = {"bash": "bash", "edit": "edit_file", "open": "read_file", "scroll_up": "read_file", "scroll_down": "read_file", "search_dir": "search", "search_file": "search", "find_file": "search", "create": "write_file", "submit": "submit", "exit": "finish", "think": "think"}


def tool_rows(domain: str | None = None) -> list[tuple[str, str, str, str | None]]:
    """(domain, tool or alias, category, stateful key)."""
    return [(d, n, category, key) for d, tool, category, key, aliases in TOOLS + CUSTOM_TOOLS for n in (tool, *aliases) if domain in (None, d)]


def rubric_rows() -> list[tuple[str, str, float, str]]:
    """(rubric set, id, weight, evaluator)."""
    return RUBRICS + CUSTOM_RUBRICS


def tool_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tool_rows(), "domain string, tool string, category string, stateful_key string")


def rubric_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rubric_rows(), "rubric_set string, rubric_id string, weight double, evaluator string")


def rubric_set_of(domain: str) -> str:
    return domain if domain in {r[0] for r in rubric_rows()} else "default"


def rubric(rubric_set: str, rubric_id: str) -> tuple[str, str, float, str] | None:
    """The rubric of an id in a set, or None."""
    return next((r for r in rubric_rows() if r[:2] == (rubric_set, rubric_id)), None)


def rubric_lines(spark: SparkSession) -> DataFrame:
    """(rubric_set, description): the rubrics of a set as a prompt lists them, in their order."""
    listed = [(s, "\n".join(f"- {i} (weight: {w})" for t, i, w, _ in rubric_rows() if t == s)) for s in dict.fromkeys(r[0] for r in rubric_rows())]
    return spark.createDataFrame(listed, "rubric_set string, description string")


#: Tools and rubrics of profiles that were loaded, in the form of TOOLS and RUBRICS.
CUSTOM_TOOLS: list[tuple[str, str, str, str | None, tuple[str, ...]]] = []
CUSTOM_RUBRICS: list[tuple[str, str, float, str]] = []


def load_profile(spark: SparkSession, path: str) -> str:
    """Reads a domain profile (JSON: domain, tools with name, category, stateful_key, aliases, and perhaps rubrics with id, weight, evaluator) from any file system of the cluster and makes it known under its domain, which is returned; one loaded before under that name is replaced."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    domain = found["domain"]
    if domain in DOMAINS:
        raise ValueError(f"{domain} is a built-in domain")
    CUSTOM_TOOLS[:] = [t for t in CUSTOM_TOOLS if t[0] != domain] + [(domain, t["name"], t.get("category", "other"), t.get("stateful_key") or None, tuple(t.get("aliases", ()))) for t in found.get("tools", ())]
    CUSTOM_RUBRICS[:] = [r for r in CUSTOM_RUBRICS if r[0] != domain] + [(domain, r["id"], float(r["weight"]), r.get("evaluator", "model")) for r in found.get("rubrics", ())]
    return domain


def list_domains() -> list[str]:
    return sorted({*DOMAINS, *(t[0] for t in CUSTOM_TOOLS)})


def profile(domain: str) -> list[tuple[str, str, str | None]]:
    """(tool or alias, category, stateful key) of a domain; an unknown one is generic, where nothing is classified."""
    return [r[1:] for r in tool_rows(domain if domain in list_domains() else "generic")]
