"""Texts of agents: parsing steps and actions, messages, memories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameter that a tool's bare argument fills.
ARGUMENT = {"read_file": "file_path", "file_read": "file_path", "edit_file": "file_path", "bash": "command", "shell": "command", "grep": "pattern", "search": "pattern", "glob": "file_pattern", "respond": "message", "reply": "message", "submit": "conclusion", "finish": "result", "think": "thought", "web_search": "query", "knowledge_base": "query", "query_stats": "query"}
# Words of decisions and of corrections.
DECISION = "决定|统一|不再|确定|方案定|最终选|采用|弃用|禁止"
CORRECTION = "其实|说错了|纠正|更正|之前错|搞错|误解|实际上应该"


def parse_steps(text: Column) -> Column:
    """array of struct(thought, action, observation) of a text with ``Step i:`` headings; steps without thought and action are left out."""
    part = lambda s, name: F.regexp_replace(F.regexp_extract(s, rf"(?is){name}\s*:(.*?)(?=\n\s*(?:thought|action|observation)\s*:|\z)", 1), r"^\s+|\s+$", "")
    bodies = F.filter(F.split(text, r"(?i)step\s+\d+\s*:"), lambda s: F.trim(s) != "")
    steps = F.transform(bodies, lambda s: F.struct(part(s, "thought").alias("thought"), part(s, "action").alias("action"), part(s, "observation").alias("observation")))
    return F.filter(steps, lambda s: (s["thought"] != "") | (s["action"] != ""))


def parse_action(text: Column) -> Column:
    """struct(tool, params, thought): from tags, else a tool with a JSON or bare argument; empty text is a thought."""
    tag = lambda name: F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)
    tool, rest = F.regexp_extract(F.trim(text), r"^(\S+)", 1), F.trim(F.regexp_extract(F.trim(text), r"(?s)^\S+\s+(.*)$", 1))
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ARGUMENT.items() for x in p)), tool), F.lit("input"))
    bare = F.when(rest == "", "{}").when(rest.startswith("{") & F.try_parse_json(rest).isNotNull(), rest).otherwise(F.to_json(F.create_map(name, rest)))
    tagged = tag("action") != ""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.struct(
        F.when(empty, "think").when(tagged, F.trim(tag("action"))).otherwise(tool).alias("tool"),
        F.when(empty, "{}").when(tagged, F.coalesce(F.when(tag("params") != "", tag("params")), F.lit("{}"))).otherwise(bare).alias("params"),
        F.when(tagged, F.trim(tag("thought"))).otherwise("").alias("thought"),
    )


def action_text(thought: Column, tool: Column, params: Column) -> Column:
    """The tags of an action."""
    return F.concat(F.when(thought != "", F.concat(F.lit("<thought>"), thought, F.lit("</thought>\n"))).otherwise(""), F.lit("<action>"), tool, F.lit("</action>"), F.when((params != "") & (params != "{}"), F.concat(F.lit("\n<params>"), params, F.lit("</params>"))).otherwise(""))


def memory_category(text: Column, turn: Column) -> Column:
    """decision, correction or finding (from the third turn on, above 200 characters); null for others."""
    return F.when(text.rlike(DECISION), "decision").when(text.rlike(CORRECTION), "correction").when((turn >= 3) & (F.length(text) > 200), "finding")


def shortened(text: Column, most: int = 8000) -> Column:
    """Cut with a mark that names the length before."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated, "), F.length(text).cast("string"), F.lit(" chars total)"))).otherwise(text)


def messages(instruction: Column, steps: Column) -> Column:
    """array of struct(role, content): the user's turn, then for each step the assistant's thought and action and the user's observation; empty ones are left out."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    said = lambda s: F.concat_ws("\n", F.when(s["thought"] != "", F.concat(F.lit("Thought: "), s["thought"])), F.when(s["action"] != "", F.concat(F.lit("Action: "), s["action"])))
    each = F.flatten(F.transform(steps, lambda s: F.array(turn("assistant", said(s)), turn("user", F.when(s["observation"] != "", F.concat(F.lit("Observation: "), s["observation"])).otherwise("")))))
    return F.filter(F.concat(F.array(turn("user", instruction)), each), lambda m: m["content"] != "")


def messages_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
