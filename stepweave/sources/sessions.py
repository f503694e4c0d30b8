"""Session logs: lines of entries with messages in content blocks, to step rows, memories and descriptions of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.functions import agent_text

_ENTRY = "type STRING, agentSetting STRING, sessionId STRING, timestamp STRING, message STRUCT<role: STRING, model: STRING, content: STRING, usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>>"
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
#: Characters of a memory, a description and a session id.
MEMORY, DESCRIPTION, SESSION_ID = 300, 200, 36
#: Names of a roster, at most.
ROSTER = 10_000


def read_sessions(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(file, ord, value): the lines of all session files below ``path`` that were modified after ``since``; files of compacted sessions are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(2**20) + F.monotonically_increasing_id() % F.lit(2**33)).alias("ord"), "value", F.col("_metadata.file_modification_time").alias("_at"))
    lines = lines.where(~F.lower("file").contains("compact"))
    return (lines.where(F.col("_at") > F.lit(since).cast("timestamp")) if since else lines).drop("_at")


def entries(lines: DataFrame) -> DataFrame:
    """(file, ord, entry, is_list, blocks, said): parsed lines; the content of a message is a text or a list of blocks, whose texts ``said`` joins. Lines that aren't JSON are left out."""
    e = lines.where("trim(value) <> ''").where(F.try_parse_json("value").isNotNull()).select("file", "ord", F.from_json("value", _ENTRY).alias("entry"))
    listed = F.coalesce(F.col("entry.message.content").startswith("["), F.lit(False))
    blocks = F.when(listed, F.from_json("entry.message.content", _BLOCKS))
    texts = lambda b: F.array_join(F.transform(F.filter(b, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return e.select("file", "ord", "entry", listed.alias("is_list"), blocks.alias("blocks")).withColumn("said", texts(F.col("blocks")))


def _shortened(text: Column, most: int = 8000) -> Column:
    return agent_text.shortened(F.coalesce(text, F.lit("")), most)


def session_steps(entry_rows: DataFrame) -> DataFrame:
    """(file, step_id, tool, params, thought, output, exit_code, timestamp, token_count): one step for each tool use of an assistant's message, with the last result of its id; a message with text alone is a thinking step. Thought and tokens stand at the first use of a message; thoughts and outputs are cut at 8000 characters with a mark. Ids count from 1."""
    by_role = lambda role: entry_rows.where((F.col("entry.message.role") == role) & F.col("is_list"))
    result = by_role("user").select("file", "ord", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_result' AND b.tool_use_id <> ''")
    shown = F.when(F.col("b.content").startswith("["), F.array_join(F.transform(F.filter(F.from_json("b.content", _BLOCKS), lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")).otherwise(F.col("b.content"))
    result = result.groupBy("file", F.col("b.tool_use_id").alias("id")).agg(F.max_by(F.struct(F.coalesce(shown, F.lit("")).alias("output"), F.coalesce("b.is_error", F.lit(False)).alias("failed")), F.struct("ord", "pos")).alias("r"))
    uses = F.filter("blocks", lambda x: x["type"] == "tool_use")
    tokens = F.coalesce("entry.message.usage.input_tokens", F.lit(0)) + F.coalesce("entry.message.usage.output_tokens", F.lit(0))
    said = by_role("assistant").select("file", "ord", F.coalesce("entry.timestamp", F.lit("")).alias("timestamp"), "said", tokens.alias("tokens"), uses.alias("uses"))
    thinking = said.where((F.size("uses") == 0) & (F.col("said") != "")).select("file", "ord", F.lit(0).alias("pos"), F.lit("thinking").alias("tool"), F.lit("{}").alias("params"), "said", F.lit("").alias("output"), F.lit(0).alias("exit_code"), "timestamp", "tokens")
    used = said.select("file", "ord", "timestamp", "said", "tokens", F.posexplode("uses").alias("pos", "u")).withColumn("id", F.coalesce("u.id", F.lit(""))).join(result, ["file", "id"], "left")
    used = used.select("file", "ord", "pos", F.coalesce("u.name", F.lit("")).alias("tool"), F.coalesce("u.input", F.lit("{}")).alias("params"), "said", F.coalesce("r.output", F.lit("")).alias("output"), F.when(F.col("r.failed"), 1).otherwise(0).alias("exit_code"), "timestamp", "tokens")
    first = F.col("pos") == 0
    return used.unionByName(thinking).select("file", F.row_number().over(Window.partitionBy("file").orderBy("ord", "pos")).alias("step_id"), "tool", "params", _shortened(F.when(first, F.col("said")).otherwise("")).alias("thought"), _shortened(F.col("output")).alias("output"), "exit_code", "timestamp", F.when(first, F.col("tokens")).otherwise(0).alias("token_count"))


def session_heads(entry_rows: DataFrame, names: DataFrame) -> DataFrame:
    """(file, session_id, employee, model, description) by the first entries of each file.

    ``names`` maps (name, employee). The employee is that of the setting among the first five entries, else of the name in the first user text among the first ten, else of a name in the file's own; unknown-agent without any. The description is the first user text, cut; the session's id that of the first five entries, else the file's stem.
    """
    rows = entry_rows.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("ord")))
    text = F.when(~F.col("is_list"), F.col("entry.message.content")).otherwise(F.replace("said", F.lit("\n"), F.lit(" ")))
    user, plain = F.col("entry.type") == "user", F.trim(F.coalesce(text, F.lit("")))
    early = lambda c, n: F.min_by(c, F.when((F.col("rn") <= n) & (c != ""), F.col("rn")))
    g = rows.groupBy("file").agg(
        F.min_by(F.col("entry.agentSetting"), F.when((F.col("rn") <= 5) & (F.col("entry.type") == "agent-setting"), F.col("rn"))).alias("setting"),
        F.min_by(text, F.when((F.col("rn") <= 10) & user, F.col("rn"))).alias("asked"),
        F.min_by(plain, F.when(user & (plain != ""), F.col("rn"))).alias("first"),
        F.min_by(F.col("entry.message.model"), F.when((F.col("entry.message.role") == "assistant") & (F.col("entry.message.model") != ""), F.col("rn"))).alias("model"),
        early(F.col("entry.sessionId"), 5).alias("sid"),
    )
    called = F.regexp_extract("asked", "你是([\\u4e00-\\u9fff]{2,4})", 1)
    known = names.select(F.col("name").alias("_n"), "employee")
    for key, c in (("_by_setting", F.col("setting")), ("_by_call", called)):
        g = g.join(known.select("_n", F.col("employee").alias(key)), F.col("_n") == c, "left").drop("_n")
    # A name may stand anywhere in a file's name or a text, so the roster is looked through; its size is checked first.
    if names.limit(ROSTER + 1).count() > ROSTER:
        raise ValueError(f"a roster has at most {ROSTER} names")
    g = g.withColumn("_names", names.agg(F.array_sort(F.collect_set(F.struct("name", "employee")))).scalar())
    found = lambda where: F.try_element_at(F.transform(F.filter("_names", lambda x: F.contains(where, x["employee"]) | F.contains(where, x["name"])), lambda x: x["employee"]), F.lit(1))
    mentioned = F.try_element_at(F.transform(F.filter("_names", lambda x: F.contains(F.coalesce("asked", F.lit("")), x["employee"])), lambda x: x["employee"]), F.lit(1))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1), "^agent-", "")
    return g.select("file", F.coalesce("sid", F.substring(stem, 1, SESSION_ID)).alias("session_id"), F.coalesce("_by_setting", "_by_call", mentioned, found(F.col("file")), F.lit("unknown-agent")).alias("employee"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce(F.substring("first", 1, DESCRIPTION), F.lit("")).alias("description"))


def memories(turns: DataFrame) -> DataFrame:
    """(session, category, content) of (session, ord, role, text): of each category the session's first assistant text, cut at MEMORY characters with dots; the turn of a text is the number of user turns before it."""
    turn = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("turn", turn).where((F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    rows = rows.withColumn("category", agent_text.memory_category(F.col("text"), F.col("turn"))).where("category IS NOT NULL")
    plain = F.trim("text")
    cut = F.when(F.length(plain) > MEMORY, F.concat(F.substring(plain, 1, MEMORY), F.lit("..."))).otherwise(plain)
    return rows.groupBy("session", "category").agg(F.min_by(cut, "ord").alias("content"))
