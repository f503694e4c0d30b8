"""Rebuilding conversations from message rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.runtime import cut

#: Row ids of one log whose pointers are read in one task. Ids are 32-bit integers, so a log has at most 2**32 / PART parts, however many rows it has.
PART = 65_536
#: Row ids that are contracted to one node before the jumps (see the README for what that saves); 1 makes every row a node.
CHUNK = 16
#: The parent of a row that has none in its log though it needs one.
MISSING = -(2**62)

_BLANK = r"(?U)^\s*$"
_EQUAL_BUT = ("log_id", "id", "source", "action", "observation", "args", "content", "thought", "timestamp", "extras")


def pointer_jump(nodes: DataFrame, keys: Sequence[str], node: str, parent: str, acc: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Follows parent pointers to the roots, doubling the distance in each round.

    ``nodes`` has one row for each ``keys`` and ``node``; ``parent`` is null at a root; ``acc`` is a struct, and ``combine(earlier, later)`` must be associative. Returned are the rows with ``acc`` of the whole path from the root and ``status``: ``ok``, ``orphan`` (the path ends at a parent that isn't there) or ``cycle`` (it hasn't ended when it is longer than its keys have nodes). Null nodes are nobody's parent; null keys join nothing: such rows are orphans unless they are roots. Keys with n nodes take part in the first log2(n) + 1 rounds alone, so a long path costs rounds for itself only; every round is cut.
    """
    plain = [c for c in nodes.columns if c not in (parent, acc)]
    sizes = nodes.groupBy(*keys).agg(F.ceil(F.log2(F.count(F.lit(1)).cast("double") + 1)).cast("int").alias("__rounds"))
    named = [F.col(k).alias(f"__{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    state = nodes.join(sizes.select(*named, "__rounds"), same).drop(*(f"__{k}" for k in keys))
    state = cut(state.withColumn("__to", F.col(parent)).withColumn("status", F.when(F.col("__to").isNull(), "ok")))
    most = state.agg(F.max("__rounds")).first()[0] or 0
    columns, done = [*plain, parent, acc, "status"], []
    for turn in range(1, most + 1):
        waiting = state.where("status IS NULL")
        ahead = state.select(*named, F.col(node).alias("__node"), F.col("__to").alias("__next"), F.col(acc).alias("__acc"), F.col("status").alias("__status"))
        found = F.col("__node").isNotNull()
        moved = waiting.join(ahead, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__to") == F.col("__node")], "left").select(
            *plain,
            parent,
            F.when(found, combine(F.col("__acc"), F.col(acc))).otherwise(F.col(acc)).alias(acc),
            "__rounds",
            F.when(found, F.col("__next")).otherwise(F.col("__to")).alias("__to"),
            F.when(~found, "orphan").otherwise(F.col("__status")).alias("status"),
        )
        state = cut(state.where("status IS NOT NULL").select(*moved.columns).unionByName(moved))
        done.append(state.where(F.col("__rounds") <= turn).select(*columns))
        state = state.where(F.col("__rounds") > turn)
    out = state.select(*columns)
    for part in done:
        out = out.unionByName(part)
    return out.withColumn("status", F.coalesce("status", F.lit("cycle")))


def message_rows(messages: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each log and id: speaker, action, observation, whether it says something, and how many different rows share the id.

    Rows that are equal but for ``received_at`` are one. Speakers lose case and surrounding blanks; blank actions and observations count as missing.
    """
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    spoken = lambda c: F.when(~c.rlike(_BLANK), c)
    text = F.coalesce(spoken(F.get_json_object("args", "$.content")), spoken(F.col("content")))
    same = F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)) if c == "extras" else F.col(c).cast("string"), F.lit("\u0000")) for c in _EQUAL_BUT))
    speaker = F.lower(trimmed(F.col("source")))
    action, observation = spoken(F.col("action")), spoken(F.col("observation"))
    says = F.coalesce((speaker.isin("user", "agent")) & (trimmed(F.col("action")) == "message") & text.isNotNull(), F.lit(False))
    row = messages.where("log_id IS NOT NULL").select("log_id", "id", same.alias("same"), F.struct(speaker.alias("speaker"), trimmed(action).alias("action"), trimmed(observation).alias("observation"), says.alias("says"), *([text.alias("text")] if texts else [])).alias("r"))
    grouped = row.groupBy("log_id", "id").agg((F.min("same") != F.max("same")).alias("shared"), F.max("r.says").alias("said"), F.min_by("r", "same").alias("r"))
    return grouped.select("log_id", F.col("id").cast("bigint").alias("id"), "shared", "said", "r.*")


def _linked(rows: DataFrame) -> DataFrame:
    """Adds ``up``, the id of each row's parent, and its place: part, chunk, first in its chunk, turn of the user inside it.

    The parent is the row before; an observation has one only if that is the agent's action of its name. An observation without it, a row with neither action nor observation and a row without an id point at MISSING; rows that share an id stand for each other and point at themselves; the first row is the root.
    """
    place = lambda n: F.coalesce(F.floor(F.col("id") / n), F.lit(-(2**40)))
    rows = rows.withColumn("part", place(PART)).withColumn("chunk", place(CHUNK))
    w = Window.partitionBy("log_id", "part").orderBy("id")
    own = F.struct("id", "speaker", "action")
    inside = rows.withColumn("before", F.lag(own).over(w))
    # The first row of a part follows the last row of the part before.
    lasts = rows.groupBy("log_id", "part").agg(F.max_by(own, "id").alias("last"))
    lasts = lasts.withColumn("before_part", F.lag("last").over(Window.partitionBy("log_id").orderBy("part"))).select("log_id", "part", "before_part")
    rows = inside.join(lasts, ["log_id", "part"]).withColumn("before", F.coalesce("before", F.when(F.col("id").isNotNull(), F.col("before_part")))).drop("before_part")
    stray = F.col("id").isNull() | (F.col("action").isNull() & F.col("observation").isNull()) | (F.col("observation").isNotNull() & ~_answers(F.col("before"), F.col("observation")))
    up = F.when(F.col("shared"), F.col("id")).when(stray, F.lit(MISSING)).otherwise(F.col("before.id"))
    c = Window.partitionBy("log_id", "part", "chunk").orderBy("id")
    user = ((F.col("speaker") == "user") & (F.col("action") == "message")).eqNullSafe(True)
    return rows.withColumn("up", up).withColumn("is_agent", (F.col("speaker") == "agent").eqNullSafe(True)).withColumn("turn", F.sum(user.cast("int")).over(c.rowsBetween(Window.unboundedPreceding, 0)))


def _answers(before: Column, observation: Column) -> Column:
    """Whether ``before`` is the agent's action of the name of the observation."""
    return ((before["speaker"] == "agent") & (before["action"] == observation)).eqNullSafe(True)


_ACC = "struct<n:bigint, first_says:string, users:boolean, pre_any:boolean, pre_says:boolean, post_any:boolean, post_says:boolean, unanswered:boolean>"


def _combine(a: Column, b: Column) -> Column:
    """The summary of two adjoining parts of a log."""
    both = a["users"] & b["users"]
    gap_any, gap_says = a["post_any"] | b["pre_any"], a["post_says"] | b["pre_says"]
    return F.struct(
        (a["n"] + b["n"]).alias("n"),
        F.coalesce(a["first_says"], b["first_says"]).alias("first_says"),
        (a["users"] | b["users"]).alias("users"),
        F.when(a["users"], a["pre_any"]).otherwise(a["pre_any"] | b["pre_any"]).alias("pre_any"),
        F.when(a["users"], a["pre_says"]).otherwise(a["pre_says"] | b["pre_says"]).alias("pre_says"),
        F.when(b["users"], b["post_any"]).otherwise(a["post_any"] | b["post_any"] | b["pre_any"]).alias("post_any"),
        F.when(b["users"], b["post_says"]).otherwise(a["post_says"] | b["post_says"] | b["pre_says"]).alias("post_says"),
        (a["unanswered"] | b["unanswered"] | (both & gap_any & ~gap_says)).alias("unanswered"),
    ).cast(_ACC)


def log_nodes(rows: DataFrame) -> DataFrame:
    """(log_id, chunk, own_n, acc, status): each node's path from the root of its log, its summary and how it ends.

    A chunk of CHUNK ids whose rows all follow each other is one node, whose parent is the chunk of its first row's parent; if a pointer in it leads nowhere or to itself, so does the node's.
    """
    linked = _linked(rows)
    turns = linked.groupBy("log_id", "part", "chunk", "turn").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("speaker", F.when(F.col("says"), F.col("id"))).alias("first_says"),
        F.max((F.col("up") == MISSING).eqNullSafe(True)).alias("missing"),
        F.max((F.col("up") == F.col("id")).eqNullSafe(True)).alias("itself"),
        F.min(F.floor(F.col("up") / CHUNK)).alias("first_up"),
        F.max("is_agent").alias("any"),
        F.max(F.col("is_agent") & F.col("says")).alias("reply"),
    )
    last = F.max(F.struct("turn", "any", "reply"))
    first_turn = F.col("turn") == 0
    own = (
        turns.groupBy("log_id", "part", "chunk")
        .agg(
            F.sum("n").alias("n"),
            F.min_by("first_says", F.when(F.col("first_says").isNotNull(), F.col("turn"))).alias("first_says"),
            F.max("missing").alias("missing"),
            F.max("itself").alias("itself"),
            F.min("first_up").alias("first_up"),
            (F.max("turn") > 0).alias("users"),
            F.coalesce(F.max(F.when(first_turn, F.col("any"))), F.lit(False)).alias("pre_any"),
            F.coalesce(F.max(F.when(first_turn, F.col("reply"))), F.lit(False)).alias("pre_says"),
            (last["any"] & (last["turn"] > 0)).alias("post_any"),
            (last["reply"] & (last["turn"] > 0)).alias("post_says"),
            F.sum((~first_turn & F.col("any") & ~F.col("reply")).cast("int")).alias("bad"),
            (last["any"] & ~last["reply"] & (last["turn"] > 0)).cast("int").alias("bad_last"),
        )
        .withColumn("unanswered", F.col("bad") > F.col("bad_last"))
    )
    up = F.when(F.col("itself"), F.col("chunk")).when(F.col("missing"), F.lit(MISSING)).when(F.col("first_up") < F.col("chunk"), F.col("first_up"))
    names = ("n", "first_says", "users", "pre_any", "pre_says", "post_any", "post_says", "unanswered")
    nodes = own.select("log_id", "chunk", F.col("n").alias("own_n"), F.struct(*names).cast(_ACC).alias("acc"), up.alias("up"))
    return pointer_jump(nodes, ["log_id"], "chunk", "up", "acc", _combine).drop("up")


def _defects(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(log_id, defect) with a null defect for logs that are whole."""
    leaf = nodes.groupBy("log_id").agg(F.max_by("acc", "chunk").alias("a"), F.max(F.col("status") != "ok").alias("lost"))
    said = rows.groupBy("log_id").agg(F.max("said").alias("said"))
    a = F.col("a")
    defect = (
        F.when(~F.col("said"), "empty")
        .when(F.col("lost") | (a["first_says"] == "agent").eqNullSafe(True), "broken")
        .when(a["unanswered"] | (a["users"] & ~a["post_says"]), "no_reply")
    )
    return leaf.join(said, "log_id").select("log_id", defect.alias("defect"))


def left_out_logs(messages: DataFrame) -> DataFrame:
    """(log_id, defect): a row for each log to be left out, with the first defect of ``empty``, ``broken``, ``no_reply``.

    Rows with a null ``log_id`` belong to no log and are not counted; a null ``id`` has no place and breaks its log; null or unreadable texts say nothing; rows delivered twice count once; an empty table gives no row; columns beyond the table's own are not read. Every log is resolved by its parent pointers (see ``_linked``): a path that ends in an orphan or runs into a cycle breaks its log.
    """
    rows = cut(message_rows(messages))
    return _defects(rows, log_nodes(rows)).where("defect IS NOT NULL")


def conversations(messages: DataFrame) -> DataFrame:
    """(log_id, pos, id, role, kind, name, text): the rows of all whole logs in order, ``pos`` counted from 0 along the path from the root.

    ``role`` is user, agent, system or tool; an observation is the tool's. Nulls and repeats as in ``left_out_logs``.
    """
    rows = cut(message_rows(messages, texts=True))
    nodes = cut(log_nodes(rows.drop("text")))
    whole = _defects(rows, nodes).where("defect IS NULL").select("log_id")
    starts = nodes.join(whole, "log_id").select("log_id", "chunk", (F.col("acc.n") - F.col("own_n")).alias("start"))
    inside = Window.partitionBy("log_id", "chunk").orderBy("id")
    rows = rows.withColumn("chunk", F.floor(F.col("id") / CHUNK))
    tool = F.col("observation").isNotNull()
    return rows.join(starts, ["log_id", "chunk"]).select(
        "log_id",
        (F.col("start") + F.row_number().over(inside) - 1).alias("pos"),
        F.col("id").cast("int").alias("id"),
        F.when(tool, "tool").otherwise(F.col("speaker")).alias("role"),
        F.when(tool, "observation").when(F.col("action") == "message", "message").otherwise("action").alias("kind"),
        F.coalesce("observation", "action").alias("name"),
        "text",
    )
