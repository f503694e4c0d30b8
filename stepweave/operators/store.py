"""The content-addressed store: hashes, upserts, desirability, statistics."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import deepjson
from stepweave.functions.text import json_text, parse_document, rounded

# Weights of desirability and the decay of freshness by day.
WEIGHTS = {"intrinsic": 0.35, "utility": 0.30, "feedback": 0.20, "freshness": 0.15}
DECAY = 0.05


def flat_content_hash(steps: DataFrame) -> DataFrame:
    """(traj_id, content_hash) of steps with one parameter ``path``: first 16 hex digits of SHA-256 over the canonical JSON of tool, params and output, where a null counts as empty."""
    one = F.concat(F.lit('{"output": '), json_text(F.col("output")), F.lit(', "params": {"path": '), json_text(F.col("target")), F.lit('}, "tool": '), json_text(F.col("tool")), F.lit("}"))
    listed = steps.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("j")))).alias("_s"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_s", lambda s: s["j"]), ", "), F.lit("]"))
    return listed.select("traj_id", F.substring(F.sha2(text, 256), 1, 16).alias("content_hash"))


def content_hash(steps_json: Column) -> Column:
    """The same for the JSON of steps of any depth and any dialect; null where it isn't JSON."""

    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                steps = deepjson.loads(text) if text else None
            except ValueError:
                return None
            steps = steps.get("steps") if isinstance(steps, dict) else steps
            if not isinstance(steps, list):
                return None
            out = []
            for s in (x for x in steps if isinstance(x, dict)):
                call, result = s.get("tool_call") or {}, s.get("tool_result") or {}
                out.append({"tool": s.get("tool") or call.get("name") or "", "params": s.get("params") or call.get("parameters") or {}, "output": s.get("output") or result.get("output") or ""})
            return hashlib.sha256(deepjson.dumps(out, sort_keys=True).encode()).hexdigest()[:16]

        return texts.map(one)

    return F.pandas_udf(run, "string")(steps_json)


def upsert(stored: DataFrame, incoming: DataFrame, order: str = "created_at") -> DataFrame:
    """One row for each content_hash: the first row's data, the highest reward of all rows."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("content_hash")
    first = F.row_number().over(w.orderBy("_new", order, F.asc_nulls_last("reward")))
    best = F.max(F.when(~F.isnan("reward"), F.col("reward"))).over(w)
    return both.withColumn("_best", best).withColumn("_rn", first).where("_rn = 1").withColumn("reward", F.col("_best")).drop("_new", "_best", "_rn")


def deduplicate(rows: DataFrame) -> DataFrame:
    """(content_hash, rows, task_id, reward): as ``upsert`` into an empty store, by aggregation alone, so that repeats are merged before the shuffle."""
    score = F.when(~F.isnan("reward"), F.col("reward"))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("rows"), F.min_by("task_id", F.struct("created_at", F.coalesce("reward", F.lit(9e9)))).alias("task_id"), F.max(score).alias("reward"))


def desirability(reward: Column, export_count: Column, created_at: Column, now: Column, feedback: Column | float = 0.5, max_export: int = 100, weights: dict[str, float] | None = None) -> Column:
    """struct(intrinsic, utility, feedback, freshness, total), each rounded to 4. Weights must sum to 1 within 0.01."""
    w = weights or WEIGHTS
    if abs(sum(w.values()) - 1) > 0.01:
        raise ValueError(f"weights sum to {sum(w.values())}, not 1")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    intrinsic = unit(F.coalesce(reward, F.lit(0.0)))
    utility = F.when(export_count <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(export_count.cast("double")) / math.log(1 + max_export)))
    voted = unit(F.coalesce(feedback, F.lit(0.5)) if isinstance(feedback, Column) else F.lit(float(feedback)))
    days = F.greatest(F.lit(0.0), (now - created_at) / 86400)
    fresh = F.when(created_at.isNull(), 1.0).otherwise(1 / (1 + days * DECAY))
    total = w["intrinsic"] * intrinsic + w["utility"] * utility + w["feedback"] * voted + w["freshness"] * fresh
    return F.struct(*(rounded(c, 4).alias(n) for c, n in ((intrinsic, "intrinsic"), (utility, "utility"), (voted, "feedback"), (fresh, "freshness"), (total, "total"))))


def feedback_update(store: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """The store with gdi_score anew where feedback is known."""
    joined = store.join(feedback.select("content_hash", F.col("feedback").alias("_f")), "content_hash", "left")
    new = desirability(F.col("reward"), F.col("export_count"), F.col("created_at"), now, F.coalesce("_f", F.lit(0.5)))["total"]
    return joined.withColumn("gdi_score", F.when(F.col("_f").isNotNull(), new).otherwise(F.col("gdi_score"))).drop("_f")


def increment_export(store: DataFrame, touched: DataFrame) -> DataFrame:
    """The store with export_count one higher for the touched hashes."""
    marked = touched.select("content_hash").distinct().withColumn("_t", F.lit(1))
    return store.join(marked, "content_hash", "left").withColumn("export_count", F.col("export_count") + F.coalesce("_t", F.lit(0))).drop("_t")


def migrate(store: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The store with columns it lacks, filled with ''."""
    for name, kind in columns.items():
        if name not in store.columns:
            store = store.withColumn(name, F.lit("").cast(kind))
    return store


# Columns by which a listing may be ordered; others fall back to gdi_score.
ORDERS = ("gdi_score", "reward", "created_at", "export_count")


def listing(store: DataFrame, order_by: str = "gdi_score", limit: int = 100, offset: int = 0, task_id: str | None = None) -> DataFrame:
    """A page of the store, best first; ties by content_hash."""
    rows = store.where(F.col("task_id") == task_id) if task_id else store
    return rows.orderBy(F.desc_nulls_last(order_by if order_by in ORDERS else "gdi_score"), "content_hash").offset(offset).limit(limit)


def since(store: DataFrame, moment: float | None, limit: int = 100) -> DataFrame:
    """The rows created after a moment, oldest first."""
    rows = store.where(F.col("created_at") > moment) if moment else store
    return rows.orderBy("created_at", "content_hash").limit(limit)


def read_best(store: DataFrame, min_reward: float = 0.0, employee: str | None = None, domain: str | None = None, limit: int = 1000) -> DataFrame:
    """Rows from a reward on, of an employee and domain if given, best first."""
    rows = store.where(F.col("reward") >= min_reward)
    for name, value in (("employee", employee), ("domain", domain)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("reward"), "content_hash").limit(limit)


def stats(store: DataFrame) -> DataFrame:
    """Counts, means rounded to 4 and the sum of exports; nulls as 0."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)), 4)
    return store.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("employee").alias("employees"), mean("reward").alias("avg_reward"), mean("gdi_score").alias("avg_gdi"), F.coalesce(F.sum("export_count"), F.lit(0)).alias("exports"))


def by_hash(store: DataFrame, hashes: list[str], prefix: bool = False) -> DataFrame:
    """The rows of given hashes (or of hashes that begin so); the filter reaches the scan."""
    if not prefix:
        return store.where(F.col("content_hash").isin(hashes))
    wanted = F.lit(False)
    for h in hashes:
        wanted = wanted | F.col("content_hash").startswith(h)
    return store.where(wanted)


def parsed_rows(store: DataFrame) -> DataFrame:
    """The rows with ``parsed`` (whether data is a JSON object or array) and ``n_steps`` of its steps (null without a list of them); data that isn't JSON is passed over."""
    v = parse_document(F.col("data"))
    at_top = F.try_variant_get(v, "$", "array<variant>")
    inside = F.try_variant_get(v, "$.steps", "array<variant>")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    return store.where("content_hash IS NOT NULL").withColumn("parsed", is_object | is_array).withColumn("n_steps", F.when(is_array, F.size(at_top)).when(inside.isNotNull(), F.size(inside)))
