"""Capping the records of dominant contributors, and the best records of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.ranking import distributed_row_number

#: Scores are counted in this many steps for each unit, within BINS_AROUND on both sides of 0; the outermost bins hold the rest.
BINS_A_UNIT = 128
BINS_AROUND = 4096


def distinct_trajectories(trajectories: DataFrame, *extra: str) -> DataFrame:
    """One row for each ``content_hash`` that isn't null: its highest reward (null or NaN is no score), highest gdi_score, and the least of each further column."""
    score = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    rows = trajectories.where("content_hash IS NOT NULL").select("content_hash", F.col("reward").cast("double").alias("reward"), F.col("gdi_score").cast("double").alias("gdi_score"), *extra)
    return rows.groupBy("content_hash").agg(score("reward"), score("gdi_score"), *(F.min(c).alias(c) for c in extra))


def best_first() -> list[Column]:
    return [F.desc_nulls_last("reward"), F.desc_nulls_last("gdi_score"), F.asc("content_hash")]


def spelling(value: Column) -> Column:
    """A contributor's name without case, blanks, kinds of dash and underscores."""
    plain = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    dashed = F.regexp_replace(plain, r"(?U)[\s_\p{Pd}−]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def contributor_parts(value: Column) -> Column:
    """The names that a value may mean: the value itself and its parts at ``/``, ``:`` and ``@`` (route or handle before, release after), each also without a date of release behind it."""
    parts = F.array_union(F.array(value), F.split(value, "[/:@]"))
    names = F.transform(parts, spelling)
    undated = F.transform(names, lambda n: F.regexp_replace(n, r"-(19|20)\d{2}-?[01]\d-?[0-3]\d$", ""))
    return F.filter(F.array_union(names, undated), lambda n: n != "")


def laminar_caps(records: DataFrame, levels: list[tuple[list[str], str]], order: list[Column]) -> DataFrame:
    """Greedy over nested caps: in each level (finest first) a group keeps its first ``cap`` of the records that the levels before kept; adds ``dropped_at`` (number of the level, null: kept).

    ``levels``: (columns of the group, column of its cap). A record whose group or cap is null isn't capped there. For nested groups this greedy choice is the best set of a laminar matroid. Each level is one ranked pass that no group can overload. ``order`` must end in a unique key.
    """
    out = records.withColumn("dropped_at", F.lit(None).cast("int"))
    for number, (group, cap) in enumerate(levels):
        counted = F.col("dropped_at").isNull() & F.col(cap).isNotNull()
        for g in group:
            counted = counted & F.col(g).isNotNull()
        ranked = distributed_row_number(out.where(counted), group, order, "__rank")
        passed = ranked.withColumn("dropped_at", F.when(F.col("__rank") > F.col(cap), F.lit(number))).drop("__rank")
        out = out.where(~counted).unionByName(passed)
    return out


def capped_trajectories(trajectories: DataFrame, contributors: DataFrame) -> DataFrame:
    """(kind, content_hash, name, kept): each trajectory by each kind of contributor by itself; ``name`` is null and ``kept`` true where the value means no known contributor.

    A contributor keeps floor(cap_pct x number of distinct content_hash / 100). Null hashes are left out; null and blank contributors mean nobody; entries of ``contributors`` that are null are passed over, and of two with one spelling the smaller cap counts. With an empty ``contributors`` nothing is capped.
    """
    one = distinct_trajectories(trajectories, "employee", "agent_model")
    both = one.select("content_hash", "reward", "gdi_score", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("employee", "agent_model")))).alias("c")).select("content_hash", "reward", "gdi_score", "c.*")
    known = contributors.where("kind IS NOT NULL AND name IS NOT NULL AND cap_pct IS NOT NULL").groupBy("kind", spelling(F.col("name")).alias("__name")).agg(F.min("name").alias("name"), F.min("cap_pct").alias("cap_pct"))
    # The values are few beside the records: each distinct one is matched once, the longest name first.
    values = both.where("value IS NOT NULL").select("kind", "value").distinct().select("kind", "value", F.explode(contributor_parts(F.col("value"))).alias("__name"))
    meant = values.join(known, ["kind", "__name"]).groupBy("kind", "value").agg(F.max_by(F.struct("name", "cap_pct"), F.struct(F.length("__name"), "__name")).alias("m")).select("kind", "value", "m.*")
    total = one.agg(F.count(F.lit(1))).scalar()
    rows = both.join(meant, ["kind", "value"], "left").withColumn("cap", F.floor(F.col("cap_pct") * total / 100))
    judged = laminar_caps(rows.select("kind", "content_hash", "name", "reward", "gdi_score", "cap"), [(["kind", "name"], "cap")], best_first())
    return judged.select("kind", "content_hash", "name", F.col("dropped_at").isNull().alias("kept"))


def top_n(rows: DataFrame, group: str, score: str, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which must begin with ``score`` descending and end in a unique key.

    A histogram of the scores gives each group the highest bin at or above which at least n of its rows lie; lower rows are filtered out before any is ranked. What remains is ranked exactly, with a limit for each group before the shuffle, so that a group whose scores are all alike doesn't gather in one task. Null groups and null scores are left out. ``rows`` may not have columns __bin and __least.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    unit = F.least(F.greatest(F.col(score) * BINS_A_UNIT, F.lit(-float(BINS_AROUND))), F.lit(float(BINS_AROUND)))
    rows = rows.withColumn("__bin", F.floor(unit).cast("int"))
    counts = rows.groupBy(group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    from_top = Window.partitionBy(group).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    # At most 2 * BINS_AROUND + 1 bins a group.
    alive = counts.withColumn("__above", F.coalesce(F.sum("__n").over(from_top), F.lit(0))).where(F.col("__above") < n).select(group, "__bin")
    ranked = rows.join(alive, [group, "__bin"], "left_semi").drop("__bin")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def best_of_tasks(trajectories: DataFrame, n: int = 3) -> DataFrame:
    """(task_id, content_hash, reward, gdi_score, rank): the best trajectories of each task, tasks trimmed and in lower case.

    Trajectories without a score (null or NaN) and null or blank tasks are left out; ties go by gdi_score (null last), then content_hash.
    """
    task = F.lower(F.regexp_replace("task_id", r"(?U)^\s+|\s+$", ""))
    one = distinct_trajectories(trajectories.withColumn("task_id", task), "task_id").where("task_id <> ''")
    return top_n(one, "task_id", "reward", n, best_first()).select("task_id", "content_hash", "reward", "gdi_score", "rank")
