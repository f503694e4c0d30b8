"""Trajectories and steps derived from the ``events`` and ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.runtime import table

#: The instant at which ages are taken.
NOW = "2024-02-01 00:00:00"

STEPS_SQL = """
SELECT traj_id, task_id, user_id, week, event_id, ts, row_number() OVER (PARTITION BY traj_id ORDER BY ts, event_id) - 1 AS ord, tool, k,
  concat('src/mod_', CAST(k % 5 AS VARCHAR(9)), '.py') AS target,
  CASE WHEN tool = 'edit_file' THEN concat('v', CAST(k % 2 AS VARCHAR(9))) ELSE '' END AS old_s,
  CASE WHEN tool = 'edit_file' THEN concat('v', CAST(1 - k % 2 AS VARCHAR(9))) ELSE '' END AS new_s,
  concat('see src/mod_', CAST(event_id % 5 AS VARCHAR(9)), '.py') AS output, value
FROM (
  SELECT event_id, user_id, ts, value, concat('t', CAST(user_id AS VARCHAR(20))) AS task_id, CAST(floor((dayofyear(ts) - 1) / 7) AS INT) AS week,
    concat('t', CAST(user_id AS VARCHAR(20)), '-w', CAST(CAST(floor((dayofyear(ts) - 1) / 7) AS INT) AS VARCHAR(9))) AS traj_id,
    CASE event_type WHEN 'view' THEN 'read_file' WHEN 'signup' THEN 'grep' WHEN 'click' THEN 'edit_file' WHEN 'error' THEN 'bash' WHEN 'purchase' THEN 'submit' END AS tool,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM {events}) e
"""

TRAJECTORIES_SQL = """
SELECT traj_id, task_id, user_id, count(*) AS n_steps,
  CASE WHEN max_by(tool, ord) IN ('submit', 'read_file') THEN 1 ELSE 0 END AS success,
  concat('model-', CAST((user_id + max(week)) % 4 AS VARCHAR(9))) AS agent_model, concat('emp-', CAST(user_id % 10 AS VARCHAR(9))) AS employee,
  user_id % 20 AS export_count, max(ts) AS last_ts, round(avg(value), 6) AS mean_value
FROM {steps} s GROUP BY traj_id, task_id, user_id
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a step, numbered from 0 in its trajectory (a user's week)."""
    return spark.sql(STEPS_SQL, events=table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


def trajectories(step_rows: DataFrame) -> DataFrame:
    """One row a trajectory."""
    return step_rows.sparkSession.sql(TRAJECTORIES_SQL, steps=step_rows).withColumn("created_at", F.unix_micros(F.col("last_ts").cast("timestamp")) / 1e6)


def tables_sql() -> str:
    """The same as common table expressions for the SQL checks."""
    steps_sql = STEPS_SQL.replace("{events}", "events")
    trajs = TRAJECTORIES_SQL.replace("{steps}", "steps").replace("SELECT traj_id", "SELECT epoch(max(ts)) AS created_at, traj_id", 1)
    return f"WITH steps AS ({steps_sql}),\ntrajs AS ({trajs})"
