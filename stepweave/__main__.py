"""``python -m stepweave VERB ...``: the main flows over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stepweave import sinks
from stepweave.operators import export, pairs, statistics
from stepweave.plans import flows
from stepweave.sources import logs
from stepweave.sources.files import write_lines


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="stepweave")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, text in (("process", "event logs (parquet) to trajectories with rewards"), ("validate", "checks a set of trajectories"), ("card", "the data card of a set"), ("compare", "agents by their rewards"), ("pairs", "preference pairs of a set"), ("split", "parts of a set")):
        v = verbs.add_parser(name, help=text)
        v.add_argument("source")
        v.add_argument("--out")
    a = p.parse_args(given)
    spark = spark or SparkSession.builder.getOrCreate()
    rows = spark.read.parquet(a.source)
    if a.verb == "process":
        found = flows.hub_trajectories(logs.openhands_trajectories(logs.event_log(rows)), flows.log_rewards(logs.event_log(rows)))
    elif a.verb == "validate":
        found = export.validate_trajectories(rows.select("task_id", "success", "reward", F.col("total_steps").alias("n_steps"), F.length("data").alias("text_length")))
    elif a.verb == "card":
        found = sinks.datacard(rows.withColumn("n_steps", F.col("total_steps")))
    elif a.verb == "compare":
        found = statistics.compare_agents(rows.where("reward IS NOT NULL AND NOT isnan(reward) AND agent_model IS NOT NULL"))
    elif a.verb == "pairs":
        found = pairs.adjacent_pairs(rows.where("reward IS NOT NULL AND NOT isnan(reward)").select("task_id", "reward", F.col("content_hash").alias("traj_id")).distinct())
    else:
        found = export.split(rows.select("content_hash").distinct(), "content_hash")
    if a.out:
        write_lines(found, a.out)
    else:
        found.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
