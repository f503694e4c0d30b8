"""Incremental ingest and per-episode state on Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from stepweave.operators import store
from stepweave.operators.ranking import distributed_row_number
from stepweave.sources import logs


#: Bytes of a batch, at most, unless one line alone is longer.
BATCH_BYTES = 8 << 20


class _TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int = BATCH_BYTES) -> None:
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _from(self, at: int) -> tuple[list[tuple[str]], int]:
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        if size < at:
            at = 0  # the file was begun anew
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(min(self.most, size - at))
            while b"\n" not in data and at + len(data) < size:  # one line is longer than a batch
                data += f.read(self.most)
        end = data.rfind(b"\n") + 1  # a line without its end stays for the next batch
        return [(x.decode("utf-8", "replace"),) for x in data[:end].split(b"\n") if x.strip()], at + end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not os.path.exists(self.path):
            return iter([]), start
        rows, end = self._from(start["at"])
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            at = start["at"] if start["at"] <= end["at"] else 0
            f.seek(at)
            return iter([(x.decode("utf-8", "replace"),) for x in f.read(end["at"] - at).split(b"\n") if x.strip()])

    def commit(self, end: dict) -> None:
        pass


class JsonLinesTail(DataSource):
    """A growing file of lines: ``format("stepweave_tail").option("path", ...)``; the offset is in bytes, up to the last whole line; a file that shrank is read from its start."""

    @classmethod
    def name(cls) -> str:
        return "stepweave_tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options["path"], int(self.options.get("maxBytesPerBatch", BATCH_BYTES)))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a growing file as a stream."""
    spark.dataSource.register(JsonLinesTail)
    return spark.readStream.format("stepweave_tail").option("path", path).load()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert_into(path: str):
    """For ``foreachBatch``: writes each batch of store rows, one a content hash, as a folder of its own below ``path`` on any file system of the cluster. A batch costs what it holds, nothing is rewritten, and a batch run again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id}"
        if not _exists(batch.sparkSession, f"{target}/_SUCCESS"):
            store.upsert(batch.limit(0), batch).write.mode("overwrite").parquet(target)

    return merge


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store that ``upsert_into`` keeps: of each hash the first batch's row with the highest reward of all. Rows are merged by partial aggregation, so no hash is gathered."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("content_hash", "reward", "batch")]
    first = F.min_by(F.struct(*rest), F.struct("batch", "created_at"))
    return rows.groupBy("content_hash").agg(first.alias("_f"), F.max(F.when(~F.isnan("reward"), F.col("reward"))).alias("reward")).select("content_hash", "reward", "_f.*")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The merged store as one batch at ``target``, from which new batches may go on."""
    read_store(spark, path).write.mode("overwrite").parquet(f"{target}/batch=0")


def _hub_rows(batch: DataFrame) -> DataFrame:
    """Trajectories of lines in the crew's layout, with the content hash of their steps; ``ok`` is false for lines that aren't such objects."""
    kind = "task STRUCT<task_id: STRING, description: STRING, domain: STRING>, agent STRING, model STRING, steps ARRAY<STRUCT<thought: STRING, tool_call: STRUCT<name: STRING, parameters: STRING>, tool_result: STRUCT<output: STRING>>>, outcome STRUCT<success: BOOLEAN, total_steps: INT, reward: DOUBLE>, metadata STRING"
    rows = batch.select("value", F.from_json("value", kind).alias("t"), (F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")).alias("ok"))
    flat = rows.select("value", "ok", "t.*", F.sha2("value", 256).alias("traj_id"))
    return flat.withColumn("content_hash", store.content_hash(F.col("value"))).withColumn("reward", F.coalesce("outcome.reward", F.lit(0.0)))


def crew_ingest(path: str):
    """For ``foreachBatch`` over a tail of crew lines: converts each batch, upserts it into the store at ``path``/store and writes its numbers (ingested, errors) to ``path``/numbers; lines that aren't JSON objects are errors and lost to nobody else."""
    merge = upsert_into(f"{path}/store")

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = _hub_rows(batch).withColumn("created_at", F.lit(float(batch_id)))
        good = rows.where("ok AND content_hash IS NOT NULL")
        merge(good.select("traj_id", "content_hash", "reward", "created_at").join(logs.crew_trajectories(good), "traj_id").drop("traj_id"), batch_id)
        rows.agg(F.count_if(F.col("ok") & F.col("content_hash").isNotNull()).alias("ingested"), F.count_if(~F.col("ok") | F.col("content_hash").isNull()).alias("errors")).write.mode("overwrite").json(f"{path}/numbers/batch={batch_id}")

    return take


def new_lines(spark: SparkSession, path: str, cursor: int) -> tuple[DataFrame, int]:
    """(the lines of a file from number ``cursor`` on, without blank ones; the next cursor). Lines are numbered from 1."""
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    numbered = distributed_row_number(lines.withColumn("_all", F.lit(0)), ["_all"], [F.asc("_id")], "line")
    total = numbered.agg(F.coalesce(F.max("line"), F.lit(0))).first()[0]
    return numbered.where((F.col("line") >= cursor) & (F.trim("value") != "")).select("value", "line"), total + 1


def episode_sums(steps: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """A stream of (episode, steps, total, done) from a stream of (episode, reward, done, at): emitted when an episode is done, or given up after ``timeout`` of event time without an event, which the batch form doesn't know."""

    wait = int(steps.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {timeout}"))).alias("ms")).first()["ms"])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"episode": [key[0]], "steps": [n], "total": [round(total, 4)], "done": [False]})
            return
        ended, last = False, state.getCurrentWatermarkMs()
        for b in batches:
            last = max(last, int(b["at"].max().timestamp() * 1000))
            n, total, ended = n + len(b), total + float(b["reward"].sum()), ended or bool(b["done"].any())
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"episode": [key[0]], "steps": [n], "total": [round(total, 4)], "done": [True]})
        else:
            state.update((n, total))
            state.setTimeoutTimestamp(last + wait)

    marked = steps.withWatermark("at", timeout)
    return marked.groupBy("episode").applyInPandasWithState(run, "episode string, steps bigint, total double, done boolean", "n bigint, total double", "update", "EventTimeTimeout")


def session_trajectories(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users by gaps in event time; an addition, as the logs have no such operator. Works on batches and, with a watermark, on streams."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "total")
