"""Progress and consensus while verdicts arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeflow.sources.files import last_rows


def progress(verdicts: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Answers done for each model, each (config_id, case_id) once; the watermark bounds what is remembered."""
    return verdicts.withWatermark(ts, late).dropDuplicatesWithinWatermark(["config_id", "case_id"]).groupBy("config_id").agg(F.count("*").alias("done"))


def incremental(verdicts: DataFrame, path: str, checkpoint: str, summarise: Callable[[DataFrame], DataFrame], judge: str = "judge_id", order: str | None = None) -> StreamingQuery:
    """A consensus of the touched answers for each batch, into a folder of the batch.

    The verdicts of an answer are the state of a streaming aggregation on (config_id, case_id): a batch reads
    and writes the state of its own answers only, however long the history. ``summarise`` gets all
    verdicts of the touched answers, a judge's greatest by ``order`` where that is given; a verdict
    that repeats in every column counts once. Late verdicts join their answer whenever they come, as
    no watermark ends an answer, and a batch that runs again overwrites its folder. Columns must not
    be maps. Long histories want the RocksDB state store with changelog checkpoints.
    """
    key = ["config_id", "case_id"]
    held = verdicts.groupBy(*key).agg(F.collect_set(F.struct(*[c for c in verdicts.columns if c not in key])).alias("held"))

    def told(batch: DataFrame, number: int) -> None:
        rows = batch.select(*key, F.inline("held"))
        if order is not None:
            rows = last_rows(rows, [*key, judge], order)
        summarise(rows).write.mode("overwrite").parquet(f"{path}/consensus/batch={number}")

    return held.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(told).trigger(availableNow=True).start()


#: Fixed value: marks of a run log: an event, its model, and how many of how many it has done.
_EVENT = r"^(?:DRY\s+)?(ANSWER_DONE|JUDGE_DONE|JUDGE_START)\s+\[([^\]]+)\]\s+(\d+)/(\d+)\s+(\S+)"


def log_progress(lines: DataFrame) -> DataFrame:
    """How far each model's answers and verdicts are, from the lines of run logs as they grow (R2).

    Takes ``value``; other lines are passed over. The state is one row for each model and event.
    """
    part = lambda k: F.regexp_extract("value", _EVENT, k)
    events = lines.where(F.col("value").rlike(_EVENT)).select(part(2).alias("config_id"), part(1).alias("event"), part(3).cast("long").alias("done"), part(4).cast("long").alias("total"))
    return events.groupBy("config_id", "event").agg(F.max("done").alias("done"), F.max("total").alias("total"))


def conflict_feed(verdicts: DataFrame, path: str, checkpoint: str, conflicts: Callable[[DataFrame], DataFrame], **how: str | None) -> StreamingQuery:
    """Keys of answers whose judges disagree, for an arbiter, as verdicts arrive.

    ``conflicts`` marks answers from all their verdicts. A batch looks at the answers it touched and
    writes those in conflict to a folder of its own, which a batch that runs again overwrites; an
    answer can stand in several folders.
    """

    def found(df: DataFrame) -> DataFrame:
        return conflicts(df).where("conflict").select("config_id", "case_id", "reason")

    return incremental(verdicts, path, checkpoint, found, **how)
